"""Fixed values of the domain: names, lists and weights that results depend on."""

from __future__ import annotations

# Generation sources used for carbon accounting.
GENERATION_SOURCES = ("nuclear", "gas", "coal", "oil", "wind", "solar", "hydro", "bioenergy")

# Fields that add up to total production.
PRODUCTION_SOURCES = (
    "nuclear", "thermal", "gas", "coal", "oil", "wind", "solar", "hydro", "bioenergy",
)

# National quarter-hour record field -> canonical measure.
NATIONAL_FIELDS = {
    "consommation": "consumption_mwh",
    "nucleaire": "nuclear_mwh",
    "gaz": "gas_mwh",
    "charbon": "coal_mwh",
    "fioul": "oil_mwh",
    "eolien": "wind_mwh",
    "eolien_terrestre": "onshore_wind_mwh",
    "eolien_offshore": "offshore_wind_mwh",
    "solaire": "solar_mwh",
    "hydraulique": "hydro_mwh",
    "pompage": "pumped_storage_mwh",
    "bioenergies": "bioenergy_mwh",
    "stockage_batterie": "battery_storage_mwh",
    "ech_physiques": "physical_exchanges_mwh",
}

# Regional quarter-hour record field -> canonical measure.
REGIONAL_FIELDS = {
    "consommation": "consumption_mwh",
    "thermique": "thermal_mwh",
    "nucleaire": "nuclear_mwh",
    "eolien": "wind_mwh",
    "solaire": "solar_mwh",
    "hydraulique": "hydro_mwh",
    "pompage": "pumped_storage_mwh",
    "bioenergies": "bioenergy_mwh",
    "stockage_batterie": "battery_storage_mwh",
    "destockage_batterie": "battery_storage_mwh",
    "ech_physiques": "physical_exchanges_mwh",
}

# Weather payload variable -> canonical measure.
WEATHER_FIELDS = {
    "temperature_2m": "temperature_c",
    "apparent_temperature": "apparent_temperature_c",
    "relative_humidity_2m": "relative_humidity_2m_pct",
    "dew_point_2m": "dew_point_2m_c",
    "precipitation": "precipitation_mm",
    "rain": "rain_mm",
    "snowfall": "snowfall_cm",
    "cloud_cover": "cloud_cover_pct",
    "cloud_cover_low": "cloud_cover_low_pct",
    "cloud_cover_mid": "cloud_cover_mid_pct",
    "cloud_cover_high": "cloud_cover_high_pct",
    "shortwave_radiation": "shortwave_radiation_wm2",
    "direct_radiation": "direct_radiation_wm2",
    "diffuse_radiation": "diffuse_radiation_wm2",
    "wind_speed_10m": "wind_speed_mps",
    "wind_speed_80m": "wind_speed_80m_mps",
    "wind_direction_10m": "wind_direction_10m_deg",
    "wind_direction_80m": "wind_direction_80m_deg",
    "wind_gusts_10m": "wind_gusts_10m_mps",
    "surface_pressure": "surface_pressure_hpa",
    "weather_code": "weather_code",
}

# Region, representative city, latitude, longitude.
REGIONAL_LOCATIONS = (
    ("Auvergne-Rhône-Alpes", "Lyon", 45.7640, 4.8357),
    ("Bourgogne-Franche-Comté", "Dijon", 47.3220, 5.0415),
    ("Bretagne", "Rennes", 48.1173, -1.6778),
    ("Centre-Val de Loire", "Orléans", 47.9029, 1.9093),
    ("Grand Est", "Strasbourg", 48.5734, 7.7521),
    ("Hauts-de-France", "Lille", 50.6292, 3.0573),
    ("Île-de-France", "Paris", 48.8566, 2.3522),
    ("Normandie", "Rouen", 49.4431, 1.0993),
    ("Nouvelle-Aquitaine", "Bordeaux", 44.8378, -0.5792),
    ("Occitanie", "Toulouse", 43.6047, 1.4442),
    ("Pays de la Loire", "Nantes", 47.2184, -1.5536),
    ("Provence-Alpes-Côte d'Azur", "Marseille", 43.2965, 5.3698),
)
NATIONAL_LOCATION = ("FR", "Paris", 48.8566, 2.3522)

NATIONAL_REGION = "FR"
DAY_AHEAD_MARKET = "day_ahead"
PRICE_UNIT = "EUR / MWh"
INTERVAL_HOURS = "0.25"
NATIONAL_SCOPE = "national"
REGIONAL_SCOPE = "regional"

# Extraction window lengths in days.
MIX_WINDOW_DAYS = 7
WEATHER_WINDOW_DAYS = 31
PRICE_WINDOW_DAYS = 365

# Scenario name, price weight, carbon weight.
SCENARIOS = (
    ("clean_first", 0.2, 0.8),
    ("balanced", 0.5, 0.5),
    ("cost_aware_clean", 0.4, 0.6),
)

# Champion score weights.
CHAMPION_WEIGHTS = {
    "carbon_intensity_error": 0.45,
    "carbon_regret": 0.25,
    "top_5_ranking_loss": 0.2,
    "price_direction_error": 0.1,
}

# Weights of the confidence score.
RANK_WEIGHT, AGREEMENT_WEIGHT, MARGIN_WEIGHT = 0.45, 0.35, 0.20

NAIVE_MODEL = "naive_lag_24h"
DIRECT_METHODOLOGY = "direct_operational_emissions"

# Lag distances and rolling widths in hours.
LAG_HOURS = (1, 24, 48, 72, 168, 336)
MEAN_HOURS = (24, 168)
SPREAD_HOURS = 24

# Feature table columns by family, in the order of the output.
CALENDAR_COLUMNS = (
    "hour", "day_of_week", "month", "day_of_year", "is_weekend", "is_peak_hour",
    "is_morning_ramp", "is_evening_peak", "is_overnight", "hour_sin", "hour_cos",
    "day_of_year_sin", "day_of_year_cos",
)
MIX_COLUMNS = (
    "consumption_mwh", "total_production_mwh", "nuclear_mwh", "thermal_mwh", "gas_mwh", "coal_mwh",
    "oil_mwh", "wind_mwh", "solar_mwh", "hydro_mwh", "bioenergy_mwh", "physical_exchanges_mwh",
)
POWER_MIX_COLUMNS = (
    "renewable_mwh", "fossil_mwh", "renewable_share", "nuclear_share", "fossil_share",
    "residual_demand_mwh", "supply_demand_gap_mwh",
)
WEATHER_AGG_COLUMNS = (
    "avg_temperature_c", "min_temperature_c", "max_temperature_c", "avg_apparent_temperature_c",
    "avg_wind_speed_mps", "avg_wind_speed_80m_mps", "avg_shortwave_radiation_wm2",
    "avg_cloud_cover_pct", "avg_precipitation_mm", "total_precipitation_mm",
    "avg_surface_pressure_hpa",
)

# Target column -> feature prefix, for every series that gets lag and rolling features.
FEATURE_TARGETS = {
    "price_eur_mwh": "price",
    "consumption_mwh": "consumption",
    "total_production_mwh": "total_production",
    **{f"{source}_mwh": source for source in GENERATION_SOURCES},
}

# Forecast target name -> (column, feature prefix).
FORECAST_TARGETS = {
    "consumption": ("consumption_mwh", "consumption"),
    "production": ("total_production_mwh", "total_production"),
    **{source: (f"{source}_mwh", source) for source in GENERATION_SOURCES},
}


def lag_feature_names(prefix: str) -> list[str]:
    """The fourteen lag and rolling feature names of one target."""
    return [
        *[f"{prefix}_lag_{h}h" for h in LAG_HOURS],
        *[f"{prefix}_rolling_mean_{h}h" for h in MEAN_HOURS],
        *[f"{prefix}_rolling_{stat}_{SPREAD_HOURS}h" for stat in ("std", "min", "max", "range")],
        f"{prefix}_lag_1h_to_24h",
        f"{prefix}_lag_24h_to_168h",
    ]


def contrast_feature_names(prefix: str) -> list[str]:
    """Day lag, week lag and their difference."""
    return [f"{prefix}_lag_24h", f"{prefix}_lag_168h", f"{prefix}_lag_24h_to_168h"]


PRICE_FEATURES = [*lag_feature_names("price"), "price_lag_168h_to_336h", "price_vs_rolling_mean_24h"]
DEMAND_CONTRASTS = [*contrast_feature_names("residual_demand"), *contrast_feature_names("variable_renewable")]


def modeling_columns() -> list[str]:
    """Every column of the modelling table, each once."""
    names = [
        "timestamp_utc", "price_eur_mwh", *MIX_COLUMNS, *POWER_MIX_COLUMNS, *WEATHER_AGG_COLUMNS,
        *CALENDAR_COLUMNS, *PRICE_FEATURES, *lag_feature_names("consumption"),
        *lag_feature_names("total_production"), *contrast_feature_names("wind"),
        *contrast_feature_names("solar"), *DEMAND_CONTRASTS,
    ]
    for source in GENERATION_SOURCES:
        names.extend(lag_feature_names(source))
    return list(dict.fromkeys(names))


def base_price_features() -> list[str]:
    """Model inputs known before delivery: calendar and lagged values only."""
    return [
        *CALENDAR_COLUMNS, *PRICE_FEATURES, *lag_feature_names("consumption"),
        *lag_feature_names("total_production"), *contrast_feature_names("wind"),
        *contrast_feature_names("solar"), *DEMAND_CONTRASTS,
    ]


SIGNAL_FEATURES = [
    "forecast_consumption_mwh", "forecast_total_production_mwh",
    "forecast_residual_demand_mwh", "forecast_supply_demand_gap_mwh",
]


def strict_price_features() -> list[str]:
    return [*base_price_features(), *SIGNAL_FEATURES]


def target_features(prefix: str) -> list[str]:
    """Model inputs of one supply or demand target."""
    return [*CALENDAR_COLUMNS, *lag_feature_names(prefix)]


# Columns that must be present for a row to enter the modelling table.
# Columns a modelling row must have.
REQUIRED_MODELING_COLUMNS = [
    "price_eur_mwh", "consumption_mwh", "total_production_mwh", "price_lag_168h", "price_lag_336h",
    "price_rolling_mean_168h", "consumption_lag_24h", "consumption_lag_168h", "wind_lag_24h",
    "wind_lag_168h", "solar_lag_24h", "solar_lag_168h",
]

# Dataset names of the sources; provisional ones are revised later.
PRICE_DATASET, WEATHER_DATASET = "day_ahead_prices", "historical_weather"
NATIONAL_DATASET, REGIONAL_DATASET = "eco2mix-national-cons-def", "eco2mix-regional-cons-def"
NATIONAL_PROVISIONAL_DATASET, REGIONAL_PROVISIONAL_DATASET = "eco2mix-national-tr", "eco2mix-regional-tr"
