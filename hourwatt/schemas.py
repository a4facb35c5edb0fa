"""Canonical table schemas, keys and constraint rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourwatt import constants as C

MEASURE = T.DecimalType(18, 6)

# Allowed source categories and granularities.
SOURCES = ("api", "csv", "manual")
GRANULARITIES = ("5m", "15m", "30m", "1h", "1d")
STATUSES = ("running", "completed", "failed")

_OBSERVATION = [
    T.StructField("source", T.StringType(), False),
    T.StructField("source_record_id", T.StringType()),
    T.StructField("region", T.StringType(), False),
    T.StructField("timestamp_utc", T.TimestampType(), False),
    T.StructField("granularity", T.StringType(), False),
]
_INGESTED = [T.StructField("ingestion_timestamp_utc", T.TimestampType())]


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


def _measures(*names: str) -> list[T.StructField]:
    return [T.StructField(n, MEASURE) for n in names]


MIX_MEASURES = list(
    dict.fromkeys(
        ["consumption_mwh", "total_production_mwh", *C.REGIONAL_FIELDS.values(), *C.NATIONAL_FIELDS.values()]
    )
)
MIX_NONNEGATIVE = [m for m in MIX_MEASURES if m not in ("pumped_storage_mwh", "battery_storage_mwh", "physical_exchanges_mwh")]
WEATHER_MEASURES = [*[m for m in C.WEATHER_FIELDS.values() if m != "weather_code"], "solar_irradiance_wm2", "humidity_pct"]
WEATHER_PERCENT = [m for m in WEATHER_MEASURES if m.endswith("_pct")]
WEATHER_DEGREES = [m for m in WEATHER_MEASURES if m.endswith("_deg")]
WEATHER_NONNEGATIVE = [
    m for m in WEATHER_MEASURES
    if m not in WEATHER_PERCENT and m not in WEATHER_DEGREES and m not in ("temperature_c", "apparent_temperature_c", "dew_point_2m_c")
]

RAW_PAGES = T.StructType(
    _strings("source_name", "endpoint", "request_params", "response_payload") + [T.StructField("ingested_at", T.TimestampType())]
)
CHECKPOINTS = T.StructType(
    _strings("source_name", "dataset_name", "region")
    + [T.StructField("window_start_date", T.DateType()), T.StructField("window_end_date", T.DateType())]
    + _strings("status")
    + [T.StructField("rows_loaded", T.LongType())]
    + _strings("error_message")
    + [T.StructField(n, T.TimestampType()) for n in ("started_at", "finished_at", "updated_at")]
)
PRICES = T.StructType(_OBSERVATION + _strings("market") + _measures("price_eur_mwh") + _strings("currency") + _INGESTED)
MIX = T.StructType(_OBSERVATION + _strings("scope") + _measures(*MIX_MEASURES, "carbon_intensity_gco2_kwh") + _INGESTED)
WEATHER = T.StructType(
    _OBSERVATION + _measures(*WEATHER_MEASURES) + [T.StructField("weather_code", T.IntegerType())] + _INGESTED
)
CARBON_INTENSITY = T.StructType(_OBSERVATION + _measures("carbon_intensity_gco2_kwh") + _strings("estimation_method") + _INGESTED)
GRID_DEMAND = T.StructType(_OBSERVATION + _measures("demand_mw") + _strings("demand_type") + _INGESTED)
RENEWABLE_GENERATION = T.StructType(_OBSERVATION + _measures("generation_mw") + _strings("technology") + _INGESTED)
WORKLOADS = T.StructType(
    _strings("workload_id", "region")
    + [T.StructField(n, T.TimestampType()) for n in ("earliest_start_utc", "latest_end_utc")]
    + [T.StructField("duration_minutes", T.IntegerType())]
    + _measures("power_kw")
    + [T.StructField("max_delay_minutes", T.IntegerType())]
    + _strings("service_level")
)
PREDICTIONS = T.StructType(
    [T.StructField("timestamp_utc", T.TimestampType())]
    + _strings("window", "target", "model")
    + [T.StructField(n, T.DoubleType()) for n in ("actual_mwh", "predicted_mwh")]
)

RECORD_KEY = ["source", "source_record_id"]
NATURAL_KEYS = {
    "electricity_prices": ["region", "timestamp_utc", "granularity", "market", "source"],
    "hourly_electricity_mix": ["region", "scope", "timestamp_utc", "source"],
    "weather_observations": ["region", "timestamp_utc", "granularity", "source"],
    "carbon_intensity": ["region", "timestamp_utc", "granularity", "source"],
    "grid_demand": ["region", "timestamp_utc", "granularity", "demand_type", "source"],
    "renewable_generation": ["region", "timestamp_utc", "granularity", "technology", "source"],
}


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast to a canonical schema; unknown columns are refused, missing nullable ones become null."""
    extra = sorted(set(df.columns) - set(schema.names))
    if extra:
        raise ValueError(f"unexpected columns: {extra}")
    missing = [f.name for f in schema.fields if f.name not in df.columns and not f.nullable]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df.select(
        *[
            F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def _nullable(name: str, rule: Column) -> Column:
    return F.col(name).isNull() | rule


def observation_rules() -> dict[str, Column]:
    return {
        "source_known": F.col("source").isin(*SOURCES),
        "region_not_empty": F.length("region") >= 1,
        "timestamp_present": F.col("timestamp_utc").isNotNull(),
        "granularity_known": F.col("granularity").isin(*GRANULARITIES),
    }


def price_rules() -> dict[str, Column]:
    return observation_rules() | {
        "market_not_empty": F.length("market") >= 1,
        "price_present": F.col("price_eur_mwh").isNotNull(),
        "currency_three_letters": F.length("currency") == 3,
    }


def mix_rules() -> dict[str, Column]:
    rules = {f"{m}_not_negative": _nullable(m, F.col(m) >= 0) for m in [*MIX_NONNEGATIVE, "carbon_intensity_gco2_kwh"]}
    return observation_rules() | {"scope_known": F.col("scope").isin(C.NATIONAL_SCOPE, C.REGIONAL_SCOPE)} | rules


def weather_rules() -> dict[str, Column]:
    rules = {f"{m}_not_negative": _nullable(m, F.col(m) >= 0) for m in WEATHER_NONNEGATIVE}
    rules |= {f"{m}_percent": _nullable(m, F.col(m).between(0, 100)) for m in WEATHER_PERCENT}
    rules |= {f"{m}_degrees": _nullable(m, F.col(m).between(0, 360)) for m in WEATHER_DEGREES}
    return observation_rules() | rules


def checkpoint_rules() -> dict[str, Column]:
    return {
        "status_known": F.col("status").isin(*STATUSES),
        "rows_loaded_not_negative": F.col("rows_loaded") >= 0,
        "window_ordered": F.col("window_end_date") >= F.col("window_start_date"),
    }


def workload_rules() -> dict[str, Column]:
    return {
        "workload_id_not_empty": F.length("workload_id") >= 1,
        "region_not_empty": F.length("region") >= 1,
        "duration_positive": F.col("duration_minutes") > 0,
        "power_positive": F.col("power_kw") > 0,
        "max_delay_not_negative": F.col("max_delay_minutes") >= 0,
        "end_after_start": F.col("latest_end_utc") > F.col("earliest_start_utc"),
    }
