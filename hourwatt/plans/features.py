"""The modelling feature table: joins, power mix, calendar and trailing features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourwatt import constants as C
from hourwatt.functions.numeric import to_double
from hourwatt.operators.calendar import TS, add_calendar
from hourwatt.operators.carbon import require_columns
from hourwatt.operators.power_mix import add_power_mix
from hourwatt.operators.trailing import BUCKET_HOURS, add_trailing_features
from hourwatt.sources.upsert import keep_one


def compact_weather(weather: DataFrame, keys: Sequence[str] = (), ts: str = TS) -> DataFrame:
    """Weather over all regions per timestamp."""
    means = {
        "avg_temperature_c": "temperature_c", "avg_apparent_temperature_c": "apparent_temperature_c",
        "avg_wind_speed_mps": "wind_speed_mps", "avg_wind_speed_80m_mps": "wind_speed_80m_mps",
        "avg_shortwave_radiation_wm2": "shortwave_radiation_wm2", "avg_cloud_cover_pct": "cloud_cover_pct",
        "avg_precipitation_mm": "precipitation_mm", "avg_surface_pressure_hpa": "surface_pressure_hpa",
    }
    return weather.groupBy(*keys, ts).agg(
        *[F.avg(column).alias(name) for name, column in means.items()],
        F.min("temperature_c").alias("min_temperature_c"),
        F.max("temperature_c").alias("max_temperature_c"),
        F.sum("precipitation_mm").alias("total_precipitation_mm"),
    ).select(*keys, ts, *C.WEATHER_AGG_COLUMNS)


def price_mix_weather(prices: DataFrame, mix: DataFrame, weather_agg: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """National day-ahead prices with their hour's generation mix (inner) and compact weather (left)."""
    on = [*keys, TS]
    price = prices.filter((F.col("region") == C.NATIONAL_REGION) & (F.col("market") == C.DAY_AHEAD_MARKET)).select(*on, "price_eur_mwh")
    national = mix.filter((F.col("scope") == C.NATIONAL_SCOPE) & (F.col("region") == C.NATIONAL_REGION))
    absent = {c: F.lit(None).cast("double") for c in C.MIX_COLUMNS if c not in mix.columns}
    national = (national.withColumns(absent) if absent else national).select(*on, *C.MIX_COLUMNS)
    return price.join(national, on).join(weather_agg, on, "left")


def hourly_features_view(mix: DataFrame, prices: DataFrame, weather: DataFrame) -> DataFrame:
    """Mix rows with the national price and the own region's weather of the same hour.

    National rows get no weather: weather regions are the twelve regional names.
    """
    hour = F.date_trunc("hour", TS)
    price = prices.filter((F.col("region") == C.NATIONAL_REGION) & (F.col("market") == C.DAY_AHEAD_MARKET)).select(
        hour.alias("_hour"), "price_eur_mwh"
    )
    skip = {"source", "source_record_id", "granularity", "ingestion_timestamp_utc", TS, "solar_irradiance_wm2", "humidity_pct"}
    local = weather.select(hour.alias("_hour"), *[c for c in weather.columns if c not in skip])
    keep = [c for c in mix.columns if c not in {"source", "source_record_id", "granularity", "ingestion_timestamp_utc"}]
    return mix.select(*keep, hour.alias("_hour")).join(price, "_hour", "left").join(local, ["_hour", "region"], "left").drop("_hour")


def modeling_features(base: DataFrame, keys: Sequence[str] = (), bucket_hours: int = BUCKET_HOURS) -> DataFrame:
    """The full feature table from the joined base rows (one row per hour after the first step).

    Of rows with the same timestamp one survives, the lowest by all its values, so the choice does not
    depend on the order of the input.
    """
    numeric = [c for c in base.columns if c not in (*keys, TS)]
    typed = base.select(*keys, TS, *[to_double(F.col(c)).alias(c) for c in numeric])
    unique = keep_one(typed, [*keys, TS], *numeric)
    # Rows off the hour grid are dropped, as densifying to hours would do.
    on_grid = unique.filter(F.col(TS) == F.date_trunc("hour", TS))
    wide = add_trailing_features(add_calendar(add_power_mix(on_grid)), keys, bucket_hours=bucket_hours)
    return wide.na.drop(subset=C.REQUIRED_MODELING_COLUMNS).select(*keys, *C.modeling_columns())


def complete_features(export: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Add only the strict features an older export lacks, then keep rows usable for modelling."""
    require_columns(export, {TS, "price_eur_mwh", "consumption_mwh", "total_production_mwh"}, "feature export")
    others = [c for c in export.columns if c not in (*keys, TS)]
    unique = keep_one(export, [*keys, TS], *others)
    full = add_trailing_features(add_calendar(unique, only_missing=True), keys, only_missing=True)
    return full.na.drop(subset=["price_eur_mwh", *C.base_price_features()])
