"""Expected hours, gaps and densification."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourwatt.operators.calendar import TS


def observed_hours(df: DataFrame, keys: Sequence[str], ts: str = TS) -> DataFrame:
    """Distinct (keys, hour); the distinct is combined map-side, so a hot key shuffles few rows."""
    return df.select(*keys, F.date_trunc("hour", F.col(ts)).alias(TS)).distinct()


def expected_hours(df: DataFrame, keys: Sequence[str], ts: str = TS) -> DataFrame:
    """Every hour between each key's own first and last hour."""
    hour = F.date_trunc("hour", F.col(ts))
    bounds = df.groupBy(*keys).agg(F.min(hour).alias("first_hour"), F.max(hour).alias("last_hour"))
    hours = F.sequence("first_hour", "last_hour", F.expr("interval 1 hour"))
    return bounds.select(*keys, F.explode(hours).alias(TS))


def missing_hours(df: DataFrame, keys: Sequence[str], ts: str = TS) -> DataFrame:
    """Hours inside each key's range that have no row."""
    seen = observed_hours(df, keys, ts)
    # Bounds come from the distinct hours too, so the raw table is read and reduced once.
    return expected_hours(seen, keys).join(seen, [*keys, TS], "left_anti")


def missing_hour_counts(df: DataFrame, keys: Sequence[str], name: str = "missing_hours", ts: str = TS) -> DataFrame:
    return missing_hours(df, keys, ts).groupBy(*keys).agg(F.count("*").alias(name))


def densify_hourly(df: DataFrame, keys: Sequence[str], ts: str = TS) -> DataFrame:
    """One row per hour and key; gap hours carry nulls, rows off the hour grid are dropped."""
    return expected_hours(df, keys, ts).join(df, [*keys, ts], "left")
