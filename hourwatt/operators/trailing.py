"""Time-based lags and trailing statistics over hourly series.

A series may be long and alone (one national series), so a window partitioned by series only would
run in one task. Rows are therefore cut into time buckets; each row is also copied into the following
bucket when it lies within the look-back distance. The window runs per (series, bucket) and copies are
dropped afterwards. A partition then holds at most ``BUCKET_HOURS`` + look-back rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourwatt import constants as C
from hourwatt.operators.calendar import TS

BUCKET_HOURS = 2016
_HOUR, _BUCKET, _OWNED = "_hour_number", "_time_bucket", "_owned"


def epoch_hour(ts: Column) -> Column:
    return F.floor(F.unix_seconds(ts) / 3600)


def with_halo(df: DataFrame, look_back: int, ts: str = TS, bucket_hours: int = BUCKET_HOURS) -> DataFrame:
    """Assign rows to time buckets and copy those within ``look_back`` hours of the next bucket."""
    hour = epoch_hour(F.col(ts))
    own = F.floor(F.col(_HOUR) / bucket_hours)
    last = F.floor((F.col(_HOUR) + look_back) / bucket_hours)
    spread = df.withColumn(_HOUR, hour).withColumn(_BUCKET, F.explode(F.sequence(own, last)))
    return spread.withColumn(_OWNED, F.col(_BUCKET) == own)


def owned_rows(df: DataFrame) -> DataFrame:
    return df.filter(_OWNED).drop(_HOUR, _BUCKET, _OWNED)


def trailing_frame(keys: Sequence[str], first: int, last: int) -> str:
    """RANGE frame over the hours [t-first, t-last]; gaps need no densifying."""
    partition = ", ".join([*keys, _BUCKET])
    return f"(partition by {partition} order by {_HOUR} range between {first} preceding and {last} preceding)"


def lag_hours(value: str, hours: int, keys: Sequence[str]) -> Column:
    """The value exactly ``hours`` earlier, or null when that hour is absent."""
    return F.expr(f"max({value}) over {trailing_frame(keys, hours, hours)}")


def rolling(value: str, stat: str, hours: int, keys: Sequence[str]) -> Column:
    """A statistic of the previous ``hours`` hours; null unless all of them are present."""
    over = trailing_frame(keys, hours, 1)
    function = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}[stat]
    return F.expr(f"case when count({value}) over {over} = {hours} then {function}({value}) over {over} end")


def target_windows(column: str, prefix: str, keys: Sequence[str]) -> dict[str, Column]:
    """Window expressions of one target: lags, rolling means, std, min, max."""
    out = {f"{prefix}_lag_{h}h": lag_hours(column, h, keys) for h in C.LAG_HOURS}
    out |= {f"{prefix}_rolling_mean_{h}h": rolling(column, "mean", h, keys) for h in C.MEAN_HOURS}
    for stat in ("std", "min", "max"):
        out[f"{prefix}_rolling_{stat}_{C.SPREAD_HOURS}h"] = rolling(column, stat, C.SPREAD_HOURS, keys)
    return out


def target_contrasts(prefix: str) -> dict[str, Column]:
    """Differences between the window features of one target."""
    out = {
        f"{prefix}_rolling_range_24h": f"{prefix}_rolling_max_24h - {prefix}_rolling_min_24h",
        f"{prefix}_lag_1h_to_24h": f"{prefix}_lag_1h - {prefix}_lag_24h",
        f"{prefix}_lag_24h_to_168h": f"{prefix}_lag_24h - {prefix}_lag_168h",
    }
    if prefix == "price":
        out["price_lag_168h_to_336h"] = "price_lag_168h - price_lag_336h"
        out["price_vs_rolling_mean_24h"] = "price_lag_1h - price_rolling_mean_24h"
    return {name: F.expr(sql) for name, sql in out.items()}


def demand_levels() -> dict[str, Column]:
    """Residual demand and variable renewables a day and a week ago (missing wind or solar is zero)."""
    out = {}
    for h in (24, 168):
        wind, solar = f"coalesce(wind_lag_{h}h, 0D)", f"coalesce(solar_lag_{h}h, 0D)"
        out[f"residual_demand_lag_{h}h"] = F.expr(f"consumption_lag_{h}h - {wind} - {solar}")
        out[f"variable_renewable_lag_{h}h"] = F.expr(f"{wind} + {solar}")
    return out


def demand_contrasts() -> dict[str, Column]:
    return {
        f"{name}_lag_24h_to_168h": F.expr(f"{name}_lag_24h - {name}_lag_168h")
        for name in ("residual_demand", "variable_renewable")
    }


def _absent(df: DataFrame, exprs: Mapping[str, Column], only_missing: bool) -> dict[str, Column]:
    return {k: v for k, v in exprs.items() if not (only_missing and k in df.columns)}


def add_trailing_features(
    df: DataFrame,
    keys: Sequence[str] = (),
    targets: Mapping[str, str] | None = None,
    ts: str = TS,
    only_missing: bool = False,
    bucket_hours: int = BUCKET_HOURS,
) -> DataFrame:
    """Lag, rolling and contrast features of every target column present in ``df``.

    Input: one row per (keys, hour). All windows share one partitioning and order, so the plan has one
    exchange and one sort. With ``only_missing`` the columns a table already has are kept.
    """
    targets = C.FEATURE_TARGETS if targets is None else targets
    present = {column: prefix for column, prefix in targets.items() if column in df.columns}
    windows: dict[str, Column] = {}
    for column, prefix in present.items():
        windows |= target_windows(column, prefix, keys)
    windows = _absent(df, windows, only_missing)
    out = df
    if windows:
        spread = with_halo(df, max(C.LAG_HOURS), ts, bucket_hours)
        out = owned_rows(spread.withColumns(windows))
    contrasts: dict[str, Column] = {}
    for prefix in present.values():
        contrasts |= target_contrasts(prefix)
    contrasts = _absent(df, contrasts, only_missing)
    out = out.withColumns(contrasts) if contrasts else out
    if {"consumption", "wind", "solar"} <= set(present.values()):
        for step in (demand_levels(), demand_contrasts()):
            step = _absent(df, step, only_missing)
            out = out.withColumns(step) if step else out
    return out
