"""Expanding walk-forward windows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourwatt.operators.calendar import TS


@dataclass(frozen=True)
class ForecastWindow:
    """One train/test pair; all four bounds are inclusive UTC timestamps."""

    name: str
    train_start: str
    train_end: str
    test_start: str
    test_end: str


# The four default windows.
DEFAULT_WINDOWS = (
    ForecastWindow("wf_2026_01", "2023-01-01 00:00:00", "2025-12-31 23:00:00", "2026-01-01 00:00:00", "2026-01-31 23:00:00"),
    ForecastWindow("wf_2026_02", "2023-01-01 00:00:00", "2026-01-31 23:00:00", "2026-02-01 00:00:00", "2026-02-28 23:00:00"),
    ForecastWindow("wf_2026_03", "2023-01-01 00:00:00", "2026-02-28 23:00:00", "2026-03-01 00:00:00", "2026-03-31 23:00:00"),
    ForecastWindow("test_2026_q2", "2023-01-01 00:00:00", "2026-03-31 23:00:00", "2026-04-01 00:00:00", "2026-06-30 23:00:00"),
)


def _between(ts: Column, start: str, end: str) -> Column:
    return ts.between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))


def split_window(df: DataFrame, window: ForecastWindow, ts: str = TS) -> tuple[DataFrame, DataFrame]:
    """Train and test rows of one window; both are plain filters that reach the scan."""
    return (
        df.filter(_between(F.col(ts), window.train_start, window.train_end)),
        df.filter(_between(F.col(ts), window.test_start, window.test_end)),
    )


def assign_windows(df: DataFrame, windows: Sequence[ForecastWindow], ts: str = TS, roles: Sequence[str] = ("train", "test")) -> DataFrame:
    """Add (window, role) for every window a row falls in.

    The few windows travel as a literal array inside the projection, so there is no join: each row
    yields the entries whose bounds hold it.
    """
    column = F.col(ts)
    entries = []
    for w in windows:
        bounds = {"train": (w.train_start, w.train_end), "test": (w.test_start, w.test_end)}
        for role in roles:
            entry = F.struct(F.lit(w.name).alias("window"), F.lit(role).alias("role"))
            entries.append(F.when(_between(column, *bounds[role]), entry))
    return df.select(*df.columns, F.inline(F.array_compact(F.array(*entries))))
