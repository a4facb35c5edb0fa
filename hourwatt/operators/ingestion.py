"""Ingestion windows: plan, state changes and resume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourwatt.functions.text import truncate_message
from hourwatt.schemas import CHECKPOINTS

WINDOW_KEY = ["source_name", "dataset_name", "region", "window_start_date", "window_end_date"]


def completed_windows(checkpoints: DataFrame) -> DataFrame:
    return checkpoints.filter(F.col("status") == "completed").select(*WINDOW_KEY)


def pending_windows(plan: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Planned windows that are not completed yet."""
    return plan.join(completed_windows(checkpoints), WINDOW_KEY, "left_anti")


def _merge(checkpoints: DataFrame, changes: DataFrame, values: dict[str, Column], insert: bool) -> DataFrame:
    """Apply one state change per window key with a single join.

    ``values`` may refer to the old row as ``old`` and to the change as ``new``. Completed rows are kept
    unless the change itself completes (``insert`` is false then, as completing only updates).
    """
    extra = [c for c in changes.columns if c not in WINDOW_KEY]
    # A window named twice counts once, with its largest values.
    once = changes.groupBy(*WINDOW_KEY).agg(*[F.max(c).alias(c) for c in extra])
    old, new = checkpoints.alias("old"), once.alias("new")
    joined = old.join(new, WINDOW_KEY, "full_outer" if insert else "left")
    changed = F.col("new._changed")
    if insert:
        changed = changed & (F.col("old.status").isNull() | (F.col("old.status") != "completed"))
    changed = F.coalesce(changed, F.lit(False))
    columns = [F.col(k) for k in WINDOW_KEY]
    for field in CHECKPOINTS.fields:
        if field.name in WINDOW_KEY:
            continue
        kept = F.col(f"old.{field.name}")
        value = values.get(field.name)
        columns.append((kept if value is None else F.when(changed, value).otherwise(kept)).cast(field.dataType).alias(field.name))
    return joined.select(*columns)


def start_windows(checkpoints: DataFrame, windows: DataFrame, now: Column) -> DataFrame:
    """Insert windows as running or reset them, unless already completed."""
    changes = windows.select(*WINDOW_KEY, F.lit(True).alias("_changed"))
    return _merge(
        checkpoints, changes,
        {
            "status": F.lit("running"), "rows_loaded": F.lit(0), "error_message": F.lit(None), "started_at": now,
            "finished_at": F.lit(None), "updated_at": now,
        },
        insert=True,
    )


def complete_windows(checkpoints: DataFrame, loaded: DataFrame, now: Column) -> DataFrame:
    """Mark known windows completed with their row counts (``rows_loaded``) and clear the error."""
    changes = loaded.select(*WINDOW_KEY, F.lit(True).alias("_changed"), "rows_loaded")
    return _merge(
        checkpoints, changes,
        {
            "status": F.lit("completed"), "rows_loaded": F.col("new.rows_loaded"), "error_message": F.lit(None),
            "finished_at": now, "updated_at": now,
        },
        insert=False,
    )


def fail_windows(checkpoints: DataFrame, failures: DataFrame, now: Column) -> DataFrame:
    """Mark windows failed with a shortened message; completed ones stay, and so do the old row counts."""
    changes = failures.select(*WINDOW_KEY, F.lit(True).alias("_changed"), truncate_message(F.col("error_message")).alias("_message"))
    return _merge(
        checkpoints, changes,
        {
            "status": F.lit("failed"), "rows_loaded": F.coalesce(F.col("old.rows_loaded"), F.lit(0)),
            "error_message": F.col("new._message"), "started_at": F.coalesce(F.col("old.started_at"), now),
            "finished_at": now, "updated_at": now,
        },
        insert=True,
    )


def purge_source(df: DataFrame, id_prefix: str) -> DataFrame:
    """Rows whose record id does not start with the prefix."""
    return df.filter(~F.coalesce(F.col("source_record_id").startswith(id_prefix), F.lit(False)))


def reset_windows(checkpoints: DataFrame, source_name: str, dataset_name: str) -> DataFrame:
    return checkpoints.filter((F.col("source_name") != source_name) | (F.col("dataset_name") != dataset_name))
