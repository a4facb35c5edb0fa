"""Idempotent last-writer-wins merges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourwatt.schemas import RECORD_KEY
from hourwatt.session import cut_lineage

PRESERVED = ("id", "created_at")
INGESTED = "ingestion_timestamp_utc"
# A batch up to this many bytes of text travels to the target's rows; a larger one is joined by key.
SMALL_BATCH_BYTES = 8 * 1024 * 1024
# Up to this many touched partitions are named in the scan's filter; beyond it they are joined.
NAMED_PARTITIONS = 1000


def keep_one(df: DataFrame, keys: Sequence[str], *order: Column | str) -> DataFrame:
    """One row per key, the first in ``order``; give a total order for a deterministic choice.

    Spark applies a ``row_number() = 1`` filter before the shuffle as well (WindowGroupLimit), so a
    key with many copies sends at most one row per map task.
    """
    numbered = df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return numbered.filter(F.col("_n") == 1).drop("_n")


def latest_first(df: DataFrame, keys: Sequence[str]) -> list[Column]:
    """Order without a version: the latest ingestion wins, then the largest values, whatever the input order."""
    rest = [c for c in df.columns if c not in keys and c != INGESTED]
    return [F.desc_nulls_last(c) for c in ([INGESTED] if INGESTED in df.columns else []) + rest] or [F.col(k) for k in keys]


def require_record_id(df: DataFrame, column: str = "source_record_id") -> DataFrame:
    """Fail the job when a row has no record id."""
    present = F.coalesce(F.col(column), F.lit("")) != ""
    error = F.raise_error(F.lit(f"a row without {column} cannot be merged twice with the same result")).cast("boolean")
    return df.filter(F.when(present, F.lit(True)).otherwise(error))


def upsert(
    target: DataFrame, batch: DataFrame, keys: Sequence[str] = tuple(RECORD_KEY), order: Sequence[Column | str] = (),
    preserved: Sequence[str] = PRESERVED,
) -> DataFrame:
    """Merge a batch into a table that is unique by ``keys``.

    Within the batch the first row in ``order`` wins (pass descending versions for "last wins"). New rows
    replace old ones except for the ``preserved`` columns. One full outer join; with both sides hashed or
    bucketed by key there is no further shuffle.
    """
    keys = list(keys)
    latest = keep_one(batch, keys, *(order or latest_first(batch, keys)))
    return _merged(target, latest, keys, preserved, "full_outer")


def _merged(target: DataFrame, latest: DataFrame, keys: Sequence[str], preserved: Sequence[str], how: str) -> DataFrame:
    batch = latest
    new = latest.withColumn("_new", F.lit(True)).alias("new")
    old = target.alias("old")
    joined = old.join(new, keys, how)
    replaced = F.col("new._new").isNotNull()
    columns = [F.col(k) for k in keys]
    for name in target.columns:
        if name in keys:
            continue
        previous = F.col(f"old.{name}")
        if name not in batch.columns:
            columns.append(previous.alias(name))
        elif name in preserved:
            columns.append(F.coalesce(previous, F.col(f"new.{name}")).alias(name))
        else:
            columns.append(F.when(replaced, F.col(f"new.{name}")).otherwise(previous).alias(name))
    return joined.select(*columns).select(*target.columns)


def merge_small(target: DataFrame, latest: DataFrame, keys: Sequence[str] = tuple(RECORD_KEY), preserved: Sequence[str] = PRESERVED) -> DataFrame:
    """Merge a small batch, unique by ``keys``, without moving the target: its rows are updated where they are.

    The batch is broadcast, so its size must have been checked (``fits_small``). Rows whose key the target lacks are
    appended; which those are is read from the target's key columns alone. Same rows as ``upsert``.
    """
    keys = list(keys)
    updated = _merged(target, F.broadcast(latest), keys, preserved, "left")
    known = target.select(*keys).join(F.broadcast(latest.select(*keys)), keys, "left_semi")
    added = latest.join(known, keys, "left_anti")
    columns = [F.col(f.name) if f.name in latest.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in target.schema.fields]
    return updated.unionByName(added.select(*columns))


def fits_small(latest: DataFrame, limit: int = SMALL_BATCH_BYTES) -> bool:
    """Whether the batch's rows, as text, stay under ``limit`` bytes: measured, not estimated."""
    size = latest.agg(F.sum(F.octet_length(F.to_json(F.struct(*latest.columns))))).first()[0]
    return (size or 0) <= limit


def touched_rows(table: DataFrame, batch: DataFrame, partition: str) -> DataFrame:
    """The table's rows in the partitions that a batch touches.

    Their values are named in the filter, so that the scan lists only their folders; the values are as few as the
    folders that will be rewritten, and beyond ``NAMED_PARTITIONS`` a join takes the filter's place.
    """
    touched = batch.select(partition).distinct()
    values = [r[0] for r in touched.limit(NAMED_PARTITIONS + 1).collect()]
    if len(values) > NAMED_PARTITIONS:
        same = F.col("_table." + partition).eqNullSafe(F.col("_touched." + partition))
        return table.alias("_table").join(touched.alias("_touched"), same, "left_semi")
    named = F.col(partition).isin([v for v in values if v is not None])
    return table.filter(named | F.col(partition).isNull() if None in values else named)


def write_upsert(
    spark: SparkSession, path: str, batch: DataFrame, partition: str, keys: Sequence[str] = tuple(RECORD_KEY),
    order: Sequence[Column | str] = (),
) -> None:
    """Upsert into a Parquet table partitioned by ``partition``, rewriting only the touched partitions.

    ``partition`` must be determined by the key (month of the timestamp in the record id, for example). The batch is
    reduced to one row per key and stored; if it is small the target's rows stay where they are, else both are joined by
    key. The merged rows are checkpointed before the dynamic overwrite, so the job never reads what it overwrites.
    A rerun of the same batch gives the same table.
    """
    keys = list(keys)
    latest = cut_lineage(keep_one(batch, keys, *(order or latest_first(batch, keys))))
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path):
        # The stored columns stay, those that this batch lacks included; the partition column keeps the batch's type,
        # which folder names would not give.
        stored = spark.read.parquet(path).schema
        known = {f.name: f for f in batch.schema.fields}
        fields = [known[f.name] if f.name == partition else f for f in stored.fields]
        fields += [f for f in batch.schema.fields if f.name not in stored.names]
        current = spark.read.schema(T.StructType(fields)).parquet(path)
        target = touched_rows(current, latest, partition)
        merged = merge_small(target, latest, keys) if fits_small(latest) else _merged(target, latest, keys, PRESERVED, "full_outer")
        merged = cut_lineage(merged)
    else:
        merged = latest
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
