"""Structured Streaming versions of the ingestion and aggregation operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourwatt import constants as C
from hourwatt.operators.calendar import TS
from hourwatt.session import scratch_path
from hourwatt.sources.payloads import finish_mix, hourly_mix_aggregates
from hourwatt.sources.upsert import write_upsert

WEEK = 7 * 24 * 3600


def read_folder(spark: SparkSession, path: str, schema: T.StructType, glob: str = "*.parquet", files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream; NTZ timestamps become zoned (watermarks need them).

    ``path`` may be a glob itself: ``<root>/events.parquet*`` takes a table that is one file as well as one that is a
    folder of part files.
    """
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    df = reader.parquet(path)
    naive = [f.name for f in schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in naive}) if naive else df


def hourly_mix_stream(records: DataFrame, scope: str, delay: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Tumbling-hour energy per region; rows later than the delay are dropped once their hour is out."""
    region = F.lit(C.NATIONAL_REGION) if scope == C.NATIONAL_SCOPE else F.col("libelle_region")
    hourly = (
        records.withWatermark(ts, delay)
        .groupBy(F.window(ts, "1 hour").alias("_hour"), region.alias("region"))
        .agg(*hourly_mix_aggregates(records.columns, scope))
    )
    return finish_mix(hourly.withColumn(TS, F.col("_hour.start")).drop("_hour"), scope)


def distinct_records(records: DataFrame, keys: Sequence[str], delay: str = "1 hour", ts: str = "ts") -> DataFrame:
    """Drop repeated records that arrive within the delay of each other."""
    return records.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def sliding_day_mean(hours: DataFrame, value: str, keys: Sequence[str], delay: str = "1 hour", ts: str = TS) -> DataFrame:
    """Mean of the 24 hours before each full hour, with how many of them were present."""
    frames = hours.withWatermark(ts, delay).groupBy(F.window(ts, "24 hours", "1 hour").alias("_frame"), *keys)
    return frames.agg(F.avg(value).alias("rolling_mean_24h"), F.count(value).alias("hours_present")).select(
        *keys, F.col("_frame.end").alias(TS), "rolling_mean_24h", "hours_present"
    )


def coverage_islands(hours: DataFrame, keys: Sequence[str], ts: str = TS, gap: str = "90 minutes", delay: str | None = None) -> DataFrame:
    """Runs of hours without a gap; works on batch input and, with a delay, on a stream.

    On batch input runs are found inside (series, week) and joined across weeks, so a series with a third of all rows
    spreads over tasks; on a stream a series' open run is its state.
    """
    if delay:
        return _sessions(hours.withWatermark(ts, delay), keys, ts, gap)
    week = F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / WEEK)
    parts = _sessions(hours.withColumn("_week", week), [*keys, "_week"], ts, gap)
    # One row per week and run: bounded by time, not by rows.
    order = Window.partitionBy(*keys).orderBy("first_hour")
    apart = F.col("first_hour") > F.lag("last_hour").over(order) + F.expr(f"interval {gap}")
    marked = parts.withColumn("_island", F.sum(F.coalesce(apart, F.lit(False)).cast("int")).over(order))
    islands = marked.groupBy(*keys, "_island").agg(F.min("first_hour").alias("first_hour"), F.max("last_hour").alias("last_hour"), F.sum("hours").alias("hours"))
    return islands.drop("_island")


def _sessions(rows: DataFrame, keys: Sequence[str], ts: str, gap: str) -> DataFrame:
    island = F.session_window(ts, gap).alias("_session")
    return rows.groupBy(island, *keys).agg(F.min(ts).alias("first_hour"), F.max(ts).alias("last_hour"), F.count("*").alias("hours")).drop("_session")


def run_to_parquet(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Process everything that is available into a Parquet sink and read the sink back."""
    spark = stream.sparkSession
    root = scratch_path(spark, name)
    running = (
        stream.writeStream.outputMode(mode).format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state")
        .trigger(availableNow=True).start()
    )
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def upsert_stream(stream: DataFrame, path: str, partition: str, keys: Sequence[str], order: Sequence[Column | str], state: str) -> None:
    """Merge every micro-batch into a partitioned table; a replayed batch changes nothing."""

    def merge(batch: DataFrame, _batch_id: int) -> None:
        write_upsert(batch.sparkSession, path, batch, partition, keys, order)

    running = stream.writeStream.foreachBatch(merge).option("checkpointLocation", state).trigger(availableNow=True).start()
    running.awaitTermination()
