import datetime as dt

from pyspark.sql import functions as F

from hourwatt import constants as C
from hourwatt.sources.payloads import hourly_mix
from hourwatt.streaming import energy as E

START = dt.datetime(2024, 1, 1)
SCHEMA = "event int, ts timestamp, libelle_region string, nucleaire double, taux_co2 double"


def write(spark, path, name, minutes):
    rows = [(i, START + dt.timedelta(minutes=m), "R", float(m % 7), 40.0) for i, m in enumerate(minutes)]
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    df.write.parquet(f"{path}/{name}")
    return df


def test_hourly_stream_equals_batch_and_drops_late_rows(spark, tmp_path):
    first = write(spark, tmp_path, "a", range(0, 400, 15))
    # Lateness is judged by the watermark one batch back, so the late row comes in the third batch.
    second = write(spark, tmp_path, "b", [401])
    write(spark, tmp_path, "c", [5, 900])
    stream = E.read_folder(spark, f"{tmp_path}/*", first.schema, files_per_trigger=1)
    got = E.run_to_parquet(E.hourly_mix_stream(stream, C.REGIONAL_SCOPE), "t").select("timestamp_utc", "nuclear_mwh")
    wanted = hourly_mix(first.unionByName(second), C.REGIONAL_SCOPE).select("timestamp_utc", "nuclear_mwh")
    assert sorted(got.collect()) == sorted(wanted.collect())


def test_repeated_records_are_dropped(spark, tmp_path):
    df = write(spark, tmp_path, "a", range(0, 60, 5))
    write(spark, tmp_path, "b", range(0, 60, 5))
    stream = E.read_folder(spark, f"{tmp_path}/*", df.schema, files_per_trigger=1)
    assert E.run_to_parquet(E.distinct_records(stream, ["event"]), "t").count() == 12


def test_upsert_stream_replays_without_change(spark, tmp_path):
    df = write(spark, tmp_path / "in", "a", [0, 10, 70])
    write(spark, tmp_path / "in", "b", [75])
    for state in ("s1", "s2"):
        stream = E.read_folder(spark, f"{tmp_path}/in/*", df.schema, files_per_trigger=1).select(
            "libelle_region", F.date_trunc("hour", "ts").alias("hour"), "ts", F.date_format("ts", "yyyy-MM-dd").alias("day")
        )
        E.upsert_stream(stream, str(tmp_path / "t"), "day", ["libelle_region", "hour"], [F.desc("ts")], str(tmp_path / state))
        rows = spark.read.parquet(str(tmp_path / "t")).orderBy("hour").collect()
        assert len(rows) == 2 and rows[0].ts == START + dt.timedelta(minutes=10)


def test_coverage_islands_in_batch_and_stream(spark, tmp_path):
    df = write(spark, tmp_path, "a", [0, 60, 120, 300, 360, 1000])
    hours = df.select("libelle_region", F.col("ts").alias("timestamp_utc"))
    batch = E.coverage_islands(hours, ["libelle_region"]).orderBy("first_hour").collect()
    assert [r.hours for r in batch] == [3, 2, 1]
    stream = E.read_folder(spark, f"{tmp_path}/*", df.schema).select("libelle_region", F.col("ts").alias("timestamp_utc"))
    closed = E.run_to_parquet(E.coverage_islands(stream, ["libelle_region"], delay="10 minutes"), "t").orderBy("first_hour").collect()
    assert closed == batch[:2]


def test_sliding_mean_counts_present_hours(spark, tmp_path):
    df = write(spark, tmp_path, "a", [60 * h for h in range(40) if h != 10])
    stream = E.read_folder(spark, f"{tmp_path}/*", df.schema).select("libelle_region", F.col("ts").alias("timestamp_utc"), F.col("nucleaire").alias("v"))
    out = {r.timestamp_utc: r.hours_present for r in E.run_to_parquet(E.sliding_day_mean(stream, "v", ["libelle_region"]), "t").collect()}
    assert out[START + dt.timedelta(hours=24)] == 23 and out[START + dt.timedelta(hours=36)] == 24
