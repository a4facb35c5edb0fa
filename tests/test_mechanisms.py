"""Shapes and results of the range, merge, island, quantile and document mechanisms."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from hourwatt.operators import quantiles, workload
from hourwatt.operators.calendar import TS
from hourwatt.plans import dashboard
from hourwatt.plans.decision import DecisionOutputs
from hourwatt.sources import upsert as U
from hourwatt.streaming.energy import coverage_islands


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def prices(spark):
    """Two regions of 40 hours; some hours missing, values with ties, one hour without a value."""
    rows = [
        (region, dt.datetime(2024, 1, 1) + dt.timedelta(hours=h), None if h == 17 else float(h * 7 % 5))
        for region, step in (("A", 1), ("B", 3)) for h in range(40) if not (region == "A" and h in (9, 10, 23)) and h % step == 0
    ]
    return spark.createDataFrame(rows, f"region string, {TS} timestamp, price double")


def jobs(spark):
    rows = [
        (f"{region}-{start}-{d}-{delay}", region, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=start), dt.datetime(2024, 1, 1) + dt.timedelta(minutes=start + 60 * delay), 60 * d, 60 * delay)
        for region in ("A", "B", "C") for start in (-600, 0, 30, 480, 1500, 2330, 9000) for d in (1, 2, 3) for delay in (0, 1, 4, 13, 37, 60)
    ]
    rows.append(("none", "A", None, None, 60, None))
    return spark.createDataFrame(rows, "workload_id string, region string, earliest_start_utc timestamp, latest_end_utc timestamp, duration_minutes int, max_delay_minutes int").withColumn("power_kw", F.lit(1.0))


def test_best_starts_equal_one_row_per_start(spark):
    blocks, work = workload.block_averages(prices(spark), [1, 2, 3], "price").cache(), jobs(spark)
    best = {r.workload_id: tuple(r) for r in workload.cheapest_starts(work, blocks, "avg_price").collect()}
    by_start: dict = {}
    for r in workload.workload_candidates(work, blocks).collect():
        by_start.setdefault(r.workload_id, []).append((r.start_utc, r.avg_price))
    assert len(best) == work.count()
    for name, got in best.items():
        found = sorted(by_start.get(name, []))
        cheapest = min(found, key=lambda f: (f[1] is None, f[1] or 0.0, f[0]), default=(None, None))
        assert got == (name, len(found), *cheapest, found[0][1] if found else None)


def test_best_starts_make_no_row_per_start(spark):
    blocks = workload.block_averages(prices(spark), [1], "price").cache()
    shape = workload.cheapest_starts(jobs(spark), blocks, "avg_price")._jdf.queryExecution().optimizedPlan().toString()
    made = [line for line in shape.splitlines() if "Generate explode(" in line]
    # Only the hours of a series are made, once for each end of a workload's starts.
    assert len(made) == 2 and all("_from" in line and "interval" not in line.lower() for line in made)


def table(spark, path):
    rows = spark.range(400).select("id", (F.col("id") % 10).cast("int").alias("part"), F.lit("old").alias("v"), F.lit("first").alias("created_at"), F.lit(1).alias("extra"))
    rows.write.partitionBy("part").parquet(path)
    return rows


def test_small_batch_equals_full_join(spark):
    target = spark.range(50).select(F.when(F.col("id") > 0, F.col("id")).alias("k"), F.lit("old").alias("v"), F.lit("first").alias("created_at"), F.lit(1).alias("extra"))
    batch = spark.range(40, 60).select(F.when(F.col("id") < 59, F.col("id")).alias("k"), F.col("id").cast("string").alias("v"), F.lit("second").alias("created_at"))
    rows = lambda df: sorted(df.collect(), key=str)
    assert rows(U.merge_small(target, batch, ["k"])) == rows(U.upsert(target, batch, ["k"]))
    empty = batch.limit(0)
    assert rows(U.merge_small(target, empty, ["k"])) == rows(target)


def test_small_batch_leaves_the_target_in_place(spark, tmp_path):
    path = str(tmp_path / "t")
    table(spark, path)
    batch = spark.createDataFrame([(3, 3, "new", "second"), (403, 3, "new", "second")], "id long, part int, v string, created_at string")
    touched = U.touched_rows(spark.read.parquet(path), batch, "part")
    assert "PartitionFilters: [isnotnull(part" in plan(touched)
    updated = U._merged(touched, F.broadcast(batch), ["id"], U.PRESERVED, "left")
    assert "BroadcastHashJoin" in plan(updated) and "hashpartitioning" not in plan(updated)


@pytest.mark.parametrize("limit", [U.SMALL_BATCH_BYTES, 0])
def test_written_merge_keeps_other_partitions(spark, tmp_path, monkeypatch, limit):
    path = str(tmp_path / "t")
    before = {r.id: (r.v, r.created_at, r.extra) for r in table(spark, path).collect()}
    monkeypatch.setattr(U.fits_small, "__defaults__", (limit,))
    batch = spark.createDataFrame([(3, 3, "new", "second"), (403, 3, "new", "second")], "id long, part int, v string, created_at string")
    for _ in range(2):
        U.write_upsert(spark, path, batch, "part", ["id"])
        after = {r.id: (r.v, r.created_at, r.extra) for r in spark.read.parquet(path).collect()}
        assert after == before | {3: ("new", "first", 1), 403: ("new", "second", None)}


def test_null_partition_is_merged_not_lost(spark, tmp_path):
    path = str(tmp_path / "t")
    shape = "id long, part string, v string"
    U.write_upsert(spark, path, spark.createDataFrame([(1, None, "a"), (2, None, "b")], shape), "part", ["id"])
    U.write_upsert(spark, path, spark.createDataFrame([(2, None, "c")], shape), "part", ["id"])
    assert {r.id: r.v for r in spark.read.parquet(path).collect()} == {1: "a", 2: "c"}
    assert U.touched_rows(spark.read.parquet(path), spark.createDataFrame([(9, "x", "")], shape), "part").count() == 0


@pytest.mark.parametrize("gap", ["90 minutes", "1 hour"])
def test_islands_equal_one_session_per_series(spark, gap):
    """Runs that cross weeks, gaps at the edge of a week, hours exactly a gap apart, repeated hours and null times."""
    start, skipped = dt.datetime(2023, 12, 20), {100, 101, 264, 265, 350, 431, 432, 433}
    rows = [(k, start + dt.timedelta(hours=h)) for k in ("a", "b") for h in range(0, 900, 1 if k == "a" else 2) if h not in skipped]
    rows += rows[:3] + [("a", None), (None, start)]
    hours = spark.createDataFrame(rows, f"k string, {TS} timestamp")
    plain = hours.groupBy(F.session_window(TS, gap).alias("w"), "k").agg(F.min(TS), F.max(TS), F.count("*")).drop("w")
    assert sorted(coverage_islands(hours, ["k"], gap=gap).collect(), key=str) == sorted(plain.collect(), key=str)


def test_islands_spread_a_series_over_weeks(spark):
    hours = spark.createDataFrame([("a", dt.datetime(2024, 1, 1))], f"k string, {TS} timestamp")
    first = [line for line in plan(coverage_islands(hours, ["k"])).splitlines() if "hashpartitioning" in line][-1]
    assert "_week" in first


@pytest.mark.parametrize("kind", ["even", "heavy", "copies"])
def test_quantiles_of_any_spread_leave_few_rows(spark, monkeypatch, kind):
    monkeypatch.setattr(quantiles, "FEW", 50)
    monkeypatch.setattr(quantiles, "SPLITS", 15)
    rng = np.random.default_rng(5)
    values = {"even": rng.uniform(-5, 9, 4000), "heavy": 10 ** rng.uniform(-200, 200, 4000), "copies": np.repeat([1.0, 2.0, 1e9], 900)}[kind]
    df = spark.createDataFrame([("a" if i % 3 else "b", float(v)) for i, v in enumerate(values)] + [("c", 4.0), ("d", None)], "k string, v double")
    seen = []
    narrowed = quantiles._narrowed

    def watched(*args):
        out = narrowed(*args)
        seen.append(out.agg(F.max("_left")).first()[0])
        return out

    monkeypatch.setattr(quantiles, "_narrowed", watched)
    got = {r.k: r.quantiles for r in quantiles.exact_quantiles(df, "v", [0.0, 0.25, 0.5, 0.99, 1.0], ["k"]).collect()}
    for name in "ab":
        part = [v for i, v in enumerate(values) if (i % 3 != 0) == (name == "a")]
        assert np.allclose(got[name], np.quantile(part, [0.0, 0.25, 0.5, 0.99, 1.0]), rtol=1e-12, atol=0)
    assert got["c"] == [4.0] * 5 and set(got) == {"a", "b", "c"}
    assert (not seen) if kind == "copies" else seen[-1] <= 50 and len(seen) <= 4


def decisions(spark, kept):
    """A small decision run: two models over two days, of which ``kept`` rows stay."""
    rows = [(dt.datetime(2024, 1, day, 5), "w", model, f"2024-01-0{day}", 1, 0.123456, "high" if day == 1 else "low") for day in (1, 2) for model in ("m", "n")]
    rec = spark.createDataFrame(rows[:kept], f"{TS} timestamp, window string, model string, decision_group string, recommendation_rank int, confidence_score double, confidence_level string")
    scenarios = rec.select("*", F.lit("balanced").alias("scenario"))
    table = spark.createDataFrame([("m", float("nan")), ("n", 0.98767)][: min(kept, 2)], "model string, mean_regret double")
    models = table.select("model", F.lit(0.5).alias("champion_score"), F.when(F.col("model") == "n", 1).otherwise(2).alias("champion_rank"))
    champion = rec.filter("model = 'n'")
    return DecisionOutputs(rec, rec, champion, scenarios, table, table, table.withColumn("scenario", F.lit("balanced")), models)


def test_dashboard_parts(spark):
    parts = dashboard.dashboard_document(decisions(spark, 4)).collect()
    by_date = {r.decision_group: json.loads(r.document) for r in parts if r.section == "date"}
    whole = {r.section: json.loads(r.document) for r in parts if r.section != "date"}
    assert len(parts) == 5 and set(by_date) == {"2024-01-01", "2024-01-02"}
    for day in by_date.values():
        assert [r["model"] for r in day["recommendations"]] == ["n"] and [r["model"] for r in day["scenario_recommendations"]] == ["n"]
        assert day["recommendations"][0]["confidence_score"] == 0.1235
    assert whole["champion"]["model"] == "n" and [m["model"] for m in whole["champion"]["models"]] == ["n", "m"]
    assert abs(sum(whole["champion"]["weights"].values()) - 1) < 1e-9
    assert whole["filters"] == {"dates": ["2024-01-01", "2024-01-02"], "scenarios": ["balanced"]}
    summary = whole["summary"]
    assert summary["decision_metrics"] == [{"model": "m", "mean_regret": None}, {"model": "n", "mean_regret": 0.9877}]
    assert (summary["date_count"], summary["recommendation_count"], summary["high_confidence_share"]) == (2, 2, 0.5)
    assert len(summary["scenario_metrics"]) == len(summary["ranking_metrics"]) == 2


def test_dashboard_of_nothing(spark):
    whole = {r.section: json.loads(r.document) for r in dashboard.dashboard_document(decisions(spark, 0)).collect()}
    assert set(whole) == {"champion", "summary", "filters"}
    assert whole["champion"]["model"] is None and whole["champion"]["models"] == []
    assert whole["filters"] == {"dates": [], "scenarios": []} and whole["summary"]["recommendation_count"] == 0
