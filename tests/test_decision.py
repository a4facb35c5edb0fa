import datetime as dt
import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hourwatt.operators import decision, metrics, ranking, workload
from hourwatt.operators.quantiles import exact_quantiles
from hourwatt.operators.workload import WorkloadConstraints
from hourwatt.plans.decision import decision_run, workload_rankings

DAY = dt.datetime(2024, 1, 16)
SCHEMA = (
    "timestamp_utc timestamp, window string, model string, decision_date string, actual_price_eur_mwh double, predicted_price_eur_mwh double, "
    "previous_day_price_eur_mwh double, actual_carbon_intensity_g_co2e_per_kwh double, predicted_carbon_intensity_g_co2e_per_kwh double, "
    "actual_total_emissions_kg_co2e double, predicted_total_emissions_kg_co2e double"
)


def hourly(spark, hours, model="m", price=None, seed=3):
    rng = random.Random(seed)
    rows = []
    for h in hours:
        ts = DAY + dt.timedelta(hours=h)
        p = price(h) if price else rng.uniform(0, 90)
        rows.append((ts, "w", model, str(ts.date()), p, rng.uniform(0, 90), None if h < 5 else 40.0, rng.uniform(5, 80), rng.uniform(5, 80), 100.0, 90.0))
    return spark.createDataFrame(rows, SCHEMA)


def hours_of(df):
    return sorted((r.timestamp_utc - DAY).total_seconds() / 3600 for r in df.select("timestamp_utc").collect())


def test_hour_bounds_drop_late_starts_unless_starts_are_bounded(spark):
    c = WorkloadConstraints(earliest_start_utc="2024-01-16 08:00:00", latest_end_utc="2024-01-16 22:00:00", duration_hours=3)
    rows = hourly(spark, range(24))
    assert hours_of(workload.candidate_windows(rows, c))[-1] == 17
    assert hours_of(workload.candidate_windows(rows, c, filter_on="start"))[-1] == 19


def test_only_constrained_blocks_cross_midnight(spark):
    rows = hourly(spark, [22, 23, 24, 25])
    assert hours_of(workload.candidate_windows(rows, WorkloadConstraints(duration_hours=2))) == [22, 24]
    c = WorkloadConstraints(earliest_start_utc="2024-01-16 22:00:00", duration_hours=2)
    assert hours_of(workload.candidate_windows(rows, c)) == [22, 23, 24]


@pytest.mark.parametrize("d", [1, 2, 3])
def test_blocks_need_contiguous_hours(spark, d):
    present = [0, 1, 2, 4, 5, 9, 10, 11, 12]
    rows = hourly(spark, present)
    wanted = [h for h in present if all(h + i in present for i in range(d))]
    out = workload.candidate_windows(rows, WorkloadConstraints(duration_hours=d))
    assert hours_of(out) == wanted
    half_hours = rows.unionByName(rows.limit(1).withColumn("timestamp_utc", F.lit(DAY + dt.timedelta(minutes=30))))
    if d > 1:
        assert 0 not in hours_of(workload.candidate_windows(half_hours, WorkloadConstraints(duration_hours=d)))


def test_ranks_are_permutations_and_ties_keep_time_order(spark):
    rows = hourly(spark, range(6), price=lambda h: 10.0)
    out = workload_rankings(rows).orderBy("timestamp_utc").collect()
    assert [r.actual_price_rank for r in out] == [1, 2, 3, 4, 5, 6]
    assert sorted(r.predicted_decision_rank for r in out) == [1, 2, 3, 4, 5, 6]
    assert min(r.combined_regret for r in out) == 0 and all(r.combined_regret >= 0 for r in out)
    assert all(0 <= r.predicted_combined_score <= 1 for r in out)
    assert out[0].predicted_price_direction_vs_previous_day == "unknown" and out[0].price_direction_correct is None
    assert out[5].price_direction_correct in (0.0, 1.0)
    assert out[0].cost_savings_vs_run_now_eur_mwh == 0.0


def test_single_candidate(spark):
    ranked = workload_rankings(hourly(spark, [7]))
    (row,) = ranked.collect()
    assert row.predicted_price_rank_pct == 0.0 and row.predicted_combined_score == 0.0
    (rec,) = decision.recommendations_with_confidence(ranked).collect()
    assert rec.score_margin_component == 0.0 and rec.confidence_score == 0.8 and rec.confidence_level == "high"


def test_scenario_ties_follow_the_decision_rank(spark):
    ranked = workload_rankings(hourly(spark, range(24)))
    tied = ranked.withColumns({f"{s}_{x}_rank_pct": F.lit(0.5) for s in ("predicted", "actual") for x in ("price", "carbon")})
    out = decision.scenario_rankings(tied)
    assert out.filter("predicted_scenario_rank != predicted_decision_rank").isEmpty()
    assert out.filter("actual_scenario_rank != predicted_decision_rank").isEmpty()


def test_confidence_by_joins_equals_confidence_by_windows(spark):
    rows = hourly(spark, range(48)).unionByName(hourly(spark, range(48), "n", seed=5))
    ranked = workload_rankings(rows)
    by_window = decision.recommendations_with_confidence(ranked)
    by_join = decision.attach_confidence_inputs(decision.top_recommendations(ranked), ranked)
    on = ["window", "model", "decision_group", "timestamp_utc"]
    both = by_window.alias("a").join(by_join.alias("b"), on)
    assert both.count() == 20
    assert both.filter("a.agreement_count != b.agreement_count or a.model_count != b.model_count").isEmpty()


def brute_loss(predicted, actual):
    compared = [(i, j) for i, j in itertools.combinations(range(len(actual)), 2) if actual[i] != actual[j]]
    wrong = [1 for i, j in compared if np.sign(predicted[i] - predicted[j]) != np.sign(actual[i] - actual[j])]
    return len(wrong) / len(compared) if compared else 0.0


def test_pairwise_loss_equals_all_pairs(spark):
    rng = random.Random(1)
    groups = {f"g{i}": [(rng.randrange(6), rng.randrange(6)) for _ in range(n)] for i, n in enumerate([1, 2, 3, 17, 64, 333])}
    groups["equal"] = [(1, 2)] * 5
    rows = [(g, float(p), float(a)) for g, pairs in groups.items() for p, a in pairs]
    got = {r.g: r.pairwise_ranking_loss for r in decision.pairwise_ranking_loss(spark.createDataFrame(rows, "g string, p double, a double"), ["g"], "p", "a").collect()}
    for g, pairs in groups.items():
        assert got[g] == pytest.approx(brute_loss([p for p, _ in pairs], [a for _, a in pairs])), g


def test_spearman_and_constant_groups(spark):
    rng = random.Random(4)
    rows = [("a", float(rng.randrange(9)), float(rng.randrange(9))) for _ in range(30)] + [("b", 1.0, float(i)) for i in range(3)] + [("c", 1.0, 1.0)]
    got = {r.g: r.spearman for r in ranking.group_spearman(spark.createDataFrame(rows, "g string, p double, a double"), ["g"], "p", "a").collect()}
    local = pd.DataFrame(rows, columns=["g", "p", "a"])
    wanted = local[local.g == "a"][["p", "a"]].rank().corr().iloc[0, 1]
    assert got["a"] == pytest.approx(wanted) and got["b"] is None and got["c"] is None


def test_exact_quantiles(spark):
    rng = random.Random(9)
    values = {"a": [rng.gauss(0, 50) for _ in range(501)], "b": [float(rng.randrange(3)) for _ in range(40)], "c": [7.0]}
    rows = [(k, v) for k, vs in values.items() for v in vs] + [("a", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    for r in exact_quantiles(df, "v", [0.25, 0.5, 0.75, 1.0], ["k"]).collect():
        assert np.allclose(r.quantiles, np.quantile(values[r.k], [0.25, 0.5, 0.75, 1.0]))
    everything = [v for _, v in rows if v is not None]
    assert np.allclose(exact_quantiles(df, "v", [0.1, 0.5]).first().quantiles, np.quantile(everything, [0.1, 0.5]))


def test_invalid_constraints():
    for bad in ({"duration_hours": 0}, {"price_weight": -1.0}, {"price_weight": 0.0, "carbon_weight": 0.0}):
        with pytest.raises(ValueError):
            WorkloadConstraints(**bad)


def test_best_start_and_empty_input(spark):
    ranked = workload_rankings(hourly(spark, range(5)))
    best = workload.best_start(ranked.select("timestamp_utc", "predicted_decision_rank")).first()
    assert best.input_rows == 5 and best.recommendation.predicted_decision_rank == 1
    none = workload.best_start(ranked.limit(0).select("timestamp_utc", "predicted_decision_rank")).first()
    assert none.input_rows == 0 and none.recommendation is None


def test_champion_scaling(spark):
    price = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("other", 1.0)], "model string, mae double")
    carbon = spark.createDataFrame([("a", "m", 5.0), ("b", "m", 5.0)], "model string, methodology string, carbon_intensity_mae_g_co2e_per_kwh double")
    quality = spark.createDataFrame([("a", 0.2, 0.1, 3.0, 0.5, 0.2), ("b", 0.4, 0.1, 1.0, 0.5, 0.2)],
        "model string, price_direction_error double, pairwise_ranking_loss double, mean_top_1_carbon_regret_g_co2e_per_kwh double, top_5_f1 double, mean_top_1_combined_regret double")
    rows = decision.champion_table(price, carbon, quality, "m").orderBy("champion_rank").collect()
    assert [r.model for r in rows] == ["b", "a"]
    assert rows[0].carbon_error_component == 0.0 and rows[0].champion_score == pytest.approx(0.1)
    assert rows[1].champion_score == pytest.approx(0.25)


def test_decision_run_without_candidates_fails(spark):
    prices = ranking.price_decision_rankings(hourly(spark, range(3)).select("timestamp_utc", "window", "model", "actual_price_eur_mwh", "predicted_price_eur_mwh"))
    carbon = hourly(spark, range(3)).select(
        "timestamp_utc", "window", "model", F.lit("direct_operational_emissions").alias("methodology"), *workload.CARBON_INPUTS
    )
    with pytest.raises(ValueError, match="no feasible"):
        decision_run(prices, carbon, None, None, WorkloadConstraints(duration_hours=5))
    with pytest.raises(ValueError, match="top_n"):
        decision.top_recommendations(workload_rankings(hourly(spark, range(3))), 0)


def test_direction_share_ignores_the_first_row(spark):
    rows = [(i, float(a), float(p)) for i, (a, p) in enumerate([(1, 1), (2, 3), (2, 2), (1, 5)])]
    df = spark.createDataFrame(rows, "timestamp_utc int, a double, p double").withColumn("g", F.lit(1))
    (r,) = metrics.regression_metrics(df, "a", "p", ["g"]).collect()
    assert r.directional_accuracy == pytest.approx(1 / 3) and r.mae == pytest.approx(5 / 4)
    empty = metrics.evaluate_forecast(df.limit(0), "a", "p").first()
    assert tuple(empty) == (0.0, 0.0, 0.0)


def test_workload_table_equals_single_workload(spark):
    rows = hourly(spark, range(24)).select(F.lit("FR").alias("region"), "timestamp_utc", F.col("actual_price_eur_mwh").alias("price"))
    jobs = spark.createDataFrame(
        [("w1", "FR", DAY + dt.timedelta(hours=8), DAY + dt.timedelta(hours=22), 180, 5.0, 10_000), ("late", "FR", DAY, DAY + dt.timedelta(hours=1), 180, 5.0, 60)],
        "workload_id string, region string, earliest_start_utc timestamp, latest_end_utc timestamp, duration_minutes int, power_kw double, max_delay_minutes int",
    )
    got = workload.workload_candidates(jobs, workload.block_averages(rows, workload.workload_durations(jobs), "price")).orderBy("start_utc").collect()
    c = WorkloadConstraints(earliest_start_utc="2024-01-16 08:00:00", latest_end_utc="2024-01-16 22:00:00", duration_hours=3)
    wanted = workload.candidate_windows(hourly(spark, range(24)), c, filter_on="start").orderBy("timestamp_utc").collect()
    assert [r.start_utc for r in got] == [r.timestamp_utc for r in wanted] and {r.workload_id for r in got} == {"w1"}
    assert [r.avg_price for r in got] == pytest.approx([r.actual_avg_price_eur_mwh for r in wanted])


def test_off_grid_and_long_workloads_are_kept(spark):
    start = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([("R", start + dt.timedelta(hours=h), float(h)) for h in range(24)], "region string, timestamp_utc timestamp, price double")
    jobs = spark.createDataFrame(
        [("off", "R", start + dt.timedelta(minutes=30), start + dt.timedelta(hours=4), 60, 600), ("long", "R", start, start + dt.timedelta(hours=9), 480, 600), ("never", "R", start, start + dt.timedelta(hours=1), 180, 600)],
        "workload_id string, region string, earliest_start_utc timestamp, latest_end_utc timestamp, duration_minutes int, max_delay_minutes int",
    ).withColumn("power_kw", F.lit(1.0))
    found = workload.workload_candidates(jobs, workload.block_averages(rows, workload.workload_durations(jobs), "price"))
    best = {r.workload_id: (r.candidate_count, r.best_start_utc) for r in workload.best_workload_starts(jobs, found, "avg_price").collect()}
    assert best == {"off": (3, start + dt.timedelta(hours=1)), "long": (2, start), "never": (0, None)}
