"""Operators with extra leading keys give each series what it gets alone."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from hourwatt.operators import carbon, metrics, ranking
from hourwatt.plans.carbon import carbon_accounting
from hourwatt.plans.decision import decision_run

START = dt.datetime(2024, 1, 1)
FACTORS = {"direct_operational_emissions": {"gas": 400.0, "wind": 0.0}, "life": {"gas": 500.0, "wind": 11.0}}
SOURCES = ("gas", "wind")


@pytest.fixture(scope="module")
def inputs(spark):
    rng = random.Random(5)
    prices, generation = [], []
    for site in ("a", "b"):
        for model in ("m1", "m2", "m3"):
            for h in range(96):
                ts = START + dt.timedelta(hours=h)
                prices.append((site, ts, "w", model, float(rng.randrange(60)), float(rng.randrange(60))))
                for source in SOURCES:
                    generation.append((site, ts, "w", source, model, float(rng.randrange(90)), float(rng.randrange(90))))
    p = spark.createDataFrame(prices, "site string, timestamp_utc timestamp, window string, model string, actual_price_eur_mwh double, predicted_price_eur_mwh double")
    g = spark.createDataFrame(generation, "site string, timestamp_utc timestamp, window string, target string, model string, actual_mwh double, predicted_mwh double")
    return p, g


def run(prices, generation, keys):
    out = carbon_accounting(generation, FACTORS, SOURCES, keys)
    by_window = metrics.regression_metrics(prices, "actual_price_eur_mwh", "predicted_price_eur_mwh", [*keys, "window", "model"])
    price_summary = metrics.mean_over_windows(by_window, [*keys, "model"])
    decisions = decision_run(ranking.price_decision_rankings(prices, keys), out.hourly, price_summary, out.summary, keys=keys)
    return out, decisions


def rows(df, site=None):
    if site is not None:
        df = df.filter(F.col("site") == site).drop("site")
    columns = sorted(df.columns)
    found = [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*columns).collect()]
    return sorted(found, key=str)


def test_two_sites_equal_each_site_alone(inputs):
    prices, generation = inputs
    both_carbon, both = run(prices, generation, ["site"])
    alone_carbon, alone = run(prices.filter("site = 'b'").drop("site"), generation.filter("site = 'b'").drop("site"), [])
    for name in ("hourly", "contributions", "metrics", "summary"):
        assert rows(getattr(both_carbon, name), "b") == rows(getattr(alone_carbon, name)), name
    for name in (
        "rankings", "recommendations", "champion_recommendations", "scenario_recommendations", "decision_summary", "ranking_quality", "scenario_summary", "champion_models",
    ):
        assert rows(getattr(both, name), "b") == rows(getattr(alone, name)), name
    assert both.champion_recommendations.select("site").distinct().count() == 2


def test_shares_sum_to_one(inputs):
    _, generation = inputs
    shares = carbon.contributions(carbon.hourly_carbon(generation, FACTORS, SOURCES, ["site"]), SOURCES, ["site"])
    sums = shares.groupBy("site", "timestamp_utc", "methodology", "window", "model").agg(F.sum("actual_emissions_share").alias("s"))
    assert sums.filter("abs(s - 1) > 1e-9").isEmpty()
    summary = ranking.price_ranking_summary(ranking.price_decision_rankings(inputs[0], ["site"]), ["site"])
    assert summary.count() == 6
