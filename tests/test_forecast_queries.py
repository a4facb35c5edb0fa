"""The forecast queries fit every model, with all its trees, for every target and window."""

import pytest

from hourwatt.catalog import q_forecast as Q
from hourwatt.operators.trees import GROWTHS
from hourwatt.plans import forecast as M

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def run(spark):
    return M.walk_forward_targets(Q.features(spark, SF_DIR), Q.TARGETS, Q.WINDOWS, Q.MODELS)


def test_every_model_target_and_window(run):
    found = {(r.window, r.target, r.model): r.trees for r in run.models.where("tree >= 0").groupBy("window", "target", "model").agg(Q.F.countDistinct("tree").alias("trees")).collect()}
    wanted = {m: g.trees + (g.step > 0) for m, g in GROWTHS.items()} | {"ridge": 1}
    assert found == {(w.name, t, m): n for w in Q.WINDOWS for t in Q.TARGETS for m, n in wanted.items()}
    assert run.summary.count() == len(Q.TARGETS) * len(Q.MODELS)


def test_naive_rows_are_the_lag(spark, run):
    table = Q.features(spark, SF_DIR)
    naive = run.predictions.where("model = 'naive_lag_24h' and target = 'wind'").join(table.select(M.TS, "wind_lag_24h"), M.TS)
    assert naive.count() > 100
    assert naive.where("abs(predicted_mwh - wind_lag_24h) > 0.0051").isEmpty()


def test_price_run_uses_the_signals(spark):
    run = M.walk_forward_price(Q.features(spark, SF_DIR), Q.WINDOWS, ("naive_lag_24h", "ridge"))
    assert {r.feature for r in run.models.where("tree < 0").select("feature").distinct().collect()} >= set(Q.C.SIGNAL_FEATURES)
    assert run.metrics.count() == 2 * len(Q.WINDOWS)
    signals = run.signal_predictions
    tested = run.predictions.select(M.TS, "window").distinct().count()
    assert signals.count() == 2 * tested


def test_a_window_without_rows_is_an_error(spark):
    gone = Q.ForecastWindow("gone", "1990-01-01 00:00:00", "1990-01-02 00:00:00", "1990-01-03 00:00:00", "1990-01-04 00:00:00")
    with pytest.raises(ValueError, match="gone has no train and no test"):
        M.walk_forward_targets(Q.features(spark, SF_DIR), ["wind"], [gone])
