"""Queries: forecasts over the national feature table. Their rows are checked in tests/test_forecast*.py."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourwatt import constants as C
from hourwatt.catalog import adapters as A
from hourwatt.catalog.q_features import base
from hourwatt.catalog.registry import query
from hourwatt.operators.calendar import TS
from hourwatt.operators.walk_forward import ForecastWindow, split_window
from hourwatt.plans import forecast as M
from hourwatt.plans import model_table as T
from hourwatt.plans.features import modeling_features
from hourwatt.session import cut_lineage, scratch_path
from hourwatt.sources.model_store import publish_models, read_models

# The month of events leaves rows with full 14-day history from the 15th on.
WINDOWS = (
    ForecastWindow("wf_a", "2024-01-15 00:00:00", "2024-01-22 23:00:00", "2024-01-23 00:00:00", "2024-01-26 23:00:00"),
    ForecastWindow("wf_b", "2024-01-15 00:00:00", "2024-01-26 23:00:00", "2024-01-27 00:00:00", A.OPEN_END),
)


# Every target that the tables have values of; no event stands for oil, hydro or bioenergy.
TARGETS = tuple(t for t in C.FORECAST_TARGETS if t in (*A.TECH_SOURCES, "consumption", "production"))


def features(s, d):
    return modeling_features(base(s, d))


MODELS = (C.NAIVE_MODEL, *T.TRAINED)
BOOSTED = ("hist_gradient_boosting", "lightgbm", "xgboost")


def _predictions(s, d, *names):
    """Predictions of some models for every window and target."""
    table, frames = cut_lineage(features(s, d)), []
    for window in WINDOWS:
        train, test = split_window(table, window)
        frames += M.side_by_side(lambda target: M.forecast_target(train, test, window, target, names)[0], TARGETS)
    return reduce(DataFrame.unionByName, frames)


@query("M02_ridge")
def m02(s, d):
    return _predictions(s, d, "ridge")


@query("M03_random_forest")
def m03(s, d):
    return _predictions(s, d, "random_forest")


@query("M04_boosted_trees")
def m04(s, d):
    """All three boosted configurations, with all their trees."""
    return M.walk_forward_targets(features(s, d), TARGETS, WINDOWS, BOOSTED).predictions


@query("M05_price_walk_forward")
def m05(s, d):
    return M.walk_forward_price(features(s, d), WINDOWS, MODELS).metrics


@query("M06_upstream_signals")
def m06(s, d):
    table, frames = cut_lineage(features(s, d)), []
    for window in WINDOWS:
        train, test = split_window(table, window)
        _, enriched, _ = M.add_signals(train, test, window)
        frames.append(enriched.select(TS, F.lit(window.name).alias("window"), *C.SIGNAL_FEATURES))
    return reduce(DataFrame.unionByName, frames)


@query("M07_target_evaluation")
def m07(s, d):
    return M.walk_forward_targets(features(s, d), TARGETS, WINDOWS, MODELS).summary


@query("M08_feature_importance")
def m08(s, d):
    run = M.walk_forward_targets(features(s, d), TARGETS, WINDOWS, T.TRAINED)
    return T.importance(run.models, [T.supply_target(t) for t in TARGETS])


@query("S16_model_persistence")
def s16(s, d):
    """The best model of each target, published, read again and used on the last window's test hours."""
    table = cut_lineage(features(s, d))
    run = M.walk_forward_targets(table, TARGETS, WINDOWS, MODELS)
    last = run.models.where(F.col("window") == WINDOWS[-1].name)
    path = scratch_path(s, "models")
    publish_models(M.best_models(last, run.summary), path)
    targets = [T.supply_target(t) for t in TARGETS]
    rows = T.model_rows(table, WINDOWS[-1:], targets).where("role = 'test'")
    scored = T.score_models(rows, read_models(s, path), targets, naive=False)
    return scored.select(TS, "target", "model", F.col("actual").alias("actual_mwh"), F.col("predicted").alias("predicted_mwh"))
