"""All models of a walk-forward run fitted by one job and kept as one table.

Every (series, window, target, model) is a group of training rows; Spark deals the groups over tasks, so a run of any
number of series, windows, targets and models takes one job instead of one per tree and level. A group holds the hours
of one series in one window, a bound set by time. The fitted models are rows of one table (``FORESTS``): inner nodes,
leaves and linear weights alike. Scoring, importance, choice and storage are plain operations on that table.
"""

from __future__ import annotations

import zlib
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hourwatt import constants as C
from hourwatt.operators.calendar import TS
from hourwatt.operators.trees import GROWTHS, Growth, grow
from hourwatt.operators.walk_forward import ForecastWindow, assign_windows

RIDGE, RIDGE_ALPHA, SEED = "ridge", 10.0, 42
TASKS_PER_MODEL = 4
TRAINED = (RIDGE, *GROWTHS)
# A node of a tree; or, with tree -1, a weight of a linear model: threshold is what stands in for a missing value.
FORESTS = (
    "window string, target string, model string, tree int, node int, feature string, threshold double, missing_left boolean, "
    "left int, right int, value double, gain double"
)
GROUP = ["window", "target"]


@dataclass(frozen=True)
class Target:
    """What one model family predicts: its column, the inputs, and the column of the naive forecast."""

    name: str
    column: str
    inputs: tuple[str, ...]
    naive: str


def supply_target(name: str) -> Target:
    if name not in C.FORECAST_TARGETS:
        raise ValueError(f"{name} is not a supply or demand series")
    column, prefix = C.FORECAST_TARGETS[name]
    return Target(name, column, tuple(C.target_features(prefix)), f"{prefix}_lag_24h")


PRICE = Target("price", "price_eur_mwh", tuple(C.strict_price_features()), "price_lag_24h")


def model_rows(features: DataFrame, windows: Sequence[ForecastWindow], targets: Sequence[Target], keys: Sequence[str] = ()) -> DataFrame:
    """One row per (keys, window, target, hour, role): label, naive forecast and inputs ``x``. No shuffle."""
    rows = assign_windows(features, windows) if "role" not in features.columns else features
    entries = [
        F.struct(
            F.lit(t.name).alias("target"), F.col(t.column).cast("double").alias("label"), F.col(t.naive).cast("double").alias("naive"),
            F.array(*[F.col(c).cast("double") for c in t.inputs]).alias("x"),
        )
        for t in targets
    ]
    return rows.select(*keys, TS, "window", "role", F.inline(F.array(*entries)))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Arrays of one width as a matrix; a null is not a number."""
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]) if column.num_chunks else pa.array([], pa.float64())
    return np.asarray(flat.to_numpy(zero_copy_only=False), float).reshape(-1, width)


def _linear(x: np.ndarray, y: np.ndarray, names: Sequence[str], middle: np.ndarray) -> list[tuple]:
    """Closed-form ridge on standardised inputs, as weights of the raw ones."""
    spread = x.std(0)
    z = (x - x.mean(0)) / np.where(spread > 0, spread, 1.0)
    w = np.linalg.solve(z.T @ z + RIDGE_ALPHA * np.eye(z.shape[1]), z.T @ (y - y.mean()))
    raw = w / np.where(spread > 0, spread, 1.0)
    rows = [(-1, i, names[i], float(middle[i]), None, -1, -1, float(raw[i]), float(abs(w[i]))) for i in range(len(names))]
    return [*rows, (0, 0, None, None, None, -1, -1, float(y.mean() - raw @ x.mean(0)), 0.0)]


def _forest(x: np.ndarray, y: np.ndarray, names: Sequence[str], middle: np.ndarray, growth: Growth, seed: int) -> list[tuple]:
    rows = []
    for number, t in enumerate(grow(x, y, growth, seed)):
        for i, (f, cut, left, right, value, gain) in enumerate(zip(t.feature, t.threshold, t.left, t.right, t.value, t.gain, strict=True)):
            inner = left >= 0
            rows.append((number, i, names[f] if inner else None, cut if inner else None, bool(middle[f] <= cut) if inner else None, left, right, value, gain))
    return rows


def fit_models(
    rows: DataFrame, targets: Sequence[Target], models: Sequence[str] = TRAINED, keys: Sequence[str] = (), growths: Mapping[str, Growth] = GROWTHS
) -> DataFrame:
    """The table of all fitted models. Gaps take the training median; inputs without a training value are left out.

    Rows without a label do not train; a group without a label gives no model.
    """
    unknown = set(models) - {RIDGE, *growths}
    if unknown:
        raise ValueError(f"models that cannot be trained: {sorted(unknown)}")
    inputs = {t.name: t.inputs for t in targets}
    group = [*keys, *GROUP, "model"]
    train = rows.where((F.col("role") == "train") & F.col("label").isNotNull()).select(*keys, *GROUP, TS, "label", "x", F.explode(F.lit(list(models))).alias("model"))
    key_fields = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{key_fields}, {FORESTS}" if keys else FORESTS

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by(TS)
        key = [table[c][0] for c in group]
        window, target, model = (str(k) for k in key[-3:])
        x, y = _matrix(table["x"], len(inputs[target])), np.asarray(table["label"])
        known = ~np.isnan(x).all(0)
        names = [n for n, k in zip(inputs[target], known, strict=True) if k]
        x = x[:, known]
        middle = np.nanmedian(x, axis=0) if x.size else np.zeros(0)
        x = np.where(np.isnan(x), middle, x)
        if model == RIDGE:
            found = _linear(x, y, names, middle)
        else:
            found = _forest(x, y, names, middle, growths[model], SEED + zlib.crc32(f"{window}|{target}|{model}".encode()))
        fields = [pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.bool_(), pa.int32(), pa.int32(), pa.float64(), pa.float64()]
        columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), fields, strict=True)]
        repeated = [pa.array([k.as_py()] * len(found), k.type) for k in key]
        return pa.Table.from_arrays([*repeated, *columns], [*group, "tree", "node", "feature", "threshold", "missing_left", "left", "right", "value", "gain"])

    # A group is little data and much work, so tasks are counted by groups and not by bytes.
    n_groups = train.sparkSession.sparkContext.defaultParallelism + TASKS_PER_MODEL * len(targets) * len(models)
    return train.repartition(n_groups, *group).groupBy(*group).applyInArrow(fit, schema)


def _apply(forest: dict[str, np.ndarray], x: np.ndarray, place: Mapping[str, int]) -> np.ndarray:
    """Sum of the leaves that rows reach and of the weighted inputs."""
    out = np.zeros(len(x))
    linear = forest["tree"] < 0
    for name, middle, weight in zip(forest["feature"][linear], forest["threshold"][linear], forest["value"][linear]):
        column = x[:, place[name]]
        out += weight * np.where(np.isnan(column), middle, column)
    order = np.lexsort((forest["node"][~linear], forest["tree"][~linear]))
    f = {k: v[~linear][order] for k, v in forest.items()}
    first = np.flatnonzero(f["node"] == 0)
    begin = np.repeat(first, np.diff(np.append(first, len(f["node"]))))
    left, right = (np.where(f[k] >= 0, f[k] + begin, -1) for k in ("left", "right"))
    column = np.array([place.get(n, 0) for n in f["feature"]])
    cut, gap_left = f["threshold"].astype(float), f["missing_left"].astype(bool)
    # All trees at once, for a slice of rows that keeps the table of places small.
    size = max(1, 2_000_000 // max(1, len(first)))
    for lo in range(0, len(x), size):
        part = x[lo : lo + size]
        at = np.tile(first, (len(part), 1))
        inner = left[at] >= 0
        while inner.any():
            seen = np.take_along_axis(part, column[at], axis=1)
            goes = np.where(np.isnan(seen), gap_left[at], seen <= cut[at])
            at = np.where(inner, np.where(goes, left[at], right[at]), at)
            inner = left[at] >= 0
        out[lo : lo + size] += f["value"][at].sum(1)
    return out


def score_models(rows: DataFrame, forests: DataFrame, targets: Sequence[Target], keys: Sequence[str] = (), naive: bool = True) -> DataFrame:
    """(keys, window, target, model, hour, actual, predicted) of all models, by one keyed pass over rows and models."""
    inputs = {t.name: {n: i for i, n in enumerate(t.inputs)} for t in targets}
    group = [*keys, *GROUP]
    key_fields = "".join(f"`{k}` {rows.schema[k].dataType.simpleString()}, " for k in keys)
    schema = f"{key_fields}window string, target string, model string, {TS} timestamp, actual double, predicted double"

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        names = [*group, "model", TS, "actual", "predicted"]
        parts = []
        if left.num_rows:
            target = left["target"][0].as_py()
            x = _matrix(left["x"], len(inputs[target]))
            for model in sorted(set(right["model"].to_pylist())):
                nodes = right.filter(pa.compute.equal(right["model"], model))
                forest = {c: nodes[c].to_numpy(zero_copy_only=False) for c in ("tree", "node", "feature", "threshold", "missing_left", "left", "right", "value")}
                predicted = pa.array(_apply(forest, x, inputs[target]))
                parts.append(pa.Table.from_arrays([*[left[c] for c in group], pa.array([model] * left.num_rows), left[TS], left["label"], predicted], names))
        if parts:
            return pa.concat_tables(parts)
        empty = left.select([*group, TS, "label"]).slice(0, 0)
        return pa.Table.from_arrays([*[empty[c] for c in group], pa.array([], pa.string()), empty[TS], empty["label"], pa.array([], pa.float64())], names)

    wanted = rows.select(*group, TS, "label", "x")
    nodes = forests.select(*group, "model", "tree", "node", "feature", "threshold", "missing_left", "left", "right", "value")
    scored = wanted.groupBy(*group).cogroup(nodes.groupBy(*group)).applyInArrow(score, schema)
    if not naive:
        return scored
    return scored.unionByName(rows.select(*group, F.lit(C.NAIVE_MODEL).alias("model"), TS, F.col("label").alias("actual"), F.col("naive").alias("predicted")))


def importance(forests: DataFrame, targets: Sequence[Target], keys: Sequence[str] = ()) -> DataFrame:
    """Share of each input in the gain of a model's splits, or its absolute standardised weight, ranked.

    Every input has a row: those that no split uses have 0.
    """
    group = [*keys, *GROUP, "model"]
    used = forests.where("feature is not null").groupBy(*group, "feature").agg(F.sum("gain").alias("gain"))
    listed = F.create_map(*[e for t in targets for e in (F.lit(t.name), F.lit(list(t.inputs)))])
    every = forests.select(*group).distinct().select(*group, F.explode(listed[F.col("target")]).alias("feature"))
    found = every.join(used, [*group, "feature"], "left").withColumn("gain", F.coalesce("gain", F.lit(0.0)))
    total = F.sum("gain").over(Window.partitionBy(*group))
    value = F.when((F.col("model") == RIDGE) | (total == 0), F.col("gain")).otherwise(F.col("gain") / total)
    ranked = Window.partitionBy(*group).orderBy(F.desc("importance"), "feature")
    return found.withColumn("importance", value).withColumn("rank", F.row_number().over(ranked)).select(*group, "feature", "importance", "rank")
