"""The table of fitted models: trees against a plain version, fitting and scoring by keys, storage in versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hourwatt.operators import trees as T
from hourwatt.plans import model_table as M
from hourwatt.plans.forecast import best_models
from hourwatt.sources.model_store import manifest, publish_models, read_models

INPUTS = ("a", "b", "c")
TARGETS = [M.Target("one", "y", INPUTS, "a"), M.Target("two", "z", INPUTS, "b")]
SMALL = {"random_forest": T.Growth(trees=5, step=0.0, depth=4, min_rows=3, bootstrap=True), "lightgbm": T.Growth(trees=8, step=0.3, leaves=5, min_rows=4, l1=0.1, l2=1.0, column_share=0.7)}


def plain_boosting(x, y, growth):
    """Best-first trees by trying every threshold of every feature on the rows themselves."""

    def gain(g):
        return max(abs(g.sum()) - growth.l1, 0) ** 2 / (len(g) + growth.l2)

    def best(rows, g):
        out = (0.0, None, None)
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for cut in (values[:-1] + values[1:]) / 2:
                left, right = rows[x[rows, f] <= cut], rows[x[rows, f] > cut]
                if min(len(left), len(right)) >= growth.min_rows:
                    won = gain(g[left]) + gain(g[right]) - gain(g[rows])
                    if won > out[0] + 1e-9:
                        out = (won, left, right)
        return out

    now = np.full(len(y), y.mean())
    for _ in range(growth.trees):
        g, leaves = now - y, [np.arange(len(y))]
        while len(leaves) < (growth.leaves or len(y)):
            splits = [best(rows, g) for rows in leaves]
            at = int(np.argmax([s[0] for s in splits]))
            if splits[at][0] <= 1e-9:
                break
            leaves[at : at + 1] = splits[at][1:]
        for rows in leaves:
            s = g[rows].sum()
            now[rows] -= growth.step * np.sign(s) * max(abs(s) - growth.l1, 0) / (len(rows) + growth.l2)
    return now


def test_trees_equal_a_plain_version():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 3))
    y = x @ [3.0, -1.0, 0.5] + np.where(x[:, 0] > 0.3, 4, 0) + rng.normal(size=60)
    growth = T.Growth(trees=6, step=0.3, leaves=6, min_rows=4, l1=0.1, l2=1.0)
    ours = sum(T.tree_values(t, x) for t in T.grow(x, y, growth, 1))
    assert np.allclose(ours, plain_boosting(x, y, growth))


@pytest.mark.parametrize("name", sorted(T.GROWTHS))
def test_every_configuration_beats_the_mean(name):
    rng = np.random.default_rng(4)
    x, new = rng.normal(size=(400, 4)), rng.normal(size=(200, 4))
    y, wanted = (m @ [5.0, -2.0, 0.0, 1.0] for m in (x, new))
    made = list(T.grow(x, y, T.GROWTHS[name], 1))
    assert len(made) == T.GROWTHS[name].trees + (T.GROWTHS[name].step > 0)
    got = sum(T.tree_values(t, new) for t in made)
    assert np.mean((got - wanted) ** 2) < 0.3 * np.var(wanted)


def test_many_values_and_constant_inputs():
    x = np.column_stack([np.arange(5000.0), np.zeros(5000)])
    assert len(T.cut_points(x[:, 0])) <= T.BINS and len(T.cut_points(x[:, 1])) == 0
    y = (x[:, 0] > 2500) * 10.0
    fitted = sum(T.tree_values(t, x) for t in T.grow(x, y, T.Growth(trees=20, step=0.5, leaves=4, min_rows=5), 1))
    assert np.abs(fitted - y).mean() < 0.3


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    made = []
    for site in ("n", "s", None):
        for i in range(120):
            a, b, c = (None if rng.random() < 0.1 else float(v) for v in rng.normal(size=3))
            y = 2.0 * (a or 0) - (b or 0) + (5 if site == "s" else 0)
            for window in ("w1", "w2"):
                made.append((site, i, window, "train" if i < 90 else "test", None if i % 17 == 0 else float(y), None if site == "n" else float(-y), a, b, c))
    table = spark.createDataFrame(made, "site string, i int, window string, role string, y double, z double, a double, b double, c double")
    table = table.withColumn(M.TS, F.timestamp_seconds(F.col("i") * 3600))
    return M.model_rows(table, (), TARGETS, ["site"]).persist()


@pytest.fixture(scope="module")
def forests(rows):
    return M.fit_models(rows, TARGETS, ["ridge", *SMALL], ["site"], SMALL).persist()


def test_one_table_holds_every_model(forests):
    found = {tuple(r) for r in forests.select("site", "window", "target", "model").distinct().collect()}
    # Site n has no label of target two, so there is nothing to fit.
    assert found == {(s, w, t, m) for s in ("n", "s", None) for w in ("w1", "w2") for t in ("one", "two") for m in ("ridge", *SMALL) if (s, t) != ("n", "two")}


def test_scoring_equals_walking_each_model(rows, forests):
    scored = M.score_models(rows.where("role = 'test'"), forests, TARGETS, ["site"])
    got = {(r.site, r.window, r.target, r.model, r[M.TS]): r.predicted for r in scored.collect()}
    nodes = {}
    for r in forests.collect():
        nodes.setdefault((r.site, r.window, r.target, r.model), {})[r.tree, r.node] = r
    tests = rows.where("role = 'test'").collect()
    assert len(got) == sum(1 + sum(k[:3] == (t.site, t.window, t.target) for k in nodes) for t in tests)
    for t in tests:
        x = dict(zip(INPUTS, t.x))
        assert got[t.site, t.window, t.target, "naive_lag_24h", t[M.TS]] == t.naive
        for (site, window, target, model), held in nodes.items():
            if (site, window, target) != (t.site, t.window, t.target):
                continue
            total = sum(n.value * (n.threshold if x[n.feature] is None else x[n.feature]) for (tree, _), n in held.items() if tree < 0)
            for tree in {k for k, _ in held if k >= 0}:
                n = held[tree, 0]
                while n.left >= 0:
                    left = n.missing_left if x[n.feature] is None else x[n.feature] <= n.threshold
                    n = held[tree, n.left if left else n.right]
                total += n.value
            assert abs(got[site, window, target, model, t[M.TS]] - total) < 1e-9


def test_ridge_is_the_closed_form(rows, forests):
    train = rows.where("role = 'train' and site = 's' and window = 'w1' and target = 'one' and label is not null").collect()
    x, y = np.array([[np.nan if v is None else v for v in r.x] for r in train]), np.array([r.label for r in train])
    x = np.where(np.isnan(x), np.nanmedian(x, axis=0), x)
    z = (x - x.mean(0)) / x.std(0)
    w = np.linalg.solve(z.T @ z + 10 * np.eye(3), z.T @ (y - y.mean()))
    scored = M.score_models(rows.where("role = 'train' and site = 's' and window = 'w1' and target = 'one' and label is not null"), forests.where("model = 'ridge'"), TARGETS, ["site"], naive=False)
    got = {r[M.TS]: r.predicted for r in scored.collect()}
    assert np.allclose([got[r[M.TS]] for r in train], z @ w + y.mean())


def test_a_fit_does_not_depend_on_the_order_of_rows(rows, forests):
    again = M.fit_models(rows.orderBy(F.rand(3)), TARGETS, ["random_forest"], ["site"], SMALL)
    kept = forests.where("model = 'random_forest'")
    assert again.exceptAll(kept).isEmpty() and kept.exceptAll(again).isEmpty()


def test_importance_names_every_input(forests):
    got = M.importance(forests, TARGETS, ["site"]).where("site = 's'").collect()
    by = {}
    for r in got:
        by.setdefault((r.window, r.target, r.model), []).append(r)
    assert len(by) == 2 * 2 * 3
    for (_, _, model), found in by.items():
        assert sorted(r["rank"] for r in found) == [1, 2, 3] and {r.feature for r in found} == set(INPUTS)
        assert min(found, key=lambda r: r["rank"]).feature == "a"
        if model != "ridge":
            assert abs(sum(r.importance for r in found) - 1) < 1e-9


def test_unknown_models_and_targets():
    with pytest.raises(ValueError):
        M.supply_target("tide")


def test_versions_are_published_and_pruned(spark, forests, tmp_path):
    path = str(tmp_path / "models")
    assert manifest(spark, path) == {"current": None, "versions": []}
    assert publish_models(forests.limit(0), path) is None and manifest(spark, path)["current"] is None
    for n in (1, 2, 3):
        assert publish_models(forests.where(F.col("tree") < n), path, keep_older=1) == n
    known = manifest(spark, path)
    assert (known["current"], known["versions"]) == (3, [3, 2])
    assert sorted(p.name.split("-")[0] for p in (tmp_path / "models").iterdir() if p.is_dir()) == ["v2", "v3"]
    assert read_models(spark, path).count() == forests.where("tree < 3").count()
    assert read_models(spark, path, 2).count() == forests.where("tree < 2").count()
    with pytest.raises(ValueError):
        read_models(spark, path, 1)
    assert publish_models(forests, path, keep_older=0) == 4 and manifest(spark, path)["versions"] == [4]


def test_best_model_of_each_family(spark, forests):
    summary = spark.createDataFrame([("one", "naive_lag_24h", 0.1), ("one", "ridge", 3.0), ("one", "lightgbm", 2.0), ("two", "ridge", None)], "target string, model string, mae double")
    assert [tuple(r) for r in best_models(forests, summary).select("target", "model").distinct().collect()] == [("one", "lightgbm")]
