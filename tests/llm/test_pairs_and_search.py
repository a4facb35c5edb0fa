"""n-gram join, vector near duplicates and top-k search against brute force."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import hourwatt.llm.ngram_join as ng
import hourwatt.llm.topk_search as ts
import hourwatt.llm.vector_dedup as vd
from brute import grams, groups
from fixtures import edge_docs, edge_rows, no_docs, prose


def test_pruning_table_keeps_pairs_at_the_threshold():
    needed = ng.least_matches(0.8, 1e-6)
    assert needed == sorted(needed) and needed[-1] <= 65
    lost = sum(math.comb(100, m) * 0.8**m * 0.2 ** (100 - m) for m in range(needed[-1]))
    assert lost < 1e-3


def mutated(text: str, rng: random.Random, changes: int) -> str:
    words = text.split()
    for _ in range(changes):
        words[rng.randrange(len(words))] = "new%d" % rng.randrange(10**6)
    return " ".join(words)


@pytest.mark.parametrize("block", [256, 8])
def test_links_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(ng, "BLOCK", block)
    rng = random.Random(4)
    base = [prose(i, 150) for i in range(4)]
    texts = {i: mutated(base[i % 4], rng, rng.randint(0, 5)) for i in range(60)} | {70: base[0].upper(), 71: base[0], 72: "", 73: None, 74: "a b", 75: "a  b", 76: "a c", 77: ""}
    rows = ng.ngram_join(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    sets = {k: grams(t) for k, t in texts.items()}
    near = lambda a, b: sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    links = [(a, b) for a in texts for b in texts if a < b and near(a, b)]
    degree, root = Counter(x for l in links for x in l), groups(texts, links)
    assert {r.doc_id: (r.n_links, r.component_id, r.kept) for r in rows} == {k: (degree[k], root[k], root[k] == k) for k in texts}


def test_exact_overlap_by_product_equals_one_by_one():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, 50).astype(np.uint64)) for _ in range(40)]
    a, b = np.triu_indices(40, 1)
    many = ng._exact(sets, a, b, 0.5)
    few = np.concatenate([ng._exact(sets, a[i : i + 100], b[i : i + 100], 0.5) for i in range(0, len(a), 100)])
    assert (many == few).all() and many.any() and not many.all()


def test_text_edge_rows(spark):
    rows = ng.ngram_join(edge_docs(spark)).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in edge_rows())
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[0].n_links == by[1].n_links == 0 and by[1].component_id == 1
    # the shared text: two ids, one repeated row, one row without an id, and one near copy
    assert by[6].n_links == 4 and by[7].component_id == 6
    assert ng.ngram_join(no_docs(spark)).count() == 0


def unit(v):
    return v / np.linalg.norm(v)


def test_vectors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vd, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(6)
    vectors = [unit(rng.standard_normal(32)) for _ in range(150)]
    for i in range(40):
        vectors.append(unit(vectors[i % 5] + rng.standard_normal(32) * 0.03))
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(vectors)]
    rows += [(300, rows[0][1]), (301, rows[0][1]), (302, [2 * x for x in rows[1][1]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    x = np.array([v for _, v in rows])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    ids = [i for i, _ in rows]
    pairs = [(ids[a], ids[b]) for a in range(len(ids)) for b in range(a + 1, len(ids)) if x[a] @ x[b] >= 0.95]
    degree, root = Counter(i for p in pairs for i in p), groups(ids, pairs)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vd.near_duplicates(df).collect()}
    assert got == {i: (degree[i], root[i], root[i] == i) for i in ids}


def test_recall_at_the_threshold(spark):
    """Pairs just above the threshold, the hardest to find: at least nine in ten are linked."""
    rng = np.random.default_rng(9)
    rows = []
    for i in range(400):
        a = unit(rng.standard_normal(64))
        side = unit(rng.standard_normal(64) - a * (a @ rng.standard_normal(64)))
        side = unit(side - a * (a @ side))
        rows += [(2 * i, a.tolist()), (2 * i + 1, (a * 0.951 + side * math.sqrt(1 - 0.951**2)).tolist())]
    found = vd.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).where("n_links > 0").count()
    assert found >= 0.9 * 800


def odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0, 2.0, 0.0]), (None, [1.0, 2.0]), (20, [-1.0, 0.5]), (40, [3.0, -4.0])]
    return spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, code string")


def test_odd_vectors(spark):
    rows = vd.near_duplicates(odd_vectors(spark)).collect()
    assert Counter(r.vec_id for r in rows) == Counter([1, 2, 2, 3, 4, 5, 6, 7, 8, 9, None, 20, 40])
    by = {r.vec_id: r for r in rows}
    assert by[1].n_links == 3 and by[2].component_id == 1 and by[None].component_id == 1 and by[9].n_links == 0
    assert all(by[i].n_links == 0 and by[i].kept for i in (3, 4, 5, 6, 7, 8))
    assert vd.near_duplicates(odd_vectors(spark).limit(0)).count() == 0
    top = ts.top_k(odd_vectors(spark), F.col("vec_id") % 20 == 0, k=3).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in sorted(top, key=lambda r: (r.query_id, r["rank"]))][:3] == [(20, 1, 1), (20, 2, 2), (20, 3, 2)]
    assert ts.top_k(odd_vectors(spark).limit(0), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("sizes", [(64, 2048, 256), (4, 16, 8)])
def test_top_k_equals_brute_force(spark, monkeypatch, sizes):
    for name, value in zip(("BLOCK", "SUPER", "GROUP"), sizes):
        monkeypatch.setattr(ts, name, value)
    rng = np.random.default_rng(2)
    x = np.round(rng.standard_normal((300, 8)), 1)
    x[100:140] = x[7]  # many ties
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    q = np.floor(64 * x).astype(int)
    want = []
    for i in range(0, 300, 20):
        s = sorted(((-int(q[i] @ q[j]), j) for j in range(300) if j != i))[:20]
        want += [(i, n + 1, j, -v) for n, (v, j) in enumerate(s)]
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in ts.top_k(df, F.col("vec_id") % 20 == 0).collect()]
    assert sorted(got) == want


def test_no_task_meets_all_vectors(spark, monkeypatch):
    plans, write = [], ts.stored
    monkeypatch.setattr(ts, "SUPER", 16)
    monkeypatch.setattr(ts, "GROUP", 1)
    monkeypatch.setattr(ts, "stored", lambda df, name: (plans.append(df._jdf.queryExecution().executedPlan().toString()), write(df, name))[1])
    df = spark.createDataFrame([(i, [float(i % 7), float(i % 11)]) for i in range(300)], "vec_id long, embedding array<double>")
    assert ts.top_k(df, F.col("vec_id") % 20 == 0).count() == 300
    assert len(plans) == 4 and not any("SinglePartition" in p for p in plans)


def test_large_products_are_exact():
    big = np.full((1, 64), 2**26, dtype=np.int32)
    assert ts._product((big, big))[0, 0] == 64 * 2**52


def test_components_of_chains_stars_and_rings(spark):
    from hourwatt.llm.components import components, spanning_links

    chain = [("c%02d" % i, "c%02d" % (i + 1)) for i in range(20)]
    star = [("s00", "s%02d" % i) for i in range(1, 30)]
    ring = [("r%d" % i, "r%d" % ((i + 1) % 5)) for i in range(5)]
    links = chain + star + ring + [("x", "x")]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a string, b string")).collect()}
    assert got == {n: {"c": "c00", "s": "s00", "r": "r0"}[n[0]] for pair in chain + star + ring for n in pair}
    a, b = np.array([0, 1, 2, 0]), np.array([1, 2, 0, 3])
    assert len(spanning_links(4, a, b)) == 3


def test_scores_of_large_components_are_exact(spark):
    """No component is cut: scores are exact up to the ends of a long, and ties there go to the smaller id."""
    import math

    rows = [(0, [2.0**21, 1.0]), (1, [2.0**22, -3.0]), (2, [2.0**21, 0.5]), (3, [2.0**21, 0.25]), (4, [-(2.0**25), 2.0**30]), (5, [1e30, 1e-3]), (6, [1e30, -1.0]), (7, [-1e30, 0.0]), (8, [0.0, 7.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = {i: [math.floor(64 * x) for x in v] for i, v in rows}
    for some in (rows[:4], rows):
        ids = [i for i, _ in some]
        wanted = {}
        for q in ids:
            scores = [(max(min(sum(a * b for a, b in zip(whole[q], whole[i])), 2**63 - 1), -(2**63) + 1), i) for i in ids if i != q]
            wanted[q] = [(i, s) for s, i in sorted(scores, key=lambda x: (-x[0], x[1]))[:3]]
        got = {}
        for r in ts.top_k(vectors.where(F.col("vec_id").isin(ids)), F.lit(True), 3).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert got == wanted
