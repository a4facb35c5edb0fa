"""Near-duplicate vectors by counting collisions on one-dimensional projections.

Every vector is projected on ``PROJECTIONS`` random lines. Sorted and cut into cells, several lines at a time bring
candidate pairs together; the number of lines per table follows from the number of vectors, so that cells stay small,
and the number of tables from the wanted recall at the threshold. A candidate pair is verified by its exact cosine
when, over all lines, the second vector falls into the first one's window (value +- ``w``) at least ``need`` times;
``w`` and ``need`` are set so that a pair exactly at the threshold passes with the wanted probability.

Equal vectors are collapsed first. A cell with many rows is cut into blocks and its block pairs are dealt out, so no
task holds a whole cell. Tasks give back link counts and spanning links, never all pairs of a group: the output of a
block pair is linear in its rows.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing (0 links,
their own component); vectors of different length never link; repeated rows are vectors of their own, linked with each
other; a row with a null id keeps a null component unless it is linked. Other columns are not read.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourwatt.llm.components import linked_groups, spanning_links
from hourwatt.llm.scratch import stored
from hourwatt.llm.topk_search import usable

THRESHOLD = 0.95
PROJECTIONS = 48
RECALL = 0.98
CELL_ROWS = 64
BLOCK_ROWS = 1024
CELL_WIDTH = 1.0


def _normal_within(x: float, sigma: float) -> float:
    return math.erf(x / (sigma * math.sqrt(2)))


def _same_cell(width: float, sigma: float) -> float:
    """Chance that two values, a normal distance of deviation sigma apart, fall into one cell of a shifted grid."""
    x = np.linspace(0, width, 2001)
    density = 2 * np.exp(-(x**2) / (2 * sigma**2)) / (sigma * math.sqrt(2 * math.pi))
    return float(np.trapezoid(density * (1 - x / width), x))


def calibrated(threshold: float, n: int, recall: float = RECALL, projections: int = PROJECTIONS) -> dict:
    """Window, needed collisions, lines per table and tables for ``n`` unit vectors."""
    near = math.sqrt(2 - 2 * threshold)
    window = 1.645 * near
    hit = _normal_within(window, near)
    need, left = projections, 0.0
    while left + math.comb(projections, need) * hit**need * (1 - hit) ** (projections - need) < 1 - (1 - recall) / 2:
        left += math.comb(projections, need) * hit**need * (1 - hit) ** (projections - need)
        need -= 1
    apart, together = _same_cell(CELL_WIDTH, math.sqrt(2)), _same_cell(CELL_WIDTH, near)
    lines = max(1, math.ceil(math.log(max(n, 2) / CELL_ROWS) / -math.log(apart)))
    tables = max(1, math.ceil(math.log((1 - recall) / 2) / math.log(1 - together**lines)))
    return {"window": window, "need": need, "lines": lines, "tables": tables}


def _lines(dims: int, plan: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The random lines, the lines of each table and the grid's shifts; the same in every task."""
    rng = np.random.default_rng(dims)
    lines = rng.standard_normal((dims, PROJECTIONS))
    chosen = np.array([rng.choice(PROJECTIONS, min(plan["lines"], PROJECTIONS), replace=False) for _ in range(plan["tables"])])
    return lines, chosen, rng.uniform(0, CELL_WIDTH, chosen.shape)


def _units(vectors) -> np.ndarray:
    x = np.array([np.asarray(v, dtype=np.float64) for v in vectors])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _cells(units: np.ndarray, plan: dict) -> tuple[np.ndarray, np.ndarray]:
    """Projections, and for every table a 64-bit key of the cell."""
    lines, chosen, shifts = _lines(units.shape[1], plan)
    values = units @ lines
    grid = np.floor((values[:, chosen] + shifts) / CELL_WIDTH).astype(np.int64)
    keys = np.zeros(grid.shape[:2], dtype=np.int64)
    for j in range(grid.shape[2]):
        keys = keys * 1_000_003 + grid[:, :, j]
    return values, keys


def _linked(units: np.ndarray, values: np.ndarray, keys: np.ndarray, cut: int, table: int, threshold: float, plan: dict):
    """Links within the rows of one block (cut is their number) or between those before and after ``cut``: those that
    no earlier table has found."""
    alone = cut == len(units)
    x, y = (slice(0, cut), slice(0, cut)) if alone else (slice(0, cut), slice(cut, None))
    if len(values[x]) * len(values[y]) <= 4096:
        hits = (np.abs(values[x][:, None, :] - values[y][None, :, :]) <= plan["window"]).sum(axis=2, dtype=np.int16)
    else:
        hits = np.zeros((len(values[x]), len(values[y])), dtype=np.int16)
        for j in range(PROJECTIONS):
            hits += np.abs(values[x, j][:, None] - values[y, j][None, :]) <= plan["window"]
    good = hits >= plan["need"]
    if alone:
        good &= np.tri(cut, k=-1, dtype=bool).T
    a, b = np.nonzero(good)
    if not len(a):
        return a, b
    b = b + (0 if alone else cut)
    exact = np.einsum("ij,ij->i", units[a], units[b]) >= threshold
    a, b = a[exact], b[exact]
    new = ~(keys[a, :table] == keys[b, :table]).any(axis=1) if table else np.ones(len(a), dtype=bool)
    return a[new], b[new]


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``vectors``: id, n_links, component_id and kept."""
    spark = vectors.sparkSession
    raw = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector}`").alias("v"))
    sound = usable(F.col("v")) & F.exists("v", lambda x: x != 0)
    plain = raw.select("id", F.when(F.coalesce(sound, F.lit(False)), F.col("v")).alias("v"))
    keyed = stored(plain.select("id", F.when(F.col("v").isNotNull(), F.concat_ws("-", F.hex(F.xxhash64("v")), F.hex(F.hash("v")))).alias("key"), "v"), "vectors")
    distinct = stored(keyed.where("key is not null").groupBy("key").agg(F.first("v").alias("v"), F.count(F.lit(1)).alias("copies"), F.min("id").alias("least")), "distinct-vectors")
    plan = calibrated(threshold, distinct.count())

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dims, part in batch.groupby(batch["v"].map(len)):
                _, keys = _cells(_units(part["v"]), plan)
                yield pd.DataFrame({"key": part["key"].to_numpy(), "dims": dims, "cells": list(keys)})

    spread = distinct.select("key", "v").mapInPandas(cells, "key string, dims int, cells array<long>")
    places = stored(spread.select("key", "dims", F.posexplode("cells").alias("tab", "cell")), "vector-cells")
    cell = ["tab", "dims", "cell"]
    sizes = places.groupBy(*cell).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*cell, F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("blocks"))
    own = places.join(sizes, cell).withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    dealt = own.select(*cell, "key", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    pairs = dealt.select(*cell, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "key").join(distinct.select("key", "v", "copies"), "key")
    sides = lambda block: F.collect_list(F.when(F.col("block") == F.col(block), F.struct("key", "v", "copies")))
    tasks = pairs.groupBy(*cell, "i", "j").agg(sides("i").alias("left"), F.when(F.col("i") != F.col("j"), sides("j")).alias("right")).select("tab", "left", "right")

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys, counts, ends = [], [], []
            tasks = [(t, list(left), [] if right is None else list(right)) for t, left, right in zip(batch["tab"], batch["left"], batch["right"]) if len(left) and (right is None or len(right))]
            for _, own in itertools.groupby(sorted(tasks, key=lambda t: len(t[1][0]["v"])), key=lambda t: len(t[1][0]["v"])):
                own = list(own)
                every = [r for _, left, right in own for r in left + right]
                units = _units([r["v"] for r in every])
                values, cells_of = _cells(units, plan)
                at = 0
                for table, left, right in own:
                    part, rows = slice(at, at + len(left) + len(right)), left + right
                    at = part.stop
                    a, b = _linked(units[part], values[part], cells_of[part], len(left), table, threshold, plan)
                    if not len(a):
                        continue
                    copies = np.array([r["copies"] for r in rows])
                    links = np.bincount(a, copies[b], len(rows)) + np.bincount(b, copies[a], len(rows))
                    hit = np.flatnonzero(links)
                    forest = spanning_links(len(rows), a, b)
                    keys += [rows[i]["key"] for i in hit] + [rows[i]["key"] for i, _ in forest]
                    counts += links[hit].astype(int).tolist() + [0] * len(forest)
                    ends += [None] * len(hit) + [rows[i]["key"] for _, i in forest]
            yield pd.DataFrame({"key": pd.Series(keys, dtype=object), "links": pd.Series(counts, dtype="int64"), "other": pd.Series(ends, dtype=object)})

    found = stored(tasks.mapInPandas(link, "key string, links long, other string"), "vector-links")
    links = found.where("other is null").groupBy("key").agg(F.sum("links").alias("links"))
    edges = found.where("other is not null").select(F.col("key").alias("a"), F.col("other").alias("b"))
    return linked_groups(keyed, distinct, links, edges, id_col)
