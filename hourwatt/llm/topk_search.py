"""Exact top-k inner-product search by block-at-a-time pruning.

Vectors are ordered by a locality code and cut into superblocks of ``SUPER`` rows, each a forward index of blocks of
``BLOCK`` consecutive rows with the maximum and minimum of every component. A query's bound for a block is the sum over
components of what the block's extremes allow. Blocks are scored in the order of their bounds until the bound falls
below the k-th best score, so the result is exact.

Work is dealt in pairs of one query group and one superblock, both of bounded size. Every query first meets the
superblock with its best bound, which sets its k-th score so far; the pairs that follow start from it, and give back
nothing below it. The queries are a stated set against all rows; no group of rows with the same value is paired.

Defined results: vectors that are null or empty, or hold null or non-finite components, take no part; a shorter vector
counts as padded with zeros; components of any size are exact, and a score beyond the range of a long is its end; rows that
repeat an id are candidates of their own, never for a query of the same id; a repeated query row is answered once a
row; null ids take no part; ties go to the smaller id. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourwatt.llm.scratch import stored

SCALE = 64
BLOCK = 64
SUPER = 2048
GROUP = 256
CODE_BITS = 10


def usable(vector: Column) -> Column:
    """Whether a vector is there, has components and only finite ones."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, finite)


def _kind(wide: bool) -> type:
    """How components are stored: whole doubles hold every floor of a double that 32 bits do not."""
    return np.float64 if wide else np.int32


def _coded(vectors: DataFrame, dims: int, wide: bool) -> DataFrame:
    directions = np.random.default_rng(7).standard_normal((dims, CODE_BITS))
    places = 1 << np.arange(CODE_BITS)[::-1]

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            ints = np.zeros((len(batch), dims), dtype=_kind(wide))
            for i, v in enumerate(batch["v"]):
                ints[i, : len(v)] = np.floor(SCALE * np.asarray(v, dtype=np.float64))
            codes = (ints @ directions > 0) @ places
            yield pd.DataFrame({"id": batch["id"], "code": codes, "ints": [r.tobytes() for r in ints]})

    return vectors.mapInPandas(code, "id long, code long, ints binary")


def _packed(coded: DataFrame, rows: int, parts: int, dims: int, with_bounds: bool, wide: bool) -> DataFrame:
    """Rows of neighbouring codes together: ids and components of up to ``rows`` vectors, and their blocks' extremes."""

    def make(frame: pd.DataFrame, number: int) -> pd.DataFrame:
        ints = np.frombuffer(b"".join(frame["ints"]), dtype=_kind(wide)).reshape(-1, dims)
        out = {"part": [(TaskContext.get().partitionId() << 32) + number], "ids": [frame["id"].to_numpy(np.int64).tobytes()], "ints": [ints.tobytes()]}
        if with_bounds:
            edges = np.arange(0, len(ints), BLOCK)
            out |= {"tops": [np.maximum.reduceat(ints, edges).tobytes()], "lows": [np.minimum.reduceat(ints, edges).tobytes()]}
        return pd.DataFrame(out)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest, number = None, 0
        for batch in batches:
            rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            while len(rest) >= rows:
                yield make(rest.iloc[:rows], number)
                rest, number = rest.iloc[rows:].reset_index(drop=True), number + 1
        if rest is not None and len(rest):
            yield make(rest, number)

    schema = "part long, ids binary, ints binary" + (", tops binary, lows binary" if with_bounds else "")
    return coded.repartitionByRange(parts, "code", "id").sortWithinPartitions("code", "id").mapInPandas(pack, schema)


def _as_rows(raw: bytes, dims: int, wide: bool) -> np.ndarray:
    return np.frombuffer(raw, dtype=_kind(wide)).reshape(-1, dims)


def _product(*pairs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Exact sum of a @ b.T over pairs of whole numbers: in doubles where every partial sum fits their mantissa, in
    64 bits where it fits those, else in integers of any size, cut to the range of a long at the end."""
    most = sum(float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1] for a, b in pairs)
    if most < 2**62:
        kind = np.float64 if most < 2**53 else np.int64
        return sum((a.astype(kind) @ b.astype(kind).T).astype(np.int64) for a, b in pairs)
    whole = np.frompyfunc(int, 1, 1)
    exact = sum(whole(a) @ whole(b).T for a, b in pairs)
    ends = np.iinfo(np.int64)
    return np.frompyfunc(lambda x: min(max(x, ends.min + 1), ends.max), 1, 1)(exact).astype(np.int64)


def _bounds(queries: np.ndarray, tops: np.ndarray, lows: np.ndarray) -> np.ndarray:
    return _product((np.maximum(queries, 0), tops), (np.minimum(queries, 0), lows))


def _search(q_ids, queries, floor, ids, rows, tops, lows, k):
    """Rows (query place, id, score) of each query's best k in one superblock that reach its floor.

    Blocks go by descending bound, summed over the queries still open; a query leaves the rest of the blocks as soon
    as its bound there is below its k-th score.
    """
    bounds = _bounds(queries, tops, lows)
    kth = floor.copy()
    best_scores = [np.empty(0, np.int64)] * len(queries)
    best_ids = [np.empty(0, np.int64)] * len(queries)
    for block in np.argsort(-bounds.max(axis=0), kind="stable"):
        open_to = np.flatnonzero(bounds[:, block] >= kth)
        if not len(open_to):
            continue
        part = slice(block * BLOCK, (block + 1) * BLOCK)
        scores = _product((queries[open_to], rows[part]))
        good = (scores >= kth[open_to, None]) & (ids[part][None, :] != q_ids[open_to, None])
        for row in np.flatnonzero(good.any(axis=1)):
            q = open_to[row]
            s = np.concatenate([best_scores[q], scores[row, good[row]]])
            i = np.concatenate([best_ids[q], ids[part][good[row]]])
            order = np.lexsort((i, -s))[:k]  # no score is the least long, so all can be negated
            best_scores[q], best_ids[q] = s[order], i[order]
            if len(order) == k:
                kth[q] = max(kth[q], s[order[-1]])
    sizes = [len(x) for x in best_ids]
    return np.repeat(np.arange(len(queries)), sizes), np.concatenate(best_ids), np.concatenate(best_scores)


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """For every row that ``is_query`` selects: its ``k`` best other rows as (query_id, rank, vec_id, score)."""
    spark = vectors.sparkSession
    good = vectors.where(usable(F.col(vector)) & F.col(id_col).isNotNull())
    largest = F.array_max(F.transform(vector, lambda x: F.abs(x.cast("double"))))
    measured = good.agg(F.max(largest).alias("largest"), F.max(F.size(vector)).alias("dims"), F.count(F.lit(1)).alias("n"), F.count_if(is_query).alias("q")).first()
    if not measured["n"] or not measured["q"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dims, wide = measured["dims"], measured["largest"] * SCALE >= 2**31 - 1
    pick = lambda rows: _coded(rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v")), dims, wide)
    # Parts are told apart by their own number, so the vectors stay in the tasks that packed them.
    supers = stored(_packed(pick(good), SUPER, -(-measured["n"] // (4 * SUPER)), dims, True, wide).withColumnRenamed("part", "block"), "search-blocks")
    groups = stored(_packed(pick(good.where(is_query)), GROUP, -(-measured["q"] // (4 * GROUP)), dims, False, wide).withColumnRenamed("part", "grp"), "search-queries")
    every = groups.crossJoin(supers.select("block"))

    def outer_bound(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sums = []
            for q, t, b in zip(batch["q_ints"], batch["tops"], batch["lows"]):
                sums.append(float(_bounds(*(_as_rows(x, dims, wide) for x in (q, t, b))).max(axis=1).sum()))
            yield pd.DataFrame({"grp": batch["grp"], "block": batch["block"], "bound": sums})

    # Estimates do not see how many rows every pair of parts makes, so these joins are kept from broadcasting a side.
    named = every.withColumnRenamed("ints", "q_ints").withColumnRenamed("ids", "q_ids").hint("merge")
    blocks = supers.hint("merge")
    bounds = named.drop("q_ids").join(blocks.select("block", "tops", "lows"), "block").mapInPandas(outer_bound, "grp long, block long, bound double")
    first = stored(bounds.groupBy("grp").agg(F.max_by("block", F.struct("bound", "block")).alias("block")), "search-first")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                q_ids = np.frombuffer(r.q_ids, dtype=np.int64)
                floor = np.full(len(q_ids), np.iinfo(np.int64).min) if r.floors is None else np.frombuffer(r.floors, dtype=np.int64)
                place, ids, scores = _search(q_ids, _as_rows(r.q_ints, dims, wide), floor, np.frombuffer(r.ids, dtype=np.int64), *(_as_rows(x, dims, wide) for x in (r.ints, r.tops, r.lows)), k)
                yield pd.DataFrame({"grp": r.grp, "place": place, "query_id": q_ids[place], "vec_id": ids, "score": scores})

    found = "grp long, place long, query_id long, vec_id long, score long"
    columns = ["grp", "q_ids", "q_ints", "floors", "ids", "ints", "tops", "lows"]
    opening = stored(
        named.join(first, ["grp", "block"]).withColumn("floors", F.lit(None).cast("binary")).join(blocks, "block").select(*columns).mapInPandas(search, found), "search-opening"
    )

    def floors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for q_ids, kths in zip(batch["q_ids"], batch["kths"]):
                floor = np.full(len(q_ids) // 8, np.iinfo(np.int64).min)
                for x in kths if kths is not None else ():
                    floor[x["place"]] = x["kth"]
                out.append(floor.tobytes())
            yield pd.DataFrame({"grp": batch["grp"], "floors": out})

    kth = opening.groupBy("grp", "place").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth")).where(F.col("n") >= k)
    kths = kth.groupBy("grp").agg(F.collect_list(F.struct("place", "kth")).alias("kths"))
    floored = groups.select("grp", F.col("ids").alias("q_ids")).join(kths, "grp", "left").mapInPandas(floors, "grp long, floors binary")
    others = named.join(first, ["grp", "block"], "left_anti").join(floored.hint("merge"), "grp").join(blocks, "block").select(*columns)
    best = Window.partitionBy("grp", "place").orderBy(F.desc("score"), "vec_id")
    ranked = opening.unionByName(others.mapInPandas(search, found)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
