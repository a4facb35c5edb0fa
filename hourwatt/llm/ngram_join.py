"""Near-duplicate texts by the Jaccard similarity of their word 5-grams, with Bayesian pruning of candidates.

1. Texts with equal sets of 5-grams are one class; the rest works on one text per class.
2. MinHash values, cut into bands, bring candidates together: two texts at the threshold share a band with probability
   1 - (1 - 0.8 ** 4) ** 25, all but 2 in a million.
3. The values of a candidate pair are compared ``STEP`` at a time. With a flat prior, m matches of n give the posterior
   Beta(m + 1, n - m + 1); once its mass at or above the threshold falls below ``TOLERANCE``, the pair is dropped.
4. Pairs that survive link their texts to candidate groups, and inside each group the same pruning is followed by the
   exact Jaccard similarity of whole 5-gram sets.

Buckets and groups with many texts are cut into blocks and dealt out as block pairs; a task gives back link counts and
spanning links, never all pairs.

Defined results: words are what white-space bytes separate, in lower case; a text of fewer than five words has the one
gram of all of them; a null text or one without words links with nothing, not even with another such; exact repeats
link with each other; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourwatt.llm.components import components, linked_groups, spanning_links
from hourwatt.llm.scratch import give_back_memory, stored
from hourwatt.llm.windows import MULTIPLIERS, Rolling, batches_of, mixed, word_codes

GRAM = 5
THRESHOLD = 0.8
ROWS, BANDS = 4, 25
VALUES = ROWS * BANDS
STEP = 10
TOLERANCE = 1e-6
BLOCK = 256
BATCH_BYTES = 1 << 20
_RNG = np.random.default_rng(1907)
SEEDS = _RNG.integers(1, 2**63, VALUES, dtype=np.uint64)
FACTORS = _RNG.integers(1, 2**63, VALUES, dtype=np.uint64) | np.uint64(1)


def least_matches(threshold: float, tolerance: float, values: int = VALUES, step: int = STEP) -> list[int]:
    """For step, 2 step, ... values: the fewest matches whose posterior still reaches the tolerance."""
    out = []
    for n in range(step, values + 1, step):
        mass, m = 0.0, -1
        while mass < tolerance:
            m += 1
            mass += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def _gram_batches(texts: list[bytes], gram: int):
    """(documents, sorted distinct gram hashes, first gram of each document and the end) of bounded batches."""
    for part in batches_of([len(t) for t in texts], BATCH_BYTES):
        own = texts[part]
        starts, codes = word_codes(np.frombuffer(b" ".join(own) + b" ", dtype=np.uint8))
        bounds = np.searchsorted(starts, np.concatenate([[0], np.cumsum([len(t) + 1 for t in own])]))
        rolling, sizes = Rolling(codes, MULTIPLIERS[1]), np.diff(bounds)
        counts = np.where(sizes >= gram, sizes - gram + 1, np.minimum(sizes, 1))
        ends = np.cumsum(counts)
        doc = np.repeat(np.arange(len(own)), counts)
        at = np.arange(ends[-1]) + np.repeat(bounds[:-1] - (ends - counts), counts)
        hashes = rolling.of(at, np.minimum(at + gram, bounds[1:][doc]))
        order = np.lexsort((hashes, doc))
        doc, hashes = doc[order], hashes[order]
        new = np.ones(len(doc), dtype=bool)
        new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
        doc, hashes = doc[new], hashes[new]
        filled, first = np.unique(doc, return_index=True)
        yield filled + part.start, hashes, np.concatenate([first, [len(doc)]])


def _utf8(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column("text").to_pylist()]


def _signed(source: DataFrame, gram: int) -> DataFrame:
    """Per document with words: two hashes of its set of grams, and its MinHash values."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for docs, grams, bounds in _gram_batches(_utf8(batch), gram):
                if not len(docs):
                    continue
                first = bounds[:-1]
                values = np.empty((len(docs), VALUES), dtype=np.uint32)
                for j in range(VALUES):
                    values[:, j] = np.minimum.reduceat(((grams ^ SEEDS[j]) * FACTORS[j]) >> np.uint64(32), first)
                ids = [mixed(np.add.reduceat(mixed(grams ^ SEEDS[j]), first)).view(np.int64) for j in (0, 1)]
                rows = pa.array(docs)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("k1").take(rows), batch.column("k2").take(rows), *map(pa.array, ids), pa.array([v.tobytes() for v in values], pa.binary())],
                    names=["k1", "k2", "s1", "s2", "values"],
                )
        give_back_memory()

    return source.mapInArrow(sign, "k1 long, k2 long, s1 long, s2 long, values binary")


def _sets(source: DataFrame, wanted: DataFrame, gram: int) -> DataFrame:
    """The gram sets of the texts that stand for the classes ``wanted``."""
    held = source.alias("s").join(wanted.alias("w"), F.col("s.k1").eqNullSafe(F.col("w.k1")) & (F.col("s.k2") == F.col("w.k2"))).select("w.key", "s.text")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for docs, grams, bounds in _gram_batches(_utf8(batch), gram):
                sets = [grams[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(docs)), pa.array(sets, pa.binary())], names=["key", "grams"])
        give_back_memory()

    return held.mapInArrow(gather, "key string, grams binary")


def _bands(values: np.ndarray) -> np.ndarray:
    out = np.zeros((len(values), BANDS), dtype=np.uint64)
    for j in range(ROWS):
        out = mixed(out + values[:, j::ROWS][:, :BANDS] + np.uint64(j + 1))
    return out.view(np.int64)


def _values(rows: list) -> np.ndarray:
    return np.frombuffer(b"".join(r["values"] for r in rows), dtype=np.uint32).reshape(-1, VALUES)


def surviving(x: np.ndarray, y: np.ndarray | None, needed: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs between the rows of x and y (or among those of x) that no comparison step drops."""
    a, b = (np.indices((len(x), len(y))).reshape(2, -1)) if y is not None else np.triu_indices(len(x), 1)
    other = x if y is None else y
    matches = np.zeros(len(a), dtype=np.int16)
    for k, need in enumerate(needed):
        part = slice(k * STEP, (k + 1) * STEP)
        matches += (x[a, part] == other[b, part]).sum(axis=1, dtype=np.int16)
        keep = matches >= need
        a, b, matches = a[keep], b[keep], matches[keep]
    return a, b


def _dealt(placed: DataFrame, group: list[str]) -> DataFrame:
    """(group, key, block, i, j): each key's block of its group, dealt to all block pairs it takes part in."""
    sizes = placed.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*group, F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    own = placed.join(sizes, group).withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    pairs = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return pairs.select(*group, "key", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))


def _sides(rows: DataFrame, group: list[str], columns: list[str]) -> DataFrame:
    side = lambda block: F.collect_list(F.when(F.col("block") == F.col(block), F.struct(*columns)))
    return rows.groupBy(*group, "i", "j").agg(side("i").alias("left"), F.when(F.col("i") != F.col("j"), side("j")).alias("right")).select("left", "right")


def _exact(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs reach the threshold: whole sets, one by one or, when pairs are many, through one incidence product."""
    sizes = np.array([len(s) for s in sets])
    if len(a) < 500:
        common = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a, b)], dtype=np.int64)
    else:
        used = np.unique(np.concatenate([a, b]))
        row = np.repeat(np.arange(len(used)), sizes[used])
        _, column, times = np.unique(np.concatenate([sets[i] for i in used]), return_inverse=True, return_counts=True)
        shared = times[column] > 1
        row, column = row[shared], np.unique(column[shared], return_inverse=True)[1]
        at = np.zeros(len(sets), dtype=np.int64)
        at[used] = np.arange(len(used))
        product, width = np.zeros((len(used), len(used)), dtype=np.float32), 1 << 14
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        for start in range(0, int(column.max(initial=-1)) + 1, width):
            lo, hi = np.searchsorted(column, [start, start + width])
            grid = np.zeros((len(used), width), dtype=np.float32)
            grid[row[lo:hi], column[lo:hi] - start] = 1
            product += grid @ grid.T
        common = product[at[a], at[b]].astype(np.int64)
    # common / union >= threshold, without rounding for thresholds of up to four decimals
    return common * 10_000 >= round(threshold * 10_000) * (sizes[a] + sizes[b] - common)


def ngram_join(docs: DataFrame, text: str = "text", doc: str = "doc_id", threshold: float = THRESHOLD, gram: int = GRAM, tolerance: float = TOLERANCE) -> DataFrame:
    """One row per row of ``docs``: id, n_links, component_id (its class: the smallest id reached by links) and kept."""
    needed = least_matches(threshold, tolerance)
    source = docs.select(F.col(f"`{doc}`").cast("long").alias("k1"), F.xxhash64(F.col(f"`{text}`")).alias("k2"), F.lower(F.col(f"`{text}`")).cast("binary").alias("text"))
    key = F.concat_ws("-", F.hex("s1"), F.hex("s2"))
    signed = stored(_signed(source, gram).withColumn("key", key).drop("s1", "s2"), "signatures")
    # Null ids cannot be told apart later, so a class is represented by a row with an id where it has one.
    picked = F.min_by(F.struct("k1", "k2", "values"), F.struct(F.col("k1").isNull(), "k1", "k2")).alias("at")
    distinct = stored(signed.groupBy("key").agg(picked, F.count(F.lit(1)).alias("copies"), F.min("k1").alias("least")).select("key", "copies", "least", "at.*"), "classes")

    def bands(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = np.frombuffer(b"".join(batch["values"]), dtype=np.uint32).reshape(-1, VALUES)
            yield pd.DataFrame({"key": batch["key"], "bands": list(_bands(values))})

    placed = distinct.select("key", "values").mapInPandas(bands, "key string, bands array<long>").select("key", F.posexplode("bands").alias("band", "bucket"))
    buckets = _dealt(stored(placed, "bands"), ["band", "bucket"]).join(distinct.select("key", "values"), "key")

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ends = [[], []]
            for left, right in zip(batch["left"], batch["right"]):
                left, right = list(left), None if right is None else list(right)
                a, b = surviving(_values(left), None if right is None else _values(right), needed)
                rows = left + (right or [])
                for i, j in spanning_links(len(rows), a, b + (0 if right is None else len(left))):
                    ends[0].append(rows[i]["key"])
                    ends[1].append(rows[j]["key"])
            yield pd.DataFrame({"a": pd.Series(ends[0], dtype=object), "b": pd.Series(ends[1], dtype=object)})

    candidates = stored(_sides(buckets, ["band", "bucket"], ["key", "values"]).mapInPandas(meet, "a string, b string").distinct(), "candidate-links")
    groups = stored(components(candidates).select(F.col("node").alias("key"), F.col("root").alias("grp")), "candidate-groups")
    members = groups.join(distinct.select("key", "values", "copies", "k1", "k2"), "key")
    sets = stored(members.select("key", "values", "copies").join(_sets(source, members.select("key", "k1", "k2"), gram).dropDuplicates(["key"]), "key"), "gram-sets")
    grouped = _dealt(groups, ["grp"]).join(sets, "key")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys, counts, others = [], [], []
            for left, right in zip(batch["left"], batch["right"]):
                left, right = list(left), None if right is None else list(right)
                rows = left + (right or [])
                a, b = surviving(_values(left), None if right is None else _values(right), needed)
                b = b + (0 if right is None else len(left))
                good = _exact([np.frombuffer(r["grams"], dtype=np.uint64) for r in rows], a, b, threshold) if len(a) else np.zeros(0, bool)
                a, b, copies = a[good], b[good], np.array([r["copies"] for r in rows])
                links = (np.bincount(a, copies[b], len(rows)) + np.bincount(b, copies[a], len(rows))).astype(np.int64)
                forest = spanning_links(len(rows), a, b)
                hit = np.flatnonzero(links)
                keys += [rows[i]["key"] for i in hit] + [rows[i]["key"] for i, _ in forest]
                counts += links[hit].tolist() + [0] * len(forest)
                others += [None] * len(hit) + [rows[j]["key"] for _, j in forest]
            yield pd.DataFrame({"key": pd.Series(keys, dtype=object), "links": pd.Series(counts, dtype="int64"), "other": pd.Series(others, dtype=object)})
            give_back_memory()

    found = stored(_sides(grouped, ["grp"], ["key", "values", "copies", "grams"]).mapInPandas(verify, "key string, links long, other string"), "links")
    links = found.where("other is null").groupBy("key").agg(F.sum("links").alias("links"))
    edges = found.where("other is not null").select(F.col("key").alias("a"), F.col("other").alias("b"))
    keyed = source.select("k1", "k2").alias("s").join(signed.select("k1", "k2", "key").distinct().alias("m"), F.col("s.k1").eqNullSafe(F.col("m.k1")) & (F.col("s.k2") == F.col("m.k2")), "left")
    return linked_groups(keyed.select(F.col("s.k1").alias("id"), F.col("m.key").alias("key")), distinct, links, edges, doc)
