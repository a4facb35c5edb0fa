"""Packing by lexical retrieval: windows filled with a seed document's nearest unused neighbours.

1. Every text is encoded and ended by ``END_ID``; only packed ids travel. Stretches of whole windows at the start of long
   documents are sequences of their own; what is left of each document, shorter than a window, is packed.
2. Document frequencies of the ids are counted over all documents. The vocabulary bounds them, so they are broadcast.
3. Documents are dealt to shards of about ``SHARD_TOKENS`` ids by likeness, so that related ones meet whatever the size of
   the corpus: each is sketched by its weighted terms, and a tree of two-means cuts, learnt on a sample, leads to its
   shard. Each shard builds its BM25 inverted index. The first unused document seeds a window; the index returns its
   best unused neighbours, which fill the window one after the other; the one that does not fit is cut, and what is left of
   it seeds the next window. Only a shard's last window needs padding.

Defined results: a null or empty text is the end id alone; equal rows are packed each for itself; ids of special tokens
spelt out in a text are those tokens'; other columns pass through with every piece of their document, except those called
as an added one.
"""

from __future__ import annotations

import base64
import functools
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourwatt.llm.scratch import give_back_memory, stored, without

WINDOW = 2048
END_ID = 1
SHARD_TOKENS = 1 << 20
QUERY_TERMS = 24
NEIGHBOURS = 64
K1, B = 1.2, 0.75
SKETCH = 64
SHARD_SAMPLE = 32
MOST_SAMPLE = 1 << 19
CUT_DIRECTIONS = 8
MEANS_ROUNDS = 12
BATCH_TEXTS = 256
ADDED = {"start": "long", "length": "long", "ids": "binary", "doc_tokens": "long", "sequence_id": "long", "offset": "long"}
# The pre-splitting pattern and the special token of the byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPECIAL = {"<|endoftext|>": 50256}
VOCABULARY_SIZE = 50257


@functools.lru_cache(maxsize=2)
def coder(path: str):
    """The byte-level vocabulary as ranks; its ids are those of the tokenizers file of the same vocabulary."""
    import tiktoken

    ranks = {}
    with open(path, "rb") as lines:
        for line in lines:
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


def ids_of(path: str, texts: list[str | None]) -> list[np.ndarray]:
    own, allowed = coder(path), set(SPECIAL)
    return [np.append(own.encode_to_numpy(t, allowed_special=allowed), END_ID).astype(np.uint16) if t else np.array([END_ID], dtype=np.uint16) for t in texts]


def _encoded(docs: DataFrame, path: str, text: str) -> DataFrame:
    """``docs`` without its text, plus ``__ids`` (packed) and ``__key``, a hash that deals documents out evenly."""
    rest = [c for c in docs.columns if c != text]
    schema = T.StructType([f for f in docs.schema.fields if f.name != text] + [T.StructField("__ids", T.BinaryType()), T.StructField("__key", T.LongType())])
    names, width = schema.names, len(rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_TEXTS):
                batch = whole.slice(at, BATCH_TEXTS)
                ids = pa.array([x.tobytes() for x in ids_of(path, batch.column(width).to_pylist())], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns[:width], ids, batch.column(width + 1)], names=names)

    every = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns if not isinstance(docs.schema[c].dataType, T.MapType)])
    return docs.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text}`"), every.alias("__key")).mapInArrow(run, schema)


def _frequencies(encoded: DataFrame) -> tuple[np.ndarray, int, int]:
    """Documents per id, documents and ids of the corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, docs, tokens = np.zeros(VOCABULARY_SIZE, dtype=np.int64), 0, 0
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                ids = np.frombuffer(raw, dtype=np.uint16)
                total[np.unique(ids)] += 1
                docs += 1
                tokens += len(ids)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, [-1, -2])), pa.array(np.append(total[used], [docs, tokens]))], names=["id", "n"])

    rows = encoded.select("__ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    found = dict(zip(rows["id"], rows["n"]))
    total = np.zeros(VOCABULARY_SIZE, dtype=np.int64)
    kept = rows[rows["id"] >= 0]
    total[kept["id"].to_numpy()] = kept["n"].to_numpy()
    return total, int(found.get(-1, 0)), int(found.get(-2, 0))


@functools.lru_cache(maxsize=1)
def _directions() -> np.ndarray:
    return np.random.default_rng(11).standard_normal((VOCABULARY_SIZE, SKETCH), dtype=np.float32)


def sketches(docs: list[np.ndarray], idf: np.ndarray) -> np.ndarray:
    """One row per document, of length one: its terms' weights on random directions. Like documents have like rows."""
    out = np.zeros((len(docs), SKETCH), dtype=np.float32)
    for row, ids in zip(out, docs):
        terms, times = np.unique(ids, return_counts=True)
        row[:] = (idf[terms] * times / (times + K1)).astype(np.float32) @ _directions()[terms]
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float16)


class Tree(NamedTuple):
    """Cuts that lead a sketch to its shards; a leaf (no children) has ``parts`` shards from ``first`` on."""

    directions: np.ndarray
    limits: np.ndarray
    children: np.ndarray
    first: np.ndarray
    parts: np.ndarray

    def shards(self, points: np.ndarray, keys: np.ndarray) -> np.ndarray:
        points, node = points.astype(np.float32), np.zeros(len(points), dtype=np.int64)
        while len(open_ := np.flatnonzero(self.children[node, 0] > 0)):
            at = node[open_]
            beyond = np.einsum("ij,ij->i", points[open_], self.directions[at]) > self.limits[at]
            node[open_] = self.children[at, beyond.astype(np.int64)]
        return self.first[node] + keys % self.parts[node]


def likeness_tree(points: np.ndarray, sizes: np.ndarray, shards: int) -> Tree:
    """Cut a sample of sketches where it is emptiest between two means found along its main directions, and both sides again,
    until each part stands for one shard.

    Where all sketches of a part are equal nothing lexical tells them apart, and its documents are dealt out by key.
    """
    points, todo, dealt = points.astype(np.float32), [(0, np.arange(len(points)), shards)], 0
    directions, limits, children, first, parts = [None], [0.0], [(0, 0)], [0], [1]
    while todo:
        node, own, wanted = todo.pop()
        x, direction, cut = points[own], np.zeros(SKETCH, dtype=np.float32), None
        if wanted > 1 and len(own) > 1:
            centred, best = x - x.mean(axis=0), 0.0
            for v in np.linalg.eigh(centred.T @ centred)[1][:, : -CUT_DIRECTIONS - 1 : -1].T:
                # Two means from this direction on, so that groups are parted whole.
                for _ in range(MEANS_ROUNDS):
                    beyond = centred @ v > np.median(centred @ v)
                    if beyond.all() or not beyond.any():
                        break
                    v = centred[beyond].mean(axis=0) - centred[~beyond].mean(axis=0)
                v = v / max(np.linalg.norm(v), 1e-9)
                found = x @ v
                by = np.argsort(found, kind="stable")
                reach = np.cumsum(sizes[own][by]) / sizes[own].sum()
                line, near = found[by], max(1, len(own) // 64)
                # A gap is where values differ; the emptier the line around it, the fewer like documents it parts.
                gaps = np.flatnonzero(np.diff(line) > 1e-4)
                middle = gaps[(reach[gaps] > 0.25) & (reach[gaps] < 0.75)]
                gaps = middle if len(middle) else gaps[np.argsort(np.abs(reach[gaps] - 0.5))[:1]]
                wide = (line[np.minimum(gaps + near, len(own) - 1)] - line[np.maximum(gaps + 1 - near, 0)]) / max(found.std(), 1e-9)
                if len(gaps) and wide.max() > best:
                    best, cut = wide.max(), gaps[wide.argmax()]
                    direction, along, order, reached = v.astype(np.float32), found, by, reach
        directions[node] = direction
        if cut is None:
            first[node], parts[node], dealt = dealt, wanted, dealt + wanted
            continue
        left = min(max(round(wanted * reached[cut]), 1), wanted - 1)
        limits[node] = (along[order[cut]] + along[order[cut + 1]]) / 2
        children[node] = (len(parts), len(parts) + 1)
        todo += [(len(parts), own[order[: cut + 1]], left), (len(parts) + 1, own[order[cut + 1 :]], wanted - left)]
        directions += [None, None]
        limits += [0.0, 0.0]
        children += [(0, 0), (0, 0)]
        first += [0, 0]
        parts += [1, 1]
    return Tree(np.array(directions, dtype=np.float32), np.array(limits, dtype=np.float32), np.array(children), np.array(first), np.array(parts))


def _learnt_tree(encoded: DataFrame, idf, n: int, shards: int) -> Tree:
    """The tree of a sample: about ``SHARD_SAMPLE`` documents a shard, 128 bytes each."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(x, dtype=np.uint16) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in sketches(ids, idf.value)], pa.binary()), pa.array([len(x) for x in ids], pa.int64())], names=["sketch", "size"])

    share = min(1.0, min(max(SHARD_SAMPLE * shards, 4096), MOST_SAMPLE) / n)
    rows = encoded.select("__ids").sample(share, 5).mapInArrow(sketch, "sketch binary, size long").toPandas()
    points = np.frombuffer(b"".join(rows["sketch"]), dtype=np.float16).reshape(-1, SKETCH)
    return likeness_tree(points, rows["size"].to_numpy(np.float64), shards)


def _dealt(encoded: DataFrame, idf, tree) -> DataFrame:
    """``encoded`` with ``__shard``, where each document's likes go."""
    schema = T.StructType([*encoded.schema.fields, T.StructField("__shard", T.LongType())])
    names, ids, key = schema.names, encoded.columns.index("__ids"), encoded.columns.index("__key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_TEXTS):
                batch = whole.slice(at, BATCH_TEXTS)
                points = sketches([np.frombuffer(x, dtype=np.uint16) for x in batch.column(ids).to_pylist()], idf.value)
                found = tree.value.shards(points, batch.column(key).to_numpy())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], names=names)

    return encoded.mapInArrow(run, schema)


class Index:
    """BM25 inverted index of one shard: postings by term, documents in order."""

    def __init__(self, tails: list[np.ndarray], idf: np.ndarray, mean: float):
        sizes = np.array([len(t) for t in tails])
        doc, term = np.repeat(np.arange(len(tails)), sizes), np.concatenate(tails).astype(np.int64)
        both, times = np.unique((term << 32) | doc, return_counts=True)
        term, self.docs = both >> 32, both & 0xFFFFFFFF
        self.starts = np.searchsorted(term, np.arange(VOCABULARY_SIZE + 1))
        weight = times * (K1 + 1) / (times + K1 * (1 - B + B * sizes[self.docs] / mean))
        self.weights, self.idf, self.n = (weight * idf[term]).astype(np.float32), idf, len(tails)

    def neighbours(self, ids: np.ndarray, free: np.ndarray) -> np.ndarray:
        """Unused documents by falling score for the query's rarest terms, ties to the earlier document."""
        terms, times = np.unique(ids, return_counts=True)
        worth = self.idf[terms] * np.minimum(times, 3)
        terms = terms[np.argsort(-worth, kind="stable")[:QUERY_TERMS]]
        parts = [slice(self.starts[t], self.starts[t + 1]) for t in terms]
        score = np.bincount(np.concatenate([self.docs[p] for p in parts]), np.concatenate([self.weights[p] for p in parts]), self.n)
        hit = np.flatnonzero((score > 0) & free)
        if len(hit) > NEIGHBOURS:
            hit = np.sort(hit[np.argpartition(-score[hit], NEIGHBOURS)[:NEIGHBOURS]])
        return hit[np.argsort(-score[hit], kind="stable")]


def fill(tails: list[np.ndarray], idf: np.ndarray, mean: float, window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) that fill windows one after the other."""
    index, free = Index(tails, idf, mean), np.ones(len(tails), dtype=bool)
    pieces, sequence, room, cursor, seed = [], 0, window, 0, None
    rest = None  # (document, start) of what the last window has cut off
    while True:
        if rest is not None:
            (seed, start), rest = rest, None
        else:
            while cursor < len(tails) and not free[cursor]:
                cursor += 1
            if cursor == len(tails):
                break
            seed, start = cursor, 0
            free[seed] = False
        todo, queue = (seed, start), iter(())
        asked = False
        while todo is not None:
            doc, start = todo
            take = min(room, len(tails[doc]) - start)
            pieces.append((doc, start, take, sequence, window - room))
            room -= take
            if room == 0:
                sequence, room = sequence + 1, window
                rest = (doc, start + take) if start + take < len(tails[doc]) else None
                break
            if not asked:
                queue, asked = iter(index.neighbours(tails[seed], free)), True
            found = next(queue, None)
            todo = None if found is None else (int(found), 0)
            if found is not None:
                free[found] = False
    return pieces


def pack(docs: DataFrame, path: str, text: str = "text", window: int = WINDOW, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row per piece: the columns of ``docs`` but its text, then start, length, ids (packed unsigned 16-bit),
    doc_tokens, sequence_id and offset."""
    spark = docs.sparkSession
    docs = without(docs, *[name for name in ADDED if name != text])
    encoded = stored(_encoded(docs, path, text), "encoded")
    frequency, n, tokens = _frequencies(encoded)
    idf = spark.sparkContext.broadcast(np.log1p((n - frequency + 0.5) / (frequency + 0.5)).astype(np.float32))
    mean = min(tokens / max(n, 1), window)
    shards = max(1, -(-tokens // shard_tokens))
    rest = [f for f in docs.schema.fields if f.name != text]
    added = ", ".join(f"`{name}` {kind}" for name, kind in ADDED.items())
    schema = T.StructType(rest + T._parse_datatype_string(added).fields)
    columns = [f.name for f in rest]

    def fill_shard(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        # All texts are encoded by now, so the vocabulary's tables can go, and afterwards what the shard took.
        coder.cache_clear()
        out = filled(key, frame)
        give_back_memory()
        return out

    def filled(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("__key", kind="stable").reset_index(drop=True)
        ids = [np.frombuffer(x, dtype=np.uint16) for x in frame["__ids"]]
        heads = [len(x) // window * window for x in ids]
        rows, sequence = [], 0
        for d, head in enumerate(heads):
            for start in range(0, head, window):
                rows.append((d, start, window, sequence, 0))
                sequence += 1
        left = [d for d in range(len(ids)) if len(ids[d]) > heads[d]]
        if left:
            for d, start, length, s, offset in fill([ids[d][heads[d] :] for d in left], idf.value, mean, window):
                rows.append((left[d], heads[left[d]] + start, length, sequence + s, offset))
        d, start, length, s, offset = np.array(rows, dtype=np.int64).reshape(-1, 5).T
        out = frame[columns].iloc[d].reset_index(drop=True)
        facts = {"start": start, "length": length, "ids": [ids[k][a : a + b].tobytes() for k, a, b in zip(d, start, length)], "doc_tokens": np.array([len(x) for x in ids])[d], "sequence_id": (int(key[0]) << 32) + s, "offset": offset}
        return pd.concat([out, pd.DataFrame(facts)], axis=1).set_axis(schema.names, axis=1)

    if shards == 1:
        dealt = encoded.withColumn("__shard", F.lit(0).cast("long"))
    else:
        dealt = _dealt(encoded, idf, spark.sparkContext.broadcast(_learnt_tree(encoded, idf, n, shards)))
    return dealt.groupBy("__shard").applyInPandas(fill_shard, schema)


def ids_crc32(packed: DataFrame, ids: str = "ids", out: str = "ids_crc32") -> DataFrame:
    """``packed`` with the CRC of each piece's ids as little-endian unsigned 32-bit numbers, in place of ``ids``."""
    schema = T.StructType([T.StructField(out, T.LongType()) if f.name == ids else f for f in packed.schema.fields])
    place, names = packed.columns.index(ids), schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [zlib.crc32(np.frombuffer(x, dtype=np.uint16).astype("<u4").tobytes()) for x in batch.column(place).to_pylist()]
            columns = list(batch.columns)
            columns[place] = pa.array(sums, pa.int64())
            yield pa.RecordBatch.from_arrays(columns, names=names)
        give_back_memory()

    return packed.mapInArrow(run, schema)
