"""Repeated word windows behind a count-min filter.

1. Every task sketches the anchors of its windows; partial sketches merge slab by slab. A window's count is at most
   its anchor's, and a count-min cell is at least the sum of what falls into it, so the sketch never estimates a
   repeated window below 2.
2. Windows estimated to stand once are out. For the others, contexts (runs of windows with one anchor) are grouped
   exactly by 128 bits; where contexts of one anchor differ, their windows are grouped one by one.
3. Words that a repeated window covers are removed, judged on the input.

The sketch's width follows the corpus and stops at ``SKETCH_BYTES``; beyond that it lets more windows through to the exact
grouping and still loses none. Only that bounded sketch is broadcast.

Defined results: a null text has no words and stays null; texts shorter than a window lose nothing; kept words are
joined by one space; exact repeats of a row lose all windows in every copy; other columns pass through, except that
columns called n_words or n_removed are replaced.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourwatt.llm import context_tables as ct
from hourwatt.llm.scratch import stored, without
from hourwatt.llm.windows import MULTIPLIERS, Contexts, Rolling, batches_of, contexts, covered, mixed, word_codes

WINDOW = 35
PIECE = 8
SKETCH_BYTES = 64 << 20
DEPTH = 2
SLAB = 1 << 16
BATCH_BYTES = 1 << 20
CHARS_PER_ANCHOR = 60
DEPTH_SEEDS = np.array([0x51ED270B7F4A7C15, 0x2545F4914F6CDD1D], dtype=np.uint64)


def _word_batches(texts: list[bytes]):
    """(slice of texts, first word of each and the end, rolling hash over the words) of bounded batches."""
    for part in batches_of([len(t) for t in texts], BATCH_BYTES):
        own = texts[part]
        data = np.frombuffer(b" ".join(own) + b" ", dtype=np.uint8)
        starts, codes = word_codes(data)
        edges = np.concatenate([[0], np.cumsum([len(t) + 1 for t in own])])
        yield part, np.searchsorted(starts, edges), Rolling(codes, MULTIPLIERS[1])


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column("text").to_pylist()]


def _cells(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (mixed(hashes[None, :] ^ DEPTH_SEEDS[:, None]) >> np.uint64(64 - bits)).astype(np.int64)


def _merged_sketch(hashes: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], source: DataFrame, bits: int, least: int) -> Broadcast:
    """Count-min sketch of the values that ``hashes`` finds in ``source``, merged over all tasks and broadcast.

    Of the merged counts one bit per cell is kept: whether it reaches ``least``. A task sends its own cells only, packed
    by slab; a slab's pieces merge in one task.
    """
    schema = "depth int, slab int, cells binary, counts binary"
    fields = pa.schema([("depth", pa.int32()), ("slab", pa.int32()), ("cells", pa.binary()), ("counts", pa.binary())])

    def partial(held: list[np.ndarray]) -> pa.RecordBatch:
        rows = []
        for depth, cells in enumerate(_cells(np.concatenate(held), bits)):
            cell, count = np.unique(cells, return_counts=True)
            cuts = np.flatnonzero(np.diff(cell // SLAB)) + 1
            for c, n in zip(np.split(cell, cuts), np.split(np.minimum(count, least).astype(np.uint8), cuts)):
                rows.append({"depth": depth, "slab": int(c[0] // SLAB), "cells": (c % SLAB).astype(np.uint16).tobytes(), "counts": n.tobytes()})
        return pa.RecordBatch.from_pylist(rows, schema=fields)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for found in hashes(batches):
            if len(found):
                held.append(found)
                size += len(found)
            if size > 1 << 19:
                yield partial(held)
                held, size = [], 0
        if size:
            yield partial(held)

    def merge(pieces: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(SLAB, dtype=np.uint8)
        for cells, counts in zip(pieces["cells"], pieces["counts"]):
            at = np.frombuffer(cells, dtype=np.uint16)
            total[at] = np.minimum(total[at] + np.frombuffer(counts, dtype=np.uint8), least)
        return pieces[["depth", "slab"]].head(1).assign(bits=[np.packbits(total >= least).tobytes()])

    table = np.zeros((DEPTH, (1 << bits) // 8), dtype=np.uint8)
    merged = source.mapInArrow(add, schema).groupBy("depth", "slab").applyInPandas(merge, "depth int, slab int, bits binary")
    for row in merged.toLocalIterator():
        table[row["depth"], row["slab"] * SLAB // 8 : (row["slab"] + 1) * SLAB // 8] = np.frombuffer(row["bits"], dtype=np.uint8)
    return source.sparkSession.sparkContext.broadcast(table.tobytes())


def _bits(expected: int) -> int:
    """Cells for about four times the expected values, within SKETCH_BYTES."""
    return min((SKETCH_BYTES * 8 // DEPTH).bit_length() - 1, max(16, int(4 * expected).bit_length()))


def _held(sketch: bytes, hashes: np.ndarray, bits: int) -> np.ndarray:
    table, cells = np.frombuffer(sketch, dtype=np.uint8).reshape(DEPTH, -1), _cells(hashes, bits)
    hit = np.ones(len(hashes), dtype=bool)
    for depth in range(DEPTH):
        hit &= (table[depth][cells[depth] >> 3] >> (7 - (cells[depth] & 7)).astype(np.uint8) & 1).astype(bool)
    return hit


def _chosen(found: Contexts, keep: np.ndarray) -> Contexts:
    return Contexts(*[x[keep] for x in found])


def _candidates(source: DataFrame, sketch: Broadcast, bits: int, window: int, piece: int) -> DataFrame:
    """Contexts of all windows that the sketch estimates to stand more than once."""
    names = ["first", "count", "lead", "anchor", "context"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, bounds, rolling in _word_batches(_texts(batch)):
                own = contexts(rolling, bounds, window, piece)
                own = _chosen(own, _held(sketch.value, own.anchor, bits))
                if not len(own.first):
                    continue
                doc = np.searchsorted(bounds, own.first, side="right") - 1
                cols = [(own.first - bounds[doc]).astype(np.int32), own.count.astype(np.int32), (own.place - own.first).astype(np.int32), own.anchor.view(np.int64), own.context.view(np.int64)]
                rows = pa.array(doc + part.start)
                yield pa.RecordBatch.from_arrays([batch.column("k1").take(rows), batch.column("k2").take(rows), *map(pa.array, cols)], names=["k1", "k2", *names])

    kind = source.schema["k1"].dataType.simpleString()
    return source.mapInArrow(find, f"k1 {kind}, k2 long, first int, count int, lead int, anchor long, context long")


def _window_hashes(source: DataFrame, shared: DataFrame, window: int, piece: int) -> DataFrame:
    """The contexts ``shared`` with a hash of each of their windows.

    A second sketch, of these contexts, tells the tasks which of their own to hash; the join drops what it lets through.
    """
    bits = _bits(shared.count())
    marked = _merged_sketch(lambda batches: (b.column(0).to_numpy().view(np.uint64) for b in batches), shared.select("context"), bits, 1)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, bounds, rolling in _word_batches(_texts(batch)):
                own = contexts(rolling, bounds, window, piece)
                own = _chosen(own, _held(marked.value, own.context, bits))
                if not len(own.first):
                    continue
                ends = np.cumsum(own.count)
                at = np.arange(ends[-1]) + np.repeat(own.first - (ends - own.count), own.count)
                hashes = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(rolling.of(at, at + window).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(own.anchor.view(np.int64)), pa.array(own.context.view(np.int64)), hashes], names=["anchor", "context", "hashes"])

    hashed = source.select("text").mapInArrow(find, "anchor long, context long, hashes array<long>").groupBy(*ct.KEY).agg(F.first("hashes").alias("hashes"))
    return shared.join(hashed, ct.KEY)


def remove_repeated_windows(docs: DataFrame, text: str = "text", doc: str = "doc_id", window: int = WINDOW, piece: int = PIECE) -> DataFrame:
    """``docs`` with ``text`` cut to its kept words, plus ``n_words`` and ``n_removed``."""
    docs = without(docs, "n_words", "n_removed")
    source = docs.select(*ct.document_key(doc, text), F.col(f"`{text}`").cast("binary").alias("text"))
    size = docs.agg(F.coalesce(F.sum(F.length(F.col(f"`{text}`"))), F.lit(0))).first()[0]
    bits = _bits(size // CHARS_PER_ANCHOR)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            for _, bounds, rolling in _word_batches(_texts(batch)):
                yield contexts(rolling, bounds, window, piece).anchor

    sketch = _merged_sketch(anchors, source.select("text"), bits, 2)
    found = stored(_candidates(source, sketch, bits, window, piece), "window-contexts")
    counted = stored(ct.counted(found, F.first("lead").alias("lead")), "distinct-contexts")
    partial = ct.repeated_by_hash(_window_hashes(source, counted.where("kinds > 1"), window, piece))
    runs = ct.runs_by_document(found, counted, partial)
    return _cut(ct.with_runs(docs, doc, text, runs), docs, text, window)


def _cut(joined: DataFrame, docs: DataFrame, text: str, window: int) -> DataFrame:
    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    place, width = docs.columns.index(text), len(docs.columns)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, n_words, n_removed = [], [], []
            for t, starts, counts in zip(batch.column(place).to_pylist(), batch.column("__start").to_pylist(), batch.column("__count").to_pylist()):
                words = t.encode().split() if t is not None else []
                gone = 0
                n_words.append(len(words))
                if starts:
                    mask = covered(len(words), starts, counts, window)
                    gone = int(mask.sum())
                    words = list(itertools.compress(words, (~mask).tolist()))
                n_removed.append(gone)
                kept.append(None if t is None else b" ".join(words).decode())
            columns = list(batch.columns[:width])
            columns[place] = pa.array(kept, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], names=schema.names)

    return joined.mapInArrow(cut, schema)
