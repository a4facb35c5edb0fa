"""Repeated byte strings by a sorted array of suffixes, built in a distributed merge sort that knows common prefixes.

The array is sparse: it holds the suffixes that start at anchors (see ``windows``), of which every 400-byte string has
one, at the same place in equal strings. Contexts that repeat as a whole, such as copies and the inside of long passages,
are counted first, one row a task and context. What remains are contexts that share their anchor with different ones:

1. tasks cut their suffixes and sort them into runs, front-coded, one for each key range;
2. the runs of a range meet in one task, which merges them by a loser tree that never looks at known common prefixes and
   so gets the common-prefix lengths of neighbours for nothing;
3. a string that starts o bytes before its anchor repeats if two suffixes of the range share 400 - o bytes and what stands
   before them shares o bytes: both are intervals of sorted arrays, read off the prefix lengths level by level.

Anchors with more than ``CROWD`` different contexts would fill one task; their windows are hashed and grouped instead, which
combines before the shuffle and gives the same result.

Defined results: matches never cross documents; a null text is empty bytes and stays null; exact repeats of a row lose
their repeated bytes in every copy; the text column comes back as binary, for cuts may fall inside a character; other
columns pass through, except that columns called n_bytes, n_removed or n_spans are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourwatt.llm import context_tables as ct
from hourwatt.llm.scratch import stored, without
from hourwatt.llm.suffix_merge import common_prefix, decoded, front_coded, merged
from hourwatt.llm.windows import BYTE_CODES, MULTIPLIERS, Rolling, batches_of, contexts, covered

WINDOW = 400
PIECE = 32
BATCH_BYTES = 2 << 20
RANGE_ROWS = 20_000
RUN_ROWS = 50_000
CROWD = 20_000
KEY_BYTES = 7


def _contexts(source: DataFrame, window: int, piece: int) -> DataFrame:
    names = ["first", "count", "lead", "anchor", "context"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column("text").to_pylist()]
            for part in batches_of([len(t) for t in texts], BATCH_BYTES):
                own = texts[part]
                codes = BYTE_CODES[np.frombuffer(b"".join(own), dtype=np.uint8)]
                bounds = np.concatenate([[0], np.cumsum([len(t) for t in own])])
                found = contexts(Rolling(codes, MULTIPLIERS[0]), bounds, window, piece)
                if not len(found.first):
                    continue
                doc = np.searchsorted(bounds, found.first, side="right") - 1
                cols = [(found.first - bounds[doc]).astype(np.int32), found.count.astype(np.int32), (found.place - found.first).astype(np.int32), found.anchor.view(np.int64), found.context.view(np.int64)]
                rows = pa.array(doc + part.start)
                yield pa.RecordBatch.from_arrays([batch.column("k1").take(rows), batch.column("k2").take(rows), *map(pa.array, cols)], names=["k1", "k2", *names])

    return source.mapInArrow(find, f"k1 {source.schema['k1'].dataType.simpleString()}, k2 long, first int, count int, lead int, anchor long, context long")


def _stretches(source: DataFrame, shared: DataFrame, window: int) -> DataFrame:
    """What stands after (``right``) and, turned round, before (``left``) each context's anchor; window hashes for crowded ones."""
    asked = shared.groupBy("k1", "k2").agg(F.collect_list(F.struct("first", "count", "lead", "anchor", "context", "n", (F.col("kinds") > CROWD).alias("crowded"))).alias("asked"))
    held = source.alias("s").join(asked.alias("a"), F.col("s.k1").eqNullSafe(F.col("a.k1")) & (F.col("s.k2") == F.col("a.k2"))).select("s.text", "a.asked")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, asked in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for a in asked:
                    at, stop = a["first"] + a["lead"], a["first"] + a["count"] - 1 + window
                    row = {"anchor": a["anchor"], "context": a["context"], "n": a["n"], "lead": a["lead"], "count": a["count"], "right": None, "left": None, "hashes": None}
                    if a["crowded"]:
                        codes = BYTE_CODES[np.frombuffer(text[a["first"] : stop], dtype=np.uint8)]
                        row["hashes"] = Rolling(codes, MULTIPLIERS[1]).every(window).view(np.int64)
                    else:
                        row |= {"right": text[at:stop], "left": text[a["first"] : at][::-1]}
                    rows.append(row)
                if len(rows) > 5000:
                    yield pa.RecordBatch.from_pylist(rows, schema=fields)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=fields)

    fields = pa.schema([("anchor", pa.int64()), ("context", pa.int64()), ("n", pa.int64()), ("lead", pa.int32()), ("count", pa.int32()), ("right", pa.binary()), ("left", pa.binary()), ("hashes", pa.list_(pa.int64()))])
    return held.mapInArrow(cut, "anchor long, context long, n long, lead int, count int, right binary, left binary, hashes array<long>")


def _runs(stretches: DataFrame, splitters: list[int]) -> DataFrame:
    """Sorted front-coded runs, one for each task, flush and key range."""
    borders = np.array(splitters, dtype=np.int64)
    facts = ["anchor", "context", "n", "lead", "count"]

    def flush(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("right", kind="stable")
        out = []
        for target, own in frame.groupby(np.searchsorted(borders, frame["key"], side="right")):
            lefts = own["left"].tolist()
            out.append({
                "target": int(target), "rights": front_coded(own["right"].tolist()), "lefts": b"".join(lefts), "sizes": np.array([len(x) for x in lefts], dtype=np.int32).tobytes(),
                "facts": own[facts].to_numpy(np.int64).tobytes(),
            })
        return pd.DataFrame(out)

    def sort(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size >= RUN_ROWS:
                yield flush(pd.concat(held, ignore_index=True))
                held, size = [], 0
        if size:
            yield flush(pd.concat(held, ignore_index=True))

    return stretches.mapInPandas(sort, "target int, rights binary, lefts binary, sizes binary, facts binary")


def _matched(right_shared: np.ndarray, lefts: list[bytes], lead: np.ndarray, count: np.ndarray, window: int) -> np.ndarray:
    """(suffix, bytes before the anchor) of the strings that stand twice, in arrays sorted by suffix."""
    n = len(lefts)
    order = np.array(sorted(range(n), key=lefts.__getitem__))
    left_shared = np.zeros(n, dtype=np.int64)
    for i in range(1, n):
        left_shared[i] = common_prefix(lefts[order[i - 1]], lefts[order[i]], 0)
    found, left_class = [], np.empty(n, dtype=np.int64)
    for before in range(int(lead.max(initial=0)), int((lead - count + 1).min(initial=0)) - 1, -1):
        open_to = np.flatnonzero((before <= lead) & (before > lead - count))
        if len(open_to) < 2:
            continue
        left_class[order] = np.cumsum(left_shared < before)
        both = (np.cumsum(right_shared < window - before)[open_to] << 32) | left_class[open_to]
        ranked = np.argsort(both, kind="stable")
        equal = both[ranked][1:] == both[ranked][:-1]
        twice = np.zeros(len(open_to), dtype=bool)
        twice[ranked[1:][equal]] = True
        twice[ranked[:-1][equal]] = True
        hit = open_to[twice]
        found.append(np.stack([hit, np.full(len(hit), before)], axis=1))
    return np.concatenate(found) if found else np.empty((0, 2), np.int64)


def _merge_range(window: int):
    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        runs = [decoded(x) for x in frame["rights"]]
        lefts, facts = [], []
        for raw, sizes, own in zip(frame["lefts"], frame["sizes"], frame["facts"]):
            ends = np.cumsum(np.frombuffer(sizes, dtype=np.int32)).tolist()
            lefts.append([raw[a:b] for a, b in zip([0, *ends], ends)])
            facts.append(np.frombuffer(own, dtype=np.int64).reshape(-1, 5))
        order, shared = merged(runs)
        rows = np.array([facts[r][i] for r, i in order])
        before = _matched(np.array(shared), [lefts[r][i] for r, i in order], rows[:, 3], rows[:, 4], window)
        hit = before[rows[before[:, 0], 2] == 1]
        places = np.stack([hit[:, 0], rows[hit[:, 0], 3] - hit[:, 1]], axis=1)
        places = places[np.lexsort((places[:, 1], places[:, 0]))]
        new = np.ones(len(places), dtype=bool)
        new[1:] = (places[1:, 0] != places[:-1, 0]) | (places[1:, 1] != places[:-1, 1] + 1)
        heads = np.flatnonzero(new)
        counts = np.diff(np.concatenate([heads, [len(places)]]))
        out = pd.DataFrame({"row": places[heads, 0], "place": places[heads, 1], "count": counts})
        return pd.DataFrame({"anchor": rows[out["row"], 0] if len(out) else [], "context": rows[out["row"], 1] if len(out) else [], "place": out["place"], "count": out["count"]}).astype({"anchor": "int64", "context": "int64"})

    return merge


def remove_repeated_strings(docs: DataFrame, text: str = "text", doc: str = "doc_id", window: int = WINDOW, piece: int = PIECE) -> DataFrame:
    """``docs`` with ``text`` as its kept bytes, plus ``n_bytes``, ``n_removed`` and ``n_spans``."""
    docs = without(docs, "n_bytes", "n_removed", "n_spans")
    source = docs.select(*ct.document_key(doc, text), F.col(f"`{text}`").cast("binary").alias("text"))
    found = stored(_contexts(source, window, piece), "suffix-contexts")
    place = F.min_by(F.struct("k1", "k2", "first", "count", "lead"), F.struct("k2", "first")).alias("at")
    counted = stored(ct.counted(found, place), "distinct-contexts")
    shared = counted.where("kinds > 1").select("anchor", "context", "n", "kinds", "at.*")
    stretches = stored(_stretches(source, shared, window), "stretches")
    key = F.conv(F.hex(F.rpad(F.substring("right", 1, KEY_BYTES), F.lit(KEY_BYTES), F.lit(b"\0"))), 16, 10).cast("long")
    suffixes = stretches.where("right is not null").withColumn("key", key)
    ranges = -(-suffixes.count() // RANGE_ROWS)
    shares = [i / ranges for i in range(1, ranges)]
    splitters = suffixes.agg(F.percentile_approx("key", shares, 10_000)).first()[0] if shares else []
    runs = _runs(suffixes, sorted(set(splitters or [])))
    by_order = runs.groupBy("target").applyInPandas(_merge_range(window), "anchor long, context long, place int, count int")
    partial = by_order.groupBy(*ct.KEY).agg(F.collect_list(F.struct("place", "count")).alias("runs"))
    by_hash = ct.repeated_by_hash(stretches.where("hashes is not null"))
    runs_by_doc = ct.runs_by_document(found, counted, partial.unionByName(by_hash))
    return _cut(ct.with_runs(docs, doc, text, runs_by_doc), docs, text, window)


def _cut(joined: DataFrame, docs: DataFrame, text: str, window: int) -> DataFrame:
    kept_fields = [T.StructField(f.name, T.BinaryType()) if f.name == text else f for f in docs.schema.fields]
    schema = T.StructType([*kept_fields, *[T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")]])
    place, width, names = docs.columns.index(text), len(docs.columns), schema.names

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, facts = [], []
            for t, starts, counts in zip(batch.column(place).to_pylist(), batch.column("__start").to_pylist(), batch.column("__count").to_pylist()):
                data, gone, spans = (t or "").encode(), 0, 0
                size = len(data)
                if starts:
                    mask = covered(size, starts, counts, window)
                    gone, spans = int(mask.sum()), int(np.count_nonzero(np.diff(np.concatenate([[False], mask]).astype(np.int8)) == 1))
                    data = np.frombuffer(data, dtype=np.uint8)[~mask].tobytes()
                kept.append(None if t is None else data)
                facts.append((size, gone, spans))
            columns = list(batch.columns[:width])
            columns[place] = pa.array(kept, pa.binary())
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array([f[i] for f in facts], pa.int64()) for i in range(3)]], names=names)

    return joined.mapInArrow(cut, schema)
