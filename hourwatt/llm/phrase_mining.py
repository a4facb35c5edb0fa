"""Phrases whose words come together more often than their parts explain, counted over a prefix-free parse.

1. Every text becomes words and piece ends (one sign for any run of separators), with ``OVERLAP`` piece ends behind the
   last one. A window of ``OVERLAP`` neighbours whose hash is divisible by ``PERIOD`` triggers a cut: the chunk before it
   ends with the window and the next one begins with it. Cuts depend on content only, so equal passages fall into equal
   chunks wherever they stand, and no chunk is the beginning of another. Chunks with their numbers of occurrences are the
   dictionary; a passage copied to a third of all documents is one entry, counted before any shuffle.
2. Phrases are counted inside the distinct chunks, weighted by the chunks' numbers. A phrase belongs to the chunk in
   which it begins before the closing window; as a phrase is at most one word longer than the window, it ends in the
   same chunk, and the overlap is counted once.
3. A phrase cannot be frequent unless its parts are, so words are counted first, pairs only of frequent words, longer
   phrases only where all neighbouring pairs are frequent. What is frequent travels as a bitmap of hashes of at most
   ``BITMAP_BITS`` bits; a bit set by another phrase only lets more through to the exact count, and loses nothing.
4. Scores, containment and ranks are joins, aggregations and a window over the frequent phrases alone.

Defined results: a null language is ``und``; null and empty texts and pieces without a word have no phrases; a text of
any length is parsed as a whole; repeated rows count as often as they stand there; ties are settled by the order of
score, count and phrase; an empty table has no phrases; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from functools import cached_property, partial
from collections.abc import Iterator, Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hourwatt.llm.scratch import stored

LONGEST = 4
OVERLAP = LONGEST - 1
PERIOD = 48
SLAB_WORDS = 3 << 18
RANK_SHARES = 64
BITMAP_BITS = 1 << 29
SLICE_BITS = 1 << 19
END = b"."
# A to Z become lower case, separators of pieces line ends.
_UPPER, _ENDS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b".,;:!?\x0A\x0B\x0C\x0D"
_PLAIN = bytes.maketrans(_UPPER + _ENDS, _UPPER.lower() + b"\n" * len(_ENDS))
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


def words_of(text: str) -> list[bytes]:
    """Words in UTF-8, A to Z in lower case, with ``END`` for every run of separators between two words."""
    pieces = text.encode().translate(_PLAIN).split(b"\n")
    return b" . ".join([p for p in pieces if p.strip()]).split()


def chunks_of(words: list[bytes]) -> Iterator[bytes]:
    """The chunks of one text: each closes with the window that opens the next, or with ends of pieces."""
    if not words:
        return
    closed = words + [END] * OVERLAP
    h = _mixed(np.fromiter(map(zlib.crc32, closed), np.uint64, len(closed)) + _M1)
    window = sum((h[i : len(words) + i] * m for i, m in zip(range(OVERLAP), (_M1, _M2, _M3), strict=True)), np.uint64(0))
    cuts = np.flatnonzero(_mixed(window) % np.uint64(PERIOD) == 0).tolist()
    begin = 0
    for cut in [*(c for c in cuts if c), len(words)]:
        yield b" ".join(closed[begin : cut + OVERLAP])
        begin = cut


_PARSED = "lang string, chunk string, times long"


def parse(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The dictionary of distinct chunks per language with their numbers of occurrences."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        size = 0

        def settled() -> pa.RecordBatch:
            langs, chunks = zip(*found, strict=True)
            out = pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(chunks, pa.binary()).cast(pa.string()), pa.array(found.values(), pa.int64())], ["lang", "chunk", "times"])
            found.clear()
            return out

        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = words_of(body.as_py())
                found.update((name, c) for c in chunks_of(words))
                size += len(words)
                if size >= SLAB_WORDS:
                    if found:
                        yield settled()
                    size = 0
        if found:
            yield settled()

    body = F.col(f"`{text}`")
    whole = docs.where(body.isNotNull()).select(F.coalesce(F.col(f"`{lang}`"), F.lit("und")).alias("lang"), body.alias("text"))
    return whole.mapInArrow(cut, _PARSED).groupBy("lang", "chunk").agg(F.sum("times").alias("times"))


_COUNTED = "lang string, phrase string, n long"


def phrase_hash(words: list[np.ndarray], lang: str) -> np.ndarray:
    """Hash of phrases from the hashes of their words, column by column."""
    out = np.full(len(words[0]), zlib.crc32(lang.encode()), np.uint64)
    for column in words:
        out = _mixed((out + column) * _M1)
    return out


def word_hashes(words: Sequence[bytes]) -> np.ndarray:
    low = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    high = np.fromiter(map(zlib.crc32, words, repeat(0x5BD1E995)), np.uint64, len(words))
    return _mixed(high << np.uint64(32) | low)


def _held(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes % np.uint64(len(bits) * 8)
    return bits[(at >> np.uint64(3)).astype(np.intp)] >> (at & np.uint64(7)).astype(np.uint8) & 1 > 0


def _weighed(numbers: np.ndarray, times: np.ndarray, size: int) -> np.ndarray:
    """Sums of ``times`` by number, exact where a double would not be."""
    if len(times) and int(times.max()) * len(times) < 1 << 53:
        return np.bincount(numbers, times, size).astype(np.int64)
    out = np.zeros(size, np.int64)
    np.add.at(out, numbers, times)
    return out


class _Rows:
    """Counted phrases of one language in a slab, and how to spell them."""

    def __init__(self, lang: str, chunks: pa.Array, times: np.ndarray) -> None:
        self.lang = lang
        split = pc.split_pattern(chunks, " ")
        tokens = split.flatten().dictionary_encode()
        self.words = tokens.dictionary
        self.ids = tokens.indices.to_numpy().astype(np.int64)
        sizes = pc.list_value_length(split).to_numpy().astype(np.int64)
        self.times = np.repeat(times, sizes)
        self.word = self.ids != pc.index(self.words, END.decode()).as_py()
        # A phrase belongs to the chunk in which it begins before the closing window.
        self.begins = self.word.copy()
        for back in range(1, OVERLAP + 1):
            self.begins[np.cumsum(sizes) - back] = False

    @cached_property
    def hashes(self) -> np.ndarray:
        return word_hashes(self.words.cast(pa.binary()).to_numpy(zero_copy_only=False))

    def _at(self, k: int, of: np.ndarray) -> np.ndarray:
        """``of`` at the k-th word after each place; the last places begin nothing."""
        return np.concatenate((of[k:], np.zeros(k, of.dtype)))

    def pairs(self, bits: np.ndarray, size: int) -> np.ndarray:
        """Places whose first ``size`` words are all held by the bitmap."""
        if size == 1:
            return self.word & _held(bits, phrase_hash([self.hashes], self.lang))[self.ids]
        both = self.word & self._at(1, self.word)
        places = np.flatnonzero(both)
        both[places] = _held(bits, phrase_hash([self.hashes[self.ids[places]], self.hashes[self.ids[places + 1]]], self.lang))
        return both

    def counted(self, sizes: tuple[int, ...], bits: np.ndarray | None) -> Iterator[tuple[pa.Array, np.ndarray]]:
        """Phrases of these neighbouring lengths; a phrase of more words is keyed by its beginning's number and a word."""
        if sizes[0] == 1:
            places = np.flatnonzero(self.begins)
            weights = _weighed(self.ids[places], self.times[places], len(self.words))
            yield pa.array([""]), np.array([self.times[places].sum()])
            held = np.flatnonzero(weights)
            yield self.words.take(pa.array(held)), weights[held]
            return
        fits = self.pairs(bits, sizes[0] - 1)
        allowed = self.begins.copy()
        for k in range(2):
            allowed &= self._at(k, fits)
        places = np.flatnonzero(allowed)
        numbers, spelt = self.ids[places], self.words
        for size in range(2, sizes[-1] + 1):
            if size > sizes[0]:
                longer = self._at(size - sizes[0] + 1, fits)[places]
                numbers, places = numbers[longer], places[longer]
            keys = pa.array(numbers << 32 | self.ids[places + size - 1]).dictionary_encode()
            numbers, distinct = keys.indices.to_numpy(), keys.dictionary.to_numpy()
            spelt = pc.binary_join_element_wise(spelt.take(pa.array(distinct >> 32)), self.words.take(pa.array(distinct & 0xFFFFFFFF)), " ")
            if size >= sizes[0]:
                yield spelt, _weighed(numbers, self.times[places], len(distinct))
            numbers = numbers.astype(np.int64)


def _phrases(batches: Iterator[pa.RecordBatch], sizes: tuple[int, ...], bits) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    size = 0
    bitmap = None if bits is None else bits.value

    def settled() -> Iterator[pa.RecordBatch]:
        langs, chunks, times = (pa.concat_arrays([b.column(i) for b in held]) for i in range(3))
        held.clear()
        names = langs.dictionary_encode()
        order = np.argsort(names.indices.to_numpy(), kind="stable")
        chunks, times = chunks.take(pa.array(order)), times.to_numpy()[order]
        stops = np.cumsum(np.bincount(names.indices.to_numpy())).tolist()
        for lang, start, stop in zip(names.dictionary.to_pylist(), [0, *stops], stops):
            for phrases, n in _Rows(lang, chunks.slice(start, stop - start), times[start:stop]).counted(sizes, bitmap):
                if len(n):
                    yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(n)), phrases, pa.array(n)], ["lang", "phrase", "n"])

    for batch in batches:
        ends = np.cumsum(pc.count_substring(batch.column(1), " ").to_numpy().astype(np.int64) + 1)
        begin = done = 0
        while begin < batch.num_rows:
            stop = min(int(np.searchsorted(ends, done + SLAB_WORDS - size)) + 1, batch.num_rows)
            held.append(batch.slice(begin, stop - begin))
            size += int(ends[stop - 1]) - done
            begin, done = stop, int(ends[stop - 1])
            if size >= SLAB_WORDS:
                yield from settled()
                size = 0
    if held:
        yield from settled()


def count_phrases(parsed: DataFrame, sizes: tuple[int, ...], least: int, bits=None) -> DataFrame:
    """Phrases of the given lengths with their numbers; for words also a row with an empty phrase, the number of words."""
    partial_counts = parsed.select("lang", "chunk", "times").mapInArrow(partial(_phrases, sizes=sizes, bits=bits), _COUNTED)
    return partial_counts.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | (F.col("phrase") == ""))


def bitmap(frequent: DataFrame):
    """Broadcast bitmap of the phrases' hashes: sixteen bits for each, ``BITMAP_BITS`` at most."""
    spark = frequent.sparkSession
    n = frequent.count()
    size = min(BITMAP_BITS, max(SLICE_BITS, 1 << (16 * n).bit_length()))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_lang = defaultdict(list)
            for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by_lang[lang].append(phrase.encode().split(b" "))
            for lang, phrases in by_lang.items():
                at = phrase_hash([word_hashes(list(column)) for column in zip(*phrases)], lang) % np.uint64(size)
                yield pa.RecordBatch.from_arrays([pa.array((at // np.uint64(SLICE_BITS)).astype(np.int32)), pa.array((at % np.uint64(SLICE_BITS)).astype(np.int32))], ["slice", "bit"])

    def merged(rows):
        bits = np.zeros(SLICE_BITS, bool)
        bits[rows["bit"].to_numpy()] = True
        return pa.table({"slice": [rows["slice"][0].as_py()], "bits": [np.packbits(bits, bitorder="little").tobytes()]}, schema=pa.schema([("slice", pa.int32()), ("bits", pa.binary())]))

    rows = frequent.where("phrase != ''").select("lang", "phrase").mapInArrow(places, "slice int, bit int").distinct()
    out = np.zeros(size // 8, np.uint8)
    width = SLICE_BITS // 8
    # Slices of fixed size, 64 MB in all at most.
    for row in rows.groupBy("slice").applyInArrow(merged, "slice int, bits binary").toLocalIterator():
        out[row.slice * width : (row.slice + 1) * width] = np.frombuffer(row.bits, np.uint8)
    return spark.sparkContext.broadcast(out)


def frequent_phrases(docs: DataFrame, least: int, text: str = "text", lang: str = "lang") -> DataFrame:
    """All phrases of 1 to ``LONGEST`` words that occur at least ``least`` times: lang, phrase, n; words' sum at phrase ''."""
    parsed = stored(parse(docs, text, lang), "phrases-parse")
    words = stored(count_phrases(parsed, (1,), least), "phrases-words")
    pairs = stored(count_phrases(parsed, (2,), least, bitmap(words)), "phrases-pairs")
    longer = stored(count_phrases(parsed, tuple(range(3, LONGEST + 1)), least, bitmap(pairs)), "phrases-longer")
    return words.unionByName(pairs).unionByName(longer)


def collocations(docs: DataFrame, least: int = 30, covered: int = 80, top: int = 2000, text: str = "text", lang: str = "lang") -> DataFrame:
    """The ``top`` phrases of each language by score: lang, rank, phrase, a, l, r, n, score.

    A phrase goes when a longer one that contains it has at least ``covered`` percent of its count.
    """
    counted = frequent_phrases(docs, least, text, lang)
    total = counted.where("phrase = ''").select("lang", F.col("n").alias("total"))
    known = counted.where("phrase != ''")
    phrases = known.withColumn("words", F.split("phrase", " ", -1)).where(F.size("words") > 1).withColumnRenamed("n", "a")

    def part(begin, size):
        return F.array_join(F.slice("words", begin, size), " ")

    cut = phrases.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    halves = cut.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("head"), part(F.col("k") + 1, F.size("words") - F.col("k")).alias("tail"))
    left = known.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l"))
    right = known.select("lang", F.col("phrase").alias("tail"), F.col("n").alias("r"))
    scored = halves.join(left, ["lang", "head"]).join(right, ["lang", "tail"]).withColumn("score", F.expr("(cast(2000000 as decimal(10,0)) * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))"))
    lowest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = phrases.where(F.size("words") > 2).select("lang", "a", "words", F.explode(F.sequence(F.lit(2), F.size("words") - 1)).alias("size"))
    inner = inner.select("lang", "a", "words", "size", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("size") + 1)).alias("begin"))
    around = inner.select("lang", part(F.col("begin"), F.col("size")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = lowest.join(around, ["lang", "phrase"], "left").where("longer is null or cast(longer as decimal(19,0)) * 100 < cast(a as decimal(19,0)) * %d" % covered)
    rows = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    # Ranked in shares first, so that one task never meets more than the shares' best of a language.
    shares = Window.partitionBy("lang", "share").orderBy(F.desc("score"), F.desc("a"), "phrase")
    rows = rows.withColumn("share", F.pmod(F.hash("phrase"), F.lit(RANK_SHARES)))
    rows = rows.withColumn("rank", F.row_number().over(shares)).where(F.col("rank") <= top).drop("rank", "share")
    best = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
