"""BPE encoding of whole texts, long ones as a tree of halves, and decoding.

A text of more than ``PIECE`` characters is halved until its leaves are short enough. Leaves are rows of their own and
are encoded in parallel, so one very long text does not hold one task. Going up the tree, a window around each join
is encoded again and grown until, on both sides, two neighbouring tokens agree with the halves in id and place; from
there on the halves' tokens hold. That is exact: whether tokens may stand side by side depends on the two alone, and
every pair of the result stands side by side in one of the three encodings. A window that covers both halves ends the
growth in any case. Where the kept edges do not agree (blanks that give no tokens, a long run of one sign at the join), the
words that meet at the join are encoded again from the blank before to the blank after it; every kept edge has one.

Words that white space bounds never influence each other, so their ids are kept in a bounded table per worker.

Defined results: a null or empty text has no ids and decodes to an empty text; special tokens spelt out in a text are
those tokens, as the library reads them; exact repeats of a row give equal rows; other columns pass through, except one
called as the output is. The vocabulary file's path is a parameter and has to exist on every executor.
"""

from __future__ import annotations

import array
import functools
import json
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourwatt.llm.scratch import without

PIECE = 8192
TABLE_WORDS = 60_000
LONG_WORD = 256
WINDOW = 64
EDGE = 1024
BATCH_TEXTS = 256
# The rules by which the vocabulary normalises and splits, and what they come to in the first 256 code
# points once the text is in lower case.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
_LETTERS, _DIGITS, _SPACES = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
LATIN_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^{_SPACES}{_LETTERS}{_DIGITS}]+")
PRINTABLE = re.compile("[!-~]+")
# White space for the language's split() that the vocabulary's patterns do not count as such.
ODD_SPACE = re.compile("[\x1c-\x1f]")


@functools.lru_cache(maxsize=2)
def tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


@functools.lru_cache(maxsize=1)
def _byte_signs() -> list[str]:
    """The sign that stands for each byte in a byte-level vocabulary: itself where printable, else one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class _Recent(dict):
    """A table whose entries fall out when they have not been met for a while."""

    def __init__(self):
        super().__init__()
        self.before: dict[str, bytes] = {}

    def missing(self, wanted: set[str]) -> list[str]:
        """Those of ``wanted`` that have to be made; the others are in the table afterwards."""
        if len(self) > TABLE_WORDS:
            self.before = dict(self)
            self.clear()
        wanted.difference_update(self)
        fresh = []
        for word in wanted:
            known = self.before.get(word)
            if known is None:
                fresh.append(word)
            else:
                self[word] = known
        return fresh

    def forget_long(self, fresh: list[str]) -> None:
        for word in fresh:
            if len(word) > LONG_WORD:
                del self[word]


class WordTable:
    """Encodes texts word by word and keeps the ids of recent words.

    Texts of the first 256 code points need no normalising but lower case; they are split as the vocabulary's pattern
    splits them, and its model encodes the words. Other texts are split at white space, and the library does the rest.
    """

    def __init__(self, path: str):
        coder = tokenizer(path)
        self.encode_batch, self.model = coder.encode_batch_fast, coder.model
        parts = [(coder.normalizer, NORMALIZER), (coder.pre_tokenizer, PRE_TOKENIZER)]
        self.known_rules = all(part is not None and json.loads(part.__getstate__()) == rule for part, rule in parts)
        self.words, self.chunks = _Recent(), _Recent()

    def _plain(self, text: str) -> bool:
        if not self.known_rules or "<|" in text:
            return False
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return True

    def encode(self, texts: list[str]) -> list[bytes]:
        plain = [self._plain(t) for t in texts]
        split = [LATIN_WORDS.findall(t.lower()) if p else re.split("[ \n]+", t) if ODD_SPACE.search(t) else t.split() for t, p in zip(texts, plain)]
        words = self.words.missing(set().union(*[x for x, p in zip(split, plain) if p]))
        signs, model = _byte_signs(), self.model.tokenize
        for word in words:
            written = word if PRINTABLE.fullmatch(word) else "".join([signs[b] for b in word.encode()])
            self.words[word] = array.array("i", [t.id for t in model(written)]).tobytes()
        chunks = self.chunks.missing(set().union(*[x for x, p in zip(split, plain) if not p]))
        for chunk, found in zip(chunks, self.encode_batch(chunks, add_special_tokens=False)):
            self.chunks[chunk] = array.array("i", found.ids).tobytes()
        out = [b"".join(map((self.words if p else self.chunks).__getitem__, x)) for x, p in zip(split, plain)]
        self.words.forget_long(words)
        self.chunks.forget_long(chunks)
        return out


@functools.lru_cache(maxsize=2)
def _table(path: str) -> WordTable:
    return WordTable(path)


def _joins_back(char: str) -> bool:
    """Whether a character may merge with the one before it when texts are normalised."""
    import unicodedata

    return unicodedata.category(char)[0] == "M" or "ᄀ" <= char <= "ᇿ" or "ힰ" <= char <= "퟿" or char > "\U00016d60" and char < "\U00016d6b"


def leaves(text: str, piece: int = PIECE) -> list[str]:
    """Cut into halves, and these again, down to pieces of at most ``piece``; never before a combining character."""
    parts = 1
    while len(text) > parts * piece:
        parts *= 2
    cuts = [0]
    for i in range(1, parts):
        cut = max(cuts[-1], len(text) * i // parts)
        while cut < len(text) and _joins_back(text[cut]):
            cut += 1
        cuts.append(cut)
    return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)])]


class Node(NamedTuple):
    """A stretch of text with its ids. Of long ones only the edges are kept where they are enough to join them."""

    start: str
    stop: str
    whole: bool  # start is the whole text, and so is stop
    ids: np.ndarray


def trimmed(text: str, ids: np.ndarray) -> Node:
    """Keep ``EDGE`` characters on each side, cut at white space; a text without white space there is kept whole."""
    if len(text) > 4 * EDGE:
        head = [p for p in (text.find(" ", WINDOW, EDGE), text.find("\n", WINDOW, EDGE)) if p >= 0]
        tail = max(text.rfind(" ", len(text) - EDGE, len(text) - WINDOW), text.rfind("\n", len(text) - EDGE, len(text) - WINDOW))
        if head and tail >= 0:
            return Node(text[:EDGE], text[len(text) - EDGE :], False, ids)
    return Node(text, text, True, ids)


def _edge(coder, text: str, last: bool) -> list[tuple[int, int, int]]:
    """(start, end, id) of the tokens at one end of a text, from a word boundary at least WINDOW characters in."""
    if last:
        cut = max(text.rfind(" ", 0, max(0, len(text) - WINDOW)), text.rfind("\n", 0, max(0, len(text) - WINDOW))) + 1
        found = coder.encode(text[cut:], add_special_tokens=False)
        return [(a + cut, b + cut, i) for (a, b), i in zip(found.offsets, found.ids)]
    ends = [p for p in (text.find(" ", WINDOW), text.find("\n", WINDOW)) if p >= 0]
    found = coder.encode(text[: min(ends, default=len(text))], add_special_tokens=False)
    return [(a, b, i) for (a, b), i in zip(found.offsets, found.ids)]


def joined(coder, left: Node, right: Node) -> Node:
    """The node of left's and right's texts in a row."""
    before, after = left.stop, right.start
    cut = len(before)

    def made(ids: np.ndarray) -> Node:
        if left.whole and right.whole:
            return trimmed(before + after, ids)
        # A whole side is shorter than an edge needs, or unsplit; with it the kept edge grows.
        return Node(before + after if left.whole else left.start, before + after if right.whole else right.stop, False, ids)

    tail, head = _edge(coder, before, True), _edge(coder, after, False)
    tail_place = {t: len(left.ids) - len(tail) + k for k, t in enumerate(tail)}
    head_place = {(a + cut, b + cut, i): k for k, (a, b, i) in enumerate(head)}
    reach = WINDOW
    while True:
        start, stop = max(0, cut - reach), min(len(after), reach)
        found = coder.encode(before[start:] + after[:stop], add_special_tokens=False)
        tokens = [(a + start, b + start, i) for (a, b), i in zip(found.offsets, found.ids)]
        inner = lambda k: k + 1 >= len(tokens) or tokens[k + 1][0] >= tokens[k][1]
        begin = (0, 0) if start == 0 and left.whole else None
        end = (len(tokens), len(right.ids)) if stop == len(after) and right.whole else None
        if begin is None:
            for k in range(2, len(tokens)):
                here = tail_place.get(tokens[k])
                if here is not None and tail_place.get(tokens[k - 1]) == here - 1 and tokens[k][1] <= cut and inner(k):
                    begin = (k + 1, here + 1)
                    break
        if end is None:
            for k in range(len(tokens) - 3, -1, -1):
                here = head_place.get(tokens[k])
                if here is not None and head_place.get(tokens[k + 1]) == here + 1 and tokens[k][0] >= cut and (k == 0 or inner(k - 1)):
                    end = (k, here)
                    break
        if begin is not None and end is not None:
            return made(np.concatenate([left.ids[: begin[1]], np.array(found.ids[begin[0] : end[0]], dtype=np.int32), right.ids[end[1] :]]))
        if start == 0 and stop == len(after):
            break
        reach *= 2
    # Words that blanks bound do not influence each other: only the one cut by the join, or none, is encoded again.
    first = max(before.rfind(" "), before.rfind("\n")) + 1
    last = min([p for p in (after.find(" "), after.find("\n")) if p >= 0], default=len(after))
    count = lambda text: len(coder.encode(text, add_special_tokens=False).ids)
    word = np.array(coder.encode(before[first:] + after[:last], add_special_tokens=False).ids, dtype=np.int32)
    return made(np.concatenate([left.ids[: len(left.ids) - count(before[first:])], word, right.ids[count(after[:last]) :]]))


def tree_encoded(coder, nodes: list[Node]) -> np.ndarray:
    """Join the encoded leaves of one text, neighbours first."""
    while len(nodes) > 1:
        nodes = [joined(coder, a, b) for a, b in zip(nodes[0::2], nodes[1::2])] + nodes[len(nodes) // 2 * 2 :]
    return nodes[0].ids


def _packed(ids: np.ndarray) -> bytes:
    """Two bytes an id where all fit, else four; the last byte tells."""
    small = ids.max(initial=0) < 1 << 16
    return ids.astype(np.uint16).tobytes() + b"\2" if small else ids.tobytes() + b"\4"


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw[:-1], dtype=np.uint16 if raw[-1] == 2 else np.int32).astype(np.int32)


def _lists(raw: list[bytes]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in raw])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(raw), dtype=np.int32)))


def encode(docs: DataFrame, path: str, text: str = "text", doc: str = "doc_id", out: str = "ids", piece: int = PIECE) -> DataFrame:
    """``docs`` with the text column replaced by ``out``, the ids of its whole text.

    Short texts are encoded where they are read. Only texts that are cut travel: as pieces, and then as ids with the
    edges of their pieces. A document's other columns go with its first piece.
    """
    docs = without(docs, *([] if out == text else [out]))
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text]
    keyed = docs.select(*rest, F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text"))
    schema = T.StructType([f for f in docs.schema.fields if f.name != text] + [T.StructField(out, T.ArrayType(T.IntegerType()))])
    width, names = len(rest), schema.names

    def direct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_TEXTS):
                batch = whole.slice(at, BATCH_TEXTS)
                yield pa.RecordBatch.from_arrays([*batch.columns[:width], _lists(_table(path).encode(batch.column(width).to_pylist()))], names=names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_TEXTS):
                batch = whole.slice(at, BATCH_TEXTS)
                parts = [leaves(t, piece) for t in batch.column("text").to_pylist()]
                number = [k for own in parts for k in range(len(own))]
                row = pa.array([i for i, own in enumerate(parts) for _ in own])
                first = pa.array([i if k == 0 else None for i, own in enumerate(parts) for k in range(len(own))], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("k1").take(row), batch.column("k2").take(row), batch.column("row").take(first), pa.array(number, pa.int32()), pa.array([p for own in parts for p in own], pa.string())],
                    names=["k1", "k2", "row", "part", "piece"],
                )

    def encode_leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_TEXTS):
                batch = whole.slice(at, BATCH_TEXTS)
                texts = batch.column("piece").to_pylist()
                nodes = [trimmed(t, np.frombuffer(x, dtype=np.int32)) for t, x in zip(texts, _table(path).encode(texts))]
                kept = [pa.array([n.start for n in nodes], pa.string()), pa.array([None if n.whole else n.stop for n in nodes], pa.string()), pa.array([_packed(n.ids) for n in nodes], pa.binary())]
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], *kept], names=["k1", "k2", "row", "part", "start", "stop", "ids"])

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(path)
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_TEXTS):
                batch = whole.slice(at, BATCH_TEXTS)
                made = []
                for pieces in batch.column("pieces").to_pylist():
                    own = {p["part"]: p for p in pieces}
                    nodes = [Node(p["start"], p["start"] if p["stop"] is None else p["stop"], p["stop"] is None, _unpacked(p["ids"])) for _, p in sorted(own.items())]
                    made.append(tree_encoded(coder, nodes).tobytes())
                yield pa.RecordBatch.from_arrays([batch.column("rows"), _lists(made)], names=["rows", "ids"])

    long = keyed.where(F.length("__text") > piece).select(
        F.col(f"`{doc}`").cast("string").alias("k1"), F.xxhash64("__text").alias("k2"), F.struct(*rest).alias("row"), F.col("__text").alias("text")
    )
    # Only first pieces have a row, so the column takes nulls.
    named = [T.StructField(f.name, f.dataType, True) for f in long.schema.fields[:3]]
    pieces = long.mapInArrow(cut, T.StructType([*named, T.StructField("part", T.IntegerType()), T.StructField("piece", T.StringType())]))
    leaf_schema = T.StructType([*pieces.schema.fields[:4], *[T.StructField(n, T.StringType()) for n in ("start", "stop")], T.StructField("ids", T.BinaryType())])
    coded = pieces.repartition("k1", "k2", "part").mapInArrow(encode_leaf, leaf_schema)
    # collect_list leaves out nulls: the rows of first pieces alone stay.
    gathered = coded.groupBy("k1", "k2").agg(F.collect_list(F.struct("part", "start", "stop", "ids")).alias("pieces"), F.collect_list("row").alias("rows"))
    rows_schema = T.StructType([T.StructField("rows", T.ArrayType(long.schema["row"].dataType)), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    whole = gathered.select("pieces", "rows").mapInArrow(grow, rows_schema).select(F.explode("rows").alias("row"), "ids")
    back = whole.select(*[F.col("row")[f.name].alias(f.name) for f in schema.fields[:-1]], F.col("ids").alias(out))
    return keyed.where(F.length("__text") <= piece).mapInArrow(direct, schema).unionByName(back)


def decode(coded: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``coded`` with ``out``, the text that its ids stand for, special tokens included."""
    coded = without(coded, out)
    schema = T.StructType([*coded.schema.fields, T.StructField(out, T.StringType())])
    place, names = coded.columns.index(ids), schema.names

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(path)
        # Without a decoder of its own a vocabulary's tokens are joined by spaces.
        plain = coder.decoder is None
        tokens = np.empty(coder.get_vocab_size(with_added_tokens=True), dtype=object)
        for token, i in coder.get_vocab(with_added_tokens=True).items():
            tokens[i] = token
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_TEXTS):
                batch = whole.slice(at, BATCH_TEXTS)
                column = batch.column(place)
                sizes = column.value_lengths().fill_null(0).to_numpy()
                lists = np.split(column.flatten().to_numpy(), np.cumsum(sizes)[:-1])
                texts = [" ".join(tokens[x].tolist()) for x in lists] if plain else coder.decode_batch([x.tolist() for x in lists], skip_special_tokens=False)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=names)

    return coded.mapInArrow(read, schema)
