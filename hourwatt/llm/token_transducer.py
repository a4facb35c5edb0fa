"""Token counts by two finite transducers compiled from a byte-level vocabulary.

The first reads classes of code points (letter, digit, blank, apostrophe ...) and marks where words begin. It has eleven
states, so what a chunk of text does to the state is a map of eleven states onto eleven; all such maps are listed once
together with their products. All chunks of a slab are read in lockstep without knowing the state they start in, their
maps are multiplied by a parallel prefix scan, which gives every chunk its first state, and a second lockstep reading
marks the words. Texts lie side by side in a slab, as the end of a text maps every state onto the first one.

The second reads the bytes of a word. Reading a byte changes the number of tokens of the word read so far by an amount
that depends on the state and the byte only, and that amount stands on the transition; the sum over a word is its
count. A state is the set of vocabulary entries that might still be completed, each with the token before it and the
count there, relative to now. States are made when they are first met, as the whole machine is far larger than what
texts visit, and are dropped and made anew beyond ``MAX_STATES``. Whether two tokens may stand side by side is asked of
the vocabulary's own model.

A text of any length needs the memory of one slab: both states pass from one slab to the next.

Defined results: a null or empty text has 0 bytes and 0 tokens; a special token spelt out in a text is one token, as the
library reads it; rows are counted one by one, so repeated rows, ties and null ids change nothing; an empty table
gives an empty table; other columns pass through, except those that are called as the new ones. The vocabulary file's
path is a parameter and has to exist on every executor.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourwatt.llm.bpe_tree import tokenizer
from hourwatt.llm.scratch import without

SLAB = 1 << 20
CHUNK = 128
MAX_STATES = 300_000
MAX_PAIRS = 500_000
TABLE_WORDS = 400_000
LONG_WORD = 64
# Classes of code points. Some letters are told apart, as they may end a contraction.
CLASSES = ("letter", "stmd", "rv", "l", "e", "digit", "space", "blank", "apostrophe", "other", "end")
_C = {name: i for i, name in enumerate(CLASSES)}
# States: what has been read since the last word began. Blanks are told apart by number (one, more) and by whether the
# last one is a space, which may belong to the next word.
STATES = ("start", "letters", "digits", "others", "space", "blanks+space", "blank", "blanks", "'", "'r", "'l")
_S = {name: i for i, name in enumerate(STATES)}
HERE, ONE_BACK = 1, 2
# A byte changes a count by less than the longest vocabulary entry has bytes.
BIAS = 128


def _run(cls: str) -> str:
    """The state of a word that begins with a sign of this class."""
    if cls in ("letter", "stmd", "rv", "l", "e"):
        return "letters"
    return {"digit": "digits", "space": "space", "blank": "blank", "apostrophe": "'", "other": "others", "end": "start"}[cls]


def _move(state: str, cls: str) -> tuple[str, int]:
    """The next state, and whether a word begins at this sign (HERE) or at the one before (ONE_BACK)."""
    letter, blank = _run(cls) == "letters", cls in ("space", "blank")
    if cls == "end":
        return "start", HERE | (ONE_BACK if state in ("'r", "'l") else 0)
    if state == "start":
        return _run(cls), HERE
    if state == "'":
        if cls == "stmd":
            return "start", 0
        if cls in ("rv", "l"):
            return "'r" if cls == "rv" else "'l", 0
        return ("others", 0) if cls in ("apostrophe", "other") else (_run(cls), HERE)
    if state in ("'r", "'l"):
        if (state, cls) in (("'r", "e"), ("'l", "l")):
            return "start", 0
        return ("letters", ONE_BACK) if letter else (_run(cls), ONE_BACK | HERE)
    if state in ("letters", "digits", "others"):
        same = {"letters": letter, "digits": cls == "digit", "others": cls in ("apostrophe", "other")}[state]
        return (state, 0) if same else (_run(cls), HERE)
    if blank:
        return ("blanks+space" if cls == "space" else "blanks"), 0
    several = ONE_BACK if state in ("blanks+space", "blanks") else 0
    if state in ("space", "blanks+space"):
        return ("others" if cls == "apostrophe" else _run(cls)), several
    return _run(cls), several | HERE


@functools.lru_cache(maxsize=1)
def word_machine() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(next state, marks) by state and class, all state maps, their products with a class, and with each other."""
    moves = [[_move(s, c) for c in CLASSES] for s in STATES]
    follow = np.array([[_S[m[0]] for m in row] for row in moves], np.uint8)
    marks = np.array([[m[1] for m in row] for row in moves], np.uint8)
    number = {tuple(range(len(STATES))): 0}
    maps, right = list(number), []
    for known in maps:  # grows while it is read
        row = []
        for c in range(len(CLASSES)):
            reached = tuple(int(follow[s, c]) for s in known)
            if reached not in number:
                number[reached] = len(maps)
                maps.append(reached)
            row.append(number[reached])
        right.append(row)
    table = np.array(maps, np.uint8)
    product = np.array([[number[tuple(b[s] for s in a)] for b in maps] for a in maps], np.uint16)
    return follow, marks, table, np.array(right, np.uint16), product


def code_point_classes(path: str) -> bytes:
    """The class of every code point, asked of the vocabulary's own word splitter; compressed, a few kilobytes."""
    split = tokenizer(path).pre_tokenizer.pre_tokenize_str
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    out = np.full(0x110000, _C["other"], np.uint8)
    # In a row of all code points a word holds one class; a space may stand before it.
    for _, (start, stop) in split("".join(map(chr, points))):
        sign = chr(points[stop - 1])
        kinds = [k for k, before in (("letter", "a"), ("digit", "1"), ("other", "!")) if len(split(before + sign)) == 1]
        out[[c for c in points[start:stop]]] = _C[kinds[0] if kinds else "blank"]
    for signs, kind in (("stmd", "stmd"), ("rv", "rv"), ("l", "l"), ("e", "e"), (" ", "space"), ("'", "apostrophe")):
        out[[ord(s) for s in signs]] = _C[kind]
    return zlib.compress(out.tobytes(), 9)


@functools.lru_cache(maxsize=2)
def _classes(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), np.uint8)


def _lockstep(classes: np.ndarray) -> np.ndarray:
    """Classes as one row per place in a chunk and one column per chunk, filled up with ends."""
    chunks = -(-len(classes) // CHUNK)
    padded = np.full(chunks * CHUNK, _C["end"], np.uint8)
    padded[: len(classes)] = classes
    return np.ascontiguousarray(padded.reshape(chunks, CHUNK).T)


def chunk_maps(columns: np.ndarray) -> np.ndarray:
    """The number of each chunk's state map."""
    right = word_machine()[3].ravel()
    out = np.zeros(columns.shape[1], np.intp)
    for row in columns:
        out = right[out * len(CLASSES) + row]
        out = out.astype(np.intp)
    return out


def prefix_products(numbers: np.ndarray) -> np.ndarray:
    """The product of each map with all before it, in as many steps as the logarithm of their number."""
    product = word_machine()[4]
    out, reach = numbers.copy(), 1
    while reach < len(out):
        out[reach:] = product[out[:-reach], out[reach:]]
        reach *= 2
    return out


def word_starts(classes: np.ndarray, state: int = 0) -> tuple[np.ndarray, int]:
    """Where words begin, -1 for the sign before the first one, and the state after the last sign."""
    follow, marks, maps, right, _ = word_machine()
    columns = _lockstep(classes)
    before = prefix_products(chunk_maps(columns))
    now = np.concatenate(([state], maps[before[:-1], state])).astype(np.intp)
    flat, flat_marks, wide = follow.ravel().astype(np.intp), marks.ravel(), len(CLASSES)
    marked = np.empty_like(columns)
    for i, row in enumerate(columns):
        at = now * wide + row
        marked[i] = flat_marks[at]
        now = flat[at]
    marked = marked.T.ravel()[: len(classes)]
    begins = np.zeros(len(classes) + 1, bool)
    begins[1:] = (marked & HERE) > 0
    begins[:-1] |= (marked & ONE_BACK) > 0
    rest = classes[(len(classes) - 1) // CHUNK * CHUNK :]
    last = int(maps[before[-2], state]) if len(before) > 1 else state
    for c in rest.tolist():
        last = int(follow[last, c])
    return np.flatnonzero(begins) - 1, last


class TokenMachine(dict):
    """Counts of words by the second transducer; as a dictionary, those of words met lately."""

    FIRST = 0

    def __init__(self, path: str) -> None:
        super().__init__()
        self.model = tokenizer(path).model
        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        from hourwatt.llm.bpe_tree import _byte_signs

        byte_of = {sign: b for b, sign in enumerate(_byte_signs())}
        self.spelt = {i: sign for sign, i in vocabulary.items()}
        self.child: dict[int, int] = {}
        self.token: dict[int, int] = {}
        nodes = 1
        for signs, i in vocabulary.items():
            node = 0
            for sign in signs:
                at = node << 8 | byte_of[sign]
                if at not in self.child:
                    self.child[at] = nodes
                    nodes += 1
                node = self.child[at]
            self.token[node] = i
        self._forget()

    def _forget(self) -> None:
        self.states: list[tuple] = [((0, -1, 0),)]
        self.number = {self.states[0]: 0}
        self.move: dict[int, int] = {}
        self.pairs: dict[int, bool] = {}

    def _agree(self, before: int, token: int) -> bool:
        """Whether the model leaves these two tokens side by side."""
        at = before << 20 | token
        known = self.pairs.get(at)
        if known is None:
            whole = self.spelt[token] if before < 0 else self.spelt[before] + self.spelt[token]
            known = [t.id for t in self.model.tokenize(whole)] == ([token] if before < 0 else [before, token])
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            self.pairs[at] = known
        return known

    def _made(self, state: int, byte: int) -> int:
        """The transition, found once: the new state and, in its last byte, the change of the count."""
        child, tokens = self.child.get, self.token.get
        open_now = [(node, last, n) for above, last, n in self.states[state] if (node := child(above << 8 | byte))]
        for node, last, n in open_now:
            token = tokens(node)
            if token is not None and self._agree(last, token):
                change = n + 1
                break
        else:
            raise ValueError("the vocabulary does not cover every byte")
        reached = (*[(node, last, n - change) for node, last, n in open_now], (0, token, 0))
        to = self.number.get(reached)
        if to is None:
            to = self.number[reached] = len(self.states)
            self.states.append(reached)
        step = self.move[state << 8 | byte] = to << 8 | change + BIAS
        return step

    def read(self, word: str, state: tuple = ()) -> tuple[tuple, int]:
        """Read on from a state, given by its entries, so that it outlives a fresh start: (state, change of the count)."""
        if len(self.states) > MAX_STATES:
            self._forget()
        now, total, move = self.FIRST, 0, self.move
        if state:
            now = self.number.setdefault(state, len(self.states))
            if now == len(self.states):
                self.states.append(state)
        read = word.encode()
        for byte in read:
            step = move.get(now << 8 | byte) or self._made(now, byte)
            now = step >> 8
            total += step & 255
        return self.states[now], total - BIAS * len(read)

    def __missing__(self, word: str) -> int:
        n = self.read(word)[1]
        if len(word) <= LONG_WORD:
            if len(self) >= TABLE_WORDS:
                self.clear()
            self[word] = n
        return n


@functools.lru_cache(maxsize=1)
def machine(path: str) -> TokenMachine:
    return TokenMachine(path)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _count_side_by_side(parts: list[str], owner: list[int], out: np.ndarray, classes: np.ndarray, count: TokenMachine) -> None:
    """Add the tokens of short parts to their texts."""
    text = "\n".join(parts) + "\n"
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    kinds = classes[_points(text)]
    kinds[ends] = _C["end"]
    starts, _ = word_starts(kinds)
    stops = np.append(starts[1:], len(text))
    words = kinds[starts] != _C["end"]
    starts, stops = starts[words], stops[words]
    numbers = list(map(count.__getitem__, [text[a:b] for a, b in zip(starts.tolist(), stops.tolist())]))
    whose = np.repeat(np.asarray(owner), np.diff(np.searchsorted(starts, ends), prepend=0))
    # Sums below 2^53 are exact in the doubles that weights are added up in.
    out += np.bincount(whose, np.asarray(numbers, np.float64), len(out)).astype(np.int64)


def count_long(text: str, classes: np.ndarray, count: TokenMachine, slab: int = SLAB) -> int:
    """Tokens of a text of any length, slab by slab; the open word's state and its last sign are carried on."""
    state, total, open_state, last = 0, 0, (), ""
    for at in range(0, len(text), slab):
        piece = text[at : at + slab]
        starts, state = word_starts(classes[_points(piece)], state)
        held = last + piece
        cuts = [s + len(last) for s in starts.tolist() if s + len(last) > 0 or open_state or s >= 0]
        begin = 0
        for cut in cuts:
            word = held[begin:cut]
            if open_state:
                total += count.read(word, open_state)[1]
            elif word:
                total += count[word]
            open_state, begin = (), cut
        rest = held[begin:]
        last = rest[-1:]
        if len(rest) > 1:
            open_state, change = count.read(rest[:-1], open_state)
            total += change
    return total + (count.read(last, open_state)[1] if open_state else count[last] if last else 0)


def _counted(texts: list[str | None], special: str, classes: np.ndarray, count: TokenMachine) -> np.ndarray:
    out = np.zeros(len(texts), np.int64)
    parts: list[str] = []
    owner: list[int] = []
    size = 0

    def settle() -> None:
        nonlocal size
        if parts:
            _count_side_by_side(parts, owner, out, classes, count)
        parts.clear()
        owner.clear()
        size = 0

    for i, text in enumerate(texts):
        pieces = (text or "").split(special)
        out[i] += len(pieces) - 1
        for piece in pieces:
            if len(piece) > SLAB:
                out[i] += count_long(piece, classes, count)
            elif piece:
                if size + len(piece) > SLAB:
                    settle()
                parts.append(piece)
                owner.append(i)
                size += len(piece) + 1
    settle()
    return out


def special_token(path: str) -> str:
    """The one special token that the vocabulary names."""
    with open(path, encoding="utf-8") as file:
        tokens = json.load(file)["added_tokens"]
    if len(tokens) != 1 or any(tokens[0][k] for k in ("lstrip", "rstrip", "single_word", "normalized")):
        raise ValueError("the vocabulary must have one plain special token")
    return str(tokens[0]["content"])


def count_tokens(docs: DataFrame, path: str, text: str = "text", n_tokens: str = "n_tokens", n_bytes: str = "n_bytes") -> DataFrame:
    """``docs`` with the number of UTF-8 bytes and of tokens of every whole text. No shuffle."""
    packed, special = code_point_classes(path), special_token(path)

    @F.arrow_udf("long")
    def counts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        classes, count = _classes(packed), machine(path)
        for batch in batches:
            yield pa.array(_counted(batch.to_pylist(), special, classes, count))

    kept = without(docs, n_tokens, n_bytes)
    body = F.col(f"`{text}`")
    return kept.withColumns({n_bytes: F.coalesce(F.octet_length(body), F.lit(0)).cast("long"), n_tokens: counts(body)})
