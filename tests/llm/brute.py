"""Plain versions of the operators, for small inputs."""

import hashlib
from collections import Counter


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def repeated_bytes(texts: dict[int, str | None], window: int) -> dict[int, tuple]:
    """doc -> (n_bytes, n_removed, n_spans, sha of kept)."""
    data = {k: (t or "").encode() for k, t in texts.items()}
    seen = Counter(d[i : i + window] for d in data.values() for i in range(len(d) - window + 1))
    out = {}
    for k, d in data.items():
        gone = bytearray(len(d))
        for i in range(len(d) - window + 1):
            if seen[d[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[k] = (len(d), sum(gone), spans, sha(bytes(b for b, g in zip(d, gone) if not g)))
    return out


def repeated_words(texts: dict[int, str | None], window: int) -> dict[int, tuple]:
    """doc -> (n_words, n_removed, kept words joined)."""
    words = {k: (t or "").encode().split() for k, t in texts.items()}
    seen = Counter(tuple(w[i : i + window]) for w in words.values() for i in range(len(w) - window + 1))
    out = {}
    for k, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out[k] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode())
    return out


def groups(nodes, links) -> dict:
    """node -> smallest node reachable."""
    root = {n: n for n in nodes}
    for _ in nodes:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    return root


def grams(text: str | None, n: int = 5) -> frozenset:
    w = (text or "").lower().encode().split()
    return frozenset(tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, 1))) if w else frozenset()


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str | None) -> list[tuple]:
    """(start, kind order, kind, end) of the four base kinds."""
    import re

    text, out = text or "", []
    number = lambda m: re.sub("[^0-9]", "", m)
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(number(m)) <= 19 and luhn(number(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(number(m)) <= 15),
    ]
    for order, (kind, pattern, good) in enumerate(rules):
        out += [(m.start(), order, kind, m.end()) for m in re.finditer(pattern, text) if good(m.group())]
    return sorted(out)
