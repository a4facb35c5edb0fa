"""Front-coded runs of sorted strings and their merge by a loser tree that knows common prefixes."""

from __future__ import annotations

import struct


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of a and b, of which ``known`` bytes are known and not looked at again."""
    low, high = known, min(len(a), len(b))
    if a[low:high] == b[low:high]:
        return high
    while high - low > 8:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    while a[low] == b[low]:
        low += 1
    return low


def front_coded(strings: list[bytes]) -> bytes:
    """Sorted strings as lengths shared with the one before, lengths of the rest, and the rests."""
    shared, rests, last = [], [], b""
    for s in strings:
        shared.append(common_prefix(last, s, 0))
        rests.append(s[shared[-1] :])
        last = s
    n = len(strings)
    return struct.pack(f"<I{n}I{n}I", n, *shared, *map(len, rests)) + b"".join(rests)


def decoded(run: bytes) -> tuple[list[bytes], list[int]]:
    """The strings of a front-coded run and their shared lengths."""
    (n,) = struct.unpack_from("<I", run)
    numbers = struct.unpack_from(f"<{2 * n}I", run, 4)
    out, at, last = [], 4 + 8 * n, b""
    for shared, size in zip(numbers[:n], numbers[n:]):
        last = last[:shared] + run[at : at + size]
        at += size
        out.append(last)
    return out, list(numbers[:n])


def merged(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[tuple[int, int]], list[int]]:
    """Places (run, index) of all strings in order, and the prefix each shares with the one before.

    Every head knows what it shares with the last string that passed its node. Of two heads the one that shares
    more is the smaller; only at equal lengths are bytes compared, and from there on.
    """
    leaves = 1
    while leaves < max(1, len(runs)):
        leaves *= 2
    heads = [run[0][0] if run[0] else None for run in runs] + [None] * (leaves - len(runs))
    shared, at = [0] * leaves, [0] * leaves

    def play(a: int, b: int) -> tuple[int, int]:
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if shared[a] != shared[b]:
            return (a, b) if shared[a] > shared[b] else (b, a)
        common = common_prefix(x, y, shared[a])
        if common == len(x) or common < len(y) and x[common] < y[common]:
            shared[b] = common
            return a, b
        shared[a] = common
        return b, a

    losers, winners = [0] * leaves, [0] * leaves + list(range(leaves))
    for node in range(leaves - 1, 0, -1):
        winners[node], losers[node] = play(winners[2 * node], winners[2 * node + 1])
    best = winners[1]
    order, lengths = [], []
    while heads[best] is not None:
        order.append((best, at[best]))
        lengths.append(shared[best])
        at[best] += 1
        strings, prefixes = runs[best]
        if at[best] < len(strings):
            heads[best], shared[best] = strings[at[best]], prefixes[at[best]]
        else:
            heads[best] = None
        node = (best + leaves) // 2
        while node:
            best, losers[node] = play(best, losers[node])
            node //= 2
    return order, lengths
