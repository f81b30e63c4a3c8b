"""Token sets inside tasks: the tokens of many texts at once, the keys by which sets that may be alike meet, and how much pairs share.

Plain functions over numpy arrays; a set is a run of sorted 64-bit token hashes, many sets are such runs one after the other with their lengths.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text hashed at a time (and at most one word more), and bytes of texts handled at a time (and at most one text more).
PIECE_BYTES, SLICE_BYTES = 1 << 16, 1 << 20
#: Buckets of token hashes whose counts order tokens (a power of two; 8 MB are broadcast, whatever the input).
TOKEN_BUCKETS = 1 << 22
#: Tokens of a part where a band's sets are largest, and the sizes that ask for one more shared part each.
PART_TOKENS, EXTRA_AT = 3, 128
#: Most sets of a component that one side of a cell holds, on average.
CELL = 256

#: 1 for what may begin a word, 2 for what may only go on with it.
_KIND = np.zeros(256, np.uint8)
_KIND[[*b"0123456789'"]] = 2
_SMALL, _LARGE = [*b"abcdefghijklmnopqrstuvwxyz"], [*b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"]
_KIND[_SMALL], _KIND[_LARGE] = 1, 1
#: Letters beyond ASCII that have ASCII letters in lower case.
_FOLDED = {"\u212a": "k", "\u0130": "i\u0307"}
_R = np.random.default_rng(71)
_OF_BYTE = _R.integers(0, 1 << 64, 256, np.uint64)
_OF_BYTE[_LARGE] = _OF_BYTE[_SMALL]
_TIMES = int(_R.integers(0, 1 << 61)) * 8 + 5
_SALT = _R.integers(0, 1 << 64, 4, np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    x = np.full(n, base, np.uint64)
    x[:1] = 1
    return np.cumprod(x)


_POWERS, _INVERSES = _powers(_TIMES, 1), _powers(pow(_TIMES, -1, 1 << 64), 1)


def mix(x: np.ndarray) -> np.ndarray:
    """Every bit of a 64-bit number spread over all."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _words(b: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the matches of ``[a-z][a-z0-9']*`` in the lower case of bytes, none across ``breaks`` (where texts begin).

    A word's hash is a polynomial of 64-bit numbers that stand for its bytes, taken from running sums, and mixed.
    """
    global _POWERS, _INVERSES
    if len(_POWERS) < len(b):
        _POWERS, _INVERSES = _powers(_TIMES, len(b)), _powers(pow(_TIMES, -1, 1 << 64), len(b))
    kind = _KIND[b]
    word = kind > 0
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    first[breaks] = word[breaks]
    before = breaks[breaks > 0] - 1
    last[before] = word[before]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    late = np.flatnonzero(kind[start] == 2)  # runs that begin with what can't begin a word
    if len(late):
        letters = np.append(np.flatnonzero(kind == 1), len(b))
        start[late] = np.minimum(letters[np.searchsorted(letters, start[late])], end[late])
        real = start < end
        start, end = start[real], end[real]
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_OF_BYTE[b] * _POWERS[: len(b)], out=total[1:])
    return mix((total[end] - total[start]) * _INVERSES[start]), start


def _pieces(b: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of about PIECE_BYTES bytes that cut no word."""
    at = 0
    while at < len(b):
        end = min(at + PIECE_BYTES, len(b))
        if end < len(b):
            gaps = np.flatnonzero(_KIND[b[at:end]] == 0)
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:
                while end < len(b) and _KIND[b[end]]:
                    end += 1
        yield at, end
        at = end


def token_sets(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, n, tokens) for runs of texts from that row on: sizes of their sets (0 without a word) and the sets' tokens as int64, sorted by row. Words are those of the texts' lower case."""
    texts = texts.cast(pa.large_string()).fill_null("")
    for large, small in _FOLDED.items():
        if pc.any(pc.match_substring(texts, large)).as_py():
            texts = pc.replace_substring(texts, large, small)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    run = (offsets[:-1] - offsets[0]) // SLICE_BYTES
    edges = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(texts)]
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        if high == low:
            continue
        at = offsets[low : high + 1] - offsets[low]
        size = int(at[-1])
        data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[low] : offsets[high]] if size else np.zeros(0, np.uint8)
        begins = np.unique(at[:-1][at[:-1] < size])
        found = []
        for a, b in _pieces(data):
            hashes, start = _words(data[a:b], begins[np.searchsorted(begins, a) : np.searchsorted(begins, b)] - a)
            found.append((hashes, start + a))
        t = np.concatenate([x[0] for x in found] or [np.zeros(0, np.uint64)]).view(np.int64)
        row = np.searchsorted(at[:-1], np.concatenate([x[1] for x in found] or [np.zeros(0, np.int64)]), "right") - 1
        ends = np.cumsum(np.bincount(row, minlength=high - low))
        for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            t[a:b].sort()
        new = np.ones(len(t), bool)
        new[1:] = (t[1:] != t[:-1]) | (row[1:] != row[:-1])
        yield low, np.bincount(row[new], minlength=high - low), t[new]


def digests(n: np.ndarray, t: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit digests of each set, none of which may be empty."""
    begins = np.cumsum(n) - n
    return [np.add.reduceat(mix(t.view(np.uint64) ^ s), begins).view(np.int64) for s in _SALT[:2]]


def worths(levels: np.ndarray) -> np.ndarray:
    """What buckets with so many items tell, in sixteenths of a bit and one more (int16); below zero where one item has the bucket alone."""
    worth = np.round(16 * np.log2(max(1, levels.max(initial=1)) / np.maximum(levels, 1))).astype(np.int16) + np.int16(1)
    return np.where(levels == 1, -worth, worth)


def _firsts(of: np.ndarray, worth: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of each set's entries from the one that tells most, and the places in it."""
    order = np.lexsort((by, -worth, of))
    counts = np.bincount(of)
    return order, np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)


def meeting_keys(n: np.ndarray, t: np.ndarray, worth: np.ndarray, least: float) -> tuple[np.ndarray, ...]:
    """(p, row, i, x, up, q) of sets: keys by which all different sets of Jaccard ``least`` or more meet.

    Sets of sizes a and b that are so alike differ in at most D = (a + b) (1 - least) / (1 + least) tokens.
    The larger one's size is in a band from 2^k to 2^(k + 1); for it all tokens are dealt by their hashes into
    parts, and what a set has in a part is a key. At most D of a set's keys aren't the other's, so where it has
    D + 1 + x, the first D + 1 + x of both in one order of keys (from what tells most; any order is exact) have
    x + 1 in common, with places i up to D + x. ``up`` counts the bands from a set's own to the one the keys are
    for. Sets with too few keys, mostly very small ones, also give the first of their single tokens (x is -1):
    two of them share one of those. A key with a token of a bucket that one item has alone is left out.
    ``q`` stands for the x + 1 keys before a key (where i is above x): two sets with those in common have met often enough.
    """
    apart = (1 - least) / (1 + least)
    tokens, of = t.view(np.uint64), np.repeat(np.arange(len(n)), n)
    value = worth[t & (TOKEN_BUCKETS - 1)].astype(np.int64)
    spread, told = mix(tokens ^ _SALT[2]), mix(tokens ^ _SALT[3])
    top = np.floor(n / least + 1e-9).astype(np.int64)
    band = lambda v: np.frexp(v.astype(np.float64))[1] - 1
    out = []
    for up in range(int((band(top) - band(n)).max(initial=0)) + 1):
        grid = band(n) + up
        over = np.left_shift(1, grid + 1)
        x = over // EXTRA_AT
        most = np.floor((n + np.minimum(top, over - 1)) * apart + 1e-9).astype(np.int64)
        meant = (grid <= band(top)) & (most > 0)  # a set that may differ in no token has no partner
        if not meant.any():
            continue
        parts = -(-over // PART_TOKENS)
        pick = np.flatnonzero(meant[of])
        cell = of[pick] * int(parts.max()) + (spread[pick] >> np.uint64(20)).astype(np.int64) % parts[of[pick]]
        order = np.argsort(cell, kind="stable")
        pick, cell = pick[order], cell[order]
        begins = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        row = of[pick[begins]]
        key = mix(np.add.reduceat(told[pick], begins) + mix((cell[begins] % int(parts.max())).astype(np.uint64) * np.uint64(64) + grid[row].astype(np.uint64)))
        alone = np.bitwise_or.reduceat(value[pick] < 0, begins)
        order, place = _firsts(row, np.add.reduceat(np.abs(value[pick]), begins), key)
        row, key = row[order], key[order]
        keep = (place <= (most + x)[row]) & ~alone[order]
        sums = np.append(np.uint64(0), np.cumsum(mix(key)))
        at, own = np.flatnonzero(keep), x[row[keep]]
        before = sums[at] - sums[np.maximum(at - own - 1, 0)]
        out.append((key[keep], row[keep], place[keep], own, np.full(len(at), up), before))
        few = meant & (np.bincount(row, minlength=len(n)) <= most + x)
        pick = np.flatnonzero(few[of])
        if len(pick):
            order, place = _firsts(of[pick], np.abs(value[pick]), tokens[pick])
            pick = pick[order]
            row = of[pick]
            keep = (place < (n - np.ceil(n * least - 1e-9).astype(np.int64) + 1)[row]) & (value[pick] > 0)
            single = mix(tokens[pick] + mix(grid[row].astype(np.uint64) + _SALT[0]))
            out.append((single[keep], row[keep], place[keep], np.full(int(keep.sum()), -1), np.full(int(keep.sum()), up), np.zeros(int(keep.sum()), np.uint64)))
    if not out:
        return tuple(np.zeros(0, k) for k in (np.uint64, np.int64, np.int64, np.int64, np.int64, np.uint64))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def shared(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many tokens the sets at ``a`` and ``b`` share, pair by pair; each ``a`` is marked once for all its partners."""
    n = np.array([len(s) for s in sets])
    kinds, ids = np.unique(np.concatenate(sets), return_inverse=True)
    begins = np.cumsum(n) - n
    own = [ids[s : s + k] for s, k in zip(begins.tolist(), n.tolist(), strict=True)]
    out, mark = np.zeros(len(a), np.int64), np.zeros(len(kinds), np.int64)
    order = np.argsort(a, kind="stable")
    edges = np.flatnonzero(np.append(True, np.diff(a[order]) != 0)).tolist()
    for low, high in zip(edges, [*edges[1:], len(order)], strict=True):
        pairs = order[low:high]
        mine, others = own[a[pairs[0]]], b[pairs]
        mark[mine] = 1
        out[pairs] = np.add.reduceat(mark[np.concatenate([own[k] for k in others.tolist()])], np.cumsum(n[others]) - n[others])
        mark[mine] = 0
    return out
