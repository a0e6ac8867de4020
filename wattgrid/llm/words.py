"""Hashes of the words of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes that are hashed at once; longer texts are cut between words.
LIMIT = 1 << 20
FACTOR = 0x9FB21C651E98DF25
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
VALUES = np.random.default_rng(20).integers(0, 1 << 64, 256, np.uint64)

_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolled(h: np.ndarray, n: int, factor: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """A 64-bit hash of every n consecutive numbers."""
    out = np.full(max(0, len(h) - n + 1), n, np.uint64)
    for k in range(n):
        out = out * np.uint64(factor) + h[k : len(h) - n + 1 + k]
    return mixed(out)


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct numbers."""
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, LIMIT + 1)
        up, down = np.full(size, FACTOR, np.uint64), np.full(size, pow(FACTOR, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _powers


def _words(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word: a polynomial in the values of its bytes, from differences of prefix sums."""
    space = SPACE[b]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.r_[0, edge]
    if not space[-1]:
        edge = np.r_[edge, len(b)]
    start, end = edge[::2], edge[1::2]
    up, down = _powers_to(len(b))
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(VALUES[b] * up[: len(b)], out=sums[1:])
    return mixed((sums[end] - sums[start]) * down[start]), start, end


def _cuts(raw: bytes) -> list[int]:
    """Ends of parts of about LIMIT bytes that cut no word."""
    cuts, at = [], 0
    space = None
    while len(raw) - at > LIMIT:
        if space is None:
            space = np.flatnonzero(SPACE[np.frombuffer(raw, np.uint8)])
        k = np.searchsorted(space, at + LIMIT)
        at = int(space[k - 1]) + 1 if k and space[k - 1] >= at else int(space[k]) + 1 if k < len(space) else len(raw)
        cuts.append(at)
    return cuts if cuts and cuts[-1] == len(raw) else [*cuts, len(raw)]


def hashed_words(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each text the hashes of its words between ASCII white space, and where they start and end in it."""
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    i = 0
    while i < len(texts):
        if len(texts[i]) > LIMIT:
            at, found = 0, []
            for cut in _cuts(texts[i]):
                h, a, b = _words(np.frombuffer(texts[i][at:cut], np.uint8))
                found.append((h, a + at, b + at))
                at = cut
            yield tuple(np.concatenate(x) for x in zip(*found))
            i += 1
            continue
        k, size = i, 0
        while k < len(texts) and size + len(texts[k]) <= LIMIT:
            size += len(texts[k]) + 1
            k += 1
        some = texts[i:k]
        i = k
        joined = np.frombuffer(b" ".join(some), np.uint8)
        if not len(joined):
            yield from [none] * len(some)
            continue
        h, a, b = _words(joined)
        base = np.r_[0, np.cumsum([len(t) + 1 for t in some])]
        at = np.searchsorted(a, base)
        for j in range(len(some)):
            x, y = at[j], at[j + 1]
            yield h[x:y], a[x:y] - base[j], b[x:y] - base[j]
