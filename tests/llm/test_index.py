"""The full-text index against counting, and shards whose hashes say nothing."""

import numpy as np
import pyarrow as pa
import pytest

from wattgrid.llm.fm_index import FMIndex, WaveletMatrix
from wattgrid.llm.substring_dedup import repeated_in_shard


def test_ranks():
    rng = np.random.default_rng(1)
    for largest in (1, 2, 9, 1000):
        s = rng.integers(0, largest + 1, 500)
        m = WaveletMatrix(s, largest)
        c, at = rng.integers(0, largest + 1, 300), rng.integers(0, 501, 300)
        assert m.rank(c, at).tolist() == [int((s[:a] == x).sum()) for x, a in zip(c, at)]


@pytest.mark.parametrize("seed", range(12))
def test_matching_statistics(seed):
    rng = np.random.default_rng(seed)
    runs = [tuple(rng.integers(1, rng.integers(3, 8), rng.integers(1, 40)).tolist()) for _ in range(rng.integers(1, 12))]
    runs += [runs[0]] * int(rng.integers(0, 3))
    text = np.array([x for r in runs for x in (*r, 0)])
    ends = np.flatnonzero(text == 0)
    spans = [(a, min(b, a + 7)) for s, b in zip(np.r_[0, ends[:-1] + 1], ends) for a in range(s, b, 5)]
    got = FMIndex(text, [8, 16, 64][seed % 3]).matching_statistics(text, *np.array(spans).T)

    def longest(i, stop):
        n = 0
        while i + n < stop:
            p = tuple(text[i : i + n + 1])
            if sum(r[k : k + len(p)] == p for r in runs for k in range(len(r) - len(p) + 1)) < 2:
                break
            n += 1
        return n

    assert got.tolist() == [longest(i, b) for a, b in spans for i in range(a, b)]


def test_streams_that_the_index_does_not_hold():
    index, asked = FMIndex(np.array([1, 2, 3, 1, 2, 4, 0]), 8), np.array([2, 1, 2, 9, 1])
    assert index.matching_statistics(asked, np.array([0]), np.array([5]), least=1).tolist() == [1, 2, 1, 0, 1]


@pytest.mark.parametrize("seed", range(6))
def test_windows_of_a_shard(seed):
    """All segments in one shard, as if every anchor had the same hash; texts that touch, repeat and overlap."""
    rng = np.random.default_rng(seed)
    window = 6
    texts = [rng.integers(0, 3 if seed % 2 else 40, rng.integers(6, 300)).tolist() for _ in range(8)]
    texts += [texts[0][3:] + texts[1], texts[2]]
    rows, where = [], []
    for t, words in enumerate(texts):
        n, a = len(words) - window + 1, 0
        while a < n:
            k = int(min(n - a, rng.integers(1, 60)))
            rows.append((t % 3, t, a, k, False, " ".join(f"w{x}" for x in words[a : a + k + window - 1])))
            where += [(t, i) for i in range(a, a + k)]
            a += k + int(rng.integers(0, 2) * rng.integers(0, 9))
    order = rng.permutation(len(rows))
    table = pa.table({n: pa.array([rows[i][k] for i in order], kind) for k, (n, kind) in enumerate([("t1", pa.int64()), ("t2", pa.int64()), ("start", pa.int64()), ("windows", pa.int64()), ("hot", pa.bool_()), ("words", pa.string())])})
    covered = {t: np.zeros(len(w), bool) for t, w in enumerate(texts)}
    inside = {t: np.zeros(len(w), bool) for t, w in enumerate(texts)}
    for t, i in where:
        inside[t][i : i + window] = True
    count: dict[tuple, int] = {}
    for t, w in enumerate(texts):
        for i in range(len(w) - window + 1):
            if inside[t][i : i + window].all():
                count[tuple(w[i : i + window])] = count.get(tuple(w[i : i + window]), 0) + 1
    for t, i in where:
        if count[tuple(texts[t][i : i + window])] > 1:
            covered[t][i : i + window] = True
    got = {t: np.zeros(len(w), bool) for t, w in enumerate(texts)}
    for _, t, start, n, _, _, kind in repeated_in_shard(table, window):
        assert kind == 0
        got[t][start : start + n] = True
    assert all((got[t] == covered[t]).all() for t in got)
