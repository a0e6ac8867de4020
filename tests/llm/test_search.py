"""Ranked search against a plain program over words, with blocks of few queries, batches of few documents and pieces of few bytes."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wattgrid.llm import ranked_search as S

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def expected(docs, items, k=10):
    rows = [(i, Counter(terms(t))) for i, t in docs]
    rows = [(i, c) for i, c in rows if c]
    n_docs, n_terms, df = len(rows), sum(sum(c.values()) for _, c in rows), Counter(t for _, c in rows for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, some in asked.items():
        found = []
        for i, c in rows:
            m = 10 + 90 * sum(c.values()) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in some if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def made():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)] + ["Ünï", "ÜNÏ", "日本", "naïve", "A1", "a1", "x_y", "o'neil"]
    text = lambda n: " ".join(rng.choices(words, [1 / (i + 1) for i in range(len(words))], k=n)) + rng.choice(["", ".", "\n"])
    docs = [(i, text(rng.randint(0, 60))) for i in range(150)] + [(7, "w1 w2"), (7, "w1 w2"), (None, text(30)), (None, None), (200, None), (201, ""), (202, " .,; "), (203, "w3 " * 50_000)]
    items = [(i, text(rng.randint(1, 15))) for i in range(20)] + [(3, "w39 日本"), (None, "w1 naïve"), (30, None), (31, "?!"), (32, "nowhere"), (33, text(15))]
    return docs, items


@pytest.mark.parametrize("small", [False, True])
def test_against_plain(spark, monkeypatch, small):
    if small:
        for name, n in (("BLOCK_QUERIES", 6), ("CELLS", 1), ("PIECE", 7), ("PARTS", 3)):
            monkeypatch.setattr(S, name, n)
    docs, items = made()
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("id", "score", "rank", "term", "item_id")})
    i = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit(1) for c in ("doc_id", "term", "terms")})
    got = sorted((tuple(r) for r in S.ranked_search(d.repartition(4), i).collect()), key=str)
    assert got == expected(docs, items)
    assert S.ranked_search(d.where("1 = 0"), i).count() == 0 and S.ranked_search(d, i.where("1 = 0")).count() == 0


def test_shared_sums():
    """Each query's roots add up to its own terms, and sets that queries share are made once."""
    rng = random.Random(5)
    queries = [sorted(set(rng.choices(range(30), k=12))) for _ in range(40)] + [[], [5]]
    plan = S.share(queries, 30)
    holds = [{t} for t in range(30)]
    for first, left, right in plan.levels:
        assert first == len(holds)
        for a, b in zip(left, right):
            assert not holds[a] & holds[b]
            holds.append(holds[a] | holds[b])
    for q, roots in zip(queries, plan.roots):
        assert sorted(t for r in roots for t in holds[r]) == q
    assert sum(len(r) for r in plan.roots) + plan.nodes - 30 < sum(map(len, queries))
