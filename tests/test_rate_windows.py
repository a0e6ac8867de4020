"""Rate windows of long texts against plain programs."""

import hashlib
import re

import pandas as pd

from wattgrid.functions import pages
from wattgrid.functions import text as X
from wattgrid.queries import QUERIES

HOME = "Residential service rate: $0.10 per kWh. "


def densest(text, budget):
    blocks = [text[a : a + 500] for a in range(0, len(text), 500)]
    scores = [3 * bool(re.search(X.RATE_AMOUNTS, b)) + 2 * bool(re.search(X.RATE_WORDS, b)) + 2 * bool(re.search(X.RATE_SCHEDULES, b)) for b in blocks]
    n = budget // 500
    if n >= len(blocks):
        return text[:budget]
    at = max(range(len(blocks) - n + 1), key=lambda k: (sum(scores[k : k + n]), -k))
    return marked(text, at * 500, at * 500 + budget)


def marked(text, a, b):
    return (pages.LEFT_OUT + "\n" if a else "") + text[a:b] + ("\n" + pages.LEFT_OUT if b < len(text) else "")


def test_windows_of_long_texts(spark):
    x = lambda n: ("filler words " * (n // 13 + 1))[:n]
    late = x(42_000) + "energy charge $5" + x(3000).rstrip()
    far = x(120_000) + "energy charge $5" + x(60_000).rstrip()
    near = x(20_000) + HOME + x(8000) + HOME + x(12_000).rstrip()
    spread = x(12_000) + HOME + x(12_000) + HOME + x(18_000).rstrip()
    book = x(100_000) + HOME + x(80_000) + HOME + x(40_000).rstrip()
    many = x(1500) + "".join(HOME + x(2200) for _ in range(4)) + x(30_000).rstrip()
    spaced = ("a" + " " * 99) * 600 + "end"
    rows = [(1, late), (2, far), (3, near), (4, spread), (5, book), (6, "short"), (7, None), (8, spaced), (9, many)]
    got = {r.id: r for r in pages.rate_windows(spark.createDataFrame(rows, "i long, t string"), "i", "t").collect()}
    second = near.index(HOME, 20_001)
    want = {
        1: densest(late, 30_000),
        2: densest(far, 90_000),
        3: f"{pages.LEFT_OUT}\n{near[19_000:26_000]}\n\n{pages.LEFT_OUT}\n\n{near[second - 1000 : second + 6000]}\n{pages.LEFT_OUT}",
        4: marked(spread, 2000, 32_000),
        5: marked(book, 90_000, 180_000),
        9: marked(many, 500, many.rindex(HOME) + 6000),
        6: "short",
        7: "",
        8: "a  " * 600 + "end",
    }
    assert {i: r.window for i, r in got.items()} == want and all(r.kept == len(r.window) for r in got.values())
    assert "energy charge" in want[1] and "energy charge" in want[2] and got[2].kept == 90_000 + len(want[2]) - 90_000


def test_query_returns_windows(spark):
    folder = "/root/testdata/sf0.01"
    texts = pd.read_parquet(f"{folder}/documents.parquet", columns=["doc_id", "text"])
    got = {r.id: (r.kept, r.window_sha256) for r in QUERIES["rate_window_texts"](spark, folder).collect()}
    assert len(got) == len(texts)
    for i, text in zip(texts["doc_id"], texts["text"]):
        text = re.sub(r"(?:\n\s*){3,}", "\n\n", re.sub(r"[ \t]{4,}", "  ", re.sub(r"\n{3,}", "\n\n", text or ""))).strip()
        if len(text) <= 30_000:
            assert got[i] == (len(text), hashlib.sha256(text.encode()).hexdigest())
        elif not re.search(pages.HOME_SIGNAL, text):
            text = densest(text, 90_000 if len(text) > 50_000 else 30_000)
            assert got[i] == (len(text), hashlib.sha256(text.encode()).hexdigest())
