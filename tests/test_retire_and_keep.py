"""Which rows retire, and which pages of a document are kept."""

from pyspark.sql import functions as F

from wattgrid.functions import pages
from wattgrid.operators import changes


def test_only_rows_of_fetched_domains_retire(spark):
    old = [(1, "a", "http://www.u.com/1"), (1, "b", "http://other.com/1"), (1, "c", None), (1, "d", "http://U.com/2"), (1, "kept", "http://u.com/3"), (2, "a", "http://u.com/4"), (3, "a", "http://u.com/5")]
    new = [(1, "kept", "https://u.com/new", True), (1, "x", None, False), (1, "y", None, False), (1, "z", None, False), (2, "n", None, True), (3, "n", "http://v.com", True)]
    existing = spark.createDataFrame(old, "g long, n string, url string")
    stored = spark.createDataFrame(new, "g long, n string, url string, home boolean")
    gone = changes.reconcile(stored, existing, "g", ["g", "n"], F.col("home"), source_url="url")
    assert gone.columns == existing.columns and {(r.g, r.n) for r in gone.collect()} == {(1, "a"), (1, "d")}


def test_pages_kept_by_priority(spark):
    texts = ["rate no. 1", "$5 and kwh", "kwh", "filler"]
    docs = {1: [0, 0, 0, 1, 2, 3], 2: [0, 0, 1, 2], 3: [1, 3], 4: [2, 2, 3], 5: [3, 3], None: [0, 3]}
    want = {1: [0, 0, 0], 2: [0, 0, 1], 3: [1], 4: [2, 2], 5: [3, 3], None: [0]}
    rows = [(d, k, texts[p]) for d, found in docs.items() for k, p in enumerate(found)]
    got = pages.kept_pages(spark.createDataFrame(rows, "d long, k long, t string"), ["d"], "t").collect()
    assert {d: sorted(r.priority for r in got if r.d == d) for d in docs} == want
