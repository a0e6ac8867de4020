"""Queries that read whole tables, beside plain programs."""

import re

import pandas as pd
import pytest

from wattgrid.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", ["dead_pages", "all_address_lookup"])
def test_no_row_is_left_out_by_its_id(name):
    assert not re.search(r"% [37]\b|id < 300", ORACLES[name])


def test_dead_pages(spark, sf):
    checks = pd.read_parquet(f"{sf}/events.parquet")
    want = {k: len(g) for k, g in checks.groupby(["user_id", "props"]) if g["event_type"].isin(["error", "view"]).all()}
    got = {(r.source_id, r.url): r.total for r in QUERIES["dead_pages"](spark, sf).collect()}
    assert got == want and 0 < len(want) < checks.groupby(["user_id", "props"]).ngroups


def test_all_addresses_are_looked_up(spark, sf):
    got = set(QUERIES["all_address_lookup"](spark, sf).toPandas()["address_id"])
    customers = pd.read_parquet(f"{sf}/customer.parquet").set_index("c_custkey")
    active = customers[customers["c_acctbal"] >= 0]
    addresses = {i for i in pd.read_parquet(f"{sf}/embeddings.parquet", columns=["vec_id"])["vec_id"] if i + 1 in customers.index}
    keys, nations = set(active.index % 100), set(active["c_nationkey"])
    assert got <= addresses and any(i % 7 == 0 for i in got)
    assert not [i for i in addresses - got if i % 100 in keys or customers["c_nationkey"][i + 1] in nations]


def test_term_changes_of_whole_documents(spark, sf):
    docs = pd.read_parquet(f"{sf}/documents.parquet").sort_values("doc_id")
    words = lambda t: set(re.split(r"[ \t\n\r\f\v]+", t or ""))
    few = lambda s: ", ".join(sorted(s)[:10])
    want = {}
    for _, g in docs.groupby("source"):
        before = (None, None)
        for i, text in zip(g["doc_id"], g["text"]):
            added, removed = words(text) - words(before[1]), words(before[1]) - words(text)
            said = "; ".join(x for x in (added and "New terms: " + few(added), removed and "Removed terms: " + few(removed)) if x)
            change = said or "Content changed (details in full diff)"
            want[i] = (before[0], "Initial check - no previous content to compare" if not before[1] else "Content became unavailable" if not text else change)
            before = (i, text)
    got = {r.doc_id: (r.before, r.changes) for r in QUERIES["document_term_changes"](spark, sf).collect()}
    assert got == want and len(want) == len(docs)


def test_all_languages_are_hashed(spark, sf):
    assert QUERIES["all_normalized_text"](spark, sf).count() == len(pd.read_parquet(f"{sf}/documents.parquet", columns=["doc_id"]))
