"""Targets of canonical links and refresh redirects, in each form that pages have."""

import time
from urllib.parse import urljoin

import duckdb
import pytest
from pyspark.sql import functions as F

from wattgrid.llm import queries
from wattgrid.llm.url_filter import decoded, judge_urls, link_edges, resolved

PAGES = ["http://a.example.org/x/y/z?q=1#f", "https://B.example.org", "http://a.example.org/x/"]
TARGETS = ["x.html", "../w", "../../../w", "./w/.", "?page=2", "//c.example.org/v", "/v/../u?b=/../c", "http://d.example.org/?u=a", "/go?u=http://a.net/es/", "go?u=http://a.net/es/", "w/..", "a..b/c"]


def test_targets_resolve_as_urls_do(spark):
    rows = [(u, t) for u in PAGES for t in TARGETS]
    got = spark.createDataFrame(rows, "u string, t string").select("u", "t", resolved(F.col("t"), F.col("u")).alias("r")).collect()
    assert {(r.u, r.t): r.r for r in got} == {(u, t): urljoin(u.replace("B.example.org", "b.example.org/"), t) for u, t in rows}  # an empty path is /
    none = spark.createDataFrame([("http://a.org/", "mailto:x@y"), ("http://a.org/", "javascript:x"), ("http://a.org/", "#f"), ("no scheme", "x"), (None, "x")], "u string, t string")
    assert {r.r for r in none.select(resolved(F.col("t"), F.col("u")).alias("r")).collect()} == {None}


def test_references_decode_once(spark):
    rows = {"a?x=1&amp;y=2": "a?x=1&y=2", "&#38;amp;&#x2F;&#233;&lt;": "&amp;/é<", "&amp;lt;&nope;&": "&lt;&nope;&", "&#55296;&#0;&#9999999;": "&#55296;&#0;&#9999999;", "": ""}
    got = spark.createDataFrame([(k,) for k in rows], "t string").select("t", decoded(F.col("t")).alias("d")).collect()
    assert {r.t: r.d for r in got} == rows


@pytest.mark.parametrize(
    "url,html,want",
    [
        ("http://p.org/d/e", '<link rel=canonical href="http://p.org/1"><link rel="canonical" href="http://p.org/2">', {"p.org/1", "p.org/2"}),
        ("http://p.org/d/e", "<meta http-equiv=refresh content='0; url=/1'><META HTTP-EQUIV=\"Refresh\" content=\"1;url=2?a=1&amp;b=2\">", {"p.org/1", "p.org/d/2?a=1&b=2"}),
        ("http://p.org/d/e", '<link rel=canonical data-href="/no" href="../x">', {"p.org/x"}),
        ("http://p.org/d/e", '<link rel=canonical href="//Q.org/x">', {"q.org/x"}),
        ("http://p.org/d/e", '<link rel=canonical href="mailto:a@b">', set()),
        ("http://p.org/d/e", '<link data-rel="canonical" href=/x><link rel="canonical-wpml" href=/x><textarea><link rel=canonical href=/x></textarea><links rel=canonical href=/x>', set()),
        ("http://p.org/d/e", '<link rel="alternate Canonical" href=/1><link title="x>y" rel=canonical href=/2><link href = "/3"rel=\'canonical\'/><link rel=canonical HREF=/4 href=/x>', {"p.org/1", "p.org/2", "p.org/3", "p.org/4"}),
        ("http://p.org/d/e", '<meta content="5;http://q.org/x" http-equiv=refresh><meta http-equiv="refresh" content="0; URL=\'/1\'; x"><meta http-equiv=refresh content=7><meta name=refresh content="0;url=/no">', {"q.org/x", "p.org/1"}),
        ("http://p.org/d/e", '<style><link rel=canonical href=/x></style><title><link rel=canonical href=/x></title><link rel=canonical href="/1"', set()),
    ],
)
def test_edges(spark, url, html, want):
    got = link_edges(spark.createDataFrame([(url, html)], "url string, html string")).collect()
    assert {r.b for r in got} == want and all(r.a == "p.org/d/e" for r in got)


def test_clean_pages_stay_and_aliases_are_blocked(spark):
    rows = [
        (1, "http://a.example.net/es/x?k=1&l=2", ""),  # blocked by a rule
        (2, "http://b.example.org/1", '<link rel=canonical href="http://b.example.org/self"><link rel=canonical href="http://a.example.net/es/x?k=1&amp;l=2">'),
        (3, "http://b.example.org/d/3", '<link rel=canonical href="../1">'),
        (4, "http://c.example.org/4", '<link rel=canonical href="/go?u=http://a.example.net/es/x?k=1&amp;l=2">'),
    ]
    got = {r.page_id: r.verdict for r in judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "allow"}


def test_links_in_comments_and_scripts_are_none(spark):
    rows = [("http://p.org/", "<!-- <link rel=canonical href=/a> --><script>'<link rel=canonical href=/b>'</script><link rel=canonical href=/c><!-- <link rel=canonical href=/d>")]
    assert {r.b for r in link_edges(spark.createDataFrame(rows, "url string, html string")).collect()} == {"p.org/c"}


def test_query_and_sql_agree_on_links(spark, tmp_path):
    link, refresh = '<link rel="canonical" href="{}">', "<meta http-equiv=refresh content='0; url={}'>"
    blocked = "http://a.example.net/es/x"
    rows = [(1, blocked, ""), (2, "http://a.example.net/es/x?k=1&l=2", ""), (3, "http://a.example.net/es/", ""), (4, "http://a.example.net/es/d/x", "")]
    targets = [
        "http://a.example.net/es/x", "//a.example.net/es/x", "//A.example.net/es/x", "/es/x", "../x", "../../es/x", "./../x", "x", "?k=1&amp;l=2", "http://a.example.net/es/x?k=1&amp;l=2", "http://a.example.net/es/x?k=1&#38;l=2",
        "/go?u=http://a.example.net/es/x", "mailto:x@a.example.net", "#x", "http://a.example.net/es/x#part", "d/../x", "..", ".", "/es/d/./x", "&#x2F;es&#47;x", "../../../../es/x",
    ]
    pages = ["http://other.example.org/es/y/z", "http://A.example.net/xx/y/z", "http://a.example.net/d/q", "http://a.example.net", "http://a.example.net/es2"]
    for u in pages:
        for k, t in enumerate(targets):
            form = link if k % 2 else refresh
            rows.append((len(rows) + 1, f"{u}/{len(rows)}" if u.count("/") > 2 else f"{u}?{len(rows)}", form.format(t)))
            rows.append((len(rows) + 1, f"{u}/c{len(rows)}" if u.count("/") > 2 else f"{u}?c{len(rows)}", f"<!-- {form.format(t)} --><script>{form.format(t)}</script>{link.format('/nothing')}{form.format(t) if k % 3 else ''}"))
    rows += [(len(rows) + 1, None, link.format(blocked)), (len(rows) + 2, "no scheme", link.format(blocked)), (len(rows) + 3, "http://q.org/", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"file://{tmp_path}/pages.parquet")
    got = {tuple(r) for r in queries.op4_url_filter(spark, f"file://{tmp_path}").select("page_id", "host", "path", "rule", "verdict").collect()}
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = con.sql(f"select page_id, host, path, rule, verdict from ({queries.ORACLES['op4_url_filter']})").fetchall()
    assert got == set(want) and len(want) == len(rows) and sum(r[4] == "block" and r[3] is None for r in want) > 60


@pytest.mark.parametrize("page", ["<link " * 300_000 + "canonical>", "<meta refresh " * 100_000, "<link rel=canonical x " * 50_000 + ">", "<!-- canonical " * 100_000, "<script " * 200_000 + "refresh>"])
def test_pages_of_any_length_take_linear_time(spark, page):
    began = time.time()
    assert link_edges(spark.createDataFrame([("http://p.org/", page)], "url string, html string")).count() == 0 and time.time() - began < 30
