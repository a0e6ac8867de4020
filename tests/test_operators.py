"""Operators over literal frames, at the edges."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from wattgrid.functions import elements, lists as L
from wattgrid.functions import pages, text as X
from wattgrid.functions.components import connected_components
from wattgrid.functions.scratch import Scratch
from wattgrid.operators import changes, geo, rates, relational as R, resolve


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize("a,b,same", [
    ("SC1C (TOU) - Zone A", "Service Classification No. 1C - Time of Use Residential", True),
    ("Rate D", "Rate DP", False), ("Rate D", "Rate D Service", True), ("E-1", "Schedule E-1", True), ("Demand Billing", "Non-Demand Billing", False),
    ("", "x", False), (None, None, False), ("Residential Service - applies when a meter is read", "Residential Service", True), ("General Service Small", "General Service Large", False),
])
def test_likely_same(spark, a, b, same):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(X.likely_same(F.col("a"), F.col("b")).alias("x")).first().x is same


@pytest.mark.parametrize("message,url,want", [("HTTP 403", "http://a", "403_forbidden"), (None, "http://a", "other"), ("404", "http://PLACEHOLDER", "placeholder_url"), ("Connection refused", "u", "connection_error"), ("Read timed out", None, "timeout"), ("odd", "u", "other")])
def test_error_category(spark, message, url, want):
    df = spark.createDataFrame([(message, url)], "m string, u string")
    assert df.select(X.error_category(F.col("m"), F.col("u")).alias("x")).first().x == want


def test_text(spark):
    assert one(spark, X.normalized_page(F.col("t")), t=" A  b\n1/2/2024 2024-01-02 C ") == "a b   c"
    assert one(spark, X.host(F.col("u")), u="https://WWW.a.b/c?d") == "a.b" and one(spark, X.is_homepage(F.col("u")), u="https://a.b?x") is True
    assert one(spark, X.is_gas_only(F.col("n")), n="Natural Gas Service") is True and one(spark, X.is_gas_only(F.col("n")), n="Gas turbine electric") is False
    assert one(spark, X.page_priority(F.col("t")), t="Energy charge: $0.10 per kWh") == 0 and one(spark, X.page_priority(F.col("t")), t="nothing") == 3
    assert one(spark, X.is_comparison_page(F.col("u")), u="http://a/electricity_rates-comparison") is True
    assert one(spark, X.is_comparison_page(F.col("u")), u="http://a/rates-comparison") is False
    assert one(spark, X.is_comparison_page(F.col("u")), u="http://a/Electricity%20Prices/electricity_prices-2031.pdf") is True
    assert sorted(one(spark, X.rate_codes(F.col("n")), n="Schedule D-1 (E-1)")) == ["d-1", "d1", "e-1", "e1"]
    day = F.lit("2024-01-01").cast("date")
    assert one(spark, X.freshness(F.lit(None).cast("date"), F.lit("2023-12-31").cast("date"), day)) == "current" and one(spark, X.freshness(F.lit(None).cast("date"), F.lit(None).cast("date"), day)) == "stale"


def test_pages(spark):
    html = '<a href="/rates/residential">Rates</a><a href="#top">t</a><a href="http://other.org/x">o</a><a href="/rates/residential#a">again</a><a href="b.pdf"><b>doc</b></a>'
    got = pages.links(spark.createDataFrame([(1, "http://a.com/x/y", html), (2, None, None)], "page_id long, url string, html string")).orderBy("place").collect()
    assert [(r.target, r.priority) for r in got] == [("http://a.com/rates/residential", 0), ("http://a.com/x/b.pdf", 2)]
    assert pages.capped_links(spark.createDataFrame([(1, 0, "t", "l", 1)], "page_id long, place int, target string, label string, priority int")).count() == 1
    table = "<table><tr><th>Name</th><th>Rate</th></tr><tr><td>Tier 1</td><td>8.7&cent;</td></tr><tr><td>short</td></tr></table>"
    got = elements.table_rows(spark.createDataFrame([(1, table)], "page_id long, html string")).orderBy("row_no").collect()
    assert [r.cells for r in got] == [{"Name": "Tier 1", "Rate": "8.7&cent;"}, {"Name": "short"}]
    assert one(spark, pages.dollars(F.col("t")), t="8.7 cents") == 0.087 and one(spark, pages.dollars(F.col("t")), t="$1,200") is None
    assert one(spark, pages.effective_date(F.col("t")), t="Effective May 1, 2024") == dt.date(2024, 5, 1) and one(spark, pages.effective_date(F.col("t")), t="none") is None
    assert one(spark, pages.term_changes(F.col("a"), F.col("b")), a="x y", b="y z") == "New terms: z; Removed terms: x" and one(spark, pages.term_changes(F.col("a"), F.col("b")), a="", b="y").startswith("Initial")
    text = "filler " * 3000 + "energy charge $0.10 per kWh" + " filler" * 3000
    got = {r.id: r.window for r in pages.rate_windows(spark.createDataFrame([(1, text), (2, "short")], "id long, text string"), "id", "text").collect()}
    assert "energy charge $0.10" in got[1] and len(got[1].replace(pages.LEFT_OUT, "").strip("\n")) <= 30_000 and got[2] == "short"
    gate = pages.gate(F.col("u"), F.col("t"), F.lit(False))
    assert one(spark, gate, u="http://a", t="x") == "thin" and one(spark, gate, u="http://a", t="x" * 200) == "no signal" and one(spark, gate, u="http://a/wholesale", t="$ 5" * 100) == "irrelevant"
    assert one(spark, pages.request_tier(F.lit("x"), F.lit(True))) == "B" and len(one(spark, pages.cache_key(F.lit("h"), "m", "1"))) == 64


def test_rates(spark):
    flat, varied, seasons = [[0] * 24] * 12, [[0] * 12 + [1] * 12] * 12, [[m // 6] * 24 for m in range(12)]
    rows = [(1, [[{"rate": 1.0}]], flat, False, "flat"), (2, [[{"rate": 1.0}, {"rate": 2.0}]], flat, False, "tiered"), (3, [[{"rate": 1.0}]], varied, True, "demand_tou"), (4, [[{"rate": 1.0}]], seasons, False, "seasonal_tou"), (5, None, None, True, "demand"), (6, None, None, None, "flat"), (7, [[{"rate": 1.0}, {"rate": 2.0}]], varied, False, "tou_tiered")]
    df = spark.createDataFrame(rows, "id long, e array<array<struct<rate:double>>>, s array<array<int>>, d boolean, want string")
    assert all(r.got == r.want for r in df.select("want", rates.rate_type(F.col("e"), F.col("s"), F.col("d")).alias("got")).collect())
    record = [(1, 5.0, None, None, "$/day", [[{"rate": 0.1, "adj": 0.0, "max": 100.0, "unit": "kWh"}, {"rate": 0.2, "adj": 0.5, "max": None, "unit": None}]], [[{"rate": 3.0, "adj": None, "max": None, "unit": None}]], None, "kW")]
    tier = "array<array<struct<rate:double,adj:double,max:double,unit:string>>>"
    df = spark.createDataFrame(record, f"id long, fixedchargefirstmeter double, mincharge double, fixedchargeunits string, minchargeunits string, energyratestructure {tier}, demandstructure {tier}, flatdemandstructure {tier}, demandunits string")
    got = {(r.component_type, r.rate_value): (r.tier_min_kwh, r.tier_max_kwh, r.adjustment, r.unit) for r in rates.explode_components(df).collect()}
    assert got == {("fixed", 5.0): (None, None, None, "$/month"), ("energy", 0.1): (None, 100.0, None, "kWh"), ("energy", 0.2): (100.0, None, 0.5, "kWh"), ("demand", 3.0): (None, None, None, "kW")}


def test_validation(spark):
    tariffs = spark.createDataFrame([(1, "A", "residential", "flat", "TX"), (2, "Proposed rate B", "residential", "flat", "TX"), (3, None, "farm", "odd", "NY"), (4, "D", "commercial", "flat", "NY"), (5, "E", "residential", "flat", None)], "id long, name string, customer_class string, rate_type string, state string")
    parts = spark.createDataFrame([(1, "energy", 0.0), (1, "energy", -0.1), (2, "fixed", 5.0), (4, "energy", 0.005), (4, "fixed", -1.0), (5, "energy", 0.9)], "tariff_id long, component_type string, rate_value double")
    bounds = spark.createDataFrame([(None, 0.5, 0.6, 50.0, 60.0, 20.0, 30.0), ("NY", 0.2, 0.3, 50.0, 60.0, 20.0, 30.0)], "state string, p95_energy double, p99_energy double, p95_fixed double, p99_fixed double, p95_demand double, p99_demand double")
    got = rates.validate(tariffs, parts, bounds)
    by = {r.id: r for r in got.collect()}
    assert by[1].valid and not by[1].needs_review and by[5].valid and by[5].needs_review
    assert by[2].issues == ["proposed or pending"] and len(by[3].issues) == 4 and len(by[4].issues) == 2
    assert rates.validation_report(got).first().asDict() == {"total": 5, "valid": 2, "invalid": 3, "flagged": 1, "has_residential": True, "has_commercial": False}


def test_lists(spark):
    bounds = {r.state: (r.p95_energy, r.p99_demand) for r in rates.state_bounds(spark).collect()}
    assert bounds[None] == (0.35, 80.0) and bounds["HI"] == (0.5, 100.0) and len(L.US_STATES) == 51 and len(L.STATE_BATCHES) == 15
    assert one(spark, rates.stored_type(F.col("k")), k="tou_demand") == "complex" and one(spark, rates.stored_type(F.col("k")), k="tou") == "tou"
    names = [(n, s, "CA") for n, s in L.CA_PROVINCES.items()] + [(n, s, "US") for n, s in L.US_STATES.items()]
    assert tuple(one(spark, geo.parse_place(F.col("a"), names, False), a="Ontario, California")) == ("ON", "CA")
    listed = spark.createDataFrame([(d,) for d in L.THIRD_PARTY_DOMAINS], "domain string")
    rows = spark.createDataFrame([("https://en.wikipedia.org/x",), ("https://acme.com",)], "url string")
    assert {r.url: r.is_blocked for r in resolve.blocked(rows, "url", listed).collect()} == {"https://en.wikipedia.org/x": True, "https://acme.com": False}


def test_relational(spark):
    rows = spark.createDataFrame([(1, 1, "a", dt.date(2024, 1, 1), None), (2, 1, "a", dt.date(2024, 1, 1), dt.date(2025, 1, 1)), (3, 1, "a", None, None)], "id long, u long, n string, s date, e date")
    newest = R.newest_version(rows, ["u", "n"], "s", "e", "id")
    assert [r.id for r in newest.collect()] == [1] and R.newest_version(newest, ["u", "n"], "s", "e", "id").count() == 1
    calls = spark.createDataFrame([(1, i, i not in (3, 4, 5)) for i in range(10)], "k long, i long, hit boolean")
    assert sorted(r.i for r in R.budgeted(calls, ["k"], ["i"], F.lit(1), 8, F.col("hit"), 3).collect()) == [0, 1, 2, 3, 4, 5]
    span = R.best_span(spark.createDataFrame([(1, i, float(v)) for i, v in enumerate([1, 5, 5, 1, 5, 5])], "k long, i long, v double"), "k", "i", F.col("v"), 2).first()
    assert (span.first, span.score) == (1, 10.0)


def test_changes(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "u long, n string, d string")
    new = spark.createDataFrame([(1, "a", "", 2), (3, "c", "z", 1), (4, "d", "w", 0)], "u long, n string, d string, n_components int")
    got = changes.upsert(old, new, ["u", "n"], ["d"])
    assert {(r.u, r.d, r.action) for r in got.collect()} == {(1, "x", "updated"), (2, "y", "kept"), (3, "z", "added"), (4, None, "rejected")}
    existing = spark.createDataFrame([(g, f"n{i}") for g in (1, 2) for i in range(100)], "g long, n string")
    stored = spark.createDataFrame([(1, f"n{i}", i == 0) for i in range(74)] + [(2, f"n{i}", i == 0) for i in range(75)], "g long, n string, home boolean")
    gone = changes.reconcile(stored, existing, "g", ["g", "n"], F.col("home"))
    assert {r.g for r in gone.collect()} == {2} and gone.count() == 25
    names = spark.createDataFrame([(1, 1, "rate d", 1, 1), (1, 2, "rate d service", 2, 2), (1, 3, "rate dp", 1, 1), (1, 4, "rate d", 1, 5)], "u long, id long, n string, c long, t long")
    assert {(r.id, r.merged_into) for r in changes.absorb_duplicates(names, ["u"], "id", "n", "c", "t").collect()} == {(1, 4), (4, 2), (2, 2), (3, 3)}
    known = spark.createDataFrame([(1, "u", "h", None, None), (2, "v", "h", None, None)], "utility_id long, url string, content_hash string, checked_at timestamp, changed_at timestamp")
    seen = spark.createDataFrame([(1, "u", "h"), (3, "w", "k")], "utility_id long, url string, content_hash string")
    first = changes.upsert_fingerprints(known, seen, "2024-01-01")
    again = changes.upsert_fingerprints(first, seen, "2024-01-01")
    assert sorted(first.collect()) == sorted(again.collect()) or {tuple(r) for r in first.collect()} == {tuple(r) for r in again.collect()}
    assert {r.utility_id for r in first.collect() if r.changed_at} == {3}
    extra = spark.createDataFrame([(1, "Rate D", 0), (1, "Other", 1), (1, "Other plan", 2)], "u long, n string, at long")
    kept = changes.merge_new_names(spark.createDataFrame([(1, "Rate D Service")], "u long, n string"), extra, "u", "n", "at")
    assert [r.n for r in kept.collect()] == ["Other"]
    pairs = spark.createDataFrame([(1, 0, 0, "fixed", 10.0, 14.0), (1, 0, 1, "fixed", 10.0, 11.0), (1, 1, 1, "fixed", 11.0, 11.0), (1, 1, 0, "fixed", 11.0, 14.0)], "g long, want_no int, got_no int, component_type string, want double, got double")
    assert {(r.want_no, r.got_no, r.close) for r in changes.nearest_components(pairs, ["g"]).collect()} == {(1, 1, True), (0, 0, True)}
    labelled, kept = changes.sweep({"A": old.where("u = 1").withColumnRenamed("u", "id"), "B": old.withColumnRenamed("u", "id")}, old.withColumnRenamed("u", "id"))
    assert {(r.id, r.category) for r in labelled.collect()} == {(1, "A"), (2, "B")} and kept.count() == 0
    assert {(r.u, r.d) for r in changes.update_values(old, spark.createDataFrame([(1, "http://n"), (2, "bad")], "u long, d string"), "u", "d", F.col("d").rlike("^https?://[^/]+")).collect()} == {(1, "http://n"), (2, "y")}


def test_geography(spark):
    square = [[[[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 4.0], [0.0, 0.0]], [[1.0, 1.0], [2.0, 1.0], [2.0, 2.0], [1.0, 2.0], [1.0, 1.0]]]]
    edges = geo.rings(spark.createDataFrame([(7, square)], "id long, geometry array<array<array<array<double>>>>")).withColumnRenamed("id", "territory_id")
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.5, 1.5), (3, 5.0, 1.0), (4, 3.0, 1.0)], "point_id long, x double, y double")
    assert {r.point_id for r in geo.points_in(points, edges, 0.7).collect()} == {1, 4}
    assert one(spark, geo.zip_code(F.col("a")), a="10000 Main St, VA 22031-1234") == "22031" and one(spark, geo.zip_code(F.col("a"), True), a="10000 Main St 22031") == "10000"
    assert one(spark, geo.postal_prefix(F.col("a")), a="x K1a 0B1") == "K1A" and one(spark, geo.postal_prefix(F.col("a")), a="M5V only") == "M5V" and one(spark, geo.postal_prefix(F.col("a")), a="none") is None
    names = [("virginia", "VA", "US"), ("west virginia", "WV", "US"), ("ontario", "ON", "CA"), ("california", "CA", "US")]
    place = lambda longest: geo.parse_place(F.col("a"), names, longest)
    assert tuple(one(spark, place(True), a="5 Rd, West Virginia")) == ("WV", "US") and tuple(one(spark, place(False), a="5 Rd, West Virginia")) == ("VA", "US") and tuple(one(spark, place(True), a="12 King St, ON, Canada")) == ("ON", "CA")
    t = spark.createDataFrame([(1, 10, ["22031"], ["K1A", "M"])], "id long, utility_id long, zip_codes array<string>, postal_code_prefixes array<string>")
    a = spark.createDataFrame([(1, "22031", None), (2, None, "M5V"), (3, None, None)], "address_id long, zip string, prefix string")
    assert [tuple(r) for r in geo.by_zip(a, t).collect()] == [(1, 10)] and [r.address_id for r in geo.by_postal_prefix(a, t).collect()] == [2]


def test_resolving(spark):
    u = spark.createDataFrame([(1, 100, "Acme Electric Company, Inc."), (2, 200, "Énergie Nord"), (3, 300, "Town of Acme Light")], "id long, eia_id long, name string")
    r = spark.createDataFrame([("a", 200, "whatever"), ("b", None, "Énergie Nord"), ("c", None, "ACME ELECTRIC COMPANY"), ("d", None, "Energie Nord North"), ("e", None, "Unknown"), ("f", None, None)], "label string, eiaid long, utility string")
    got = {x.label: (x.utility_id, x.how) for x in resolve.resolve_utilities(r, u).collect()}
    assert got == {"a": (2, "number"), "b": (2, "name"), "c": (1, "plain"), "d": (2, "inside"), "e": (None, None), "f": (None, None)}
    assert [x.name for x in resolve.missing_utilities(spark.createDataFrame([("acme electric",), ("New One",)], "name string"), u.select("name")).collect()] == ["New One"]
    results = spark.createDataFrame([(1, 0, "http://www.blocked.com/acme", "t", "d"), (1, 1, "http://sub.acme.com/rates", "Acme rates", "electric residential"), (1, 2, "http://acme.com/", "t", "d")], "utility_id long, position int, url string, title string, description string")
    domains = spark.createDataFrame([("blocked.com",)], "domain string")
    assert resolve.own_domain(results, u.select(F.col("id").alias("utility_id"), "name"), domains).first().host == "acme.com"
    scored = resolve.score_results(resolve.blocked(results, "url", domains).withColumns({"domain": F.lit("acme.com"), "utility": F.lit("Acme"), "state": F.lit("TX")}), {"TX": "texas", "AL": "alabama"}).collect()
    by = {x.position: x.score for x in scored}
    assert by[0] == -999 and by[1] > by[2]
    assert one(spark, resolve.wrong_state(F.col("u"), F.lit("NY"), {"NY": "new york", "AL": "alabama"}), u="http://a.com/al/x") is True and one(spark, resolve.wrong_state(F.col("u"), F.lit("NY"), {"NY": "new york", "AL": "alabama"}), u="http://a.com/ny/x") is False
    tries = resolve.url_rewrites(spark.createDataFrame([(1, "https://www.a.com/x?y")], "source_id long, url string"), ["/rates"])
    assert {x.url for x in tries.collect()} == {"http://www.a.com/x?y", "https://www.a.com/x", "https://a.com/x?y", "https://www.a.com/", "https://www.a.com/rates"}
    foreign = resolve.foreign_names(spark.createDataFrame([(1, "Metro plan", "Acme"), (2, "Metro plan", "Metro Power"), (3, "x", "Acme")], "id long, name string, utility string"), ["metro"])
    assert {(x.id, x.foreign) for x in foreign.collect()} == {(1, True), (2, False), (3, False)}
    order = resolve.alternate_order(spark.createDataFrame([(1, "http://a/x/1", 0), (1, "http://a/x/2", 1), (1, "http://b/", 2)], "utility_id long, url string, rank int")).orderBy("place").collect()
    assert [x.rank for x in order] == [0, 2, 1]


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(200, 201), (201, 201), (None, 5)], "a long, b long")
    got = {r.id: r.component_id for r in connected_components(edges, Scratch(spark, "t")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 200: 200, 201: 200} and connected_components(edges.where("1=0"), Scratch(spark, "t")).count() == 0


def test_reasons_touches_and_benchmarks(spark):
    names = ["pages", "sent", "zero", "failed", "thin", "off_topic", "no_signal"]
    rows = [(0, 0, 0, 0, 0, 0, 0, True, False), (5, 0, 0, 0, 1, 0, 4, False, False), (5, 5, 5, 0, 0, 0, 0, False, True), (3, 2, 0, 2, 0, 0, 0, False, False), (3, 2, 1, 0, 0, 0, 0, False, False)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} int" for n in names) + ", had_page boolean, aborted boolean")
    got = [r.x for r in df.select(pages.failure_reason({c: F.col(c) for c in df.columns}).alias("x")).collect()]
    assert [g.split(" ")[0] for g in got] == ["No", "No", "LLM", "LLM", "Extracted"] and "aborted early" in got[2] and "4 pages had no rate content signals; 1 pages had too little content" in got[1]
    t = spark.createDataFrame([(1, None), (2, None)], "utility_id long, last_verified date")
    assert {(r.utility_id, str(r.last_verified)) for r in changes.touch_verified(t, t.where("utility_id = 1"), "utility_id", "2024-01-01").collect()} == {(1, "2024-01-01"), (2, "None")}
    e = spark.createDataFrame([(1, 1), (1, 2), (2, 3)], "utility_id long, id long")
    m = spark.createDataFrame([(1, 1, 9), (2, 3, 8)], "utility_id long, want long, got long")
    c = spark.createDataFrame([(1, False), (2, True)], "utility_id long, close boolean")
    assert changes.benchmark_summary(e, e, m, c).first().asDict() == {"recall": 66.7, "precision": 66.7, "rate_errors": 1, "perfect": 1}


def test_greedy_matches_take_pairs_in_order(spark):
    import random

    rng = random.Random(4)
    rows = list({(g, a, b): (g, a, b, rng.randint(0, 4)) for g in range(6) for a in range(8) for b in range(8) if rng.random() < 0.4}.values())
    want, used = set(), set()
    for g, a, b, r in sorted(rows, key=lambda x: (x[0], x[3], x[1], x[2])):
        if ("l", g, a) not in used and ("r", g, b) not in used:
            used |= {("l", g, a), ("r", g, b)}
            want.add((g, a, b))
    df = spark.createDataFrame([*rows, (None, 1, 1, 0), (1, None, 1, 0)], "g long, a long, b long, r int")
    assert {tuple(x) for x in changes.greedy_matches(df, "g", "a", "b", ["r"]).collect()} == want
    assert changes.greedy_matches(df.where("1 = 0"), "g", "a", "b", ["r"]).count() == 0


def test_candidates_in_the_order_of_the_wanted(spark):
    wanted = spark.createDataFrame([(1, 1, "Residential", "r"), (1, 2, "Residential Service Plan", "r"), (1, 3, "Small Farm Pumps", "r"), (1, 4, "Farm", "c")], "utility_id long, id long, name string, customer_class string")
    found = spark.createDataFrame([(1, 10, "Residential Service", "r"), (1, 11, "residential", "r"), (1, 12, "Pumps, Small", "r"), (1, 13, "Farm", "r")], "utility_id long, id long, name string, customer_class string")
    pairs = changes.match_candidates(wanted, found)
    assert {(r.want, r.got) for r in changes.greedy_matches(pairs, "utility_id", "want", "got", ["want", "stage", "overlap"]).collect()} == {(1, 11), (2, 10), (3, 13)}
    assert {(r.want, r.got): r.stage for r in pairs.collect()} == {(1, 10): 1, (1, 11): 0, (2, 10): 1, (2, 11): 1, (3, 12): 2, (3, 13): 1}


def test_rejected_names_stand_in_nobodys_way(spark):
    import random

    from wattgrid.functions.text import plain_name

    def kept(existing, extra):
        taken, out = list(existing), []
        for n in extra:
            if not any(n.startswith(t) or t.startswith(n) for t in taken):
                taken.append(n)
                out.append(n)
        return out

    rng = random.Random(9)
    groups = {1: (["rate d service"], ["rate d", "rate d x", "other", "other plan"])}
    for g in range(2, 12):
        name = lambda: "".join(rng.choice("ab ") for _ in range(rng.randint(1, 5))).strip() or "c"  # noqa: E731, B023
        groups[g] = ([name() for _ in range(rng.randint(0, 2))], [name() for _ in range(rng.randint(1, 9))])
    e = spark.createDataFrame([(g, n) for g, (a, _) in groups.items() for n in a], "u long, n string")
    x = spark.createDataFrame([(g, n, i) for g, (_, b) in groups.items() for i, n in enumerate(b)], "u long, n string, at long")
    plain = {n: r for n, r in x.union(e.selectExpr("u", "n", "0L")).select("n", plain_name(F.col("n"))).collect()}
    got = {}
    for r in changes.merge_new_names(e, x, "u", "n", "at").orderBy("u", "at").collect():
        got.setdefault(r.u, []).append(plain[r.n])
    assert got == {g: k for g, (a, b) in groups.items() if (k := kept([plain[n] for n in a], [plain[n] for n in b]))}
    assert got[1] == ["rate d x", "other"] or got[1] == ["other"]


def test_containment(spark):
    names = ["a", "ab", "abcdef", "xabcdefy", "duke", "dukeenergy carolinas", "", None, "é", "bcdefy"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    real = [n for n in names if n]
    assert {tuple(r) for r in resolve.contained_names(df, df).collect()} == {(a, b) for a in real for b in real if a in b or b in a}


def test_text_rules(spark):
    assert one(spark, X.compressed(F.col("t")), t=" a \t b \n\n\n\n c ") == "a b\n\nc"
    assert one(spark, geo.looks_canadian(F.col("a")), a="Portage MB SK") is True and one(spark, geo.looks_canadian(F.col("a")), a="12 Ontario St, CA") is False and one(spark, geo.looks_canadian(F.col("a")), a="x K1A 0B1") is True
    gone = changes.supersede(spark.createDataFrame([(1, 1, "Rate D"), (1, 2, "Rate DP"), (2, 3, "Rate D")], "u long, id long, name string"), spark.createDataFrame([(1, 9, "Rate D Service"), (1, 8, "Rate D Service")], "u long, id long, name string"), ["u"])
    assert {tuple(r) for r in gone.collect()} == {(1, 8)}
    sources = changes.insert_missing_sources(spark.createDataFrame([(1, True), (2, False), (3, True), (4, True)], "id long, is_active boolean"), spark.createDataFrame([(3,)], "utility_id long"), spark.createDataFrame([(1, "u"), (2, "v"), (3, "w"), (4, None)], "id long, url string"))
    assert [tuple(r) for r in sources.collect()] == [(1, "u", "pending")]
    best = resolve.best_url(spark.createDataFrame([(1, "s"), (2, None), (3, "t")], "id long, website_url string"), spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "", 3), (3, None, 1)], "utility_id long, source_url string, updated_at int"))
    assert {tuple(r) for r in best.collect()} == {(1, "b"), (2, None), (3, "t")}


@pytest.mark.parametrize("cell", [0.05, 0.3, 5.0])
def test_points_in_random_polygons(spark, cell):
    import numpy as np

    rng = np.random.default_rng(7)
    shapes = []
    for k in range(12):
        n = int(rng.integers(3, 12))
        angle = np.sort(rng.uniform(0, 2 * np.pi, n))
        ring = rng.uniform(-1, 1, 2) + np.c_[np.cos(angle), np.sin(angle)] * rng.uniform(0.1, 1.2, (n, 1))
        if k % 3 == 0:
            ring = np.round(ring * 10) / 10  # corners on the lines of the grid
        shapes.append((k, [[[*ring.tolist(), ring[0].tolist()]]]))
    square = [[-0.6, -0.6], [0.6, -0.6], [0.6, 0.6], [-0.6, 0.6], [-0.6, -0.6]]
    shapes.append((12, [[square, [[0.5 * v for v in p] for p in square]]]))
    at = rng.uniform(-2, 2, (400, 2))
    want = set()
    for k, polygons in shapes:
        for i, (x, y) in enumerate(at):
            n = sum((y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 for rings in polygons for ring in rings for (x1, y1), (x2, y2) in zip(ring, ring[1:]))
            if n % 2:
                want.add((i, k))
    edges = geo.rings(spark.createDataFrame(shapes, "id long, geometry array<array<array<array<double>>>>")).withColumnRenamed("id", "territory_id")
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(at)] + [(900, None, 0.0), (901, float("nan"), 0.0)], "point_id long, x double, y double")
    assert {tuple(r) for r in geo.points_in(points, edges, cell).collect()} == want and len(want) > 200
