"""Steps whose work grew faster than their input, or was done several times for a row."""

import random

from pyspark.sql import functions as F

from wattgrid.functions.pages import term_changes
from wattgrid.operators import changes, rates, resolve
from wattgrid.queries import QUERIES
from wattgrid.sources import readers as S


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_spellings_of_single_urls_are_not_grouped(spark):
    given = [(i, f"https://{'www.' if i % 2 else ''}s{i}.example{('', '/', '/a?b=1', '/rates')[i % 4]}") for i in range(40)] + [(1, "http://other.example/"), (2, None), (3, given_3 := "https://www.s3.example/rates"), (None, "http://n.example")]
    out = resolve.url_rewrites(spark.createDataFrame(given, "source_id long, url string"), ["/rates", "/tariffs"])
    want = {}
    for i, url in given:
        if url is None:
            continue
        scheme, rest = url.split("://")
        host = rest.split("/")[0]
        swap = ("http" if scheme == "https" else "https") + "://" + rest
        www = url.replace("://www.", "://") if host.startswith("www.") else url.replace("://", "://www.")
        for k, u in enumerate([swap, url.split("?")[0], www, f"{scheme}://{host}/", f"{scheme}://{host}/rates", f"{scheme}://{host}/tariffs"]):
            if u != url:
                want[i, u] = min(k, want.get((i, u), 9))
    rows = out.collect()
    assert {(r.source_id, r.url): r.prio for r in rows} == want and len(rows) == len(want) and given_3
    assert "_n" in plan(out).split("Aggregate")[0] and "Union" in plan(out).split("Aggregate")[0]


def test_rate_types_work_out_the_schedule_once(spark):
    rows = spark.range(3).select(F.col("id"), F.lit(None).cast("array<array<int>>").alias("e"))
    schedule = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda m: F.array((m + F.col("id")).cast("int")))
    out = rows.select(rates.rate_type(F.col("e"), schedule, F.col("id") == 1).alias("k"))
    assert plan(out).count("sequence(") + plan(out).count("transform([0,1,2") <= 1
    assert [r.k for r in out.collect()] == ["seasonal_tou", "demand_tou", "seasonal_tou"]


def test_names_of_a_report_are_put_together_once_per_key(spark):
    addresses = spark.createDataFrame([(1, "r", "a", "f", 1.0, 2.0, None, 7), (2, "r", "b", "f", None, 2.0, "x", 7), (3, "r", "c", None, 1.0, 2.0, None, 8)], "address_id long, region string, address string, formatted string, latitude double, longitude double, error string, zip long")
    found = spark.createDataFrame([(7, 2, "B", "zip_code", 0), (7, 1, "A", "polygon", 3)], "zip long, place long, name string, match_method string, n_tariffs long")
    got = {r.address: (r.utilities_found, r.utility_names, r.match_methods, r.has_tariffs) for r in S.lookup_results(addresses, found, "zip").collect()}
    assert got == {"a": (2, "A; B", "polygon; zip_code", "yes"), "b": (2, "A; B", "polygon; zip_code", "yes"), "c": (0, "", "", "no")}


def greedy(pairs):
    want = set()
    for g in {p[0] for p in pairs}:
        left, right = set(), set()
        for _, l, r, a, b in sorted((p for p in pairs if p[0] == g), key=lambda p: (abs(p[3] - p[4]), p[1], p[2])):
            if l not in left and r not in right:
                left.add(l), right.add(r), want.add((g, l, r, a, b))
    return want


def test_nearest_components_of_small_and_large_groups(spark, monkeypatch):
    rnd = random.Random(6)
    side = {(g, k): rnd.randrange(30) / 10 for g in range(30) for k in range(12)}
    pairs = [(g, l, r, side[g, l], side[29 - g, r]) for g in range(30) for l in range(g % 7) for r in range(g % 5 + 1)]
    df = spark.createDataFrame([(*p, "energy") for p in pairs], "g long, want_no long, got_no long, want double, got double, component_type string")
    for few in (1000, 9, 0):
        monkeypatch.setattr(changes, "FEW_PAIRS", few)
        rows = changes.nearest_components(df, ["g"]).collect()
        assert {(r.g, r.want_no, r.got_no, r.want, r.got) for r in rows} == greedy(pairs) and len(rows) == len(greedy(pairs))


def test_nearest_components_query_is_the_greedy_one_in_one_shuffle(spark, sf):
    out = QUERIES["nearest_components"](spark, sf)
    lines = {}
    for r in spark.read.parquet(f"{sf}/lineitem.parquet").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").collect():
        lines.setdefault(r.l_orderkey, []).append(r)
    pairs = [((o, a.l_returnflag), i + 1, j + 1, float(a.l_discount), float(b.l_tax)) for o, rows in lines.items() for i, a in enumerate(rows) for j, b in enumerate(rows) if a.l_returnflag == b.l_returnflag]
    assert {((r.id, r.component_type), r.want_no, r.got_no, r.want, r.got) for r in out.collect()} == greedy(pairs)
    assert plan(out).count("Join") <= 1


def test_merged_names_compare_a_name_of_a_group_once(spark, monkeypatch):
    sizes, cut = [], changes.Scratch.cut
    monkeypatch.setattr(changes.Scratch, "cut", lambda self, df, *more: (lambda t: (sizes.append(t.count()), t)[1])(cut(self, df, *more)))
    extra = spark.range(300).select(F.lit(1).alias("u"), F.when(F.col("id") % 2 == 0, "Rate A").otherwise("Rate A plus").alias("n"), F.col("id").alias("at"))
    kept = changes.merge_new_names(spark.createDataFrame([(1, "Rate")], "u long, n string").where("1 = 0"), extra, "u", "n", "at")
    assert [(r.n, r.at) for r in kept.collect()] == [("Rate A", 0)] and max(sizes) < 10


def test_texts_are_split_once_for_their_changes(spark):
    rows = spark.createDataFrame([(None, "a"), ("", "a"), ("a b", None), ("a b", ""), ("a b", "b  a"), ("a b b", "b c c d"), ("x", "x y")], "o string, n string")
    out = rows.select(term_changes(F.col("o"), F.col("n")).alias("c"))
    assert plan(out).count("split(") == 2
    first, gone, same = "Initial check - no previous content to compare", "Content became unavailable", "Content changed (details in full diff)"
    assert [r.c for r in out.collect()] == [first, first, gone, gone, same, "New terms: c, d; Removed terms: a", "New terms: y"]


def test_answers_are_parsed_once(spark):
    answers = [(1, 'x [{"name": "A"}, null] y'), (2, '{"name": "B", "components": []}'), (3, "none"), (4, None), (5, "[]"), (6, '```json\n{"name": "C"}\n``` [{"name": "D"}]'), (7, '[1] {"name": "E"}')]
    out = S.read_responses(spark.createDataFrame(answers, "id long, answer string"), "answer")
    seen = out.where("found is not null").select("id", F.col("found")[0]["name"].alias("name"), F.size("found").alias("n"))
    assert plan(seen).count("from_json") == 2
    got = {r.id: r.found and [t and t.name for t in r.found] for r in out.collect()}
    assert got[1] == ["A", None] and got[2] == ["B"] and got[3] is None and got[4] is None and got[5] == [] and got[6] == ["C"]
    found, rejects = S.parse_responses(spark.createDataFrame(answers, "id long, answer string"), "id", "answer")
    assert {(r.id, r.name) for r in found.collect()} >= {(1, "A"), (2, "B"), (6, "C")} and {r.id for r in rejects.collect()} >= {3, 4}


def test_plain_dates_and_ids_are_not_parsed_as_objects(spark):
    given = [{"_id": "r1", "startdate": "2020-01-02T00:00:00.000Z"}, {"_id": ' {"$oid": "r2"}', "startdate": ' {"$date": "2020-01-03T00:00:00.000Z"}'}, {"label": "r3", "startdate": "1577836800"}, {"_id": "[1]", "startdate": "?"}]
    out = S.normalize_bulk(spark.createDataFrame([(r,) for r in given], "r map<string,string>")).select("label", F.date_format("startdate", "yyyy-MM-dd").alias("d"))
    assert plan(out).count("RLIKE") >= 2
    assert [tuple(r) for r in out.collect()] == [("r1", "2020-01-02"), ("r2", "2020-01-03"), ("r3", "2020-01-01"), ("[1]", None)]
