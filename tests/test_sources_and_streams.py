"""Readers over small files, and streams beside their batch twins."""

import gzip
import json

from pyspark.sql import functions as F

from wattgrid.sources import readers as S
from wattgrid.streaming import checks as C

RECORDS = [
    {"_id": {"$oid": "x1"}, "eiaId": 5, "utilityName": "A", "rateName": "R", "sector": "Residential", "effectiveDate": {"$date": "2020-01-02T00:00:00Z"}, "energyRateStrux": [{"energyRateTiers": [{"rate": 0.1, "max": 5}, {"rate": 0.2}]}], "country": "CAN"},
    {"_id": "x2", "eiaid": 6, "utility": "B", "name": "S", "startdate": 1577836800, "energyratestructure": [[{"rate": 0.3}]], "fixedchargefirstmeter": 7.5, "country": "USA"},
]


def test_bulk(spark, tmp_path):
    for name, body in (("a.json", RECORDS), ("b.json", {"items": RECORDS})):
        (tmp_path / name).write_text(json.dumps(body))
        with gzip.open(tmp_path / f"{name}.gz", "wt") as f:
            json.dump(body, f)
        for path in (name, f"{name}.gz"):
            rows = S.normalize_bulk(S.read_bulk_rates(spark, str(tmp_path / path))).orderBy("label").collect()
            assert [(r.label, r.eiaid, r.utility, r.name, r.customer_class, str(r.startdate)[:10]) for r in rows] == [("x1", 5, "A", "R", "residential", "2020-01-02"), ("x2", 6, "B", "S", None, "2020-01-01")]
            assert [len(r.energyratestructure[0]) for r in rows] == [2, 1] and rows[0].energyratestructure[0][0].max == 5 and rows[1].fixedchargefirstmeter == 7.5
    assert S.only_canada(S.normalize_bulk(S.read_bulk_rates(spark, str(tmp_path / "a.json")))).count() == 1


def test_master(spark, tmp_path):
    (tmp_path / "u.csv").write_text("UTILITY NUMBER,Utility Name,State,Ownership Type\n12.0, A ,TX,Municipal\n12,A again,TX,\n,none,TX,\n13,B,,Odd\n")
    rows, rejects = S.read_utility_master(spark, str(tmp_path / "u.csv"), {"Municipal": "municipal"})
    assert {(r.eia_id, r.state, r.utility_type) for r in rows.collect()} == {(12, "TX", "municipal"), (13, "Unknown", "other")} and rejects.count() == 1
    assert S.new_rows(rows, spark.createDataFrame([(12,)], "eia_id long"), ["eia_id"]).count() == 1


def test_territories(spark, tmp_path):
    square = [[[0, 0], [1, 0], [1, 1], [0, 0]]]
    feature = lambda kind, c, z: {"properties": {"NAME": kind, "ID": "1", "STATE": "TX", "ZIP": z}, "geometry": {"type": kind, "coordinates": c}}
    (tmp_path / "t.json").write_text(json.dumps({"features": [feature("Polygon", square, "1, 2,"), feature("MultiPolygon", [square], None), feature("Point", [0, 0], "")]}))
    rows = {r.name: r for r in S.read_territories(spark, str(tmp_path / "t.json")).collect()}
    assert set(rows) == {"Polygon", "MultiPolygon"} and rows["Polygon"].geometry == rows["MultiPolygon"].geometry and rows["Polygon"].zip_codes == ["1", "2"] and rows["MultiPolygon"].zip_codes == []
    u = spark.createDataFrame([(1, "CA", "ON"), (2, "CA", "QC"), (3, "US", "ON")], "id long, country string, state string")
    assert [r.utility_id for r in S.province_territories(u, spark.createDataFrame([(2,)], "utility_id long"), {"ON": ["K", "L"], "QC": ["G"]}).collect()] == [1]


def test_answers(spark, tmp_path):
    body = {"utilities": [{"utility_id": 1, "name": "A", "state": "TX", "tariffs": [{"name": "R", "components": [{"component_type": "energy", "rate_value": 0.1}, {"component_type": "fixed", "rate_value": 5}]}]}]}
    (tmp_path / "g.json").write_text(json.dumps(body))
    assert [(r.tariff_no, r.component_no, r.rate_value) for r in S.read_ground_truth(spark, str(tmp_path / "g.json")).orderBy("component_no").collect()] == [(0, 0, 0.1), (0, 1, 5.0)]
    answers = [(1, '```json\n[{"name": "A", "components": [{"rate_value": 0.5}]}]\n```'), (2, 'Report: {"name": "B"} end'), (3, "nothing here"), (4, None), (5, "[]")]
    found, rejects = S.parse_responses(spark.createDataFrame(answers, "id long, answer string"), "id", "answer")
    assert {(r.id, r.name) for r in found.collect()} == {(1, "A"), (2, "B")} and {r.id for r in rejects.collect()} == {3, 4}


def test_logs_and_sinks(spark, tmp_path):
    (tmp_path / "log.txt").write_text("source_id=1 old_url=http://a/x new_url=http://a/\nsource_id=1 old_url=http://b/x new_url=http://b\nsource_id=2 old_url=http://c new_url=http://c/rates\nnoise\n")
    assert [tuple(r) for r in S.read_homepage_fixes(spark, str(tmp_path / "log.txt")).collect()] == [(1, "http://a/x", "http://a/")]
    errors = spark.createDataFrame([(1, 2, "u", "m")], "source_id long, utility_id long, url string, message string")
    S.write_summary(spark.createDataFrame([(3,)], "checked long"), errors, str(tmp_path / "s"))
    assert [r.message for r in S.read_error_details(spark, str(tmp_path / "s")).collect()] == ["m"]
    S.write_lookup_results(errors, str(tmp_path / "c"))
    S.write_snapshot(errors, str(tmp_path / "p"), "utility_id")
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == spark.read.parquet(str(tmp_path / "p")).count() == 1


def run(spark, stream, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_change_stream_equals_batch(spark, sf, tmp_path):
    checks = spark.read.parquet(f"{sf}/events.parquet").where("user_id % 5 = 0").select(F.col("user_id").alias("source_id"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("checked_at"), F.col("event_type").alias("content_hash"), (F.col("event_type") == "error").alias("failed"))
    checks.orderBy("checked_at", "id").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(checks.schema).parquet(str(tmp_path / "in"))
    got = {(r.id, r.outcome, r.review) for r in run(spark, C.stream_changes(stream), "changes").collect()}
    want = C.detect_changes(checks, "source_id", "checked_at", "id", "content_hash", "failed")
    assert got == {(r.id, r.outcome, r.review) for r in want.collect()} and len(got) > 10


def test_windows_and_runs(spark, tmp_path):
    rows = [(1, "changed", "2024-01-01 00:00:00"), (2, "error", "2024-01-02 00:00:00"), (3, "first", "2024-01-20 00:00:00"), (4, "first", "2024-03-01 00:00:00")]
    df = spark.createDataFrame(rows, "id long, outcome string, at string").select("id", "outcome", F.col("at").cast("timestamp").alias("checked_at"))
    df.coalesce(1).write.parquet(str(tmp_path / "w"))
    stream = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "w"))
    got = run(spark, C.stream_outcomes(stream()), "weeks").collect()
    assert sum(r.changed for r in got) == 1 and sum(r.errors for r in got) == 1
    new = run(spark, C.stream_new_pages(stream().select(F.lit("u").alias("url"), F.col("outcome").alias("content_hash"), F.col("checked_at").alias("fetched_at"))), "pages")
    assert new.count() == 3
    progress = run(spark, C.stream_run_progress(stream().select(F.lit(1).alias("run_id"), F.col("checked_at").alias("reported_at"), (F.col("outcome") == "error").alias("failed"))), "runs")
    assert progress.agg(F.sum("errors")).first()[0] == 1
    runs = spark.createDataFrame([(1, "2024-01-01 00:00:00", None), (2, "2024-01-01 09:00:00", None), (3, "2024-01-01 00:00:00", "2024-01-01 01:00:00")], "id long, a string, b string").select("id", F.col("a").cast("timestamp").alias("started_at"), F.col("b").cast("timestamp").alias("finished_at"))
    assert [r.id for r in C.stalled_runs(runs, "2024-01-01 10:00:00").collect()] == [1]


def test_bulk_records_by_line(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"label": "a", "tiers": [1]},\n{"label": "b"}\n]\n')
    (tmp_path / "b.json").write_text('{"label": "c", "x": {"y": 2}}\n\n')
    assert {r.r["label"]: r.r.get("x") for r in S.read_bulk_lines(spark, str(tmp_path)).collect()} == {"a": None, "b": None, "c": '{"y":2}'}


def test_the_first_of_a_number_stays(spark, tmp_path):
    rows = [f"{i % 50},name {i},TX,Municipal" for i in range(2000)]
    (tmp_path / "u.csv").write_text("\n".join(["Utility Number,Utility Name,State,Ownership Type", *rows, ",no number,TX,State"]))
    good, bad = S.read_utility_master(spark, str(tmp_path / "u.csv"), {"Municipal": "municipal"})
    assert {(r.eia_id, r.name) for r in good.collect()} == {(i, f"name {i}") for i in range(50)} and [r.name for r in bad.collect()] == ["no number"]
