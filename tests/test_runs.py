"""Streams of results and of pages, batch by batch."""

import pytest

from wattgrid.streaming import checks as M
from wattgrid.streaming import fingerprints


def drain(query):
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def test_a_run_is_complete_once(spark, tmp_path):
    results = str(tmp_path / "in")
    runs = spark.createDataFrame([(1, 3), (2, 2)], "run_id long, targeted long")
    spark.createDataFrame([(1, False), (2, True), (1, True)], "run_id long, failed boolean").coalesce(1).write.mode("append").parquet(results)
    stream = spark.readStream.schema("run_id long, failed boolean").option("maxFilesPerTrigger", 1).parquet(results)
    query = M.stream_run_completion(stream, runs).writeStream.format("memory").queryName("completed").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    spark.createDataFrame([(1, True), (2, False), (1, False)], "run_id long, failed boolean").coalesce(1).write.mode("append").parquet(results)
    drain(query)
    assert {tuple(r) for r in spark.table("completed").collect()} in ({(1, 4, 2, True), (2, 2, 1, True)}, {(1, 3, 1, True), (2, 2, 1, True)})


def test_pages_are_stored_when_they_change(spark, tmp_path):
    source, stored = str(tmp_path / "in"), str(tmp_path / "out")
    add = lambda *rows: spark.createDataFrame(list(rows), "utility_id long, url string, content_hash string").coalesce(1).write.mode("append").parquet(source)
    add((1, "a", "h1"), (1, "b", "h1"))
    stream = spark.readStream.schema("utility_id long, url string, content_hash string").option("maxFilesPerTrigger", 1).parquet(source)
    query = fingerprints.write_changed_pages(stream, spark, stored, str(tmp_path / "c")).start()
    query.processAllAvailable()
    add((1, "a", "h1"), (1, "b", "h2"), (2, "a", "h1"))
    drain(query)
    rows = spark.read.parquet(*[f"{stored}/{k}" for k in (0, 1)]).collect()
    assert {tuple(r) for r in rows} == {(1, "a", "h1", 0), (1, "b", "h1", 0), (1, "b", "h2", 1), (2, "a", "h1", 1)}


@pytest.mark.parametrize("hours,stalled", [(6, {1}), (100, set())])
def test_stalled_runs_end_once(spark, hours, stalled):
    runs = spark.createDataFrame([(1, "2024-01-01 00:00:00", None), (2, "2024-01-01 11:00:00", None), (3, "2024-01-01 00:00:00", "2024-01-01 01:00:00")], "run_id long, a string, b string").selectExpr("run_id", "timestamp(a) as started_at", "timestamp(b) as finished_at")
    first = M.finish_stalled(runs, "2024-01-01 12:00:00", hours)
    assert {r.run_id for r in first.collect() if r.stalled} == stalled
    again = M.finish_stalled(first.drop("stalled"), "2024-01-01 12:00:01", hours)
    assert not [r for r in again.collect() if r.stalled and r.run_id in stalled]
