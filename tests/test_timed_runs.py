"""Runs that end by timers, rows that come too late, runs told from times, and fingerprints kept batch by batch."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from wattgrid.functions import files
from wattgrid.operators import runs as O
from wattgrid.streaming import checks as C
from wattgrid.streaming import runs as M
from wattgrid.streaming.fingerprints import FingerprintTable

START = dt.datetime(2024, 1, 1)
EVENTS = "run_id long, at timestamp, targeted long, failed boolean"


def hour(h):
    return START + dt.timedelta(hours=h)


def made_events(seed):
    rng, rows = random.Random(seed), []
    for run in range(12):
        at = rng.uniform(0, 10)
        rows.append((run, hour(at), rng.randint(1, 6), None))
        for _ in range(rng.randint(0, 7)):
            at += rng.choice([0, 0.2, 1, 3, 5.9, 6, 6.5])
            rows.append((run, hour(at), None, rng.random() < 0.3))
    return sorted(rows, key=lambda r: r[1])


def plain_finish(rows, as_of, hours=6):
    out = {}
    for run in {r[0] for r in rows}:
        targeted, reported, failed, last = None, 0, 0, None
        for _, at, n, bad in sorted((r for r in rows if r[0] == run and r[1] < as_of), key=lambda r: (r[1], r[3] is not None, bool(r[3]))):
            if last is not None and at > last + dt.timedelta(hours=hours):
                break
            last, targeted = at, n if n is not None else targeted
            reported, failed = reported + (bad is not None), failed + bool(bad)
            if targeted is not None and reported >= targeted:
                out[run] = ("complete", at, reported, failed, max((targeted or 0) - reported, 0))
                break
        if run not in out and last is not None and as_of > last + dt.timedelta(hours=hours):
            out[run] = ("stalled", last + dt.timedelta(hours=hours), reported, failed, max((targeted or 0) - reported, 0))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_runs_end_as_in_the_batch_twin(spark, seed):
    rows = made_events(seed)
    for end in (20.25, 60.25):
        got = M.finish_runs(spark.createDataFrame(rows, EVENTS), str(hour(end))).collect()
        assert {r.run_id: tuple(r)[1:] for r in got} == plain_finish(rows, hour(end))


def test_stream_ends_runs_once_by_timers(spark, tmp_path):
    rows = made_events(3)
    rng, folder = random.Random(4), str(tmp_path / "in")
    late = M.LateRows()
    spark.streams.addListener(late)
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(EVENTS).parquet(folder)
    query = M.stream_finished_runs(stream, delay="2 hours").writeStream.format("memory").queryName("ended").option("checkpointLocation", str(tmp_path / "c")).start()
    latest = START
    try:
        for lo in range(0, 48, 8):  # within a batch in any order, over batches up to an hour too early or too late
            part = [r for r in rows if lo <= (r[1] - START).total_seconds() / 3600 + ((r[0] + r[1].minute) % 3 - 1) * 0.9 < lo + 8]
            rng.shuffle(part)
            part.append((-1, hour(lo + 8), None, None))
            spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(folder)
            query.processAllAvailable()
            latest = max([latest, *[r[1] for r in part]])
        spark.createDataFrame([(5, hour(1), None, True)] * 3, EVENTS).coalesce(1).write.mode("append").parquet(folder)  # long after the watermark
        query.processAllAvailable()
        for _ in range(100):
            if late.dropped["ended"]:
                break
            time.sleep(0.1)
    finally:
        query.stop()
        spark.streams.removeListener(late)
    assert late.dropped["ended"] == 3
    got = spark.table("ended").where("run_id >= 0").collect()
    assert len(got) == len({r.run_id for r in got}) and {r.outcome for r in got} == {"complete", "stalled"}
    assert {r.run_id: tuple(r)[1:] for r in got} == plain_finish(rows, latest - dt.timedelta(hours=2))


def test_late_checks_are_counted(spark, tmp_path):
    folder, schema = str(tmp_path / "in"), "source_id long, id long, checked_at timestamp, content_hash string, failed boolean"
    add = lambda *rows: spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(folder)
    late = M.LateRows()
    spark.streams.addListener(late)
    add((1, 1, hour(0), "a", False), (1, 2, hour(100), "b", False))
    query = C.stream_changes(spark.readStream.schema(schema).parquet(folder), "1 day").writeStream.format("memory").queryName("checked").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        query.processAllAvailable()
        add((1, 3, hour(10), "a", False), (2, 4, hour(20), "a", False), (1, 5, hour(90), "a", False), (1, 6, hour(101), "b", False))
        query.processAllAvailable()
        for _ in range(100):
            if late.dropped["checked"]:
                break
            time.sleep(0.1)
    finally:
        query.stop()
        spark.streams.removeListener(late)
    assert late.dropped["checked"] == 2
    assert {(r.id, r.outcome) for r in spark.table("checked").collect()} == {(1, "first"), (2, "changed"), (5, "late"), (6, "unchanged")}


def page(u, url, h, at):
    return (u, url, h, hour(at))


def test_fingerprints(spark, tmp_path):
    schema, rng = "utility_id long, url string, content_hash string, at timestamp", random.Random(1)
    table, known, names = FingerprintTable(spark, str(tmp_path / "t"), buckets=8), {}, set()
    for number in range(9):
        rows = [page(rng.randint(0, 9), rng.choice("abc"), rng.choice(["h1", "h2", None]), number * 10 + k * 0.1) for k in range(rng.choice([0, 3, 30]))]
        if number == 5:
            rows += [page(1, "a", "old", 0), (None, "a", "x", hour(1)), (1, None, "x", hour(1))]
        want = []
        for u, url, h, at in rows:
            if u is None or url is None:
                continue
            before = known.get((u, url))
            if before and at < before[1]:
                want.append((u, url, "late"))
                continue
            want.append((u, url, "first" if before is None else "same" if before[0] == (h or "") else "changed"))
            known[u, url] = (h or "", at)
        for attempt in range(2 if number in (2, 5) else 1):  # a batch that is applied again changes nothing
            shuffled = rng.sample(rows, len(rows))
            got = table.apply(spark.createDataFrame(shuffled, schema), number)
            assert sorted((r.utility_id, r.url, r.outcome) for r in got.collect()) == sorted(want)
        assert {(r.utility_id, r.url): (r.content_hash, r.at) for r in table.current().collect()} == known
        names.add(len(table.manifest()["runs"]))
    assert max(names) <= 6 and len(files.names_in(spark, str(tmp_path / "t" / "manifest"))) <= 4
    sizes = [r["rows"] for r in table.manifest()["runs"]]
    assert all(a > 2 * b for a, b in zip(sizes, sizes[1:]))


def test_a_failed_batch_is_done_again(spark, tmp_path, monkeypatch):
    schema = "utility_id long, url string, content_hash string, at timestamp"
    table = FingerprintTable(spark, str(tmp_path / "t"))
    table.apply(spark.createDataFrame([page(1, "a", "x", 0)], schema), 0)
    second = spark.createDataFrame([page(1, "a", "y", 1), page(1, "b", "y", 1)], schema)
    with monkeypatch.context() as m:
        m.setattr(files, "write_text", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            table.apply(second, 1)
    assert table.manifest()["batch"] == 0 and table.current().count() == 1
    assert sorted(r.outcome for r in table.apply(second, 1).collect()) == ["changed", "first"] and table.current().count() == 2


def test_run_trail(spark):
    rng = random.Random(2)
    runs = [(i, hour(rng.uniform(0, 100)) if i else None, rng.choice([None, 3, 50])) for i in range(300)]
    tariffs = [(rng.choice([None, *range(40)]), rng.choice([None, hour(rng.uniform(0, 120))]), rng.choice([None, hour(rng.uniform(0, 120))])) for _ in range(400)]
    as_of, got = hour(90), {}
    df = O.run_trail(spark.createDataFrame(runs, "run_id long, started_at timestamp, targeted long"), spark.createDataFrame(tariffs, "utility_id long, created_at timestamp, verified_at timestamp"), str(as_of))
    got = {r.run_id: tuple(r)[1:] for r in df.collect()}
    for run, s, n in runs:
        e = min(as_of, s + dt.timedelta(hours=24)) if s else as_of
        inside = lambda t: s is not None and t is not None and s <= t < e  # noqa: E731, B023
        created, done = sum(inside(c) for _, c, _ in tariffs), {u for u, _, v in tariffs if inside(v) and u is not None}
        verified = sum(inside(v) and (c is None or c < s) for _, c, v in tariffs)
        assert got[run][1:] == (created, verified, len(done), max((n or 0) - len(done), 0))


def test_run_outcomes(spark):
    results = spark.createDataFrame([(1, 1, "A", "TX", True, 3, None), (1, 2, "B", None, False, 0, ["x", "y"]), (1, 3, None, "OK", None, None, None), (2, 1, "A", "", True, 1, [])], "run_id long, utility_id long, name string, state string, success boolean, found long, problems array<string>")
    before = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (2, 1, 5)], "run_id long, utility_id long, n long")
    tariffs = spark.createDataFrame([(1, "2024-01-01"), (1, None), (2, "2023-01-01"), (2, "2024-01-01"), (9, None)], "utility_id long, d string").select("utility_id", F.col("d").cast("date").alias("last_verified"))
    got = {r.run_id: tuple(r)[1:] for r in O.run_outcomes(results, before, tariffs, "2024-02-01").collect()}
    assert got == {1: (3, 1, 2, 3, 1, 2, 2, "OK,TX", "? (OK): unknown\nB (?): x; y"), 2: (1, 1, 0, 1, 0, 0, 1, "", "")}
