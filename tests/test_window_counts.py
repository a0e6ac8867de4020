"""Windows that overlap: counts beside plain loops, and work that does not grow with the number of meetings."""

import datetime as dt
import random
import time

from pyspark.sql import functions as F

from wattgrid.functions.dominance import LEAST, window_counts
from wattgrid.operators import runs as O


def test_window_counts_beside_loops(spark):
    rnd = random.Random(4)
    windows = [(s, s + rnd.randrange(-2, 60)) for s in (rnd.randrange(200) for _ in range(300))]
    points = [(rnd.choice("ab"), rnd.choice([50, rnd.randrange(260)]), rnd.choice([LEAST, 70, rnd.randrange(260)])) for _ in range(1500)]
    want = {(k, s, e): sum(j == k and s <= x < e and y < s for j, x, y in points) for s, e in windows if e > s for k in "ab"}
    got = window_counts(spark.createDataFrame(windows, "s long, e long"), spark.createDataFrame(points, "kind string, x long, y long"), chunk=100).collect()
    assert {(r.kind, r.s, r.e): r.n for r in got} == want and len(got) == len(want)


def test_overlapping_runs_do_not_meet_times_row_by_row(spark):
    at = lambda n: F.timestamp_micros(F.lit(1_704_067_200_000_000) + n)
    n, began = 40_000, time.time()
    runs = spark.range(n).select(F.col("id").alias("run_id"), at(F.col("id")).alias("started_at"), F.lit(5).alias("targeted"))
    tariffs = spark.range(n).select((F.col("id") % 10).alias("utility_id"), at(F.col("id") - 5).alias("created_at"), at(F.col("id")).alias("verified_at"))
    rows = O.run_trail(runs, tariffs, str(dt.datetime(2024, 1, 2))).collect()
    assert time.time() - began < 60
    assert {r.run_id: tuple(r)[2:] for r in rows} == {i: (max(n - 5 - i, 0), min(5, n - i), min(10, n - i), max(5 - min(10, n - i), 0)) for i in range(n)}
