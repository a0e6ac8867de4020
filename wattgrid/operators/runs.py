"""Refresh runs: what their results add up to, and what the tariffs' own times say of runs that never reported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattgrid.functions.dominance import LEAST, window_counts


def run_trail(runs: DataFrame, tariffs: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    """run_id, ended_at, created, verified_only, processed, errors of each run, from the times of tariffs.

    runs: run_id, started_at, targeted; tariffs: utility_id, created_at, verified_at. A run's window goes from its start to ``hours``
    later, or as_of where that is earlier. created counts tariffs made in it, verified_only those verified in it that are older than the run
    (or of no known age), processed the different utilities verified in it, errors the targeted ones beyond these, at least 0.

    Runs may overlap by the thousand, so no run meets its tariffs row by row: all three are counts of times in the window beside a
    second time before it, which for processed is the utility's verification before this one. Runs without a start have nulls,
    tariffs without times count nowhere, and a run without hits has zeros.
    """
    start = F.col("started_at").cast("timestamp")
    end = F.least(F.lit(as_of).cast("timestamp"), start + F.make_dt_interval(hours=F.lit(hours)))
    made, seen = (F.unix_micros(F.col(c).cast("timestamp")) for c in ("created_at", "verified_at"))
    before = F.lag("x").over(Window.partitionBy("utility_id").orderBy("x"))
    of = lambda rows, kind, y: rows.where("x is not null").select(F.lit(kind).alias("kind"), "x", F.coalesce(y, F.lit(LEAST)).alias("y"))
    times = tariffs.select("utility_id", made.alias("made_"), seen.alias("x"))
    points = of(tariffs.select(made.alias("x")), "created", F.lit(None)).unionAll(of(times, "verified_only", F.col("made_")))
    points = points.unionAll(of(times.where("utility_id is not null and x is not null").select("utility_id", "x").distinct().select("x", before.alias("before_")), "processed", F.col("before_")))
    spans = runs.select("run_id", end.alias("ended_at"), F.coalesce("targeted", F.lit(0)).cast("bigint").alias("targeted"), F.unix_micros(start).alias("s"), F.unix_micros(end).alias("e"))
    sums = window_counts(spans, points).groupBy("s", "e").agg(*[F.sum(F.when(F.col("kind") == k, F.col("n"))).alias(k) for k in ("created", "verified_only", "processed")])
    none = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    out = spans.join(sums, ["s", "e"], "left")
    return out.select("run_id", "ended_at", none("created").alias("created"), none("verified_only").alias("verified_only"), none("processed").alias("processed"), F.greatest(F.col("targeted") - none("processed"), F.lit(0)).alias("errors"))


def run_outcomes(results: DataFrame, before: DataFrame, tariffs: DataFrame, as_of: str, stale_days: int = 270) -> DataFrame:
    """run_id, targeted, processed, errors, found, added, updated, stale, states, error_details per run, from its results.

    results: run_id, utility_id, name, state, success, found, problems (array); before: run_id, utility_id, n, the tariffs of a
    utility when the run began; tariffs: utility_id, last_verified. A result adds what its utility has more than before, and updates all its
    tariffs where they are as many as before. stale counts the tariffs of the run's utilities last verified before as_of less
    stale_days, or never. States are sorted; failed results are told line by line, by name, with their problems or unknown.
    """
    have = tariffs.groupBy("utility_id").agg(F.count("*").alias("a_"), F.count_if(F.col("last_verified").isNull() | (F.col("last_verified") < F.date_sub(F.lit(as_of).cast("date"), stale_days))).alias("old_"))
    was = before.groupBy("run_id", "utility_id").agg(F.sum("n").alias("b_"))
    rows = results.join(was, ["run_id", "utility_id"], "left").join(have, "utility_id", "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    a, b = n("a_"), n("b_")
    ok = F.coalesce("success", F.lit(False))
    said: Column = F.format_string("%s (%s): %s", F.coalesce("name", F.lit("?")), F.coalesce("state", F.lit("?")), F.coalesce(F.array_join("problems", "; "), F.lit("unknown")))
    per = rows.groupBy("run_id").agg(
        F.count("*").alias("targeted"), F.count_if(ok).alias("processed"), F.count_if(~ok).alias("errors"), F.sum(n("found")).alias("found"),
        F.sum(F.when(a > b, a - b).otherwise(0)).alias("added"), F.sum(F.when((a == b) & (b > 0), a).otherwise(0)).alias("updated"),
        F.array_join(F.sort_array(F.collect_set(F.nullif("state", F.lit("")))), ",").alias("states"), F.array_join(F.sort_array(F.collect_list(F.when(~ok, said))), "\n").alias("error_details"),
    )
    stale = rows.select("run_id", "utility_id", "old_").distinct().groupBy("run_id").agg(F.sum(n("old_")).alias("stale"))
    return per.join(stale, "run_id").select("run_id", "targeted", "processed", "errors", "found", "added", "updated", "stale", "states", "error_details")
