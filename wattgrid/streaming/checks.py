"""Page checks as batches and as streams: changes per source, outcomes per week, runs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def detect_changes(checks: DataFrame, source: str, at: str, id_col: str, content_hash: str, failed: str) -> DataFrame:
    """checks with before, changed, outcome and review: a check is compared with its source's last one that did not fail.

    The first sight of a source is unchanged, a failed check keeps the known hash. Review is pending for changes and errors.
    """
    w = Window.partitionBy(source).orderBy(at, id_col).rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(F.when(~F.col(failed), F.col(content_hash)), ignorenulls=True).over(w)
    rows = checks.withColumn("before", before)
    changed = ~F.col(failed) & F.col("before").isNotNull() & (F.col("before") != F.col(content_hash))
    outcome = F.when(F.col(failed), "error").when(F.col("before").isNull(), "first").when(changed, "changed").otherwise("unchanged")
    return rows.withColumns({"changed": changed, "outcome": outcome}).withColumn("review", F.when(F.col("outcome").isin("error", "changed"), "pending").otherwise("dismissed"))


def stream_changes(checks: DataFrame, delay: str = "1 day") -> DataFrame:
    """(source_id, id, checked_at, outcome, review) from a stream of checks (source_id, id, checked_at, content_hash, failed).

    State per source is the last good hash and its time. Checks of a batch are taken in order of checked_at; a check older
    than the known one is reported as late and does not roll the hash back. Rows older than the watermark are dropped by Spark,
    which it does where state has timeouts; runs.LateRows counts them.
    """
    schema = "source_id long, id long, checked_at timestamp, outcome string, review string"

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known, seen = state.get if state.exists else (None, -1)
        rows = pd.concat(list(pdfs)).sort_values(["checked_at", "id"])
        out = []
        for r in rows.itertuples(index=False):
            us = r.checked_at.value // 1000
            if us < seen:
                outcome = "late"
            elif r.failed:
                outcome, seen = "error", us
            else:
                outcome = "first" if known is None else "changed" if known != r.content_hash else "unchanged"
                known, seen = r.content_hash, us
            out.append((key[0], r.id, r.checked_at, outcome, "pending" if outcome in ("error", "changed") else "dismissed"))
        state.update((known, seen))
        yield pd.DataFrame(out, columns=["source_id", "id", "checked_at", "outcome", "review"])

    rows = checks.select("source_id", "id", "checked_at", "content_hash", "failed").withWatermark("checked_at", delay)
    return rows.groupBy("source_id").applyInPandasWithState(step, schema, "known string, seen long", "append", GroupStateTimeout.EventTimeTimeout)


def stream_outcomes(outcomes: DataFrame, width: str = "7 days", slide: str | None = None, delay: str = "1 day") -> DataFrame:
    """(start, checks, changed, errors) per window of event time; windows are emitted when the watermark passes them."""
    window = F.window("checked_at", width, slide) if slide else F.window("checked_at", width)
    per = outcomes.withWatermark("checked_at", delay).groupBy(window.alias("w"))
    return per.agg(F.count("*").alias("checks"), F.count_if(F.col("outcome") == "changed").alias("changed"), F.count_if(F.col("outcome") == "error").alias("errors")).select(F.col("w.start").alias("start"), "checks", "changed", "errors")


def stream_new_pages(pages: DataFrame, delay: str = "7 days") -> DataFrame:
    """Pages (url, content_hash, fetched_at) whose hash was not seen for their url within the delay."""
    return pages.withWatermark("fetched_at", delay).dropDuplicatesWithinWatermark(["url", "content_hash"])


def stalled_runs(runs: DataFrame, as_of: str, hours: int = 6) -> DataFrame:
    """Runs that began more than ``hours`` before as_of and have no end; those given an end drop out, so repeating it is harmless."""
    return runs.where(F.col("finished_at").isNull() & (F.col("started_at") < F.lit(as_of).cast("timestamp") - F.make_dt_interval(hours=F.lit(hours))))


def stream_run_progress(results: DataFrame, delay: str = "6 hours") -> DataFrame:
    """(run_id, start, processed, errors) per session of results (run_id, reported_at, failed) of a run; a session ends after ``delay`` of silence."""
    rows = results.withWatermark("reported_at", delay).groupBy("run_id", F.session_window("reported_at", delay).alias("s"))
    return rows.agg(F.count("*").alias("processed"), F.count_if("failed").alias("errors")).select("run_id", F.col("s.start").alias("start"), "processed", "errors")


def finish_stalled(runs: DataFrame, as_of: str, hours: int = 6) -> DataFrame:
    """runs with stalled, where those that stalled_runs names get as_of as their end; runs with an end stay as they are, so repeating it changes nothing."""
    gone = stalled_runs(runs, as_of, hours).select("run_id").distinct().withColumn("stalled", F.lit(True))
    out = runs.join(gone, "run_id", "left").withColumn("stalled", F.coalesce("stalled", F.lit(False)))
    return out.withColumn("finished_at", F.when(F.col("stalled"), F.lit(as_of).cast("timestamp")).otherwise(F.col("finished_at")))


def run_completion(runs: DataFrame, results: DataFrame) -> DataFrame:
    """(run_id, targeted, reported, errors, complete) of runs (run_id, targeted) by their results (run_id, failed) so far; runs without results are left out."""
    per = results.groupBy("run_id").agg(F.count("*").alias("reported"), F.count_if("failed").alias("errors"))
    return runs.join(per, "run_id").select("run_id", "targeted", "reported", "errors", (F.col("reported") >= F.col("targeted")).alias("complete"))


def stream_run_completion(results: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, reported, errors, complete) once a run's last result is in, from a stream of results (run_id, failed); runs: (run_id, targeted), a table.

    State per run is how many results it has; a run is told of once, when as many are in as were targeted.
    """

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        reported, errors = state.get if state.exists else (0, 0)
        before, targeted = reported, None
        for pdf in pdfs:
            reported, errors, targeted = reported + len(pdf), errors + int(pdf["failed"].sum()), int(pdf["targeted"].iloc[0])
        state.update((reported, errors))
        if targeted is not None and before < targeted <= reported:
            yield pd.DataFrame([(key[0], reported, errors, True)], columns=["run_id", "reported", "errors", "complete"])

    rows = results.join(runs, "run_id").select("run_id", "failed", "targeted")
    return rows.groupBy("run_id").applyInPandasWithState(step, "run_id long, reported long, errors long, complete boolean", "reported long, errors long", "append", GroupStateTimeout.NoTimeout)
