"""Refresh runs as streams with timers, and rows that come too late."""

from __future__ import annotations

import json
import threading
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "run_id bigint, outcome string, finished_at timestamp, reported bigint, failed bigint, missing bigint"


def finish_runs(events: DataFrame, as_of: str, hours: int = 6) -> DataFrame:
    """run_id, outcome, finished_at, reported, failed, missing of the runs that have ended by as_of, from their events (run_id, at, targeted, failed) before as_of.

    A row with targeted starts a run, one with failed is a result. A run is complete at the result that makes as many as were
    targeted, and stalled when nothing was heard of it for over ``hours`` after its last event before; it then ends at that time, with
    what it had, and later events change nothing. Events of equal times count starts first. Runs that still wait are left out.
    """
    limit, end = F.make_dt_interval(hours=F.lit(hours)), F.lit(as_of).cast("timestamp")
    rows = events.where(F.col("run_id").isNotNull() & (F.col("at") < end)).select("run_id", "at", "targeted", F.col("failed").isNotNull().alias("result"), F.coalesce("failed", F.lit(False)).alias("failed"))
    w = Window.partitionBy("run_id").orderBy("at", "result", "failed")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select(
        "run_id", "at", F.row_number().over(w).alias("k"), F.max("targeted").over(so_far).alias("targeted"), F.count_if("result").over(so_far).alias("reported"),
        F.count_if(F.col("result") & F.col("failed")).over(so_far).alias("failed"), F.lead("at").over(w).alias("next"),
    )
    complete = F.coalesce(F.col("reported") >= F.col("targeted"), F.lit(False))
    silent = F.coalesce(F.col("next"), end) > F.col("at") + limit
    outcome = F.when(complete, "complete").when(silent, "stalled")
    ended = rows.withColumn("outcome", outcome).where("outcome is not null")
    finished = F.when(F.col("outcome") == "complete", F.col("at")).otherwise(F.col("at") + limit)
    missing = F.coalesce(F.greatest(F.col("targeted") - F.col("reported"), F.lit(0)), F.lit(0))
    first = ended.groupBy("run_id").agg(F.min(F.struct("k", "outcome", finished.alias("finished_at"), "reported", "failed", missing.alias("missing"))).alias("e_"))
    return first.select("run_id", *[F.col(f"e_.{c}").cast(t).alias(c) for c, t in (("outcome", "string"), ("finished_at", "timestamp"), ("reported", "bigint"), ("failed", "bigint"), ("missing", "bigint"))])


def stream_finished_runs(events: DataFrame, hours: int = 6, delay: str = "1 hour", forget: int = 48) -> DataFrame:
    """The rows of finish_runs from a stream of events, each once: when the result that completes a run is certain, or by a timer of event time when a run was silent for over ``hours``.

    Events wait in the state of their run until the watermark (``delay`` behind the latest event) has passed them, and are then taken
    in order of time; so the rows are those of finish_runs as of the watermark, however the events were dealt to batches.
    State per run is a few numbers and the events of one delay. An ended run is remembered for ``forget`` hours.
    """
    limit, keep = hours * 3_600_000_000, forget * 3_600_000_000

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        targeted, reported, failed, last, ended, waiting = state.get if state.exists else (None, 0, 0, None, None, "[]")
        mark = state.getCurrentWatermarkMs() * 1000
        waits = json.loads(waiting)
        for pdf in pdfs:
            for at, n, bad in zip(pdf["at"], pdf["targeted"], pdf["failed"]):
                is_result = bad is not None and bad == bad
                waits.append([at.value // 1000, is_result, bool(bad) if is_result else False, None if pd.isna(n) else int(n)])
        waits.sort(key=lambda e: e[:3])
        out = None
        while ended is None:
            if last is not None and (waits[0][0] if waits else mark) > last + limit and mark > last + limit:
                ended, out = last + limit, "stalled"
            elif waits and waits[0][0] < mark:
                last, is_result, bad, n = waits.pop(0)
                targeted = max([x for x in (targeted, n) if x is not None], default=None)
                reported, failed = reported + is_result, failed + (is_result and bad)
                if targeted is not None and reported >= targeted:
                    ended, out = last, "complete"
            else:
                break
        if ended is not None:
            waits = []
            if mark > ended + keep:
                state.remove()
            else:
                state.update((targeted, reported, failed, last, ended, "[]"))
                state.setTimeoutTimestamp((ended + keep) // 1000 + 1)
        else:
            state.update((targeted, reported, failed, last, None, json.dumps(waits)))
            wakes = min([e[0] for e in waits[:1]] + ([last + limit] if last is not None else []))
            state.setTimeoutTimestamp(max(wakes, mark) // 1000 + 1)
        if out:
            row = (key[0], out, pd.Timestamp(ended, unit="us"), reported, failed, max((targeted or 0) - reported, 0))
            yield pd.DataFrame([row], columns=["run_id", "outcome", "finished_at", "reported", "failed", "missing"])

    rows = events.where("run_id is not null").select("run_id", "at", "targeted", "failed").withWatermark("at", delay)
    held = "targeted bigint, reported bigint, failed bigint, last bigint, ended bigint, waiting string"
    return rows.groupBy("run_id").applyInPandasWithState(step, OUT, held, "append", GroupStateTimeout.EventTimeTimeout)


class LateRows(StreamingQueryListener):
    """Counts the rows that stateful operators dropped because they came after the watermark, by query name (its id where it has none).

    Add it with spark.streams.addListener before queries start. Progress is reported after a batch, so the count is that of finished batches.
    """

    def __init__(self):
        self.dropped: Counter[str] = Counter()
        self.batches: Counter[str] = Counter()
        self.lock = threading.Lock()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        with self.lock:
            self.dropped[p.name or str(p.id)] += sum(op.numRowsDroppedByWatermark for op in p.stateOperators)
            self.batches[p.name or str(p.id)] += 1

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
