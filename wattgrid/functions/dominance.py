"""How many points lie in windows that overlap by the thousand, without a row per point and window."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattgrid.functions.scratch import Scratch

LEAST = -(1 << 63)  # y of points that no lower bound leaves out
CHUNK = 50_000  # points of a chunk at least


def dominated(x: np.ndarray, y: np.ndarray, w: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each (a, b) the weight of the points with x < a and y < b: a wavelet matrix of the ranks of y in the order of x."""
    by_x = np.argsort(x, kind="stable")
    by_y = np.argsort(y[by_x], kind="stable")
    rank = np.empty(len(x), np.int64)
    rank[by_y] = np.arange(len(x))
    weight, least = w[by_x], np.searchsorted(np.sort(y), b)
    low, high, out = np.zeros(len(a), np.int64), np.searchsorted(x[by_x], a), np.zeros(len(a), np.int64)
    for bit in range(len(x).bit_length() - 1, -1, -1):
        zero = (rank >> bit) & 1 == 0
        zeros, sums = np.concatenate(([0], np.cumsum(zero))), np.concatenate(([0], np.cumsum(np.where(zero, weight, 0))))
        one = (least >> bit) & 1 == 1
        out += np.where(one, sums[high] - sums[low], 0)
        low, high = (np.where(one, zeros[-1] + p - zeros[p], zeros[p]) for p in (low, high))
        rank, weight = np.concatenate((rank[zero], rank[~zero])), np.concatenate((weight[zero], weight[~zero]))
    return out


def _answers(rows: pd.DataFrame) -> pd.DataFrame:
    points, asked = rows[rows["w"] > 0], rows[rows["w"] == 0]
    n = dominated(*(points[c].to_numpy() for c in "xyw"), asked["x"].to_numpy(), asked["y"].to_numpy())
    return asked[["kind", "a", "b"]].assign(n=n)


def _bounds(values: DataFrame, chunks: int) -> list[int]:
    """Lower ends of chunks of about as many values each; a value that fills several has a chunk of its own."""
    cuts = values.agg(F.percentile_approx("v", [k / chunks for k in range(1, chunks)] or [0.5])).first()[0] or []
    return sorted({int(c) for c in cuts} | {int(c) + 1 for c, d in zip(cuts, cuts[1:]) if c == d})


def _chunk(bounds: list[int]):
    @F.pandas_udf("bigint")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in batches:
            yield pd.Series(np.searchsorted(np.array(bounds, np.int64), values.to_numpy(), "right"))

    return of


def window_counts(windows: DataFrame, points: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(kind, s, e, n): for each window (s, e) and kind the points (kind, x, y) with s <= x < e and y < s. All are whole numbers.

    That is the number with x < e less that with x < s, both with y < s. Each is told from three parts: the points of the
    bound's own chunk of x, those of chunks before it in the bound's own chunk of y, and whole cells of chunks, which are counted
    first. So points and windows are shuffled twice each, however many of them meet; a chunk is one task's work.
    """
    scratch = Scratch(windows.sparkSession, "window-counts")
    w = scratch.cut(windows.select("s", "e").where("e > s").distinct())
    ends = w.agg(F.min("s"), F.max("e")).first()
    p = points.where(F.col("x").between(*ends) if ends[0] is not None else F.lit(False))
    p = scratch.cut(p.groupBy("kind", "x", "y").agg(F.count("*").alias("w")))
    n = p.count()
    chunks = -(-n // max(chunk, int(n ** (2 / 3)))) if chunk == CHUNK else -(-n // chunk)
    value = lambda rows, c: rows.select(F.col(c).alias("v"))
    xs = _bounds(value(p, "x").unionAll(value(w, "s")).unionAll(value(w, "e")), max(chunks, 1))
    ys = _bounds(value(p, "y").unionAll(value(w, "s")), max(chunks, 1))
    x_of, y_of = _chunk(xs), _chunk(ys)
    single = lambda c, bounds: c.isin([b - 1 for b in bounds if b - 1 in set(bounds)] or [None])  # noqa: E731  # a chunk of one value: no bound in it is beyond its points
    p = scratch.cut(p.select("*", x_of("x").alias("cx"), y_of("y").alias("cy")))
    bound = F.explode(F.array("s", "e")).alias("a")
    q = w.select(bound, F.col("s").alias("b")).distinct().crossJoin(F.broadcast(p.select("kind").distinct()))
    q = scratch.cut(q.select("*", x_of("a").alias("cx"), y_of("b").alias("cy")))
    cells = lambda side, chunk_, x, y, rows, weight, *more: rows.select("kind", F.lit(side).alias("side"), chunk_.cast("bigint").alias("chunk"), F.col(x).alias("x"), F.col(y).alias("y"), weight.cast("bigint").alias("w"), *more)
    none, zero = [F.lit(0).cast("bigint").alias(c) for c in "ab"], F.lit(0)
    own = [F.col("a"), F.col("b")]
    near = (
        cells("x", F.col("cx"), "x", "y", p.where(~F.coalesce(single(F.col("x"), xs), F.lit(False))), F.col("w"), *none)
        .unionAll(cells("y", F.col("cy"), "cx", "y", p.where(~F.coalesce(single(F.col("y"), ys), F.lit(False))), F.col("w"), *none))
        .unionAll(cells("x", F.col("cx"), "a", "b", q, zero, *own)).unionAll(cells("y", F.col("cy"), "cx", "b", q, zero, *own))
    )
    answer = "kind string, a bigint, b bigint, n bigint"
    near = near.groupBy("kind", "side", "chunk").applyInPandas(_answers, answer)
    counts = p.groupBy("kind", "cx", "cy").agg(F.sum("w").alias("w"))
    asked = q.select("kind", "cx", "cy").distinct()
    far = cells("far", zero, "cx", "cy", counts, F.col("w"), *none).unionAll(cells("far", zero, "cx", "cy", asked, zero, F.col("cx").alias("a"), F.col("cy").alias("b")))
    far = far.groupBy("kind", "side").applyInPandas(_answers, answer).toDF("kind", "cx", "cy", "n")
    far = q.join(far, ["kind", "cx", "cy"]).select("kind", "a", "b", "n")
    d = scratch.cut(near.unionAll(far).groupBy("kind", "a", "b").agg(F.sum("n").alias("n")))
    up, down = (d.select("kind", F.col("a").alias(c), F.col("b").alias("s"), F.col("n").alias(f"n_{c}")) for c in ("e", "s_"))
    return w.join(up, ["s", "e"]).join(down.where("s_ = s").drop("s_"), ["kind", "s"]).select("kind", "s", "e", (F.col("n_e") - F.col("n_s_")).alias("n"))
