"""Near-duplicate embeddings by collision counting over one-dimensional projections."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattgrid.functions.components import connected_components
from wattgrid.functions.scratch import Scratch
from wattgrid.llm.near_dups import groups_of
from wattgrid.llm.words import mixed

#: Projections of a vector that are counted; comparisons that cost as much as one more copy of a vector; least recall at the threshold; standard deviations in half a window.
PROJECTIONS, COPY_COST, RECALL, HALF = 48, 200, 0.92, 2.3
#: Homes, and probes, of a cell that are compared as one group; pairs of them that are held at once.
BLOCK, SLICE = 4096, 400_000


class Projections:
    """Directions, window and the number of collisions that a pair needs, fitted to a threshold and the rows of the largest label.

    Directions are rows of random rotations. Two unit vectors at the threshold are sqrt(2 - 2 t) apart, so their
    projections differ by about a normal error of that over sqrt(dimensions); the half-window is HALF such errors. The
    count that a pair needs is the largest that a pair at the threshold reaches in all but a thousandth of cases.

    The sorted lines of ``deep`` leading projections are cut into cells twice as wide as a window. A probe's window lies in
    1.5 cells of a line on average and holds about half of the vectors, so a vector is copied 1.5 ** deep times and compared
    rows / 2 ** deep times per set; deep makes the sum of both least. Both then grow with the rows to the power 0.37, at any
    size. Sets of leading projections, two at first, are added until recall reaches RECALL.
    """

    def __init__(self, dims: int, rows: int, threshold: float):
        self.deep = min(range(2, 64), key=lambda d: rows / 2**d + COPY_COST * 1.5**d)
        p = math.erf(HALF / math.sqrt(2))
        below, need = 0.0, 0
        while below + (q := math.comb(PROJECTIONS, need) * p**need * (1 - p) ** (PROJECTIONS - need)) < 1e-3:
            below, need = below + q, need + 1
        self.need, self.sets = need, 2
        while self.recall() < RECALL:
            self.sets += 1
        rng = np.random.default_rng(dims)
        n = max(PROJECTIONS, self.sets * self.deep)
        turns = [np.linalg.qr(rng.standard_normal((dims, dims)))[0] for _ in range(-(-n // dims))]
        self.directions = np.concatenate(turns)[:n].T
        self.half = HALF * math.sqrt(2 - 2 * threshold) / math.sqrt(dims)
        self.cell = 4 * self.half

    def recall(self) -> float:
        """How probably a pair just at the threshold is found, at least: it collides in a whole set of leading projections, and in enough of those counted."""
        p = math.erf(HALF / math.sqrt(2))
        missed = (1 - p**self.deep) ** self.sets
        return 1 - missed - 1e-3

    def project(self, unit: np.ndarray) -> np.ndarray:
        return unit @ self.directions

    def leads(self, q: np.ndarray, k: int) -> np.ndarray:
        return q[:, k * self.deep : (k + 1) * self.deep]

    def cells(self, v: np.ndarray) -> np.ndarray:
        return np.floor(v / self.cell).astype(np.int64)


def _unit(raw: list[bytes], dims: int) -> np.ndarray:
    """Unit vectors in double precision from the bytes of floats or doubles; doubles are scaled by their largest component first, so that squares neither vanish nor overflow."""
    x = np.frombuffer(b"".join(raw), f"<f{len(raw[0]) // dims if raw else 8}").reshape(len(raw), dims).astype(np.float64)
    if raw and len(raw[0]) == 8 * dims:  # the squares of floats fit
        x = np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _cell_key(cells: np.ndarray, k: int) -> np.ndarray:
    out = np.full(len(cells), k + 1, np.uint64)
    for c in cells.T:
        out = mixed(out) + c.astype(np.uint64)
    return mixed(out).astype(np.int64)


def link_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98) -> DataFrame:
    """One row per row: vec_id, n_links, component_id, kept.

    Vectors with equal labels link at a cosine of threshold or more, in double precision; n_links counts the other vectors
    linked directly, component_id is the smallest id that links reach. Pairs are found when they collide in the windows of
    all leading projections of one set and in enough of PROJECTIONS, then verified; no pair below the threshold
    is linked. A pair just at the threshold is found with the probability Projections.recall or more: 0.99 up to 20,000 rows of a
    label, 0.98 at 200,000, 0.96 at 10 million, and RECALL at least at any number. A closer pair is found with more. Vectors of
    doubles are taken as they are, others as floats.

    Ids are numbers. Null labels, and vectors that are null, empty, zero or hold null or non-finite components link with nothing; so do
    vectors of different lengths. Equal vectors of a label form a class and are not compared with each other. Rows
    that share an id count as vectors of their own that have one component. Null ids link with nothing and have a null
    component and kept false. Other columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vector-dedup")
    kind = "double" if vectors.schema[vector_col].dataType.simpleString() == "array<double>" else "float"
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast(f"array<{kind}>").alias("v"))
    whole = F.expr("vec_id is not null and label is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < float('infinity')) and exists(v, x -> x <> 0)")
    rows = rows.withColumn("ok", F.coalesce(whole, F.lit(False)))
    classes = scratch.cut(rows.where("ok").groupBy("label", "v").agg(F.min("vec_id").alias("cid"), F.count("*").alias("m")))
    per = classes.groupBy("label").agg(F.count("*").alias("n"), F.min(F.size("v")).alias("low"), F.max(F.size("v")).alias("high"))
    shape = per.agg(F.max("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).first()  # n: of the largest label
    sizes = [r[0] for r in classes.select(F.size("v").alias("n")).distinct().collect()] if shape["n"] and shape["low"] != shape["high"] else [shape["high"]] if shape["n"] else []
    links = edges = None
    for dims in sizes:
        counted, joined = _links_of(classes.where(F.size("v") == dims), Projections(dims, shape["n"], threshold), dims, threshold, scratch)
        links, edges = (counted, joined) if links is None else (links.union(counted), edges.union(joined))
    keyed = rows.withColumn("h", F.when(F.col("ok"), F.xxhash64("label", "v")))
    mine = keyed.join(classes, ["label", "v"], "left").select("vec_id", "ok", F.when(F.col("ok"), F.col("cid")).alias("cid"), F.when(F.col("ok"), F.col("m")).alias("m"))
    mine = scratch.cut(mine)
    if links is None:
        return mine.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    same_id = mine.where("ok and vec_id <> cid").groupBy("vec_id", "cid").agg(F.count("*").alias("n")).join(mine.groupBy("vec_id").agg(F.count("*").alias("rows")).where("rows > 1"), "vec_id").select("vec_id", "cid")
    parts = scratch.cut(connected_components(edges.union(same_id.toDF("a", "b")), scratch).select(F.col("id").alias("cid"), F.col("component_id").alias("part")))
    others = links.groupBy("cid").agg(F.sum("linked").alias("linked"))
    out = mine.join(parts, "cid", "left").join(others, "cid", "left")
    component = F.coalesce("part", "cid", "vec_id")
    out = out.select("vec_id", F.coalesce(F.col("m") - 1 + F.coalesce("linked", F.lit(0)), F.lit(0)).cast("bigint").alias("n_links"), F.when(F.col("vec_id").isNotNull(), component).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _met(dealt: DataFrame, block: int) -> DataFrame:
    """Rows of cells where homes meet probes, dealt to groups (cell, home block, probe block) so that each home meets each probe once; block: homes, and probes, of a group on average."""
    count = lambda role: F.count_if(F.col("role") == role)
    full = dealt.groupBy("cell").agg(count(0).alias("homes"), count(1).alias("probes"), F.count("*").alias("n")).where("homes > 0 and n > 1")
    full = full.select("cell", *[F.ceil(F.col(c) / block).cast("int").alias(f"{c}_in") for c in ("homes", "probes")])
    own = lambda n: F.array(F.pmod(F.xxhash64("cid"), F.col(n)).cast("int"))
    each = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    home = F.col("role") == 0
    met = dealt.join(full.where("probes_in > 0"), "cell")
    met = met.withColumn("block", F.explode(F.when(home, own("homes_in")).otherwise(each("homes_in"))))
    met = met.withColumn("other", F.explode(F.when(home, each("probes_in")).otherwise(own("probes_in"))))
    return met.select("cell", "block", "other", "k", "role", "cid", "m", "raw")


def _pairs(role: np.ndarray, cid: np.ndarray, unit: np.ndarray, k: int, proj: Projections, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs (probe, home) of the k-th set in one group, by row, verified; a slice of at most SLICE comparisons, or one probe, at a time.

    The homes are sorted by each projection; a probe's window is a run of each order, and the runs that hold a home are counted.
    """
    home, probe = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
    if not len(home) or not len(probe):
        return
    q = proj.project(unit)
    sets = [proj.leads(q, before) for before in range(k + 1)]
    spans = [(proj.cells(v - proj.half), proj.cells(v), proj.cells(v + proj.half)) for v in sets]
    place = np.zeros((PROJECTIONS, len(home)), np.uint16 if len(home) < 1 << 15 else np.uint32)
    first, width = (np.zeros((PROJECTIONS, len(probe)), place.dtype) for _ in range(2))
    for d in range(PROJECTIONS):
        order = np.argsort(q[home, d])
        place[d, order] = np.arange(len(home))
        line = q[home[order], d]
        first[d] = np.searchsorted(line, q[probe, d] - proj.half, "left")
        width[d] = np.searchsorted(line, q[probe, d] + proj.half, "right") - first[d]
    step = max(1, SLICE // len(home))
    for a in range(0, len(probe), step):
        rows = probe[a : a + step]
        count = np.zeros((len(rows), len(home)), np.int8)
        for d in range(PROJECTIONS):
            count += place[d][None, :] - first[d, a : a + step, None] < width[d, a : a + step, None]  # places before the window wrap to large numbers
        i, j = np.nonzero((count >= proj.need) & (cid[rows][:, None] < cid[home][None, :]))
        x, y = rows[i], home[j]
        for before, (low, cell, high) in enumerate(spans):
            meets = ((low[x] <= cell[y]) & (cell[y] <= high[x])).all(axis=1)
            real = meets if before == k else ~meets  # a pair that an earlier set of projections finds counts there; a cell's hash may stand for two cells
            x, y = x[real], y[real]
        real = [np.einsum("ij,ij->i", unit[x[s : s + 65536]], unit[y[s : s + 65536]]) >= threshold for s in range(0, len(x), 65536)]
        if real and (real := np.concatenate(real)).any():
            yield x[real], y[real]


def _counted(role: np.ndarray, cid: np.ndarray, m: np.ndarray, unit: np.ndarray, k: int, proj: Projections, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cid, root, linked) of one group's members that link: the smallest member that links reach inside the group, and the vectors linked; summed slice by slice."""
    ids, at = np.unique(cid, return_inverse=True)
    root, linked = np.arange(len(ids)), np.zeros(len(ids), np.int64)
    for x, y in _pairs(role, cid, unit, k, proj, threshold):
        a, b = at[x], at[y]
        linked += (np.bincount(a, m[y], len(ids)) + np.bincount(b, m[x], len(ids))).astype(np.int64)
        while len(a):  # larger roots move below smaller ones until all pairs share one
            a, b = root[a], root[b]
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root != root[root]).any():
                root = root[root]
    some = linked > 0
    return ids[some], ids[root[some]], linked[some]


def _links_of(classes: DataFrame, proj: Projections, dims: int, threshold: float, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(cid, linked): vectors in other classes that a class's vectors link with, in parts to be summed; (a, b): edges that connect what links."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                b = batch.slice(i, 2000)
                flat = b.column(1).flatten().to_numpy()
                raw = [flat[k : k + dims].tobytes() for k in range(0, len(flat), dims)]
                q = proj.project(_unit(raw, dims))
                label, cid, m = b.column(0), b.column(2).to_numpy(), b.column(3).to_numpy()
                vectors = pa.array(raw, pa.binary())
                for k in range(proj.sets):
                    v = proj.leads(q, k)
                    low, high = proj.cells(v - proj.half), proj.cells(v + proj.half)
                    outs = [(np.arange(len(v)), proj.cells(v), 0)]
                    at, cells = np.arange(len(v)), low.copy()
                    for d in range(proj.deep):  # each projection's window lies in one cell or two
                        two = np.flatnonzero(high[at, d] != low[at, d])
                        more = cells[two].copy()
                        more[:, d] = high[at[two], d]
                        at, cells = np.concatenate([at, at[two]]), np.concatenate([cells, more])
                    outs.append((at, cells, 1))
                    for at, cells, role in outs:
                        n = len(at)
                        yield pa.RecordBatch.from_arrays(
                            [label.take(pa.array(at)), pa.array(_cell_key(cells, k)), pa.array(np.full(n, k)), pa.array(np.full(n, role)), pa.array(cid[at]), pa.array(m[at]), vectors.take(pa.array(at))],
                            names=["label", "cell", "k", "role", "cid", "m", "raw"],
                        )

    kind = classes.schema["label"].dataType.simpleString()
    dealt = classes.select("label", "v", "cid", "m").mapInArrow(deal, f"label {kind}, cell bigint, k bigint, role bigint, cid bigint, m bigint, raw binary")
    dealt = scratch.cut(dealt.withColumn("cell", F.xxhash64("label", "cell")).drop("label"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups_of(batches, 4):
            role, cid, m = (g.column(c).to_numpy() for c in ("role", "cid", "m"))
            if role.min() == 1 or role.max() == 0:
                continue
            ids, root, linked = _counted(role, cid, m, _unit(g.column("raw").to_pylist(), dims), g.column("k")[0].as_py(), proj, threshold)
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(root), pa.array(linked)], names=["cid", "root", "linked"])

    n = max(1, int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = _met(dealt, BLOCK).repartition(n, "cell", "block", "other").sortWithinPartitions("cell", "block", "other", "k").mapInArrow(compare, "cid bigint, root bigint, linked bigint")
    found = scratch.cut(found)
    return found.select("cid", "linked"), found.where("cid <> root").select(F.col("cid").alias("a"), F.col("root").alias("b")).distinct()
