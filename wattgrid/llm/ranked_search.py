"""Ranked lexical search of many queries at once: term sets that queries share are summed once per document."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattgrid.functions.scratch import Scratch

#: Queries are answered in blocks of so many queries, or so many different terms, at most; all documents are read for each block.
BLOCK_QUERIES, BLOCK_TERMS = 4096, 200_000
#: Sums that a task holds at once (64 MB), bytes of a text that are cut into terms at once, and parts that rank a query's hits before its last ranking.
CELLS, PIECE, PARTS = 1 << 23, 1 << 20, 64
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def term_counts(text: str, known: dict[bytes, int]) -> tuple[int, dict[int, int]]:
    """How many terms a text has, and how often each of the known ones (by number); the text is cut piece by piece, between terms."""
    raw, n, at, found = text.encode("utf-8", "surrogatepass").translate(_FOLD), 0, 0, {}
    while at < len(raw):
        to = len(raw)
        if to - at > PIECE:
            cut = raw.rfind(b" ", at, at + PIECE)
            cut = cut if cut >= 0 else raw.find(b" ", at + PIECE)
            to = cut + 1 if cut >= 0 else to
        terms = raw[at:to].split()
        n, at = n + len(terms), to
        for term, times in Counter(terms).items():
            k = known.get(term)
            if k is not None:
                found[k] = found.get(k, 0) + times
    return n, found


@dataclass(frozen=True)
class SharedPlan:
    """How the sums of a block of queries are made: terms are the first nodes, each level adds pairs of nodes made before it, and a query adds up its roots."""

    levels: tuple[tuple[int, np.ndarray, np.ndarray], ...]
    roots: tuple[np.ndarray, ...]
    nodes: int

    def sums(self, cells: np.ndarray) -> np.ndarray:
        """Sums per query (rows) and document (columns); cells: nodes by documents, of which the rows of terms are given."""
        for first, left, right in self.levels:
            cells[first : first + len(left)] = cells[left] + cells[right]
        return np.array([cells[r].sum(0) if len(r) else np.zeros(cells.shape[1], np.int64) for r in self.roots])


def share(queries: list[list[int]], n_terms: int) -> SharedPlan:
    """Mines term sets that queries share: a query's nodes are put in order of how many queries hold them, and neighbours that two
    queries or more have in common become one node, round after round, until none is shared. Each round takes time in proportion to the nodes left."""
    often = Counter(t for q in queries for t in q)
    rows = [sorted(q, key=lambda t: (-often[t], t)) for q in queries]
    levels, nodes = [], n_terms
    while True:
        pairs = Counter(p for r in rows for p in zip(r, r[1:]))
        picked: list[list[int]] = []
        for r in rows:  # places of pairs that don't overlap, of two neighbouring pairs the one that more queries have
            at, i = [], 0
            while i + 1 < len(r):
                here, after = pairs[r[i], r[i + 1]], pairs[r[i + 1], r[i + 2]] if i + 2 < len(r) else 0
                if here > 1 and here >= after:
                    at.append(i)
                    i += 1
                i += 1
            picked.append(at)
        used = Counter((r[i], r[i + 1]) for r, at in zip(rows, picked) for i in at)
        made = {p: nodes + k for k, p in enumerate(sorted(p for p, n in used.items() if n > 1))}
        if not made:
            return SharedPlan(tuple(levels), tuple(np.array(r, np.int64) for r in rows), nodes)
        levels.append((nodes, np.array([a for a, _ in made]), np.array([b for _, b in made])))
        nodes += len(made)
        for k, (r, at) in enumerate(zip(rows, picked)):
            for i in reversed(at):
                if (new := made.get((r[i], r[i + 1]))) is not None:
                    r[i : i + 2] = [new]
            rows[k] = r


@dataclass
class Best:
    """The k best documents of each query so far: of equal scores the smaller id, null ids last."""

    k: int
    hits: list[list[tuple[int, bool, int]]]
    least: np.ndarray

    def add(self, scores: np.ndarray, ids: list[int | None]) -> None:
        for q in np.flatnonzero(scores.max(1) >= self.least):
            row = scores[q]
            at = np.flatnonzero(row >= self.least[q])
            if len(at) > self.k:
                at = at[row[at] >= np.partition(row[at], -self.k)[-self.k]]
            best = sorted([*self.hits[q], *[(-int(row[i]), ids[i] is None, ids[i] or 0) for i in at]])[: self.k]
            self.hits[q] = best
            if len(best) == self.k:
                self.least[q] = -best[-1][0]


def _statistics(docs: DataFrame, known: dict[bytes, int]) -> tuple[int, int, np.ndarray]:
    """N, L and the documents of each known term, over all documents; a task sends a row per known term at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holding, n_docs, n_terms = np.zeros(len(known), np.int64), 0, 0
        for b in batches:
            for text in b.column(1).to_pylist():
                n, found = term_counts(text, known)
                n_docs, n_terms = n_docs + (n > 0), n_terms + n
                holding[list(found)] += 1
        at = np.flatnonzero(holding)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *at]), pa.array([n_docs, *holding[at]]), pa.array([n_terms, *[0] * len(at)])], names=["term", "docs", "terms"])

    rows = docs.mapInArrow(count, "term bigint, docs bigint, terms bigint").groupBy("term").agg(F.sum("docs").alias("docs"), F.sum("terms").alias("terms"))
    df, total = np.zeros(len(known), np.int64), (0, 0)
    for r in rows.toLocalIterator():
        if r["term"] < 0:
            total = r["docs"], r["terms"]
        else:
            df[r["term"]] = r["docs"]
    return *total, df


def _answer(docs: DataFrame, block: list[tuple[int | None, list[str]]], k: int) -> DataFrame:
    """(item_id, doc_id, score): for each query of a block the k best documents of each task."""
    known: dict[bytes, int] = {}
    queries = [[known.setdefault(t.encode("utf-8", "surrogatepass"), len(known)) for t in terms] for _, terms in block]
    n_docs, n_terms, df = _statistics(docs, known)
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    plan, item_ids = share(queries, len(known)), [i for i, _ in block]
    at_once = max(16, min(1024, CELLS // max(1, plan.nodes)))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(k, [[] for _ in queries], np.ones(len(queries), np.int64))
        cells = np.zeros((plan.nodes, at_once), np.int64)
        for whole in batches:
            for i in range(0, whole.num_rows, at_once):
                b = whole.slice(i, at_once)
                cells[: len(known)] = 0
                for d, text in enumerate(b.column(1).to_pylist()):
                    n, found = term_counts(text, known)
                    if found:
                        t, tf = np.fromiter(found, np.int64, len(found)), np.fromiter(found.values(), np.int64, len(found))
                        m = 10 + 90 * n * n_docs // n_terms
                        cells[t, d] = weights[t] * (1_000_000_000 * tf // (1000 * tf + 8 * m))
                best.add(plan.sums(cells)[:, : b.num_rows], b.column(0).to_pylist())
        hits = [(item_ids[q], None if none else d, -score) for q, found in enumerate(best.hits) for score, none, d in found]
        yield pa.RecordBatch.from_arrays([pa.array([h[c] for h in hits], pa.int64()) for c in range(3)], names=["item_id", "doc_id", "score"])

    return docs.mapInArrow(rank, "item_id bigint, doc_id bigint, score bigint")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: for each query item its k best documents with a score above 0, equal scores by ascending doc_id.

    Terms are letters, digits and whatever lies beyond ASCII, with A-Z lower-cased; a document's score is the sum over the
    item's different terms of floor(1000 ln((2N + 2) / (2df + 1))) times a saturated term frequency, in 64-bit integers.
    Items are answered in blocks against all documents. For a block, term sets that items share are mined and form a graph of
    sums: in each batch of documents a shared sum is made once and used by all items (and larger sets) that hold it. A task keeps
    the k best documents of each item; these are ranked in two steps, so no task meets more than a part of an item's hits.

    Ids are numbers. Null and empty texts have no terms, and items without terms no rows. Rows of items that share an id are one
    item with the terms of all; null is an id. Every row of docs is a document, also where ids repeat; a null doc_id comes after
    others of its score. Other columns are ignored; an empty table on either side gives an empty result.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.coalesce(F.col(doc_text).cast("string"), F.lit("")).alias("text"))
    low = F.translate(F.col(item_text).cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = items.select(F.col(item_id).cast("bigint").alias("item_id"), F.explode(F.array_distinct(F.regexp_extract_all(low, F.lit(TERM), F.lit(0)))).alias("term")).distinct()
    asked = words.groupBy("item_id").agg(F.sort_array(F.collect_set("term")).alias("terms")).sort("item_id")
    blocks, block, terms = [], [], set()
    for r in asked.toLocalIterator():
        if block and (len(block) == BLOCK_QUERIES or len(terms) + len(r["terms"]) > BLOCK_TERMS):
            blocks.append(_answer(texts, block, k))
            block, terms = [], set()
        block.append((r["item_id"], r["terms"]))
        terms.update(r["terms"])
    if block:
        blocks.append(_answer(texts, block, k))
    if not blocks:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    if len(blocks) > 1:
        scratch = Scratch(spark, "search")
        blocks = [scratch.cut(b) for b in blocks]
    hits = blocks[0]
    for b in blocks[1:]:
        hits = hits.union(b)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    part = F.pmod(F.hash("doc_id"), F.lit(PARTS))
    some = hits.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", part).orderBy(*order))).where(F.col("rank") <= k)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")
