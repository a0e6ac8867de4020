"""Line dedup: multi-line chunks with content-defined boundaries, removed where they repeat."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattgrid.functions.scratch import Scratch

#: A chunk ends where the rolling hash of its last WINDOW lines is 0 modulo MEAN, not before LEAST lines.
WINDOW, MEAN, LEAST = 2, 3, 2
#: Hashes that hold over one in MOST_HOT of all chunks are broadcast; there are at most MOST_HOT of them, whatever the input.
MOST_HOT = 10_000


def chunk_spans(hashes: list[int], window: int = WINDOW, mean: int = MEAN, least: int = LEAST) -> list[tuple[int, int]]:
    """(first line, lines) of each chunk. Boundaries depend on nearby lines alone, so they fall in step again after an insertion."""
    spans, first = [], 0
    for i in range(len(hashes)):
        if i + 1 - first >= least:
            rolled = 0
            for h in hashes[i + 1 - window : i + 1]:
                rolled = (rolled * 0x9E3779B97F4A7C15 + h) & 0xFFFFFFFFFFFFFFFF
            if (rolled ^ (rolled >> 29)) % mean == 0:
                spans.append((first, i + 1 - first))
                first = i + 1
    if first < len(hashes):
        spans.append((first, len(hashes) - first))
    return spans


def text_chunks(text: str, seed: int, least: int = LEAST) -> list[tuple[int, int, int, str]]:
    """(hash, first line, lines, chunk) of the chunks that may be removed: of at least ``least`` lines, and not blank."""
    lines = text.split("\n")
    if len(lines) < least:
        return []
    out = []
    for first, n in chunk_spans([xxhash.xxh3_64_intdigest(x) for x in lines]):
        chunk = "\n".join(lines[first : first + n])
        if n >= least and not chunk.isspace() and chunk:
            out.append((xxhash.xxh3_64_intdigest(chunk, seed) - (1 << 63), first, n, chunk))
    return out


def row_key(id_col: Column, text: Column) -> list[Column]:
    """128 bits that name a row by its id and text; rows that repeat both share it."""
    return [F.xxhash64(id_col, text).alias("k1"), F.xxhash64(F.lit(1), text, id_col).alias("k2")]


def _by_hash(rows: DataFrame, table: DataFrame, total: int) -> DataFrame:
    """rows joined with table (one row per h, with times) on h; a hash with very many rows meets none of them in one task."""
    hot = F.col("times") * MOST_HOT > total
    many = F.broadcast(table.where(hot))
    rest = rows.join(F.broadcast(table.where(hot).select("h")), "h", "left_anti").join(table.where(~hot).hint("merge"), "h")
    return rows.join(many, "h").union(rest)


def find_repeats(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k1, k2, first, n): the chunks to remove, by row_key. Of equal chunks the one with the smallest (id, key, line) stays."""
    doc, text = F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(*row_key(doc, text), doc.cast("bigint").alias("doc_id"), text.alias("text"))
    seed = 0
    while True:

        def hashed(batches: Iterator[pa.RecordBatch], seed: int = seed) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = [(k1, k2, d, *c[:3]) for k1, k2, d, t in zip(*[b.column(i).to_pylist() for i in range(4)]) for c in text_chunks(t, seed)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["k1", "k2", "doc_id", "h", "first", "n"])

        found = scratch.cut(rows.mapInArrow(hashed, "k1 bigint, k2 bigint, doc_id bigint, h bigint, first bigint, n bigint").distinct())
        total, counts = found.count(), scratch.cut(found.groupBy("h").agg(F.count("*").alias("times")).where("times > 1"))
        often = scratch.cut(_by_hash(found, counts, total).select("k1", "k2", "doc_id", "h", "first", "n"))
        scratch.drop(found)

        def texts(batches: Iterator[pa.RecordBatch], seed: int = seed) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = []
                for k1, k2, d, t, wanted in zip(*[b.column(i).to_pylist() for i in range(5)]):
                    some = set(wanted)
                    out += [(h, c, d, k1, k2, f) for h, f, _, c in text_chunks(t, seed) if f in some]
                if out:
                    cols = list(zip(*out))
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), *[pa.array(c, pa.int64()) for c in cols[2:]]], names=["h", "chunk", "doc_id", "k1", "k2", "first"])

        wanted = often.groupBy("k1", "k2").agg(F.collect_list("first").alias("wanted"))
        chunks = rows.join(wanted.hint("merge"), ["k1", "k2"]).select("k1", "k2", "doc_id", "text", "wanted").mapInArrow(texts, "h bigint, chunk string, doc_id bigint, k1 bigint, k2 bigint, first bigint")
        equal = chunks.groupBy("h", "chunk").agg(F.min(F.struct("doc_id", "k1", "k2", "first")).alias("keep"))
        groups = scratch.cut(equal.groupBy("h").agg(F.count("*").alias("n_texts"), F.min("keep").alias("keep")).join(counts, "h"))
        scratch.sweep()
        if groups.where("n_texts > 1").isEmpty():
            out = _by_hash(often, groups.select("h", "keep", "times"), total)
            return scratch.cut(out.where(~((F.col("k1") == F.col("keep.k1")) & (F.col("k2") == F.col("keep.k2")) & (F.col("first") == F.col("keep.first")))).select("k1", "k2", "first", "n"))
        scratch.drop(often, groups, counts)
        seed += 1


def _without(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
    out = []
    for text, gone in zip(texts, spans):
        lines = text.split("\n")
        if gone is None or not len(gone):
            out.append((text, len(lines) if text else 0, 0))
            continue
        keep = np.ones(len(lines), bool)
        for s in gone:
            keep[s["first"] : s["first"] + s["n"]] = False
        out.append(("\n".join([x for x, k in zip(lines, keep) if k]), len(lines), int((~keep).sum())))
    return pd.DataFrame(out, columns=["text", "n_lines", "n_removed"])


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, done): the input row as a struct, and a struct of text without repeated chunks, n_lines and n_removed.

    Lines end at a line feed. Chunk boundaries follow a rolling hash of line hashes; chunks of one line and blank chunks are
    never removed. Chunks count as equal only when their bytes are: the bytes of chunks with equal hashes are grouped, and if
    two differ all chunks are hashed anew with another seed. Of equal chunks, also within a document, the one with the
    smallest id and line stays (a null id is the smallest); rows that repeat both id and text are treated alike.
    Ids are numbers. Null texts count as empty and have no lines. An empty table gives an empty result.

    Texts meet the lists of their chunks twice, in sort-merge joins at every size: the lists have no bound for a broadcast.
    """
    scratch = Scratch(docs.sparkSession, "line-dedup")
    gone = find_repeats(docs, scratch, id_col, text_col).groupBy("k1", "k2").agg(F.collect_list(F.struct("first", "n")).alias("gone"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), text.alias("text_"), *row_key(F.col(id_col), text))
    return rows.join(gone.hint("merge"), ["k1", "k2"], "left").select("row", F.pandas_udf(_without, "struct<text:string,n_lines:bigint,n_removed:bigint>")("text_", "gone").alias("done"))


def line_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, n_lines, n_removed, kept_sha256 (of the text that stays)."""
    out = dedup_lines(docs, id_col, text_col)
    return out.select(F.col(f"row.{id_col}").alias("doc_id"), "done.n_lines", "done.n_removed", F.sha2(F.col("done.text").cast("binary"), 256).alias("kept_sha256"))
