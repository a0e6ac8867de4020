"""Substring dedup: windows of words that occur more than once, found by an FM-index per shard."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattgrid.functions.scratch import Scratch
from wattgrid.llm.fm_index import FMIndex
from wattgrid.llm.words import hashed_words, mixed, rolled

WINDOW, ANCHOR = 35, 8
#: Words of a piece that is streamed through an index.
PIECE = 128
#: Words of a shard, and places of one anchor that go to one shard; texts whose anchors a task has written. They bound the memory of a task.
SHARD_WORDS, HOT_SEGMENTS, SEEN = 600_000, 4_000, 200_000
#: Places of a text that are dealt to a shard together where their anchor is a hot one, so that one text may lie in many shards.
BLOCK = 2_048


def window_anchors(h: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray]:
    """For each window the place of its anchor, the leftmost of its smallest hashes of ``anchor`` words, and all those hashes. Equal windows have equal anchors at equal places."""
    grams = rolled(h, anchor)
    width = window - anchor + 1
    if len(grams) < width:
        return np.zeros(0, np.int64), grams
    return sliding_window_view(grams, width).argmin(axis=1) + np.arange(len(grams) - width + 1), grams


def spread(anchor: np.ndarray, shards: int) -> np.ndarray:
    return (mixed(anchor.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)) % np.uint64(shards)).astype(np.int64)


def text_key(text: Column) -> list[Column]:
    """128 bits that name a text."""
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]


def _runs(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.r_[False, mask, False].astype(np.int8)))
    return list(zip(edge[::2].tolist(), (edge[1::2] - edge[::2]).tolist()))


def repeated_in_shard(segments: pa.Table, window: int) -> Iterator[tuple]:
    """Rows (t1, t2, start, n, h1, h2, kind) for one shard of segments (t1, t2, start, windows, hot, words).

    The shard's words are numbered by their bytes and its texts are indexed; then they are streamed through the index in
    pieces, and where the matching statistic, the longest match that the index holds twice, reaches the window, it is
    repeated. kind 0: n words from start are covered by windows that occur elsewhere in the shard. Windows of a hot
    segment, whose equals may be in other shards, also leave 128 bits of their bytes: kind 1 once for each window without an
    equal here, kind 2 once for those with one.
    """
    t1, t2, start, windows, hot = (segments.column(i).to_numpy() for i in range(5))
    words = [w.encode().split() for w in segments.column(5).to_pylist()]
    named = pa.array([w for some in words for w in some], pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64) + 1
    cuts = np.cumsum([len(w) for w in words])[:-1]
    names_of = np.split(named, cuts)
    parts, place, at_text = [], np.zeros(len(words), np.int64), 0  # place: of a segment's first word in the shard's text
    last, reach, base = None, 0, 0
    for i in np.lexsort((start, t2, t1)).tolist():
        some, key, a = names_of[i], (t1[i], t2[i]), int(start[i])
        if key == last and a <= reach:  # segments of a text that touch are one sequence
            some = some[reach - a :]
        else:
            if last is not None:
                parts.append(np.zeros(1, np.int64))
                at_text += 1
            base, last, reach = at_text - a, key, a
        place[i] = base + a
        parts.append(some)
        at_text += len(some)
        reach += len(some)
    text = np.concatenate([*parts, np.zeros(1, np.int64)])
    ends = np.flatnonzero(text == 0)
    starts = np.r_[0, ends[:-1] + 1]
    begin = np.concatenate([np.arange(a, b, PIECE) for a, b in zip(starts, ends)])
    stop = np.minimum(begin + PIECE + window - 1, np.repeat(ends, -(-(ends - starts) // PIECE)))
    longest = FMIndex(text, PIECE + window).matching_statistics(text, begin, stop)
    size = stop - begin
    offset = np.arange(len(longest)) - np.repeat(np.cumsum(size) - size, size)
    own = np.flatnonzero(offset < PIECE)  # places beyond are the next piece's
    twice = np.zeros(len(text), bool)
    twice[(np.repeat(begin, size) + offset)[own]] = longest[own] >= window
    told: set[bytes] = set()
    for i in range(len(place)):
        n = int(windows[i])
        found = twice[place[i] : place[i] + n]
        key, first = (int(t1[i]), int(t2[i])), int(start[i])
        for a, k in _runs(found):
            yield (*key, first + a, k + window - 1, 0, 0, 0)
        if hot[i]:
            for k in range(n):
                digest = xxhash.xxh3_128_digest(b" ".join(words[i][k : k + window]))
                if not found[k]:
                    yield (*key, first + k, window, *np.frombuffer(digest, np.int64).tolist(), 1)
                elif digest not in told:
                    told.add(digest)
                    yield (*key, first + k, window, *np.frombuffer(digest, np.int64).tolist(), 2)


def repeated_spans(docs: DataFrame, scratch: Scratch, text_col: str = "text", window: int = WINDOW, hot_segments: int = HOT_SEGMENTS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(t1, t2, whole, gone): by text_key, whether the text occurs more than once, and spans (start, n) of words in repeated windows."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(*text_key(text), text.alias("text"))

    def anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for b in batches:
            for i in range(0, b.num_rows, 500):
                some, out = b.slice(i, 500), []
                for a, c, (h, _, _) in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), hashed_words([t.encode() for t in some.column(2).to_pylist()])):
                    if (a, c) in seen:
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add((a, c))
                    if len(h) >= window:
                        at, grams = window_anchors(h, window)
                        at = np.unique(at)
                        out.append((a, c, grams[at].astype(np.int64), at.astype(np.int32)))
                if out:
                    x = list(zip(*out))
                    yield pa.RecordBatch.from_arrays([pa.array(x[0], pa.int64()), pa.array(x[1], pa.int64()), pa.array(x[2], pa.list_(pa.int64())), pa.array(x[3], pa.list_(pa.int32()))], names=["t1", "t2", "anchors", "at"])

    found = scratch.cut(rows.mapInArrow(anchored, "t1 bigint, t2 bigint, anchors array<bigint>, at array<int>"))
    often = scratch.cut(found.select(F.explode("anchors").alias("anchor")).groupBy("anchor").agg(F.count("*").alias("times")).where("times > 1"))
    total = often.agg(F.sum("times")).first()[0] or 0
    shards = max(1, math.ceil(total * 50 / shard_words))
    places = found.select("t1", "t2", F.explode(F.arrays_zip("anchors", "at")).alias("x")).select("t1", "t2", F.col("x.anchors").alias("anchor"), F.col("x.at").alias("at"))
    wanted = places.join(often, "anchor").groupBy("t1", "t2").agg(F.collect_list(F.struct("at", "times")).alias("wanted"))

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["shard", "t1", "t2", "start", "windows", "hot", "words"]
        for b in batches:
            for i in range(0, b.num_rows, 200):
                some, out = b.slice(i, 200), []
                times = some.column(3).flatten()
                counts = np.r_[0, np.cumsum(pa.compute.list_value_length(some.column(3)).to_numpy())]
                at_all, times_all = times.field("at").to_numpy(), times.field("times").to_numpy()
                texts = [t.encode() for t in some.column(2).to_pylist()]
                for k, (a, c, t, (h, starts, ends)) in enumerate(zip(some.column(0).to_pylist(), some.column(1).to_pylist(), texts, hashed_words(texts))):
                    anchor_at, grams = window_anchors(h, window)
                    often_at = np.zeros(len(grams), np.int64)
                    often_at[at_all[counts[k] : counts[k + 1]]] = times_all[counts[k] : counts[k + 1]]
                    many = often_at[anchor_at]
                    salts = np.maximum(1, -(-many // hot_segments)).astype(np.uint64)
                    block = np.arange(len(many), dtype=np.uint64) // np.uint64(min(BLOCK, hot_segments))
                    salt = mixed(np.full(1, a, np.int64).astype(np.uint64) + block * np.uint64(0xD1342543DE82EF95)) % salts
                    shard = np.where(many > 0, spread(grams[anchor_at] + salt * np.uint64(0x9E3779B97F4A7C15), shards), -1)
                    hot = many > hot_segments
                    cut = np.flatnonzero(np.r_[True, (shard[1:] != shard[:-1]) | (hot[1:] != hot[:-1]), True])
                    for x, y in zip(cut[:-1].tolist(), cut[1:].tolist()):
                        if shard[x] >= 0:
                            out.append((int(shard[x]), a, c, x, y - x, bool(hot[x]), t[starts[x] : ends[y + window - 2]].decode()))
                if out:
                    kinds = [pa.int64()] * 5 + [pa.bool_(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(zip(*out), kinds)], names=names)

    uniq = rows.groupBy("t1", "t2").agg(F.first("text").alias("text"))
    cut_out = uniq.join(wanted, ["t1", "t2"]).select("t1", "t2", "text", "wanted").mapInArrow(segments, "shard bigint, t1 bigint, t2 bigint, start bigint, windows bigint, hot boolean, words string")

    def search(shard: pa.Table) -> pa.Table:
        out = list(repeated_in_shard(shard.select(["t1", "t2", "start", "windows", "hot", "words"]), window))
        names = ["t1", "t2", "start", "n", "h1", "h2", "kind"]
        return pa.table([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 7)], names=names)

    told = scratch.cut(cut_out.groupBy("shard").applyInArrow(search, "t1 bigint, t2 bigint, start bigint, n bigint, h1 bigint, h2 bigint, kind bigint"))
    scratch.sweep()
    shared = told.where("kind > 0").groupBy("h1", "h2").agg(F.count("*").alias("shards")).where("shards > 1")
    spans = told.where("kind = 0").select("t1", "t2", "start", "n").union(told.where("kind = 1").join(shared, ["h1", "h2"]).select("t1", "t2", "start", "n"))
    spans = spans.groupBy("t1", "t2").agg(F.collect_list(F.struct("start", "n")).alias("gone"))
    copies = rows.select("t1", "t2").groupBy("t1", "t2").agg(F.count("*").alias("rows")).where("rows > 1").select("t1", "t2", F.lit(True).alias("whole"))
    return scratch.cut(copies.join(spans, ["t1", "t2"], "full").select("t1", "t2", F.coalesce("whole", F.lit(False)).alias("whole"), "gone"))


def _kept(window: int):
    def run(texts: pd.Series, whole: pd.Series, gone: pd.Series) -> pd.DataFrame:
        out = []
        for text, all_of_it, spans in zip(texts, whole, gone):
            words = text.encode().split()
            n = len(words)
            if all_of_it and n >= window:
                out.append(("", n, n))
                continue
            if spans is not None and len(spans):
                keep = np.ones(n, bool)
                for s in spans:
                    keep[s["start"] : s["start"] + s["n"]] = False
                words = [w for w, k in zip(words, keep.tolist()) if k]
            out.append((b" ".join(words).decode(), n, n - len(words)))
        return pd.DataFrame(out, columns=["text", "n_words", "n_removed"])

    return F.pandas_udf(run, "struct<text:string,n_words:bigint,n_removed:bigint>")


def dedup_substrings(docs: DataFrame, text_col: str = "text", window: int = WINDOW, hot_segments: int = HOT_SEGMENTS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(row, done): the input row as a struct, and a struct of the words that stay (joined by a space), n_words and n_removed.

    Words lie between ASCII white space, unchanged. Every word in a window of ``window`` words whose sequence also starts
    anywhere else, in the same text or another row, is removed, all occurrences alike; windows are judged on the input.
    Windows with equal anchors meet in a shard; where very many share one, its shards are salted by text and block of places,
    so that one long text full of an anchor is split too, and windows that two of them report are repeated as well. In a shard words are told apart by their bytes; hashes of 64 bits only choose anchors. Texts, and
    windows of two such shards, are told apart by 128 bits: among 10^13 of them two differing ones meet with a chance of 10^-12.

    Null texts count as empty. Shorter texts than a window lose nothing. Ids play no part: rows that repeat are occurrences
    of their own. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "substring-dedup")
    marks = repeated_spans(docs, scratch, text_col, window, hot_segments, shard_words)
    scratch.keep_only(marks)
    scratch.sweep()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), text.alias("text_"), *text_key(text))
    return rows.join(marks, ["t1", "t2"], "left").select("row", _kept(window)("text_", F.coalesce("whole", F.lit(False)), "gone").alias("done"))


def substring_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, hot_segments: int = HOT_SEGMENTS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row per row: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space)."""
    out = dedup_substrings(docs.select(id_col, text_col), text_col, window, hot_segments, shard_words).select(F.col(f"row.{id_col}").alias("doc_id"), "done")
    return out.select("doc_id", "done.n_words", "done.n_removed", F.sha2(F.col("done.text").cast("binary"), 256).alias("kept_sha256"))

