"""Personal data: e-mail addresses, IP addresses, card and phone numbers by their form, and by contexts learnt from these.

The spans found by form are seeds. The words around them are patterns; patterns and the values that stand in them form a graph
over the whole corpus, on which patterns and unseen values score one another. Patterns that score high name further values.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattgrid.functions.scratch import Scratch
from wattgrid.llm.words import LIMIT, hashed_words, mixed

KINDS = ("email", "ip", "card", "phone")
#: A pattern needs so many different seeds and one in SHARE of its kind's seeds; so there are at most 4 * SHARE patterns of a kind, whatever the corpus.
LEAST_VALUES, SHARE = 5, 2000
#: Score from which a pattern names values, how much of its best pattern's score an unseen value has, and characters of a value at least.
CONFIDENT, DAMPED, LEAST_LENGTH = 0.8, 0.5, 4
#: Rounds of scoring: each halves what is left to change.
ROUNDS, CLOSE = 20, 1e-3

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TELLS = re.compile(rb"[0-9@]")
_OPENS, _CLOSES = b"=:\"'([<{", b".,;:!?\"')]}>"


def _luhn(digits: str) -> bool:
    back = [int(d) for d in reversed(digits)]
    return (sum(back[::2]) + sum(d * 2 - 9 * (d > 4) for d in back[1::2])) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the spans found by form, in code points, in order. Each kind is searched from left to right in time in proportion to the text; what fails its check is left out."""
    out, end = [], 0
    for m in _DOMAIN.finditer(text):
        at = first = m.start()
        while first > end and text[first - 1] in _LOCAL:
            first -= 1
        if first < at:
            out.append((first, 0, m.end()))
            end = m.end()
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and _luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


@dataclass
class Slots:
    """Places of texts where a value stands: text number, kind (-1 where none was found by form), start and end in code points, hash of the value, and four contexts as hashes (0 where there is none)."""

    text: np.ndarray
    kind: np.ndarray
    start: np.ndarray
    end: np.ndarray
    value: np.ndarray
    contexts: np.ndarray


def _contexts(glued: np.ndarray, before: np.ndarray, before2: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Four patterns of a place: what stands right before it, that and one word more, the word after it, and both sides. Hashes of 0 stand for nothing."""

    def of(kind: int, *parts: np.ndarray) -> np.ndarray:
        x, there = np.full(len(glued), kind, np.uint64), np.ones(len(glued), bool)
        for p in parts:
            x, there = mixed(x * np.uint64(0x9E3779B97F4A7C15) + p), there & (p != 0)
        return np.where(there, x | np.uint64(1), np.uint64(0))

    stuck = glued != 0
    near, far = np.where(stuck, glued, before), np.where(stuck, before, before2)
    return np.stack([of(1, near), of(2, near, far), of(3, after), of(4, near, after)])


def _hash(b: bytes) -> int:
    return xxhash.xxh3_64_intdigest(b) | 1


def slots(texts: list[str], spans: list[list[tuple[int, int, int]]]) -> tuple[Slots, np.ndarray]:
    """The places of spans and of words that look like identifiers (they hold a digit or @, and no span), and the contexts of all other words.

    Words lie between ASCII white space, without regard to A-Z or a-z. What is stuck to a value before it, up to an opening sign, belongs to its context.
    """
    lows = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
    found = list(hashed_words(lows))
    sizes = np.array([len(h) for h, _, _ in found], np.int64)
    offsets = np.r_[0, np.cumsum(sizes)]
    h = np.concatenate([x | np.uint64(1) for x, _, _ in found]) if found else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(texts)), sizes)
    pad = np.r_[np.zeros(2, np.uint64), h, np.zeros(1, np.uint64)]
    same = np.r_[np.full(2, -1), doc, -1]
    word = lambda i, d: np.where(same[i + 2] == d, pad[i + 2], np.uint64(0))
    rows, other = [], np.ones(len(h), bool)
    for k, (low, (_, a, b)) in enumerate(zip(lows, found)):
        told = np.unique(np.searchsorted(b, [m.start() for m in _TELLS.finditer(low)], "right")) if len(a) else []
        if not len(told) and not spans[k]:
            continue
        at = None if len(low) == len(texts[k]) else np.r_[np.flatnonzero((np.frombuffer(low, np.uint8) & 0xC0) != 0x80), len(low)]
        taken = set()
        for s, kind, e in spans[k]:
            bs, be = (s, e) if at is None else (at[s], at[e])
            i, j = int(np.searchsorted(b, bs, "right")), int(np.searchsorted(a, be, "left"))
            taken.update(range(i, j))
            glued = low[a[i] : bs]
            rows.append((k, kind, s, e, _hash(low[bs:be]), _hash(glued) if glued else 0, offsets[k] + i, offsets[k] + j))
        other[offsets[k] + np.array(sorted(taken), np.int64)] = False
        for i in told:
            if int(i) in taken:
                continue
            w = low[a[i] : b[i]]
            first = _TELLS.search(w).start()
            cut = max(w.rfind(c, 0, first) for c in (bytes([c]) for c in _OPENS)) + 1
            core = w[cut:].rstrip(_CLOSES)
            if len(core) < LEAST_LENGTH or not _TELLS.search(core):
                continue
            bs = a[i] + cut
            s, e = (bs, bs + len(core)) if at is None else np.searchsorted(at, [bs, bs + len(core)])
            other[offsets[k] + i] = False
            rows.append((k, -1, s, e, _hash(core), _hash(w[:cut]) if cut else 0, offsets[k] + i, offsets[k] + i + 1))
    cols = list(zip(*rows)) or [()] * 8
    text, kind, start, end, i, j = (np.array(c, np.int64) for c in (*cols[:4], *cols[6:]))
    value, glued = (np.array(c, np.uint64) for c in cols[4:6])
    places = Slots(text, kind, start, end, value, _contexts(glued, word(i - 1, text), word(i - 2, text), word(j, text)))
    n = np.flatnonzero(other)
    d = doc[n]
    return places, _contexts(np.zeros(len(n), np.uint64), word(n - 1, d), word(n - 2, d), word(n + 1, d))


def _groups(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about LIMIT characters together, with the number of the first."""
    first, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size > LIMIT:
            yield first, texts[first : k + 1]
            first, size = k + 1, 0
    if first < len(texts):
        yield first, texts[first:]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _seed_patterns(texts: DataFrame) -> list[tuple[int, int]]:
    """(kind, context) of the contexts that hold enough seeds of a kind."""

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, some in _groups(b.column(0).to_pylist()):
                spans = [base_spans(t) for t in some]
                having = [k for k, s in enumerate(spans) if s]
                if not having:
                    continue
                p, _ = slots([some[k] for k in having], [spans[k] for k in having])
                own = p.kind >= 0
                kind, value, contexts = p.kind[own], p.value[own], p.contexts[:, own]
                kinds, values, all_ = np.r_[np.tile(kind, 4), kind], np.r_[np.tile(value, 4), value], np.r_[contexts.ravel(), np.zeros(len(kind), np.uint64)]
                there = (all_ != 0) | (np.arange(len(all_)) >= 4 * len(kind))
                yield pa.RecordBatch.from_arrays([pa.array(kinds[there]), _signed(all_[there]), _signed(values[there])], names=["kind", "context", "value"])

    rows = texts.mapInArrow(seeds, "kind bigint, context bigint, value bigint").groupBy("kind", "context", "value").agg(F.count("*").alias("n"))
    per = rows.groupBy("kind", "context").agg(F.sum("n").alias("n"), F.count("*").alias("n_values"))
    per = Scratch(texts.sparkSession, "patterns").cut(per)
    total = {r["kind"]: r["n"] for r in per.where("context = 0").collect()}
    enough = F.lit(False)
    for kind, n in total.items():
        enough = enough | ((F.col("kind") == kind) & (F.col("n") * SHARE >= n))
    return [(r["kind"], r["context"]) for r in per.where(f"context <> 0 and n_values >= {LEAST_VALUES}").where(enough).collect()]


def _edges(texts: DataFrame, contexts: np.ndarray) -> DataFrame:
    """(context, value, kind, n): how often a value stands in a context; ordinary words are counted under value 0 and kind -2 (a row per context and task), identifiers without a kind have -1."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordinary = np.zeros(len(contexts), np.int64)
        for b in batches:
            for _, some in _groups(b.column(0).to_pylist()):
                p, rest = slots(some, [base_spans(t) for t in some])
                at = np.searchsorted(contexts, rest.ravel())
                at[at == len(contexts)] = 0
                np.add.at(ordinary, at[contexts[at] == rest.ravel()], 1)
                flat = p.contexts.ravel()
                hit = np.flatnonzero(np.isin(flat, contexts))
                if len(hit):
                    of = hit % len(p.kind)
                    yield pa.RecordBatch.from_arrays([_signed(flat[hit]), _signed(p.value[of]), pa.array(p.kind[of]), pa.array(np.ones(len(hit), np.int64))], names=["context", "value", "kind", "n"])
        at = np.flatnonzero(ordinary)
        yield pa.RecordBatch.from_arrays([_signed(contexts[at]), pa.array(np.zeros(len(at), np.int64)), pa.array(np.full(len(at), -2)), pa.array(ordinary[at])], names=["context", "value", "kind", "n"])

    return texts.mapInArrow(count, "context bigint, value bigint, kind bigint, n bigint").groupBy("context", "value", "kind").agg(F.sum("n").alias("n"))


def learn_patterns(docs: DataFrame, text_col: str = "text") -> dict[int, tuple[int, float]]:
    """Contexts that name values, with their kind and score, learnt from all documents.

    A pattern's score for a kind is the share of its places that hold seeds of that kind, where an unseen value counts with
    DAMPED times the score of the best pattern that it stands in; so patterns and values raise one another round after round.
    Patterns that could not reach CONFIDENT if all their unseen values were as good as they can be have no say. Places with
    ordinary words, or values of other kinds, count against a pattern.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(text_col).cast("string").alias("text")).where("text is not null")
    wanted = _seed_patterns(texts)
    if not wanted:
        return {}
    scratch = Scratch(spark, "contexts")
    edges = scratch.cut(_edges(texts, np.unique(np.array([c for _, c in wanted], np.int64).view(np.uint64))))
    sums = {(r["context"], r["kind"]): r["n"] for r in edges.groupBy("context", "kind").agg(F.sum("n").alias("n")).toLocalIterator()}
    all_of: dict[int, int] = {}
    for (c, _), n in sums.items():
        all_of[c] = all_of.get(c, 0) + n
    seeded = {(k, c): sums.get((c, k), 0) / all_of[c] for k, c in wanted}
    score = {(k, c): s for (k, c), s in seeded.items() if s + DAMPED * sums.get((c, -1), 0) / all_of[c] >= CONFIDENT}
    if score:
        open_ = spark.createDataFrame(sorted({c for _, c in score}), "bigint").toDF("context")
        unseen = scratch.cut(edges.where("kind = -1").join(F.broadcast(open_), "context", "left_semi").select("context", "value", "n"))
        for _ in range(ROUNDS if not unseen.isEmpty() else 0):
            known = spark.createDataFrame([(k, c, s) for (k, c), s in score.items()], "kind bigint, context bigint, score double")
            best = unseen.join(F.broadcast(known), "context").groupBy("value", "kind").agg((DAMPED * F.max("score")).alias("s"))
            more = unseen.join(best, "value").groupBy("kind", "context").agg(F.sum(F.col("n") * F.col("s")).alias("more"))
            raised = {(r["kind"], r["context"]): r["more"] for r in more.join(F.broadcast(known.select("kind", "context")), ["kind", "context"], "left_semi").collect()}
            new = {(k, c): seeded[k, c] + raised.get((k, c), 0.0) / all_of[c] for k, c in score}
            change, score = max(abs(new[x] - score[x]) for x in score), new
            if change < CLOSE:
                break
    out: dict[int, tuple[int, float]] = {}
    for (k, c), s in sorted(score.items(), key=lambda x: (x[1], -x[0][0])):
        if s >= CONFIDENT:
            out[c] = (k, s)
    return out


def find_personal(docs: DataFrame, patterns: dict[int, tuple[int, float]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans (kind, start, end, text, learnt): the personal data of every document, by start, then kind; learnt marks what a pattern named.

    Patterns are learnt from docs unless given (learn_patterns). A learnt span is a word with a digit or @ that no span found by form
    touches, without the signs around it, in a confident context; of several contexts the best names its kind. Start
    and end count code points. Ids are passed on as they are, nulls and repeated ones too; a null text counts as empty; other
    columns are ignored; an empty table gives an empty result.
    """
    known = learn_patterns(docs, text_col) if patterns is None else patterns
    contexts = np.unique(np.array(list(known), np.int64).view(np.uint64))
    kind_of = [known[int(c)][0] for c in contexts.view(np.int64)]
    score_of = [known[int(c)][1] for c in contexts.view(np.int64)]
    rows = docs.select(F.struct(F.col(id_col)).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def named(texts: list[str]) -> list[list[dict]]:
        base = [base_spans(t) for t in texts]
        out = [[(s, k, e, False) for s, k, e in spans] for spans in base]
        if len(contexts):
            p, _ = slots(texts, base)
            for i in np.flatnonzero((p.kind < 0) & np.isin(p.contexts, contexts).any(0)):
                at = [int(a) for a in np.searchsorted(contexts, p.contexts[:, i]) if a < len(contexts) and contexts[a] in p.contexts[:, i]]
                best = max(at, key=lambda a: (score_of[a], -kind_of[a]))
                out[p.text[i]].append((int(p.start[i]), kind_of[best], int(p.end[i]), True))
        return [[{"kind": KINDS[k], "start": s, "end": e, "text": t[s:e], "learnt": learnt} for s, k, e, learnt in sorted(spans)] for t, spans in zip(texts, out)]

    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string()), ("learnt", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, some in _groups(b.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(some)), pa.array(named(some), pa.list_(span))], names=["id", "spans"])

    found = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, spans array<struct<kind:string,start:bigint,end:bigint,text:string,learnt:boolean>>")
    return found.select(F.col("id")[id_col].alias("doc_id"), "spans")


def personal_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (of spans found by form), base_sha256 of these, spans: all as kind:start:end, and n_learnt."""
    found = find_personal(docs, None, id_col, text_col)
    base = F.filter("spans", lambda s: ~s["learnt"])
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")
    return found.select("doc_id", *map(of, KINDS), F.sha2(said(base).cast("binary"), 256).alias("base_sha256"), said("spans").alias("spans"), F.size(F.filter("spans", lambda s: s["learnt"])).cast("bigint").alias("n_learnt"))
