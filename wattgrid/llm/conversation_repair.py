"""Conversation structure repair: cheapest edits by a Viterbi search that runs over chunks of a conversation at once.

A conversation is right when its role initials read (s?(ua)+)?. Keep costs 0, Rerole (to user or assistant) 2, Delete 3,
Insert (an empty text of user or assistant) 2; a row that stays and is cut off costs 1 more; blank and repeated rows must go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattgrid.functions.scratch import Scratch

#: Rows of a chunk at most, and what edits cost.
CHUNK, KEEP, REROLE, DELETE, INSERT, CUT_OFF = 1 << 16, 0, 2, 3, 2, 1
SPACES = " \t\n\x0b\f\r"
# Places in the wanted order: 0 nothing yet, 1 after s, 2 after u, 3 after a. ALTERNATE is where an added or given role leads, with NAMES its role.
ALTERNATE, NAMES = (2, 2, 3, 2), ("user", "user", "assistant", "user")
KEEPS = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None), "o": (None, None, None, None)}
#: What is left to pay after the last row, by place: the end must be at 0 or 3.
END = (0, 4, 2, 0)


def _settled(costs: list[int]) -> tuple[int, ...]:
    """Costs by place, where inserts may come first."""
    c = list(costs)
    for _ in range(2):
        c = [min(c[q], INSERT + c[ALTERNATE[q]]) for q in range(4)]
    return tuple(c)


@lru_cache(1 << 16)
def step(after: tuple[int, ...], kind: str) -> tuple[int, tuple[int, ...], tuple[tuple[str, int], ...]]:
    """One row, backwards: what all costs rise by, costs less that (least 0) before the row, and by place the ASCII-least cheapest edits up to this row with the place they lead to.

    kind: a role initial (s, u, a, or o for others), a capital where the row is cut off, or - where it must go. As costs count
    up to a constant only, few vectors exist, and each is worked out once.
    """
    initial, off = kind.lower(), CUT_OFF * kind.isupper()
    paid = []
    for q in range(4):
        if kind == "-":
            paid.append({"D": (DELETE + after[q], q)})
            continue
        ways = {"D": (DELETE + after[q], q), "R": (REROLE + off + after[ALTERNATE[q]], ALTERNATE[q])}
        to = KEEPS[initial][q]
        if to is not None:
            ways["K"] = (KEEP + off + after[to], to)
        paid.append(ways)
    before = _settled([min(c for c, _ in ways.values()) for ways in paid])
    edits = []
    for q in range(4):
        done, at = "", q
        while not (done and done[-1] != "I"):
            ways = {e: (c, to) for e, (c, to) in paid[at].items() if c == before[at]}
            if INSERT + before[ALTERNATE[at]] == before[at]:
                ways["I"] = before[at], ALTERNATE[at]
            e = min(ways)
            done, at = done + e, ways[e][1]
        edits.append((done, at))
    least = min(before)
    return least, tuple(c - least for c in before), tuple(edits)


def run_back(kinds: str, after: tuple[int, ...]) -> tuple[int, tuple[int, ...], tuple[int, ...]]:
    """A chunk's rows backwards from the costs after it: what costs rise by, costs before it, and by place at its start the place at its end."""
    rise, ends = 0, (0, 1, 2, 3)
    for kind in reversed(kinds):
        up, after, edits = step(after, kind)
        rise, ends = rise + up, tuple(ends[to] for _, to in edits)
    return rise, after, ends


def trace(kinds: str, after: tuple[int, ...], place: int) -> tuple[list[list[tuple[str, str | None]]], int]:
    """The edits of a chunk's rows, each with the inserts before it, as (letter, new role), from the place at its start and the costs after it; and the place at its end."""
    tables = []
    for kind in reversed(kinds):
        _, after, edits = step(after, kind)
        tables.append(edits)
    out = []
    for edits in reversed(tables):
        done, to = edits[place]
        row = []
        for e in done:
            row.append((e, NAMES[place] if e in "IR" else None))
            place = ALTERNATE[place] if e in "IR" else place
        place = to
        out.append(row)
    return out, place


def inserts_at_end(place: int) -> list[tuple[str, str]]:
    """The inserts that follow a conversation's last row."""
    out = []
    while place in (1, 2):
        out.append(("I", NAMES[place]))
        place = ALTERNATE[place]
    return out


def _text(costs: tuple[int, ...]) -> str:
    return ",".join(map(str, costs))


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, turn, role, text, copies: rows as the damage leaves them, decided by crc32("conv:turn") % 20; of dropped rows there are 0 copies. Nulls read as one space, a null turn stays null."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(blank(conv), F.lit(":"), blank(turn)).cast("binary")) % 20
    new_text = F.when(hit == 1, F.lit("")).when(hit == 2, F.regexp_replace(blank(text), "[.!?]", "")).otherwise(blank(text))
    return rows.select(
        F.col(conv).alias("conv"), F.col(turn).cast("bigint").alias("turn"), F.when(hit == 4, F.lit("user")).otherwise(blank(role)).alias("role"),
        new_text.alias("text"), F.when(hit == 0, 0).when(hit == 3, 2).otherwise(1).cast("bigint").alias("copies"),
    )


def _print(text: Column) -> Column:
    """128 bits of a text's SHA-256."""
    return F.substring(F.unhex(F.sha2(text.cast("binary"), 256)), 1, 16)


def _light(rows: DataFrame) -> DataFrame:
    """conv, turn, role, h, blank, cut_off, copies, n_rows: rows that agree in all columns once, without their texts."""
    last = F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1))
    light = rows.select("conv", "turn", "role", _print(F.col("text")).alias("h"), (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("cut_off"), "copies")
    return light.groupBy("conv", "turn", "role", "h", "blank", "cut_off").agg(F.sum("copies").alias("copies"), F.count("*").alias("n_rows"))


def _chunks(light: DataFrame) -> DataFrame:
    """conv, chunk, kinds (a letter a row, as step takes them), rows: the rows that are there, in order, at most CHUNK of a conversation."""
    there, at_turn = light.where("copies > 0"), F.struct(F.col("turn").isNotNull(), F.col("turn"))
    first = there.where("not blank").groupBy(F.col("conv").alias("c_"), F.col("role").alias("r_"), F.col("h").alias("h_")).agg(F.min(at_turn).alias("first_"), F.count("*").alias("n_")).where("n_ > 1")
    rows = there.join(first, F.col("conv").eqNullSafe(F.col("c_")) & (F.col("role") == F.col("r_")) & (F.col("h") == F.col("h_")), "left")
    initial = F.substring("role", 1, 1)
    initial = F.when(initial.isin("s", "u", "a"), initial).otherwise(F.lit("o"))
    again = F.col("first_").isNotNull() & ~F.col("blank") & ~F.col("first_").eqNullSafe(at_turn)
    kind = F.when(F.col("blank") | again, "-").when(F.col("cut_off"), F.upper(initial)).otherwise(initial)
    order = [F.asc_nulls_first(c) for c in ("conv", "turn", "role", "h")]
    rows = rows.select("conv", "turn", "role", "h", "blank", "copies", kind.alias("kind"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    per = rows.groupBy("conv", F.expr(f"at div {CHUNK}").alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("at", "turn", "role", "h", "blank", "copies", "kind"))).alias("rows"))
    return per.select("conv", "chunk", F.array_join(F.transform("rows", lambda x: x["kind"]), "").alias("kinds"), "rows")


def stitched(chunks: DataFrame, scratch: Scratch) -> DataFrame:
    """conv, chunk, after, place, is_last of the chunks of conversations that have several: the true costs after each (less a constant) and the place at its start.

    All chunks start at once, from the costs that the end of a conversation has; for its last chunk they are true. Then passes
    run chunks again from every vector that some chunk turned out to have before it (few exist, as vectors that differ by a
    constant are one), until no chunk brings a new one. So the passes don't grow with a conversation, also where its rows never
    make two vectors one. What is left of a chunk is a small table of its runs, by which a conversation's chunks are stitched,
    one after the other: costs from its end, then places from its start.
    """
    kind_of = f"conv {chunks.schema['conv'].dataType.simpleString()}, chunk bigint"
    several = chunks.groupBy(F.col("conv").alias("c_")).agg(F.count("*").alias("n_")).where("n_ > 1")
    many = scratch.cut(chunks.select("conv", "chunk", "kinds").join(several, F.col("conv").eqNullSafe(F.col("c_")), "left_semi"))
    runs, todo, done = None, {END}, set()
    while todo:

        def run(batches: Iterator[pd.DataFrame], starts: tuple = tuple(sorted(todo))) -> Iterator[pd.DataFrame]:
            for b in batches:
                out = [(c, k, _text(s), run_back(x, s)) for c, k, x in zip(b["conv"], b["chunk"], b["kinds"]) for s in starts]
                yield pd.DataFrame([(c, k, s, _text(before), list(ends)) for c, k, s, (_, before, ends) in out], columns=["conv", "chunk", "after", "before", "ends"])

        new = scratch.cut(many.mapInPandas(run, f"{kind_of}, after string, before string, ends array<int>"))
        runs = new if runs is None else runs.union(new)
        done |= todo
        todo = {tuple(map(int, r["before"].split(","))) for r in new.select("before").distinct().toLocalIterator()} - done
    tables = runs.groupBy("conv", "chunk").agg(F.collect_list(F.struct("after", "before", "ends")).alias("runs"))

    def stitch(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, after, back = pdf.sort_values("chunk", ascending=False), _text(END), []
        for chunk, table in zip(pdf["chunk"], pdf["runs"]):
            run = next(r for r in table if r["after"] == after)
            back.append((chunk, after, run["ends"]))
            after = run["before"]
        place, out, conv = 0, [], pdf["conv"].iloc[0]
        for chunk, after, ends in reversed(back):
            out.append((conv, chunk, after, place, len(out) + 1 == len(back)))
            place = int(ends[place])
        return pd.DataFrame(out, columns=["conv", "chunk", "after", "place", "is_last"])

    return scratch.cut(tables.groupBy("conv").applyInPandas(stitch, f"{kind_of}, after string, place int, is_last boolean"))


EDITS = "array<struct<edit:string,role:string>>"


def cheapest_edits(light: DataFrame, scratch: Scratch) -> DataFrame:
    """conv, at, turn, role, h, blank, copies, kind, edits, tail: each row with its edits (inserts before it first) and, at a conversation's end, the inserts after it; of copies all but the first go besides."""
    chunks = scratch.cut(_chunks(light))
    known = stitched(chunks, scratch).select(F.col("conv").alias("c_"), F.col("chunk").alias("k_"), "after", "place", "is_last")
    rows = chunks.join(known, F.col("conv").eqNullSafe(F.col("c_")) & (F.col("chunk") == F.col("k_")), "left")
    rows = rows.select("conv", "kinds", "rows", F.coalesce("after", F.lit(_text(END))).alias("after"), F.coalesce("place", F.lit(0)).alias("place"), F.coalesce("is_last", F.lit(True)).alias("is_last"))

    def traced(kinds: pd.Series, after: pd.Series, place: pd.Series, is_last: pd.Series) -> pd.Series:
        out = []
        for k, a, p, last in zip(kinds, after, place, is_last):
            edits, at = trace(k, tuple(map(int, a.split(","))), p)
            tails = [[]] * (len(k) - 1) + [inserts_at_end(at) if last else []]
            out.append([{"edits": [{"edit": e, "role": r} for e, r in row], "tail": [{"edit": e, "role": r} for e, r in tail]} for row, tail in zip(edits, tails)])
        return pd.Series(out)

    done = F.pandas_udf(traced, f"array<struct<edits:{EDITS},tail:{EDITS}>>")("kinds", "after", "place", "is_last")
    both = rows.select("conv", F.explode(F.arrays_zip("rows", done.alias("done"))).alias("x"))
    return both.select("conv", "x.rows.at", "x.rows.turn", "x.rows.role", "x.rows.h", "x.rows.blank", "x.rows.copies", "x.rows.kind", "x.done.edits", "x.done.tail")


def _one_text(rows: DataFrame, light: DataFrame) -> DataFrame:
    """conv, turn, role, h, text: one row of those that agree in all columns."""
    keys = ["conv", "turn", "role", "h"]
    texts, many = rows.where("copies > 0").select("conv", "turn", "role", _print(F.col("text")).alias("h"), "text"), light.where("n_rows > 1").select(*[F.col(c).alias(f"{c}_") for c in keys])
    if many.isEmpty():
        return texts
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_"))
    return texts.join(many, same, "left_anti").union(texts.join(many, same, "left_semi").dropDuplicates(keys).select(*texts.columns))


def _prepared(rows: DataFrame) -> tuple[DataFrame, DataFrame, Scratch]:
    scratch = Scratch(rows.sparkSession, "repair")
    light = scratch.cut(_light(rows))
    return light, cheapest_edits(light, scratch), scratch


def repair_conversations(rows: DataFrame) -> DataFrame:
    """conv, at, part, turn, edit, role, text: the conversations as the cheapest edits leave them, in order of (at, part); turn is null for inserted rows.

    rows: conv, turn, role, text, copies (how often a row is there, see damage). Rows of a conversation go by turn (nulls first),
    then role, then a hash of the text; of edits that cost the same those count whose letters (D, I, K, R) are least in ASCII.
    Null texts and roles read as one space (damage does that); a null conv is a conversation of its own. Rows that agree in all
    columns are copies, of which the first may stay. A conversation of any size is dealt to many tasks by range, in chunks of
    CHUNK rows at most. An empty table, and conversations whose rows all go, give no rows.
    """
    light, edits, _ = _prepared(rows)
    parts = edits.select("conv", "at", "turn", F.col("role").alias("own"), "h", F.posexplode(F.concat("edits", "tail")).alias("part", "e")).where("e.edit <> 'D'")
    kept = parts.where("e.edit <> 'I'").join(_one_text(rows, light).select(F.col("conv").alias("c_"), F.col("turn").alias("t_"), F.col("role").alias("r_"), F.col("h").alias("h_"), "text"),
        F.col("conv").eqNullSafe(F.col("c_")) & F.col("turn").eqNullSafe(F.col("t_")) & (F.col("own") == F.col("r_")) & (F.col("h") == F.col("h_")))
    added = parts.where("e.edit = 'I'").select("conv", "at", "part", F.lit(None).cast("bigint").alias("turn"), "e.edit", "e.role", F.lit("").alias("text"))
    return kept.select("conv", "at", "part", "turn", "e.edit", F.coalesce("e.role", "own").alias("role"), "text").union(added)


def repair_digests(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation after damage.

    Edits are found in chunks (repair_conversations). A SHA-256 can only be made in order, so a conversation's rows then pass one
    task as a sorted stream, of which the audit alone is held. A conversation that lost all rows has zeros, an empty audit
    and the hash of nothing. Other columns are ignored, and an empty table gives an empty result.
    """
    rows = damage(conversations, conv, turn, role, text)
    light, edits, scratch = _prepared(rows)
    keys = [F.asc_nulls_first(c) for c in ("conv", "turn", "role", "h")]
    given = edits.select("conv", "turn", "role", "h", F.lit(0).alias("tag"), "blank", "copies", "kind", F.col("edits").alias("edits"), "tail", F.lit(None).cast("string").alias("text"))
    none = lambda kind: F.lit(None).cast(kind)
    texts = _one_text(rows, light).select("conv", "turn", "role", "h", F.lit(1).alias("tag"), none("boolean").alias("blank"), none("bigint").alias("copies"), none("string").alias("kind"), none(EDITS).alias("edits"), none(EDITS).alias("tail"), "text")
    stream = given.union(texts).repartition("conv").sortWithinPartitions(*keys, "tag").select("conv", "turn", "role", "tag", "blank", "copies", "kind", "edits", "tail", "text")
    kind_of, arrow_of = conversations.select(F.col(conv).alias("conv")).schema["conv"].dataType.simpleString(), _arrow(conversations.select(F.col(conv).alias("conv")))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ready = None, []
        for b in batches:
            for c, *row in zip(*[col.to_pylist() for col in b.columns]):
                if at is None or at.conv != c:
                    if at is not None:
                        ready.append(at.finished())
                    at = Digest(c)
                at.add(*row)
            if len(ready) > 1000:
                yield _batch(ready, arrow_of)
                ready = []
        if at is not None:
            yield _batch([*ready, at.finished()], arrow_of)

    found = stream.mapInArrow(digests, f"conv_id {kind_of}, {', '.join(f'{c} bigint' for c in counts)}, audit string, repaired_sha256 string")
    lost = light.groupBy("conv").agg(F.max("copies").alias("most")).where("most = 0")
    zeros = lost.select(F.col("conv").alias("conv_id"), *[F.lit(0).cast("bigint").alias(c) for c in counts], F.lit("").alias("audit"), F.sha2(F.lit("").cast("binary"), 256).alias("repaired_sha256"))
    return found.union(zeros)


def _arrow(df: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[0].dataType)


def _batch(rows: list[tuple], conv_type: pa.DataType) -> pa.RecordBatch:
    kinds = [conv_type, *[pa.int64()] * 6, pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"])


class Digest:
    """What one conversation's rows, in order, add up to; each row's text follows it, if it has one."""

    def __init__(self, conv):
        self.conv, self.hash, self.empty, self.audit = conv, hashlib.sha256(), True, []
        self.turns, self.low, self.high, self.last = 0, None, None, ""
        self.blank = self.duplicate = self.truncated = self.illegal = self.cost = 0
        self.waiting, self.tail = None, []

    def _write(self, role: str, text: str) -> None:
        self.hash.update((("" if self.empty else "\n") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.empty = False

    def add(self, turn, role, tag, blank, copies, kind, edits, tail, text) -> None:
        if tag:
            if self.waiting is not None:
                self._write(self.waiting, text)
                self.waiting = None
                self._inserts(self.tail)
            return
        self.low, self.turns = (turn if self.low is None else self.low), self.turns + (turn is not None and turn != self.high)
        self.high = turn if turn is not None else self.high
        initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
        self.illegal += bool(self.last) and self.last + initial not in ("su", "ua", "au")
        self.illegal, self.last = self.illegal + copies - 1, initial
        self.blank += copies if blank else 0
        self.duplicate += 0 if blank else copies if kind == "-" else copies - 1
        self.truncated += kind.isupper()
        own = edits[-1]
        self._inserts(edits[:-1])
        self.audit.append("".join(e["edit"] for e in edits) + "D" * (copies - 1) + "I" * len(tail))
        self.cost += DELETE * (copies - 1 + (own["edit"] == "D")) + REROLE * (own["edit"] == "R") + INSERT * (len(edits) - 1 + len(tail)) + CUT_OFF * (own["edit"] != "D" and kind.isupper())
        self.tail = tail
        if own["edit"] == "D":
            self._inserts(tail)
        else:
            self.waiting = own["role"] or role

    def _inserts(self, edits: list[dict]) -> None:
        for e in edits:
            self._write(e["role"], "")

    def finished(self) -> tuple:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest()
