"""Conversation repair against a search through all places, written apart from the operator, with chunks of few rows and of many."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from wattgrid.llm import conversation_repair as C

SPACE = " \t\n\x0b\f\r"


def cheapest(rows):
    """(cost, audit, repaired rows) by Dijkstra over (rows done, what was written last), ordered by (cost, audit)."""
    seen, heap = set(), [(0, "", 0, "", ())]
    while heap:
        cost, audit, i, state, out = heapq.heappop(heap)
        if i == len(rows) and state in ("", "a"):
            return cost, audit, out
        if (i, state) in seen:
            continue
        seen.add((i, state))
        nxt = "a" if state == "u" else "u"
        name = {"u": "user", "a": "assistant"}[nxt]
        heapq.heappush(heap, (cost + 2, audit + "I", i, nxt, (*out, (name, ""))))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, out))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, nxt, (*out, (name, text))))
                if role[:1] == nxt or (role[:1] == "s" and state == ""):
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[:1], (*out, (role, text))))
    return None


def expected(rows):
    """Digests of (conv, turn, role, text) rows, one conversation at a time."""
    convs = {}
    for conv, turn, role, text in rows:
        blank = lambda x: " " if x is None else str(x)
        hit = zlib.crc32(f"{blank(conv)}:{blank(turn)}".encode()) % 20
        role, text = blank(role), blank(text)
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        role = "user" if hit == 4 else role
        convs.setdefault(conv, []).extend([(turn, role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1))
    out = {}
    for conv, some in convs.items():
        some.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()[:16]))
        seen, marked = set(), []
        for _, role, text in some:
            bare = text.rstrip(SPACE)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            marked.append((role, text, fault))
        turns = [t for t, _, _ in some if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        n = lambda f: sum(m[2] == f for m in marked)  # noqa: B023, E731
        illegal = sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        cost, audit, repaired = cheapest(marked)
        out[conv] = (gaps, n("blank"), n("duplicate"), n("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest())
    return out


def made(n, longest, seed, roles=("user", "assistant", "system", "tool", "", None)):
    rng = random.Random(seed)
    weights = [6, 6, 1, 1, 0.3, 0.3]
    rows = []
    for conv in [None, *range(n)]:
        for turn in range(rng.randint(1, longest)):
            t = rng.choice([None, turn, turn, turn, turn, turn + 2])
            text = rng.choice(["Yes.", "No", "Why?", "", " \n", f"text {turn}.", f"cut {turn}", f"all right!  {turn} ! ", None])
            rows.append((conv, t, rng.choices(roles, weights)[0], text))
    return rows


def digests(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("conv", "h", "at", "kind", "copies", "tag", "edits")})
    got = C.repair_digests(df.repartition(3)).collect()
    assert len(got) == len({r.conv_id for r in got})
    return {r.conv_id: tuple(r)[1:] for r in got}


@pytest.mark.parametrize("chunk, longest", [(1 << 16, 12), (4, 40)])
def test_digests(spark, monkeypatch, chunk, longest):
    monkeypatch.setattr(C, "CHUNK", chunk)
    rows = made(60, longest, longest)
    assert digests(spark, rows) == expected(rows)


def test_one_role_never_converges(spark, monkeypatch):
    """Runs of one role keep two vectors apart for ever; the chunks of such conversations still agree."""
    monkeypatch.setattr(C, "CHUNK", 8)
    rows = [(c, t, role, f"text {t}.") for c, role in enumerate(["system", "tool", "user", "assistant"]) for t in range(150 + c)]
    assert digests(spark, rows) == expected(rows)


def test_hot_conversation(spark):
    """A third of all rows in one conversation, most of them copies of one row."""
    rows = [(7, t % 500, "user" if t % 2 else "assistant", f"row {t % 500}.") for t in range(3000)] + [(7, 3, "user", "same.")] * 3000 + [(c, 0, "user", "hi.") for c in range(100, 200)]
    assert digests(spark, rows) == expected(rows)


def test_repaired_rows(spark, monkeypatch):
    monkeypatch.setattr(C, "CHUNK", 4)
    rows = made(30, 15, 5)
    df = C.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    found = {}
    for r in sorted(C.repair_conversations(df).collect(), key=lambda r: (r.at, r.part)):
        found.setdefault(r.conv, []).append(f"{r.role}:{r.text}")
    want = {c: x[7] for c, x in expected(rows).items() if x[7] != hashlib.sha256(b"").hexdigest()}
    assert {c: hashlib.sha256("\n".join(x).encode()).hexdigest() for c, x in found.items()} == want
    assert all(re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in some)) for some in found.values())


def test_empty(spark):
    assert C.repair_digests(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
