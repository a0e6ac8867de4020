"""Personal data: the base forms against plain regular expressions, the learnt spans against a plain program over words."""

import hashlib
import random
import re
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wattgrid.llm import personal_data as P

PLAIN = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    r"[0-9](?:[\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain_spans(text):
    out = []
    for kind, pattern in enumerate(PLAIN):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = [True, all(int(x) <= 255 for x in m[0].split(".")) if kind == 1 else True, 14 <= len(digits) <= 19 and luhn(digits), 10 <= len(digits) <= 15][kind]
            if good:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


@settings(max_examples=3000, deadline=None)
@given(st.text(alphabet="a1@.-+ (9%é5_0\n", max_size=60))
def test_base(text):
    assert P.base_spans(text) == plain_spans(text)


def test_base_cards_and_long_runs():
    text = "x 4111 1111 1111 1111 y 4111-1111-1111-1112 5500005555555559 +1 (383) 555-6083, 300.1.2.3.4 001.2.3.255 mail a.b@c.d@e.fg"
    assert P.base_spans(text) == plain_spans(text) and len(P.base_spans(text)) == 4
    for unit in ("1", "a", "1.", "a@", "+1(", "1 ", "@a.", "a.b-"):
        P.base_spans(unit * 300_000)  # in time


def plain_places(text):
    """(kind or -1, start, end, value, contexts) of values, and contexts of other words, as tuples of words."""
    words = [(m.start(), m.end()) for m in WORD.finditer(text)]
    low = lambda a, b: "".join(c.lower() if c.isascii() else c for c in text[a:b])
    get = lambda i: low(*words[i]) if 0 <= i < len(words) else None

    def contexts(glued, i, j):
        near, far = (glued, get(i - 1)) if glued else (get(i - 1), get(i - 2))
        found = [("near", near) if near else None, ("far", near, far) if near and far else None, ("after", get(j)) if get(j) else None, ("both", near, get(j)) if near and get(j) else None]
        return [c for c in found if c]

    places, taken = [], set()
    for s, kind, e in plain_spans(text):
        inside = [k for k, (a, b) in enumerate(words) if b > s and a < e]
        taken |= set(inside)
        places.append((kind, s, e, low(s, e), contexts(low(words[inside[0]][0], s), inside[0], inside[-1] + 1)))
    ordinary = []
    for k, (a, b) in enumerate(words):
        if k in taken:
            continue
        first = re.search("[0-9@]", text[a:b])
        if first:
            cut = max([0] + [m.end() for m in re.finditer(r"[=:\"'(\[<{]", text[a : a + first.start()])])
            core = text[a + cut : b].rstrip(".,;:!?\"')]}>")
            if len(core.encode()) >= P.LEAST_LENGTH and re.search("[0-9@]", core):
                places.append((-1, a + cut, a + cut + len(core), low(a + cut, a + cut + len(core)), contexts(low(a, a + cut), k, k + 1)))
                continue
        ordinary += contexts("", k, k + 1)
    return places, ordinary


def plain_learn(texts):
    seeds, seen, all_of, totals = defaultdict(lambda: defaultdict(int)), defaultdict(lambda: defaultdict(int)), defaultdict(int), defaultdict(int)
    for t in texts:
        places, ordinary = plain_places(t or "")
        for c in ordinary:
            all_of[c] += 1
        for kind, _, _, value, contexts in places:
            totals[kind] += 1
            for c in contexts:
                all_of[c] += 1
                if kind >= 0:
                    seeds[kind, c][value] += 1
                else:
                    seen[c][value] += 1
    seeded = {(k, c): sum(v.values()) / all_of[c] for (k, c), v in seeds.items() if len(v) >= P.LEAST_VALUES and sum(v.values()) * P.SHARE >= totals[k]}
    score = {x: s for x, s in seeded.items() if s + P.DAMPED * sum(seen[x[1]].values()) / all_of[x[1]] >= P.CONFIDENT}
    for _ in range(P.ROUNDS):
        best = defaultdict(float)
        for (k, c), s in score.items():
            for v in seen[c]:
                best[k, v] = max(best[k, v], P.DAMPED * s)
        score = {(k, c): seeded[k, c] + sum(n * best[k, v] for v, n in seen[c].items()) / all_of[c] for k, c in score}
    return {x: s for x, s in score.items() if s >= P.CONFIDENT}


def plain_find(texts):
    score, out = plain_learn(texts), []
    for t in texts:
        spans = [(s, k, e, False) for s, k, e in plain_spans(t or "")]
        for kind, s, e, _, contexts in plain_places(t or "")[0]:
            hits = [(p, -k) for (k, c), p in score.items() if c in contexts]
            if kind < 0 and hits:
                spans.append((s, -max(hits)[1], e, True))
        out.append([(P.KINDS[k], s, e, (t or "")[s:e], learnt) for s, k, e, learnt in sorted(spans)])
    return out


def corpus():
    rng, texts = random.Random(1), []
    fill = lambda: " ".join(rng.choice("the of and Über straße on in to is it 12 4.0 v2.1.3 a1b2c3".split()) for _ in range(rng.randint(0, 12)))
    for k in range(400):
        n = rng.randint(100, 999)
        mail = f"u{n}@mail{n % 7}.example.com" if k % 5 else f"u{n}(at)mail.example.com"
        phone = f"+1 ({n}) 555-{n}{n % 10}" if k % 3 else f"030-{n}-{n}"
        ip = f"{n % 256}.1.{n % 100}.7" if k % 4 else f"fe80::{n}"
        one = rng.choice([f"write to {mail} today", f"E-Mail: {mail}", f"email={mail}", f'call "{phone}", please', f"phone {phone} or", f"from host {ip} port {n}", f"card 4111 1111 1111 1111 held", f"see 1{n}4 pages", fill()])
        texts.append(f"{fill()} {one} {fill()}".strip())
    return [*texts, None, "", "4111111111111111", "@", "é" * 50 + " write to späm2@öx today", "  \t\n"]


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({c: F.lit(1) for c in ("id", "spans", "kind", "value", "context", "n")})
    return {r.doc_id: [tuple(s) for s in r.spans] for r in P.find_personal(df.repartition(5)).collect()}


def test_learnt_spans(spark):
    texts = corpus()
    want = plain_find(texts)
    got = found(spark, texts)
    assert [got[i] for i in range(len(texts))] == want
    learnt = {s[:1] + s[3:4] for spans in want for s in spans if s[4]}
    assert any(k == "email" and "(at)" in v for k, v in learnt) and any(k == "phone" and v.startswith("030-") for k, v in learnt) and any(k == "ip" and v.startswith("fe80") for k, v in learnt)
    assert not any(v.isdigit() and len(v) == 5 for _, v in learnt)


def test_values_raise_patterns(spark):
    """A pattern with seven seeds of ten is confident only because its other values stand in a better pattern too."""
    texts = [f"mail u{i}@a.example.org now" for i in range(30)] + [f"mail secret{i}#9 now" for i in range(3)]
    texts += [f"reach u{i}@a.example.org soon" for i in range(7)] + [f"reach secret{i}#9 soon" for i in range(3)] + [f"reach other{i}#7 soon" for i in range(1)]
    assert found(spark, texts) == dict(enumerate(plain_find(texts)))
    assert any(s[3] == "other0#7" for spans in plain_find(texts) for s in spans)


def test_digests(spark):
    texts = corpus()
    df = spark.createDataFrame([(None if i == 3 else i % 300, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = P.personal_digests(df).collect()
    assert len(rows) == len(texts) and P.personal_digests(df.where("1 = 0")).count() == 0
    want = sorted((",".join(f"{k}:{a}:{b}" for k, a, b, _, learnt in s if not learnt), ",".join(f"{k}:{a}:{b}" for k, a, b, _, _ in s)) for s in plain_find(texts))
    assert sorted(r.spans for r in rows) == sorted(w[1] for w in want)
    assert sorted(r.base_sha256 for r in rows) == sorted(hashlib.sha256(w[0].encode()).hexdigest() for w in want)
    assert sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in rows) == sum(len(plain_spans(t or "")) for t in texts)
