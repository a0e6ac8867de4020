"""Operators against plain programs over a small table."""

import collections
import hashlib
import html
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wattgrid.llm.bpe import Transducer, round_trip
from wattgrid.llm.exact_dedup import exact_duplicates
from wattgrid.llm.html_blocks import leaf_blocks
from wattgrid.llm.html_text import default_field, extract_text
from wattgrid.llm.labelled_pages import labelled_pages
from wattgrid.llm.line_dedup import line_digests, text_chunks
from wattgrid.llm.near_dups import near_duplicates, part_keys, shingle_set, sketch
from wattgrid.llm.packing import best_fit_decreasing, pack_documents
from wattgrid.llm.quality import score_documents, train_on
from wattgrid.llm.substring_dedup import substring_digests
from wattgrid.llm.url_filter import judge_urls
from wattgrid.llm.vector_dedup import link_vectors


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


def components(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near_links(sets):
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                yield a, b


def plain_shingles(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def varied(rng, n, base, edits):
    """n copies of a text, each with some words exchanged."""
    out = []
    for _ in range(n):
        words = base.split()
        for i in rng.sample(range(len(words)), min(len(words), rng.randint(0, edits))):
            words[i] = f"z{rng.randint(0, 9)}"
        out.append(" ".join(words))
    return out


def check_near(spark, rows):
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    sets = {i: plain_shingles(t) for i, t in rows.items()}
    want = components(rows, near_links(sets))
    got = near_duplicates(df).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(sets[i]), want[i]) for i in rows}


def test_near_duplicates(spark, texts):
    check_near(spark, texts)


def test_near_duplicates_of_families(spark):
    rng = random.Random(5)
    word = lambda: rng.choice("abcdefgh") + str(rng.randint(0, 400))
    rows, passage = [], " ".join(word() for _ in range(30))
    for size in (4, 7, 11, 25, 60, 200):
        base = " ".join(word() for _ in range(size))
        rows += varied(rng, 12, base, max(1, size // 14))
        rows += [f"{base} {passage}", f"{passage} {word()} {base[: len(base) // 2]}"]
    check_near(spark, dict(enumerate(rows)))


def test_keys_lose_no_pair():
    rng = np.random.default_rng(3)
    for n in [*range(1, 40), 80, 150, 333, 900]:
        for _ in range(20):
            a = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
            d = rng.integers(0, n // 4 + 1)
            b = np.unique(np.concatenate([a[rng.permutation(n)[: n - d]], rng.integers(0, 1 << 63, rng.integers(0, d + 1), np.uint64)]))
            both = len(np.intersect1d(a, b))
            if len(b) and 100 * both >= 80 * (len(a) + len(b) - both):
                assert np.intersect1d(part_keys(a), part_keys(b)).size
                m = min(len(sketch(a)), len(sketch(b)))
                fold = lambda s: np.bitwise_xor.reduce(np.frombuffer(sketch(s), np.uint8).reshape(-1, m), axis=0)  # noqa: E731, B023
                assert np.bitwise_count(fold(a) ^ fold(b)).sum() <= len(a) + len(b) - 2 * both


def test_exact(docs, texts):
    groups = collections.defaultdict(list)
    for i, t in texts.items():
        groups[t].append(i)
    for block in (4096, 7):
        got = exact_duplicates(docs, block_bytes=block).collect()
        assert {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in got} == {i: (max(g), len(g), i == max(g)) for g in groups.values() for i in g}


@pytest.mark.parametrize("hot,shard", [(4000, 600_000), (2, 3000)])
def test_substrings(docs, texts, hot, shard):
    words = {i: t.encode().split() for i, t in texts.items()}
    count = collections.Counter(tuple(w[i : i + 35]) for w in words.values() for i in range(len(w) - 34))
    want = {}
    for k, w in words.items():
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - 34):
            if count[tuple(w[i : i + 35])] > 1:
                gone[i : i + 35] = True
        want[k] = (len(w), int(gone.sum()), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())
    got = substring_digests(docs, hot_segments=hot, shard_words=shard).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == want


def test_substrings_within_a_text(spark):
    loop, run = " ".join(f"a{i}" for i in range(40)), "same " * 50
    rows = [(1, f"{loop} x {loop}"), (2, run), (3, " ".join(f"b{i}" for i in range(60))), (4, loop)]
    got = {r.doc_id: r.n_removed for r in substring_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 80, 2: 50, 3: 0, 4: 40}


def test_lines(docs, texts):
    seen, gone = set(), collections.Counter()
    for i in sorted(texts):
        for _, _, n, chunk in text_chunks(texts[i], 0):
            gone[i] += n * (chunk in seen)
            seen.add(chunk)
    assert {r.doc_id: r.n_removed for r in line_digests(docs).collect()} == {i: gone[i] for i in texts}


def test_line_chunks_fall_in_step_again():
    lines = [f"line {i * i}" for i in range(200)]
    a, b = ({c[3] for c in text_chunks("\n".join(x), 0)} for x in (lines, ["new first line", *lines]))
    assert len(a & b) >= 0.9 * len(a)


def test_packing(docs, texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    ids = {i: [*tok.encode(t, add_special_tokens=False).ids, 1] for i, t in texts.items()}
    sequences, pieces = collections.defaultdict(list), collections.defaultdict(list)
    for r in pack_documents(docs, path, horizon=50_000).collect():
        part = np.asarray(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.start, r.length))
    for found, whole in [*((sorted(s), None) for s in sequences.values()), *((sorted(p), len(ids[i])) for i, p in pieces.items())]:
        at = 0
        for start, n in found:
            assert start == at
            at += n
        assert at <= 2048 if whole is None else at == whole
    assert set(pieces) == set(ids)
    used = [sum(n for _, n in s) for s in sequences.values()]
    assert sum(2048 - u for u in used if u & (u - 1)) < 0.01 * sum(used)


def test_best_fit_takes_the_tightest():
    rng = random.Random(2)
    lengths = [rng.randint(1, 99) for _ in range(400)]
    windows: list[list[int]] = []
    for i in sorted(range(400), key=lambda i: (-lengths[i], i)):
        free = [(100 - sum(lengths[j] for j in w), k) for k, w in enumerate(windows)]
        fits = [f for f in free if f[0] >= lengths[i]]
        if fits:
            windows[min(fits)[1]].append(i)
        else:
            windows.append([i])
    got = best_fit_decreasing(lengths, 100)
    assert sorted(sum(lengths[i] for i in w) for w in got) == sorted(sum(lengths[i] for i in w) for w in windows)


def test_bpe(docs, texts):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    for r in round_trip(docs, path).collect():
        ids = tok.encode(texts[r.doc_id], add_special_tokens=False).ids
        want = hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), *want)


def test_bpe_streams():
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok, machine, rng = Tokenizer.from_file(path), Transducer(path), random.Random(4)
    for _ in range(60):
        word = "".join(rng.choice(["a", "th", "ing", "é", "zz", "Q", "日"]) for _ in range(rng.randint(1, 900)))
        raw = word.encode()
        want = tok.encode(word, add_special_tokens=False).ids
        assert [t for some in machine.stream(raw[i : i + 7] for i in range(0, len(raw), 7)) for t in some] == want == machine.tokens(raw)
        ids, decode = [rng.randrange(50257) for _ in range(40)], machine.decoder()
        parts = [decode(np.asarray(ids[i : i + 3], "<u4").tobytes(), False) for i in range(0, 40, 3)]
        assert "".join([*parts, decode(b"", True)]) == tok.decode(ids, skip_special_tokens=False)


def test_html(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    for r in extract_text(pages).join(pages.select("page_id", "html"), "page_id").collect():
        inner = re.search(r"(?s)<article>(.*?)</article>", r.html)[1]
        assert r.text == " ".join(html.unescape(re.sub(r"<[^>]+>", " ", inner)).split())


def test_html_of_other_layouts():
    field, wrong, total = default_field(), 0, 0
    for page, labels in labelled_pages(200, 50_000):
        blocks = leaf_blocks(page)
        assert len(blocks) == len(labels)
        total += len(labels)
        wrong += sum(a != b for a, b in zip(field.viterbi(field.scores(blocks)), labels))
    assert wrong < 0.02 * total


def test_quality_holds_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    rows = score_documents(docs, train_on(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.95 and np.mean([g >= 0.3 for g in good]) > 0.95


def test_urls_pass_decisions_on(spark):
    rows = [
        (1, "http://a.example.net/es/x", ""),  # blocked by a rule
        (2, "http://b.example.org/1", '<link rel="canonical" href="http://a.example.net/es/x">'),
        (3, "http://c.example.org/", "<META http-equiv=refresh content='0; url=http://b.example.org/1'>"),
        (4, "http://d.example.com/", '<link href="http://c.example.org/" rel=canonical>'),  # an explicit allow
        (5, "http://e.example.org/", '<link rel="canonical" href="/other">'),
        (6, "http://WWW.example.com/en/", ""),
        (7, "http://x.example.com/en/", ""),
    ]
    got = {r.page_id: (r.rule, r.verdict) for r in judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: ("net/es/", "block"), 2: (None, "block"), 3: (None, "block"), 4: ("com/", "allow"), 5: (None, "allow"), 6: ("www.example.com/en/", "allow"), 7: ("example.com/en/", "block")}


def test_vectors(spark):
    rng = np.random.default_rng(8)
    base = rng.standard_normal((300, 32))
    rows = [*base, *(base[rng.integers(0, 40, 300)] + rng.normal(0, 0.12, (300, 32)))]
    data = [(i, [float(np.float32(x)) for x in v], int(i % 2)) for i, v in enumerate(rows)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")
    x = np.array([v for _, v, _ in data])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = [(i, j) for i in range(600) for j in range(i) if i % 2 == j % 2 and x[i] @ x[j] >= 0.98]
    got = link_vectors(df).collect()
    assert 0.95 * len(links) <= sum(r.n_links for r in got) / 2 <= len(links) and len(links) > 200
    want = components(range(600), links)
    assert np.mean([want[r.vec_id] == r.component_id for r in got]) > 0.95 and all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert shingle_set("").size == 0 and df.agg(F.count("*")).first()[0] == 600
