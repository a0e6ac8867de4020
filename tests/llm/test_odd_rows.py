"""Each operator over nulls, empty and long texts, repeated rows, ids that repeat, and columns whose names operators use inside."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wattgrid.llm import queries as Q
from wattgrid.llm.exact_dedup import exact_duplicates
from wattgrid.llm.html_text import extract_text
from wattgrid.llm.line_dedup import dedup_lines, line_digests
from wattgrid.llm.near_dups import near_duplicates
from wattgrid.llm.packing import pack_documents
from wattgrid.llm.bpe import decode_ids, encode_texts, round_trip
from wattgrid.llm.quality import RuleEnsemble, keep_good, score_documents, train_on
from wattgrid.llm.substring_dedup import dedup_substrings, substring_digests
from wattgrid.llm.url_filter import judge_urls
from wattgrid.llm.vector_dedup import link_vectors

import public_tokenizers

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
LONG = " ".join(f"w{i % 997}x{i}" for i in range(40_000))
TEXTS = [(1, "one two three\nfour five"), (2, None), (3, ""), (None, "no id here"), (None, None), (4, LONG), (4, LONG), (5, "same id"), (5, "other text of it"), (6, "one two three\nfour five"), (7, " \n\t\n "), (8, "ÀÉ ﬁ 日本 🙂 \x1c\x85 é")]
EXTRA = ["name", "cid", "row", "done", "rid", "key", "n", "component_id", "text_", "k1", "t1", "label", "words", "stats_", "row_"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None, "s", 1) for i, t in TEXTS]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(7) for c in EXTRA})


def empty(df):
    return df.where("1 = 0")


def test_exact(docs):
    got = exact_duplicates(docs).collect()
    assert len(got) == len(TEXTS) and sum(r.kept for r in got) == len({t or "" for _, t in TEXTS})
    by = {(r.doc_id, r.text_sha256): r for r in got}
    assert {r.keep_id for r in got if r.doc_id == 1} == {6} and {r.group_size for r in got if r.doc_id == 3} == {3}
    assert sum(r.kept for r in got if r.doc_id == 4) == 1 and len(by) < len(got)
    assert exact_duplicates(empty(docs)).count() == 0


def test_near(docs):
    got = near_duplicates(docs).collect()
    assert len(got) == len(TEXTS)
    assert {(r.doc_id, r.component_id) for r in got if r.doc_id in (1, 6, 2, 3, 7)} == {(1, 1), (6, 1), (2, 2), (3, 3), (7, 7)}
    assert {r.component_id for r in got if r.doc_id is None} == {None} and {r.component_id for r in got if r.doc_id == 5} == {5}
    assert near_duplicates(empty(docs)).count() == 0


def test_lines(docs):
    got = line_digests(docs).collect()
    assert len(got) == len(TEXTS) and {(r.doc_id, r.n_removed) for r in got if r.doc_id in (1, 6)} == {(1, 0), (6, 2)}
    assert {r.n_lines for r in got if r.doc_id in (2, 3)} == {0}
    assert set(dedup_lines(docs).select("row.*").columns) == set(docs.columns) and line_digests(empty(docs)).count() == 0


def test_substrings(docs):
    got = substring_digests(docs).collect()
    assert len(got) == len(TEXTS) and {r.n_removed for r in got if r.doc_id == 4} == {40_000} and {r.n_removed for r in got if r.doc_id == 1} == {0}
    assert dedup_substrings(docs).count() == len(TEXTS) and substring_digests(empty(docs)).count() == 0


def test_packing(docs):
    got = pack_documents(docs, WORDS).collect()
    assert {r.doc_id for r in got} == {i for i, _ in TEXTS} and {r.length for r in got if r.doc_id in (2, 3)} == {1}
    assert pack_documents(empty(docs), WORDS).count() == 0


def test_bpe(docs):
    encoded = encode_texts(docs, BYTES)
    assert sorted((r.doc_id is None, r.doc_id, r.text) for r in decode_ids(encoded, BYTES).collect() if r.doc_id) == sorted((i is None, i, t or "") for i, t in TEXTS if i)
    assert round_trip(docs, BYTES).count() == len(TEXTS) and round_trip(empty(docs), BYTES).count() == 0


def test_quality(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 0, 0), (4, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = train_on(docs, labels)
    got = score_documents(docs, model).collect()
    assert len(got) == len(TEXTS) and all(0 <= r.score <= 1 for r in got) and all(r.predicted == int(r.score >= 0.3) for r in got)
    assert keep_good(docs, RuleEnsemble(9.0, ())).columns == docs.columns and keep_good(docs, RuleEnsemble(-9.0, ())).count() == 0
    assert train_on(empty(docs), empty(labels)).rules == () and score_documents(empty(docs), model).count() == 0


def test_pages(spark):
    rows = [(1, "http://a.example.com/en/x", "<p>Hello"), (2, None, None), (3, "no scheme", ""), (None, "https://B.example.NET/es/", "<div"), (1, "http://a.example.com/en/x", "<p>Hello"), (4, "http://x", "<" * 5000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("host", "path", "node", "best", "own", "text", "n_chars", "id", "component_id")})
    got = judge_urls(pages).collect()
    assert len(got) == 6 and {(r.host, r.path, r.verdict) for r in got if r.page_id in (2, 3)} == {("", "", "allow")}
    assert {r.verdict for r in got if r.page_id == 1} == {"block"} and judge_urls(empty(pages)).count() == 0
    text = extract_text(pages).collect()
    assert len(text) == 6 and all(r.n_chars == len(r.text) for r in text) and {r.text for r in text if r.page_id == 2} == {""}
    assert extract_text(empty(pages)).count() == 0


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, None, 1), (5, [0.0, 0.0], 1), (6, [nan, 1.0], 1), (7, [inf, 1.0], 1), (8, [None, 1.0], 1), (9, [1.0, 0.0], None), (None, [1.0, 0.0], 1), (10, [], 1), (11, [1.0, 0.01, 0.0], 1), (2, [1.0, 0.0], 1), (12, [1.0, 0.001], 1)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit(1) for c in ("v", "m", "cid", "ok", "kept", "part")})
    got = link_vectors(v).collect()
    assert len(got) == len(rows)
    by = {r.vec_id: r for r in got}
    assert (by[1].n_links, by[1].component_id, by[1].kept) == (3, 1, True) and (by[2].component_id, by[2].kept) == (1, False) and by[12].component_id == 1 and by[12].n_links == 3
    assert all(by[i].n_links == 0 and by[i].component_id == i and by[i].kept for i in (3, 4, 5, 6, 7, 8, 9, 10, 11)) and not by[None].kept
    assert link_vectors(empty(v)).count() == 0


def test_pipeline(spark, docs, tmp_path):
    folder = f"file://{tmp_path}"
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for rows in (plain, empty(plain)):
            out = stage(spark, rows, folder)
            assert out.columns == plain.columns
            assert out.count() <= rows.count()
    assert corpus_pipeline.STAGES[-1][1](spark, plain, folder).count() > 0


def test_all_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in Q.QUERIES) == list(range(1, 14))
