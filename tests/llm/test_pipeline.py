"""The pipeline's run against its stages, redone by plain programs where they can be."""

import collections
import os

import corpus_pipeline
from pyspark.sql import functions as F

from wattgrid.functions.scratch import Scratch, shared_folder
from wattgrid.llm.line_dedup import dedup_lines
from wattgrid.llm.quality import score_documents, train_on


def shingles(text):
    words = text.encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_run_is_its_stages_redone(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    good = {r.doc_id for r in score_documents(docs, train_on(docs, labels)).where("predicted = 1").collect()}
    kept = docs.where(F.col("doc_id").isin(list(good)))
    texts = {r.doc_id: r.text for r in dedup_lines(kept).select("row.doc_id", "done.text").collect()}
    root, sets = {i: i for i in texts}, {i: shingles(t) for i, t in texts.items()}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for k, b in enumerate(ids):
        for a in ids[:k]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    words = {i: texts[i].encode().split() for i in ids if find(i) == i}
    count = collections.Counter(tuple(w[k : k + 35]) for w in words.values() for k in range(len(w) - 34))
    want = {}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - 34):
            if count[tuple(w[k : k + 35])] > 1:
                gone.update(range(k, k + 35))
        want[i] = b" ".join(x for k, x in enumerate(w) if k not in gone).decode()
    expected = corpus_pipeline.STAGES[-1][1](spark, spark.createDataFrame(list(want.items()), "doc_id long, text string"), sf)
    digest = lambda df: sorted((r.doc_id, r.doc_tokens) for r in df.where("start = 0").select("doc_id", "doc_tokens").collect())
    assert digest(corpus_pipeline.run(spark, sf)) == digest(expected) and len(want) < len(texts) < docs.count()


def test_rows_that_share_an_id(spark, sf):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g"), (3, "p q r s t u v"), (3, "other words of the same id here"), (None, "x"), (None, "x")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.drop_near_duplicates(spark, docs, sf)
    assert sorted(str(r.doc_id) for r in out.collect()) == ["1", "3", "None", "None"] and out.columns == docs.columns


def test_run_leaves_the_last_table_alone(spark, sf):
    root = shared_folder(spark).removeprefix("file://")
    before = {os.path.join(d, f) for d, _, files in os.walk(root) for f in files if f.endswith(".parquet")}
    corpus_pipeline.run(spark, sf).count()
    left = {d for d, _, files in os.walk(root) for f in files if f.endswith(".parquet") and os.path.join(d, f) not in before}
    assert len(left) == 1 and "pipeline" in left.pop()


def test_collected_scratch(spark):
    with Scratch.collected() as made:
        inner = Scratch(spark, "inner")
        inner.cut(spark.range(3))
    Scratch(spark, "outer")
    assert made == [inner] and inner.keep_only() is None and not inner.live
