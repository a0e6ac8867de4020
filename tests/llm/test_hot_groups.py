"""Groups that hold many rows: bounded in rows and in memory."""

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from wattgrid.llm import vector_dedup
from wattgrid.llm.vector_dedup import Projections, link_vectors


def copies(n, dims=32, noise=0.004):
    rng = np.random.default_rng(6)
    x = rng.standard_normal(dims)
    x = x / np.linalg.norm(x) + rng.normal(0, noise, (n, dims))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_vectors_of_a_hot_cell_meet_in_blocks(spark, monkeypatch):
    seen = []
    groups_of = vector_dedup._met
    monkeypatch.setattr(vector_dedup, "_met", lambda dealt, block: seen.append(groups_of(dealt, 50)) or seen[-1])
    data = [(i, v.tolist(), 1) for i, v in enumerate(copies(400))]
    got = link_vectors(spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")).collect()
    assert {(r.n_links, r.component_id, r.kept) for r in got if r.vec_id} == {(399, 0, False)}
    sizes = [r["count"] for r in seen[0].groupBy("cell", "block", "other").count().collect()]
    assert max(sizes) < 200 and seen[0].agg({"block": "max", "other": "max"}).first() == (7, 7)


def test_pairs_of_a_group_are_held_by_slice():
    unit, proj = copies(6000), Projections(32, 6000, 0.98)
    role, cid = np.repeat([0, 1], 3000), np.concatenate([np.arange(3000, 6000), np.arange(3000)])
    tracemalloc.start()
    ids, root, linked = vector_dedup._counted(role, cid, np.ones(6000, np.int64), unit, 0, proj, 0.98)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (ids == np.arange(6000)).all() and (root == 0).all() and (linked == 3000).all()
    assert peak < 150_000_000  # nine million pairs


def test_repeated_rows_of_one_id(spark):
    """Many rows of two linked texts, all of one id each, are two classes with a text each."""
    from wattgrid.llm.near_dups import near_duplicates

    a, b = (" ".join(f"w{i}" for i in range(60)) + end for end in (" x", " y"))
    rows = [(1, a)] * 3000 + [(2, b)] * 3000 + [(3, "other words of its own here")] * 3
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).groupBy("doc_id", "component_id").count().collect()
    assert {tuple(r) for r in got} == {(1, 1, 3000), (2, 1, 3000), (3, 3, 3)}


def test_one_text_full_of_an_anchor_lies_in_many_shards(spark, monkeypatch):
    """Windows that repeat in one long text are found across the shards that its blocks are dealt to."""
    from collections import Counter

    from wattgrid.llm import substring_dedup

    rng = np.random.default_rng(3)
    runs = [" ".join(["a"] * 3000), " ".join(f"u{i}" for i in range(50)), " ".join(["a"] * 500 + ["b"] * 36), " ".join(rng.choice(["x", "y"], 400))]
    texts = [" ".join(runs), " ".join(["a"] * 36 + ["b"] * 36), "a b c " * 700, " ".join(["b"] * 34)]
    held = Counter(tuple(w[i : i + 35]) for w in map(str.split, texts) for i in range(len(w) - 34))
    want = {}
    for k, words in enumerate(map(str.split, texts)):
        gone = np.zeros(len(words), bool)
        for i in range(len(words) - 34):
            if held[tuple(words[i : i + 35])] > 1:
                gone[i : i + 35] = True
        want[k] = (len(words), int(gone.sum()))
    spread, cut = [], substring_dedup.Scratch.cut

    def watched(self, df):
        out = cut(self, df)
        if "kind" in out.columns:
            spread.append(out.where("kind = 2").groupBy("t1", "t2", "h1", "h2").count().agg(F.max("count")).first()[0])
        return out

    monkeypatch.setattr(substring_dedup.Scratch, "cut", watched)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = substring_dedup.substring_digests(rows, hot_segments=200, shard_words=2000)
    assert {r.doc_id: (r.n_words, r.n_removed) for r in got.collect()} == want and want[0][1] >= 3500
    assert spread[0] > 5  # shards in which one text's window of equal words is
