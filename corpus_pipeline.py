"""Corpus cleaning: quality, repeated lines, near-duplicates, repeated passages, packing.

Each stage takes the documents that its predecessor kept, and all but the last return the columns of documents, with
n_chars (where there is such a column) of the text as it is now.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattgrid.functions.scratch import Scratch
from wattgrid.llm.line_dedup import dedup_lines
from wattgrid.llm.near_dups import near_duplicates
from wattgrid.llm.packing import pack_documents
from wattgrid.llm.quality import keep_good, train_on
from wattgrid.llm.substring_dedup import dedup_substrings

CACHED_WORDS = 300_000


def _with_text(done: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of (row, done) with the text of done."""
    new = {"text": F.col("done.text"), "n_chars": F.char_length("done.text").cast("bigint")}
    return done.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in columns])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble scores 0.3 or more; it is fitted on labelled rows of these documents."""
    return keep_good(docs, train_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the multi-line chunks that an earlier place holds already."""
    return _with_text(dedup_lines(docs), docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents that links join, the one with the smallest id; documents without an id stay. Of rows that share that id the one whose text comes first (by bytes; null as empty), then whose columns do, as JSON."""
    gone = near_duplicates(docs).where("component_id <> doc_id").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    repeated = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n_rows")).where("n_rows > 1").select("doc_id")
    if repeated.isEmpty():
        return kept
    order = F.struct(F.coalesce("text", F.lit("")), F.to_json(F.struct("*")))
    one = kept.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), order).alias("row")).select("row.*")
    return kept.join(repeated, "doc_id", "left_anti").unionByName(one).select(*docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words that repeated windows of 35 words cover."""
    return _with_text(dedup_substrings(docs), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens; workers that other stages have used remember fewer words."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), cached_words=CACHED_WORDS)


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("substring dedup", drop_repeated_passages),
    ("packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each but the last is written and read again, so that the next one's passes don't repeat it, and what it was made from is deleted."""
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for _, stage in STAGES[:-1]:
        with Scratch.collected() as made:
            docs = scratch.cut(stage(spark, docs, sf_dir))
        scratch.keep_only(docs)
        for used in made:
            used.keep_only()
    return STAGES[-1][1](spark, docs, sf_dir)
