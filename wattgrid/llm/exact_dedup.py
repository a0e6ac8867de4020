"""Exact dedup by deterministic block naming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattgrid.functions.scratch import Scratch

BLOCK_BYTES = 4096


def _named(distinct: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys in sorted order, numbered upwards: a range sort over the cluster, then a number per row."""
    n = max(1, int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return distinct.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())


def _block_names(texts: DataFrame, scratch: Scratch, block_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(rid, doc_id, n_blocks, text_sha256, prints) per row, and (p, q, name) per distinct block.

    Blocks are sorted by two 64-bit prints, then bytes. Distinct blocks are grouped by their bytes, with copies combined
    before the shuffle; if two different blocks ever share both prints, everything is printed anew with another seed,
    so that the prints that later joins use are known to be one-to-one with the bytes.
    """
    seed = 0
    while True:
        blocks = F.transform(F.sequence(F.lit(0), F.col("n_blocks") - 1), lambda i: F.substring(F.col("bytes"), i * block_bytes + 1, F.lit(block_bytes)))
        prints = F.when(F.col("n_blocks") > 0, F.transform(blocks, lambda x: F.struct(F.xxhash64(F.lit(seed), x).alias("p"), F.xxhash64(F.lit(seed + 1), x, F.lit(1)).alias("q"))))
        rows = scratch.cut(texts.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "n_blocks", F.sha2("bytes", 256).alias("text_sha256"), prints.alias("prints")))
        block = texts.where("n_blocks > 0").select(F.explode(blocks).alias("block"))
        block = block.groupBy(F.xxhash64(F.lit(seed), "block").alias("p"), F.xxhash64(F.lit(seed + 1), "block", F.lit(1)).alias("q"), "block").agg(F.lit(1).alias("one"))
        names = scratch.cut(_named(block.groupBy("p", "q").agg(F.count("*").alias("n_texts")), ["p", "q"]))
        if names.where("n_texts > 1").isEmpty():
            return rows, names.select("p", "q", "name")
        scratch.drop(rows, names)
        seed += 2


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Each text is cut into blocks of block_bytes bytes. The distinct blocks are sorted and numbered; then neighbouring
    numbers are paired and the distinct pairs sorted and numbered, until every text has one number, which together with
    its count of blocks is shared by exactly the equal texts.

    Null texts count as empty, and all empty texts are equal. Of equal texts the row with the largest id stays (a null id
    is the smallest); of repeated rows with that id exactly one has kept true. Other columns are ignored. An empty table
    gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("bytes"))
    texts = texts.withColumn("n_blocks", F.ceil(F.octet_length("bytes") / block_bytes).cast("int"))
    rows, names = _block_names(texts, scratch, block_bytes)

    first = rows.where("n_blocks > 0").select("rid", "n_blocks", F.posexplode("prints").alias("pos", "x")).select("rid", "n_blocks", "pos", "x.p", "x.q")
    level = scratch.cut(first.join(names, ["p", "q"]).select("rid", "n_blocks", "pos", "name"))
    done, width = [level.where("n_blocks = 1").select("rid", "name")], 1
    most = rows.agg(F.max("n_blocks")).first()[0] or 0
    while width < most:
        pair = level.where(f"n_blocks > {width}").groupBy("rid", "n_blocks", F.shiftright("pos", 1).alias("half"))
        pair = pair.agg(F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("l"), F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("r"))
        pair = scratch.cut(pair)
        names = scratch.cut(_named(pair.select("l", "r").distinct(), ["l", "r"]))
        level = scratch.cut(pair.join(names, ["l", "r"]).select("rid", "n_blocks", F.col("half").alias("pos"), "name"))
        scratch.drop(pair, names)
        done.append(level.where(f"n_blocks <= {2 * width}").select("rid", "name"))
        width *= 2
    named = done[0]
    for part in done[1:]:
        named = named.union(part)
    known = rows.select("rid", "doc_id", "n_blocks", "text_sha256").join(named, "rid", "left").withColumn("name", F.coalesce("name", F.lit(-1)))
    known = scratch.cut(known)
    groups = scratch.cut(known.groupBy("n_blocks", "name").agg(F.max(F.struct("doc_id", "rid")).alias("keep"), F.count("*").alias("group_size")))
    scratch.keep_only(known, groups)
    out = known.join(groups, ["n_blocks", "name"])
    return out.select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("keep.rid")).alias("kept"), "text_sha256")
