"""Objects of JSON arrays that stand on one line, read by many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wattgrid.functions.scratch import Scratch

HEAD = r'^\s*(?:\[|\{\s*"items"\s*:\s*\[)'


def _walk(outside: Column, closed: Column) -> Column:
    """Struct (delta, low) of a piece's brackets outside strings: what they add to the depth, and the lowest depth on the way; a closed piece ends with a brace."""
    opens, ends = F.char_length(outside) - F.char_length(F.translate(outside, "{[", "")), closed.cast("int")
    plain = F.struct((opens - ends).alias("delta"), F.least(F.lit(0), opens - ends).alias("low"))  # brackets open, and at most the last brace closes
    marks = F.concat(F.regexp_replace(outside, r"[^{\[\]]", ""), F.when(closed, "}").otherwise(""))
    step = lambda acc, c: F.struct(
        (acc["delta"] + F.when(c.isin("{", "["), 1).otherwise(-1)).alias("delta"), F.least(acc["low"], acc["delta"] + F.when(c.isin("{", "["), 1).otherwise(-1)).alias("low")
    )
    return F.when(~outside.contains("]"), plain).otherwise(F.aggregate(F.filter(F.split(marks, ""), lambda c: c != ""), F.struct(F.lit(0).alias("delta"), F.lit(0).alias("low")), step))


def read_array_objects(spark: SparkSession, path: str) -> DataFrame:
    """(file, json): the objects of files that are a JSON array, or an object whose first member is the array items, also on one line.

    Files are split by size, whatever their lines (gzipped ones are not). Rows are pieces between closing braces; whether a piece
    begins inside a string, and at what depth, is summed up for both cases inside a split, and over splits in a table of one row
    each. Where a closing brace leads back to the array an object is whole; those that lie across splits are put together last.

    The array's elements are objects; others are left out. What follows the array is ignored, and of an array that breaks off the
    whole objects are read. Empty files and arrays give no rows; a file with another head is an error.
    """
    scratch = Scratch(spark, "json-arrays")
    pieces = spark.read.option("lineSep", "}").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    split = Window.partitionBy("file", "block").orderBy("at")
    before = split.rowsBetween(Window.unboundedPreceding, -1)
    first = (F.col("block") == 0) & (F.row_number().over(split) == 1)
    known = F.when(F.col("value").rlike(HEAD) | (F.trim("value") == ""), F.regexp_replace("value", HEAD, "")).otherwise(F.raise_error(F.lit("not an array of objects, nor an object with items first")))
    rows = pieces.withColumn("value", F.when(first, known).otherwise(F.col("value")))
    rows = rows.withColumn("plain", F.when(F.contains("value", F.lit("\\")), F.regexp_replace("value", r"(?s)\\.", "")).otherwise(F.col("value")))
    rows = rows.withColumn("quotes", F.char_length("plain") - F.char_length(F.translate("plain", '"', ""))).withColumn("odd", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)
    for state in (0, 1):  # whether the split begins inside a string
        inside = (F.col("odd") + state) % 2 == 1
        outside = F.regexp_replace(F.concat(F.when(inside, '"').otherwise(""), F.col("plain")), r'(?s)"[^"]*+(?:"|$)', "")
        rows = rows.withColumn(f"ends{state}", (F.col("odd") + F.col("quotes") + state) % 2 == 0)
        rows = rows.withColumn(f"outside{state}", outside)
        rows = rows.withColumn(f"walk{state}", _walk(F.col(f"outside{state}"), F.col(f"ends{state}")))
        rows = rows.withColumn(f"start{state}", F.coalesce(F.sum(f"walk{state}.delta").over(before), F.lit(0)))
    rows = scratch.cut(rows.select("file", "block", "at", "value", "quotes", *[f"{c}{s}" for c in ("ends", "walk", "start") for s in (0, 1)]))
    order = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = rows.groupBy("file", "block").agg(F.sum("quotes").alias("quotes"), F.sum("walk0.delta").alias("sum0"), F.sum("walk1.delta").alias("sum1"))
    splits = splits.withColumn("state", F.coalesce(F.sum("quotes").over(order), F.lit(0)) % 2).withColumn("own", F.when(F.col("state") == 0, F.col("sum0")).otherwise(F.col("sum1")))
    splits = splits.select("file", "block", "state", F.coalesce(F.sum("own").over(order), F.lit(0)).alias("depth"))
    of_state = lambda c: F.when(F.col("state") == 0, F.col(f"{c}0")).otherwise(F.col(f"{c}1"))
    rows = rows.join(splits, ["file", "block"]).select("file", "block", "at", "value", of_state("ends").alias("ends"), of_state("walk").alias("walk"), (F.col("depth") + of_state("start")).alias("start"))
    over = rows.where("start + walk.low < 0").groupBy("file").agg(F.min(F.struct("block", "at")).alias("over"))  # where the array is closed
    rows = rows.join(over, "file", "left").where(F.col("over").isNull() | (F.struct("block", "at") < F.col("over")))
    rows = rows.withColumn("last", F.col("ends") & (F.col("start") + F.col("walk.delta") == 0))
    rows = rows.withColumn("n", F.coalesce(F.sum(F.col("last").cast("int")).over(before), F.lit(0)))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "value"))), lambda x: F.concat(x["value"], F.lit("}"))), "")
    parts = scratch.cut(rows.groupBy("file", "block", "n").agg(text.alias("json"), F.max("last").alias("last")))
    whole = F.col("last") & ((F.col("n") > 0) | (F.col("block") == 0))
    along = Window.partitionBy("file").orderBy("block", "n").rowsBetween(Window.unboundedPreceding, -1)
    edges = parts.where(~whole).withColumn("of", F.coalesce(F.sum(F.col("last").cast("int")).over(along), F.lit(0)))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "n", "json"))), lambda x: x["json"]), "")
    edges = edges.groupBy("file", "of").agg(joined.alias("json"), F.max("last").alias("last")).where("last")
    return parts.where(whole).select("file", "json").unionByName(edges.select("file", "json")).select("file", F.regexp_replace("json", r"^[^{]*+", "").alias("json"))
