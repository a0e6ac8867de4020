"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattgrid.functions.scratch import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (id, component_id) for every id on an edge; component_id is the smallest id that the edges reach.

    Alternates large-star and small-star contraction: each round links every node to the smallest node it knows,
    which takes a number of rounds that grows with the logarithm of the longest path. Minima are aggregated before the
    shuffle, so a node with very many edges costs a row per task, and the joins with the minima are ones that adaptive
    execution can split. Each round is a written table, so neither plans nor lost executors make earlier rounds run again.
    Edges with a null end and loops link nothing; an empty table gives an empty result. Ids may be of any ordered type.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") > F.col("v")))
    e, seen = scratch.cut(e.distinct()), None
    while True:
        print_of = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if print_of == seen or not print_of["n"]:
            return e.select(F.col("u").alias("id"), F.col("v").alias("component_id")).union(e.select("v", "v").distinct())
        seen, before = print_of, e
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        large = scratch.cut(large)
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(down).distinct()
        e = scratch.cut(small)
        scratch.drop(before, large)
