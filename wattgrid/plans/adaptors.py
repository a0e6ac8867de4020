"""The tariff schema over the driver's tables: customers as utilities, orders as tariffs, line items as rate components, events as page checks."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    """Tables of one folder, read when first used; Spark prunes what a query doesn't need."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def utilities(self) -> DataFrame:
        places = self.read("nation").join(self.read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        rows = self.read("customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
        return rows.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("n_name").alias("state"), F.col("r_name").alias("country"), F.col("c_mktsegment").alias("utility_type"), (F.col("c_acctbal") >= 0).alias("is_active"))

    @cached_property
    def tariffs(self) -> DataFrame:
        day = F.col("o_orderdate").cast("date")
        return self.read("orders").select(
            F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("utility_id"), F.col("o_orderpriority").alias("customer_class"), F.col("o_orderstatus").alias("rate_type"),
            F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("name"), day.alias("effective_date"), F.when(F.col("o_orderstatus") != "P", F.date_add(day, 90)).alias("last_verified"), F.col("o_totalprice").cast("decimal(18,2)").alias("amount"),
        )

    @cached_property
    def components(self) -> DataFrame:
        return self.read("lineitem").select(F.col("l_orderkey").alias("tariff_id"), F.col("l_linenumber").alias("ordinal"), F.col("l_returnflag").alias("component_type"), F.col("l_linestatus").alias("period"), F.col("l_discount").cast("decimal(16,6)").alias("rate_value"), F.col("l_quantity").cast("decimal(16,2)").alias("tier_max"))

    @cached_property
    def checks(self) -> DataFrame:
        at = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
        return self.read("events").select(F.col("event_id").alias("id"), F.col("user_id").alias("source_id"), at.alias("checked_us"), F.col("ts").alias("checked_at"), (F.col("event_type") == "error").alias("failed"), F.col("event_type").alias("content_hash"), "props")


#: The same views in SQL, for the queries' counterparts.
SQL = """
utilities as (select c_custkey as id, c_name as name, n_name as state, r_name as country, c_mktsegment as utility_type, c_acctbal >= 0 as is_active
    from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
tariffs as (select o_orderkey as id, o_custkey as utility_id, o_orderpriority as customer_class, o_orderstatus as rate_type, o_orderpriority || ' ' || o_orderstatus as name,
    cast(o_orderdate as date) as effective_date, case when o_orderstatus <> 'P' then cast(o_orderdate as date) + 90 end as last_verified, cast(o_totalprice as decimal(18,2)) as amount from orders),
components as (select l_orderkey as tariff_id, l_linenumber as ordinal, l_returnflag as component_type, l_linestatus as period, cast(l_discount as decimal(16,6)) as rate_value, cast(l_quantity as decimal(16,2)) as tier_max from lineitem),
checks as (select event_id as id, user_id as source_id, epoch_us(ts) as checked_us, ts as checked_at, event_type = 'error' as failed, event_type as content_hash, props from events)"""
