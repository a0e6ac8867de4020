"""General operators: counts of children, latest and top rows, facets, coverage, anti and semi selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def with_counts(parents: DataFrame, children: DataFrame, key: str, child_key: str, **counts: Column) -> DataFrame:
    """Parents with conditional counts of their children, 0 where there are none; children are aggregated before the join."""
    per = children.groupBy(F.col(child_key).alias(key)).agg(*[F.count_if(c).alias(n) for n, c in counts.items()])
    return parents.join(per, key, "left").fillna(0, subset=list(counts))


def browse(rows: DataFrame, filters: list[Column | None], order: list[Column], offset: int = 0, limit: int | None = None) -> DataFrame:
    """Rows that pass all given filters, in order, from offset on."""
    for f in filters:
        if f is not None:
            rows = rows.where(f)
    rows = rows.orderBy(*order)
    if offset:
        rows = rows.offset(offset)
    return rows if limit is None else rows.limit(limit)


def latest(rows: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key in the given order; Spark keeps only n per key and task before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def all_children_match(children: DataFrame, key: str, condition: Column) -> DataFrame:
    """Keys all of whose children meet a condition, with their number."""
    return children.groupBy(key).agg(F.count("*").alias("total"), F.count_if(condition).alias("matching")).where("total = matching").select(key, "total")


def without(rows: DataFrame, others: DataFrame, on: list[str] | str) -> DataFrame:
    return rows.join(others, on, "left_anti")


def having(rows: DataFrame, others: DataFrame, on: list[str] | str) -> DataFrame:
    return rows.join(others, on, "left_semi")


def nested(parents: DataFrame, children: DataFrame, key: str, child_key: str, fields: list[str], name: str) -> DataFrame:
    """Parents with an array of their children, sorted by the children's fields in order; a parent's children are its own and few."""
    per = children.groupBy(F.col(child_key).alias(key)).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))
    return parents.join(per, key, "left").withColumn(name, F.coalesce(name, F.array().cast(per.schema[name].dataType)))


def option_tree(rows: DataFrame, top: str, middle: str, leaf: list[str]) -> DataFrame:
    """(top, tree): a map from middle to the sorted distinct leaves, per top."""
    lower = rows.select(top, middle, *leaf).distinct().groupBy(top, middle).agg(F.sort_array(F.collect_list(F.struct(*leaf))).alias("leaves"))
    return lower.groupBy(top).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(middle, "leaves")))).alias("tree"))


def coverage(rows: DataFrame, levels: list[str], covered: Column, share: str = "pct") -> DataFrame:
    """Totals, covered and share in percent (one decimal) for each level, its parents and all; null marks a roll-up."""
    out = rows.rollup(*levels).agg(F.count("*").alias("total"), F.count_if(covered).alias("covered"))
    return out.withColumn(share, F.round(100.0 * F.col("covered") / F.nullif("total", F.lit(0)), 1))


def buckets(rows: DataFrame, **conditions: Column) -> DataFrame:
    """One row with the number of rows that meet each condition, in one pass."""
    return rows.agg(*[F.count_if(c).alias(n) for n, c in conditions.items()])


def newest_version(rows: DataFrame, keys: list[str], starts: str, ends: str, id_col: str) -> DataFrame:
    """The newest row of each key: latest start (nulls last), then open end before late end, then largest id."""
    return latest(rows, keys, [F.col(starts).desc_nulls_last(), F.col(ends).desc_nulls_first(), F.col(id_col).desc()])


def budgeted(rows: DataFrame, keys: list[str], order: list[str], cost: Column, budget: int, hit: Column, patience: int) -> DataFrame:
    """Rows of each key in order until the cost so far passes the budget, or ``patience`` rows in a row had no hit."""
    w = Window.partitionBy(*keys).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    spent = F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, 0))
    island = F.sum(F.when(hit, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumns({"_spent": spent, "_island": island, "_hit": hit})
    misses = F.sum(F.when(F.col("_hit"), 0).otherwise(1)).over(Window.partitionBy(*keys, "_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_misses", misses)
    stopped = F.coalesce(F.max(F.when(F.col("_misses") >= patience, 1).otherwise(0)).over(before), F.lit(0))
    rows = rows.withColumn("_stopped", stopped)
    return rows.where((F.col("_spent") <= budget) & (F.col("_stopped") == 0)).drop("_spent", "_island", "_hit", "_misses", "_stopped")


def best_span(rows: DataFrame, key: str, position: str, score: Column, width: int, last: Column | None = None) -> DataFrame:
    """(key, first, score): the run of ``width`` positions with the largest sum of scores; the first of equal ones, and none that begins after last."""
    w = Window.partitionBy(key).orderBy(position).rowsBetween(0, width - 1)
    sums = rows.select(key, F.col(position).alias("first"), F.sum(score).over(w).alias("score"), (F.lit(True) if last is None else F.col(position) <= last).alias("in_"))
    return sums.where("in_").groupBy(key).agg(F.max(F.struct("score", (-F.col("first")).alias("neg"))).alias("m")).select(key, (-F.col("m.neg")).alias("first"), F.col("m.score").alias("score"))


def browse_tariffs(
    tariffs: DataFrame, utilities: DataFrame, components: DataFrame, country: str | None = None, state: str | None = None, utility_id: int | None = None,
    utility_search: str | None = None, customer_class: str | None = None, rate_type: str | None = None, offset: int = 0, limit: int = 50,
) -> tuple[DataFrame, DataFrame]:
    """(page, total): tariffs of active utilities that pass the filters given, with their component counts, by country, state, utility, class, name and id; a utility_id goes before a search."""
    u = utilities.where("is_active")
    for column, value in (("country", country), ("state", state)):
        if value:
            u = u.where(F.col(column) == value)
    if utility_id:
        u = u.where(F.col("id") == utility_id)
    elif utility_search:
        u = u.where(F.col("name").ilike(f"%{utility_search}%"))
    t = tariffs
    for column, value in (("customer_class", customer_class), ("rate_type", rate_type)):
        if value:
            t = t.where(F.col(column) == value)
    rows = t.join(u.select(F.col("id").alias("utility_id"), F.col("name").alias("utility"), "country", "state"), "utility_id")
    page = browse(rows, [], [F.col(c) for c in ("country", "state", "utility", "customer_class", "name", "id")], offset, limit)
    return with_counts(page, components, "id", "tariff_id", n_components=F.lit(True)), rows.agg(F.count("*").alias("total"))


def capped(rows: DataFrame, keys: list[str], order: list[Column], caps: dict[int, int], level: str = "level") -> DataFrame:
    """The first rows of each key and level, as many as caps allows the level; the caps are the budget of a crawl."""
    most = F.element_at(F.create_map(*[F.lit(x) for kv in caps.items() for x in kv]), F.col(level))
    place = F.row_number().over(Window.partitionBy(*keys, level).orderBy(*order))
    return rows.withColumn("_place", place).where(F.col("_place") <= most).drop("_place")


def audit_summary(audits: DataFrame) -> DataFrame:
    """(what, name, n, pct) of audits (utility_id, grade, issues: array of severity and type): utilities by grade, issues by severity and type, utilities without fault and their share, and those that need attention with their issues."""
    none = F.lit(None).cast("double").alias("pct")
    grades = audits.groupBy(F.col("grade").alias("name")).agg(F.count("*").alias("n")).select(F.lit("grade").alias("what"), "name", "n", none)
    issues = audits.select(F.explode("issues").alias("i"))
    kinds = [issues.groupBy(F.coalesce(F.col("i")[k], F.lit(other)).alias("name")).agg(F.count("*").alias("n")).select(F.lit(k).alias("what"), "name", "n", none) for k, other in (("severity", "medium"), ("type", "other"))]
    perfect = F.count_if(F.col("grade") == "A")
    best = audits.agg(F.lit("perfect").alias("what"), F.lit("A").alias("name"), perfect.alias("n"), F.round(100.0 * perfect / F.nullif(F.count("*"), F.lit(0)), 1).cast("double").alias("pct"))
    poor = audits.where("grade in ('C', 'D', 'F')").select(F.lit("attention").alias("what"), F.concat_ws(" ", "utility_id", "grade").alias("name"), F.size("issues").cast("long").alias("n"), none)
    return grades.union(kinds[0]).union(kinds[1]).union(best).union(poor)


def explicit_list(spark: SparkSession, ids: list[int], most: int = 2000) -> DataFrame:
    """(place, id) of ids in their order, repeated ones once; an error for more than ``most`` different ones."""
    own = list(dict.fromkeys(ids))
    if len(own) > most:
        raise ValueError(f"{len(own)} ids, at most {most}")
    return spark.createDataFrame(list(enumerate(own)), "place int, id bigint")


def run_targets(utilities: DataFrame, tariffs: DataFrame, sources: DataFrame, kind: str, limit: int, country: str | None = None, state: str | None = None) -> DataFrame:
    """The ids of the utilities that a run is for, the smallest ``limit`` ones: active ones without tariffs (missing) or with some (having), of a country and state if given; or those with a source in error (error), whatever else they are."""
    if kind == "error":
        found = sources.where("status = 'ERROR'").select(F.col("utility_id").alias("id")).distinct()
    else:
        rows = utilities.where("is_active")
        for column, value in (("country", country), ("state", state)):
            rows = rows if value is None else rows.where(F.col(column) == value)
        owners = tariffs.select(F.col("utility_id").alias("id"))
        found = rows.select("id").join(owners, "id", {"missing": "left_anti", "having": "left_semi"}[kind])
    return found.where("id is not null").orderBy("id").limit(limit)


def source_domains(tariffs: DataFrame, url_col: str, most: int = 30) -> DataFrame:
    """(domain, tariffs, utilities) of the sites that most tariffs come from; utilities are different ones. Of equal sites the first by name."""
    domain = F.regexp_extract(url_col, "https?://([^/]+)", 1)
    per = tariffs.where(F.col(url_col).isNotNull()).groupBy(F.nullif(domain, F.lit("")).alias("domain"), "utility_id").agg(F.count("*").alias("n"))
    return per.groupBy("domain").agg(F.sum("n").alias("tariffs"), F.count("utility_id").alias("utilities")).orderBy(F.desc("tariffs"), "domain").limit(most)


def section(kind: Column) -> Column:
    """The part of a tariff's page that a component stands in: fixed for fixed and minimum charges, energy, demand; null for other kinds."""
    return F.when(kind.isin("fixed", "minimum"), "fixed").when(kind.isin("energy", "demand"), kind)


def country_audit(utilities: DataFrame, tariffs: DataFrame, components: DataFrame, first: str, second: str) -> DataFrame:
    """Per country of active utilities: how many have tariffs, pct of them, tariffs by class (two classes and the rest), tariffs with components, components, and their mean per tariff, both over tariffs and, as the larger tariffs count more, over components."""
    n = components.groupBy(F.col("tariff_id").alias("id")).agg(F.count("*").alias("c"))
    kind = lambda c: F.count_if(F.col("customer_class") == c)
    own = tariffs.join(n, "id", "left").groupBy(F.col("utility_id").alias("id")).agg(
        F.count("*").alias("t"), kind(first).alias("a"), kind(second).alias("b"), F.count_if(~F.col("customer_class").isin(first, second)).alias("o"), F.count("c").alias("filled"), F.sum("c").alias("c"), F.sum(F.col("c") * F.col("c")).alias("squares"))
    out = utilities.where("is_active").join(own, "id", "left").groupBy("country").agg(F.count("*").alias("utilities"), F.count("t").alias("having"), *[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("t", "a", "b", "o", "filled", "c", "squares")])
    mean = lambda x, y: F.round(F.col(x) / F.nullif(y, F.lit(0)), 1)
    return out.select("country", "utilities", "having", (F.col("utilities") - F.col("having")).alias("missing"), F.round(100 * F.col("having") / F.col("utilities")).cast("int").alias("pct"), F.col("t").alias("tariffs"), F.col("a").alias("first"), F.col("b").alias("second"), F.col("o").alias("other"), "filled", F.col("c").alias("components"), mean("c", "filled").alias("per_tariff"), mean("squares", "c").alias("per_component"))
