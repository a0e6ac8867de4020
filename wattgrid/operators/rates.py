"""Rate records: classification, components, validation, confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wattgrid.functions.lists import COMPLEX_TYPES, RATE_BOUNDS

# The words that results depend on.
CLASSES = ["residential", "commercial"]
COMPONENTS = ["energy", "demand", "fixed", "minimum", "adjustment"]
CORE = ["energy", "fixed", "demand"]
RATE_TYPES = ["flat", "tiered", "tou", "demand", "seasonal", "tou_tiered", "seasonal_tou", "seasonal_tiered", "demand_tou", "complex"]
NOT_IN_FORCE = ["proposed rate", "(proposed)", "pending approval", "subject to approval", "preliminary rate"]


def rate_type(energy: Column, weekday: Column, has_demand: Column) -> Column:
    """Type of a record from its energy structure (periods of tiers), its 12 x 24 weekday schedule and whether it has demand rates.

    Both inputs, and what is told from them, are bound as the one element of an array, as Spark works out an expression wherever it stands.
    """
    once = lambda c, f: F.get(F.transform(F.array(c), f), F.lit(0))
    hours = lambda w: F.coalesce(F.size(F.array_distinct(F.flatten(w))) > 1, F.lit(False))
    months = lambda w: F.coalesce((F.size(w) >= 12) & (F.size(F.array_distinct(w)) > 1), F.lit(False))
    tiers = F.coalesce(F.exists(energy, lambda p: F.size(p) > 1), F.lit(False))
    marks = F.struct(tiers.alias("tiers"), F.coalesce(has_demand, F.lit(False)).alias("demand"), once(weekday, lambda w: F.struct(hours(w).alias("tou"), months(w).alias("seasonal"))).alias("w"))

    def kind(m: Column) -> Column:
        tiers, demand, tou, seasonal = m["tiers"], m["demand"], m["w"]["tou"], m["w"]["seasonal"]
        return (
            F.when(demand & tou, "demand_tou").when(tou & tiers, "tou_tiered").when(seasonal & tou, "seasonal_tou").when(seasonal & tiers, "seasonal_tiered")
            .when(seasonal, "seasonal").when(demand, "demand").when(tou, "tou").when(tiers, "tiered").otherwise("flat")
        )

    return once(marks, kind)


def stored_type(kind: Column) -> Column:
    """A candidate's rate type as it is stored: known ones as they are, other combinations as complex; unknown ones stay for validation."""
    return F.when(kind.isin(COMPLEX_TYPES), "complex").otherwise(kind)


def state_bounds(spark: SparkSession) -> DataFrame:
    """The bounds of validate for the states that have their own, and a row for all others."""
    return spark.createDataFrame([(s, *v) for s, v in RATE_BOUNDS.items()], "state string, " + ", ".join(f"{p}_{k} double" for k in ("energy", "fixed", "demand") for p in ("p95", "p99")))


def tier_bounds(rows: DataFrame, keys: list[str], order: list[str], upper: str, lower: str = "tier_min") -> DataFrame:
    """Each tier's lower bound: the upper bound of the tier before it under the same keys, null for the first."""
    return rows.withColumn(lower, F.lag(upper).over(Window.partitionBy(*keys).orderBy(*order)))


def explode_components(records: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, component_type, unit, rate_value, period_index, tier_min_kwh, tier_max_kwh, adjustment) of bulk records.

    Records hold fixedchargefirstmeter, mincharge and their units, and energyratestructure, demandstructure and
    flatdemandstructure as arrays of periods of tiers (rate, adj, max, unit). Null structures and charges give no rows.
    """
    none = F.lit(None)
    flat = lambda kind, value, unit: records.where(F.col(value).isNotNull()).select(id_col, F.lit(kind).alias("component_type"), F.coalesce(unit, F.lit("$/month")).alias("unit"), F.col(value).cast("double").alias("rate_value"), none.cast("int").alias("period_index"), none.cast("double").alias("tier_min_kwh"), none.cast("double").alias("tier_max_kwh"), none.cast("double").alias("adjustment"))
    out = flat("fixed", "fixedchargefirstmeter", F.col("fixedchargeunits")).unionByName(flat("minimum", "mincharge", F.col("minchargeunits")))
    periods = records.select(id_col, F.posexplode("energyratestructure").alias("period_index", "tiers"))
    tiers = periods.select(id_col, "period_index", F.posexplode("tiers").alias("tier", "t"))
    before = F.lag("t.max").over(Window.partitionBy(id_col, "period_index").orderBy("tier"))
    energy = tiers.withColumn("before", before).select(
        id_col, F.lit("energy").alias("component_type"), F.coalesce("t.unit", F.lit("kWh")).alias("unit"), F.coalesce(F.col("t.rate").cast("double"), F.lit(0.0)).alias("rate_value"), "period_index",
        F.when(F.col("t.max").isNotNull() | (F.col("before") != 0), F.col("before").cast("double")).alias("tier_min_kwh"), F.col("t.max").cast("double").alias("tier_max_kwh"), F.nullif(F.col("t.adj").cast("double"), F.lit(0.0)).alias("adjustment"),
    )
    out = out.unionByName(energy)
    for structure in ("demandstructure", "flatdemandstructure"):
        tiers = records.select(id_col, "demandunits", F.posexplode(structure).alias("period_index", "tiers")).select(id_col, "demandunits", "period_index", F.explode("tiers").alias("t"))
        out = out.unionByName(tiers.select(id_col, F.lit("demand").alias("component_type"), F.coalesce("demandunits", F.lit("kW")).alias("unit"), F.coalesce(F.col("t.rate").cast("double"), F.lit(0.0)).alias("rate_value"), "period_index", none.cast("double").alias("tier_min_kwh"), F.col("t.max").cast("double").alias("tier_max_kwh"), none.cast("double").alias("adjustment")))
    return out


def load_records(records: DataFrame, utilities: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tariffs, components, rejects) of bulk records, as normalize_bulk gives them; known: labels that are loaded already, so that repeating a load adds nothing.

    Records need a customer class, a utility (by number or name) and at least one component; rejects hold the label and
    the first of these reasons. Of records with equal labels one is loaded; records without a label are rejected too.
    """
    from wattgrid.operators.resolve import resolve_utilities

    rows = records.dropDuplicates(["label"])
    owner = resolve_utilities(rows.select("label", "eiaid", "utility"), utilities).select("label", "utility_id")
    parts = explode_components(rows, "label")
    loaded = known.select("label").distinct().withColumn("known_", F.lit(True))
    n = parts.groupBy("label").agg(F.count("*").alias("n_components"))
    rows = rows.join(owner, "label", "left").join(loaded, "label", "left").join(n, "label", "left")
    reason = F.when(F.col("label").isNull(), "no id").when(F.col("known_"), "known").when(F.col("customer_class").isNull(), "no class").when(F.col("utility_id").isNull(), "no utility").when(F.coalesce("n_components", F.lit(0)) == 0, "no components")
    has_demand = F.col("demandstructure").isNotNull() | F.col("flatdemandstructure").isNotNull()
    kind = stored_type(rate_type(F.col("energyratestructure"), F.col("energyweekdayschedule"), has_demand))
    rows = rows.withColumns({"reason": reason, "rate_type": kind})
    tariffs = rows.where("reason is null").select("label", "utility_id", "customer_class", "rate_type")
    return tariffs, parts.join(tariffs.select("label"), "label", "left_semi"), rows.where("reason is not null").select("label", "reason")


def validate(tariffs: DataFrame, components: DataFrame, bounds: DataFrame, valid_classes: list[str] = CLASSES, valid_types: list[str] = RATE_TYPES) -> DataFrame:
    """tariffs (id, name, customer_class, rate_type, state) with issues (array), valid and needs_review.

    components (tariff_id, component_type, rate_value); bounds (state, p95, p99 for energy, fixed and demand as p95_energy ...),
    where the row with a null state holds for states without one. A value over three times its p99 is an issue, over its p95 a
    reason for review; energy between 0 and 0.01, negative values other than energy and adjustments, unknown types and the
    lack of a core component are issues too.
    """
    names = [f"{p}_{k}" for k in CORE for p in ("p95", "p99")]
    other = bounds.where("state is null").select(*[F.col(n).alias(f"d_{n}") for n in names])
    rows = tariffs.join(bounds.where("state is not null"), "state", "left").crossJoin(other)  # other: one row
    rows = rows.select(*tariffs.columns, *[F.coalesce(n, f"d_{n}").alias(n) for n in names])
    value, kind = F.col("rate_value"), F.col("component_type")
    over = lambda p, times: F.coalesce(*[F.when(kind == k, value > F.col(f"{p}_{k}") * times) for k in CORE], F.lit(False))
    found = F.array_compact(F.array(
        F.when(~kind.isin(COMPONENTS) | kind.isNull(), F.concat(F.lit("invalid component_type "), F.coalesce(kind, F.lit("null")))),
        F.when((value < 0) & ~kind.isin("adjustment", "energy"), F.lit("negative rate_value")),
        F.when((kind == "energy") & (value > 0) & (value < 0.01), F.lit("energy rate suspiciously low")),
        F.when(over("p99", 3), F.concat(kind, F.lit(" rate over 3x p99"))),
    ))
    per = rows.join(components.withColumnRenamed("tariff_id", "id"), "id").groupBy("id").agg(
        F.flatten(F.collect_list(found)).alias("found"), F.bool_or(kind.isin(CORE)).alias("core"), F.bool_or(over("p95", 1)).alias("high")
    )
    out = rows.join(per, "id", "left")
    low = F.lower("name")
    marked = low.contains(NOT_IN_FORCE[0])
    for words in NOT_IN_FORCE[1:]:
        marked = marked | low.contains(words)
    own = F.array_compact(F.array(
        F.when(F.col("name").isNull() | F.col("name").isin("", "Unknown"), "missing name"),
        F.when(F.col("customer_class").isNull() | ~F.col("customer_class").isin(valid_classes), "invalid customer_class"),
        F.when(F.col("rate_type").isNull() | ~F.col("rate_type").isin(valid_types), "invalid rate_type"),
        F.when(marked, "proposed or pending"),
        F.when(~F.coalesce("core", F.lit(False)), "no energy/fixed/demand component"),
    ))
    issues = F.sort_array(F.concat(own, F.coalesce("found", F.array().cast("array<string>"))))
    out = out.withColumn("issues", issues).withColumn("valid", F.size("issues") == 0)
    return out.select(*tariffs.columns, "issues", "valid", (F.col("valid") & F.coalesce("high", F.lit(False))).alias("needs_review"))


def validation_report(validated: DataFrame) -> DataFrame:
    return validated.agg(
        F.count("*").alias("total"), F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("invalid"), F.count_if("needs_review").alias("flagged"),
        F.coalesce(F.bool_or(F.col("valid") & (F.col("customer_class") == "residential")), F.lit(False)).alias("has_residential"), F.coalesce(F.bool_or(F.col("valid") & (F.col("customer_class") == "commercial")), F.lit(False)).alias("has_commercial"),
    )


def confidence(same_domain: Column, reported: Column, energy_values: Column, p95_energy: Column, n_components: Column, utility_name: Column, source_url: Column, name: Column) -> tuple[Column, Column]:
    """(score, factors): six weighted signals as a map, and their sum, at most 1, to three decimals. same_domain is null where unknown; energy_values is an array."""
    words = F.array_distinct(F.filter(F.split(F.lower(utility_name), r"\s+"), lambda w: F.length(w) > 2))
    url, low = F.lower(F.coalesce(source_url, F.lit(""))), F.lower(name)
    hits = F.size(F.filter(words, lambda w: F.contains(url, w) | F.contains(low, w)))
    share = F.when(F.size(words) > 0, F.round(F.least(F.lit(0.2), hits / F.size(words) * 0.2), 3)).otherwise(0.0)
    factors = F.create_map(
        F.lit("domain_match"), F.coalesce(F.when(same_domain, 0.25), F.lit(0.0)),
        F.lit("llm_confidence"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), reported)) * 0.2, 3),
        F.lit("rates_normal"), F.when(F.exists(energy_values, lambda v: v > p95_energy), 0.0).otherwise(0.15),
        F.lit("component_richness"), F.when(n_components >= 2, 0.1).when(n_components == 1, 0.05).otherwise(0.0),
        F.lit("has_energy"), F.when(F.size(energy_values) > 0, 0.1).otherwise(0.0),
        F.lit("name_match"), share,
    )
    total = F.aggregate(F.map_values(factors), F.lit(0.0), lambda a, x: a + x)
    return F.round(F.least(F.lit(1.0), total), 3), factors
