"""Readers of the inputs, each giving rows of one shape; bad rows go to a reject table or stay countable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattgrid.functions import text as X
from wattgrid.sources.arrays import read_array_objects

#: Bulk fields in both spellings, (name, camel case, lower case).
BULK_FIELDS = [
    ("eiaid", "eiaId", "eiaid"), ("utility", "utilityName", "utility"), ("name", "rateName", "name"), ("sector", "sector", "sector"), ("startdate", "effectiveDate", "startdate"), ("enddate", "endDate", "enddate"),
    ("source", "sourceReference", "source"), ("description", "description", "description"), ("approved", "approved", "approved"), ("is_default", "isDefault", "is_default"), ("country", "country", "country"),
    ("energyratestructure", "energyRateStrux", "energyratestructure"), ("demandstructure", "demandRateStrux", "demandstructure"), ("flatdemandstructure", "flatDemandStrux", "flatdemandstructure"),
    ("energyweekdayschedule", "energyWeekdaySched", "energyweekdayschedule"), ("energyweekendschedule", "energyWeekendSched", "energyweekendschedule"), ("fixedchargefirstmeter", "fixedChargeFirstMeter", "fixedchargefirstmeter"),
    ("fixedchargeunits", "fixedChargeUnits", "fixedchargeunits"), ("mincharge", "minCharge", "mincharge"), ("minchargeunits", "minChargeUnits", "minchargeunits"), ("demandunits", "demandUnits", "demandunits"),
]
TIERS = {"energyratestructure": "energyRateTiers", "demandstructure": "demandRateTiers", "flatdemandstructure": "flatDemandTiers"}
SECTORS = {"Residential": "residential", "Commercial": "commercial", "Industrial": "industrial", "Lighting": "lighting"}
CANADA = ["CAN", "CANADA", "CA"]
OWNERSHIP_COLUMNS = {"eia_id": ["Utility Number", "utility_id"], "name": ["Utility Name", "utility_name"], "state": ["State"], "ownership": ["Ownership", "Ownership Type"]}
FEATURE = "struct<properties:struct<NAME:string,ID:string,STATE:string,ZIP:string>,geometry:struct<type:string,coordinates:string>>"
RESPONSE = (
    "array<struct<name:string,code:string,customer_class:string,rate_type:string,description:string,effective_date:string,confidence:double,"
    "components:array<struct<component_type:string,unit:string,rate_value:double,tier_min_kwh:double,tier_max_kwh:double,tier_label:string,period_label:string,season:string>>>>"
)


def read_bulk_rates(spark: SparkSession, path: str) -> DataFrame:
    """Bulk rate records, raw: a JSON array, also gzipped, or an object with the array under items. Column r maps each field to its text, objects to their JSON."""
    body = spark.read.text(path, wholetext=True).select(F.when(F.col("value").rlike(r"^\s*\["), F.col("value")).otherwise(F.get_json_object("value", "$.items")).alias("body"))
    return body.select(F.explode(F.from_json("body", "array<map<string,string>>")).alias("r"))


def read_bulk_lines(spark: SparkSession, path: str) -> DataFrame:
    """Bulk rate records, raw as read_bulk_rates gives them, from files with one JSON object a line; these are split over tasks by size, so files of any length do.

    read_bulk_rates takes a file as one value, as its array may be one line: files up to 2 GB, one task each. Larger ones are
    to be given in this form; commas and brackets around the objects of an array that has one object a line are let be.
    """
    line = F.regexp_replace(F.trim("value"), r"^\[\s*|\s*[,\]]\s*$", "")
    rows = spark.read.text(path).select(line.alias("line")).where(F.col("line").startswith("{"))
    return rows.select(F.from_json("line", "map<string,string>").alias("r"))


def plain_values(json: Column) -> Column:
    """JSON text with each object that holds $oid or $date alone put down as its value, at any depth; in strings quotes are escaped, so none is touched there."""
    return F.regexp_replace(json, r'\{\s*"\$(?:oid|date)"\s*:\s*("[^"\\]*+(?:\\.[^"\\]*+)*+"|[^\s"{}\[\],]++)\s*\}', "$1")


def read_bulk_array(spark: SparkSession, path: str) -> DataFrame:
    """Bulk rate records, raw as read_bulk_rates gives them but with plain ids and dates, from arrays of any length, also on one line, which many tasks read."""
    return read_array_objects(spark, path).select(F.from_json(plain_values(F.col("json")), "map<string,string>").alias("r"))


def _moment(c: Column) -> Column:
    """Epoch seconds, an ISO date, or an object with one under $date, as a timestamp."""
    iso = F.when(c.rlike(r"^\s*\{"), F.from_json(c, "map<string,string>")["$date"])  # other text is no object, which costs an exception to find out
    return F.coalesce(F.try_to_timestamp(iso), F.timestamp_seconds(c.try_cast("double")), F.try_to_timestamp(c))


def _periods(c: Column, tiers: str) -> Column:
    """Periods of tiers, given as arrays or as objects with the array under ``tiers``."""
    one = "rate:double,adj:double,max:double,unit:string"
    listed = F.from_json(c, f"array<array<struct<{one}>>>")
    named = F.transform(F.from_json(c, f"array<struct<`{tiers}`:array<struct<{one}>>>>"), lambda p: p[tiers])
    return F.when(c.rlike(r"^\s*\[\s*\{"), named).otherwise(listed)


def normalize_bulk(raw: DataFrame) -> DataFrame:
    """One row per record under lower-case names, the camel-case spelling first; dates as timestamps, structures as arrays, sector as class."""
    value = lambda a, b: F.coalesce(F.nullif(F.col("r")[a], F.lit("")), F.col("r")[b])
    cols = {n: value(a, b) for n, a, b in BULK_FIELDS}
    cols |= {n: _moment(cols[n]) for n in ("startdate", "enddate")} | {n: _periods(cols[n], t) for n, t in TIERS.items()}
    cols |= {n: F.from_json(cols[n], "array<array<int>>") for n in ("energyweekdayschedule", "energyweekendschedule")}
    cols |= {n: cols[n].try_cast("double") for n in ("fixedchargefirstmeter", "mincharge")} | {"eiaid": cols["eiaid"].try_cast("long"), "name": F.coalesce(cols["name"], F.lit("Unknown Rate"))}
    given = F.col("r")["_id"]
    oid = F.coalesce(F.when(given.rlike(r"^\s*\{"), F.from_json(given, "map<string,string>")["$oid"]), given, F.col("r")["label"])
    classes = F.create_map(*[F.lit(x) for kv in SECTORS.items() for x in kv])
    return raw.select(oid.alias("label"), *[c.alias(n) for n, c in cols.items()]).withColumn("customer_class", F.element_at(classes, F.col("sector")))


def only_canada(records: DataFrame) -> DataFrame:
    return records.where(F.upper("country").isin(CANADA))


def resolve_columns(df: DataFrame, wanted: dict[str, list[str]]) -> dict[str, str]:
    """Column of df for each wanted name: one that equals a candidate without regard to case, else one that contains it."""
    found = {}
    for name, candidates in wanted.items():
        for c in candidates:
            hit = next((x for x in df.columns if x.strip().lower() == c.lower()), None) or next((x for x in df.columns if c.lower() in x.lower()), None)
            if hit:
                found[name] = hit
                break
    return found


def read_utility_master(spark: SparkSession, path: str, ownership: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of the utility list: eia_id, name, state (Unknown where blank) and utility_type (other for unknown ownerships); rejects lack a number or name."""
    return utility_master(spark.read.option("header", True).csv(path), ownership)


def utility_master(raw: DataFrame, ownership: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of a utility list whose columns are strings under any of the known headings. Of rows with one number the first of the list stays."""
    c = resolve_columns(raw, OWNERSHIP_COLUMNS)
    kinds = F.create_map(*[F.lit(x) for kv in ownership.items() for x in kv])
    text = lambda n: F.nullif(F.trim(F.col(f"`{c[n]}`")), F.lit("")) if n in c else F.lit(None).cast("string")
    rows = raw.select(text("eia_id").try_cast("double").cast("long").alias("eia_id"), text("name").alias("name"), F.coalesce(text("state"), F.lit("Unknown")).alias("state"), F.coalesce(F.element_at(kinds, text("ownership")), F.lit("other")).alias("utility_type"))
    good = F.col("eia_id").isNotNull() & F.col("name").isNotNull()
    placed = rows.withColumn("at_", F.monotonically_increasing_id())  # files are read from first to last
    first = placed.where(good).groupBy("eia_id").agg(F.min_by(F.struct(*rows.columns), "at_").alias("row_")).select("row_.*")
    return first, rows.where(~good)


def read_territories(spark: SparkSession, path: str) -> DataFrame:
    """Territories of a GeoJSON file: name, id, state, zip_codes (array) and geometry as MultiPolygon; other geometries are dropped."""
    schema = f"features array<{FEATURE}>"
    return territory_rows(spark.read.option("multiLine", True).schema(schema).json(path).select(F.explode("features").alias("f")))


def territory_rows(features: DataFrame) -> DataFrame:
    """Territories of features (column f, of the type FEATURE)."""
    point = "array<array<array<double>>>"
    rows = features.select("f.properties.*", F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("points"))
    shape = F.when(F.col("kind") == "Polygon", F.array(F.from_json("points", point))).when(F.col("kind") == "MultiPolygon", F.from_json("points", f"array<{point}>"))
    zips = F.filter(F.transform(F.split("ZIP", ","), lambda z: F.trim(z)), lambda z: z != "")
    return rows.where(F.col("kind").isin("Polygon", "MultiPolygon")).select(F.col("NAME").alias("name"), F.col("ID").alias("id"), F.col("STATE").alias("state"), F.coalesce(zips, F.array().cast("array<string>")).alias("zip_codes"), shape.alias("geometry"))


def province_territories(utilities: DataFrame, territories: DataFrame, prefixes: dict[str, list[str]]) -> DataFrame:
    """(utility_id, postal_code_prefixes) for Canadian utilities that have no territory, by province."""
    table = utilities.sparkSession.createDataFrame(list(prefixes.items()), "state string, postal_code_prefixes array<string>")
    missing = utilities.where("country = 'CA'").join(territories.select(F.col("utility_id").alias("id")), "id", "left_anti")
    return missing.join(F.broadcast(table), "state").select(F.col("id").alias("utility_id"), "postal_code_prefixes")


def new_rows(candidates: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates, one per key, whose key is not known yet."""
    return candidates.dropDuplicates(keys).join(known.select(*keys), keys, "left_anti")


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """One row per component of the reference answers: utility, tariff and component columns with their positions."""
    part = "component_type:string,rate_value:double,unit:string,tier_label:string,tier_min_kwh:double,tier_max_kwh:double,season:string,period_label:string"
    tariff = f"name:string,customer_class:string,rate_type:string,components:array<struct<{part}>>"
    schema = f"utilities array<struct<utility_id:bigint,name:string,state:string,country:string,rate_url:string,tariffs:array<struct<{tariff}>>>>"
    return truth_rows(spark.read.option("multiLine", True).schema(schema).json(path).select(F.explode("utilities").alias("u")))


def truth_rows(answers: DataFrame) -> DataFrame:
    """One row per component of answers (column u: a utility with its tariffs with their components)."""
    u = answers
    t = u.select("u.utility_id", F.col("u.name").alias("utility"), "u.state", F.posexplode("u.tariffs").alias("tariff_no", "t"))
    c = t.select("utility_id", "utility", "state", "tariff_no", F.col("t.name").alias("tariff"), "t.customer_class", "t.rate_type", F.posexplode("t.components").alias("component_no", "c"))
    return c.select(*[x for x in c.columns if x != "c"], "c.*")


def read_responses(responses: DataFrame, column: str) -> DataFrame:
    """responses with found, the tariffs of an answer that holds a JSON array or object, bare, in a code fence or inside other text; null where it holds none.

    Its parts are bound as the one element of an array, and found is one that is exploded, so that an answer is parsed once however often found is named.
    """
    once = lambda c, f: F.get(F.transform(F.array(c), f), F.lit(0))
    body = once(F.regexp_extract(column, r"(?s)```(?:json)?\s*(.*?)```", 1), lambda fenced: F.when(fenced != "", fenced).otherwise(F.col(column)))
    parts = lambda b: F.struct(F.nullif(F.regexp_extract(b, r"(?s)(\[.*\])", 1), F.lit("")).alias("listed"), F.nullif(F.regexp_extract(b, r"(?s)(\{.*\})", 1), F.lit("")).alias("single"), F.regexp_extract(b, r"[\[{]", 0).alias("first"))

    def parsed(p: Column) -> Column:
        listed, single = p["listed"], F.concat(F.lit("["), p["single"], F.lit("]"))
        first, second = F.when(p["first"] == "{", single).otherwise(listed), F.when(p["first"] == "{", listed).otherwise(single)  # what opens first is tried first
        return F.coalesce(F.from_json(first, RESPONSE), F.from_json(second, RESPONSE))

    return responses.select("*", F.explode(F.array(once(once(body, parts), parsed))).alias("found"))


def parse_responses(responses: DataFrame, key: str, column: str) -> tuple[DataFrame, DataFrame]:
    """(tariffs, rejects): the tariffs of answers as read_responses finds them; rejects hold none."""
    rows = read_responses(responses.select(key, column), column)
    found = rows.where("found is not null").select(key, F.posexplode("found").alias("place", "t")).where("t is not null").select(key, "place", "t.*")
    return found, rows.where("found is null").select(key, column)


def read_error_details(spark: SparkSession, path: str) -> DataFrame:
    """(source_id, utility_id, url, message) of the errors beside a run summary that write_summary wrote."""
    return spark.read.schema("source_id bigint, utility_id bigint, url string, message string").json(f"{path}/errors")


def error_details(summaries: DataFrame, text: str = "value") -> DataFrame:
    """(source_id, utility_id, url, message) of the error_details in the texts of run summaries, one JSON object each."""
    schema = "error_details array<struct<source_id:bigint,utility_id:bigint,url:string,message:string>>"
    return summaries.select(F.explode(F.from_json(text, schema)["error_details"]).alias("e")).select("e.*")


def read_homepage_fixes(spark: SparkSession, path: str) -> DataFrame:
    """(source_id, old_url, new_url) of key=value log lines whose new url is a bare homepage; the first of each source in file order."""
    return homepage_fixes(spark.read.text(path).select("value", F.monotonically_increasing_id().alias("line")))


def homepage_fixes(lines: DataFrame) -> DataFrame:
    """(source_id, old_url, new_url) of log lines (line, value) whose new url is a bare homepage; the first of each source."""
    value = lambda k: F.nullif(F.regexp_extract("value", rf"\b{k}=(\S+)", 1), F.lit(""))
    rows = lines.select("line", value("source_id").try_cast("long").alias("source_id"), value("old_url").alias("old_url"), value("new_url").alias("new_url"))
    rows = rows.where(F.col("source_id").isNotNull() & X.is_homepage(F.col("new_url")))
    first = rows.groupBy("source_id").agg(F.min(F.struct("line", "old_url", "new_url")).alias("m"))
    return first.select("source_id", "m.old_url", "m.new_url")


def write_summary(counts: DataFrame, errors: DataFrame, path: str) -> None:
    """A run summary: one JSON object with the counts (one row), and beside it all error rows, one JSON object a line."""
    counts.coalesce(1).write.mode("overwrite").json(f"{path}/counts")
    errors.write.mode("overwrite").json(f"{path}/errors")


def lookup_results(addresses: DataFrame, found: DataFrame, key: str = "address_id") -> DataFrame:
    """One row per address with the report's eleven columns, as text but for the number of utilities.

    addresses: address_id, region, address, formatted, latitude, longitude, error; without coordinates an address was not
    placed. found: key, place (the order of names), name, match_method, n_tariffs. The key is a column of both; where all addresses
    of a ZIP code, say, find the same utilities, it is the code, and their names are put together once.
    """
    names = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "name"))), lambda u: u["name"]), "; ")
    per = found.groupBy(key).agg(F.count("*").alias("n"), names.alias("names"), F.array_join(F.sort_array(F.collect_set("match_method")), "; ").alias("methods"), F.max("n_tariffs").alias("most"))
    placed = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    or_empty = lambda c: F.coalesce(c, F.lit(""))
    degrees = lambda c: F.when(placed, F.format_string("%.5f", F.col(c))).otherwise("")
    return addresses.join(per, key, "left").select(
        "region", "address", F.when(placed, "yes").otherwise("no").alias("geocoded"), F.when(placed, or_empty(F.col("formatted"))).otherwise("").alias("geocoded_address"), degrees("latitude").alias("lat"), degrees("longitude").alias("lon"),
        F.coalesce("n", F.lit(0)).alias("utilities_found"), or_empty(F.col("names")).alias("utility_names"), or_empty(F.col("methods")).alias("match_methods"), F.when(F.col("most") > 0, "yes").otherwise("no").alias("has_tariffs"), or_empty(F.col("error")).alias("error"),
    )


def write_lookup_results(rows: DataFrame, path: str, compression: str = "none") -> None:
    """CSV with a header; quotes in fields are doubled, as spreadsheets read them."""
    rows.write.mode("overwrite").option("header", True).option("escape", '"').option("compression", compression).csv(path)


def write_snapshot(df: DataFrame, path: str, partition: str | None = None) -> None:
    """A table's new state in a new folder; a folder that is being read is never overwritten."""
    (df.write if partition is None else df.write.partitionBy(partition)).mode("errorifexists").parquet(path)
