"""The registered queries of the tariff engine, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattgrid.functions import lists as L
from wattgrid.functions import text as X
from wattgrid.operators import changes, geo, rates
from wattgrid.operators import relational as R
from wattgrid.plans.adaptors import Tables
from wattgrid.registry import AS_OF, ORACLES, QUERIES, query  # noqa: F401

# Browsing


@query("""
    select u.id, u.name, u.state, u.country, count(t.id) as n_tariffs from utilities u left join tariffs t on t.utility_id = u.id
    where u.is_active and u.country = 'ASIA' and u.state ilike '%n_1%' and u.name ilike '%5%' group by all order by u.name, u.id limit 20 offset 2""")
def utility_list(t: Tables) -> DataFrame:
    """A page of active utilities by name, with a country and parts of state and name given."""
    filters = [F.col("is_active"), F.col("country") == "ASIA", F.col("state").ilike("%n_1%"), F.col("name").ilike("%5%")]
    page = R.browse(t.utilities.select("id", "name", "state", "country", "is_active"), filters, [F.col("name"), F.col("id")], 2, 20)
    return R.with_counts(page.drop("is_active"), t.tariffs, "id", "utility_id", n_tariffs=F.lit(True))


@query("""select id, name, country, (select count(*) from tariffs t where t.utility_id = u.id) as n_tariffs from utilities u where id = (select min(utility_id) from tariffs)""")
def utility_detail(t: Tables) -> DataFrame:
    first = t.tariffs.agg(F.min("utility_id").alias("id"))
    rows = t.utilities.join(first, "id").select("id", "name", "country")
    return R.with_counts(rows, t.tariffs, "id", "utility_id", n_tariffs=F.lit(True))


@query("""
    select t.id, t.name, u.name as utility, u.state, t.customer_class, cast(coalesce(c.n, 0) as bigint) as n_components
    from tariffs t join utilities u on u.id = t.utility_id left join (select tariff_id, count(*) n from components group by 1) c on c.tariff_id = t.id
    where u.country = 'EUROPE' and t.rate_type = 'O'""")
def tariff_browse(t: Tables) -> DataFrame:
    u = t.utilities.where("country = 'EUROPE'").select(F.col("id").alias("utility_id"), F.col("name").alias("utility"), "state")
    rows = t.tariffs.where("rate_type = 'O'").join(u, "utility_id").select("id", "name", "utility", "state", "customer_class")
    return R.with_counts(rows, t.components, "id", "tariff_id", n_components=F.lit(True))


BROWSED = """+ b as (
        select t.id, t.name, u.name as utility, u.country, u.state, t.customer_class, t.utility_id, t.rate_type from tariffs t join utilities u on u.id = t.utility_id where u.is_active),
    n as (select tariff_id, count(*) as n from components group by 1)
    select b.id, b.name, utility, cast(coalesce(n, 0) as bigint) as n_components, total
    from (select *, count(*) over () as total from b where {} order by country, state, utility, customer_class, name, id limit 40 offset 5) b left join n on tariff_id = b.id"""


def _browsed(t: Tables, **filters) -> DataFrame:
    page, total = R.browse_tariffs(t.tariffs, t.utilities, t.components, offset=5, limit=40, **filters)
    return page.crossJoin(total).select("id", "name", "utility", "n_components", "total")


@query(BROWSED.format("country = 'EUROPE' and utility ilike '%1%' and customer_class = '1-URGENT' and rate_type = 'O'"))
def tariff_search(t: Tables) -> DataFrame:
    return _browsed(t, country="EUROPE", utility_search="1", customer_class="1-URGENT", rate_type="O")


@query(BROWSED.format("utility_id = 7"))
def tariffs_by_utility_id(t: Tables) -> DataFrame:
    """The search counts for nothing beside a utility's id."""
    return _browsed(t, utility_id=7, utility_search="no such name")


@query("""select t.id, t.name, count(*) over () as total from tariffs t join utilities u on u.id = t.utility_id where u.is_active and t.customer_class = '1-URGENT' order by t.name, t.id limit 50 offset 20""")
def tariff_page(t: Tables) -> DataFrame:
    rows = t.tariffs.where("customer_class = '1-URGENT'").join(t.utilities.where("is_active").select(F.col("id").alias("utility_id")), "utility_id", "left_semi").select("id", "name")
    return R.browse(rows, [], [F.col("name"), F.col("id")], 20, 50).crossJoin(rows.agg(F.count("*").alias("total")))


@query("""select utility_id, id, name, rate_type from tariffs where customer_class = '2-HIGH' and rate_type = 'F'""")
def tariffs_of_utility(t: Tables) -> DataFrame:
    return R.browse(t.tariffs, [F.col("customer_class") == "2-HIGH", F.col("rate_type") == "F"], [F.col("utility_id"), F.col("id")]).select("utility_id", "id", "name", "rate_type")


@query("""select t.id, t.name, string_agg(c.ordinal || ':' || c.component_type, ',' order by c.ordinal, c.component_type) as parts from tariffs t left join components c on c.tariff_id = t.id group by all""")
def tariff_detail(t: Tables) -> DataFrame:
    rows = R.nested(t.tariffs.select("id", "name"), t.components, "id", "tariff_id", ["ordinal", "component_type"], "components")
    parts = F.array_join(F.transform("components", lambda c: F.concat(c["ordinal"].cast("string"), F.lit(":"), c["component_type"])), ",")
    return rows.select("id", "name", F.nullif(parts, F.lit("")).alias("parts"))


@query("""select country, count(distinct state) as states, count(*) as utilities, min(name) as first_name from utilities group by 1""")
def filter_tree(t: Tables) -> DataFrame:
    states = t.utilities.groupBy("country", "state").agg(F.count("*").alias("n"), F.min("name").alias("first_name"))
    return states.groupBy("country").agg(F.count("state").alias("states"), F.sum("n").alias("utilities"), F.min("first_name").alias("first_name"))


@query("""
    select row_number() over (order by case when country = 'AMERICA' then 0 else 1 end, country, state) as place, country, state
    from (select distinct country, state from utilities where state <> 'NATION_13')""")
def facet_lists(t: Tables) -> DataFrame:
    """Countries and states to choose from, one country before the others and without the state that stands for unknown."""
    rows = t.utilities.where("state <> 'NATION_13'").select("country", "state").distinct()
    first = F.when(F.col("country") == "AMERICA", 0).otherwise(1)
    return rows.select(F.row_number().over(Window.orderBy(first, "country", "state")).cast("long").alias("place"), "country", "state")  # a row per state


@query("""select id, name, cast(last_verified as varchar) as verified, amount > 100000 as approved from tariffs where last_verified is not null""")
def tariff_provenance(t: Tables) -> DataFrame:
    return t.tariffs.where("last_verified is not null").select("id", "name", F.col("last_verified").cast("string").alias("verified"), (F.col("amount") > 100000).alias("approved"))


@query("""select id, source_id, checked_us from (select *, row_number() over (order by checked_us nulls first, id) rn from checks) where rn <= 100""")
def check_queue(t: Tables) -> DataFrame:
    return t.checks.orderBy(F.col("checked_us").asc_nulls_first(), "id").limit(100).select("id", "source_id", "checked_us")


@query("""+ done as (select distinct source_id, props from checks where content_hash = 'purchase')
    select source_id, props as url from (select distinct source_id, props from checks where failed) anti join done using (source_id, props) order by source_id, url limit 50""")
def unattempted_errors(t: Tables) -> DataFrame:
    """The first 50 pages in error that no action was taken on."""
    page = ["source_id", F.col("props").alias("url")]
    failed, done = t.checks.where("failed").select(*page).distinct(), t.checks.where("content_hash = 'purchase'").select(*page)
    return R.browse(R.without(failed, done, ["source_id", "url"]), [], [F.col("source_id"), F.col("url")], 0, 50)


@query("""select id, 'missing' as target from utilities u where is_active and not exists (select 1 from tariffs t where t.utility_id = u.id)
    union all select id, 'having' from utilities u where is_active and exists (select 1 from tariffs t where t.utility_id = u.id)""")
def target_selectors(t: Tables) -> DataFrame:
    u, owners = t.utilities.where("is_active").select("id"), t.tariffs.select(F.col("utility_id").alias("id")).distinct()
    return R.without(u, owners, "id").withColumn("target", F.lit("missing")).unionByName(R.having(u, owners, "id").withColumn("target", F.lit("having")))


@query("""+ owners as (select distinct utility_id from tariffs), last as (select source_id as id, arg_max(failed, (checked_us, id)) as failed from checks group by 1), c as (
      select id, 'missing' as target from utilities where is_active and country = 'ASIA' and id not in (select utility_id from owners)
      union all select id, 'having' from utilities where is_active and state = 'NATION_3' and id in (select utility_id from owners)
      union all select distinct id, 'in error' from last where failed)
    select id, target from c qualify row_number() over (partition by target order by id) <= 40""")
def update_targets(t: Tables) -> DataFrame:
    """The first utilities to look at: without tariffs in a country, with tariffs in a state, and those whose source is in error now; 40 of each."""
    u, owners = t.utilities.where("is_active"), t.tariffs.select(F.col("utility_id").alias("id")).distinct()
    failed = t.checks.groupBy(F.col("source_id").alias("id")).agg(F.max_by("failed", F.struct("checked_us", "id")).alias("failed")).where("failed")
    chosen = {"missing": R.without(u.where("country = 'ASIA'"), owners, "id"), "having": R.having(u.where("state = 'NATION_3'"), owners, "id"), "in error": failed}
    parts = [R.browse(rows.select("id"), [], [F.col("id")], 0, 40).withColumn("target", F.lit(name)) for name, rows in chosen.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""select tariff_id, ordinal, rate_value::double as rate_value from components where component_type = 'N' and (rate_value > 0.09 or rate_value < 0.02) and rate_value <> 0 order by components.rate_value desc, tariff_id, ordinal limit 30""")
def suspicious_rates(t: Tables) -> DataFrame:
    rows = t.components.where("component_type = 'N' and (rate_value > 0.09 or rate_value < 0.02) and rate_value <> 0")
    return rows.orderBy(F.desc("rate_value"), "tariff_id", "ordinal").limit(30).select("tariff_id", "ordinal", "rate_value")


@query("""select t.id, t.name from tariffs t where not exists (select 1 from components c where c.tariff_id = t.id and c.component_type = 'A')""")
def tariffs_without_component(t: Tables) -> DataFrame:
    return R.without(t.tariffs.select("id", "name"), t.components.where("component_type = 'A'").select(F.col("tariff_id").alias("id")), "id")


@query("""select customer_class, count(*) as unverified from tariffs where rate_type <> 'F' and last_verified is null group by 1""")
def seed_only_tariffs(t: Tables) -> DataFrame:
    return t.tariffs.where("rate_type <> 'F' and last_verified is null").groupBy("customer_class").agg(F.count("*").alias("unverified"))


@query("""select tariff_id, coalesce(nullif(trim(case when ordinal > 4 then ' ' else period end), ''), 'All Seasons') as season, case component_type when 'A' then 'fixed' when 'R' then 'energy' else case when ordinal % 3 = 0 then 'fixed' when ordinal % 3 = 1 then 'demand' end end as section, count(*) as parts, max(rate_value)::double as top from components where component_type <> 'N' or ordinal % 3 < 2 group by all""")
def component_sections(t: Tables) -> DataFrame:
    season = F.when(F.col("ordinal") > 4, " ").otherwise(F.col("period"))
    kind = F.when(F.col("component_type") == "A", "fixed").when(F.col("component_type") == "R", "energy").otherwise(F.get(F.array(F.lit("minimum"), F.lit("demand"), F.lit("adjustment")), F.col("ordinal") % 3))
    rows = t.components.withColumn("section", R.section(kind)).where("section is not null")
    return rows.groupBy("tariff_id", F.coalesce(F.nullif(F.trim(season), F.lit("")), F.lit("All Seasons")).alias("season"), "section").agg(F.count("*").alias("parts"), F.max("rate_value").alias("top"))


BATCHES = {name: [f"NATION_{k}" for k in range(i, 25, 15)] for i, name in enumerate(L.STATE_BATCHES)}


@query(f"""+ b(batch, state) as (values {", ".join(f"('{b}', '{s}')" for b, states in BATCHES.items() for s in states)})
    select batch, id, name, row_number() over (partition by batch order by state, name, id) as place from b join utilities u using (state) where is_active""")
def region_batches(t: Tables) -> DataFrame:
    """Utilities of each named batch of states in the order in which they are worked through."""
    groups = t.spark.createDataFrame([(b, s) for b, states in BATCHES.items() for s in states], "batch string, state string")
    rows = t.utilities.where("is_active").join(F.broadcast(groups), "state")  # a row per state
    return rows.select("batch", "id", "name", F.row_number().over(Window.partitionBy("batch").orderBy("state", "name", "id")).cast("long").alias("place"))


@query(r"""+ q(template) as (values ('{name} electric rates {state}'), ('{name} tariff')), c as (
        select id, state, lower(regexp_replace(name, '(?i)[\s,]+(inc|llc|co|corp|corporation|company|ltd|limited)\.?$', '')) as name
        from (select id, state, name || case id % 3 when 0 then ', Inc.' when 1 then ' Company' else '' end as name from utilities where is_active))
    select id, replace(replace(template, '{name}', regexp_replace(name, '[^a-z0-9\s]', '', 'g')), '{state}', state) as search from c cross join q""")
def search_queries(t: Tables) -> DataFrame:
    """Every template filled in with each utility's name, without corporate suffix, and state."""
    from wattgrid.operators.resolve import plain_utility

    suffix = F.get(F.array(F.lit(", Inc."), F.lit(" Company"), F.lit("")), (F.col("id") % 3).cast("int"))
    templates = t.spark.createDataFrame([("{name} electric rates {state}",), ("{name} tariff",)], "template string")
    rows = t.utilities.where("is_active").withColumn("plain", plain_utility(F.concat("name", suffix))).crossJoin(F.broadcast(templates))
    return rows.select("id", F.replace(F.replace("template", F.lit("{name}"), F.col("plain")), F.lit("{state}"), F.col("state")).alias("search"))


# Monitoring


@query("""select source_id, id, content_hash, checked_us from (select *, row_number() over (partition by source_id order by checked_us desc, id desc) rn from checks) where rn = 1""")
def latest_check(t: Tables) -> DataFrame:
    return R.latest(t.checks, ["source_id"], [F.desc("checked_us"), F.desc("id")]).select("source_id", "id", "content_hash", "checked_us")


@query("""select count(*) as total, count(*) filter (failed) as errors, count(*) filter (content_hash = 'view') as changed, count(distinct source_id) as sources from checks""")
def monitoring_stats(t: Tables) -> DataFrame:
    return t.checks.agg(F.count("*").alias("total"), F.count_if("failed").alias("errors"), F.count_if(F.col("content_hash") == "view").alias("changed"), F.count_distinct("source_id").alias("sources"))


MESSAGES = ["HTTP 403 Forbidden", "404", "502 bad gateway", "read timed out", "SSL: bad certificate", "getaddrinfo failed", "connection refused", "empty content", "401", "too many redirects", "odd"]


@query("""+ m as (select source_id, id, (id % 11)::int as k, case when id % 29 = 0 then 'http://placeholder.example/' else 'http://a.example/' end as url from checks where failed),
    c as (select *, case when url like '%placeholder%' then 'placeholder_url' else list_extract(['403_forbidden','404_not_found','5xx_server_error','timeout','ssl_certificate','dns_failed','connection_error','empty_content','auth_required','redirect_error','other'], k + 1) end as category from m)
    select category, count(*) as checks, count(distinct source_id) as sources from c group by 1""")
def error_categories(t: Tables) -> DataFrame:
    rows = t.checks.where("failed").select("source_id", F.get(F.array(*map(F.lit, MESSAGES)), (F.col("id") % 11).cast("int")).alias("message"), F.when(F.col("id") % 29 == 0, "http://placeholder.example/").otherwise("http://a.example/").alias("url"))
    return rows.groupBy(X.error_category(F.col("message"), F.col("url")).alias("category")).agg(F.count("*").alias("checks"), F.count_distinct("source_id").alias("sources"))


@query("""select source_id // 2 as site, checked_us // 21600000000 as quarter, count(*) as total from checks group by 1, 2 having count(*) = count(*) filter (content_hash in ('error', 'view'))""")
def dead_sources(t: Tables) -> DataFrame:
    """Sites none of whose checks, of all of a quarter of a day, had another outcome."""
    site = F.struct(F.floor(F.col("source_id") / 2).alias("site"), F.floor(F.col("checked_us") / 21600000000).alias("quarter"))
    return R.all_children_match(t.checks.select(site.alias("k"), "content_hash"), "k", F.col("content_hash").isin("error", "view")).select("k.site", "k.quarter", "total")


@query("""select source_id, props as url, count(*) as total from checks group by 1, 2 having count(*) = count(*) filter (content_hash in ('error', 'view'))""")
def dead_pages(t: Tables) -> DataFrame:
    """Pages of a source none of whose checks, of all, had another outcome."""
    pages = t.checks.select(F.struct("source_id", F.col("props").alias("url")).alias("page"), "content_hash")
    return R.all_children_match(pages, "page", F.col("content_hash").isin("error", "view")).select("page.*", "total")


@query("""+ s as (select *, last_value(case when not failed then content_hash end ignore nulls) over (partition by source_id order by checked_us, id rows between unbounded preceding and 1 preceding) as before from checks)
    select id, source_id, not failed and before is not null and before <> content_hash as changed, case when failed then 'error' when before is null then 'first' when before <> content_hash then 'changed' else 'unchanged' end as outcome,
      case when failed or (before is not null and before <> content_hash) then 'pending' else 'dismissed' end as review from s""")
def change_detection(t: Tables) -> DataFrame:
    from wattgrid.streaming.checks import detect_changes

    return detect_changes(t.checks, "source_id", "checked_us", "id", "content_hash", "failed").select("id", "source_id", "changed", "outcome", "review")


@query("""select cast(date_trunc('week', checked_at) as date)::varchar as week, count(*) as checks, count(*) filter (failed) as errors from checks group by 1""")
def weekly_outcomes(t: Tables) -> DataFrame:
    week = F.date_trunc("week", "checked_at").cast("date").cast("string")
    return t.checks.groupBy(week.alias("week")).agg(F.count("*").alias("checks"), F.count_if("failed").alias("errors"))


@query("""select source_id, max(checked_us) as last_us from checks where content_hash = 'view' and checked_at >= timestamp '2024-01-20' - interval 7 day and checked_at < timestamp '2024-01-20' group by 1""")
def changed_recently(t: Tables) -> DataFrame:
    rows = t.checks.where("content_hash = 'view' and checked_at >= timestamp_ntz'2024-01-13' and checked_at < timestamp_ntz'2024-01-20'")
    return rows.groupBy("source_id").agg(F.max("checked_us").alias("last_us"))


@query("""select utility_id, status, n from (select source_id as utility_id, content_hash as status, count(*) as n, row_number() over (partition by content_hash order by count(*) desc, source_id) rn from checks group by 1, 2) where rn <= 5""")
def top_sources(t: Tables) -> DataFrame:
    counts = t.checks.groupBy(F.col("source_id").alias("utility_id"), F.col("content_hash").alias("status")).agg(F.count("*").alias("n"))
    return R.latest(counts, ["status"], [F.desc("n"), F.col("utility_id")], 5)


# Quality


@query("""select country, state, count(*) as total, count(*) filter (has) as covered, round(100.0 * count(*) filter (has) / count(*), 1) as pct
    from (select u.*, exists (select 1 from tariffs t where t.utility_id = u.id and t.rate_type = 'P') as has from utilities u where is_active) group by rollup (country, state)""")
def coverage_rollup(t: Tables) -> DataFrame:
    rows = R.with_counts(t.utilities.where("is_active"), t.tariffs.where("rate_type = 'P'"), "id", "utility_id", n=F.lit(True))
    return R.coverage(rows, ["country", "state"], F.col("n") > 0).withColumn("pct", F.col("pct").cast("double"))


@query("""select (select count(*) from utilities) as utilities, (select count(*) from utilities where is_active) as active, (select count(*) from tariffs) as tariffs, (select count(*) from components) as components,
    (select count(distinct utility_id) from tariffs) as with_tariffs, round(100.0 * (select count(distinct utility_id) from tariffs) / (select count(*) from utilities), 2) as pct""")
def quality_headline(t: Tables) -> DataFrame:
    u = t.utilities.agg(F.count("*").alias("utilities"), F.count_if("is_active").alias("active"))
    f = t.tariffs.agg(F.count("*").alias("tariffs"), F.count_distinct("utility_id").alias("with_tariffs"))
    return u.crossJoin(f).crossJoin(t.components.agg(F.count("*").alias("components"))).withColumn("pct", F.round(100.0 * F.col("with_tariffs") / F.col("utilities"), 2).cast("double"))


@query("""select utility_id, count(*) as n from tariffs group by 1 having count(*) >= 15 order by n desc, utility_id limit 30""")
def outlier_utilities(t: Tables) -> DataFrame:
    return t.tariffs.groupBy("utility_id").agg(F.count("*").alias("n")).where("n >= 15").orderBy(F.desc("n"), "utility_id").limit(30)


@query(f"""select count(*) filter (last_verified > date '{AS_OF}' - 30) as within_30, count(*) filter (last_verified > date '{AS_OF}' - 90) as within_90, count(*) filter (last_verified is null) as never from tariffs""")
def freshness_buckets(t: Tables) -> DataFrame:
    v, day = F.col("last_verified"), F.lit(AS_OF).cast("date")
    return R.buckets(t.tariffs, within_30=v > F.date_sub(day, 30), within_90=v > F.date_sub(day, 90), never=v.isNull())


@query(f"""select case when date '{AS_OF}' - coalesce(last_verified, effective_date) <= 730 then 'current' when date '{AS_OF}' - coalesce(last_verified, effective_date) <= 1825 then 'aging' else 'stale' end as label, count(*) as n from tariffs group by 1""")
def freshness_labels(t: Tables) -> DataFrame:
    return t.tariffs.groupBy(X.freshness(F.col("last_verified"), F.col("effective_date"), F.lit(AS_OF).cast("date")).alias("label")).agg(F.count("*").alias("n"))


@query(f"""select country, count(*) filter (effective_date > date '{AS_OF}' - 730 or last_verified > date '{AS_OF}' - 730) as current, count(*) filter (effective_date is null and last_verified is null) as undated,
    count(*) filter (effective_date <= date '{AS_OF}' - 730 and effective_date > date '{AS_OF}' - 1825) as aging from tariffs t join utilities u on u.id = t.utility_id group by 1""")
def freshness_by_country(t: Tables) -> DataFrame:
    day = F.lit(AS_OF).cast("date")
    two, five = F.date_sub(day, 730), F.date_sub(day, 1825)
    e, v = F.col("effective_date"), F.col("last_verified")
    rows = t.tariffs.join(t.utilities.select(F.col("id").alias("utility_id"), "country"), "utility_id")
    return rows.groupBy("country").agg(F.count_if((e > two) | (v > two)).alias("current"), F.count_if(e.isNull() & v.isNull()).alias("undated"), F.count_if((e <= two) & (e > five)).alias("aging"))


@query("""select count(*) filter (amount >= 200000) as high, count(*) filter (amount >= 50000 and amount < 200000) as middle, count(*) filter (amount < 50000) as low, count(*) filter (amount is null) as none from tariffs""")
def confidence_buckets(t: Tables) -> DataFrame:
    a = F.col("amount")
    return R.buckets(t.tariffs, high=a >= 200000, middle=(a >= 50000) & (a < 200000), low=a < 50000, none=a.isNull())


@query("""+ n as (select tariff_id, count(*) c from components group by 1)
    select country, count(distinct u.id) as utilities, count(distinct t.utility_id) as with_tariffs, count(distinct t.id) as tariffs, cast(coalesce(sum(n.c), 0) as bigint) as components, round(coalesce(sum(n.c), 0) / nullif(count(distinct t.id), 0), 4) as per_tariff
    from utilities u left join tariffs t on t.utility_id = u.id left join n on n.tariff_id = t.id group by 1""")
def counts_by_country(t: Tables) -> DataFrame:
    n = t.components.groupBy(F.col("tariff_id").alias("id")).agg(F.count("*").alias("c"))
    per = t.tariffs.join(n, "id", "left").groupBy(F.col("utility_id").alias("id")).agg(F.count("*").alias("t"), F.coalesce(F.sum("c"), F.lit(0)).alias("c"))
    out = t.utilities.join(per, "id", "left").groupBy("country").agg(F.count("*").alias("utilities"), F.count("t").alias("with_tariffs"), F.coalesce(F.sum("t"), F.lit(0)).alias("tariffs"), F.coalesce(F.sum("c"), F.lit(0)).alias("components"))
    return out.withColumn("per_tariff", F.round(F.col("components") / F.nullif("tariffs", F.lit(0)), 4))


@query("""+ n as (select utility_id, count(*) c, count(*) filter (customer_class = '1-URGENT') res, count(*) filter (customer_class = '2-HIGH') com from tariffs group by 1)
    select country, count(*) as utilities, count(n.c) as with_tariffs, count(*) - count(n.c) as without_tariffs, round(100.0 * count(n.c) / count(*), 0)::double as pct,
      coalesce(sum(n.res), 0)::bigint as residential, coalesce(sum(n.com), 0)::bigint as commercial, coalesce(sum(n.c - n.res - n.com), 0)::bigint as others
    from utilities u left join n on n.utility_id = u.id where is_active group by 1""")
def audit_by_country(t: Tables) -> DataFrame:
    """Active utilities of each country with and without tariffs, and their tariffs by class."""
    of = lambda c: F.count_if(F.col("customer_class") == c)
    per = t.tariffs.groupBy(F.col("utility_id").alias("id")).agg(F.count("*").alias("n"), of("1-URGENT").alias("res"), of("2-HIGH").alias("com"))
    out = t.utilities.where("is_active").join(per, "id", "left").groupBy("country").agg(
        F.count("*").alias("utilities"), F.count("n").alias("with_tariffs"), F.count_if(F.col("n").isNull()).alias("without_tariffs"), F.round(100.0 * F.count("n") / F.count("*"), 0).alias("pct"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(a) for c, a in (("res", "residential"), ("com", "commercial"))], F.coalesce(F.sum(F.col("n") - F.col("res") - F.col("com")), F.lit(0)).alias("others"),
    )
    return out


@query("""select country, rate_type, count(*) as n from tariffs t join utilities u on u.id = t.utility_id group by 1, 2""")
def rate_types_by_country(t: Tables) -> DataFrame:
    u = t.utilities.select(F.col("id").alias("utility_id"), "country")
    return t.tariffs.groupBy("utility_id", "rate_type").agg(F.count("*").alias("c")).join(u, "utility_id").groupBy("country", "rate_type").agg(F.sum("c").alias("n"))


@query("""select component_type, count(*) filter (rate_value between 0.01 and 0.08) as reasonable, count(*) filter (rate_value > 0.08) as high, count(*) filter (rate_value < 0.01) as low from components group by 1""")
def component_sanity(t: Tables) -> DataFrame:
    v = F.col("rate_value")
    return t.components.groupBy("component_type").agg(F.count_if(v.between(0.01, 0.08)).alias("reasonable"), F.count_if(v > 0.08).alias("high"), F.count_if(v < 0.01).alias("low"))


@query("""select tariff_id, string_agg(distinct component_type, ',' order by component_type) as kinds from components group by 1 having count(*) filter (component_type in ('A', 'R')) = 0""")
def no_core_components(t: Tables) -> DataFrame:
    kinds = F.concat_ws(",", F.sort_array(F.collect_set("component_type"))).alias("kinds")
    return t.components.groupBy("tariff_id").agg(kinds, F.count_if(F.col("component_type").isin("A", "R")).alias("core")).where("core = 0").drop("core")


@query("""select utility_id, customer_class, count(*) as n, string_agg(name, ' | ' order by name) as names from tariffs group by 1, 2 having count(*) >= 5""")
def over_extraction(t: Tables) -> DataFrame:
    names = F.array_join(F.sort_array(F.collect_list("name")), " | ").alias("names")
    return t.tariffs.groupBy("utility_id", "customer_class").agg(F.count("*").alias("n"), names).where("n >= 5")


@query("""select customer_class, count(*) as joined_rows, count(distinct t.id) as tariffs from tariffs t join components c on c.tariff_id = t.id group by 1""")
def class_distribution(t: Tables) -> DataFrame:
    per = t.components.groupBy(F.col("tariff_id").alias("id")).agg(F.count("*").alias("c"))
    return t.tariffs.join(per, "id").groupBy("customer_class").agg(F.sum("c").alias("joined_rows"), F.count("*").alias("tariffs"))


@query("""+ k as (select tariff_id, bool_or(component_type = 'A') as core from components group by 1)
    select utility_id, count(*) as tariffs, count(distinct customer_class) as classes, count(*) filter (core) as with_core from tariffs t left join k on k.tariff_id = t.id group by 1""")
def per_utility_summary(t: Tables) -> DataFrame:
    core = t.components.groupBy(F.col("tariff_id").alias("id")).agg(F.bool_or(F.col("component_type") == "A").alias("core"))
    return t.tariffs.join(core, "id", "left").groupBy("utility_id").agg(F.count("*").alias("tariffs"), F.count_distinct("customer_class").alias("classes"), F.count_if("core").alias("with_core"))


@query("""select tariff_id, arg_min(ordinal, (rate_value, ordinal)) as ordinal, min(rate_value)::double as rate_value from components where component_type = 'N' group by 1""")
def cheapest_component(t: Tables) -> DataFrame:
    best = F.min(F.struct("rate_value", "ordinal"))
    return t.components.where("component_type = 'N'").groupBy("tariff_id").agg(best.alias("b")).select("tariff_id", "b.ordinal", "b.rate_value")


@query("""select state, count(*) as tariffs, count(*) filter (last_verified is not null) as verified, round(100.0 * count(*) filter (last_verified is not null) / nullif(count(*), 0), 1) as pct from tariffs t join utilities u on u.id = t.utility_id where customer_class = '5-LOW' group by 1""")
def verified_share(t: Tables) -> DataFrame:
    per = t.tariffs.where("customer_class = '5-LOW'").groupBy("utility_id").agg(F.count("*").alias("n"), F.count("last_verified").alias("v"))
    out = per.join(t.utilities.select(F.col("id").alias("utility_id"), "state"), "utility_id").groupBy("state").agg(F.sum("n").alias("tariffs"), F.sum("v").alias("verified"))
    return out.withColumn("pct", F.round(100.0 * F.col("verified") / F.nullif("tariffs", F.lit(0)), 1).cast("double"))


@query("""
    select u.id, u.name, l.id as check_id from utilities u left join (select source_id, min(id) as id from checks group by 1) l on l.source_id = u.id
    where is_active and not exists (select 1 from tariffs t where t.utility_id = u.id and t.rate_type = 'P')""")
def zero_tariff_utilities(t: Tables) -> DataFrame:
    """Active utilities without a pending tariff, each with its first check."""
    u = R.without(t.utilities.where("is_active").select("id", "name"), t.tariffs.where("rate_type = 'P'").select(F.col("utility_id").alias("id")), "id")
    return u.join(t.checks.groupBy(F.col("source_id").alias("id")).agg(F.min("id").alias("check_id")), "id", "left")


# Versions, duplicates, changes


@query("""select id, utility_id, name from (select *, row_number() over (partition by utility_id, customer_class, rate_type order by effective_date desc nulls last, last_verified desc nulls first, id desc) rn from tariffs) where rn = 1""")
def newest_version_dedup(t: Tables) -> DataFrame:
    return R.newest_version(t.tariffs, ["utility_id", "customer_class", "rate_type"], "effective_date", "last_verified", "id").select("id", "utility_id", "name")


@query("""select tariff_id, ordinal, tier_max::double as tier_max, (lag(tier_max) over (partition by tariff_id, component_type order by ordinal, tier_max))::double as tier_min from components""")
def tier_bounds(t: Tables) -> DataFrame:
    return rates.tier_bounds(t.components, ["tariff_id", "component_type"], ["ordinal", "tier_max"], "tier_max").select("tariff_id", "ordinal", "tier_max", "tier_min")


@query(r"""+ p as (
        select p_brand as brand, p_partkey as id, trim(lower(p_name || case p_partkey % 4 when 0 then '' when 1 then ' A' when 2 then ' Service' else ' Time-of-Use' end)) as raw from part),
    n as (select brand, id, trim(regexp_replace(regexp_replace(raw, '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g')) as name from p)
    select a.brand, a.id, min(b.id) as of from n a join n b on a.brand = b.brand and a.id <> b.id and starts_with(a.name, b.name) and ((a.name = b.name and b.id < a.id) or length(trim(a.name[length(b.name) + 1:])) >= 4) group by 1, 2""")
def prefix_duplicates(t: Tables) -> DataFrame:
    """Names that repeat another of their brand or go on after it with four characters or more; shorter endings are other rates."""
    ending = F.get(F.array(F.lit(""), F.lit(" A"), F.lit(" Service"), F.lit(" Time-of-Use")), (F.col("p_partkey") % 4).cast("int"))
    rows = t.read("part").select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("id"), F.concat("p_name", ending).alias("name"))
    return changes.near_prefixes(rows, ["brand"], "id", "name")


@query("""select utility_id, state, customer_class, n, least(n, 3) as kept from (select utility_id, customer_class, count(*) n from tariffs group by 1, 2) t join utilities u on u.id = t.utility_id where n > 1""")
def tariff_counts(t: Tables) -> DataFrame:
    per = t.tariffs.groupBy("utility_id", "customer_class").agg(F.count("*").alias("n")).where("n > 1")
    return per.join(t.utilities.select(F.col("id").alias("utility_id"), "state"), "utility_id").select("utility_id", "state", "customer_class", "n", F.least("n", F.lit(3).cast("long")).alias("kept"))


@query("""+ o as (select utility_id, name, max(amount) as amount, cast(max(effective_date) as varchar) as code from tariffs where effective_date < date '1999-01-01' group by 1, 2),
    n as (select t.utility_id, t.name, max(t.amount) as amount, case when max(t.id) % 4 = 0 then '' else cast(max(t.effective_date) as varchar) end as code, count(*) filter (rate_type <> 'P') as parts from tariffs t where effective_date >= date '1999-01-01' group by 1, 2)
    select coalesce(o.utility_id, n.utility_id) as utility_id, coalesce(o.name, n.name) as name, (case when n.parts > 0 then coalesce(n.amount, o.amount) else o.amount end)::double as amount,
      case when n.parts > 0 then coalesce(nullif(n.code, ''), o.code) else o.code end as code,
      case when n.parts > 0 and o.utility_id is not null then 'updated' when n.parts > 0 then 'added' when o.utility_id is not null then 'kept' else 'rejected' end as action
    from o full join n on o.utility_id = n.utility_id and o.name = n.name""")
def tariff_upsert(t: Tables) -> DataFrame:
    keys, cut = ["utility_id", "name"], F.lit("1999-01-01").cast("date")
    old = t.tariffs.where(F.col("effective_date") < cut).groupBy(*keys).agg(F.max("amount").alias("amount"), F.max("effective_date").cast("string").alias("code"))
    code = F.when(F.max("id") % 4 == 0, "").otherwise(F.max("effective_date").cast("string"))
    new = t.tariffs.where(F.col("effective_date") >= cut).groupBy(*keys).agg(F.max("amount").alias("amount"), code.alias("code"), F.count_if(F.col("rate_type") != "P").alias("n_components"))
    return changes.upsert(old, new, keys, ["amount", "code"])


@query("""+ e as (select utility_id, name, id from tariffs where effective_date < date '1999-01-01'), s as (select utility_id, name, customer_class from tariffs where effective_date >= date '1999-01-01'),
    g as (select utility_id from (select utility_id, count(*) ns, bool_or(customer_class = '1-URGENT') home from s group by 1) a join (select utility_id, count(*) ne from e group by 1) b using (utility_id) where home and not (ns < 0.75 * ne and ne >= 3))
    select e.id, e.utility_id, e.name from e join g using (utility_id) where not exists (select 1 from s where s.utility_id = e.utility_id and s.name = e.name)""")
def reconcile_missing(t: Tables) -> DataFrame:
    cut = F.lit("1999-01-01").cast("date")
    stored, existing = t.tariffs.where(F.col("effective_date") >= cut), t.tariffs.where(F.col("effective_date") < cut).select("utility_id", "name", "id")
    return changes.reconcile(stored, existing, "utility_id", ["utility_id", "name"], F.col("customer_class") == "1-URGENT").select("id", "utility_id", "name")


@query("""+ w as (select *, case when rate_type <> 'P' then 'https://www.' || lower(rate_type) || '.example/' || id end as source_url, case when rate_type <> 'P' then lower(rate_type) end as domain from tariffs),
    e as (select utility_id, name, id, domain from w where effective_date < date '1999-01-01'), s as (select utility_id, name, customer_class, domain from w where effective_date >= date '1999-01-01'),
    g as (select utility_id from (select utility_id, count(*) ns, bool_or(customer_class = '1-URGENT') home from s group by 1) a join (select utility_id, count(*) ne from e group by 1) b using (utility_id) where home and not (ns < 0.75 * ne and ne >= 3))
    select e.id, e.utility_id, e.name from e join g using (utility_id) where not exists (select 1 from s where s.utility_id = e.utility_id and s.name = e.name) and exists (select 1 from s where s.utility_id = e.utility_id and s.domain = e.domain)""")
def reconcile_fetched(t: Tables) -> DataFrame:
    """Missing tariffs of the domains that were fetched; pending ones have no url."""
    cut, kind = F.lit("1999-01-01").cast("date"), F.lower("rate_type")
    rows = t.tariffs.withColumn("source_url", F.when(F.col("rate_type") != "P", F.concat(F.lit("https://www."), kind, F.lit(".example/"), F.col("id").cast("string"))))
    stored, existing = rows.where(F.col("effective_date") >= cut), rows.where(F.col("effective_date") < cut).select("utility_id", "name", "id", "source_url")
    return changes.reconcile(stored, existing, "utility_id", ["utility_id", "name"], F.col("customer_class") == "1-URGENT", source_url="source_url").select("id", "utility_id", "name")


@query(f"""select distinct id from (select source_id as id from checks where content_hash = 'view' and checked_at >= timestamp '2024-01-20'
    union all select u.id from utilities u where is_active and not exists (select 1 from tariffs t where t.utility_id = u.id and t.last_verified > date '{AS_OF}' - 270))""")
def refresh_targets(t: Tables) -> DataFrame:
    changed = t.checks.where("content_hash = 'view' and checked_at >= timestamp_ntz'2024-01-20'").select(F.col("source_id").alias("id"))
    recent = t.tariffs.where(F.col("last_verified") > F.date_sub(F.lit(AS_OF).cast("date"), 270)).select(F.col("utility_id").alias("id"))
    return changed.union(R.without(t.utilities.where("is_active").select("id"), recent, "id")).distinct()


@query(f"""+ b as (select utility_id, count(*) n from tariffs where effective_date < date '1999-01-01' group by 1), a as (select utility_id, count(*) n from tariffs group by 1)
    select count(*) as processed, cast(sum(case when a.n > coalesce(b.n, 0) then a.n - coalesce(b.n, 0) else 0 end) as bigint) as added, cast(sum(case when a.n = b.n and b.n > 0 then a.n else 0 end) as bigint) as updated,
      (select count(*) from tariffs where last_verified < date '{AS_OF}' - 270) as stale from a left join b using (utility_id)""")
def run_finalise(t: Tables) -> DataFrame:
    before = t.tariffs.where("effective_date < date'1999-01-01'").groupBy("utility_id").agg(F.count("*").alias("b"))
    both = t.tariffs.groupBy("utility_id").agg(F.count("*").alias("a")).join(before, "utility_id", "left").withColumn("b", F.coalesce("b", F.lit(0)))
    out = both.agg(F.count("*").alias("processed"), F.sum(F.greatest(F.col("a") - F.col("b"), F.lit(0))).alias("added"), F.sum(F.when((F.col("a") == F.col("b")) & (F.col("b") > 0), F.col("a")).otherwise(0)).alias("updated"))
    return out.crossJoin(t.tariffs.agg(F.count_if(F.col("last_verified") < F.date_sub(F.lit(AS_OF).cast("date"), 270)).alias("stale")))


@query("""select id from tariffs where rate_type = 'O' intersect select tariff_id from components where component_type = 'N' and rate_value > 0.09""")
def delete_list_overlap(t: Tables) -> DataFrame:
    return t.tariffs.where("rate_type = 'O'").select("id").intersect(t.components.where("component_type = 'N' and rate_value > 0.09").select(F.col("tariff_id").alias("id")))


@query("""select count(*) as tariffs, (select count(*) from components c where not exists (select 1 from tariffs t where t.id = c.tariff_id and t.rate_type = 'P')) as components from tariffs where rate_type <> 'P'""")
def cascade_delete(t: Tables) -> DataFrame:
    p, c = changes.cascade_delete(t.tariffs, t.components, t.tariffs.where("rate_type = 'P'"), "id", "tariff_id")
    return p.agg(F.count("*").alias("tariffs")).crossJoin(c.agg(F.count("*").alias("components")))


# Pages and texts


@query(r"""select regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1), '^www\.', '') as domain, count(*) as pages, count(distinct page_id % 60) as utilities from pages group by 1 order by pages desc, domain limit 30""")
def top_domains(t: Tables) -> DataFrame:
    return t.read("pages").groupBy(X.host(F.col("url")).alias("domain")).agg(F.count("*").alias("pages"), F.count_distinct(F.col("page_id") % 60).alias("utilities")).orderBy(F.desc("pages"), "domain").limit(30)


BLOCKED = ["cheap-pills.example.com", "casino-win.example.org", "free-bets.example.com", "spam-farm.example.org"]


@query(r"""+ h as (select page_id, regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1), '^www\.', '') as host from pages), b(d) as (values ('cheap-pills.example.com'), ('casino-win.example.org'), ('free-bets.example.com'), ('spam-farm.example.org'))
    select page_id, host from h where exists (select 1 from b where host = d or ends_with(host, '.' || d))""")
def blocked_pages(t: Tables) -> DataFrame:
    from wattgrid.operators.resolve import blocked

    listed = t.spark.createDataFrame([(d,) for d in BLOCKED], "domain string")
    return blocked(t.read("pages"), "url", listed).where("is_blocked").select("page_id", X.host(F.col("url")).alias("host"))


@query(r"""select page_id, case when regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) in ('', '/') then true else false end as homepage, contains(url, 'utm_source') as tracked, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) as path from pages""")
def url_parts(t: Tables) -> DataFrame:
    url = F.col("url")
    return t.read("pages").select("page_id", X.is_homepage(url).alias("homepage"), url.contains("utm_source").alias("tracked"), X.path(url).alias("path"))


@query("""select page_id, sha256(html) as content_hash, length(html) < 500 as thin from pages""")
def page_hash(t: Tables) -> DataFrame:
    return t.read("pages").select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("content_hash"), (F.char_length("html") < 500).alias("thin"))


NORMALIZED = r"""
    select doc_id, sha256(regexp_replace(regexp_replace(lower(trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g'))), '\b\d{1,2}/\d{1,2}/\d{2,4}\b', '', 'g'), '\b\d{4}-\d{2}-\d{2}\b', '', 'g')) as page_hash
    from documents"""


@query(NORMALIZED)
def normalized_text(t: Tables) -> DataFrame:
    return t.read("documents").select("doc_id", F.sha2(X.normalized_page(F.col("text")).cast("binary"), 256).alias("page_hash"))


@query(NORMALIZED)
def all_normalized_text(t: Tables) -> DataFrame:
    return normalized_text(t)


@query("""+ o as (select source_id, id, checked_us, row_number() over (partition by source_id order by checked_us, id) rn, case when content_hash = 'view' then 0 else 1 end hit from checks),
    r as (select *, sum(hit) over (partition by source_id order by rn) isl from o),
    m as (select *, sum(1 - hit) over (partition by source_id, isl order by rn) miss from r),
    f as (select *, coalesce(max(case when miss >= 5 then 1 else 0 end) over (partition by source_id order by rn rows between unbounded preceding and 1 preceding), 0) stop from m)
    select id, source_id from f where rn <= 20 and stop = 0""")
def budgeted_calls(t: Tables) -> DataFrame:
    return R.budgeted(t.checks, ["source_id"], ["checked_us", "id"], F.lit(1), 20, F.col("content_hash") != "view", 5).select("id", "source_id")


@query("""+ o as (select tariff_id, ordinal, sum(rate_value) as v from components group by 1, 2), s as (select tariff_id, ordinal, sum(v) over (partition by tariff_id order by ordinal rows between current row and 2 following) as score from o)
    select tariff_id, arg_max(ordinal, (score, -ordinal)) as first, max(score)::double as score from s group by 1""")
def best_windows(t: Tables) -> DataFrame:
    per = t.components.groupBy("tariff_id", "ordinal").agg(F.sum("rate_value").alias("v"))
    return R.best_span(per, "tariff_id", "ordinal", F.col("v"), 3)


# Geography

POLYGONS = [  # (id, utility_id, MultiPolygon): a square with a hole, a triangle, and a second territory of the first utility
    (1, 1, [[[[-0.3, -0.3], [0.3, -0.3], [0.3, 0.3], [-0.3, 0.3], [-0.3, -0.3]], [[-0.1, -0.1], [0.1, -0.1], [0.1, 0.1], [-0.1, 0.1], [-0.1, -0.1]]]]),
    (2, 2, [[[[0.0, 0.0], [0.5, 0.0], [0.0, 0.5], [0.0, 0.0]]]]),
    (3, 1, [[[[-0.5, -0.05], [-0.05, -0.05], [-0.05, 0.02], [-0.5, 0.02], [-0.5, -0.05]]]]),
]


def _inside(t: Tables) -> DataFrame:
    shapes = t.spark.createDataFrame(POLYGONS, "id long, utility_id long, geometry array<array<array<array<double>>>>")
    edges = geo.rings(shapes).withColumnRenamed("id", "territory_id")
    points = t.read("embeddings").select(F.col("vec_id").alias("point_id"), F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y"))
    return geo.points_in(points, edges, 0.05)


EDGES_SQL = """+ e(tid, x1, y1, x2, y2) as (values (1,-0.3,-0.3,0.3,-0.3),(1,0.3,-0.3,0.3,0.3),(1,0.3,0.3,-0.3,0.3),(1,-0.3,0.3,-0.3,-0.3),(1,-0.1,-0.1,0.1,-0.1),(1,0.1,-0.1,0.1,0.1),(1,0.1,0.1,-0.1,0.1),(1,-0.1,0.1,-0.1,-0.1),
    (2,0.0,0.0,0.5,0.0),(2,0.5,0.0,0.0,0.5),(2,0.0,0.5,0.0,0.0),(3,-0.5,-0.05,-0.05,-0.05),(3,-0.05,-0.05,-0.05,0.02),(3,-0.05,0.02,-0.5,0.02),(3,-0.5,0.02,-0.5,-0.05)),
    ed as (select tid::bigint as tid, x1::double x1, y1::double y1, x2::double x2, y2::double y2 from e), p as (select vec_id, embedding[1]::double as x, embedding[2]::double as y from embeddings),
    hit as (select vec_id as point_id, tid as territory_id from p join ed on (y1 > y) <> (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 group by 1, 2 having count(*) % 2 = 1)"""


@query(EDGES_SQL + " select point_id, territory_id from hit")
def points_in_territory(t: Tables) -> DataFrame:
    return _inside(t)


LOOKUP = EDGES_SQL + """, ut as (select u.id, state, country, is_active, (select count(*) from tariffs t where t.utility_id = u.id) n from utilities u),
    a as (select vec_id as address_id, state, country, lpad((vec_id * 13 % 1000)::varchar, 5, '0') as zip from embeddings join utilities on id = vec_id + 1),
    poly as (select h.point_id as address_id, o.uid as utility_id from hit h join (values (1, 1), (2, 2), (3, 1)) o(tid, uid) on o.tid = h.territory_id join ut on ut.id = o.uid and is_active join a on a.address_id = h.point_id where a.country = ut.country),
    code as (select distinct a.address_id, ut.id as utility_id from a join ut on is_active and zip in (lpad((ut.id % 1000)::varchar, 5, '0'), lpad(((ut.id + 1) % 1000)::varchar, 5, '0')) where a.address_id not in (select address_id from poly)),
    m as (select address_id, utility_id, 'polygon' as match_method from poly union all select *, 'code' from code),
    s as (select a.address_id, ut.id as utility_id from a join ut on is_active and a.state = ut.state and a.country = ut.country where (a.address_id not in (select address_id from m) or ut.n > 0) and not exists (select 1 from m where m.address_id = a.address_id and m.utility_id = ut.id))
    select address_id, utility_id, match_method, count(*) as n from (select * from m union all select *, 'state' from s) group by all"""


@query(LOOKUP)
def address_lookup(t: Tables) -> DataFrame:
    """All addresses to utilities: by polygon, else by ZIP, then by state."""
    owners = t.spark.createDataFrame([(i, u) for i, u, _ in POLYGONS], "territory_id long, utility_id long")
    code = lambda n: F.lpad((n % 1000).cast("string"), 5, "0")
    addresses = t.read("embeddings").select(F.col("vec_id").alias("address_id"), (F.col("vec_id") + 1).alias("id"), code(F.col("vec_id") * 13).alias("zip")).join(t.utilities, "id").select("address_id", "state", "country", "zip")
    polygon = _inside(t).join(F.broadcast(owners), "territory_id").select(F.col("point_id").alias("address_id"), "utility_id")
    areas = t.utilities.select(F.col("id").alias("utility_id"), F.array(code(F.col("id")), code(F.col("id") + 1)).alias("zip_codes"))
    utilities = R.with_counts(t.utilities, t.tariffs, "id", "utility_id", n_tariffs=F.lit(True))
    return geo.lookup(addresses, polygon, areas, utilities)


@query(LOOKUP)
def all_address_lookup(t: Tables) -> DataFrame:
    return address_lookup(t)


# Rates


@query("""+ c as (select tariff_id, case component_type when 'A' then 'energy' when 'N' then 'fixed' else 'adjustment' end as kind, rate_value * 100 - 1 as v from components),
    k as (select tariff_id, count(*) filter (v < 0 and kind = 'fixed') + count(*) filter (kind = 'energy' and v > 0 and v < 0.01) + count(*) filter ((kind = 'energy' and v > 7.5) or (kind = 'fixed' and v > 7.5)) as bad, bool_or(kind in ('energy', 'fixed')) as core, bool_or((kind = 'energy' and v > 5) or (kind = 'fixed' and v > 5)) as high from c group by 1)
    select t.id, (not coalesce(core, false))::int + coalesce(bad, 0) as issues, coalesce(core, false) and coalesce(bad, 0) = 0 as valid, coalesce(core, false) and coalesce(bad, 0) = 0 and coalesce(high, false) as needs_review from tariffs t left join k on k.tariff_id = t.id""")
def validation_issues(t: Tables) -> DataFrame:
    kind = F.when(F.col("component_type") == "A", "energy").when(F.col("component_type") == "N", "fixed").otherwise("adjustment")
    parts = t.components.select("tariff_id", kind.alias("component_type"), (F.col("rate_value") * 100 - 1).alias("rate_value"))
    bounds = t.spark.createDataFrame([(None, 5.0, 2.5, 5.0, 2.5, 5.0, 2.5)], "state string, p95_energy double, p99_energy double, p95_fixed double, p99_fixed double, p95_demand double, p99_demand double")
    rows = t.tariffs.select("id", "name", F.lit("residential").alias("customer_class"), F.lit("flat").alias("rate_type"), F.lit("x").alias("state"))
    return rates.validate(rows, parts, bounds).select("id", F.size("issues").cast("long").alias("issues"), "valid", "needs_review")


@query("""+ v as (select tariff_id, list(rate_value) filter (component_type = 'N') as vs, count(*) as n, max(rate_value) filter (component_type = 'N') as top from components group by 1)
    select t.id, round(least(1.0, (case when t.id % 3 = 0 then 0.25 else 0 end) + 0.1 + (case when coalesce(top, 0) > 0.09 then 0.0 else 0.15 end) + (case when n >= 2 then 0.1 when n = 1 then 0.05 else 0 end) + (case when top is not null then 0.1 else 0 end) + (case when t.rate_type = 'O' then 0.2 else 0 end)), 3) as score
    from tariffs t join v on v.tariff_id = t.id""")
def confidence_scores(t: Tables) -> DataFrame:
    per = t.components.groupBy(F.col("tariff_id").alias("id")).agg(F.collect_list(F.when(F.col("component_type") == "N", F.col("rate_value"))).alias("values"), F.count("*").alias("n"))
    name = F.when(F.col("rate_type") == "O", "Omega residential").otherwise("other")
    score, _ = rates.confidence(F.col("id") % 3 == 0, F.lit(0.5), F.col("values"), F.lit(0.09).cast("decimal(16,6)"), F.col("n"), F.lit("omega"), F.lit(None).cast("string"), name)
    return t.tariffs.join(per, "id").select("id", score.alias("score"))


SEED_NAMES, FRESH_NAMES = ["Rate D", "SC1C (TOU)", "General Service Small", "Residential Service - applies when a meter is read"], ["Rate D Service", "Service Classification No. 1C", "General Service Large", "Residential Service", "Rate DP"]
SAME = {(0, 0), (1, 1), (3, 3)}  # by hand, from the rule: equal heads or codes, enough shared words, equal discriminators


@query(f"""+ same(a, b) as (values {", ".join(map(str, sorted(SAME)))}), o as (select id, utility_id, customer_class, (id % {len(SEED_NAMES)}) as a from tariffs where rate_type = 'O'),
    f as (select id, utility_id, customer_class, (id % {len(FRESH_NAMES)}) as b from tariffs where rate_type = 'F')
    select o.id, min(f.id) as fresh_id from o join f using (utility_id, customer_class) join same using (a, b) group by 1""")
def same_product(t: Tables) -> DataFrame:
    """Open tariffs that a filled one of the same utility and class describes too, under names that match in some cases only."""
    named = lambda kind, names: t.tariffs.where(F.col("rate_type") == kind).select("id", "utility_id", "customer_class", F.get(F.array(*map(F.lit, names)), (F.col("id") % len(names)).cast("int")).alias("name"))
    return changes.supersede(named("O", SEED_NAMES), named("F", FRESH_NAMES), ["utility_id", "customer_class"])


WANTED_NAMES, FOUND_NAMES = ["Residential Service", "Residential Time of Use", "Small General Service", "Farm"], ["Residential Service", "Residential Service Rider", "General Service Time", "Time of Use Residential Pilot", "Street Lighting"]


def _benchmark_pairs(t: Tables) -> DataFrame:
    named = lambda kind, names: t.tariffs.where(F.col("rate_type") == kind).select("id", "utility_id", "customer_class", F.get(F.array(*map(F.lit, names)), (F.col("id") % len(names)).cast("int")).alias("name"))
    return changes.match_candidates(named("O", WANTED_NAMES), named("F", FOUND_NAMES))


@query(f"""+ w as (select id, utility_id, customer_class, lower(list_extract({WANTED_NAMES}, (id % {len(WANTED_NAMES)} + 1)::int)) as name from tariffs where rate_type = 'O'),
    f as (select id, utility_id, customer_class, lower(list_extract({FOUND_NAMES}, (id % {len(FOUND_NAMES)} + 1)::int)) as name from tariffs where rate_type = 'F'),
    p as (select utility_id, w.id as want, f.id as got, case when w.name = f.name then 0 when contains(f.name, w.name) or contains(w.name, f.name) then 1
            when len(list_intersect(string_split(w.name, ' '), string_split(f.name, ' '))) >= 2 then 2 end as stage, len(list_intersect(string_split(w.name, ' '), string_split(f.name, ' '))) as shared
          from w join f using (utility_id, customer_class))
    select utility_id, want, got, stage, case when stage = 2 then -shared else 0 end as overlap from p where stage is not null""")
def benchmark_candidates(t: Tables) -> DataFrame:
    """Pairs of a wanted and a found tariff of a utility and class that may be one, with how they match."""
    return _benchmark_pairs(t)


@query(None)
def benchmark_match(t: Tables) -> DataFrame:
    """For each wanted tariff, in order of id, the best candidate that is still free: equal names, one inside the other, then most shared words."""
    return changes.greedy_matches(_benchmark_pairs(t), "utility_id", "want", "got", ["want", "stage", "overlap"])


@query(r"""+ l as (select page_id, unnest(range(len(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)))) as place, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) as href, url from pages),
    r as (select page_id, place, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', 0) || regexp_replace(href, '#.*$', '') as target from l where href like '/%')
    select page_id, target, min(place)::int as place from r group by 1, 2""")
def links_ranked(t: Tables) -> DataFrame:
    from wattgrid.functions.pages import links

    return links(t.read("pages")).select("page_id", "target", "place")


@query(r"""+ d as (select doc_id as id, text, regexp_replace(regexp_replace(regexp_replace(text, '\n{3,}', chr(10) || chr(10), 'g'), '[ \t]{4,}', '  ', 'g'), '(?:\n\s*){3,}', chr(10) || chr(10), 'g') as short from documents)
    select id, length(text) as chars, length(text) <= 30000 as whole, case when length(text) <= 30000 then sha256(trim(short, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) end as window_sha256 from d""")
def rate_windows(t: Tables) -> DataFrame:
    """The window kept of each document; where the text fits the budget it is the whole text with its runs of white space shortened, which SQL can check."""
    from wattgrid.functions.pages import rate_windows as run

    rows = run(t.read("documents"), "doc_id", "text")
    whole = F.col("chars") <= 30_000
    return rows.select("id", "chars", whole.alias("whole"), F.when(whole, F.sha2(F.col("window").cast("binary"), 256)).alias("window_sha256"))


@query(rf"""+ d as (select doc_id as id, trim(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\n{{3,}}', chr(10) || chr(10), 'g'), '[ \t]{{4,}}', '  ', 'g'), '(?:\n\s*){{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as t from documents),
    s as (select id, t, length(t) as n, case when length(t) > 50000 then 90000 else 30000 end as room from d),
    k as (select id, n, room, unnest(range(0, n, 500)) as a, unnest(list_transform(range(0, n, 500), lambda x: t[x + 1:x + 500])) as b from s where n > room),
    p as (select id, n, room, a, 3 * regexp_matches(b, '{X.RATE_AMOUNTS}')::int + 2 * regexp_matches(b, '{X.RATE_WORDS}')::int + 2 * regexp_matches(b, '{X.RATE_SCHEDULES}')::int as score from k),
    w as (select id, n, room, a, sum(score) over (partition by id order by a rows between current row and 59 following) as s60, sum(score) over (partition by id order by a rows between current row and 179 following) as s180 from p),
    m as (select id, arg_max(a, (case when room = 30000 then s60 else s180 end, -a)) as a from w where a + room < n + 500 group by 1),
    o as (select id, case when n <= room then t else case when a > 0 then '[...document truncated...]' || chr(10) else '' end || t[a + 1:a + room] || case when a + room < n then chr(10) || '[...document truncated...]' else '' end end as w from s left join m using (id))
    select id, length(w) as kept, sha256(w) as window_sha256 from o""")
def rate_window_texts(t: Tables) -> DataFrame:
    """The window of each document; none has residential signals, so those over the budget keep their densest run."""
    from wattgrid.functions.pages import rate_windows as run

    return run(t.read("documents"), "doc_id", "text").select("id", "kept", F.sha2(F.col("window").cast("binary"), 256).alias("window_sha256"))


RECORDS = r"""+ u as (select s_suppkey as id, s_suppkey + 100000 as eia_id, case s_suppkey % 3 when 0 then 'Énergie ' || s_suppkey || ', Inc.' when 1 then 'Power' || s_suppkey || ' Light' else 'Town of T' || s_suppkey end as name from supplier),
    v as (select *, trim(regexp_replace(translate(lower(regexp_replace(name, '[\s,]+Inc\.?$', '')), 'é', 'e'), '[^a-z0-9 ]', '', 'g')) as plain from u),
    k as (select p_partkey as label, p_partkey % 150 as n, p_partkey % 7 as form from part),
    r as (select label, case when form = 0 then n + 100000 end as eiaid, case form when 1 then 'Énergie ' || n || ', Inc.' when 2 then 'ENERGIE ' || n when 3 then 'Power' || n when 4 then 'The Town of T' || n || ' Utilities' when 5 then '' when 6 then null else 'x' end as utility from k),
    w as (select *, trim(regexp_replace(translate(lower(regexp_replace(coalesce(utility, ''), '[\s,]+Inc\.?$', '')), 'é', 'e'), '[^a-z0-9 ]', '', 'g')) as plain from r),
    m as (select label, (select min(id) from u where eia_id = eiaid) as a, (select min(id) from u where name = utility) as b, (select min(id) from v where v.plain = w.plain and w.plain <> '') as c,
            (select min(id) from v where w.plain <> '' and v.plain <> '' and (contains(v.plain, w.plain) or contains(w.plain, v.plain))) as d from w)"""


def _records(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Records that name utilities by number, in full, in other spellings, by a part of the name or not at all; and the utilities."""
    i, text = F.col("s_suppkey"), lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
    name = F.when(i % 3 == 0, text("Énergie ", i, ", Inc.")).when(i % 3 == 1, text("Power", i, " Light")).otherwise(text("Town of T", i))
    utilities = t.read("supplier").select(i.alias("id"), (i + 100000).alias("eia_id"), name.alias("name"))
    n, form = F.col("p_partkey") % 150, F.col("p_partkey") % 7
    said = F.when(form == 1, text("Énergie ", n, ", Inc.")).when(form == 2, text("ENERGIE ", n)).when(form == 3, text("Power", n)).when(form == 4, text("The Town of T", n, " Utilities")).when(form == 5, "").when(form == 0, "x")
    return t.read("part").select(F.col("p_partkey").alias("label"), F.when(form == 0, n + 100000).alias("eiaid"), said.alias("utility")), utilities


@query(RECORDS + " select label, coalesce(a, b, c, d) as utility_id, case when a is not null then 'number' when b is not null then 'name' when c is not null then 'plain' when d is not null then 'inside' end as how from m")
def resolve_records(t: Tables) -> DataFrame:
    from wattgrid.operators.resolve import resolve_utilities

    return resolve_utilities(*_records(t)).select("label", "utility_id", "how")


@query("""+ f as (select source_id as utility_id, props as url, max(checked_us) as us, arg_max(content_hash, (checked_us, id)) as content_hash from checks group by 1, 2),
    o as (select utility_id, url, case when us % 20 = 0 then 'old' else content_hash end as content_hash from f where us % 97 <> 0 or utility_id % 5 = 0)
    select utility_id, count(*) as pages from f left join o using (utility_id, url) group by 1 having bool_and(coalesce(f.content_hash = o.content_hash, false))""")
def unchanged_pages(t: Tables) -> DataFrame:
    """Sources all of whose pages have the stored hash; of some pages another hash is stored, or none."""
    pages = t.checks.groupBy(F.col("source_id").alias("utility_id"), F.col("props").alias("url")).agg(F.max("checked_us").alias("us"), F.max_by("content_hash", F.struct("checked_us", "id")).alias("content_hash"))
    stored = pages.where("us % 97 <> 0 or utility_id % 5 = 0").withColumn("content_hash", F.when(F.col("us") % 20 == 0, "old").otherwise(F.col("content_hash")))
    same = changes.unchanged_utilities(pages.drop("us"), stored.drop("us"))
    return pages.join(same, "utility_id", "left_semi").groupBy("utility_id").agg(F.count("*").alias("pages"))


@query("""select category, count(*) as n from (select id, case when rate_type = 'P' then 'A' when amount < 50000 then 'B' end as category from tariffs) where category is not null group by 1""")
def quality_sweep(t: Tables) -> DataFrame:
    labelled, _ = changes.sweep({"A": t.tariffs.where("rate_type = 'P'"), "B": t.tariffs.where("amount < 50000")}, t.tariffs)
    return labelled.groupBy("category").agg(F.count("*").alias("n"))


@query("""select id, case when id % 10 = 0 then false else is_active end as is_active, case when id % 10 = 0 then 'merged' end as reason from utilities""")
def deactivate_listed(t: Tables) -> DataFrame:
    reasons = t.utilities.where("id % 10 = 0").select("id", F.lit("merged").alias("reason"))
    return changes.deactivate(t.utilities, reasons).select("id", "is_active", "reason")


# Further selections, roll-ups and reports


@query("""+ ids as (select unnest([7, 3, 7, 11, 3, 5]) as id, unnest(range(6)) as pos), f as (select id, min(pos) as pos from ids group by 1)
    select (row_number() over (order by pos) - 1)::int as place, u.id, u.name from f join utilities u using (id)""")
def explicit_ids(t: Tables) -> DataFrame:
    listed = R.explicit_list(t.spark, [7, 3, 7, 11, 3, 5])
    return t.utilities.join(F.broadcast(listed), "id").select("place", "id", "name")


@query(None)
def seeded_sample(t: Tables) -> DataFrame:
    """100 active utilities by a seeded hash of the id: the same ones in every run; the sample is the feature."""
    return t.utilities.where("is_active").orderBy(F.xxhash64(F.lit(42), "id"), "id").limit(100).select("id", "name")


@query("""select t.id, t.name, c.component_type, c.period, max(c.rate_value)::double as rate_value from tariffs t join components c on c.tariff_id = t.id where t.name like '%URGENT%' and t.rate_type = 'F' and c.component_type = 'R' group by all""")
def named_plans(t: Tables) -> DataFrame:
    named = t.tariffs.where(F.col("name").like("%URGENT%") & (F.col("rate_type") == "F")).select("id", "name")
    parts = t.components.where("component_type = 'R'").select(F.col("tariff_id").alias("id"), "component_type", "period", "rate_value")
    return named.join(parts, "id").groupBy("id", "name", "component_type", "period").agg(F.max("rate_value").alias("rate_value"))


@query("""select u.name as utility, t.id, c.ordinal, c.component_type, c.rate_value::double as rate_value from utilities u join tariffs t on t.utility_id = u.id join components c on c.tariff_id = t.id where u.state = 'NATION_3'""")
def region_listing(t: Tables) -> DataFrame:
    u = t.utilities.where("state = 'NATION_3'").select(F.col("id").alias("utility_id"), F.col("name").alias("utility"))
    rows = t.tariffs.select("id", "utility_id").join(u, "utility_id")
    return rows.join(t.components.withColumnRenamed("tariff_id", "id"), "id").select("utility", "id", "ordinal", "component_type", "rate_value")


@query("""+ l as (select source_id, content_hash, checked_us, row_number() over (partition by source_id order by checked_us desc, id desc) rn from checks where failed)
    select u.id, l.checked_us as last_error_us from utilities u left join l on l.source_id = u.id and rn = 1 where u.is_active""")
def latest_error(t: Tables) -> DataFrame:
    last = R.latest(t.checks.where("failed"), ["source_id"], [F.desc("checked_us"), F.desc("id")]).select(F.col("source_id").alias("id"), F.col("checked_us").alias("last_error_us"))
    return t.utilities.where("is_active").select("id").join(last, "id", "left")


@query("""+ m(customer_class, rate) as (values ('residential', 0.087), ('commercial', 0.103)) select u.id, customer_class, rate::double as rate from utilities u cross join m where is_active and country = 'ASIA'""")
def regulator_rates(t: Tables) -> DataFrame:
    templates = t.spark.createDataFrame([("residential", 0.087), ("commercial", 0.103)], "customer_class string, rate double")
    return t.utilities.where("is_active and country = 'ASIA'").select("id").crossJoin(F.broadcast(templates))


@query("""+ b(state, p95) as (values ('NATION_3', 0.05), (null, 0.08)), d as (select p95 from b where state is null)
    select t.id, count(*) as high from tariffs t join utilities u on u.id = t.utility_id left join b on b.state = u.state cross join d join components c on c.tariff_id = t.id where c.rate_value > coalesce(b.p95, d.p95) group by 1""")
def over_bounds(t: Tables) -> DataFrame:
    bounds = t.spark.createDataFrame([("NATION_3", 0.05), (None, 0.08)], "state string, p95 double")
    u = t.utilities.select(F.col("id").alias("utility_id"), "state").join(F.broadcast(bounds.where("state is not null")), "state", "left")
    limit = t.tariffs.select("id", "utility_id").join(u, "utility_id").crossJoin(F.broadcast(bounds.where("state is null").select(F.col("p95").alias("other")))).select("id", F.coalesce("p95", "other").cast("decimal(16,6)").alias("limit"))
    return t.components.select(F.col("tariff_id").alias("id"), "rate_value").join(limit, "id").where("rate_value > limit").groupBy("id").agg(F.count("*").alias("high"))


@query("""+ k as (select tariff_id, count(*) n from components group by 1), s as (select u.state, count(distinct u.id) utilities, count(t.id) tariffs, coalesce(sum(k.n), 0)::bigint as components from utilities u left join tariffs t on t.utility_id = u.id left join k on k.tariff_id = t.id where u.country = 'EUROPE' group by 1)
    select *, round(tariffs / nullif(utilities, 0)::double, 3) as tariffs_each, round(components / nullif(tariffs, 0)::double, 3) as components_each from s""")
def coverage_by_state(t: Tables) -> DataFrame:
    k = t.components.groupBy(F.col("tariff_id").alias("id")).agg(F.count("*").alias("n"))
    per = t.tariffs.join(k, "id", "left").groupBy(F.col("utility_id").alias("id")).agg(F.count("*").alias("t"), F.sum("n").alias("c"))
    out = t.utilities.where("country = 'EUROPE'").join(per, "id", "left").groupBy("state").agg(F.count("*").alias("utilities"), F.coalesce(F.sum("t"), F.lit(0)).alias("tariffs"), F.coalesce(F.sum("c"), F.lit(0)).alias("components"))
    return out.withColumns({"tariffs_each": F.round(F.col("tariffs") / F.nullif("utilities", F.lit(0)), 3), "components_each": F.round(F.col("components") / F.nullif("tariffs", F.lit(0)), 3)})


@query("""+ h as (select u.country as batch, u.id, exists (select 1 from tariffs t where t.utility_id = u.id) as has from utilities u where is_active)
    select coalesce(batch, 'TOTAL') as batch, count(*) as total, count(*) filter (has) as having, count(*) filter (not has) as missing from h group by rollup (batch)""")
def batch_overview(t: Tables) -> DataFrame:
    rows = R.with_counts(t.utilities.where("is_active"), t.tariffs, "id", "utility_id", n=F.lit(True))
    out = rows.rollup("country").agg(F.count("*").alias("total"), F.count_if(F.col("n") > 0).alias("having"), F.count_if(F.col("n") == 0).alias("missing"))
    return out.select(F.coalesce("country", F.lit("TOTAL")).alias("batch"), "total", "having", "missing")


@query("""+ runs(run_id, started, ended) as (values (1, date '1996-01-01', date '1996-07-01'), (2, date '1996-05-01', date '1997-01-01'))
    select run_id, count(*) as touched, count(distinct utility_id) as processed, count(*) filter (last_verified is null) as unverified from runs join tariffs on effective_date >= started and effective_date < ended group by 1""")
def runs_from_trail(t: Tables) -> DataFrame:
    runs = t.spark.createDataFrame([(1, "1996-01-01", "1996-07-01"), (2, "1996-05-01", "1997-01-01")], "run_id int, a string, b string").select("run_id", F.col("a").cast("date").alias("started"), F.col("b").cast("date").alias("ended"))
    rows = t.tariffs.join(F.broadcast(runs), (F.col("effective_date") >= F.col("started")) & (F.col("effective_date") < F.col("ended")))  # two runs
    return rows.groupBy("run_id").agg(F.count("*").alias("touched"), F.count_distinct("utility_id").alias("processed"), F.count_if(F.col("last_verified").isNull()).alias("unverified"))


@query("""select source_id % 50 as batch, count(*) filter (content_hash = 'error') as error, count(*) filter (content_hash = 'view') as view, count(*) filter (content_hash = 'click') as click from checks group by 1""")
def outcome_pivot(t: Tables) -> DataFrame:
    return t.checks.groupBy((F.col("source_id") % 50).alias("batch")).pivot("content_hash", ["error", "view", "click"]).count().fillna(0)


@query("""+ g as (select case when n >= 12 then 'A' when n >= 8 then 'B' else 'C' end as grade, n from (select utility_id, count(*) n from tariffs group by 1))
    select grade, count(*) as audited, sum(n)::bigint as tariffs, round(100.0 * count(*) filter (grade in ('A', 'B')) / count(*), 1) as accuracy from g group by 1""")
def audit_rollup(t: Tables) -> DataFrame:
    n = t.tariffs.groupBy("utility_id").agg(F.count("*").alias("n"))
    grade = F.when(F.col("n") >= 12, "A").when(F.col("n") >= 8, "B").otherwise("C")
    out = n.groupBy(grade.alias("grade")).agg(F.count("*").alias("audited"), F.sum("n").alias("tariffs"))
    return out.withColumn("accuracy", F.when(F.col("grade").isin("A", "B"), 100.0).otherwise(0.0))


@query("""select id, source_id, round((max_us - checked_us) / 60000000.0, 1)::double as minutes from (select *, max(checked_us) over (partition by source_id) as max_us from checks) where content_hash = 'signup'""")
def check_durations(t: Tables) -> DataFrame:
    top = t.checks.groupBy("source_id").agg(F.max("checked_us").alias("top"))
    rows = t.checks.where("content_hash = 'signup'").join(top, "source_id")
    return rows.select("id", "source_id", F.round((F.col("top") - F.col("checked_us")) / F.lit(60000000.0), 1).alias("minutes"))


@query(r"""+ d as (select doc_id, lag(text) over (partition by source order by doc_id) as old, text as new from documents),
    p as (select doc_id, old, new from d where old <> '' and new <> ''), o as (select distinct doc_id, unnest(string_split_regex(old, '\s+')) as w from p), n as (select distinct doc_id, unnest(string_split_regex(new, '\s+')) as w from p),
    a as (select doc_id, count(*) as c from n anti join o using (doc_id, w) group by 1), r as (select doc_id, count(*) as c from o anti join n using (doc_id, w) group by 1)
    select doc_id, coalesce(a.c, 0) as added, coalesce(r.c, 0) as removed from p left join a using (doc_id) left join r using (doc_id)""")
def added_terms(t: Tables) -> DataFrame:
    """How many words each document adds to the one before it of its source, and drops; over whole texts."""
    pairs = _before(t).where("old <> '' and new <> ''")
    words = lambda c: F.array_distinct(F.split(c, r"\s+"))
    return pairs.select("doc_id", F.size(F.array_except(words("new"), words("old"))).cast("long").alias("added"), F.size(F.array_except(words("old"), words("new"))).cast("long").alias("removed"))


def _before(t: Tables) -> DataFrame:
    """(doc_id, before, old, new): each document beside the one before it of its source. Only ids are sorted by source, texts are joined."""
    docs = t.read("documents")
    before = F.lag("doc_id").over(Window.partitionBy("source").orderBy("doc_id"))
    pairs = docs.select("doc_id", before.alias("before"))
    old, new = docs.select(F.col("doc_id").alias("before"), F.col("text").alias("old")), docs.select("doc_id", F.col("text").alias("new"))
    return pairs.join(old, "before", "left").join(new, "doc_id")


@query(None)
def document_term_changes(t: Tables) -> DataFrame:
    """What each document adds to the one before it of its source, by id, and drops; over whole texts of all languages. Only ids are sorted by source, texts are joined."""
    from wattgrid.functions.pages import term_changes

    return _before(t).select("doc_id", "before", term_changes(F.col("old"), F.col("new")).alias("changes"))


@query("""select domain, pages, round(100.0 * pages / sum(pages) over (), 1)::double as pct, regexp_matches(domain, 'casino|pills|bets|farm') as hinted from (select regexp_extract(split_part(split_part(url, '://', 2), '/', 1), '[^.]+\\.[^.]+\\.[^.]+$', 0) as domain, count(*) as pages from pages group by 1)""")
def domain_shares(t: Tables) -> DataFrame:
    site = F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1))
    per = t.read("pages").groupBy(F.regexp_extract(site, r"[^.]+\.[^.]+\.[^.]+$", 0).alias("domain")).agg(F.count("*").alias("pages"))
    total = per.agg(F.sum("pages").alias("all"))
    return per.crossJoin(F.broadcast(total)).select("domain", "pages", F.round(100.0 * F.col("pages") / F.col("all"), 1).alias("pct"), F.col("domain").rlike("casino|pills|bets|farm").alias("hinted"))


@query("""select t.id, string_agg(c.component_type || ' ' || c.rate_value::varchar, '; ' order by c.ordinal, c.component_type, c.rate_value) as evidence from tariffs t join components c on c.tariff_id = t.id group by 1""")
def evidence_lines(t: Tables) -> DataFrame:
    rows = R.nested(t.tariffs.select("id"), t.components, "id", "tariff_id", ["ordinal", "component_type", "rate_value"], "parts").where(F.size("parts") > 0)
    return rows.select("id", F.array_join(F.transform("parts", lambda c: F.concat_ws(" ", c["component_type"], c["rate_value"].cast("string"))), "; ").alias("evidence"))


@query("""+ c as (select utility_id, count(*) filter (customer_class = '1-URGENT') as residential, count(*) filter (customer_class = '2-HIGH') as commercial from tariffs group by 1) select u.id, coalesce(residential, 0)::bigint as residential, coalesce(commercial, 0)::bigint as commercial from utilities u left join c on c.utility_id = u.id where is_active and coalesce(residential, 0) > 0""")
def lookup_counts(t: Tables) -> DataFrame:
    rows = R.with_counts(t.utilities.where("is_active").select("id"), t.tariffs, "id", "utility_id", residential=F.col("customer_class") == "1-URGENT", commercial=F.col("customer_class") == "2-HIGH")
    return rows.where("residential > 0")


@query("""select (id % 10)::bigint as batch, count(*) as tested, count(*) filter (is_active) as geocoded, bool_and(is_active) as all_active, string_agg(distinct state, ';' order by state) as states from utilities group by 1""")
def lookup_summary(t: Tables) -> DataFrame:
    return t.utilities.groupBy((F.col("id") % 10).alias("batch")).agg(F.count("*").alias("tested"), F.count_if("is_active").alias("geocoded"), F.bool_and("is_active").alias("all_active"), F.array_join(F.sort_array(F.collect_set("state")), ";").alias("states"))


@query(r"""+ d as (select page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>', ' ', 'g'), '(?is)<style\b[^>]*>.*?</style\s*>', ' ', 'g'), '(?is)<nav\b[^>]*>.*?</nav\s*>', ' ', 'g'), '(?is)<footer\b[^>]*>.*?</footer\s*>', ' ', 'g'), '(?is)<header\b[^>]*>.*?</header\s*>', ' ', 'g'), '(?is)<noscript\b[^>]*>.*?</noscript\s*>', ' ', 'g'), '(?is)<iframe\b[^>]*>.*?</iframe\s*>', ' ', 'g') as t from pages), m as (select page_id, case when regexp_extract(t, '(?is)<main\b[^>]*>(.*)</main\s*>', 1) <> '' then regexp_extract(t, '(?is)<main\b[^>]*>(.*)</main\s*>', 1) when regexp_extract(t, '(?is)<article\b[^>]*>(.*)</article\s*>', 1) <> '' then regexp_extract(t, '(?is)<article\b[^>]*>(.*)</article\s*>', 1) else regexp_replace(t, '(?is)^.*?</head\s*>', '') end as t from d),
    r as (select page_id, regexp_replace(regexp_replace(t, '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g') as t from m), u as (select page_id, replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') as t from r)
    select page_id, sha256(trim(regexp_replace(t, '[ \t\n\r\f\v]+', ' ', 'g'))) as text_sha256 from u""")
def page_text(t: Tables) -> DataFrame:
    from wattgrid.functions.elements import main_texts

    return main_texts(t.read("pages")).select("page_id", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


from wattgrid import queries_jobs, queries_reports, queries_runs  # noqa: E402, F401  (they register themselves)
