"""Registered queries of monitoring lists, reports, page jobs, matches and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattgrid.functions import elements as E
from wattgrid.functions import lists as L
from wattgrid.functions import pages as P
from wattgrid.functions import text as X
from wattgrid.operators import changes, rates, resolve
from wattgrid.operators import relational as R
from wattgrid.plans.adaptors import Tables
from wattgrid.queries_jobs import pick, sql_list, text
from wattgrid.registry import query
from wattgrid.streaming import checks as M

# Monitoring

SOURCES = """+ k as (select source_id, arg_max(content_hash, (checked_us, id)) as last, max(case when content_hash = 'view' then checked_us end) as changed_us, max(checked_us) as checked_us from checks group by 1),
    s as (select u.id, u.name, u.state, u.country, case last when 'error' then 'ERROR' when 'view' then 'CHANGED' when 'signup' then 'PENDING' else 'UNCHANGED' end as status, case when u.id % 4 = 0 then null else changed_us end as changed_us from k join utilities u on u.id = k.source_id)"""


def _sources(t: Tables) -> DataFrame:
    """Monitoring sources: utilities that were checked, with the status of the last check; some have no known change."""
    per = t.checks.groupBy(F.col("source_id").alias("id")).agg(F.max_by("content_hash", F.struct("checked_us", "id")).alias("last"), F.max(F.when(F.col("content_hash") == "view", F.col("checked_us"))).alias("changed_us"))
    status = F.when(F.col("last") == "error", "ERROR").when(F.col("last") == "view", "CHANGED").when(F.col("last") == "signup", "PENDING").otherwise("UNCHANGED")
    rows = t.utilities.select("id", "name", "state", "country", "is_active").join(per, "id")
    return rows.select("id", "name", "state", "country", "is_active", status.alias("status"), F.when(F.col("id") % 4 != 0, F.col("changed_us")).alias("changed_us"))


@query(SOURCES + " select row_number() over (order by changed_us desc nulls first, id) as place, id, name, status, changed_us from s where status <> 'ERROR' order by changed_us desc nulls first, id limit 60 offset 3")
def monitoring_sources(t: Tables) -> DataFrame:
    """A page of the sources that are not in error, unknown changes first, then the newest."""
    rows = R.browse(_sources(t), [F.col("status") != "ERROR"], [F.col("changed_us").desc_nulls_first(), F.col("id")], 3, 60)
    place = F.row_number().over(Window.orderBy(F.col("changed_us").desc_nulls_first(), "id"))  # a page of rows
    return rows.select((place + 3).cast("long").alias("place"), "id", "name", "status", "changed_us")


@query("""+ s as (select *, last_value(case when not failed then content_hash end ignore nulls) over (partition by source_id order by checked_us, id rows between unbounded preceding and 1 preceding) as before from checks)
    select id, source_id, checked_us from s where source_id between 10 and 30 and not failed and before is not null and before <> content_hash order by checked_us desc, id limit 50""")
def monitoring_logs(t: Tables) -> DataFrame:
    """The newest log rows of some sources whose check found a change that is to be reviewed."""
    rows = M.detect_changes(t.checks, "source_id", "checked_us", "id", "content_hash", "failed")
    filters = [F.col("source_id").between(10, 30), F.col("changed"), F.col("review") == "pending"]
    return R.browse(rows, filters, [F.desc("checked_us"), F.col("id")], 0, 50).select("id", "source_id", "checked_us")


@query("""+ s as (select *, last_value(case when not failed then content_hash end ignore nulls) over (partition by source_id order by checked_us, id rows between unbounded preceding and 1 preceding) as before from checks)
    select (select count(*) from utilities where is_active) as sources, count(distinct source_id) as checked, (select count(*) from utilities where is_active and id not in (select source_id from checks)) as unchecked,
      count(*) filter (not failed and before <> content_hash) as changed, count(*) filter (failed) as errors, count(*) filter (failed or before <> content_hash) as pending_reviews from s where source_id in (select id from utilities where is_active)""")
def monitoring_totals(t: Tables) -> DataFrame:
    """Sources, those ever checked and not, changes, errors, and reviews that are due."""
    active = t.utilities.where("is_active").select(F.col("id").alias("source_id"))
    logs = M.detect_changes(t.checks.join(active, "source_id", "left_semi"), "source_id", "checked_us", "id", "content_hash", "failed")
    out = logs.agg(F.count_distinct("source_id").alias("checked"), F.count_if("changed").alias("changed"), F.count_if(F.col("outcome") == "error").alias("errors"), F.count_if(F.col("review") == "pending").alias("pending_reviews"))
    unchecked = R.without(active, t.checks.select("source_id"), "source_id").agg(F.count("*").alias("unchecked"))
    return out.crossJoin(unchecked).crossJoin(active.agg(F.count("*").alias("sources")))


@query(SOURCES + """, w as (select u.*, u.id in (select id from s where status not in ('ERROR', 'PENDING')) as url, exists (select 1 from tariffs t where t.utility_id = u.id) as tariff from utilities u where is_active)
    select country, coalesce(state, 'ALL') as state, count(*) as total, count(*) filter (url) as with_url, count(*) filter (tariff) as with_tariff, round(100.0 * count(*) filter (url) / count(*), 1)::double as url_pct, round(100.0 * count(*) filter (tariff) / count(*), 1)::double as tariff_pct
    from w group by grouping sets ((country, state), (country))""")
def source_coverage(t: Tables) -> DataFrame:
    """Active utilities with a working source and with tariffs, by state and by country."""
    working = _sources(t).where("status not in ('ERROR', 'PENDING')").select("id").withColumn("url", F.lit(True))
    rows = R.with_counts(t.utilities.where("is_active").join(working, "id", "left"), t.tariffs, "id", "utility_id", n=F.lit(True))
    out = rows.rollup("country", "state").agg(F.count("*").alias("total"), F.count("url").alias("with_url"), F.count_if(F.col("n") > 0).alias("with_tariff")).where("country is not null")
    share = lambda c: F.round(100.0 * F.col(c) / F.col("total"), 1).cast("double")
    return out.select("country", F.coalesce("state", F.lit("ALL")).alias("state"), "total", "with_url", "with_tariff", share("with_url").alias("url_pct"), share("with_tariff").alias("tariff_pct"))


CATEGORIES = ["403_forbidden", "404_not_found", "5xx_server_error", "timeout", "ssl_certificate", "dns_failed", "connection_error", "empty_content", "auth_required", "redirect_error", "other"]
FAILED = f"""+ l as (select source_id, id as log_id, props, row_number() over (partition by source_id, props order by checked_us desc, id desc) as rn from checks where failed),
    e as (select u.id as utility_id, u.country, u.state, 'd' || l.source_id % 17 || '.example' as domain, case when log_id % 29 = 0 then 'placeholder_url' else list_extract({sql_list(CATEGORIES)}, (log_id % 11 + 1)::int) end as category
          from l join utilities u on u.id = l.source_id where rn = 1 and is_active)"""


def _errors(t: Tables) -> DataFrame:
    from wattgrid.queries import MESSAGES

    last = R.latest(t.checks.where("failed"), ["source_id", "props"], [F.desc("checked_us"), F.desc("id")])
    url = F.when(F.col("id") % 29 == 0, text("http://d", F.col("source_id") % 17, ".example/placeholder")).otherwise(text("http://d", F.col("source_id") % 17, ".example/"))
    rows = last.select(F.col("source_id").alias("utility_id"), pick(MESSAGES, F.col("id")).alias("message"), url.alias("url"))
    u = t.utilities.where("is_active").select(F.col("id").alias("utility_id"), "country", "state")
    return rows.join(u, "utility_id").select("utility_id", "country", "state", X.host(F.col("url")).alias("domain"), X.error_category(F.col("message"), F.col("url")).alias("category"))


@query(FAILED + """, d as (select category, domain, count(*) as n, row_number() over (partition by category order by count(*) desc, domain) as place from e group by 1, 2), c as (select category, country, count(*) as n from e group by 1, 2)
    select category, count(*) as sources, count(distinct utility_id) as utilities, (select string_agg(domain, ',' order by place) from d where d.category = e.category and place <= 5) as top_domains, (select string_agg(country || ':' || n, ',' order by country) from c where c.category = e.category) as by_country
    from e group by category""")
def error_category_details(t: Tables) -> DataFrame:
    """For each kind of error: pages, utilities, the five commonest domains, and counts by country."""
    rows = _errors(t)
    top = R.latest(rows.groupBy("category", "domain").agg(F.count("*").alias("n")), ["category"], [F.desc("n"), F.col("domain")], 5)
    top = top.groupBy("category").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "domain"))).alias("d"))
    country = rows.groupBy("category", "country").agg(F.count("*").alias("n")).groupBy("category").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("country", "n")))).alias("m"))
    out = rows.groupBy("category").agg(F.count("*").alias("sources"), F.count_distinct("utility_id").alias("utilities")).join(top, "category").join(country, "category")
    pairs = F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))
    return out.select("category", "sources", "utilities", F.array_join(F.transform("d", lambda x: x["domain"]), ",").alias("top_domains"), F.array_join(pairs, ",").alias("by_country"))


@query(FAILED + " select coalesce(country, 'TOTAL') as country, state, count(*) as errors, count(distinct utility_id) as utilities from e group by grouping sets ((country, state), ())")
def errors_by_state(t: Tables) -> DataFrame:
    """Pages in error and utilities affected, by state and in all."""
    out = _errors(t).groupingSets([["country", "state"], []], "country", "state").agg(F.count("*").alias("errors"), F.count_distinct("utility_id").alias("utilities"))
    return out.select(F.coalesce("country", F.lit("TOTAL")).alias("country"), "state", "errors", "utilities")


@query("""select date_trunc('day', checked_at)::date::varchar as run, min(checked_us) as started, round((max(checked_us) - min(checked_us)) / 60000000.0, 1)::double as duration_minutes, count(distinct source_id) as processed, count(*) filter (failed) as errors,
    row_number() over (order by min(checked_us) desc) as place from checks group by 1 order by started desc limit 20""")
def run_list(t: Tables) -> DataFrame:
    """The newest 20 runs with their length in minutes."""
    runs = t.checks.groupBy(F.to_date("checked_at").cast("string").alias("run")).agg(F.min("checked_us").alias("started"), F.max("checked_us").alias("finished"), F.count_distinct("source_id").alias("processed"), F.count_if("failed").alias("errors"))
    page = R.browse(runs, [], [F.desc("started")], 0, 20)
    minutes = F.round((F.col("finished") - F.col("started")) / F.lit(60000000.0), 1)
    return page.select("run", "started", minutes.alias("duration_minutes"), "processed", "errors", F.row_number().over(Window.orderBy(F.desc("started"))).cast("long").alias("place"))  # 20 rows


@query("""+ r as (select source_id as run_id, min(checked_at) as started_at, case when source_id % 3 = 0 then null else max(checked_at) end as finished_at from checks group by 1)
    select run_id, case when finished_at is null and started_at < timestamp '2024-01-01 09:00:00' - interval 6 hour then true else false end as stalled, case when finished_at is null and started_at < timestamp '2024-01-01 03:00:00' then '2024-01-01 09:00:00' else strftime(finished_at, '%Y-%m-%d %H:%M:%S') end as finished from r""")
def stalled_runs(t: Tables) -> DataFrame:
    """Runs without an end that began over six hours ago get one; doing it again changes nothing."""
    at = F.col("checked_at").cast("timestamp")
    runs = t.checks.groupBy(F.col("source_id").alias("run_id")).agg(F.min(at).alias("started_at"), F.max(at).alias("last"))
    runs = runs.select("run_id", "started_at", F.when(F.col("run_id") % 3 != 0, F.col("last")).alias("finished_at"))
    out = M.finish_stalled(runs, "2024-01-01 09:00:00")
    return out.select("run_id", "stalled", F.date_format("finished_at", "yyyy-MM-dd HH:mm:ss").alias("finished"))


@query("""+ r as (select source_id as run_id, count(*) as reported, count(*) filter (failed) as errors from checks group by 1), g as (select id as run_id, case when id % 3 = 0 then 60 + id % 20 else 1000 end::bigint as targeted from utilities)
    select run_id, targeted, reported, errors, reported >= targeted as complete from g join r using (run_id)""")
def run_completion(t: Tables) -> DataFrame:
    """Runs with all their results in, and those that still wait."""
    runs = t.utilities.select(F.col("id").alias("run_id"), F.when(F.col("id") % 3 == 0, 60 + F.col("id") % 20).otherwise(1000).cast("long").alias("targeted"))
    return M.run_completion(runs, t.checks.select(F.col("source_id").alias("run_id"), "failed"))


# Reports


@query("""+ i as (select l_orderkey % 300 as utility_id, case when l_quantity > 40 then 'high' when l_quantity > 20 then 'medium' else 'low' end as severity, l_returnflag || l_linestatus as type from lineitem where l_discount > 0.07),
    g as (select utility_id, count(*) as n, case when count(*) < 35 then 'A' when count(*) < 50 then 'B' when count(*) < 60 then 'C' else 'D' end as grade from i group by 1)
    select 'grade' as what, grade as name, count(*) as n, null as pct from g group by 2 union all select 'severity', severity, count(*), null from i group by 2 union all select 'type', type, count(*), null from i group by 2
    union all select 'perfect', 'A', count(*) filter (grade = 'A'), round(100.0 * count(*) filter (grade = 'A') / count(*), 1)::double from g
    union all select 'attention', utility_id || ' ' || grade, n, null from g where grade in ('C', 'D', 'F')""")
def audit_summary(t: Tables) -> DataFrame:
    """Audits rolled up: grades, issues by severity and type, the share without fault, and the utilities that need attention."""
    severity = F.when(F.col("l_quantity") > 40, "high").when(F.col("l_quantity") > 20, "medium").otherwise("low")
    issues = t.read("lineitem").where("l_discount > 0.07").select((F.col("l_orderkey") % 300).alias("utility_id"), severity.alias("severity"), F.concat("l_returnflag", "l_linestatus").alias("type"))
    n = F.size("issues")
    grade = F.when(n < 35, "A").when(n < 50, "B").when(n < 60, "C").otherwise("D")
    audits = issues.groupBy("utility_id").agg(F.collect_list(F.struct("severity", "type")).alias("issues")).withColumn("grade", grade)
    return R.audit_summary(audits)


@query("""+ a as (select id, country, id % 7 <> 0 as geocoded from utilities), m as (select a.*, (id % 5 > 0 and geocoded) as found, (select count(*) from tariffs t where t.utility_id = a.id) as n from a)
    select coalesce(country, 'TOTAL') as region, count(*) as tested, count(*) filter (geocoded) as geocoded, count(*) filter (found) as with_utilities, count(*) filter (found and n > 0) as with_tariffs from m group by rollup (country)""")
def lookup_totals(t: Tables) -> DataFrame:
    """Addresses tested, located, and with utilities and tariffs, by region and in all."""
    rows = R.with_counts(t.utilities.select("id", "country"), t.tariffs, "id", "utility_id", n=F.lit(True))
    located = F.col("id") % 7 != 0
    found = located & (F.col("id") % 5 > 0)
    out = rows.rollup("country").agg(F.count("*").alias("tested"), F.count_if(located).alias("geocoded"), F.count_if(found).alias("with_utilities"), F.count_if(found & (F.col("n") > 0)).alias("with_tariffs"))
    return out.select(F.coalesce("country", F.lit("TOTAL")).alias("region"), "tested", "geocoded", "with_utilities", "with_tariffs")


@query("""+ r as (select utility_id, count(*) filter (rate_type <> 'P') as valid, count(*) filter (rate_type = 'P') as errors from tariffs group by 1)
    select u.country as batch, count(*) as processed, count(*) filter (errors = 0) as success, count(*) filter (errors > 0) as failed, coalesce(sum(valid) filter (errors = 0), 0)::bigint as tariffs from r join utilities u on u.id = r.utility_id group by 1""")
def batch_results(t: Tables) -> DataFrame:
    """Results of a batch run: utilities that went well and not, and the tariffs of the former."""
    per = t.tariffs.groupBy(F.col("utility_id").alias("id")).agg(F.count_if(F.col("rate_type") != "P").alias("valid"), F.count_if(F.col("rate_type") == "P").alias("errors"))
    rows = per.join(t.utilities.select("id", "country"), "id")
    good = F.col("errors") == 0
    return rows.groupBy(F.col("country").alias("batch")).agg(F.count("*").alias("processed"), F.count_if(good).alias("success"), F.count_if(~good).alias("failed"), F.coalesce(F.sum(F.when(good, F.col("valid"))), F.lit(0)).alias("tariffs"))


@query("""+ s as (select source_id, count(distinct props) as n from checks group by 1)
    select u.id, u.name, u.state, (select count(*) from tariffs t where t.utility_id = u.id) as tariffs, coalesce(s.n, 0) as sources from utilities u left join s on s.source_id = u.id where is_active and utility_type = 'FURNITURE'""")
def retail_marketers(t: Tables) -> DataFrame:
    """Active utilities of one type with their tariffs and sources."""
    rows = R.with_counts(t.utilities.where("is_active and utility_type = 'FURNITURE'").select("id", "name", "state"), t.tariffs, "id", "utility_id", tariffs=F.lit(True))
    return R.with_counts(rows, t.checks.select("source_id", "props").distinct(), "id", "source_id", sources=F.lit(True))


@query("""select tariff_id, row_number() over (partition by tariff_id order by period, ordinal, tier_max nulls last, rate_value) as place, period, ordinal, tier_max::double as tier_max, rate_value::double as rate_value from components where component_type = 'N'""")
def energy_listing(t: Tables) -> DataFrame:
    """The energy rates of each tariff in order of season, period and tier."""
    place = F.row_number().over(Window.partitionBy("tariff_id").orderBy("period", "ordinal", F.col("tier_max").asc_nulls_last(), "rate_value"))
    return t.components.where("component_type = 'N'").select("tariff_id", place.cast("long").alias("place"), "period", "ordinal", "tier_max", "rate_value")


@query("""+ c as (select tariff_id, case component_type when 'A' then 'energy' when 'N' then 'fixed' else 'adjustment' end as kind, (rate_value * 5)::double as v from components), s as (select t.id, t.name, t.rate_type, t.customer_class, u.state from tariffs t join utilities u on u.id = t.utility_id),
    b as (select id, s.name, customer_class, case state when 'NATION_1' then 0.40 when 'NATION_2' then 0.35 else 0.60 end as p99, case state when 'NATION_1' then 0.25 when 'NATION_2' then 0.20 else 0.35 end as p95 from s),
    k as (select b.id, count(*) filter (kind = 'energy' and v > 0 and v < 0.01) + count(*) filter (kind = 'energy' and v > p99 * 3) as bad, bool_or(kind in ('energy', 'fixed')) as core, bool_or((kind = 'energy' and v > p95) or (kind = 'fixed' and v > 50)) as high from b join c on c.tariff_id = b.id group by 1),
    r as (select b.id, b.customer_class, coalesce(bad, 0) + (not coalesce(core, false))::int = 0 as valid, coalesce(high, false) as high from b left join k using (id))
    select count(*) as total, count(*) filter (valid) as valid, count(*) filter (not valid) as invalid, count(*) filter (valid and high) as flagged, coalesce(bool_or(valid and customer_class in ('1-URGENT', '2-HIGH')), false) as has_residential, coalesce(bool_or(valid and customer_class not in ('1-URGENT', '2-HIGH')), false) as has_commercial from r""")
def validation_totals(t: Tables) -> DataFrame:
    """The validation report of all tariffs under the bounds of their state, of which some states have their own."""
    kind = F.when(F.col("component_type") == "A", "energy").when(F.col("component_type") == "N", "fixed").otherwise("adjustment")
    state = F.when(F.col("state") == "NATION_1", "FL").when(F.col("state") == "NATION_2", "LA").otherwise("ZZ")
    u = t.utilities.select(F.col("id").alias("utility_id"), state.alias("state"))
    home = F.when(F.col("customer_class").isin("1-URGENT", "2-HIGH"), "residential").otherwise("commercial")
    rows = t.tariffs.join(u, "utility_id").select("id", "name", home.alias("customer_class"), F.lit("flat").alias("rate_type"), "state")
    parts = t.components.select("tariff_id", kind.alias("component_type"), (F.col("rate_value") * 5).cast("double").alias("rate_value"))
    return rates.validation_report(rates.validate(rows, parts, rates.state_bounds(t.spark)))


# Matches


@query("""+ w as (select l_orderkey as id, l_returnflag as kind, l_linenumber as no, l_extendedprice::double as v from lineitem), a as (select id, kind, min(v) as want from w group by 1, 2), b as (select id, kind, max(v) as got from w group by 1, 2)
    select id, kind, want, got, case when kind = 'R' then abs(want - got) <= 5 else abs(want - got) <= 0.15 * abs(want) end as close from a join b using (id, kind)""")
def close_components(t: Tables) -> DataFrame:
    """The least and the largest price of a tariff and type as a wanted and a found component: one pair each, close or not."""
    per = t.read("lineitem").groupBy(F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("kind")).agg(F.min("l_extendedprice").cast("double").alias("want"), F.max("l_extendedprice").cast("double").alias("got"))
    kind = F.when(F.col("kind") == "R", "fixed").otherwise("energy")
    pairs = per.select("id", "kind", kind.alias("component_type"), F.lit(0).alias("want_no"), F.lit(0).alias("got_no"), "want", "got")
    return changes.nearest_components(pairs, ["id", "kind"]).select("id", "kind", "want", "got", "close")


@query(None)
def nearest_components(t: Tables) -> DataFrame:
    """For each tariff the discounts of its lines as wanted and its taxes as found components, paired greedily by type and nearness."""
    line = t.read("lineitem")
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice"))
    rows = line.select(F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("component_type"), place.alias("no"), F.col("l_discount").cast("double").alias("want"), F.col("l_tax").cast("double").alias("got"))
    sides = rows.groupBy("id", "component_type").agg(F.collect_list(F.struct(F.col("no").alias("want_no"), "want")).alias("wants"), F.collect_list(F.struct(F.col("no").alias("got_no"), "got")).alias("gots"))
    pairs = sides.where("id is not null and component_type is not null").select("id", "component_type", F.inline("wants"), "gots").select("id", "component_type", "want_no", "want", F.inline("gots"))
    return changes.nearest_components(pairs, ["id", "component_type"]).select("id", "component_type", "want_no", "got_no", "want", "got", "close")


@query("""+ e as (select utility_id, id from tariffs where rate_type = 'O'), x as (select utility_id, id from tariffs where rate_type = 'F'), m as (select utility_id, id as want from e where id % 3 <> 0), c as (select t.utility_id, c.rate_value > 0.01 as close from components c join tariffs t on t.id = c.tariff_id where t.rate_type = 'O'),
    p as (select e.utility_id, count(*) as expected, (select count(*) from x where x.utility_id = e.utility_id) as extracted, (select count(*) from m where m.utility_id = e.utility_id) as matched, (select count(*) from c where c.utility_id = e.utility_id and not close) as errors from e group by 1)
    select round(100.0 * sum(matched) / sum(expected), 1)::double as recall, round(100.0 * sum(matched) / sum(extracted), 1)::double as precision, sum(errors)::bigint as rate_errors, count(*) filter (matched = expected and errors = 0) as perfect from p""")
def benchmark_totals(t: Tables) -> DataFrame:
    """Recall, precision, wrong rates and utilities without fault, over all utilities."""
    expected, extracted = (t.tariffs.where(F.col("rate_type") == k).select("utility_id", "id") for k in "OF")
    matches = expected.where("id % 3 <> 0").select("utility_id", F.col("id").alias("want"), F.col("id").alias("got"))
    parts = t.components.join(t.tariffs.where("rate_type = 'O'").select(F.col("id").alias("tariff_id"), "utility_id"), "tariff_id").select("utility_id", (F.col("rate_value") > 0.01).alias("close"))
    return changes.benchmark_summary(expected, extracted, matches, parts)


# Pages and urls

TITLE = r"(?is)<title[^>]*>(.*?)</title"
SCORED_PATHS = ["/residential/rates", "/docket/rate.pdf", "/blog/electric-pricing", "/al/rates", "/", "/archive/tariff", "/business/new-york/rates", "/rate-comparison"]
SCORED_TEXTS = ["Acme River rates electric", "Acme tariff", "residential pricing", "River Acme historic rate"]


@query(f"""+ w as (select page_id, page_id % 60 as utility_id, row_number() over (partition by page_id % 60 order by page_id) as position, (page_id % {len(SCORED_PATHS)})::int as k, (page_id // 3 % {len(SCORED_TEXTS)})::int as d, page_id % 7 as h from pages),
    p(k, path, pts, wrong, dead) as (values (0, '/residential/rates', 15 + 10, 0, false), (1, '/docket/rate.pdf', 15 - 15 - 30, 0, false), (2, '/blog/electric-pricing', 15 + 15 - 30, 0, false), (3, '/al/rates', 15, -40, false), (4, '/', -30, 0, false),
        (5, '/archive/tariff', 3 - 50, 0, false), (6, '/business/new-york/rates', 15 + 5, 0, false), (7, '/rate-comparison', 15, 0, true)),
    q(d, pts) as (values (0, 3 + 3 + 25), (1, 15 - 5), (2, 3 + 3 - 10), (3, 3 + 25 - 50)),
    s as (select page_id, utility_id, position, case when dead or h = 6 then -999 else p.pts + wrong + q.pts + case when d = 3 and k = 5 then 50 else 0 end + case when h < 3 then 50 else 0 end end as score from w join p using (k) join q using (d))
    select page_id, score, case when score > -999 then row_number() over (partition by utility_id, score > -999 order by score desc, position) end as place from s""")
def url_scores(t: Tables) -> DataFrame:
    """Search results scored for a utility by domain, path, words, state and age, blocked or not, and their order; the expected points were added up by hand."""
    i = F.col("page_id")
    rows = t.read("pages").select("page_id", (i % 60).alias("utility_id"), F.row_number().over(Window.partitionBy(i % 60).orderBy("page_id")).alias("position"))
    site = F.when(i % 7 < 3, "http://www.acme.com").when(i % 7 == 6, "https://sub.findenergy.com").otherwise("http://other.net")
    results = rows.select("page_id", "utility_id", "position", F.concat(site, pick(SCORED_PATHS, i)).alias("url"), F.lit("").alias("title"), pick(SCORED_TEXTS, F.floor(i / 3)).alias("description"))
    listed = t.spark.createDataFrame([(d,) for d in L.THIRD_PARTY_DOMAINS], "domain string")
    states = {code: name for name, code in L.US_STATES.items() if code != "DC"}
    judged = resolve.blocked(results, "url", listed).withColumns({"domain": F.lit("acme.com"), "utility": F.lit("Acme River Electric Company"), "state": F.lit("NY")})
    ranked = resolve.ranked_results(judged, states).select("page_id", F.col("place").cast("long"))
    return resolve.score_results(judged, states).select("page_id", "score").join(ranked, "page_id", "left")


URL_PATHS = ["/understanding-your-bill", "/dockets/12", "/cancelled%20tariff/x", "/news-release/rates", "/rate_case_filing", "/archives", "/newsroom/", "/superseded", "/residential-rates", "/comprendre-facture", "/historic-rates", "/class/relay"]
URL_KINDS = ["explainer", "filing", "superseded", "explainer", "filing", "superseded", "explainer", "superseded", "", "explainer", "superseded", ""]


@query(f"select page_id, list_extract({sql_list(URL_KINDS)}, (page_id % {len(URL_KINDS)} + 1)::int) as kinds from pages")
def url_classes(t: Tables) -> DataFrame:
    """Urls of explainers, filings and superseded tariffs; the expected kinds were set down by hand."""
    url = F.concat(F.lit("http://a.example"), pick(URL_PATHS, F.col("page_id")))
    kinds = F.concat_ws("+", F.when(X.is_explainer(url), "explainer"), F.when(X.is_filing(url), "filing"), F.when(X.is_superseded(url), "superseded"))
    return t.read("pages").select("page_id", kinds.alias("kinds"))


STATE_URLS = ["http://a.com/al/rates", "http://ny.a.com/x", "http://a.com/relay/class", "http://tx.gov/rates", "http://a.com/new-jersey/rates", "http://a.com/new-jersey/new-york/x", "http://www.la.power.com/", "http://a.com/TX/"]


@query(f"""select page_id, case when page_id % 3 = 2 then false else list_extract([true, page_id % 3 = 1, false, true, true, page_id % 3 = 1, true, true], (page_id // 3 % {len(STATE_URLS)} + 1)::int) end as wrong from pages""")
def wrong_states(t: Tables) -> DataFrame:
    """Urls that name another state than the utility's, given by code or name or not known."""
    states = {code: name for name, code in L.US_STATES.items() if code != "DC"}
    i = F.col("page_id")
    return t.read("pages").select("page_id", resolve.wrong_state(pick(STATE_URLS, F.floor(i / 3)), pick(["NY", "Ohio", "Ontario"], i), states).alias("wrong"))


@query(f"""+ w as (select page_id, url, html, length(html) < 900 as short, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1) as title, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) as host from pages),
    g as (select *, case when host = 'spam-farm.example.org' or ends_with(host, '.spam-farm.example.org') then 'blocked' when length(trim(html)) < 1500 then 'thin' when regexp_matches(url || ' ' || title, '(?i)/de/|ment') then 'irrelevant'
        when not (regexp_matches(html, '(?i)erbl.*the') or regexp_matches(title, '(?i)que') or regexp_matches(url, '(?i)que')) then 'no signal' else 'sent' end as gate from w)
    select page_id, gate, case when gate = 'sent' then row_number() over (partition by gate, host order by length(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '[^/]', '', 'g')) desc, page_id) end as place from g""")
def page_gate(t: Tables) -> DataFrame:
    """Why a page is not sent on, and the order of those that are: deepest paths first; the words are ones that these pages hold."""
    from wattgrid.queries import BLOCKED

    listed = t.spark.createDataFrame([(d,) for d in BLOCKED[3:]], "domain string")
    rows = resolve.blocked(t.read("pages"), "url", listed)
    gate = P.gate(F.col("url"), F.col("html"), F.col("is_blocked"), F.regexp_extract("html", TITLE, 1), thin=1500, skip="(?i)/de/|ment", content="(?i)erbl.*the", titles="(?i)que")
    rows = rows.select("page_id", "url", gate.alias("gate"), F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1).alias("host"))
    sent = P.deepest_first(rows.where("gate = 'sent'"), ["host"], "url", "page_id").select("page_id", F.col("place").cast("long"))
    return rows.select("page_id", "gate").join(sent, "page_id", "left")


@query(r"""+ w as (select page_id, page_id % 25 as utility_id, page_id as rank, regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1), '^www\.', '') as host, string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/') as parts from pages),
    s as (select *, array_to_string(parts[2:3], '/') as section from w),
    f as (select *, row_number() over (partition by utility_id, host order by rank) = 1 as h, row_number() over (partition by utility_id, host, section order by rank) = 1 as s from s)
    select page_id, row_number() over (partition by utility_id order by h desc, s desc, rank) as place from f""")
def unseen_hosts(t: Tables) -> DataFrame:
    """The order in which a utility's pages are tried: hosts not seen yet, then sections not seen yet, then as found."""
    rows = t.read("pages").select("page_id", "url", (F.col("page_id") % 25).alias("utility_id"), F.col("page_id").alias("rank"))
    return resolve.alternate_order(rows).select("page_id", F.col("place").cast("long"))


@query(r"""+ l as (select page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) as href, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) as label, generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1), 1) as place, url, html from pages),
    r as (select page_id, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', 0) || regexp_replace(href, '#.*$', '') as target, place, trim(label) as label, url, html from l where href like '/%'),
    g as (select page_id, target, min(place) as place, arg_min(label, place) as label from r group by 1, 2), b as (select *, lower(target || ' ' || label) as both_ from g)
    select page_id, target, case when contains(both_, 'rate') and contains(both_, 'electricity') then 0 when contains(both_, 'rate') and (contains(both_, 'residential') or contains(both_, 'commercial')) then 1 when contains(both_, 'rate') then 2 else 3 end as priority
    from b where not regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/?$') and regexp_matches(both_, 'the|que|ung') and not regexp_matches(both_, 'tion') and not regexp_matches(target || ' ' || label, '(?i)natural.gas|careers|job|login|storm|safety|rebate|outage')""")
def relevant_links(t: Tables) -> DataFrame:
    """Links worth a visit with their priority; the words for rates are ones that these pages hold."""
    pages = t.read("pages")
    return P.relevant_links(P.links(pages), pages, rate_pages="(?i)the|que|ung", skip="(?i)tion", titles="^no title$").select("page_id", "target", "priority")


@query(r"""+ l as (select page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) as href, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) as label, generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1), 1) as place, url from pages),
    r as (select page_id, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', 0) || regexp_replace(href, '#.*$', '') as target, place, label from l where href like '/%'), g as (select page_id, target, min(place) as place from r group by 1, 2),
    v as (select *, (place % 2)::int + 1 as level, contains(target, 'e') as old from g), o as (select *, row_number() over (partition by page_id, level order by old, place, target) as n from v)
    select page_id, level, target from o where n <= case level when 1 then 3 else 2 end""")
def capped_links(t: Tables) -> DataFrame:
    """The first links of each page and level: superseded ones last, so many a level."""
    found = P.links(t.read("pages"))
    rows = found.select("page_id", "target", ((F.col("place") + 1) % 2 + 1).cast("int").alias("level"), "place", F.col("target").contains("e").alias("old"))
    return R.capped(rows, ["page_id"], [F.col("old"), F.col("place"), F.col("target")], {1: 3, 2: 2}).select("page_id", "level", "target")


@query(r"""+ w as (select doc_id, source, coalesce(text, '') || list_extract(['', ' per month', ' energy charge $ 4', ' Rate no. 12 $0.11 per kWh', ''], (doc_id % 5 + 1)::int) as text from documents),
    p as (select doc_id, source, case when regexp_matches(text, '(?i)rate\s*#|rate\s*no\.?\s*\d|basic\s*customer\s*charge|energy\s*charge.*\$|per\s+k[wW]h.*\$|\$.*per\s+k[wW]h|minimum\s+(monthly\s+)?bill|service\s*charge.*\d+\.\d{2}|domestic\s+service|general\s+service\s+\d|residential\s+service|commercial\s+service') then 0
        when regexp_matches(text, '\$\s*\d+\.?\d*|\d+\.\d+\s*(?:cents|¢)') and regexp_matches(text, '(?i)kwh|per month|energy charge|customer charge|basic charge|demand charge|cents per|kilowatt|service charge|monthly charge|minimum bill') then 1
        when regexp_matches(text, '(?i)kwh|per month|energy charge|customer charge|basic charge|demand charge|cents per|kilowatt|service charge|monthly charge|minimum bill') then 2 else 3 end as priority from w),
    m as (select source, case when count(*) filter (priority = 0) >= 3 then 0 when count(*) filter (priority <= 1) > 0 then 1 when count(*) filter (priority <= 2) > 0 then 2 else 3 end as most from p group by 1)
    select doc_id, priority::bigint as priority from p join m using (source) where priority <= most""")
def page_priorities(t: Tables) -> DataFrame:
    """The pages of each source that are read, by their priority, over texts with rate words added to some."""
    docs = t.read("documents")
    words = pick(["", " per month", " energy charge $ 4", " Rate no. 12 $0.11 per kWh", ""], F.col("doc_id"))
    rows = docs.select("doc_id", "source", F.concat(F.coalesce("text", F.lit("")), words).alias("text"))
    kept = P.kept_pages(rows, ["source"], "text")
    return kept.select("doc_id", F.col("priority").cast("long"))


@query(r"""select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ') as squeezed from documents where text is not null""")
def compressed_text(t: Tables) -> DataFrame:
    """Texts without runs of blanks and empty lines."""
    return t.read("documents").where("text is not null").select("doc_id", X.compressed(F.col("text")).alias("squeezed"))


@query(r"""+ w as (select doc_id, text || case doc_id % 4 when 0 then ' $0.0956' when 1 then ' 9.5 cents per kWh' when 2 then ' summer rate' else '' end as text, length(text) >= 8000 as long from documents where text is not null),
    k as (select *, len(regexp_extract_all(text, '(?i)tier|step|block|on.peak|off.peak|shoulder|summer|winter|seasonal|schedule\s+[a-z]|rate\s+[a-z]')) >= 5 and length(text) >= 8000 as complex from w)
    select doc_id, regexp_matches(text, '(?i)\$\s*\d+\.\d{2,4}|\d+\.\d+\s*(?:cents|¢)|\d+\.\d+\s*/\s*kwh|\d+\.\d+\s*/\s*kw\b|\$\d+\s*/\s*month') as numbers, complex, case when doc_id % 10 = 0 or complex then 'B' else 'A' end as tier,
      case when doc_id % 3 = 0 then 'done' when regexp_matches(text, '(?i)\$\s*\d+\.\d{2,4}|\d+\.\d+\s*(?:cents|¢)|\d+\.\d+\s*/\s*kwh|\d+\.\d+\s*/\s*kw\b|\$\d+\s*/\s*month') then 'C' else 'none' end as next from k""")
def extraction_tiers(t: Tables) -> DataFrame:
    """Which texts hold amounts, which are complex, where they are sent first and where after a try that found nothing."""
    words = pick([" $0.0956", " 9.5 cents per kWh", " summer rate", ""], F.col("doc_id"))
    rows = t.read("documents").where("text is not null").select("doc_id", F.concat("text", words).alias("text"))
    found = F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0)
    c = F.col("text")
    return rows.select("doc_id", P.has_numbers(c).alias("numbers"), P.is_complex(c).alias("complex"), P.request_tier(c, F.col("doc_id") % 10 == 0).alias("tier"), P.request_tier(c, F.lit(False), found).alias("next"))


DATED = ["Effective Nov 1, 2025", "effective: 2024-05-31", "Rates effective January 15, 2023 apply", "600 (Summer) 1,000 (Winter)", "8.7¢", "$1,200", "0.1234 per kWh", "none"]


@query(f"""select p_partkey as id, list_extract(['2025-11-01', '2024-05-31', '2023-01-15', null, null, null, null, null], (p_partkey % {len(DATED)} + 1)::int) as effective, list_extract([null, null, null, null, 0.087, null, 0.1234, null]::double[], (p_partkey % {len(DATED)} + 1)::int) as dollars,
    list_extract([1, 2024, 15, 600, 8, 1200, 0, 600], (p_partkey % {len(DATED)} + 1)::int) as summer, list_extract([2025, 5, 2023, 1000, 7, 1200, 1234, 1000], (p_partkey % {len(DATED)} + 1)::int) as winter from part""")
def dates_and_dollars(t: Tables) -> DataFrame:
    """Effective dates, dollars and thresholds in texts of several forms; the expected values were set down by hand."""
    c = F.col("c")
    rows = t.read("part").select(F.col("p_partkey").alias("id"), pick(DATED, F.col("p_partkey")).alias("c"))
    small = F.when(c.rlike("[¢$]|kWh|none"), P.dollars(c))
    return rows.select("id", P.effective_date(c).cast("string").alias("effective"), small.alias("dollars"), P.thresholds(c)["summer"].alias("summer"), P.thresholds(c)["winter"].alias("winter"))


@query("""+ d as (select doc_id, doc_id % 4 as k, (doc_id % 90 + 10) / 10.0 as a from documents),
    s(k, kind, name, labels) as (values (0, 'tou', 'Time-of-Use (TOU)', ['Off-Peak', 'Mid-Peak', 'On-Peak']), (1, 'tiered', 'Tiered', ['Lower Tier', 'Higher Tier']), (2, 'tou', 'Ultra-Low Overnight (ULO)', ['Ultra-Low Overnight', 'Weekend Off-Peak', 'Mid-Peak', 'On-Peak'])),
    r as (select doc_id, kind, name, a, unnest(labels) as label, generate_subscripts(labels, 1) as pos from d join s using (k)), c(customer_class, said) as (values ('residential', 'Residential'), ('commercial', 'Small Business'))
    select doc_id as id, customer_class, kind as rate_type, name || ' — ' || said as name, label, round((a + pos - 1) / 100, 5)::double as rate_value from r cross join c""")
def regulator_tariffs(t: Tables) -> DataFrame:
    """Tariffs of two classes from the rate sets in texts, whose prices stand after a heading."""
    a = F.format_string("%.1f", (F.col("doc_id") % 90 + 10) / 10)
    price = lambda k: F.format_string("%.1f", (F.col("doc_id") % 90 + 10) / 10 + k)
    listed = lambda n: F.concat_ws("\n", a, *[price(k) for k in range(1, n)])
    forms = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("Time-of-Use (TOU) prices: "), listed(3))).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("Tiered rates in cents: "), listed(2)))
    forms = forms.when(F.col("doc_id") % 4 == 2, F.concat(F.lit("ultra-low overnight "), listed(4))).otherwise("Time-of-Use without prices")
    rows = t.read("documents").select("doc_id", F.concat_ws("\n", F.lit("Plans."), forms).alias("text"))
    return P.tariff_templates(rows, "doc_id", "text")


@query("""select page_id, 0 as table_no, k as row_no, case k when 3 then 'note' else 'tier ' || k end as tier, case when k < 3 then (page_id % 50 + k) || ' cents' end as price from pages, range(4) r(k) where page_id % 3 <> 2""")
def page_tables(t: Tables) -> DataFrame:
    """Rows of the tables of pages, keyed by the header; short rows have the first keys only."""
    i = F.col("page_id")
    row = lambda k: text(f"<tr><td>tier {k}</td><td class='p'>", i % 50 + k, " <b>cents</b></td></tr>")
    table = text("<TABLE border=1><tr><th>Tier</th><th>Price</th></tr>", row(0), row(1), row(2), "<tr><td>note</td></tr></TABLE>")
    rows = t.read("pages").select("page_id", F.concat(F.coalesce("html", F.lit("")), F.when(i % 3 == 2, "").otherwise(table)).alias("html"))
    return E.table_rows(rows).select("page_id", "table_no", "row_no", F.try_element_at("cells", F.lit("Tier")).alias("tier"), F.try_element_at("cells", F.lit("Price")).alias("price"))


@query(r"""+ a as (select page_id, regexp_extract(html, '(?is)<article\b[^>]*>(.*)</article\s*>', 1) as t from pages), r as (select page_id, replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(t, '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') as t from a)
    select page_id, sha256(trim(regexp_replace(case page_id % 3 when 0 then 'b ' || t || ' inner tail' when 1 then t else 'd ' || t || ' e' end, '[ \t\n\r\f\v]+', ' ', 'g'))) as text_sha256 from r""")
def nested_page_text(t: Tables) -> DataFrame:
    """Main text of pages whose articles stand in nested elements of one name: a main inside a main, an article inside an article, sections inside one with the role."""
    i, article = F.col("page_id"), F.regexp_extract("html", r"(?is)<article\b[^>]*>.*</article\s*>", 0)
    bare = F.regexp_replace(article, r"(?i)</?article\b[^>]*>", " ")
    page = F.when(i % 3 == 0, text("<body><nav>x<nav>y</nav>z</nav><main>b ", article, "<main>inner</main> tail</main>after</body>")).when(i % 3 == 1, text("<body>top <article>", article, "</article><article>more</article></body>"))
    page = page.otherwise(text("<head><title>t</title></head><section>x</section><section role='main'>d <section>", bare, "</section> e</section> f"))
    return E.main_texts(t.read("pages").select("page_id", page.alias("html"))).select("page_id", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


@query("""+ p as (select page_id, page_id % 5 as k, (page_id % 90 + 10) / 10.0 as a from pages), s as (
    select page_id, 'tou' as kind, 'table' as source, '2025-11-01' as effective, 3 as n, a as low, a + 2 as high, null::int as summer, null::int as winter from p where k = 0
    union all select page_id, 'tiered', 'table', '2024-05-01', 2, a, a + 1, 600, (1000 + page_id % 7)::int from p where k in (0, 1)
    union all select page_id, 'tou', 'text', '2000-11-01', 3, a, a + 2, null, null from p where k = 1
    union all select page_id, 'ulo', case page_id % 2 when 0 then 'text' else 'table' end, case page_id % 2 when 0 then '2000-11-01' else '2023-11-03' end, 4, a, a + 3, null, null from p where k = 2
    union all select page_id, 'tou', 'table', '2021-02-10', 3, a + 1, a + 3, null, null from p where k = 3)
    select page_id, kind, source, effective, n, round(low / 100, 5)::double as low, round(high / 100, 5)::double as high, summer, winter from s""")
def table_rates(t: Tables) -> DataFrame:
    """Rate sets of pages from the cells of their tables: headers in any order, short rows, rows without prices or a year, several tables of a kind; from the text where cells are empty or the first row is short."""
    i = F.col("page_id")
    price = lambda k: F.format_string("%.1f", (i % 90 + 10) / 10 + k)
    row = lambda *cells: text("<tr>", *[x for c in cells for x in ("<td>", c if not isinstance(c, str) else F.lit(c), "</td>")], "</tr>")
    head = lambda *names: F.lit("<table><tr>" + "".join(f"<th>{n}</th>" for n in names) + "</tr>")
    tou = lambda *rows: text(head("Effective date", "Off-Peak", "On-Peak", "Mid-Peak"), *rows, "</table>")
    tiered = text(head("Date", "Lower tier", "Threshold (kWh)", "Higher tier"), row("May 1, 2024", price(0), text("600 (Summer) ", F.format_string("%,d", 1000 + i % 7), " (Winter)"), price(1)), "</table>")
    ulo = text(head("From", "Ultra-Low Overnight", "Weekend Off-Peak", "Mid-Peak", "On-Peak"), F.when(i % 2 == 0, row("Jan 1, 2024", "1.0")).otherwise(""), row("Moon 3 2023", price(0), price(1), price(2), price(3)), row("Jan 1, 2024", "1.0"), "</table>")
    page = F.when(i % 5 == 0, text(tou(row("soon", "1", "2", "3"), row("Nov 1, 2025", price(0), price(2), price(1)), row("Nov 1, 2024", "1", "1", "1")), tiered))
    page = page.when(i % 5 == 1, text(tou(row("Nov 1, 2025", "", "", "")), tiered, "<p>Time-of-Use prices</p><p>", price(0), "</p><p>", price(1), "</p><p>", price(2), "</p>")).when(i % 5 == 2, ulo)
    page = page.when(i % 5 == 3, text(tou(row("Jan 1, 2020", price(0), price(2), price(1))), tou(row("Feb 10 2021", price(1), price(3), price(2))))).otherwise(tou(row("Jan 1, 2020", "1", "200", "x")))
    found = E.page_rate_sets(t.read("pages").select("page_id", text(F.coalesce("html", F.lit("")), page).alias("html")), "2001-08-01")
    return found.select("page_id", "kind", "source", "effective", F.size("prices").alias("n"), F.get("prices", F.lit(0)).alias("low"), F.array_max("prices").alias("high"), "summer", "winter")


@query(SOURCES + """ select 'missing' as target, id from (select id from utilities u where is_active and country = 'ASIA' and not exists (select 1 from tariffs t where t.utility_id = u.id) order by id limit 40)
    union all select 'having', id from (select id from utilities u where is_active and state = 'NATION_7' and exists (select 1 from tariffs t where t.utility_id = u.id) order by id limit 40) union all select 'error', id from (select id from s where status = 'ERROR' order by id limit 40)""")
def run_targets(t: Tables) -> DataFrame:
    """The first 40 utilities that each kind of run is for."""
    sources = _sources(t).select(F.col("id").alias("utility_id"), "status")
    of = lambda kind, **where: R.run_targets(t.utilities, t.tariffs, sources, kind, 40, **where).select(F.lit(kind).alias("target"), "id")
    return of("missing", country="ASIA").union(of("having", state="NATION_7")).union(of("error"))


@query("""select domain, count(*) as tariffs, count(distinct utility_id) as utilities from (select utility_id, 'www.s' || id % 83 || '.example' as domain from tariffs where id % 5 <> 0) group by 1 order by tariffs desc, domain limit 30""")
def source_domains(t: Tables) -> DataFrame:
    """The 30 sites that most tariffs come from, with their different utilities."""
    i = F.col("id")
    url = F.when(i % 5 != 0, text("https://www.s", i % 83, ".example/rates/", i))
    return R.source_domains(t.tariffs.select("utility_id", url.alias("url")), "url")


@query("""select t.id, 'http://' || t.id % 61 || '.example/' as url, sha256(p.html) as hash, t.last_verified::varchar as verified, t.amount > 100000 as approved from tariffs t left join pages p on p.page_id = t.id % 61""")
def tariff_origins(t: Tables) -> DataFrame:
    """Where each tariff comes from: url, hash of the page, when it was verified and whether it is approved."""
    hashed = t.read("pages").where("page_id < 61").select(F.col("page_id").alias("page"), F.sha2(F.col("html").cast("binary"), 256).alias("hash"))
    rows = t.tariffs.withColumn("page", F.col("id") % 61).join(hashed, "page", "left")
    return rows.select("id", text("http://", F.col("page"), ".example/").alias("url"), "hash", F.col("last_verified").cast("string").alias("verified"), (F.col("amount") > 100000).alias("approved"))


@query("""+ n as (select tariff_id, count(*) as c from components group by 1), a as (select u.country, u.id as uid, t.id, t.customer_class as k, n.c from utilities u left join tariffs t on t.utility_id = u.id left join n on n.tariff_id = t.id where u.is_active)
    select country, count(distinct uid) as utilities, count(distinct uid) filter (id is not null) as having, count(distinct uid) - count(distinct uid) filter (id is not null) as missing, round(100.0 * count(distinct uid) filter (id is not null) / count(distinct uid))::int as pct, count(id) as tariffs,
      count(*) filter (k = '1-URGENT') as first, count(*) filter (k = '2-HIGH') as second, count(*) filter (k not in ('1-URGENT', '2-HIGH')) as other, count(c) as filled, coalesce(sum(c), 0)::bigint as components, round(sum(c) / count(c), 1)::double as per_tariff, round(sum(c * c) / sum(c), 1)::double as per_component from a group by 1""")
def country_audit(t: Tables) -> DataFrame:
    """Utilities, tariffs by class and components of each country, with both means."""
    return R.country_audit(t.utilities, t.tariffs, t.components, "1-URGENT", "2-HIGH")


@query("""+ s as (select id as source_id, case when id % 3 = 0 then 'http' else 'https' end as scheme, case when id % 2 = 0 then 'www.' else '' end as w, 's' || id || '.example' as h, case id % 4 when 0 then '' when 1 then '/' when 2 then '/a?b=1' else '/rates' end as tail from utilities), u as (select *, scheme || '://' || w || h || tail as url from s),
    c as (select source_id, url as old, unnest([case scheme when 'https' then 'http' else 'https' end || '://' || w || h || tail, regexp_replace(url, '[?#].*$', ''), scheme || '://' || case w when '' then 'www.' else '' end || h || tail, scheme || '://' || w || h || '/', scheme || '://' || w || h || '/rates', scheme || '://' || w || h || '/tariffs']) as url, unnest(range(6)) as prio from u)
    select source_id, url, min(prio)::int as prio from c where url <> old group by 1, 2""")
def url_rewrites(t: Tables) -> DataFrame:
    """Other spellings of the urls of sources in error, by the order in which they are tried."""
    i = F.col("id")
    url = F.concat(F.when(i % 3 == 0, "http://").otherwise("https://"), F.when(i % 2 == 0, "www.").otherwise(""), text("s", i, ".example"), pick(["", "/", "/a?b=1", "/rates"], i))
    return resolve.url_rewrites(t.utilities.select(i.alias("source_id"), url.alias("url")), ["/rates", "/tariffs"])


@query("""+ c as (select source_id as id, count(*) % 3 = 0 as none, count(*) filter (failed) as failed, count(*) filter (content_hash = 'view') as thin, count(*) filter (content_hash = 'click') as off_topic, count(*) as n from checks group by 1),
    w as (select id, case when none then 0 else n end as pages, case id % 4 when 0 then 0 else 5 end as sent, case id % 4 when 1 then 5 else 0 end as zero, case id % 4 when 2 then 5 else 0 end as bad, thin, off_topic, id % 2 = 0 as had from c)
    select id, case when pages = 0 then case when had then 'No candidate pages found after visiting rate page' else 'No candidate pages found — search returned no usable URLs' end
      when sent = 0 then 'No pages reached the LLM: ' || off_topic || ' pages were off-topic; ' || thin || ' pages had too little content' when zero = sent then 'LLM returned 0 tariffs on all 5 pages' when bad >= sent then 'LLM errored on all 5 attempts — possible API issue'
      else 'Extracted tariffs did not pass validation (' || pages || ' pages total, 5 reached LLM, 0 returned 0)' end as reason from w""")
def failure_reasons(t: Tables) -> DataFrame:
    """Where the extraction of each source broke off, from its counters."""
    n = lambda kind: F.count_if(F.col("content_hash") == kind)
    c = t.checks.groupBy(F.col("source_id").alias("id")).agg(n("view").alias("thin"), n("click").alias("off_topic"), F.count("*").alias("n"))
    i = F.col("id")
    five = lambda k: F.when(i % 4 == k, 5).otherwise(0)
    values = {"pages": F.when(F.col("n") % 3 == 0, 0).otherwise(F.col("n")), "sent": F.when(i % 4 == 0, 0).otherwise(5), "zero": five(1), "failed": five(2), "thin": F.col("thin"), "off_topic": F.col("off_topic"), "no_signal": F.lit(0), "had_page": i % 2 == 0, "aborted": F.lit(False)}
    return c.select("id", P.failure_reason(values).alias("reason"))


@query("""+ k as (select page_id, sha256(sha256(html) || ':m1:v2') as cache_key from pages), r as (select sha256(sha256(html) || ':m1:v2') as cache_key, page_id % 60 as age, 'r' || page_id as result from pages where page_id % 3 <> 0), f as (select cache_key, arg_min(result, age) as result from r where age <= 30 group by 1)
    select page_id, result from k left join f using (cache_key)""")
def cached_answers(t: Tables) -> DataFrame:
    """Answers to pages that are stored under their content, model and version and are at most 30 days old."""
    key = P.cache_key(F.sha2(F.col("html").cast("binary"), 256), "m1", "v2")
    now = F.lit("2024-03-01 00:00:00").cast("timestamp")
    pages = t.read("pages").select("page_id", key.alias("cache_key"))
    stored = pages.where("page_id % 3 <> 0").select("cache_key", (now - F.make_dt_interval((F.col("page_id") % 60).cast("int"))).alias("stored_at"), text("r", F.col("page_id")).alias("result"))
    hits, misses = P.cached_results(pages, stored, now)
    return hits.select("page_id", "result").unionByName(misses.select("page_id", F.lit(None).cast("string").alias("result")))


@query("""+ w as (select page_id, page_id % 80 as utility_id, case page_id % 5 when 0 then 'http://www.findenergy.com/acme' when 1 then 'http://other' || page_id % 80 || '.net/acme' when 2 then 'https://www.acme' || page_id % 80 || '.com/' when 3 then 'http://x.acme' || page_id % 80 || '.com/' else 'http://riverpower.org/' end as url from pages),
    f as (select utility_id, page_id, case page_id % 5 when 2 then 'acme' || utility_id || '.com' when 4 then 'riverpower.org' end as host from w where page_id % 5 in (2, 4)) select utility_id, arg_min(host, page_id) as host from f group by 1""")
def own_domains(t: Tables) -> DataFrame:
    """The first search result of each utility whose host carries its name and is no site that compares rates."""
    i = F.col("page_id")
    u = i % 80
    url = F.when(i % 5 == 0, "http://www.findenergy.com/acme").when(i % 5 == 1, text("http://other", u, ".net/acme")).when(i % 5 == 2, text("https://www.acme", u, ".com/")).when(i % 5 == 3, text("http://x.acme", u, ".com/")).otherwise("http://riverpower.org/")
    results = t.read("pages").select(u.alias("utility_id"), i.alias("position"), url.alias("url"))
    names = results.select("utility_id").distinct().withColumn("name", F.lit("River Acme Electric Co."))
    listed = t.spark.createDataFrame([(d,) for d in L.THIRD_PARTY_DOMAINS], "domain string")
    return resolve.own_domain(results, names, listed)


COMPARISON = ["/electricity_prices-2031.pdf", "/Rate%2Dcomparison", "/rates", "/comparison_of-electricity", "/average-electricity_rates", "/rates-comparison"]


@query(f"select id, true as comparison, name from (select id, name, list_extract([true, true, false, true, true, false], (id % 6 + 1)::int) as hit from tariffs) where hit and id % 4 <> 1 union all select id, false, 'gas' from tariffs where id % 4 = 1")
def unfit_tariffs(t: Tables) -> DataFrame:
    """Tariffs from pages that compare prices, and tariffs for gas alone."""
    i = F.col("id")
    name = pick(["Residential", "Natural gas service", "Gas turbine electric", "GDS electric"], i)
    rows = t.tariffs.select("id", "name", name.alias("said"), F.concat(F.lit("http://a.example"), pick(COMPARISON, i)).alias("url"))
    gas = rows.where(X.is_gas_only(F.col("said")))
    hit = rows.where(X.is_comparison_page(F.col("url"))).join(gas.select("id"), "id", "left_anti")
    return hit.select("id", F.lit(True).alias("comparison"), "name").union(gas.select("id", F.lit(False), F.lit("gas")))


@query("""+ d as (select id, 't' || id % 6 as kind from tariffs where id % 6 < 4), g as (select id from tariffs where id % 2 = 0)
    select 'both' as part, count(*) as n, coalesce(sum(id), 0)::bigint as ids from d semi join g using (id) union all select 'first', count(*), coalesce(sum(id), 0)::bigint from d anti join g using (id) union all select 'second', count(*), coalesce(sum(id), 0)::bigint from g anti join d using (id)""")
def delete_lists(t: Tables) -> DataFrame:
    """What two lists of tariffs to delete share, and what each has alone."""
    a, b = t.tariffs.where("id % 6 < 4").select("id"), t.tariffs.where("id % 2 = 0").select("id")
    total = lambda df, name: df.agg(F.lit(name).alias("part"), F.count("*").alias("n"), F.coalesce(F.sum("id"), F.lit(0)).alias("ids"))
    return total(a.intersect(b), "both").union(total(a.subtract(b), "first")).union(total(b.subtract(a), "second"))


@query("""select u.id, string_agg(distinct 'http://t.example/' || t.id % 9, ' ' order by 'http://t.example/' || t.id % 9) filter (t.id % 9 < 5) as urls, count(*) as tariffs from utilities u join tariffs t on t.utility_id = u.id group by 1""")
def evidence_urls(t: Tables) -> DataFrame:
    """Up to five distinct source urls of each utility as evidence beside its tariffs."""
    url = F.when(F.col("id") % 9 < 5, text("http://t.example/", F.col("id") % 9))
    per = t.tariffs.groupBy(F.col("utility_id").alias("id")).agg(F.slice(F.sort_array(F.collect_set(url)), 1, 5).alias("u"), F.count("*").alias("tariffs"))
    return per.select("id", F.nullif(F.array_join("u", " "), F.lit("")).alias("urls"), "tariffs")


# Streams


@query("""select window_start::date::varchar as start, count(*) as checks, count(*) filter (content_hash = 'view') as changed, count(*) filter (failed) as errors from (select *, date_trunc('day', checked_at) as window_start from checks) group by 1""")
def daily_outcomes(t: Tables) -> DataFrame:
    """Outcomes per day of event time, by the operator that streams use, over the whole table at once."""
    rows = t.checks.select(F.col("checked_at").cast("timestamp").alias("checked_at"), F.when(F.col("failed"), "error").when(F.col("content_hash") == "view", "changed").otherwise("unchanged").alias("outcome"))
    return M.stream_outcomes(rows, "1 day").select(F.to_date("start").cast("string").alias("start"), "checks", "changed", "errors")


@query("""+ f as (select source_id as utility_id, props as url, content_hash, checked_us, id, lag(content_hash) over (partition by source_id, props order by checked_us, id) as before from checks)
    select utility_id, count(*) filter (before is null or before <> content_hash) as extracted, count(*) filter (before = content_hash) as skipped from f group by 1""")
def incremental_pages(t: Tables) -> DataFrame:
    """Checks whose page is new or changed since its last check, which are extracted again, and those that are skipped."""
    w = Window.partitionBy("source_id", "props").orderBy("checked_us", "id")
    rows = t.checks.withColumn("before", F.lag("content_hash").over(w))
    same = F.coalesce(F.col("before") == F.col("content_hash"), F.lit(False))
    return rows.groupBy(F.col("source_id").alias("utility_id")).agg(F.count_if(~same).alias("extracted"), F.count_if(same).alias("skipped"))
