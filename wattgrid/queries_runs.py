"""Registered queries of runs, of pages that are skipped batch by batch, of whose pages they are, and of duplicates that a pass removes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattgrid.functions.scratch import shared_folder
from wattgrid.operators import changes, resolve, runs
from wattgrid.plans.adaptors import Tables
from wattgrid.queries_jobs import pick, sql_list
from wattgrid.registry import AS_OF, query
from wattgrid.streaming import runs as stream_runs
from wattgrid.streaming.fingerprints import FingerprintTable

DAYS = 5


@query("""+ d as (select *, lag(content_hash) over (partition by source_id, props order by checked_us, content_hash) as before from checks)
    select source_id as utility_id, count(*) filter (before is null) as first, count(*) filter (before <> content_hash) as changed, count(*) filter (before = content_hash) as same from d group by 1""")
def pages_by_batch(t: Tables) -> DataFrame:
    """Checks of pages in batches of five days, each against the fingerprints that the batches before it left: how many are new, changed, or skipped."""
    rows = t.checks.select(F.col("source_id").alias("utility_id"), F.col("props").alias("url"), "content_hash", F.timestamp_micros("checked_us").alias("at"), F.expr(f"checked_us div {DAYS * 86_400_000_000}").alias("span"))
    table, done = FingerprintTable(t.spark, f"{shared_folder(t.spark)}/fingerprints-{uuid.uuid4().hex}"), None
    ends = rows.agg(F.min("span").alias("a"), F.max("span").alias("b")).first()
    if ends["a"] is None:
        return t.spark.createDataFrame([], "utility_id bigint, first bigint, changed bigint, same bigint")
    for number, span in enumerate(range(ends["a"], ends["b"] + 1)):
        part = table.apply(rows.where(F.col("span") == span).drop("span"), number)
        done = part if done is None else done.unionByName(part)
    return done.groupBy("utility_id").agg(*[F.count_if(F.col("outcome") == k).alias(k) for k in ("first", "changed", "same")])


RUN_EVENTS = """+ k as (select *, source_id * 100 + day(checked_at) as run_id, row_number() over (partition by source_id, day(checked_at) order by checked_us, id) as k from checks),
    e as (select run_id, checked_us as us, case when k = 1 then 1 + source_id % 3 end as targeted, k > 1 as result, k > 1 and failed as failed from k where checked_us < epoch_us(timestamp '2024-01-25 12:00:00'))"""


@query(RUN_EVENTS + """,
    s as (select *, row_number() over w as n, max(targeted) over w as wanted, count(*) filter (result) over w as reported, count(*) filter (result and failed) over w as bad, lead(us) over (partition by run_id order by us, result, failed) as later
          from e window w as (partition by run_id order by us, result, failed rows between unbounded preceding and current row)),
    o as (select *, case when reported >= wanted then 'complete' when coalesce(later, epoch_us(timestamp '2024-01-25 12:00:00')) > us + 6 * 3600000000 then 'stalled' end as outcome from s)
    select run_id, arg_min(outcome, n) as outcome, arg_min(us + case when outcome = 'stalled' then 6 * 3600000000 else 0 end, n) as finished_us, arg_min(reported, n) as reported, arg_min(bad, n) as failed, arg_min(greatest(wanted - reported, 0), n) as missing from o where outcome is not null group by 1""")
def finished_runs(t: Tables) -> DataFrame:
    """Runs of a source and day: complete with their last result, or stalled when six hours went by without one."""
    from pyspark.sql import Window

    day = F.dayofmonth("checked_at")
    rows = t.checks.select("source_id", F.timestamp_micros("checked_us").alias("at"), "failed", (F.col("source_id") * 100 + day).alias("run_id"), F.row_number().over(Window.partitionBy("source_id", day).orderBy("checked_us", "id")).alias("k"))
    events = rows.select("run_id", "at", F.when(F.col("k") == 1, 1 + F.col("source_id") % 3).alias("targeted"), F.when(F.col("k") > 1, F.col("failed")).alias("failed"))
    out = stream_runs.finish_runs(events, "2024-01-25 12:00:00")
    return out.select("run_id", "outcome", F.unix_micros("finished_at").alias("finished_us"), "reported", "failed", "missing")


@query("""+ r as (select source_id as run_id, min(checked_us) as s, least(epoch_us(timestamp '2024-01-02 12:00:00'), min(checked_us) + 24 * 3600000000) as e, 5 + source_id % 100 as targeted from checks group by source_id),
    t as (select source_id as utility_id, checked_us as seen, case id % 3 when 0 then checked_us - 3600000000 when 1 then checked_us - 5 * 86400000000 end as made from checks),
    j as (select run_id, count(*) filter (made >= s and made < e) as created, count(*) filter (seen >= s and seen < e and (made is null or made < s)) as verified_only, count(distinct case when seen >= s and seen < e then utility_id end) as processed
          from r join t on (made >= s and made < e) or (seen >= s and seen < e) group by 1)
    select run_id, e as ended_us, coalesce(created, 0) as created, coalesce(verified_only, 0) as verified_only, coalesce(processed, 0) as processed, greatest(targeted - coalesce(processed, 0), 0) as errors from r left join j using (run_id)""")
def run_trail(t: Tables) -> DataFrame:
    """Overlapping runs, one per source, told from the times at which tariffs were made and verified."""
    at, id_ = F.col("checked_us"), F.col("id")
    given = t.checks.groupBy(F.col("source_id").alias("run_id")).agg(F.timestamp_micros(F.min("checked_us")).alias("started_at")).withColumn("targeted", 5 + F.col("run_id") % 100)
    made = F.when(id_ % 3 == 0, at - 3_600_000_000).when(id_ % 3 == 1, at - 5 * 86_400_000_000)
    tariffs = t.checks.select(F.col("source_id").alias("utility_id"), F.timestamp_micros(made).alias("created_at"), F.timestamp_micros(at).alias("verified_at"))
    out = runs.run_trail(given, tariffs, "2024-01-02 12:00:00")
    return out.select("run_id", F.unix_micros("ended_at").alias("ended_us"), "created", "verified_only", "processed", "errors")


@query(f"""+ r as (select id % 20 as run_id, id as utility_id, name, case when id % 6 > 0 then state end as state, id % 5 <> 0 as success, id % 4 as found, case id % 10 when 0 then ['timed out', 'no page ' || id] end as problems from utilities),
    b as (select utility_id, count(*) as n from tariffs where effective_date < date '1999-01-01' or utility_id % 3 = 0 group by 1),
    a as (select utility_id, count(*) as n, count(*) filter (last_verified is null or last_verified < date '{AS_OF}' - 270) as old from tariffs group by 1),
    j as (select r.*, coalesce(b.n, 0) as was, coalesce(a.n, 0) as now, coalesce(a.old, 0) as old from r left join b using (utility_id) left join a using (utility_id))
    select run_id, count(*) as targeted, count(*) filter (success) as processed, count(*) filter (not success) as errors, sum(found)::bigint as found, sum(greatest(now - was, 0))::bigint as added, sum(case when now = was then now else 0 end)::bigint as updated, sum(old)::bigint as stale,
      string_agg(distinct state, ',' order by state) as states, coalesce(string_agg(name || ' (' || coalesce(state, '?') || '): ' || coalesce(array_to_string(problems, '; '), 'unknown'), chr(10) order by name) filter (not success), '') as error_details from j group by 1""")
def run_outcomes(t: Tables) -> DataFrame:
    """What the results of twenty runs over the utilities add up to: tariffs added and updated against the counts before, stale ones, states, and errors in words."""
    i = F.col("id")
    problems = F.when(i % 10 == 0, F.array(F.lit("timed out"), F.concat(F.lit("no page "), i.cast("string"))))
    results = t.utilities.select((i % 20).alias("run_id"), i.alias("utility_id"), "name", F.when(i % 6 > 0, F.col("state")).alias("state"), (i % 5 != 0).alias("success"), (i % 4).alias("found"), problems.alias("problems"))
    before = t.tariffs.where("effective_date < date'1999-01-01' or utility_id % 3 = 0").groupBy("utility_id").agg(F.count("*").alias("n")).withColumn("run_id", F.col("utility_id") % 20)
    return runs.run_outcomes(results, before, t.tariffs, AS_OF)


OWNERS = ["Article Zzqqy Electric Co", "Zzqqy Qqzzx Nowhere9", "City of Zzqqy, Qqzzx LLC", "Zzqqy Qqzzx", "Qqzzx Zzqqy Board", "City Power", "Rescued Quxly Inc.", "Qqzzx Light"]
STATES = ["TX", "tx", "ZQXJ", "ZQXJ", "TX", "TX", "ZQXJ", "TX"]
DOMAINS = [None, "nowhere.test", "nowhere.test", None, "nowhere.test", "nowhere.test", "nowhere.test", "www.Other.Example.org"]
NAMED = [*resolve.NAMED_STATES.items()]


@query(rf"""+ v as (select page_id % 40 as utility_id, url, lower(html || case page_id % 8 when 1 then ' Texas Ohio Maine Utah' when 4 then ' TEXAS' when 7 then ' texas' else '' end) as body, case when page_id % 8 = 6 then 'Rescued Quxly' else '' end as title from pages),
    p as (select *, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) as site from v),
    u as (select distinct utility_id, list_extract({sql_list(OWNERS)}, (utility_id % 8 + 1)::int) as name, list_extract({sql_list(STATES)}, (utility_id % 8 + 1)::int) as state, nullif(list_extract({sql_list([d or '' for d in DOMAINS])}, (utility_id % 8 + 1)::int), '') as domain from p),
    c as (select utility_id, trim(lower(regexp_replace(regexp_replace(name, '(?i)\s+(Co|Inc|LLC)\.?$', ''), ',$', ''))) as name from u),
    w as (select utility_id, unnest(list_filter(string_split_regex(name, '\s+'), lambda x: length(x) > 2 and x not in ('city', 'power', 'electric', 'light', 'board'))) as word from c),
    h as (select utility_id, word, bool_or(contains(body, word)) as b, bool_or(contains(site || ' ' || lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) || ' ' || title), word)) as t from w join p using (utility_id) group by 1, 2),
    m as (select utility_id, count(*) as n_words, count(*) filter (b) as b, count(*) filter (t) as t from h group by 1),
    n(code, full_name) as (values {", ".join(f"('{c}', '{n}')" for c, n in NAMED)}),
    s as (select utility_id, count(distinct full_name) filter (code <> upper(state)) as others, bool_or(code = upper(state)) as own from p join u using (utility_id) join n on contains(body, full_name) group by 1),
    f as (select utility_id, bool_or(contains(body, lower(state))) as short, bool_or(replace(site, 'www.', '') = replace(lower(domain), 'www.', '') or ends_with(site, '.' || replace(lower(domain), 'www.', '')) or array_to_string(string_split(site, '.')[-2:], '.') = array_to_string(string_split(lower(domain), '.')[-2:], '.')) as fits from p join u using (utility_id) group by 1),
    a as (select u.*, coalesce(n_words, 0) as n_words, case when t >= 2 or (t >= 1 and n_words <= 2) then greatest(b, t) else coalesce(b, 0) end as hits, coalesce(others, 0) as other_states, short or coalesce(own, false) as has_state, domain is null or fits as domain_ok from u left join m using (utility_id) left join s using (utility_id) join f using (utility_id)),
    k as (select *, case when hits > 0 or n_words = 0 then null when has_state and other_states >= 3 and not domain_ok then 'other_states' when not has_state and not domain_ok then 'nothing_fits' when not has_state then 'no_mention' when not domain_ok then 'state_only' end as code from a)
    select utility_id, n_words, hits, other_states, code is null as is_own, code, case code
        when 'other_states' then 'Page mentions ' || other_states || ' other states more than target state (' || state || ') and domain doesn''t match — likely cross-contamination.'
        when 'nothing_fits' then 'Page content does not mention the utility name (' || name || '), state (' || state || '), and pages are from a different domain. Likely cross-contamination.'
        when 'no_mention' then 'Page content does not mention the utility name (' || name || ') or state (' || state || '). Possible cross-contamination.'
        when 'state_only' then 'Page mentions target state (' || state || ') but utility name (' || name || ') not found and domain doesn''t match — possible cross-contamination.' else '' end as reason from k""")
def identity_verdicts(t: Tables) -> DataFrame:
    """Whether the pages of forty utilities are their own, by name, state and domain, each verdict being reached."""
    i = F.col("page_id") % 40
    more = F.when(i % 8 == 1, " Texas Ohio Maine Utah").when(i % 8 == 4, " TEXAS").when(i % 8 == 7, " texas").otherwise("")
    pages = t.read("pages").select(i.alias("utility_id"), "url", F.when(i % 8 == 6, "Rescued Quxly").alias("title"), F.concat("html", more).alias("content"))
    by = F.col("utility_id")
    utilities = pages.select("utility_id").distinct().select("utility_id", pick(OWNERS, by).alias("name"), pick(STATES, by).alias("state"), F.nullif(pick([d or "" for d in DOMAINS], by), F.lit("")).alias("domain"))
    return resolve.identity_verdicts(utilities, pages)


@query(r"""++ r as (select p_brand as brand, p_partkey as id, case p_partkey % 5 when 0 then split_part(p_name, ' ', 1) when 1 then upper(p_name) || '-X' when 2 then p_name || '  pro' when 3 then p_name else '"' || split_part(p_name, ' ', 1) || '"' end as name, p_size % 4 as core, p_size as total from part),
    n as (select *, trim(regexp_replace(regexp_replace(lower(name), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g')) as plain, row_number() over (partition by brand order by name collate "C", id) as o from r),
    pairs as (select brand, a.o as i, b.o as j, a.core > b.core or (a.core = b.core and a.total >= b.total) as stays, row_number() over (partition by brand order by a.o, b.o) as k
              from n a join n b using (brand) where a.o < b.o and (a.plain = b.plain or (starts_with(a.plain, b.plain) and length(trim(a.plain[length(b.plain) + 1:])) >= 4) or (starts_with(b.plain, a.plain) and length(trim(b.plain[length(a.plain) + 1:])) >= 4))),
    walk(brand, k, lost, won) as (
        select distinct brand, 0::bigint, []::bigint[], []::bigint[] from n
        union all
        select w.brand, w.k + 1, case when list_contains(lost, i) or list_contains(lost, j) then lost else list_append(lost, case when stays then j else i end) end,
               case when list_contains(lost, i) or list_contains(lost, j) then won else list_append(won, case when stays then i else j end) end
        from walk w join pairs p on p.brand = w.brand and p.k = w.k + 1),
    ends as (select brand, arg_max(lost, k) as lost, arg_max(won, k) as won from walk group by 1),
    out_ as (select brand, unnest(lost) as o, unnest(won) as to_o from ends)
    select n.brand, n.id, coalesce(b.id, n.id) as merged_into from n left join out_ using (brand, o) left join n b on b.brand = n.brand and b.o = to_o""")
def absorbed_duplicates(t: Tables) -> DataFrame:
    """Parts as tariffs of their brand, gone through by name: of two alike the richer stays, and the pass goes on from what is left."""
    word, by = F.split_part("p_name", F.lit(" "), F.lit(1)), F.col("p_partkey") % 5
    name = F.when(by == 0, word).when(by == 1, F.concat(F.upper("p_name"), F.lit("-X"))).when(by == 2, F.concat("p_name", F.lit("  pro"))).when(by == 3, F.col("p_name")).otherwise(F.concat(F.lit('"'), word, F.lit('"')))
    rows = t.read("part").select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("id"), name.alias("name"), (F.col("p_size") % 4).alias("core"), F.col("p_size").alias("total"))
    return changes.absorb_duplicates(rows, ["brand"], "id", "name", "core", "total")
