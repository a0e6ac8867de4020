"""New states of tables, with the changes that lead to them; nothing is written in place."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattgrid.functions.scratch import Scratch
from wattgrid.functions.text import host, likely_same, plain_name


def upsert(old: DataFrame, new: DataFrame, keys: list[str], fill: list[str], children_per_key: str = "n_components") -> DataFrame:
    """old and new rows by key: a new non-empty value of the fill columns goes before the old one; action is kept, added, updated or rejected.

    New rows without usable components (children_per_key 0) change nothing: they appear as rejected where there is no old row.
    """
    a = old.select(*keys, *[F.col(c).alias(f"o_{c}") for c in fill], F.lit(True).alias("o_"))
    b = new.select(*keys, *[F.col(c).alias(f"n_{c}") for c in fill], (F.col(children_per_key) > 0).alias("n_"))
    out = a.join(b, keys, "full")

    def value(c: str) -> Column:
        given = F.col(f"n_{c}")
        if new.schema[c].dataType.simpleString() == "string":
            given = F.nullif(given, F.lit(""))
        return F.when(F.col("n_"), F.coalesce(given, F.col(f"o_{c}"))).otherwise(F.col(f"o_{c}")).alias(c)

    action = F.when(F.col("n_") & F.col("o_"), "updated").when(F.col("n_") & F.col("o_").isNull(), "added").when(F.col("o_"), "kept").otherwise("rejected")
    return out.select(*keys, *[value(c) for c in fill], action.alias("action"))


def replace_children(old: DataFrame, new: DataFrame, actions: DataFrame, keys: list[str]) -> DataFrame:
    """Children after an upsert: of updated and added rows the new ones, of kept rows the old ones; actions (keys, action) as upsert gives them. Null keys are equal to nothing."""
    fresh = actions.where("action in ('updated', 'added')").select(*keys)
    return old.join(fresh, keys, "left_anti").unionByName(new.join(fresh, keys, "left_semi").select(*old.columns))


def reconcile(stored: DataFrame, existing: DataFrame, group: str, keys: list[str], residential: Column, least_share: float = 0.75, least_existing: int = 3, source_url: str | None = None) -> DataFrame:
    """Existing rows that a re-extraction no longer has and may retire: per group it must have stored something, a residential row among it, and not under least_share of least_existing or more existing rows.

    With source_url, a column of both tables, only rows whose url has a domain that the group's stored rows were fetched
    from may retire; rows without a url stay.
    """
    s = stored.groupBy(group).agg(F.count("*").alias("n_stored"), F.bool_or(residential).alias("home"))
    e = existing.groupBy(group).agg(F.count("*").alias("n_existing"))
    guard = s.join(e, group).where("n_stored > 0 and home").where(~((F.col("n_stored") < least_share * F.col("n_existing")) & (F.col("n_existing") >= least_existing)))
    gone = existing.join(guard.select(group), group, "left_semi").join(stored.select(*keys).distinct(), keys, "left_anti")
    if source_url is None:
        return gone
    fetched = stored.select(F.col(group).alias("g_"), host(F.col(source_url)).alias("domain_")).where("domain_ <> ''").distinct()
    return gone.join(fetched, (F.col(group) == F.col("g_")) & (host(F.col(source_url)) == F.col("domain_")), "left_semi")


def newest_only(rows: DataFrame, newest: DataFrame, id_col: str, children: DataFrame, child_key: str) -> tuple[DataFrame, DataFrame]:
    """rows and children without what the newest versions replace."""
    kept = rows.join(newest.select(id_col), id_col, "left_semi")
    return kept, children.join(newest.select(F.col(id_col).alias(child_key)), child_key, "left_semi")


def cascade_delete(parents: DataFrame, children: DataFrame, gone: DataFrame, id_col: str, child_key: str) -> tuple[DataFrame, DataFrame]:
    ids = gone.select(id_col).distinct()
    return parents.join(ids, id_col, "left_anti"), children.join(ids.withColumnRenamed(id_col, child_key), child_key, "left_anti")


def absorb_duplicates(rows: DataFrame, group: list[str], id_col: str, name_col: str, core: str, total: str, least_suffix: int = 4) -> DataFrame:
    """(group, id, merged_into): which row of its group each row loses to, itself where it stays.

    Rows of a group are gone through by name, then id. Each row that is still there meets the later ones that are still there, in
    order: of two whose plain names are equal, or of which one begins the other and leaves least_suffix characters or more (outer blanks not
    counted), the one with more core, then more total components stays, the earlier on a draw; a row that loses is out.

    The pass is made in rounds. A row may act when no earlier row that it could meet is left; those for which it is the first
    it could meet lose to it, up to the first richer one, to which it loses itself if that one waits for nobody else. So every round
    does what the pass would do, in all groups and at many places of a group at once, and rounds follow the changes of the
    keeper, not the rows. What a row could meet first is a minimum over equal names and beginnings of names, so no pairs of a
    group are listed but those with a row that may act. Rows without a name stay; null components are fewest; nulls in a group are equal.
    """
    scratch = Scratch(rows.sparkSession, "absorb")
    order = F.struct(F.col(name_col).alias("name"), F.col(id_col).alias("id"))
    worth = F.struct(F.coalesce(F.col(core), F.lit(-1)).alias("core"), F.coalesce(F.col(total), F.lit(-1)).alias("total"))
    live = rows.where(F.col(name_col).isNotNull()).select(F.struct(*group).alias("g_"), plain_name(F.col(name_col)).alias("n_"), order.alias("r_"), worth.alias("w_"))
    live, lost = scratch.cut(live), None
    begun_list = lambda n: F.filter(F.transform(F.sequence(F.lit(0), F.char_length(n)), lambda k: F.when(F.char_length(F.trim(F.substring(n, k + 1, F.char_length(n)))) >= least_suffix, F.substring(n, F.lit(1), k))), lambda p: p.isNotNull())
    begun = lambda n: F.explode(begun_list(n))
    while True:
        names = live.groupBy("g_", "n_").agg(F.min("r_").alias("c_"), F.min_by("w_", "r_").alias("cw_"), F.count("*").alias("many_"))
        tied = names.select("g_", "n_", "c_", begun(F.col("n_")).alias("p_")).join(names.select("g_", F.col("n_").alias("p_"), F.col("c_").alias("pc_")), ["g_", "p_"])
        ends = F.explode(F.array(F.struct(F.col("n_").alias("n"), F.col("pc_").alias("c")), F.struct(F.col("p_").alias("n"), F.col("c_").alias("c"))))
        near = tied.select("g_", ends.alias("e_")).groupBy("g_", F.col("e_.n").alias("n_")).agg(F.min("e_.c").alias("near_"))
        names = scratch.cut(names.join(near, ["g_", "n_"], "left"))
        met = live.join(names, ["g_", "n_"]).select("g_", "n_", "r_", "w_", F.when(F.col("r_") == F.col("c_"), F.coalesce("near_", F.when(F.col("many_") > 1, F.col("r_")))).otherwise(F.least("c_", "near_")).alias("first_")).where("first_ is not null")
        acts = names.where("near_ is null and many_ > 1 or c_ < near_").select("g_", "n_", F.col("c_").alias("i_"), F.col("cw_").alias("iw_"))
        # A row meets those that may act under its own name, under the beginnings of its name, and under names that its own begins.
        down = met.select("g_", "r_", "w_", "first_", F.explode(F.array_append(begun_list(F.col("n_")), F.col("n_"))).alias("n_")).join(acts, ["g_", "n_"])
        up = acts.select("g_", "i_", "iw_", begun(F.col("n_")).alias("n_")).join(met, ["g_", "n_"])
        cols = ["g_", "i_", "iw_", "r_", "w_", "first_"]
        pairs = scratch.cut(down.select(*cols).union(up.select(*cols)).where("r_ <> i_"))
        richer = pairs.groupBy("g_", "i_").agg(F.min(F.when(F.col("w_") > F.col("iw_"), F.struct("r_", "first_"))).alias("t_"))
        beaten = richer.where("t_.first_ = i_").select("g_", F.col("i_").alias("r_"), F.col("t_.r_").alias("to_"))
        taken = pairs.where("first_ = i_").join(richer, ["g_", "i_"]).where("t_ is null or r_ < t_.r_").select("g_", "r_", F.col("i_").alias("to_"))
        done = scratch.cut(met.select("g_", "n_", "r_", "w_").join(beaten.union(taken), ["g_", "r_"], "left"))
        scratch.drop(names, pairs)
        gone, live = done.where("to_ is not null").select("g_", "r_", "to_"), done.where("to_ is null").select("g_", "n_", "r_", "w_")
        if gone.isEmpty():
            break
        lost = gone if lost is None else lost.union(gone)
    out = rows.select(F.struct(*group).alias("g_"), *group, id_col, order.alias("r_"))
    if lost is None:
        return out.select(*group, id_col, F.col(id_col).alias("merged_into"))
    return out.join(lost, ["g_", "r_"], "left").select(*group, id_col, F.coalesce("to_.id", id_col).alias("merged_into"))


def greedy_matches(pairs: DataFrame, group: str, left: str, right: str, rank: list[str]) -> DataFrame:
    """(group, left, right): pairs taken in rank order per group, then by left and right, each side at most once.

    In each round the pairs that are the first of both their sides are taken, which the order would take too, and pairs of
    taken sides go. So groups may have any size; rounds follow the longest chain of pairs that wait for one another.
    Null groups and sides match nothing.
    """
    scratch = Scratch(pairs.sparkSession, "greedy")
    order = F.struct(*dict.fromkeys([*rank, left, right]))
    rows = pairs.where(" and ".join(f"`{c}` is not null" for c in (group, left, right)))
    rows = scratch.cut(rows.select(F.col(group).alias("g_"), F.col(left).alias("l_"), F.col(right).alias("r_"), order.alias("o_")).distinct())
    taken = None
    while True:
        first = lambda side: rows.groupBy("g_", side).agg(F.min("o_").alias("o_"))  # noqa: E731, B023
        both = scratch.cut(rows.join(first("l_"), ["g_", "l_", "o_"], "left_semi").join(first("r_"), ["g_", "r_", "o_"], "left_semi").select("g_", "l_", "r_"))
        taken = both if taken is None else taken.union(both)
        rest = scratch.cut(rows.join(both.select("g_", "l_"), ["g_", "l_"], "left_anti").join(both.select("g_", "r_"), ["g_", "r_"], "left_anti").select("g_", "l_", "r_", "o_"))
        scratch.drop(rows)
        rows = rest
        if rows.isEmpty():
            return taken.toDF(group, left, right)


def match_candidates(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """(utility_id, want, got, stage, overlap): pairs of a utility and class whose names are equal (stage 0), one inside the other (1) or share two words or more (2), of equal stages with less overlap the larger first.

    wanted, found: utility_id, id, name, customer_class; names are compared without case and punctuation. Pairs of one
    utility and class are joined, which are its own few tariffs.
    """
    one = lambda df, name: df.select("utility_id", "customer_class", F.col("id").alias(name), plain_name(F.col("name")).alias(f"{name}_name"))
    pairs = one(wanted, "want").join(one(found, "got"), ["utility_id", "customer_class"])
    a, b = F.col("want_name"), F.col("got_name")
    overlap = F.size(F.array_intersect(F.split(a, " "), F.split(b, " ")))
    stage = F.when(a == b, 0).when(F.contains(a, b) | F.contains(b, a), 1).when(overlap >= 2, 2)
    return pairs.select("utility_id", "want", "got", stage.alias("stage"), F.when(stage == 2, -overlap).otherwise(0).alias("overlap")).where("stage is not null")


def keep_richest(rows: DataFrame, keys: list[str], components: str, position: str) -> DataFrame:
    """Of rows with equal keys the one with most components, of equal ones the first by position; null keys are equal, null components fewest."""
    from wattgrid.operators.relational import latest

    return latest(rows, keys, [F.col(components).desc_nulls_last(), F.col(position).asc_nulls_last()])


def near_prefixes(rows: DataFrame, group: list[str], id_col: str, name_col: str, least_suffix: int = 4) -> DataFrame:
    """(group, id, of): names of a group that equal an earlier id's name, or go on after another's with least_suffix characters or more (blanks around them not counted); of: the smallest such id.

    Names are met with their own beginnings by equality. Names are compared without case and punctuation; empty ones, and
    rows with a null in the group, are left out.
    """
    names = rows.select(*group, F.col(id_col).alias("id"), plain_name(F.col(name_col)).alias("n_")).where("n_ <> ''")
    whole = names.groupBy(*group, "n_").agg(F.min("id").alias("of"))
    size = F.char_length("n_")
    starts = names.select(*group, "id", F.col("n_").alias("long_"), F.explode(F.transform(F.sequence(F.lit(1), size), lambda k: F.substring(F.col("n_"), F.lit(1), k))).alias("n_"))
    suffix = F.char_length(F.trim(F.expr("substring(long_, char_length(n_) + 1)")))
    hits = starts.join(whole, [*group, "n_"]).where(((F.col("long_") == F.col("n_")) & (F.col("of") < F.col("id"))) | (suffix >= least_suffix))
    return hits.groupBy(*group, "id").agg(F.min("of").alias("of"))


def purge(tariffs: DataFrame, sources: DataFrame, domains: DataFrame, url: str = "source_url") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(gone, kept, sources): tariffs from blocked domains, with the domain; the others; and the sources, where those of affected utilities have the status CHANGED."""
    from wattgrid.operators.resolve import blocked

    judged = blocked(tariffs, url, domains)
    gone = judged.where("is_blocked").withColumn("domain", host(F.col(url))).drop("is_blocked")
    hit = gone.select("utility_id").distinct().withColumn("hit_", F.lit(True))
    flagged = sources.join(hit, "utility_id", "left").withColumn("status", F.when(F.col("hit_"), "CHANGED").otherwise(F.col("status"))).drop("hit_")
    return gone, judged.where("not is_blocked").drop("is_blocked"), flagged


def sweep(candidates: dict[str, DataFrame], rows: DataFrame, id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """(labelled, kept): ids to remove with the first category that names them, and the rows that stay; the first is the dry run."""
    labelled = None
    for k, (name, df) in enumerate(candidates.items()):
        part = df.select(id_col).distinct().withColumns({"category": F.lit(name), "_k": F.lit(k)})
        labelled = part if labelled is None else labelled.unionByName(part)
    labelled = labelled.groupBy(id_col).agg(F.min_by("category", "_k").alias("category"))
    return labelled, rows.join(labelled, id_col, "left_anti")


def deactivate(rows: DataFrame, reasons: DataFrame, id_col: str = "id") -> DataFrame:
    """rows with is_active false and a reason where reasons (id, reason) names them."""
    out = rows.join(reasons.groupBy(id_col).agg(F.min("reason").alias("reason")), id_col, "left")
    return out.withColumn("is_active", F.when(F.col("reason").isNotNull(), False).otherwise(F.col("is_active")))


def upsert_fingerprints(known: DataFrame, seen: DataFrame, as_of: str) -> DataFrame:
    """Fingerprints by (utility_id, url) after a check: new hashes replace old ones and set changed_at, equal ones only checked_at."""
    now = F.lit(as_of).cast("timestamp")
    new = seen.select("utility_id", "url", F.col("content_hash").alias("n_hash"), F.lit(True).alias("n_"))
    out = known.join(new, ["utility_id", "url"], "full")
    changed = F.col("n_") & ~F.col("n_hash").eqNullSafe(F.col("content_hash"))
    return out.select("utility_id", "url", F.when(F.col("n_"), F.col("n_hash")).otherwise(F.col("content_hash")).alias("content_hash"), F.when(F.col("n_"), now).otherwise(F.col("checked_at")).alias("checked_at"), F.when(changed, now).otherwise(F.col("changed_at")).alias("changed_at"))


def unchanged_utilities(pages: DataFrame, known: DataFrame) -> DataFrame:
    """Utilities all of whose pages have the stored hash, so that they need no new extraction."""
    stored = known.select("utility_id", "url", F.col("content_hash").alias("_hash"))
    per = pages.join(stored, ["utility_id", "url"], "left").groupBy("utility_id").agg(F.bool_and(F.coalesce(F.col("content_hash") == F.col("_hash"), F.lit(False))).alias("same"))
    return per.where("same").select("utility_id")


def update_values(rows: DataFrame, updates: DataFrame, key: str, column: str, valid: Column | None = None, order: str | None = None) -> DataFrame:
    """rows with the column's new values from updates (key, column); null and invalid ones are left out. Of several updates of a key the last by order counts, of equal ones (or without an order) the largest value."""
    place = F.struct(*([order] if order else []), column)
    new = updates.where(F.col(column).isNotNull() & (valid if valid is not None else F.lit(True))).groupBy(key).agg(F.max_by(column, place).alias("_new"))
    return rows.join(new, key, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def insert_missing_sources(utilities: DataFrame, sources: DataFrame, urls: DataFrame) -> DataFrame:
    """(utility_id, url, status) for active utilities without a source that have a url (id, url)."""
    missing = utilities.where("is_active").select("id").join(sources.select(F.col("utility_id").alias("id")), "id", "left_anti")
    return missing.join(urls.where("url is not null"), "id").select(F.col("id").alias("utility_id"), "url", F.lit("pending").alias("status"))


def merge_new_names(existing: DataFrame, extra: DataFrame, group: str, name: str, order: str) -> DataFrame:
    """Extra candidates, in their order, whose plain name neither begins an existing or accepted name of their group nor begins with one; rejected ones stand in nobody's way.

    Clashes are found by equality of names with beginnings of names; which names begin which is told once for the distinct names.
    Of candidates with one plain name only the first can be accepted, so the others go at once. In each round candidates that clash with an
    accepted one go, and those without an undecided clash before them are accepted. Order is unique in a group; null groups and orders are not taken.
    """
    scratch = Scratch(extra.sparkSession, "new-names")
    begin = lambda n: F.explode(F.transform(F.sequence(F.lit(0), F.char_length(n)), lambda k: F.substring(n, F.lit(1), k)))
    x = extra.select(F.col(group).alias("g_"), F.col(order).alias("at_"), F.coalesce(plain_name(F.col(name)), F.lit("")).alias("n_"))
    x = scratch.cut(x.where("g_ is not null and at_ is not null").groupBy("g_", "n_").agg(F.min("at_").alias("at_")))
    e = existing.select(F.col(group).alias("g_"), F.coalesce(plain_name(F.col(name)), F.lit("")).alias("n_")).distinct()

    names = scratch.cut(x.select("n_").union(e.select("n_")).distinct())
    begins = scratch.cut(names.select("n_", begin(F.col("n_")).alias("p_")).join(names.withColumnRenamed("n_", "p_"), "p_"))

    def clashes(a: DataFrame, b: DataFrame) -> DataFrame:
        """(g_, at_) of a beside the columns of b whose name begins one's of a, or the other way round."""
        up = a.join(begins, "n_").select("g_", "at_", "p_").join(b.withColumnRenamed("n_", "p_"), ["g_", "p_"])
        down = a.withColumnRenamed("n_", "p_").join(b.join(begins, "n_").drop("n_"), ["g_", "p_"])
        return up.drop("p_").unionByName(down.drop("p_"))

    left = scratch.cut(x.join(clashes(x, e).distinct(), ["g_", "at_"], "left_anti").select("g_", "at_", "n_"))
    waits = clashes(left, left.withColumnRenamed("at_", "before_")).where("before_ < at_").distinct()
    waits, accepted = scratch.cut(waits), None
    left = left.select("g_", "at_")
    while True:
        new = scratch.cut(left.join(waits, ["g_", "at_"], "left_anti"))
        accepted = new if accepted is None else accepted.union(new)
        gone = waits.join(new.withColumnRenamed("at_", "before_"), ["g_", "before_"], "left_semi").select("g_", "at_").distinct()
        left = scratch.cut(left.join(new.union(gone), ["g_", "at_"], "left_anti"))
        if left.isEmpty():
            break
        open_ = left.withColumnRenamed("at_", "before_")
        waits = scratch.cut(waits.join(left, ["g_", "at_"], "left_semi").join(open_, ["g_", "before_"], "left_semi").select("g_", "at_", "before_"))
    taken = accepted.select(F.col("g_").alias(group), F.col("at_").alias(order))
    return extra.join(taken, [group, order], "left_semi").select(*extra.columns)


def same_names(names: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, a, b): distinct names of names (keys, a) and (keys, b) that describe one product, by likely_same; given as rows (keys, side, name).

    Each pair of distinct names is compared once, however many rows have them.
    """
    one = lambda side: names.where(F.col("side") == side).select(*keys, F.col("name").alias(side)).distinct()
    return one("a").join(one("b"), keys).where(likely_same(F.col("a"), F.col("b")))


def supersede(seeds: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """(id, fresh_id): seed rows that a fresh row of the same keys describes too, by likely_same over their names; the smallest such row."""
    sides = seeds.select(*keys, F.lit("a").alias("side"), "name").union(fresh.select(*keys, F.lit("b").alias("side"), "name"))
    first = fresh.groupBy(*keys, F.col("name").alias("b")).agg(F.min("id").alias("fresh_id"))
    met = same_names(sides, keys).join(first, [*keys, "b"]).groupBy(*keys, "a").agg(F.min("fresh_id").alias("fresh_id"))
    return seeds.select(*keys, "id", F.col("name").alias("a")).join(met, [*keys, "a"]).select("id", "fresh_id")


FEW_PAIRS = 1000  # pairs of a group that is matched as one row


def nearest_components(pairs: DataFrame, group: list[str]) -> DataFrame:
    """Of pairs (group, want_no, got_no, component_type, want, got) of one type, the nearest values one to one, greedily, with whether they are close: 5 for fixed, 15 % else.

    Groups of few pairs are matched as one row each, without a shuffle where pairs come by group; larger ones in the rounds of greedy_matches.
    """
    apart = F.abs(F.col("want") - F.col("got"))
    close = F.when(F.col("component_type") == "fixed", apart <= 5).otherwise(apart <= 0.15 * F.abs("want"))
    pairs, columns = pairs.where("want_no is not null and got_no is not null"), pairs.columns
    large = pairs.groupBy(*group).agg(F.count("*").alias("n_")).where(F.col("n_") > FEW_PAIRS).select(*[F.col(c).alias(f"_{c}") for c in group])
    large = Scratch(pairs.sparkSession, "large-groups").cut(large, 8)
    of_large = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in group])
    rest = [c for c in columns if c not in group and c not in ("want_no", "got_no")]
    item = F.struct(apart.alias("_apart"), "want_no", "got_no", *rest)
    rows = pairs.join(large, of_large, "left_anti").groupBy(*group).agg(F.sort_array(F.collect_list(item)).alias("_items"))
    none = F.struct(*[F.array().cast(pairs.select(F.array(c)).schema[0].dataType).alias(c) for c in ("want_no", "got_no")])
    gone = lambda t, x: F.array_contains(t["want_no"], x["want_no"]) | F.array_contains(t["got_no"], x["got_no"])
    both = lambda t, x: F.struct(*[F.array_append(t[c], x[c]).alias(c) for c in ("want_no", "got_no")])
    taken = F.aggregate("_items", none, lambda t, x: F.when(gone(t, x), t).otherwise(both(t, x)))
    place = lambda t, x, c: F.array_position(t[c], x[c])
    kept = lambda t: F.filter("_items", lambda x: (place(t, x, "want_no") > 0) & (place(t, x, "want_no") == place(t, x, "got_no")))
    # taken is bound as the one element of an array: as a column it would be worked out anew for each pair
    rows = rows.withColumn("_kept", F.when(F.size("_items") > 1, F.get(F.transform(F.array(taken), kept), F.lit(0))).otherwise(F.col("_items")))
    out = rows.select(*group, F.inline("_kept")).select(*columns)
    if not large.isEmpty():
        keyed = pairs.join(large, of_large, "left_semi").withColumn("_group", F.concat_ws("|", *group)).withColumn("_apart", apart)
        picked = greedy_matches(keyed.select("_group", "want_no", "got_no", "_apart"), "_group", "want_no", "got_no", ["_apart"])
        out = out.unionByName(keyed.join(picked, ["_group", "want_no", "got_no"]).select(*columns))
    return out.withColumn("close", close)


def touch_verified(rows: DataFrame, ids: DataFrame, key: str, as_of: str) -> DataFrame:
    """rows whose key is among ids get as_of as last_verified."""
    named = ids.select(key).distinct().withColumn("_touch", F.lit(True))
    return rows.join(named, key, "left").withColumn("last_verified", F.when(F.col("_touch"), F.lit(as_of).cast("date")).otherwise(F.col("last_verified"))).drop("_touch")


def benchmark_summary(expected: DataFrame, extracted: DataFrame, matches: DataFrame, close: DataFrame) -> DataFrame:
    """recall, precision (percent, one decimal), rate_errors and perfect utilities.

    expected and extracted: (utility_id, id); matches: (utility_id, want, got); close: (utility_id, close) per compared component.
    """
    e = expected.groupBy("utility_id").agg(F.count("*").alias("expected"))
    x = extracted.groupBy("utility_id").agg(F.count("*").alias("extracted"))
    m = matches.groupBy("utility_id").agg(F.count("*").alias("matched"))
    c = close.groupBy("utility_id").agg(F.count_if(~F.col("close")).alias("errors"))
    per = e.join(x, "utility_id", "left").join(m, "utility_id", "left").join(c, "utility_id", "left").fillna(0)
    share = lambda a, b: F.round(100.0 * F.sum(a) / F.nullif(F.sum(b), F.lit(0)), 1)
    return per.agg(share("matched", "expected").alias("recall"), share("matched", "extracted").alias("precision"), F.sum("errors").alias("rate_errors"), F.count_if((F.col("matched") == F.col("expected")) & (F.col("errors") == 0)).alias("perfect"))
