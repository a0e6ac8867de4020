"""Which utility a record belongs to, which urls are worth a visit, and which tariffs are really a utility's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattgrid.functions import lists as L
from wattgrid.functions import text as X

# Corporate suffixes, and words that say little about a name.
SUFFIXES = r"(?i)[\s,]+(inc|llc|co|corp|corporation|company|ltd|limited)\.?$"
COMMON_WORDS = "the of and electric power energy utility utilities company city county light public service cooperative coop association district authority".split()


def plain_utility(name: Column) -> Column:
    """Lower case without accents, punctuation and up to three corporate suffixes."""
    n = F.trim(name)
    for _ in range(3):
        n = F.regexp_replace(n, SUFFIXES, "")
    n = F.translate(F.lower(n), "àâäáçéèêëíîïñóôöúùûü", "aaaaceeeeiiinooouuuu")
    return F.trim(F.regexp_replace(F.regexp_replace(n, r"[^a-z0-9\s]", ""), r"\s+", " "))


def name_words(name: Column) -> Column:
    """Words of over two letters that tell a utility apart."""
    common = F.array(*map(F.lit, COMMON_WORDS))
    return F.array_distinct(F.filter(F.split(plain_utility(name), " "), lambda w: (F.length(w) > 2) & ~F.array_contains(common, w)))


def contained_names(a: DataFrame, b: DataFrame, gram: int = 5) -> DataFrame:
    """(a, b): names of a and b (one column each, distinct) one of which contains the other.

    The shorter name's first ``gram`` characters, or all of a shorter one, are among the grams of the longer name, so the
    join is an equality on grams that is verified, and not a product. Empty and null names are contained in nothing.
    """
    a, b = (x.toDF("name").where("name <> ''") for x in (a, b))
    grams = lambda n: F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.lit(gram)), lambda k: F.when(F.char_length(n) >= k, F.transform(F.sequence(F.lit(1), F.char_length(n) - k + 1), lambda i: F.substring(n, i, k))).otherwise(F.array().cast("array<string>")))))
    head = lambda x, name: x.select(F.col("name").alias(name), F.substring("name", 1, gram).alias("gram"))
    inside = lambda x, name: x.select(F.col("name").alias(name), F.explode(grams(F.col("name"))).alias("gram"))
    up = head(a, "a").join(inside(b, "b"), "gram").where(F.contains("b", "a"))
    down = head(b, "b").join(inside(a, "a"), "gram").where(F.contains("a", "b"))
    return up.select("a", "b").union(down.select("a", "b")).distinct()


def resolve_utilities(records: DataFrame, utilities: DataFrame, key: str = "label") -> DataFrame:
    """(key, utility_id, how) by number, exact name, plain name, then containment of plain names either way (the smallest id); records without a match have nulls.

    records: key, eiaid, utility; utilities: id, eia_id, name. The last stage compares the distinct names that are left.
    """
    u = utilities.select(F.col("id").alias("uid"), "eia_id", F.col("name").alias("uname"), plain_utility(F.col("name")).alias("uplain"))
    r = records.select(key, "eiaid", "utility", plain_utility(F.col("utility")).alias("plain"))
    least = lambda c: u.groupBy(c).agg(F.min("uid").alias("m"))
    out = r.join(least("eia_id").toDF("eiaid", "number"), "eiaid", "left").join(least("uname").toDF("utility", "name"), "utility", "left")
    out = out.join(least("uplain").where("uplain <> ''").toDF("plain", "same"), "plain", "left")
    left = out.where("coalesce(number, name, same) is null").select("plain").distinct()
    near = contained_names(left, u.select("uplain").distinct()).join(least("uplain").toDF("b", "m"), "b").groupBy(F.col("a").alias("plain")).agg(F.min("m").alias("inside"))
    out = out.join(near, "plain", "left")
    how = F.when(F.col("number").isNotNull(), "number").when(F.col("name").isNotNull(), "name").when(F.col("same").isNotNull(), "plain").when(F.col("inside").isNotNull(), "inside")
    return out.select(key, F.coalesce("number", "name", "same", "inside").alias("utility_id"), how.alias("how"))


def territory_owners(territories: DataFrame, utilities: DataFrame) -> DataFrame:
    """(territory_id, utility_id) by name without regard to case; else the first utility, by id, whose name contains the territory's; null without one."""
    t = territories.select(F.col("id").alias("territory_id"), F.lower("name").alias("low"))
    u = utilities.groupBy(F.lower("name").alias("ulow")).agg(F.min("id").alias("uid"))
    exact = t.join(u, t.low == u.ulow, "left").select("territory_id", "low", F.col("uid").alias("same"))
    wanted = exact.where("same is null").select("low").distinct()
    holds = contained_names(wanted, u.select("ulow")).where(F.contains("b", "a")).join(u, F.col("b") == F.col("ulow")).groupBy(F.col("a").alias("low")).agg(F.min("uid").alias("near"))
    return exact.join(holds, "low", "left").select("territory_id", F.coalesce("same", "near").alias("utility_id"))


def missing_utilities(found: DataFrame, known: DataFrame) -> DataFrame:
    """Found names that are no known utility's, exactly or plain (where both plain names are over six characters long)."""
    f = found.select("name", F.lower("name").alias("low"), plain_utility(F.col("name")).alias("plain"))
    k = known.select(F.lower("name").alias("low"), plain_utility(F.col("name")).alias("plain"))
    f = f.join(k.select("low"), "low", "left_anti")
    return f.join(k.where(F.length("plain") > 6).select("plain"), "plain", "left_anti").select("name")


def blocked(rows: DataFrame, url: str, domains: DataFrame) -> DataFrame:
    """rows with is_blocked: the host is a domain of the list (column domain) or a subdomain of one."""
    hosts = rows.select(X.host(F.col(url)).alias("_host")).distinct()
    hits = hosts.select("_host", F.explode(X.host_suffixes(F.col("_host"))).alias("domain")).join(domains.select("domain"), "domain", "left_semi").select("_host").distinct().withColumn("_hit", F.lit(True))
    return rows.withColumn("_host", X.host(F.col(url))).join(hits, "_host", "left").withColumn("is_blocked", F.coalesce("_hit", F.lit(False))).drop("_host", "_hit")


def best_url(utilities: DataFrame, tariffs: DataFrame) -> DataFrame:
    """(id, url): the source url of a utility's newest tariff that has one, else its website."""
    newest = tariffs.where("source_url is not null and source_url <> ''").groupBy(F.col("utility_id").alias("id")).agg(F.max_by("source_url", F.struct("updated_at", "source_url")).alias("newest"))
    return utilities.join(newest, "id", "left").select("id", F.coalesce("newest", "website_url").alias("url"))


def own_domain(results: DataFrame, names: DataFrame, domains: DataFrame) -> DataFrame:
    """(utility_id, host) of the first search result (utility_id, position, url) that is not blocked and whose host's first label holds a word of the name or its first six letters."""
    rows = blocked(results, "url", domains).where("not is_blocked").join(names.select("utility_id", name_words(F.col("name")).alias("words"), F.substring(F.regexp_replace(F.lower("name"), "[^a-z]", ""), 1, 6).alias("head")), "utility_id")
    label = F.split_part(X.host(F.col("url")), F.lit("."), F.lit(1))
    fits = F.exists("words", lambda w: F.contains(label, w)) | ((F.length("head") == 6) & F.contains(label, F.col("head")))
    return rows.where(fits).groupBy("utility_id").agg(F.min_by(X.host(F.col("url")), "position").alias("host"))


def score_results(results: DataFrame, states: dict[str, str]) -> DataFrame:
    """results (url, title, description, domain, utility, state, is_blocked) with a score: weighted hits in path, title and description; -999 for blocked hosts and comparison pages."""
    url, p, text = F.col("url"), F.lower(X.path(F.col("url"))), F.lower(F.concat_ws(" ", "title", "description"))
    points = lambda hit, n: F.when(F.coalesce(hit, F.lit(False)), n).otherwise(0)
    domain = F.lower("domain")
    score = points((X.host(url) == domain) | F.endswith(X.host(url), F.concat(F.lit("."), domain)), 50)
    for word, n in (("rate", 15), ("pricing", 15), ("electric", 15), ("residential", 10), ("tariff", 3)):
        score = score + points(p.contains(word), n)
    score = score + points(p.rlike("commercial|business"), 5) + points(p.rlike(r"regulatory|submission|filing|bcuc|puc\.|docket"), -15) + points(p.endswith(".pdf"), -30)
    for word in ("rate", "electric", "residential", "commercial", "pricing"):
        score = score + points(text.contains(word), 3)
    score = score + points(text.contains("tariff") & ~text.contains("rate"), -5)
    words = name_words(F.col("utility"))
    hits = F.size(F.filter(words, lambda w: F.contains(text, w)))
    score = score + F.when(F.size(words) == 0, 0).when(hits >= 2, 25).when((hits == 1) & (F.size(words) <= 2), 15).when(hits == 0, -10).otherwise(0)
    score = score + points(X.is_explainer(url, F.col("title")), -30) + points(X.is_homepage(url), -30) + points(wrong_state(url, F.col("state"), states), -40) + points(X.is_superseded(url, F.concat_ws(" ", "title", "description")), -50)
    return results.withColumn("score", F.when(F.col("is_blocked") | X.is_comparison_page(url, F.col("title")), -999).otherwise(score))


def ranked_results(results: DataFrame, states: dict[str, str]) -> DataFrame:
    """results with their score and place in their utility's list (utility_id): best score first, of equal ones the earlier result (position); blocked ones are left out."""
    scored = score_results(results, states).where("score > -999")
    return scored.withColumn("place", F.row_number().over(Window.partitionBy("utility_id").orderBy(F.desc("score"), "position")))


def wrong_state(url: Column, state: Column, states: dict[str, str]) -> Column:
    """Whether a url names another state than the given one: by a two-letter code that is a whole path part or host label, or by a full name between separators.

    states: full names by code. A url that also spells out the given state's name is not wrong by names; without a known state nothing is.
    """
    code = F.coalesce(
        F.when(F.length(F.trim(state)) == 2, F.lower(F.trim(state))),
        F.element_at(F.create_map(*[F.lit(x) for c, name in states.items() for x in (name.replace(" ", ""), c.lower())]), F.regexp_replace(F.lower(F.trim(state)), "[ -]", "")),
    )
    labels = F.split(F.lower(X.host(url)), r"\.")
    tokens = F.concat(F.split(F.lower(X.path(url)), "/"), F.slice(labels, F.lit(1), F.greatest(F.size(labels) - 1, F.lit(0))))
    codes = F.array(*[F.lit(c.lower()) for c in states])
    other = F.size(F.filter(F.array_intersect(tokens, codes), lambda c: c != code)) > 0
    spelt = lambda name: F.lower(url).rlike(rf"(?:^|[/\-_.]){name.lower().replace(' ', '-')}(?:$|[/\-_.])")
    named, own = F.lit(False), F.lit(False)
    for c, name in states.items():
        named = named | ((code != c.lower()) & spelt(name))
        own = own | ((code == c.lower()) & spelt(name))
    return F.coalesce(other | (named & ~own), F.lit(False))


def url_rewrites(sources: DataFrame, paths: list[str]) -> DataFrame:
    """(source_id, prio, url): other spellings of a url worth trying: other scheme, no query, www or not, the root, common paths.

    A url's own spellings are told apart in its row; only sources with several rows are grouped.
    """
    url, h = F.col("url"), F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1)
    bare = F.regexp_replace(url, r"[?#].*$", "")
    root = F.concat(F.regexp_extract(url, r"^([a-z]+://)", 1), h)
    www = F.when(h.startswith("www."), F.replace(url, F.lit("://www."), F.lit("://"))).otherwise(F.replace(url, F.lit("://"), F.lit("://www.")))
    swap = F.when(url.startswith("https:"), F.replace(url, F.lit("https:"), F.lit("http:"))).otherwise(F.replace(url, F.lit("http:"), F.lit("https:")))
    tries = F.array(swap, bare, www, F.concat(root, F.lit("/")), *[F.concat(root, F.lit(p)) for p in paths])
    rows = sources.select("source_id", "url").repartition("source_id").withColumn("_n", F.count("*").over(Window.partitionBy("source_id")))
    rows = rows.select("source_id", F.col("url").alias("_old"), "_n", tries.alias("_tries"))
    numbered = F.transform("_tries", lambda u, k: F.struct(u.alias("url"), k.alias("prio")))
    kept = F.filter(numbered, lambda t: (t["url"] != F.col("_old")) & (F.array_position("_tries", t["url"]) == t["prio"] + 1))
    several = rows.where("_n > 1").select("source_id", F.inline(kept)).groupBy("source_id", "url").agg(F.min("prio").alias("prio"))
    return rows.where("_n = 1").select("source_id", F.inline(kept)).unionByName(several)


def foreign_names(tariffs: DataFrame, markers: list[str]) -> DataFrame:
    """tariffs (id, name, utility) with foreign: the first marker of the list that the name holds is no part of the utility's name. The list is short and fixed, so it is part of the expression."""
    name, utility = F.lower(F.coalesce("name", F.lit(""))), F.lower("utility")
    held = F.lit(None)
    for m in reversed(markers):
        held = F.when(name.contains(m), m).otherwise(held)
    return tariffs.withColumn("foreign", F.coalesce(~F.contains(utility, held), F.lit(False)))


# Words that say little about whose page it is, and why a page is taken for another's.
PLAIN_WORDS = "of the and for in at by to a an city town village county electric power light energy utility utilities service services dept department board commission authority".split()
COMPANY_SUFFIXES = r"(?i)\s+(Co|Corp|Inc|LLC|LLP|Ltd|Company|Corporation|Incorporated|Assn|Assoc|Association|Member|Coop|PLC|LP|PA|NA)\.?$"
REASONS = {
    "other_states": "Page mentions %d other states more than target state (%s) and domain doesn't match — likely cross-contamination.",
    "nothing_fits": "Page content does not mention the utility name (%s), state (%s), and pages are from a different domain. Likely cross-contamination.",
    "no_mention": "Page content does not mention the utility name (%s) or state (%s). Possible cross-contamination.",
    "state_only": "Page mentions target state (%s) but utility name (%s) not found and domain doesn't match — possible cross-contamination.",
}
#: States and provinces whose names are looked for; Iowa, Yukon and the territories are not among them.
NAMED_STATES = {code: name for name, code in L.US_STATES.items() if code != "IA"} | {code: "newfoundland" if code == "NL" else name for name, code in L.CA_PROVINCES.items() if code not in ("YT", "NT", "NU")}
WORDS_AT_ONCE = 60


def own_words(name: Column) -> Column:
    """Words of over two letters of a name without corporate suffixes, in their order, but for those that many names have."""
    n = name
    for _ in range(3):
        n = F.rtrim(F.trim(F.regexp_replace(n, COMPANY_SUFFIXES, "")), F.lit(","))
    plain = F.array(*map(F.lit, PLAIN_WORDS))
    return F.filter(F.split(F.trim(F.lower(n)), r"\s+"), lambda w: (F.char_length(w) > 2) & ~F.array_contains(plain, w))


def identity_verdicts(utilities: DataFrame, pages: DataFrame) -> DataFrame:
    """utility_id, n_words, hits, other_states, is_own, code, reason: whether the pages fetched for each utility are its own.

    utilities: utility_id, name, state, domain (null where none is known); pages: utility_id, url, title, content. Over all pages of a
    utility, whole, it is counted how many words of its name they hold (as parts of words too); where hosts, paths and titles
    hold two of them, or one of a name of at most two, these count if they are more. With three tenths of the words or two, or any
    at all, the pages are its own. Else code says why not: its state is named but three others too and no page is of its
    domain; neither name nor state is named, with or without its domain; its state alone is named and no page is of its domain. A page
    is of a domain on it, below it, or with the same last two labels; without a known domain all are. Utilities without
    words, pages or content are taken as they are.

    Per page the hits are bits of a number (names in parts of WORDS_AT_ONCE words), so the pages of a utility are combined before they
    are shuffled. State names are a short fixed list and part of the expression. Null texts are empty; null utility ids meet nothing.
    """
    u = utilities.select("utility_id", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("state", F.lit("")).alias("state"), F.replace(F.lower("domain"), F.lit("www."), F.lit("")).alias("domain"))
    u = u.withColumn("words", own_words(F.col("name")))
    codes = F.create_map(*[F.lit(x) for k, code in enumerate(NAMED_STATES) for x in (code, k)])
    full = F.create_map(*[F.lit(x) for code, name in NAMED_STATES.items() for x in (code, name)])
    u = u.withColumns({"own_": F.coalesce(F.pow(F.lit(2.0), codes[F.upper("state")]).cast("bigint"), F.lit(0).cast("bigint")), "full_": F.coalesce(full[F.upper("state")], F.lower("state"))})
    site = F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    p = pages.select("utility_id", F.lower(F.coalesce("content", F.lit(""))).alias("body"), F.lower(F.concat_ws(" ", site, X.path(F.coalesce("url", F.lit(""))), F.coalesce("title", F.lit("")))).alias("head"), F.replace(F.lower(site), F.lit("www."), F.lit("")).alias("site"))
    rows = p.join(u.select("utility_id", "words", "state", "full_", "domain"), "utility_id")
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.size("words") / WORDS_AT_ONCE) - 1, F.lit(0)).cast("int"))))
    some = F.slice("words", F.col("part") * WORDS_AT_ONCE + 1, F.lit(WORDS_AT_ONCE))
    bits = lambda where, of: F.aggregate(F.transform(of, lambda w, k: F.when(F.contains(where, w), F.pow(F.lit(2.0), k).cast("bigint")).otherwise(0)), F.lit(0).cast("bigint"), lambda a, x: a.bitwiseOR(x))
    base = lambda d: F.array_join(F.slice(F.split(d, r"\."), F.greatest(F.size(F.split(d, r"\.")) - 1, F.lit(1)), F.lit(2)), ".")
    fits = (F.col("site") == F.col("domain")) | F.endswith(F.col("site"), F.concat(F.lit("."), F.col("domain"))) | (base(F.col("site")) == base(F.col("domain")))
    states = F.lit(0).cast("bigint")
    for k, name in enumerate(NAMED_STATES.values()):
        states = states + F.when(F.contains("body", F.lit(name)), F.lit(1 << k)).otherwise(F.lit(0)).cast("bigint")
    first = F.col("part") == 0
    seen = rows.select(
        "utility_id", "part", bits(F.col("body"), some).alias("body_"), bits(F.col("head"), some).alias("head_"), F.when(first, states).otherwise(0).alias("states_"),
        (F.contains("body", F.lower("state")) | F.contains("body", "full_")).alias("state_"), (F.col("body") != "").alias("text_"), (F.col("site") != "").alias("site_"), ((F.col("site") != "") & F.coalesce(fits, F.lit(False))).alias("fits_"),
    )
    flags = [F.bool_or(c).alias(c) for c in ("state_", "text_", "site_", "fits_")]
    per = seen.groupBy("utility_id", "part").agg(F.bit_or("body_").alias("body_"), F.bit_or("head_").alias("head_"), F.bit_or("states_").alias("states_"), *flags)
    per = per.groupBy("utility_id").agg(F.sum(F.bit_count("body_")).alias("in_body"), F.sum(F.bit_count("head_")).alias("in_head"), F.bit_or("states_").alias("states_"), *flags)
    out = u.join(per, "utility_id", "left").withColumn("n_words", F.size("words"))
    rescued = (F.col("in_head") >= 2) | ((F.col("in_head") >= 1) & (F.col("n_words") <= 2))
    out = out.withColumn("hits", F.when(rescued, F.greatest("in_body", "in_head")).otherwise(F.coalesce("in_body", F.lit(0))))
    out = out.withColumn("other_states", F.bit_count(F.coalesce("states_", F.lit(0)).bitwiseAND(F.bitwise_not("own_"))))
    judged = (F.col("n_words") > 0) & F.coalesce("text_", F.lit(False)) & (F.col("hits") == 0)
    abroad = F.col("domain").isNotNull() & (F.col("domain") != "") & F.col("site_") & ~F.col("fits_")
    code = F.when(F.col("state_") & (F.col("other_states") >= 3) & abroad, "other_states").when(~F.col("state_") & abroad, "nothing_fits").when(~F.col("state_"), "no_mention").when(abroad, "state_only")
    out = out.withColumn("code", F.when(judged, code))
    said = {"other_states": ("other_states", "state"), "nothing_fits": ("name", "state"), "no_mention": ("name", "state"), "state_only": ("state", "name")}
    reason = F.lit("")
    for c, cols in said.items():
        reason = F.when(F.col("code") == c, F.format_string(REASONS[c], *cols)).otherwise(reason)
    return out.select("utility_id", F.col("n_words").cast("bigint").alias("n_words"), F.col("hits").cast("bigint").alias("hits"), F.col("other_states").cast("bigint").alias("other_states"), F.col("code").isNull().alias("is_own"), "code", reason.alias("reason"))


def alternate_order(pages: DataFrame) -> DataFrame:
    """pages (utility_id, url, rank) with place: hosts not seen before first, then unseen path sections (first two parts), then rank."""
    section = F.array_join(F.slice(F.split(X.path(F.col("url")), "/"), 2, 2), "/")
    rows = pages.withColumns({"_host": X.host(F.col("url")), "_section": section})
    first = lambda *keys: F.row_number().over(Window.partitionBy("utility_id", *keys).orderBy("rank")) == 1
    rows = rows.withColumns({"_h": first("_host"), "_s": first("_host", "_section")})
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("utility_id").orderBy(F.desc("_h"), F.desc("_s"), "rank"))).drop("_host", "_section", "_h", "_s")
