"""Jobs over page bodies: links, tables, rate windows, gates."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattgrid.functions import text as X

LINK = r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a>"""
# Words that make a link or page relevant, or not.
RATE_PAGES = r"(?i)rate|tariff|pricing|schedule|electric.*charge|billing.*rate|residential.*rate|commercial.*rate|general.*service|small.*business|fee.*schedule|cost.*service|price.*electricity"
STRONG = r"(?i)electricity.rate|electric.rate|residential.rate|commercial.rate|business.rate|rate.schedule|rate.tariff"
SKIP = (
    r"(?i)irrigation|fleet.*electrif|shore.*power|street.*light|unmetered|transmission.*rate|industrial|large.*power|large.*general|large.*service|interruptible|standby|wholesale|interconnect|wheeling|curtailment|generation|"
    r"supplement.*\d{2,}|lighting|outdoor.*light|area.*light|security.*light|pumping|mining|smelting|data.center|high.voltage|primary.*service|subtransmission"
)
TITLES = r"(?i)\brate[s]?\b|\btariff|\bpricing|\bbilling.*rate|\bschedule\b|\belectric.*charge|\bresidential.*service|\bgeneral.*service|\bcost.*electric|\belectricity.*cost"
CONTENT = (
    r"(?i)\$/kwh|cents/kwh|per kwh|\bkwh\b.*\d|\$/kw[^h]|\$/month|\bcharge\b.*\$|\$.*\bcharge\b|rate.*schedule|schedule.*rate|energy charge|demand charge|service charge|basic charge|customer charge|delivery charge|"
    r"residential.*rate|commercial.*rate|general.*service|tier\s*[12]|step\s*[12]|block\s*[12]|on.peak|off.peak|shoulder|summer.*rate|winter.*rate|seasonal"
)
NUMERIC = r"(?i)\$\s*\d+\.\d{2,4}|\d+\.\d+\s*(?:cents|¢)|\d+\.\d+\s*/\s*kwh|\d+\.\d+\s*/\s*kw\b|\$\d+\s*/\s*month"
COMPLEX = r"(?i)tier|step|block|on.peak|off.peak|shoulder|summer|winter|seasonal|schedule\s+[a-z]|rate\s+[a-z]"
RELEVANT = r"(?i)rate|tariff|pricing|schedule|residential|commercial|billing"
FIRST = r"(?i)residential.*rate|rate.*schedule|tariff"
DROPPED = ["script", "style", "nav", "footer", "header", "noscript", "iframe"]
REFERENCES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]
SIGNAL = r"(?i)\$\s*\d|\bkwh\b|cents per"
HOME_SIGNAL = r"(?i)\bdomestic\b|residential\s+(?:service|rate|customer)|rate\s+no\.\s*1|schedule\s+(?:r|rs|d|ds)\b|\b[12]\.\d\s+domestic\b"
PER_UNIT = r"(?i)per\s+(?:month|kWh|kW)|\$/\s*(?:kWh|kW|day|month)|¢/\s*kWh"
SPACES = [(r"\n{3,}", "\n\n"), (r"[ \t]{4,}", "  "), (r"(?:\n\s*){3,}", "\n\n")]


def links(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, place, target, label, priority) of the links to the page's own site; relative targets are completed, fragments cut; of equal targets the first.

    priority: 0 for rate schedules, 1 for other relevant links, 2 for documents, 3 for the rest.
    """
    hrefs, labels = F.regexp_extract_all(html_col, F.lit(LINK), 1), F.regexp_extract_all(html_col, F.lit(LINK), 2)
    found = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("base"), F.posexplode(F.arrays_zip(hrefs.alias("href"), labels.alias("label"))).alias("place", "a"))
    root = F.regexp_extract("base", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0)
    href = F.regexp_replace(F.trim("a.href"), r"#.*$", "")
    folder = F.regexp_replace(F.concat(root, X.path(F.col("base"))), r"/[^/]*$", "")
    target = F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(F.lit("https:"), href)).when(href.startswith("/"), F.concat(root, href)).otherwise(F.concat(folder, F.lit("/"), href))
    rows = found.where(href != "").select("page_id", "place", target.alias("target"), F.trim(F.regexp_replace("a.label", r"<[^>]*>", " ")).alias("label"), "base")
    rows = rows.where(X.host(F.col("target")) == X.host(F.col("base")))
    rows = rows.groupBy("page_id", "target").agg(F.min(F.struct("place", "label")).alias("m")).select("page_id", "m.place", "target", "m.label")
    both = F.concat_ws(" ", "target", "label")
    return rows.withColumn("priority", F.when(both.rlike(FIRST), 0).when(both.rlike(RELEVANT), 1).when(F.lower("target").endswith(".pdf"), 2).otherwise(3))


def link_priority(target: Column, label: Column) -> Column:
    """0 for electricity rates, 1 for residential or commercial ones, 2 for other rates, 3 for the rest."""
    both = F.lower(F.concat_ws(" ", target, label))
    rate = both.contains("rate")
    return F.when(rate & both.contains("electricity"), 0).when(rate & (both.contains("residential") | both.contains("commercial")), 1).when(rate, 2).otherwise(3)


def relevant_links(found: DataFrame, pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rate_pages: str = RATE_PAGES, skip: str = SKIP, titles: str = TITLES) -> DataFrame:
    """Of links (page_id, place, target, label) those worth a visit, with priority and whether they are superseded.

    A link counts if it is no homepage, looks like rates, is of no skipped kind, and, unless it speaks of rates strongly, of no
    irrelevant one. On pages whose title or url is about rates, or whose text has signs of them, all PDFs of the site count too.
    Regulators' filings never do.
    """
    title = F.regexp_extract(html_col, r"(?is)<title[^>]*>(.*?)</title", 1)
    themed = pages.select(F.col(id_col).alias("page_id"), (F.concat_ws(" ", title, url_col).rlike(titles) | F.coalesce(F.col(html_col).rlike(CONTENT), F.lit(False))).alias("themed"))
    both = F.concat_ws(" ", "target", "label")
    good = ~X.is_homepage(F.col("target")) & (both.rlike(STRONG) | ~both.rlike(X.IRRELEVANT)) & both.rlike(rate_pages) & ~both.rlike(skip)
    rows = found.join(themed, "page_id").where(good | (F.col("themed") & F.lower("target").endswith(".pdf")))
    rows = rows.where(~X.is_filing(F.col("target"), F.col("label"))).drop("themed", "priority")
    return rows.withColumns({"priority": link_priority(F.col("target"), F.col("label")), "superseded": X.is_superseded(F.col("target"), F.col("label"))})


def has_rates(text: Column, title: Column, url: Column, content: str = CONTENT, titles: str = TITLES) -> Column:
    """Whether a page likely holds rates: by its text, else by its title or url."""
    yes = lambda c, p: F.coalesce(c.rlike(p), F.lit(False))
    return yes(text, content) | yes(title, titles) | yes(url, titles)


def has_numbers(text: Column) -> Column:
    """Whether a text holds an amount in the form of a rate."""
    return F.coalesce(text.rlike(NUMERIC), F.lit(False))


def kept_pages(pages: DataFrame, doc_cols: list[str], text_col: str) -> DataFrame:
    """Pages of each document that are worth reading: those of priority 0; where these are under 3, up to 1; where none are, up to 2; else all."""
    ranked = pages.withColumn("priority", X.page_priority(F.coalesce(text_col, F.lit(""))))
    upto = lambda p: F.count_if(F.col("priority") <= p)
    most = ranked.groupBy(*[F.col(c).alias(f"{c}_doc") for c in doc_cols]).agg(F.when(upto(0) >= 3, 0).when(upto(1) > 0, 1).when(upto(2) > 0, 2).otherwise(3).alias("most"))
    same = F.lit(True)
    for c in doc_cols:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_doc"))
    return ranked.join(most, same & (F.col("priority") <= F.col("most")), "left_semi")


def capped_links(found: DataFrame, first: int = 15) -> DataFrame:
    """The first links of each page by priority, superseded ones last; the cap is the crawl's own budget per page."""
    from wattgrid.operators.relational import latest

    old = F.concat_ws(" ", "target", "label").rlike("(?i)superseded|cancelled|historical|archive")
    return latest(found, ["page_id"], [old.cast("int"), F.col("priority"), F.col("place")], first)


def gate(url: Column, text: Column, is_blocked: Column, title: Column | None = None, thin: int = 100, skip: str = SKIP, content: str = CONTENT, titles: str = TITLES) -> Column:
    """Why a page is not sent on, or sent: blocked host, thin text, words to skip in url or title, no sign of rates."""
    title = F.lit("") if title is None else title
    short = F.char_length(F.trim(F.coalesce(text, F.lit("")))) < thin
    skipped = F.concat_ws(" ", url, title).rlike(skip)
    return F.when(is_blocked, "blocked").when(short, "thin").when(skipped, "irrelevant").when(~has_rates(text, title, url, content, titles), "no signal").otherwise("sent")


def deepest_first(pages: DataFrame, keys: list[str], url_col: str, id_col: str) -> DataFrame:
    """pages with their place per key: most steps in the path first, of equal ones the smaller id."""
    depth = F.char_length(F.regexp_replace(X.path(F.col(url_col)), "[^/]", ""))
    return pages.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(depth), id_col)))


def is_complex(text: Column, least_chars: int = 8000, least_signals: int = 5) -> Column:
    return (F.char_length(text) >= least_chars) & (F.regexp_count(text, F.lit(COMPLEX)) >= least_signals)


#: Fixed value: what stands where text is left out.
LEFT_OUT = "[...document truncated...]"
BLOCK, NEAR = 500, 2500


def _signal_places(texts: pd.Series) -> pd.Series:
    """Where each text's residential signals begin that have an amount and a unit in the next NEAR characters."""
    amount, unit = re.compile(X.RATE_AMOUNTS), re.compile(PER_UNIT)
    follows = lambda t, a: all(sign.search(t, a, a + NEAR) for sign in (amount, unit))
    return texts.map(lambda t: [m.start() for m in re.finditer(HOME_SIGNAL, t) if follows(t, m.start())])


def _block_scores(texts: DataFrame) -> DataFrame:
    """(key, block, score): how much each block of a text says of rates: amounts 3, rate words 2, schedules 2."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / BLOCK).cast("int")), lambda k: F.substring("text", k * BLOCK + 1, F.lit(BLOCK)))
    rows = texts.select("key", F.posexplode(blocks).alias("block", "b"))
    score = sum((F.when(F.col("b").rlike(sign), n).otherwise(0) for sign, n in ((X.RATE_AMOUNTS, 3), (X.RATE_WORDS, 2), (X.RATE_SCHEDULES, 2))), F.lit(0))
    return rows.select("key", "block", score.alias("score"))


def _spans(texts: DataFrame, budget: int) -> DataFrame:
    """(key, a, b, to): the parts of each text (key, text, size, room) that are kept, and how far parts would reach if there were room for all.

    Without signals: the run of whole blocks with the largest sum of scores, all if they have room. With signals over 10,000 characters apart, or more room than
    ``budget``: from 10,000 characters before the first. Else 1,000 characters before and 6,000 behind each, joined where they are
    at most 500 apart, as far as the room goes with the marks between them; a cut part has over 500 characters.
    """
    from wattgrid.operators.relational import best_span

    at = texts.select("key", "size", "room", F.explode(F.pandas_udf(_signal_places, "array<int>")("text")).alias("at"))
    ends = at.groupBy("key").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    met = texts.select("key", "size", "room").join(ends, "key", "left")
    wide = F.col("first").isNotNull() & ((F.col("last") - F.col("first") > 10_000) | (F.col("room") > budget))
    start = F.greatest(F.col("first") - 10_000, F.lit(0))
    one = met.where(wide).select("key", start.alias("a"), F.least("size", start + F.col("room")).alias("b"), F.least("size", start + F.col("room")).alias("to"))

    plain = met.where("first is null")
    scores = _block_scores(texts.join(plain.select("key"), "key", "left_semi")).join(plain.select("key", "room", "size"), "key")
    width = F.floor(F.col("room") / BLOCK)
    dense = plain.where(width * BLOCK >= F.col("size")).select("key", F.lit(0).alias("a"), F.col("size").alias("b"), F.col("size").alias("to"))
    for room in (budget, 3 * budget):
        n = room // BLOCK
        whole = scores.where((F.col("room") == room) & (F.col("size") > n * BLOCK))
        best = best_span(whole, "key", "block", F.col("score"), n, last=F.floor((F.col("size") - 1) / BLOCK) + 1 - n).join(plain.select("key", "size"), "key")
        begin = F.col("first") * BLOCK
        dense = dense.union(best.select("key", begin.alias("a"), F.least("size", begin + room).alias("b"), F.least("size", begin + room).alias("to")))

    order = Window.partitionBy("key").orderBy("at")
    tight = at.join(met.where("first is not null").where(~wide).select("key"), "key", "left_semi").select("key", "room", "at", F.greatest(F.col("at") - 1000, F.lit(0)).alias("a"), F.least("size", F.col("at") + 6000).alias("b"))
    reached = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    isles = tight.withColumn("new", F.coalesce((F.col("a") > reached + 500).cast("int"), F.lit(1))).withColumn("isle", F.sum("new").over(order))
    isles = isles.groupBy("key", "isle").agg(F.first("room").alias("room"), F.min("a").alias("a"), F.max("b").alias("b"))
    by = Window.partitionBy("key").orderBy("isle")
    mark = len(LEFT_OUT) + 4
    left = F.col("room") - F.coalesce(F.sum(F.col("b") - F.col("a") + mark).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = isles.select("key", "a", "b", left.alias("left"), F.max("b").over(Window.partitionBy("key")).alias("to"))
    kept = kept.where((F.col("left") >= F.col("b") - F.col("a")) | (F.col("left") > 500)).select("key", "a", F.least("b", F.col("a") + F.col("left")).alias("b"), "to")
    return one.union(dense).union(kept)


def rate_windows(docs: DataFrame, id_col: str, text_col: str, budget: int = 30_000, long: int = 50_000) -> DataFrame:
    """(id, chars, kept, window): the parts of each text, runs of white space shortened, that say most about residential rates, in order; whole if it fits the budget, which is tripled for texts over ``long`` characters.

    Which parts are kept is decided over rows of places and blocks (_spans); only texts over the budget take part, and are written once.
    Marks stand where text is left out: before, between and behind parts. Null texts are empty; ids are passed on.
    """
    from wattgrid.functions.scratch import Scratch

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    short = text
    for pattern, shorter in SPACES:
        short = F.regexp_replace(short, pattern, shorter)
    rows = docs.select(F.col(id_col).alias("id"), F.char_length(text).cast("bigint").alias("chars"), F.trim(short, F.lit(" \t\n\x0b\f\r")).alias("text")).withColumn("size", F.char_length("text"))
    fits = rows.where(F.col("size") <= budget).select("id", "chars", F.col("size").cast("bigint").alias("kept"), F.col("text").alias("window"))
    over = rows.where(F.col("size") > budget).withColumns({"key": F.monotonically_increasing_id(), "room": F.when(F.col("size") > long, 3 * budget).otherwise(budget)})
    over = Scratch(docs.sparkSession, "windows").cut(over)
    parts = _spans(over.select("key", "text", "size", "room"), budget).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("parts"), F.max("to").alias("to"))
    said = F.array_join(F.transform("parts", lambda p: F.substring("text", p["a"] + 1, p["b"] - p["a"])), f"\n\n{LEFT_OUT}\n\n")
    before, behind = F.when(F.col("parts")[0]["a"] > 0, f"{LEFT_OUT}\n").otherwise(""), F.when(F.col("to") < F.col("size"), f"\n{LEFT_OUT}").otherwise("")
    cut = over.join(parts, "key").withColumn("window", F.concat(before, said, behind))
    return fits.union(cut.select("id", "chars", F.char_length("window").cast("bigint"), "window"))


def dollars(text: Column) -> Column:
    """A rate in cents or dollars, with thousands separators, in dollars to five places; null outside 0 to 1."""
    number = F.regexp_replace(F.regexp_extract(text, r"([\d,]*\.?\d+)", 1), ",", "").try_cast("double")
    value = F.round(F.when(text.rlike(r"(?i)¢|cent"), number / 100).otherwise(number), 5)
    return F.when(value.between(0, 1), value)


def effective_date(text: Column) -> Column:
    """The date after 'effective', as 'January 1, 2024', with the month's first letters alone, or ISO."""
    word = r"(?i)effective\D{0,20}?([A-Z][a-z]{2})[a-z]*\.? (\d{1,2}),? (\d{4})"
    parts = F.concat_ws(" ", F.initcap(F.regexp_extract(text, word, 1)), F.regexp_extract(text, word, 2), F.regexp_extract(text, word, 3))
    iso = F.regexp_extract(text, r"(?i)effective\D{0,20}?(\d{4}-\d{2}-\d{2})", 1)
    return F.coalesce(F.try_to_timestamp(F.nullif(F.trim(parts), F.lit("")), F.lit("MMM d yyyy")).cast("date"), F.nullif(iso, F.lit("")).try_cast("date"))


def term_changes(old: Column, new: Column, sample: int = 10) -> Column:
    """What a new preview adds and drops, up to ``sample`` sorted words each.

    Words, and those added and removed, are bound as the one element of an array: each text is split once.
    """
    once = lambda c, f: F.get(F.transform(F.array(c), f), F.lit(0))
    words = lambda c: F.split(F.coalesce(c, F.lit("")), r"\s+")
    few = lambda x: F.array_join(F.slice(F.sort_array(x), 1, sample), ", ")
    told = lambda d: F.concat_ws("; ", F.when(F.size(d["added"]) > 0, F.concat(F.lit("New terms: "), few(d["added"]))), F.when(F.size(d["removed"]) > 0, F.concat(F.lit("Removed terms: "), few(d["removed"]))))
    apart = lambda w: F.struct(F.array_except(w["b"], w["a"]).alias("added"), F.array_except(w["a"], w["b"]).alias("removed"))
    said = once(F.struct(words(old).alias("a"), words(new).alias("b")), lambda w: once(apart(w), told))
    said = once(said, lambda s: F.when(s != "", s).otherwise("Content changed (details in full diff)"))
    return F.when(old.isNull() | (old == ""), "Initial check - no previous content to compare").when(new.isNull() | (new == ""), "Content became unavailable").otherwise(said)


def request_tier(text: Column, is_pdf: Column, first_found: Column | None = None) -> Column:
    """B for documents and complex pages, else A; after a first try that found nothing (first_found 0) C where the text holds amounts, else none."""
    tier = F.when(is_pdf | is_complex(text), "B").otherwise("A")
    return tier if first_found is None else F.when(first_found > 0, "done").when(has_numbers(text), "C").otherwise("none")


def thresholds(text: Column) -> Column:
    """Struct (summer, winter) of the first two numbers of a text; of one number both; 600 and 1000 without any."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([\d,]*\d[\d,]*)"), 1), lambda x: F.regexp_replace(x, ",", "").cast("int"))
    return F.struct(F.coalesce(F.get(found, F.lit(0)), F.lit(600)).alias("summer"), F.coalesce(F.get(found, F.lit(1)), F.get(found, F.lit(0)), F.lit(1000)).alias("winter"))


#: Kinds of rate sets: the heading in a page's text, and the labels of its prices in order.
RATE_SETS = {"tou": ("Time-of-Use", ["Off-Peak", "Mid-Peak", "On-Peak"]), "tiered": ("Tiered rates", ["Lower Tier", "Higher Tier"]), "ulo": ("Ultra-Low", ["Ultra-Low Overnight", "Weekend Off-Peak", "Mid-Peak", "On-Peak"])}


def rate_sets(text: Column) -> Column:
    """Array of (kind, prices in dollars): for each kind the first numbers with one decimal after its heading, in cents; kinds with a missing price are left out."""
    out = []
    for kind, (heading, labels) in RATE_SETS.items():
        gap = r"\s+" if kind != "tiered" else r"\s+.*?"
        pattern = rf"(?is){heading}.*?" + gap.join([r"(\d+\.\d)"] * len(labels))
        prices = F.array(*[dollars(F.concat(F.regexp_extract(text, pattern, k + 1), F.lit(" cents"))) for k in range(len(labels))])
        out.append(F.when(text.rlike(pattern) & ~F.exists(prices, lambda p: p.isNull()), F.struct(F.lit(kind).alias("kind"), prices.alias("prices"))))
    return F.array_compact(F.array(*out))


def tariff_templates(pages: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, customer_class, rate_type, name, label, rate_value) of the rate sets in texts: each set is a tariff for two classes, each price a component."""
    sets = pages.select(F.col(id_col).alias("id"), F.explode(rate_sets(F.coalesce(text_col, F.lit("")))).alias("s"))
    names = F.create_map(*[F.lit(x) for kv in (("tou", "Time-of-Use (TOU)"), ("tiered", "Tiered"), ("ulo", "Ultra-Low Overnight (ULO)")) for x in kv])
    labels = F.create_map(*[x for kind, (_, ls) in RATE_SETS.items() for x in (F.lit(kind), F.array(*map(F.lit, ls)))])
    classes = F.array(F.struct(F.lit("residential").alias("c"), F.lit("Residential").alias("l")), F.struct(F.lit("commercial").alias("c"), F.lit("Small Business").alias("l")))
    rows = sets.select("id", "s.kind", "s.prices", F.explode(classes).alias("k"))
    rows = rows.select("id", "kind", "k", F.posexplode("prices").alias("at", "rate_value"))
    kind = F.when(F.col("kind") == "ulo", "tou").otherwise(F.col("kind"))
    return rows.select("id", F.col("k.c").alias("customer_class"), kind.alias("rate_type"), F.concat(F.element_at(names, F.col("kind")), F.lit(" — "), F.col("k.l")).alias("name"), F.get(F.element_at(labels, F.col("kind")), F.col("at")).alias("label"), "rate_value")


def cache_key(content_hash: Column, model: str, version: str) -> Column:
    return F.sha2(F.concat_ws(":", content_hash, F.lit(model), F.lit(version)), 256)


def cached_results(requests: DataFrame, results: DataFrame, as_of: Column, days: int = 30) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of requests (cache_key): hits with the newest stored result (cache_key, stored_at, result) that is at most ``days`` old."""
    fresh = results.where(F.col("stored_at") >= as_of - F.make_dt_interval(F.lit(days))).groupBy("cache_key").agg(F.max_by("result", "stored_at").alias("result"))
    return requests.join(fresh, "cache_key"), requests.join(fresh.select("cache_key"), "cache_key", "left_anti")


#: What is said of an extraction without results, and of pages that were not sent.
FAILURES = {
    "no_candidates": ("No candidate pages found after visiting rate page", []),
    "no_results": ("No candidate pages found — search returned no usable URLs", []),
    "nothing_sent": ("No pages reached the LLM: %s", ["skipped"]),
    "stopped": ("LLM returned 0 tariffs on all %s pages (aborted early after 5 consecutive 0-extractions)", ["sent"]),
    "all_empty": ("LLM returned 0 tariffs on all %s pages", ["sent"]),
    "all_failed": ("LLM errored on all %s attempts — possible API issue", ["sent"]),
    "invalid": ("Extracted tariffs did not pass validation (%s pages total, %s reached LLM, %s returned 0)", ["pages", "sent", "zero"]),
}
SKIPPED = {"no_signal": "%s pages had no rate content signals", "off_topic": "%s pages were off-topic", "thin": "%s pages had too little content"}
UNFILTERED = "%s pages did not pass filters"


def failure_code(c: dict[str, Column]) -> Column:
    """Where an extraction without results broke off, as a key of FAILURES: the first of these that holds for its counters."""
    none_sent, every = c["sent"] == 0, lambda n: (n > 0) & (n >= c["sent"])
    empty = every(c["zero"]) & (c["zero"] == c["sent"])
    holds = {
        "no_candidates": (c["pages"] == 0) & c["had_page"], "no_results": c["pages"] == 0, "nothing_sent": none_sent, "stopped": empty & c["aborted"],
        "all_empty": empty, "all_failed": every(c["failed"]), "invalid": F.lit(True),
    }
    return F.element_at(F.filter(F.array(*[F.when(F.coalesce(x, F.lit(False)), F.lit(k)) for k, x in holds.items()]), lambda k: k.isNotNull()), 1)


def failure_reason(c: dict[str, Column]) -> Column:
    """failure_code in words, from the counters pages, sent, zero, failed, thin, off_topic, no_signal and, as booleans, had_page and aborted."""
    told = F.concat_ws("; ", *[F.when(c[k] > 0, F.format_string(said, c[k].cast("string"))) for k, said in SKIPPED.items()])
    words = {k: v.cast("string") for k, v in c.items()} | {"skipped": F.when(told == "", F.format_string(UNFILTERED, c["pages"].cast("string"))).otherwise(told)}
    said = F.create_map(*[x for k, (text, of) in FAILURES.items() for x in (F.lit(k), F.format_string(text, *[words[w] for w in of]) if of else F.lit(text))])
    return F.element_at(said, failure_code(c))
