"""URL rules with decisions that travel along redirects and canonical links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattgrid.functions.components import connected_components
from wattgrid.functions.scratch import Scratch

#: Fixed values: (verdict, host, path) of the default rules.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
#: Tags end at a '>' outside quotes. None holds a '<', so every search for an end stops at the next one.
TAGS = r"""(?i)<(?:link|meta)(?=[\s/>])(?:[^>"'<]++|"[^"<]*+"|'[^'<]*+')*+>"""
#: An attribute's name and, perhaps in quotes, its value.
ATTRIBUTE = r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*+"|'[^']*+'|[^\s>"']+))?"""
#: What stands before the target in the content of a refresh.
DELAY = r"(?i)^\s*[0-9.]*\s*[;,]?\s*(?:url\s*=\s*)?"
#: What browsers don't read as mark-up: comments, and elements that hold text only.
UNREAD = r"(?is)<!--.*?(?:-->|\z)|<(script|style|textarea|title|xmp|iframe|noembed|noframes)(?=[\s/>]).*?(?:</\1(?=[\s/>])|\z)"
SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"
#: Character references, what lies between them, and an & alone.
REFERENCE = r"(?s)&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|amp|lt|gt|quot|apos);|[^&]+|&"
WHITE = " \t\n\f\r"
NAMED = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'"}


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; empty without one."""
    return _ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host, up to '?', '#' or the end; empty for a url without '://'."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct (size, rule, verdict) of the longest rule that fits, else null; looks up each suffix of the host in a literal map."""
    by_host: dict[str, list[tuple[str, str]]] = {}
    for verdict, rule_host, rule_path in rules:
        by_host.setdefault(rule_host, []).append((verdict, rule_path))
    if not by_host:
        return F.lit(None).cast("struct<size:int,rule:string,verdict:string>")
    table = F.create_map(*[x for h, found in by_host.items() for x in (F.lit(h), F.array(*[F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"), F.lit(p).alias("path")) for v, p in found]))])
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fits = F.filter(F.flatten(F.filter(F.transform(suffixes, lambda s: F.element_at(table, s)), lambda x: x.isNotNull())), lambda r: path.startswith(r["path"]))
    best = F.array_max(F.transform(fits, lambda r: F.struct(r["size"].alias("size"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))
    return best


def _node(url: Column) -> Column:
    """One spelling of a url: host lower-cased, without fragment; null where it has no host."""
    tail = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(host_of(url) != "", F.concat(host_of(url), F.when(tail == "", F.lit("/")).otherwise(tail)))


def decoded(text: Column) -> Column:
    """text with numeric references and the five named ones of XML decoded, once."""

    def one(x: Column) -> Column:
        digits = lambda pattern: F.regexp_extract(x, pattern, 1)
        code = F.when(x.startswith("&#x") | x.startswith("&#X"), F.conv(digits("^&#[xX]([0-9A-Fa-f]+);$"), 16, 10)).when(x.startswith("&#"), digits("^&#([0-9]+);$")).try_cast("int")
        char = F.when(code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF), F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        named = F.element_at(F.create_map(*[F.lit(v) for pair in NAMED.items() for v in pair]), x)
        return F.coalesce(char, named, x)

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0)), one), "")


def _without_dots(path: Column) -> Column:
    """An absolute path without '.' and '..' steps."""
    steps = F.split(path, "/")
    up = lambda kept: F.when(F.size(kept) > 1, F.slice(kept, F.lit(1), F.size(kept) - 1)).otherwise(kept)
    kept = F.aggregate(steps, F.array().cast("array<string>"), lambda kept, x: F.when(x == "..", up(kept)).when(x == ".", kept).otherwise(F.concat(kept, F.array(x))))
    return F.concat(F.array_join(kept, "/"), F.when(F.element_at(steps, -1).isin(".", ".."), "/").otherwise(""))


def resolved(target: Column, url: Column) -> Column:
    """A target as it stands on the page at url, in full: with a scheme and '//' as it is, else completed from the page's scheme, host, path or folder; null for other schemes, mere fragments and pages without an absolute url. A base element is not looked at."""
    scheme = F.regexp_extract(url, SCHEME + "//", 0)
    base, path = F.concat(scheme, host_of(url)), path_of(url)
    rest = F.regexp_extract(target, r"(?s)^[^?#]*(.*)$", 1)
    own = F.regexp_extract(target, r"(?s)^[^?#]*", 0)
    folder = F.concat(F.regexp_replace(path, r"(?s)[^/]*$", ""), F.when(path.contains("/"), "").otherwise("/"))
    relative = (
        F.when(target.rlike(SCHEME) | target.startswith("#") | (target == "") | (scheme == ""), F.lit(None))
        .when(target.startswith("//"), F.concat(F.regexp_extract(scheme, SCHEME, 0), target))
        .when(target.startswith("/"), F.concat(base, _without_dots(own), rest))
        .when(target.startswith("?"), F.concat(base, F.when(path == "", "/").otherwise(path), target))
        .otherwise(F.concat(base, _without_dots(F.concat(folder, own)), rest))
    )
    return F.when(target.rlike(SCHEME + "//"), target).otherwise(relative)


def _target(tag: Column) -> Column:
    """Where a tag points to: a link's href if canonical is a word of its rel, or what a meta refresh names; else null. Of attributes of one name the first counts."""
    rest = F.substring(tag, F.lit(6), F.char_length(tag))  # both names have four letters
    names, values = (F.regexp_extract_all(rest, F.lit(ATTRIBUTE), F.lit(k)) for k in (1, 2))
    names = F.transform(names, F.lower)
    bare = lambda v: F.when(v.rlike("^[\"']"), F.substring(v, F.lit(2), F.char_length(v) - 2)).otherwise(v)
    value = lambda name: F.trim(bare(F.coalesce(F.get(values, (F.array_position(names, name) - 1).cast("int")), F.lit(""))), F.lit(WHITE))
    is_link = F.lower(F.substring(tag, 2, 4)) == "link"
    canonical = F.array_contains(F.split(F.lower(value("rel")), r"\s+"), "canonical")
    named = F.regexp_replace(value("content"), DELAY, "")
    named = F.when(named.rlike("^[\"']"), F.regexp_extract(named, "^([\"'])(.*?)(?:\\1|$)", 2)).otherwise(named)
    return F.when(is_link & canonical, value("href")).when(~is_link & (F.lower(value("http-equiv")) == "refresh"), F.trim(named, F.lit(WHITE)))


def link_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html", redirects: DataFrame | None = None) -> DataFrame:
    """Edges (a, b) between url nodes from all canonical links and refresh redirects in the html, outside comments, scripts and other elements that hold text only, and from redirects (source, target). A tag with a '<' inside is not read."""
    closed = F.expr(f"left(`{html_col}`, length(`{html_col}`) - length(substring_index(`{html_col}`, '>', -1)))")  # up to the last '>', so that every search for one ends soon
    tags = F.regexp_extract_all(F.regexp_replace(closed, UNREAD, ""), F.lit(TAGS), F.lit(0))
    targets = F.filter(F.transform(tags, _target), lambda t: t.isNotNull() & (t != ""))
    url, marked = F.col(url_col), F.col(html_col).rlike("(?i)canonical|refresh") & F.col(html_col).contains(">")
    found = pages.where(marked).select(_node(url).alias("a"), url.alias("url"), F.explode(targets).alias("t"))
    found = found.select("a", _node(resolved(decoded(F.col("t")), F.col("url"))).alias("b"))
    edges = found.where("a is not null and b is not null and a <> b")
    if redirects is not None:
        more = redirects.select(_node(F.col("source")).alias("a"), _node(F.col("target")).alias("b")).where("a is not null and b is not null and a <> b")
        edges = edges.union(more)
    return edges.distinct()


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", redirects: DataFrame | None = None) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    A page that a rule fits takes the verdict of the longest such rule (of equally long ones, the largest verdict by name,
    block), so an explicit allow holds whatever its aliases are. Any other page is blocked if a page that a rule blocks is
    in its component of the graph of canonical links and redirects, and allowed if not. A null url, or one without '://',
    has an empty host and path, fits no rule and is allowed. Null html has no links. Repeated rows each get a row; other
    columns are ignored; an empty table gives an empty result.
    """
    scratch = Scratch(pages.sparkSession, "url-filter")
    url = F.col(url_col)
    edges = scratch.cut(link_edges(pages, url_col, html_col, redirects))
    judged = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), _node(url).alias("node"))
    judged = judged.withColumn("best", longest_rule(F.col("host"), F.col("path"), rules)).withColumns({"rule": F.col("best.rule"), "own": F.col("best.verdict")})
    if edges.isEmpty():
        return judged.select("page_id", "host", "path", "rule", F.coalesce("own", F.lit("allow")).alias("verdict"))
    parts = scratch.cut(connected_components(edges, scratch))
    blocked = judged.where("own = 'block'").join(parts, judged.node == parts.id, "left").select(F.coalesce("component_id", "node").alias("component_id")).distinct().withColumn("hit", F.lit(True))
    out = judged.join(parts, judged.node == parts.id, "left").withColumn("component_id", F.coalesce("component_id", "node")).join(blocked, "component_id", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("own", F.when(F.col("hit"), "block"), F.lit("allow")).alias("verdict"))
