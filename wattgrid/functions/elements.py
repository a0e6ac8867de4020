"""Elements of HTML pages as rows: pieces of text between tags, spans of elements told by depth, main text and tables from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattgrid.functions.pages import DROPPED, REFERENCES

TAG = r"</?[A-Za-z][^>]*>"
UNREAD = [r"(?s)<!--.*?-->"] + [rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>" for tag in ("script", "style", "noscript", "iframe")]
WITHOUT_END = "area base br col embed hr img input link meta source track wbr".split()


def decoded(text: Column) -> Column:
    """Text with the references of XML and &nbsp; decoded, white space one space, trimmed."""
    for name, char in REFERENCES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def page_pieces(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, place, name, ends, attributes, text): the tags of each page in order, each with the text behind it; place 0 is the text before the first tag.

    Comments, scripts, styles and frames are left out first. Null pages have one empty piece; ids are taken as unique.
    """
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    for pattern in UNREAD:
        html = F.regexp_replace(html, pattern, " ")
    cut = pages.select(F.col(id_col).alias("page_id"), html.alias("html"))
    both = F.arrays_zip(F.concat(F.array(F.lit("")), F.regexp_extract_all("html", F.lit(f"({TAG})"), 1)).alias("tag"), F.split("html", TAG).alias("text"))
    rows = cut.select("page_id", F.posexplode(both).alias("place", "p"))
    return rows.select("page_id", "place", F.lower(F.regexp_extract("p.tag", r"^</?([A-Za-z][^\s/>]*)", 1)).alias("name"), F.col("p.tag").startswith("</").alias("ends"), F.regexp_extract("p.tag", r"(?s)^<[A-Za-z][^\s/>]*(.*)>$", 1).alias("attributes"), F.coalesce("p.text", F.lit("")).alias("text"))


def element_spans(pieces: DataFrame) -> DataFrame:
    """(page_id, name, a, b, attributes): elements from the piece of their start tag to before the piece of their end tag, nested ones of one name told by depth.

    A start without an end, and an end without a start, make no element: depth is counted from its lowest point so far, and at one
    depth starts and ends take turns.
    """
    own = Window.partitionBy("page_id", "name").orderBy("place")
    tags = pieces.where((F.col("name") != "") & ~F.col("name").isin(WITHOUT_END)).select("page_id", "place", "name", "ends", "attributes")
    tags = tags.withColumn("sum", F.sum(F.when(F.col("ends"), -1).otherwise(1)).over(own))
    tags = tags.withColumn("depth", F.col("sum") - F.least(F.lit(0), F.min("sum").over(own)))
    tags = tags.withColumn("level", F.when(F.col("ends"), F.lag("depth", 1, 0).over(own)).otherwise(F.col("depth"))).where("level > 0")
    turn = Window.partitionBy("page_id", "name", "level").orderBy("place")
    tags = tags.withColumns({"b": F.lead("place").over(turn), "closed": F.lead("ends").over(turn)})
    return tags.where("not ends and closed").select("page_id", "name", F.col("place").alias("a"), "b", "attributes")


def main_texts(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, text): the text of each page without scripts, styles, navigation, header, footer and frames: of its first main element, else its first article, else the first element with that role, else of the body; also where elements of one name are nested."""
    pieces = page_pieces(pages, id_col, html_col)
    spans = element_spans(pieces)
    gone = spans.where(F.col("name").isin(*DROPPED, "head")).select("page_id", F.explode(F.array(F.struct(F.col("a").alias("place"), F.lit(1).alias("step")), F.struct(F.col("b").alias("place"), F.lit(-1).alias("step")))).alias("e"))
    steps = gone.groupBy("page_id", "e.place").agg(F.sum("e.step").alias("step"))
    rank = F.when(F.col("name") == "main", 0).when(F.col("name") == "article", 1).when(F.col("attributes").rlike(r"""(?i)\brole\s*=\s*["']?main\b"""), 2)
    heads = spans.select("page_id", F.col("a").alias("place"), F.struct(rank.alias("rank"), "a", "b").alias("head")).where("head.rank is not null").groupBy("page_id", "place").agg(F.min("head").alias("head"))
    run, page = Window.partitionBy("page_id").orderBy("place"), Window.partitionBy("page_id")
    rows = pieces.select("page_id", "place", "text").join(steps, ["page_id", "place"], "left").join(heads, ["page_id", "place"], "left")
    rows = rows.withColumn("seen", F.coalesce(F.sum("step").over(run), F.lit(0)) == 0)
    rows = rows.withColumn("chosen", F.min(F.when(F.col("seen"), F.col("head"))).over(page))
    kept = F.col("seen") & (F.col("chosen").isNull() | ((F.col("place") >= F.col("chosen.a")) & (F.col("place") < F.col("chosen.b"))))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(kept, F.struct("place", "text")))), lambda p: p["text"]), " ")
    return rows.groupBy("page_id").agg(decoded(text).alias("text"))


def table_rows(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, table_no, row_no, heads, cells): rows of HTML tables as maps from the table's header cells to texts, in page order.

    Rows are those with td cells, counted from 0; cells beyond the headers are col_0, col_1 and so on by place, short rows have the first keys only.
    A header that an earlier one equals gets its place behind it. heads are the headers in order. Cells of a table inside another belong to
    the inner one alone. Row and cell end tags may be missing.
    """
    pieces = page_pieces(pages, id_col, html_col)
    spans = element_spans(pieces.where("name = 'table'")).select("page_id", F.col("a"), F.col("b"))
    ends = spans.select("page_id", F.explode(F.array(F.struct(F.col("a").alias("place"), F.lit(1).alias("step")), F.struct(F.col("b").alias("place"), F.lit(-1).alias("step")))).alias("e")).select("page_id", "e.place", "e.step")
    run = Window.partitionBy("page_id").orderBy("place")
    rows = pieces.join(ends, ["page_id", "place"], "left").withColumn("level", F.coalesce(F.sum("step").over(run), F.lit(0))).where("level > 0")
    level = Window.partitionBy("page_id", "level").orderBy("place")
    rows = rows.withColumn("table_at", F.last(F.when(F.col("step") == 1, F.col("place")), True).over(level))
    inner = Window.partitionBy("page_id", "table_at").orderBy("place")
    starts = lambda *names: F.col("name").isin(*names) & ~F.col("ends")
    rows = rows.withColumns({"tr": F.count_if(starts("tr")).over(inner), "cell": F.count_if(starts("td", "th")).over(inner), "open": F.last(F.when(starts("td", "th"), F.col("name")).when(F.col("name").isin("td", "th", "tr"), ""), True).over(inner)})
    cells = rows.where("open <> ''").groupBy("page_id", "table_at", "tr", "cell", F.col("open").alias("kind"))
    cells = cells.agg(decoded(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "text"))), lambda p: p["text"]), " ")).alias("text"))
    of = lambda kind: F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct("cell", "text")))), lambda c: c["text"])
    heads = cells.groupBy("page_id", "table_at").agg(of("th").alias("named"))
    named = F.transform("named", lambda h, i: F.when(F.array_position("named", h) == i + 1, h).otherwise(F.concat(h, F.lit("_"), i.cast("string"))))
    body = cells.groupBy("page_id", "table_at", "tr").agg(of("td").alias("said")).where("size(said) > 0").join(heads.withColumn("heads", named).drop("named"), ["page_id", "table_at"])
    keys = F.transform("said", lambda _, i: F.coalesce(F.get("heads", i), F.concat(F.lit("col_"), i.cast("string"))))
    tables = spans.select("page_id", F.col("a").alias("table_at"), F.row_number().over(Window.partitionBy("page_id").orderBy("a")).alias("n"))
    out = body.select("page_id", "table_at", "tr", "heads", F.map_from_entries(F.arrays_zip(keys.alias("k"), F.col("said").alias("v"))).alias("cells")).join(tables, ["page_id", "table_at"])
    place = F.row_number().over(Window.partitionBy("page_id", "table_at").orderBy("tr")) - 1
    return out.select("page_id", (F.col("n") - 1).alias("table_no"), place.alias("row_no"), "heads", "cells")


#: Kinds of rate sets: what the headers of a table hold and don't hold, and for each price the word of its column and the column's place without one.
KINDS = {
    "tou": (["off-peak", "mid-peak"], ["ultra-low"], [("off-peak", 1), ("mid-peak", 2), ("on-peak", 3)]),
    "ulo": (["ultra-low"], [], [("ultra-low", 1), ("weekend", 2), ("mid-peak", 3), ("on-peak", 4)]),
    "tiered": (["lower", "tier"], ["ultra-low"], [("lower", 1), ("higher", 3)]),
}
THRESHOLD = ("threshold", 2)
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def cents(text: Column) -> Column:
    """A cell that is a number of cents, with thousands separators, in dollars to five places; null for other cells and outside 0 to 1."""
    plain = F.replace(F.trim(text), F.lit(","), F.lit(""))
    value = F.round(F.when(plain.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), plain.try_cast("double")) / 100, 5)
    return F.when(value.between(0, 1), value)


def day_of(text: Column) -> Column:
    """'Nov 1, 2025' anywhere in a text as 2025-11-01, by the month's first three letters, unknown ones November; empty without such a date."""
    part = lambda k: F.regexp_extract(text, r"(\w+)\s+(\d+),?\s+(\d{4})", k)
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(part(1), 1, 3)))
    two = lambda c: F.when(F.length(c) < 2, F.lpad(c, 2, "0")).otherwise(c)
    day = F.regexp_replace(part(2), r"^0+(?=\d)", "")
    return F.when(part(3) == "", "").otherwise(F.concat_ws("-", part(3), two(F.when(month > 0, month).otherwise(11).cast("string")), two(day)))


def table_rate_sets(rows: DataFrame) -> DataFrame:
    """(page_id, kind, effective, prices, threshold) from table_rows: a set for each kind that the headers of a page's tables speak of.

    The headers are those of a table's first row, so a first row that is short hides the others. Columns are found by a word of their
    header, the first one that holds it, else by place. Of a table the first row with a year in its first
    column and all prices counts, of several tables of one kind the last. threshold is the text of that column, for tiers alone.
    """
    first = rows.withColumns({"top": F.first("cells").over(Window.partitionBy("page_id", "table_no").orderBy("row_no")), "place": F.col("row_no")})
    keys = F.map_keys("top")
    said = F.lower(F.array_join(keys, " "))
    has = lambda words, without: F.forall(F.array(*map(F.lit, words)), lambda w: said.contains(w)) & ~F.exists(F.array(*map(F.lit, without or ["\n"])), lambda w: said.contains(w))
    kind = F.coalesce(*[F.when(has(words, without), k) for k, (words, without, _) in KINDS.items()])
    cell = lambda word, at: F.try_element_at("cells", F.coalesce(F.get(F.filter(keys, lambda h: F.lower(h).contains(word)), F.lit(0)), F.get(keys, F.lit(at)), F.lit("")))
    prices = F.coalesce(*[F.when(F.col("kind") == k, F.array(*[cents(cell(*c)) for c in columns])) for k, (_, _, columns) in KINDS.items()])
    date = F.coalesce(F.try_element_at("cells", F.get(keys, F.lit(0))), F.lit(""))
    sets = first.withColumn("kind", kind).where("kind is not null").select("page_id", "table_no", "row_no", "kind", date.alias("date"), prices.alias("prices"), F.when(F.col("kind") == "tiered", F.coalesce(cell(*THRESHOLD), F.lit(""))).alias("threshold"))
    sets = sets.where(F.col("date").rlike(r"\d{4}") & ~F.exists("prices", lambda p: p.isNull()))
    best = F.max_by(F.struct("date", "prices", "threshold"), F.struct("table_no", -F.col("row_no")))
    return sets.groupBy("page_id", "kind").agg(best.alias("s")).select("page_id", "kind", day_of(F.col("s.date")).alias("effective"), "s.prices", "s.threshold")


def page_rate_sets(pages: DataFrame, as_of: str, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, kind, source, effective, prices, summer, winter): the rate sets of pages from the cells of their tables; on pages whose tables lack one of tou and tiered, kinds without a set are read from the text.

    source is table or text. Sets of a text hold from the last November 1 before as_of. summer and winter are thresholds of tiers.
    """
    from wattgrid.functions.pages import rate_sets, thresholds

    year, month = int(as_of[:4]), int(as_of[5:7])
    since = f"{year if month >= 11 else year - 1}-11-01"
    found = table_rate_sets(table_rows(pages, id_col, html_col))
    out = ["page_id", "kind", F.lit("table").alias("source"), "effective", "prices", F.when(F.col("kind") == "tiered", thresholds(F.col("threshold"))).alias("t")]
    full = found.groupBy("page_id").agg(F.collect_set("kind").alias("kinds"))  # at most three
    pieces = page_pieces(pages, id_col, html_col)
    texts = pieces.groupBy("page_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "text"))), lambda p: p["text"]), "\n").alias("text"))
    rest = texts.join(full, "page_id", "left").withColumn("kinds", F.coalesce("kinds", F.array().cast("array<string>"))).where(~(F.array_contains("kinds", "tou") & F.array_contains("kinds", "tiered")))
    read = rest.select("page_id", "kinds", "text", F.explode(rate_sets(F.col("text"))).alias("s")).where(~F.array_contains("kinds", F.col("s.kind")))
    read = read.select("page_id", "s.kind", F.lit("text").alias("source"), F.lit(since).alias("effective"), "s.prices", F.when(F.col("s.kind") == "tiered", thresholds(F.lit(""))).alias("t"))
    return found.select(*out).union(read).select("page_id", "kind", "source", "effective", "prices", "t.summer", "t.winter")
