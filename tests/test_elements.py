"""Main text, tables and rate sets of literal pages, with nested and unclosed elements."""

import pytest
from pyspark.sql import functions as F

from wattgrid.functions import elements as E


def frame(spark, *pages):
    return spark.createDataFrame(list(enumerate(pages)), "page_id int, html string")


MAIN = [
    ("<body><nav>a<nav>b</nav>c</nav><main>x<main>y</main>z</main>w</body>", "x y z"),
    ("<head><title>t</title></head><body>a<header>h</header> b &amp; c<!-- <main>no</main> --></body>", "a b & c"),
    ("<nav><main>hidden</main></nav><article>one</article><article>two</article>", "one"),
    ("<section>a</section><section role='main'>b<section>c</section>d</section>e", "b c d"),
    ("<nav>never closed <main>kept</main>", "kept"),
    ("</main></nav>x<nav>y</nav>", "x"),
    ("<script>if (a < b) '<main>'</script><p>text", "text"),
    ("plain", "plain"),
    ("", ""),
    (None, ""),
]


def test_main_texts(spark):
    got = {r.page_id: r.text for r in E.main_texts(frame(spark, *[h for h, _ in MAIN])).collect()}
    assert got == {k: want for k, (_, want) in enumerate(MAIN)}


def test_table_rows(spark):
    page = "<table><tr><th>A<th>B<th>A</tr><tr><td>1<td>2</tr><tr><td>3</td><td>4</td><td>5</td><td>6</td></tr><tr></tr><tr><td>7 <table><tr><td>in</td></tr></table> 8</td></tr></table>x<TABLE><tr><td>y</table><table><tr><td>open"
    rows = E.table_rows(frame(spark, page, "<p>none</p>", None)).orderBy("table_no", "row_no").collect()
    assert [(r.table_no, r.row_no, r.cells) for r in rows] == [
        (0, 0, {"A": "1", "B": "2"}), (0, 1, {"A": "3", "B": "4", "A_2": "5", "col_3": "6"}), (0, 2, {"A": "7 8"}), (1, 0, {"col_0": "in"}), (2, 0, {"col_0": "y"}),
    ]
    assert rows[0].heads == ["A", "B", "A_2"]


TOU = "<table><tr><th>Effective date</th><th>Off-Peak (c)</th><th>On-Peak</th><th>Mid-Peak</th></tr>{}</table>"
TIERED = "<table><tr><th>Date</th><th>Lower tier</th><th>Threshold kWh</th><th>Higher tier</th></tr><tr><td>May 1, 2024</td><td>10.3</td><td>600 (Summer) 1,000 (Winter)</td><td>12.5</td></tr></table>"
SETS = [
    (TOU.format("<tr><td>soon</td><td>1</td><td>2</td><td>3</td></tr><tr><td>Nov 1, 2025</td><td>7.6</td><td>15.8</td><td>12.2</td></tr><tr><td>Nov 1, 2024</td><td>1</td><td>1</td><td>1</td></tr>") + TIERED,
     [("tiered", "table", "2024-05-01", [0.103, 0.125], 600, 1000), ("tou", "table", "2025-11-01", [0.076, 0.122, 0.158], None, None)]),
    (TOU.format("<tr><td>Nov 1, 2025</td><td></td><td>x</td><td>1</td></tr>") + "<p>Time-of-Use now</p><p>7.6</p> <p>12.2</p> <p>15.8</p>", [("tou", "text", "2023-11-01", [0.076, 0.122, 0.158], None, None)]),
    ("<table><tr><th>From</th><th>Ultra-Low Overnight</th><th>Weekend Off-Peak</th><th>Mid-Peak</th><th>On-Peak</th></tr><tr><td>Moon 3 2023</td><td>2.8</td><td>7.6</td><td>12.2</td><td>28.4</td></tr></table>",
     [("ulo", "table", "2023-11-03", [0.028, 0.076, 0.122, 0.284], None, None)]),
    (TOU.format("<tr><td>Jan 1, 2020</td><td>1</td><td>2</td><td>3</td></tr>") + TOU.format("<tr><td>Feb 10 2021</td><td>4</td><td>5</td><td>6</td></tr>"), [("tou", "table", "2021-02-10", [0.04, 0.06, 0.05], None, None)]),
    (TOU.format("<tr><td>Jan 1, 2020</td><td>1</td><td>200</td><td>3</td></tr>"), []),
    ("<table><tr><th>From</th><th>Off-Peak</th><th>Mid-Peak</th><th>On-Peak</th></tr><tr><td>Jan 1, 2020</td><td>1</td></tr><tr><td>Jan 1, 2021</td><td>1</td><td>2</td><td>3</td></tr></table>", []),
    (None, []),
]


@pytest.mark.parametrize("page,want", SETS)
def test_page_rate_sets(spark, page, want):
    got = E.page_rate_sets(frame(spark, page), "2024-10-31").collect()
    assert sorted((r.kind, r.source, r.effective, r.prices, r.summer, r.winter) for r in got) == want


def test_against_a_plain_parser(spark):
    """Random sequences of tags: spans equal those of a program that keeps a stack per name."""
    import random

    r = random.Random(3)
    pages = ["".join(r.choice(["<a>", "</a>", "<b>", "</b>", "<nav x='1'>", "</nav>", "<br>", "t"]) for _ in range(r.randint(0, 40))) for _ in range(60)]
    want = set()
    import re

    for k, page in enumerate(pages):
        stacks = {}
        for place, m in enumerate(re.finditer(r"</?([a-z]+)[^>]*>", page), 1):
            if m[1] == "br":
                continue
            stack = stacks.setdefault(m[1], [])
            if not m[0].startswith("</"):
                stack.append(place)
            elif stack:
                want.add((k, m[1], stack.pop(), place))
    got = E.element_spans(E.page_pieces(frame(spark, *pages)).where(F.col("place") >= 0)).collect()
    assert {(s.page_id, s.name, s.a, s.b) for s in got} == want and len(got) == len(want)


def test_run_targets_and_lists(spark):
    from wattgrid.operators import relational as R

    u = spark.createDataFrame([(1, "CA", "ON", True), (2, "CA", "BC", True), (3, "US", "NY", True), (4, "CA", "ON", False), (5, "CA", "ON", True)], "id bigint, country string, state string, is_active boolean")
    t = spark.createDataFrame([(2,), (2,), (4,), (None,)], "utility_id bigint")
    s = spark.createDataFrame([(4, "ERROR"), (4, "ERROR"), (1, "OK"), (None, "ERROR"), (9, "ERROR")], "utility_id bigint, status string")
    ids = lambda kind, limit=10, **where: [r.id for r in R.run_targets(u, t, s, kind, limit, **where).collect()]
    assert ids("missing") == [1, 3, 5] and ids("missing", 1, country="CA") == [1] and ids("missing", country="CA", state="ON") == [1, 5]
    assert ids("having") == [2] and ids("error") == [4, 9] and ids("error", 1) == [4]
    assert [tuple(r) for r in R.explicit_list(spark, [3, 1, 3]).collect()] == [(0, 3), (1, 1)] and R.explicit_list(spark, list(range(2000)) * 2).count() == 2000
    with pytest.raises(ValueError):
        R.explicit_list(spark, list(range(2001)))


def test_country_audit_by_hand(spark):
    from wattgrid.operators import relational as R

    u = spark.createDataFrame([(1, "CA", True), (2, "CA", True), (3, "CA", False), (4, "US", True)], "id bigint, country string, is_active boolean")
    t = spark.createDataFrame([(1, 1, "r"), (2, 1, "c"), (3, 1, "x"), (4, 3, "r")], "id bigint, utility_id bigint, customer_class string")
    c = spark.createDataFrame([(1,)] * 3 + [(2,)] + [(4,)] * 9, "tariff_id bigint")
    got = {r.country: tuple(r)[1:] for r in R.country_audit(u, t, c, "r", "c").collect()}
    assert got == {"CA": (2, 1, 1, 50, 3, 1, 1, 1, 2, 4, 2.0, 2.5), "US": (1, 0, 1, 0, 0, 0, 0, 0, 0, 0, None, None)}
