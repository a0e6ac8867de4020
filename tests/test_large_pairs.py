"""Matches whose pairs are far more than their rows: results beside plain programs, and no pairs in a shuffle."""

import random
from collections import Counter

from pyspark.sql import functions as F

from wattgrid.operators import geo
from wattgrid.queries import QUERIES


def above_pairs(df):
    """The operators above the one that writes pairs out."""
    return df._jdf.queryExecution().sparkPlan().toString().split("Generate")[0]


def test_pairs_of_addresses_are_not_shuffled(spark, sf):
    for name in ("zip_matches", "postal_matches"):
        assert not any(k in above_pairs(QUERIES[name](spark, sf)) for k in ("Aggregate", "Join", "Exchange")), name
    root = above_pairs(QUERIES["address_lookup"](spark, sf)).strip().split("\n")[0]
    assert "Union" in root, root


def test_zip_counts_and_prefixes_beside_a_plain_program(spark):
    rnd = random.Random(3)
    addresses = [(rnd.randrange(300), rnd.choice(["1", "2", "3", None])) for _ in range(3000)]
    areas = [(u, u, [rnd.choice("12345") for _ in range(rnd.randrange(4))]) for u in range(50)] + [(7, 7, ["1", "1"])]
    want = Counter()
    for i, z in addresses:
        for _, u, zips in areas:
            want[i, u] += zips.count(z)
    t = spark.createDataFrame(areas, "id long, utility_id long, zip_codes array<string>")
    a = spark.createDataFrame(addresses, "address_id long, zip string")
    assert {(r.address_id, r.utility_id): r.n for r in geo.zip_counts(a, t).collect()} == +want
    assert Counter(tuple(r) for r in geo.by_zip(a, t).collect()) == +want
    given = [(i, z and z + "AB") for i, z in addresses]
    prefixes = [(i, u, [z if k % 2 else z + "AB" for k, z in enumerate(zips)]) for i, u, zips in areas]
    pairs = {(i, u, k) for i, z in given if z for k, u, keys in prefixes if z in keys or z[0] in keys}
    got = geo.by_postal_prefix(spark.createDataFrame(given, "address_id long, prefix string"), spark.createDataFrame(prefixes, "id long, utility_id long, postal_code_prefixes array<string>")).collect()
    assert {tuple(r) for r in got} == pairs and len(got) == len(pairs)


def test_lookup_beside_a_plain_program(spark):
    rnd = random.Random(5)
    states = [("A", "X"), ("B", "X"), ("A", "Y"), (None, "Y"), ("B", None)]
    utilities = [(u, *rnd.choice(states), rnd.random() < 0.8, rnd.choice([0, 0, 2])) for u in range(1500)]
    addresses = [(i, *rnd.choice(states), rnd.choice(["1", "2", "3", "4", None])) for i in range(40)]
    areas = [(u, rnd.sample("1235", 2)) for u in range(0, 1500, 3)]
    inside = [(i, rnd.randrange(1500)) for i in range(0, 40, 4) for _ in range(2)]
    inside += inside[:3]
    of = {u[0]: u for u in utilities if u[3]}
    zips, want = dict(areas), Counter()
    for i, state, country, z in addresses:
        polygon = Counter(u for j, u in inside if j == i and u in of and (country is None or country == of[u][2]))
        code = set() if polygon else {u for u in of if z in zips.get(u, [])}
        want.update({(i, u, "polygon"): n for u, n in polygon.items()} | {(i, u, "code"): 1 for u in code})
        met = code | set(polygon)
        want.update({(i, u, "state"): 1 for u, s, c, _, n in of.values() if s and c and (s, c) == (state, country) and u not in met and (not met or n > 0)})
    found = geo.lookup(
        spark.createDataFrame(addresses, "address_id long, state string, country string, zip string"), spark.createDataFrame(inside, "address_id long, utility_id long"),
        spark.createDataFrame(areas, "utility_id long, zip_codes array<string>"), spark.createDataFrame(utilities, "id long, state string, country string, is_active boolean, n_tariffs long"),
    )
    rows = found.collect()
    assert {(r.address_id, r.utility_id, r.match_method): r.n for r in rows} == want and len(rows) == len(want)


def test_a_task_holds_the_pairs_of_one_row(spark):
    plain = spark.newSession()
    plain.conf.set("spark.sql.adaptive.enabled", "false")  # then the plan names its compiled stages
    a, b = (plain.range(5).select((F.col("id") % 2).alias("k"), F.col("id").alias(name)) for name in "ab")
    pairs = geo.class_pairs(a, b, ["k"])
    over, within = [line for line in pairs._jdf.queryExecution().executedPlan().toString().split("\n") if " Generate " in line][:2]
    assert "*(" in over and "*(" not in within, (over, within)
    assert sorted(map(tuple, pairs.collect())) == [(k, i, j) for k in (0, 1) for i in range(5) for j in range(5) if i % 2 == j % 2 == k]


def test_utilities_of_a_state_in_small_blocks_beside_a_plain_program(spark, monkeypatch):
    monkeypatch.setattr(geo, "BLOCK", 3)
    rnd = random.Random(8)
    utilities = [(u, rnd.choice("AB"), "X", True, rnd.choice([0, 2])) for u in range(60)]
    utilities += utilities[7:9] * 2
    addresses = [(i, rnd.choice("AB"), "X", rnd.choice(["1", "2", "9", None])) for i in range(30)]
    addresses += addresses[:3] * 2
    areas = [(u, rnd.sample(["1", "2", "3", None], 2)) for u in range(0, 60, 2)]
    inside = [(i, rnd.randrange(60)) for i in range(0, 30, 5)]
    zips, polygon = dict(areas), {i: {u for j, u in inside if j == i} for i, *_ in addresses}
    served, want = {z for zs in zips.values() for z in zs if z}, Counter()
    for i, state, _, z in addresses:
        for u, s, _, _, n in utilities:
            same = u in polygon[i] if polygon[i] else z is not None and z in zips.get(u, [])
            want[i, u] += s == state and not same and (n > 0 or not polygon[i] and z not in served)
    found = geo.lookup(
        spark.createDataFrame(addresses, "address_id long, state string, country string, zip string"), spark.createDataFrame(inside, "address_id long, utility_id long"),
        spark.createDataFrame(areas, "utility_id long, zip_codes array<string>"), spark.createDataFrame(utilities, "id long, state string, country string, is_active boolean, n_tariffs long"),
    )
    pairs = found.where("match_method = 'state'").collect()
    assert {(r.address_id, r.utility_id): r.n for r in pairs} == +want and len(pairs) == len(+want)


def test_utilities_of_a_state_are_not_told_apart_pair_by_pair(spark, sf):
    plan = QUERIES["address_lookup"](spark, sf)._jdf.queryExecution().sparkPlan().toString().split("\n")
    assert not [line for line in plan if "Filter" in line and "array_contains" in line]


def test_tariffs_are_counted_once_for_all_stages_of_a_lookup(spark, sf):
    assert "o_custkey" not in QUERIES["all_address_lookup"](spark, sf)._jdf.queryExecution().sparkPlan().toString()
