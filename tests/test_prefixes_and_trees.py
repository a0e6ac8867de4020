"""Groups of any size: no Python frames per group, no lists of a group's rows, no join of a group with itself."""

import random
import re

import pytest
from pyspark.sql import functions as F

from wattgrid.operators import changes
from wattgrid.queries import QUERIES


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["filter_tree", "prefix_duplicates"])
def test_plans_hold_no_whole_group(spark, sf, name):
    said = plan(QUERIES[name](spark, sf))
    assert "FlatMapGroups" not in said and "collect_list" not in said and "StartsWith" not in said


def plain_pass(rows):
    """The pass over one group, row by row: who loses to whom."""
    lost, rows = {}, sorted(rows, key=lambda r: (r[1].encode(), r[0]))
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            if a[0] in lost:
                break
            if b[0] in lost:
                continue
            x, y = (" ".join(re.sub(r"[^a-z0-9\s]", "", r[1].lower().strip()).split()) for r in (a, b))
            short, long_ = sorted((x, y), key=len)
            if x == y or (long_.startswith(short) and len(long_[len(short) :].strip()) >= 4):
                worth = [tuple(-1 if v is None else v for v in r[2:]) for r in (a, b)]
                keep, lose = (a, b) if worth[0] >= worth[1] else (b, a)
                lost[lose[0]] = keep[0]
    return {r[0]: lost.get(r[0], r[0]) for r in rows}


@pytest.mark.parametrize("seed", range(2))
def test_duplicates_are_absorbed_as_in_one_pass(spark, seed):
    rng = random.Random(seed)
    parts = ["rate", "Rate", "d", "D-", "service", "x", "time", "(use)", "  ", "é"] if seed else ["rate", "rate d", "service"]
    rows = [(rng.choice([1, 2, None]), i, "".join(rng.choice(parts) + rng.choice([" ", " ", ""]) for _ in range(rng.randint(1, 4))), rng.choice([0, 1, 2, 3, None]), rng.randint(0, 3)) for i in range(250)]
    rows += [(1, 1000, "Rate D", 1, 1), (1, 1001, "Rate D Service", 3, 3), (1, 1002, "Rate D X", 2, 2), (3, 1003, None, 1, 1), (3, 1004, "***", 0, 1), (3, 1005, "long name", 0, 0)]
    want = {1003: 1003}
    for g in (1, 2, 3, None):
        want |= plain_pass([r[1:] for r in rows if r[0] == g and r[2] is not None])
    df = spark.createDataFrame(rows, "g long, id long, name string, core long, total long")
    got = changes.absorb_duplicates(df, ["g"], "id", "name", "core", "total")
    assert got.columns == ["g", "id", "merged_into"] and {r.id: r.merged_into for r in got.collect()} == want and len(rows) == len(want)


def test_many_equal_names(spark):
    """Ten thousand rows of one name, met in a few rounds and no pairs."""
    df = spark.range(10_000).selectExpr("1 as g", "id", "'one name' as name", "id * 7919 % 10007 as core", "0 as total")
    top = df.selectExpr("max_by(id, core) as id").first()["id"]
    got = changes.absorb_duplicates(df, ["g"], "id", "name", "core", "total").where("merged_into = id").collect()
    assert [r.id for r in got] == [top]
