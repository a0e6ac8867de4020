"""One-line JSON arrays in splits of any size, beside Python's own reader."""

import gzip
import json

import pytest

from wattgrid.sources import readers as S
from wattgrid.sources.arrays import read_array_objects

ODD = ['plain', 'a "quoted" {brace}', "}{][", 'ends in \\', '\\"}', "", "é ✓ ]}", '{"$oid":"no"}']
RECORDS = [{"label": f"r{i}", "name": ODD[i % len(ODD)] * (1 + i % 3), "tiers": [[{"rate": i / 8, "unit": "}]"}], []], "deep": {"a": {"b": [ODD[(i + 3) % len(ODD)], {}]}}} for i in range(120)]


@pytest.mark.parametrize("size", [64, 999, 1 << 20])
def test_arrays_in_splits(spark, tmp_path, size):
    (tmp_path / "a.json").write_text(json.dumps(RECORDS, ensure_ascii=False))
    (tmp_path / "b.json").write_text(json.dumps({"items": RECORDS, "more": [{"x": 1}], "and": {"y": {}}}, indent=1))
    (tmp_path / "c.json").write_text("[]")
    (tmp_path / "d.json").write_text('{"items": [], "more": [{"x": 1}]}')
    (tmp_path / "e.json").write_text(" [" + json.dumps(RECORDS[0]) + ", " + json.dumps(RECORDS[1])[:40])
    with gzip.open(tmp_path / "f.json.gz", "wt") as f:
        json.dump(RECORDS[:30], f)
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        got = {}
        for r in read_array_objects(spark, str(tmp_path)).collect():
            got.setdefault(r.file.rsplit("/", 1)[1], []).append(json.loads(r.json))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    same = lambda a, b: sorted(map(json.dumps, a)) == sorted(map(json.dumps, b))
    assert set(got) == {"a.json", "b.json", "e.json", "f.json.gz"}
    assert same(got["a.json"], RECORDS) and same(got["b.json"], RECORDS) and same(got["e.json"], RECORDS[:1]) and same(got["f.json.gz"], RECORDS[:30])


def test_other_heads_are_errors(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"meta": 1, "items": []}')
    with pytest.raises(Exception, match="items first"):
        read_array_objects(spark, str(tmp_path)).collect()


def test_ids_and_dates_become_plain(spark, tmp_path):
    deep = {"_id": {"$oid": "x1"}, "rateName": 'says {"$oid":"no"}', "effectiveDate": {"$date": "2020-01-02T00:00:00Z"}, "meta": [{"by": {"$oid": "y \" z"}, "at": {"$date": 5}}, {"a": {"b": {"$date": "d"}}}]}
    (tmp_path / "a.json").write_text(json.dumps([deep, {"label": "l", "startdate": 1577836800}]))
    raw = S.read_bulk_array(spark, str(tmp_path))
    first = {r.r.get("_id"): r.r for r in raw.collect()}["x1"]
    assert first["rateName"] == deep["rateName"] and json.loads(first["meta"]) == [{"by": 'y " z', "at": 5}, {"a": {"b": "d"}}]
    assert {(r.label, str(r.startdate)[:10]) for r in S.normalize_bulk(raw).collect()} == {("x1", "2020-01-02"), ("l", "2020-01-01")}
