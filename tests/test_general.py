import json

import pytest
from pyspark.sql import functions as F

from urlsieve.operators.nested import BadJson, events, flatten, record_triples, snake
from urlsieve.operators.skew import Measure, eager_join_aggregate, salted_join


def test_json_grammar():
    for good in ("1", "-0.5e+3", '"a\\u00e9"', "[]", "{}", '{"a":[1,{"b":null}],"c":true}', " [1 , 2 ] "):
        json.loads(good)
        list(events(good))
    for bad in ("", "[1,]", "{,}", '{"a"}', '{"a":1,}', "[1 2]", "01", "1.", "tru", "[1]]", '"a', "nul", '{"a":1 "b":2}', "{1:2}", "[,1]", "-"):
        with pytest.raises(ValueError):
            json.loads(bad)
        with pytest.raises(BadJson):
            list(events(bad))


def test_triples():
    got = record_triples('{"resolvedIps": "[\\"a\\", null]", "x": [{"y": 1}, 2], "s": "[no"}')
    assert ("resolved_ips[]", (0,), "s", "a") in got and ("resolved_ips[]", (1,), "l", None) in got
    assert ("x[].y", (0,), "n", "1") in got and ("x[]", (1,), "n", "2") in got and ("s", (), "s", "[no") in got
    assert len(record_triples("[" * 20_000 + "]" * 20_000)) == 20_000
    deep = '["x"]'
    for _ in range(9):  # a list in a string in a list, and so on
        deep = json.dumps([deep])
    assert record_triples(deep)[-1] == ("[]" * 10, (0,) * 10, "s", "x")
    lone = record_triples('{"a": {"b": 1}, "c": {"a": "{\\"b\\": 2}"}, "d": {"a": null}, "e": {"a": [3]}, "f": {"a": "[4]"}}', frozenset("a"))
    assert [x for x in lone if x[0].endswith("b") or x[2] == "n"] == [("a[].b", (0,), "n", "1"), ("c.a[].b", (0,), "n", "2"), ("e.a[]", (0,), "n", "3"), ("f.a[]", (0,), "n", "4")]
    assert ("d.a", (), "l", None) in lone
    assert snake("Resolved-IPs") == snake("resolvedIPs") == "resolved_ips"


def test_flatten(spark):
    df = spark.createDataFrame([(1, '{"pos": 7, "a": [{"pos": 3, "z": "q"}, null, {"b": [1]}]}', "x"), (2, None, "y"), (3, "", "z"), (4, "{", "w")], "id bigint, j string, ords string")
    t = flatten(df, "id", "j", {"": ["pos"], r"a\[\]": ["pos"]})
    assert [(r.id, r.f_pos) for r in t[""].collect()] == [(1, "7")]
    rows = sorted(t[r"a\[\]"].collect(), key=lambda r: r.pos)
    assert [(r.pos, r.f_pos, r.rest) for r in rows] == [(0, "3", {"z": "q"}), (1, None, {}), (2, None, {})]
    assert flatten(df.limit(0), "id", "j", {"": ["pos"]})[""].count() == 0


def test_p3_shapes(spark, tmp_path):
    from urlsieve.plans.nested_queries import p3_found

    payloads = ['[null, {"resolvedIps": "1.1.1.1", "redirect_chain": {"url": "u", "resolved_ips": ["a", null, "b"]}}]', '{"batch": {"results": [{"indicators": {"category": "x", "evidence": {"tokens": ["t"]}}}]}}', "[", None, '{"redirect_chain": ["h", {"url": "i", "resolved_ips": "[\\"c\\"]"}]}']
    spark.createDataFrame([(i, p) for i, p in enumerate(payloads)], "record_id bigint, payload string").write.parquet(str(tmp_path / "result_raw.parquet"))
    got = {tuple(r) for r in p3_found(spark, str(tmp_path)).collect()}
    assert got == {(0, 1, "resolved_ips", -1, 0, "1.1.1.1"), (0, 1, "redirect_chain", -1, 0, "u"), (0, 1, "resolved_ips", 0, 0, "a"), (0, 1, "resolved_ips", 0, 2, "b"), (1, 0, "indicators", -1, 0, "x"), (4, 0, "redirect_chain", -1, 0, "h"), (4, 0, "redirect_chain", -1, 1, "i"), (4, 0, "resolved_ips", 1, 0, "c")}


def test_salted_join(spark):
    left = spark.createDataFrame([("hot", i) for i in range(100)] + [("cold", 1), ("none", 2), (None, 3)], "k string, v int")
    right = spark.createDataFrame([("hot", 100, "h"), ("cold", 1, "c"), (None, 1, "n")], "k string, n bigint, w string")
    got = sorted(map(tuple, salted_join(left, right, ["k"], "n", hot_rows=7).collect()))
    assert got == sorted([("hot", i, "h") for i in range(100)] + [("cold", 1, "c")])
    assert salted_join(left, right, ["k"], "n", 7, "left").count() == 103
    assert salted_join(left.limit(0), right, ["k"], "n").count() == 0
    assert sorted(map(tuple, salted_join(left, right, ["k"], "n", hot_rows=0, most_hot=1).collect())) == got


def test_salted_join_spreads(spark):
    left = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 3 == 1, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"), "id")
    joined = salted_join(left, left.groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("w", F.lit(1)), ["k"], "n", hot_rows=100, how="left")
    assert joined.count() == 3000 and joined.filter("k = 'hot' and w = 1").count() == 1000 and joined.filter("k is null and w is null").count() == 1000


def test_eager_aggregate(spark):
    left = spark.createDataFrame([("a", "g", 3, 1), ("a", "g", 2, 2), ("b", "g", 1, 3), (None, "g", 9, 4), ("c", None, 9, 5), ("b", "h", None, 6)], "k string, d string, t int, id int")
    right = spark.createDataFrame([("a", 10), ("a", 20), ("b", 5), (None, 7)], "k string, w bigint")
    m = [Measure("first", "first", "id", order=("t", "id")), Measure("ids", "sum", "id"), Measure("w", "sum", "w", side="right")]
    got = {(r.field, r.item): tuple(r)[2:] for r in eager_join_aggregate(left, right, "k", ["d"], m).collect()}
    # joined rows of g: a-1 twice, a-2 twice, b-3 once
    assert got == {("d", "g"): (3, 5, 3, 9, 65), ("d", "h"): (1, 1, 6, 6, 5)}
    outer = {r.item: (r.left_rows, r.joined_rows, r.first) for r in eager_join_aggregate(left, right, "k", ["d"], m, "left").collect()}
    assert outer == {"g": (4, 6, 3), "h": (1, 1, 6)}
    assert eager_join_aggregate(left.limit(0), right, "k", ["d"], m).count() == 0
    by_key = {r.item: (r.left_rows, r.joined_rows) for r in eager_join_aggregate(left, right, "k", ["k"], m, "left").collect()}
    assert by_key == {"a": (2, 4), "b": (2, 2), "c": (1, 1)}


def test_entry(spark, folder):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    for name in ("p3_found", "p6_found", "rules_path", "evaluate_best", "blocklist_hits"):
        assert e.queries()[name](spark, folder).columns
