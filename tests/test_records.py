import math

import pytest
from pyspark.sql import functions as F

from veldspar.functions import values as V
from veldspar.operators import analytics as A
from veldspar.operators import profile as P
from veldspar.operators import records as R
from veldspar.operators.predicate import Condition, Group, allowed_operators, filter_records, parsed_value, search_records

ROWS = [
    (1, "Alice", 30.0, True, '{"a": {"b": 5}, "t": "10", "l": [1, 2]}'),
    (2, "bob", 25.0, False, '{"a": {"b": "x"}, "t": "ten"}'),
    (3, None, None, None, '{"a": null}'),
    (4, "carol", float("nan"), True, "{}"),
]


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(ROWS, "id int, name string, age double, ok boolean, j string").withColumn("j", F.parse_json("j"))


def ids(df):
    return sorted(r["id"] for r in df.collect())


@pytest.mark.parametrize(
    ("condition", "expected"),
    [
        (Condition("name", "=", "ALICE"), [1]),
        (Condition("name", "!=", "alice"), [2, 3, 4]),
        (Condition("name", "<", "b"), [1, 3]),
        (Condition("age", ">", "26"), [1]),
        (Condition("age", "<=", 25), [2, 3, 4]),
        (Condition("age", "=", 25), [2, 4]),
        (Condition("ok", "=", True), [1, 4]),
        (Condition("ok", "<", True), [2, 3]),
        (Condition("name", "is null"), [3]),
        (Condition("name", ">", None), [1, 2, 4]),
        (Condition("name", "contains", "AR"), [4]),
        (Condition("name", "starts with", "B"), [2]),
        (Condition("age", "contains", "2"), []),
        (Condition("j.a.b", "=", 5), [1]),
        (Condition("j.a.b", "is not null"), [1, 2]),
        (Condition("j.t", ">=", 10), [1]),
        (Condition("j.t", "<", 10), [2, 3, 4]),
        (Condition("nothing.here", "is null"), [1, 2, 3, 4]),
    ],
)
def test_conditions(people, condition, expected):
    assert ids(filter_records(people, Group((condition,)))) == expected


def test_groups(people):
    assert ids(filter_records(people, Group())) == [1, 2, 3, 4]
    assert ids(filter_records(people, Group((Condition("id", "=", 1), Group()), any_of=True))) == [1, 2, 3, 4]
    assert ids(filter_records(people, Group((Condition("id", "=", 1), Condition(" ", "=", 1)), any_of=True))) == [1]
    assert allowed_operators("boolean") == ("=", "!=", "is null", "is not null")
    assert parsed_value("number", "1.5") == 1.5 and parsed_value("number", "x") == "x" and parsed_value("boolean", "TRUE") is True
    with pytest.raises(ValueError):
        Condition("a", "like", "b")


def test_search(people):
    assert ids(search_records(people.select("id", "name", "age"), "AL", "id")) == [1]
    assert ids(search_records(people.select("id", "name", "age"), "25", "id")) == [2]
    assert ids(search_records(people.select("id", "name"), "2", "id", ids_only=True)) == [2]


def test_paging(spark):
    df = spark.range(25).withColumnRenamed("id", "k")
    last = R.page(df, "k", 20, 10).collect()
    assert [r["k"] for r in last] == [20, 21, 22, 23, 24] and not last[0]["has_more"]
    assert R.page(df, "k", 0, 10).collect()[0]["has_more"]
    assert R.page(df.where("k < 0"), "k").collect() == []


def test_sizes_need_an_id(spark):
    df = spark.createDataFrame([(None, 1)], "id string, v int")
    with pytest.raises(Exception, match="has no id"):
        R.with_sizes(df, "id", "T").collect()


def test_upsert_delete(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string")
    assert sorted(map(tuple, R.upsert(base, new, "id").collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert [tuple(r) for r in R.delete(base, new, "id").collect()] == [(1, "a")]


def test_aggregation(spark):
    df = spark.createDataFrame([("a", "1"), ("a", "2.5"), ("b", "x"), (None, " 3"), (None, "4d"), ("c", None)], "g string, v string")
    get = lambda *q: {r["group_key"]: r["value"] for r in A.aggregate(df, A.Aggregation(*q)).collect()}
    assert get("sum", "v", "g") == {"a": 3.5, "b": 0.0, "(null)": 0.0, "c": 0.0}
    assert get("avg", "v", "g") == {"a": 1.75}
    assert get("count", None, "g") == {"a": 2.0, "b": 1.0, "(null)": 2.0, "c": 1.0}
    assert get("max", "v") == {"Total": 2.5}
    inf = spark.createDataFrame([("a", float("inf"))], "g string, v double")
    assert A.aggregate(inf, A.Aggregation("max", "v", "g")).collect() == []


@pytest.mark.parametrize("p", [0.0, 0.5, 0.9, 0.95, 1.0])
def test_percentile_is_the_floored_index(spark, p):
    values = [float(x % 7) for x in range(41)]
    df = spark.createDataFrame([("g", v) for v in values] + [("n", None)], "g string, v double")
    got = {r["group_key"]: r["value"] for r in A.aggregate(df, A.Aggregation("percentile", "v", "g", p)).collect()}
    assert got == {"g": sorted(values)[int((len(values) - 1) * p)]}


def test_profile(spark):
    rows = ['{"a": 1, "o": {"x": "t"}, "v": %s}' % list(range(64)), '{"a": "s", "o": {"x": null}, "v": [1]}', '{"b": true}']
    df = spark.createDataFrame([(r,) for r in rows], "j string").withColumn("j", F.parse_json("j"))
    got = {r["path"]: (r["type"], r["depth"], r["samples"]) for r in P.profile(df, "j").collect()}
    assert got["a"][0] == "mixed" and got["a"][2] == ["1", "s"]
    assert got["b"][:2] == ("boolean", 0)
    assert got["o"][0] == "object" and got["o.x"][:2] == ("mixed", 1)
    assert got["v"][0] == "mixed"


def test_display_and_tree(spark):
    df = spark.createDataFrame([(1, '{"b": [1, {"c": null}], "a": "x"}')], "id int, j string").withColumn("j", F.parse_json("j"))
    tree = {r["path"]: r["display"] for r in R.json_tree(df, "id", "j").collect()}
    assert tree == {"$": "{2 fields}", "$.b": "[2 items]", "$.a": "x", "$.b[0]": "1", "$.b[1]": "{1 fields}", "$.b[1].c": "null"}
    one = df.select(V.short_number(F.lit(1500.5)).alias("k"), V.short_number(F.lit(2e6)).alias("m"), V.short_number(F.lit(12.0)).alias("n"), V.short_number(F.lit(0.126)).alias("d"), R.hexdump(F.lit("AB")).alias("h"), R.byte_size(F.lit(2048)).alias("s")).first()
    assert tuple(one) == ("1.5K", "2.0M", "12", "0.13", "41 42", "2.0 KB")
    assert R.storage_kind("x/Y.SQLITE") == "sqlite" and R.storage_kind("x") == "cluster"
    assert not math.isnan(1.0)


def test_number_comparisons_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([(1, 1.5), (2, None), (None, float("nan"))], "k int, v double").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = filter_records(df, Group((Condition("v", ">=", 1), Condition("k", "<", "5"))))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(v,1.0)" in plan and "LessThan(k,5)" in plan
    want = {"=": [None], "!=": [1, 2], ">": [], ">=": [None], "<": [1, 2], "<=": [1, 2, None]}
    for operator, ids in want.items():
        got = [r["k"] for r in filter_records(df, Group((Condition("v", operator, 2.0),))).collect()]
        assert sorted(got, key=str) == sorted(ids, key=str), operator
        assert filter_records(df, Group((Group((Condition("v", operator, 2.0),)), Condition("k", "=", 99)), any_of=True)).count() == len(ids)


def test_deep_records(spark):
    """Nothing is cut off by depth, and a sample met in two types takes one place."""
    import json

    deep = {"a": 1}
    for k in range(20):
        deep = {f"k{k}": deep, "s": f"x{k} }}{{"}
    df = spark.createDataFrame([(1, json.dumps(deep)), (2, '{"s": [[[1]]]}'), (3, None)], "id int, j string").select("id", F.try_parse_json("j").alias("v"))
    found = {r["path"]: r for r in P.profile(df, "v").collect()}
    path = ".".join(f"k{k}" for k in reversed(range(20))) + ".a"
    assert found[path]["depth"] == 20 and found[path]["samples"] == ["1"] and found["s"]["type"] == "mixed"
    tree = R.json_tree(df, "id", "v").collect()
    assert max(r["depth"] for r in tree if r["id"] == 1) == 21 and {r["path"] for r in tree if r["id"] == 2} == {"$", "$.s", "$.s[0]", "$.s[0][0]", "$.s[0][0][0]"}
    two = spark.createDataFrame([(k, json.dumps({"a": x})) for k, x in enumerate(["1", 1, "2", 2, "3", 3, "4", "5", "6"])], "id int, j string").select(F.parse_json("j").alias("v"))
    assert P.profile(two, "v").first()["samples"] == ["1", "2", "3", "4", "5"]


def test_nested_search_and_columns(spark):
    df = spark.createDataFrame([("r1", ("Deep",), {"k": "mapped"}, ["listed"], [(7, "In list")], 42), ("r2", None, None, None, None, 1)], "id string, s struct<t:string>, m map<string,string>, l array<string>, ls array<struct<n:int,t:string>>, n int")
    for text, want in (("deep", ["r1"]), ("MAPPED", ["r1"]), ("listed", ["r1"]), ("in list", ["r1"]), ("42", ["r1"]), ("r2", ["r2"]), ("none", [])):
        assert [r["id"] for r in search_records(df, text, "id").collect()] == want, text
    shown = R.configured(df, "id", "T", ["s.t", "n"], ("id", "size"))
    assert shown.columns == ["_id", "size", "s.t", "n"] and [r["s.t"] for r in shown.collect()] == ["Deep", "-"]
    with pytest.raises(R.RecordError):
        R.configured(df, "id", "T", list("abcde"))
