import pytest

from veldspar.operators import workspace as W
from veldspar.operators.analytics import Aggregation
from veldspar.sources.readers import ImportFailure


def test_entities(spark, tmp_path):
    tree = W.entity_tree(spark, [W.Entity("b", ("x", "y", "z")), W.Entity("a"), W.Entity("c", ("x",))]).collect()
    by = {r["path"]: (r["parent"], r["depth"], r["is_entity"]) for r in tree}
    assert by["x/y/z/b"] == ("x/y/z", 3, True) and by["_root/a"] == ("_root", 1, True) and by["x/c"] == ("x", 1, True) and by["x/y"] == ("x", 1, False)
    spark.range(1).write.parquet(str(tmp_path / "t.parquet"))
    assert [e.name for e in W.load_entities(spark, str(tmp_path))] == ["t"]
    with pytest.raises(ImportFailure):
        W.load_entities(spark, str(tmp_path / "none"))
    assert W.Entity("e", indexes=(W.Index("i", "vector"), W.Index("j", "graph"))).tools == ("vector", "graph", "analytics")
    with pytest.raises(ValueError):
        W.Index("i", "tree")


def test_histories():
    q = W.SavedQueries(kept=2)
    for text in ("a", "b", "a", "c"):
        q.add(text)
    assert q.recent() == ["c", "a"] and q.frequent(1) == ["a"]
    c = W.Connections(kept=1)
    c.add("f", favourite=True)
    c.add("x")
    c.add("y")
    assert c.all() == ["y", "f"]


def test_bounds_and_panels(spark):
    df = spark.range(200).selectExpr("cast(id as double) as x", "cast(id % 2 as string) as g")
    assert tuple(W.robust_bounds(df, ["x"]).first()) == (5.0, 194.0)
    assert tuple(W.robust_bounds(df.limit(10), ["x"]).first()) == (0.0, 9.0)
    p = W.Panels(df)
    k = p.add(Aggregation("count", group_by="g"))
    assert p.kind(k) == "bar" and {r["value"] for r in p.results(k).collect()} == {100.0}
    p.remove(k)
    assert p.queries == [] and len(W.PRESETS) == 5
    assert W.initial_facet("edgeKind").values == ("subClassOf", "instanceOf", "relationship", "property") and W.initial_facet("metricThreshold").values == ("degree", ">", 0.0)
    with pytest.raises(ValueError):
        W.initial_facet("colour")
    fields = spark.createDataFrame([("a.b", "b", "string"), ("o", "o", "object")], "path string, name string, type string")
    assert [r["path"] for r in W.pick_fields(fields, "A.").collect()] == ["a.b"]
    assert W.node_links({"a": "http://x", "b": "c"}) == ({"b": "c"}, {"a": "http://x"})
