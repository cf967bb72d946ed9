import re

import pytest
from pyspark.sql import functions as F

from veldspar.operators import graph as G
from veldspar.plans import sparql
from veldspar.shared import written

FULL = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"


def build(spark, *rows):
    return G.from_triples(spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "s string, p string, o string, seq int"))


def nodes(graph):
    return {r["id"]: r for r in graph.nodes.collect()}


@pytest.mark.parametrize("predicate", ["rdf:type", FULL, "x#type"])
def test_types(spark, predicate):
    g = build(spark, ("ex:alice", predicate, "ex:Person"))
    n = nodes(g)
    assert n["ex:Person"]["role"] == "type" and n["ex:alice"]["role"] == "instance"
    assert n["ex:alice"]["ontology_class"] == n["ex:Person"]["ontology_class"] == "ex:Person"
    assert [(e["label"], e["kind"]) for e in g.edges.collect()] == [("rdf:type", "instanceOf")]


@pytest.mark.parametrize("predicate", ["ex:SubClassOf", "rdfs:subClassOf", "http://x/y#SUBCLASSOF"])
def test_sub_classes(spark, predicate):
    g = build(spark, ("ex:Dog", predicate, "ex:Animal"))
    assert {n["role"] for n in nodes(g).values()} == {"type"}
    assert g.edges.first()["kind"] == "subClassOf"


def test_literals_and_promotion(spark):
    g = build(spark, ("ex:a", "ex:count", '"42"^^<http://x#integer>'), ("ex:a", "ex:label", '"Hello"@en'), ("ex:a", "ex:label", '"Bye"'), ("ex:a", "ex:sees", "ex:Person"), ("ex:b", "rdf:type", "ex:Person"))
    n = nodes(g)
    assert n["ex:a"]["metadata"] == {"count": "42", "label": "Bye"} and set(n) == {"ex:a", "ex:b", "ex:Person"}
    assert n["ex:Person"]["role"] == "type" and n["ex:a"]["label"] == "a"


def test_degrees_and_loops(spark):
    g = build(spark, ("a", "p", "a"), ("a", "p", "b"))
    assert {r["id"]: r["degree"] for r in G.degrees(g).collect()} == {"a": 3, "b": 1}


def test_cycles_end(spark):
    g = build(spark, ("x", "rdf:type", "A"), ("A", "rdfs:subClassOf", "B"), ("B", "rdfs:subClassOf", "A"), ("C", "rdfs:subClassOf", "Thing"))
    assert [r["id"] for r in G.class_chain(g, "x").orderBy("depth").collect()] == ["A", "B"]
    tree = {r["id"]: r["part"] for r in G.class_tree(g).collect()}
    assert tree == {"C": "tree", "A": "cycle", "B": "cycle"}


def test_small_graph_is_its_backbone(spark):
    assert G.backbone(build(spark, ("a", "p", "b"))).count() == 2


def test_records(spark):
    rows = spark.createDataFrame([("1", "a", "knows", "b"), ("2", None, "knows", "b"), ("3", "a", "name", '"x"'), ("4", "a", "rdf:type", "P")], "id string, f string, e string, t string")
    g = G.from_records(rows, "id", "f", "t", "e", "idx")
    assert {e["id"]: e["kind"] for e in g.edges.collect()} == {"1": "relationship", "4": "instanceOf"}
    assert nodes(g)["a"]["metadata"] == {"name": "x"}
    assert {e["label"] for e in G.from_records(rows, "id", "f", "t", None, "idx").edges.collect()} == {"idx"}


@pytest.fixture(scope="module")
def data(spark):
    rows = [("a", "knows", "b"), ("b", "knows", "c"), ("a", "age", '"5"'), ("b", "age", '"10"'), ("c", "age", '"x"'), ("a", "name", '"Al"@en')]
    return spark.createDataFrame(rows, "s string, p string, o string")


def run(data, text, dialect="compat"):
    out = sparql.select(data, text, dialect)
    return sorted(tuple(r[c] for c in out.columns) for r in out.collect())


def test_sparql_patterns(data):
    assert run(data, "SELECT ?x ?z WHERE { ?x <knows> ?y . ?y <knows> ?z }") == [("a", "c")]
    assert run(data, "SELECT ?x ?n WHERE { ?x <age> ?v OPTIONAL { ?x <name> ?n } }") == [("a", "Al"), ("b", ""), ("c", "")]
    assert run(data, "SELECT ?x WHERE { { ?x <knows> <b> } UNION { <b> <knows> ?x } }") == [("a",), ("c",)]
    assert run(data, "SELECT ?x WHERE { ?x <age> ?v MINUS { ?x <knows> ?y } }") == [("c",)]


def test_sparql_compat_traps(data):
    assert run(data, "SELECT ?x WHERE { ?x <age> ?v FILTER(?v > 5) }") == [("b",)]
    assert run(data, "SELECT ?x (COUNT(*) AS ?n) WHERE { ?x ?p ?o } GROUP BY ?x HAVING(COUNT(*) > 1)") == []
    assert run(data, "SELECT DISTINCT ?p WHERE { ?s ?p ?o }") == [("age",)] * 3 + [("knows",)] * 2 + [("name",)]
    assert run(data, "SELECT DISTINCT ?p WHERE { ?s ?p ?o }", "w3c") == [("age",), ("knows",), ("name",)]
    assert run(data, "SELECT ?x WHERE { ?x <name> ?n FILTER(LANG(?n) = \"en\") }") == [("a",)]
    with pytest.raises(Exception, match="division"):
        run(data, "SELECT ?w WHERE { ?x <age> ?v BIND(?v / 0 AS ?w) }")
    assert len(run(data, "SELECT ?x WHERE { ?x <age> ?v } ORDER BY (?v / 0)")) == 3


@pytest.mark.parametrize("text", ["SELECT WHERE { ?s ?p ?o }", "SELECT ?s { ?s ?p ?o }", "SELECT ?s WHERE { ?s ?p }", "ASK WHERE { }", "SELECT ?s WHERE { ?s ?p ?o } GROUP BY", "SELECT (SUM(*) AS ?x) WHERE { ?s ?p ?o }", "SELECT ?s WHERE { ?s ?p ~ }"])
def test_syntax_errors(text):
    with pytest.raises(sparql.SparqlSyntaxError):
        sparql.parse(text)


def test_long_chains_of_classes(spark):
    triples = [(f"c{k:03}", "rdfs:subClassOf", f"c{k + 1:03}", k) for k in range(100)] + [("x", "rdf:type", "c000", 999)]
    g = G.from_triples(spark.createDataFrame(triples, "s string, p string, o string, seq int"))
    assert {r["id"]: r["ancestor"] for r in G.nearest_ancestors(g, F.col("label") == "c100").collect()}["c000"] == "c100"
    assert G.class_chain(g, "x").count() == 101
    assert {r["id"]: r["depth"] for r in G.class_tree(g).where("part = 'tree'").collect()} == {f"c{k:03}": 100 - k for k in range(101)}
    icons = {r["id"]: r["icon"] for r in G.class_icons(g, {"c050": "fifty"}, "none").collect()}
    assert icons["c000"] == icons["c050"] == "fifty" and icons["c051"] == "none"
    row = G.inspected(g, "c001").first()
    assert (row["in_degree"], row["out_degree"], row["degree"]) == (1, 1, 2)
    plain = G.Graph(g.nodes, g.edges)
    assert sorted(map(tuple, G.degrees(g).collect())) == sorted(map(tuple, G.degrees(plain).collect()))
    store = spark.createDataFrame([("b", "x"), ("a", "y"), ("a", "z")], "ontology string, axiom string")
    assert sorted(r["axiom"] for r in G.first_ontology(store).collect()) == ["y", "z"]


def test_optionals_that_share_an_unbound_variable(spark, capsys):
    """Rows meet by the variable where it is bound: no nested loop over what binds it."""
    rows = [("a", "ex:p", "1"), ("b", "ex:p", "2"), ("c", "ex:p", "3"), ("a", "ex:q", "x"), ("b", "ex:q", "y"), ("t", "ex:r", "x"), ("u", "ex:r", "x"), ("v", "ex:r", "z")]
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "s string, p string, o string, seq int")
    run = lambda text: sorted(tuple(x or "-" for x in r) for r in sparql.select(df, text, "w3c").collect())
    both = "SELECT ?s ?x ?t WHERE { ?s ex:p ?o OPTIONAL { ?s ex:q ?x } OPTIONAL { ?t ex:r ?x } }"
    want = [("a", "x", "t"), ("a", "x", "u"), ("b", "y", "-")] + [("c", x, t) for x, t in (("x", "t"), ("x", "u"), ("z", "v"))]
    assert run("PREFIX ex: <ex:> " + both) == sorted(want)
    minus = "PREFIX ex: <ex:> SELECT ?s WHERE { ?s ex:p ?o OPTIONAL { ?s ex:q ?x } MINUS { ?t ex:r ?x } }"
    assert run(minus) == [("b",), ("c",)]


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


HUB = [(f"o{k}", "rdf:type", "ex:OrderEvent", k) for k in range(40)] + [("o1", "rdf:type", "ex:Event", 50), ("ex:OrderEvent", "rdfs:subClassOf", "ex:Event", 51), ("x", "p", "o2", 52), ("y", "rdf:type", "ex:Other", 53)]


@pytest.mark.parametrize("few", [100_000, 0])
def test_events_of_a_hub(spark, monkeypatch, few):
    """The rows of one class aren't sorted by it in one task, whether few or many ids meet them."""
    monkeypatch.setattr(G, "BROADCAST_IDS", few)
    g = G.from_triples(spark.createDataFrame(HUB, "s string, p string, o string, seq int"))
    found = G.events(g)
    assert "SortMergeJoin [type" not in planned(found) or "__part" in planned(found)
    assert sorted(r["id"] for r in found.collect()) == sorted(f"o{k}" for k in range(40))


@pytest.mark.parametrize("few", [100_000, 0])
def test_leaf_types_of_a_hub(spark, monkeypatch, few):
    monkeypatch.setattr(G, "BROADCAST_IDS", few)
    g = G.from_triples(spark.createDataFrame(HUB, "s string, p string, o string, seq int"))
    want = sorted([(f"o{k}", "ex:OrderEvent") for k in range(40)] + [("y", "ex:Other")])
    for graph in (g, G.Graph(g.nodes, g.edges)):
        found = G.leaf_types(graph)
        assert "SortMergeJoin [type" not in planned(found) or "__part" in planned(found)
        assert sorted((r["id"], r["type"]) for r in found.collect()) == want


@pytest.mark.parametrize("few", [100_000, 0])
def test_neighbours_of_a_hub(spark, monkeypatch, few):
    monkeypatch.setattr(G, "BROADCAST_IDS", few)
    g = G.from_triples(spark.createDataFrame(HUB, "s string, p string, o string, seq int"))
    found = G.neighbourhood(g, "x", 3)
    assert "SortMergeJoin [src" not in planned(found) or "__part" in planned(found)
    assert sorted(r["id"] for r in found.collect()) == sorted(["x", "ex:OrderEvent", *(f"o{k}" for k in range(40))])
    assert sorted(r["id"] for r in G.neighbourhood(g, "x", 1).collect()) == ["o2", "x"]


@pytest.mark.parametrize("few", [100_000, 0])
def test_facets_at_a_hub(spark, monkeypatch, few):
    monkeypatch.setattr(G, "BROADCAST_IDS", few)
    g = G.from_triples(spark.createDataFrame(HUB, "s string, p string, o string, seq int"))
    found = G.visible_edges(g, facets=[G.Facet("nodeRole", ("type",))])
    assert "SortMergeJoin [dst" not in planned(found) or "__part" in planned(found)
    assert found.count() == 43
    assert [r["id"] for r in G.visible_edges(g, facets=[G.Facet("nodeRole", ("type",), exclude=True), G.Facet("nodeRole", ("instance",), exclude=True)]).where("kind = 'subClassOf'").collect()] == []


def broadcast_parts(df):
    return re.search(r"BroadcastHashJoin \[[^\]]*__part", planned(df))


@pytest.mark.parametrize("how", ["left", "left_semi", "left_anti"])
def test_many_ids_are_not_broadcast(spark, monkeypatch, how):
    """More ids than may go to all tasks are sorted, however small their file looks, and only a hub's id is repeated."""
    monkeypatch.setattr(G, "BROADCAST_IDS", 2)
    monkeypatch.setattr(G, "HUB_ROWS", 10)
    keys = ["hub"] * 95 + [f"k{k}" for k in range(30)] + [None]
    known = ["hub", *(f"k{k}" for k in range(0, 60, 2))]
    rows = spark.createDataFrame(list(zip(keys, range(len(keys)), strict=True)), "key string, n int")
    ids = written(spark.createDataFrame([(k,) for k in known], "key string"))
    found = G.at_hubs(rows, ids.withColumn("hit", F.lit(True)) if how == "left" else ids, "key", how)
    assert not broadcast_parts(found)
    assert [tuple(r) for r in G._hubs(rows, "key").collect()] == [("hub", 10)]
    want = {"left": [(n, k in known or None) for n, k in enumerate(keys)], "left_semi": [(n,) for n, k in enumerate(keys) if k in known], "left_anti": [(n,) for n, k in enumerate(keys) if k not in known]}[how]
    assert sorted(map(tuple, found.drop("key").collect())) == want


@pytest.mark.parametrize(("few", "want"), [(100_000, ["k1", "k2", "k3", "k4", "k5"]), (4, ["k4", "k5"]), (0, [])])
def test_hubs_are_few(spark, monkeypatch, few, want):
    """Which keys are hubs goes to all tasks, so they are no more than ids may be."""
    monkeypatch.setattr(G, "BROADCAST_IDS", few)
    monkeypatch.setattr(G, "HUB_ROWS", 1)
    rows = spark.createDataFrame([(f"k{k}",) for k in range(6) for _ in range(k + 1)], "key string")
    assert sorted(r["key"] for r in G._hubs(rows, "key").collect()) == want


def test_facets_by_metadata_of_many(spark, monkeypatch):
    monkeypatch.setattr(G, "BROADCAST_IDS", 0)
    triples = [(f"c{k}", "ex:in", f"n{k % 3}", k) for k in range(40)] + [(f"c{k}", "ex:segment", f'"{"AUTO" if k % 4 else "OTHER"}"', 100 + k) for k in range(40)]
    g = G.from_triples(spark.createDataFrame(triples, "s string, p string, o string, seq int"))
    found = G.apply_facets(g, [G.Facet("edgeLabel", ("in",)), G.Facet("metadataContains", ("segment", "auto"))])
    assert not broadcast_parts(found)
    assert sorted(r["src"] for r in found.collect()) == sorted(f"c{k}" for k in range(40) if k % 4)


def test_facets_exclude_many_by_degree(spark, monkeypatch):
    """An edge goes if both ends are of high degree: many ids, among them hubs, whose edges are dealt out."""
    monkeypatch.setattr(G, "BROADCAST_IDS", 2)
    monkeypatch.setattr(G, "HUB_ROWS", 8)
    triples = [(f"c{k}", "rdf:type", "ex:Customer", k) for k in range(20)] + [(f"c{k}", "ex:in", f"n{k % 2}", 100 + k) for k in range(20)] + [(f"o{k}", "ex:by", f"c{k % 7}", 200 + k) for k in range(35)]
    g = G.from_triples(spark.createDataFrame(triples, "s string, p string, o string, seq int"))
    found = G.apply_facets(g, [G.Facet("metricThreshold", ("degree", ">", 3), exclude=True)])
    assert not broadcast_parts(found)
    high = {"ex:Customer", "n0", "n1", *(f"c{k}" for k in range(7))}
    assert sorted(r["id"] for r in found.collect()) == sorted(f"{s}-{p}-{o}" for s, p, o, _ in triples if not (s in high and o in high))


VISIBLE = [(f"c{k}", "ex:in", f"n{k % 2}", k) for k in range(20)] + [(f"c{k}", "ex:segment", f'"{"BUILDING" if k % 4 else "OTHER"}"', 100 + k) for k in range(20)] + [(f"c{k}", "rdf:type", "ex:Customer", 200 + k) for k in range(20)] + [("ex:Customer", "rdfs:subClassOf", "ex:Party", 300), ("ex:Customer", "ex:in", "n0", 301)]


@pytest.mark.parametrize("few", [100_000, 2, 0])
def test_visible_edges_of_many(spark, monkeypatch, few):
    """Neither the edges of a class nor the many nodes that a text finds are gathered in one place."""
    monkeypatch.setattr(G, "BROADCAST_IDS", few)
    monkeypatch.setattr(G, "HUB_ROWS", 5)
    g = G.from_triples(spark.createDataFrame(VISIBLE, "s string, p string, o string, seq int"))
    for graph in (g, G.Graph(g.nodes, g.edges)):
        found = G.visible_edges(graph, show_classes=False, text="build", facets=[G.Facet("edgeLabel", ("in",))])
        assert "SortMergeJoin [dst" not in planned(found) or "__part" in planned(found)
        assert not broadcast_parts(found)
        assert sorted((r["src"], r["dst"]) for r in found.collect()) == sorted((f"c{k}", f"n{k % 2}") for k in range(20) if k % 4)


@pytest.mark.parametrize("few", [100_000, 2, 0])
def test_visible_nodes_of_many(spark, monkeypatch, few):
    monkeypatch.setattr(G, "BROADCAST_IDS", few)
    monkeypatch.setattr(G, "HUB_ROWS", 5)
    g = G.from_triples(spark.createDataFrame(VISIBLE, "s string, p string, o string, seq int"))
    edges = G.visible_edges(g, show_classes=False, text="build", facets=[G.Facet("edgeLabel", ("in",))])
    found = G.visible_nodes(g, edges, "c0", show_classes=False)
    assert "SortMergeJoin [dst" not in planned(found) or "__part" in planned(found)
    assert not broadcast_parts(found)
    assert sorted(r["id"] for r in found.collect()) == sorted(["n0", "n1", "c0", *(f"c{k}" for k in range(20) if k % 4)])


def test_optionals_find_lone_rows_by_values(spark):
    """Which rows meet none is found by the distinct values of the other side, not by all pairs once more."""
    rows = [("a", "p", "1"), ("b", "p", "2"), ("c", "p", "3"), ("a", "q", "x"), ("b", "q", "y"), ("t", "r", "x"), ("u", "r", "x")]
    found = sparql.select(spark.createDataFrame(rows, "s string, p string, o string"), "SELECT ?s ?t WHERE { ?s <p> ?o OPTIONAL { ?s <q> ?x } OPTIONAL { ?t <r> ?x } }", "w3c")
    assert "Aggregate(keys=[__r_x" in planned(found)
    assert sorted(map(tuple, found.collect())) == [("a", "t"), ("a", "u"), ("b", ""), ("c", "t"), ("c", "u")]
