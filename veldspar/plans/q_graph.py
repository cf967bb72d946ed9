"""Queries over a graph of regions, nations, suppliers, customers and orders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldspar.functions import terms as R
from veldspar.operators import graph as G
from veldspar.operators import workspace as WS
from veldspar.plans.catalog import query
from veldspar.plans.q_records import read
from veldspar.shared import written

#: Triples by table: (order, table, subject, predicate, object).
_PARTS = (
    (1, "customer", "'tp:customer' || c_custkey", "'rdf:type'", "'tp:Party'", "c_acctbal > 9000"),
    (2, "region", "'tp:region' || r_regionkey", "'rdf:type'", "'tp:Region'", "true"),
    (2, "nation", "'tp:nation' || n_nationkey", "'rdf:type'", "'tp:Nation'", "true"),
    (2, "supplier", "'tp:supplier' || s_suppkey", "'rdf:type'", "'tp:Supplier'", "true"),
    (2, "customer", "'tp:customer' || c_custkey", "'rdf:type'", "'tp:Customer'", "true"),
    (2, "orders", "'tp:order' || o_orderkey", "'rdf:type'", "'tp:OrderEvent'", "true"),
    (3, "region", "'tp:region' || r_regionkey", "'tp:name'", "'\"' || r_name || '\"'", "true"),
    (3, "nation", "'tp:nation' || n_nationkey", "'tp:name'", "'\"' || n_name || '\"@en'", "true"),
    (3, "nation", "'tp:nation' || n_nationkey", "'tp:inRegion'", "'tp:region' || n_regionkey", "true"),
    (3, "supplier", "'tp:supplier' || s_suppkey", "'tp:inNation'", "'tp:nation' || s_nationkey", "true"),
    (3, "supplier", "'tp:supplier' || s_suppkey", "'tp:balance'", "'\"' || CAST(floor(s_acctbal) AS BIGINT) || '\"'", "true"),
    (3, "customer", "'tp:customer' || c_custkey", "'tp:inNation'", "'tp:nation' || c_nationkey", "true"),
    (3, "customer", "'tp:customer' || c_custkey", "'tp:segment'", "'\"' || c_mktsegment || '\"'", "true"),
    (3, "customer", "'tp:customer' || c_custkey", "'tp:balance'", "'\"' || CAST(floor(c_acctbal) AS BIGINT) || '\"'", "c_custkey % 3 <> 0"),
    (3, "orders", "'tp:order' || o_orderkey", "'tp:placedBy'", "'tp:customer' || o_custkey", "true"),
    (3, "orders", "'tp:order' || o_orderkey", "'tp:occurredOnDate'", "'\"' || {date} || '\"^^<xsd:date>'", "true"),
)
_CLASSES = (("tp:Supplier", "tp:Party"), ("tp:Customer", "tp:Party"), ("tp:Party", "owl:Thing"), ("tp:Nation", "tp:Place"), ("tp:Region", "tp:Place"), ("tp:Place", "owl:Thing"), ("tp:OrderEvent", "tp:Event"), ("tp:Event", "owl:Thing"))


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = []
    for seq, table, s, p, o, where in _PARTS:
        rows = read(spark, sf_dir, table).where(where)
        parts.append(rows.select(F.expr(s).alias("s"), F.expr(p).alias("p"), F.expr(o.format(date="date_format(o_orderdate, 'yyyy-MM-dd')")).alias("o"), F.lit(seq).alias("seq")))
    parts.append(spark.createDataFrame([(a, "rdfs:subClassOf", b, 4) for a, b in _CLASSES], "s string, p string, o string, seq int"))
    return reduce(DataFrame.unionByName, parts)


def graph(spark: SparkSession, sf_dir: str) -> G.Graph:
    """Its triples are written once: a query reads them several times, and each time would plan and scan all tables."""
    return G.from_triples(written(triples(spark, sf_dir)))


def _local(x: str) -> str:
    return f"CASE WHEN contains({x}, '#') THEN regexp_extract({x}, '[^#]*$') WHEN contains({x}, '/') THEN regexp_extract({x}, '[^/]*$') WHEN contains({x}, ':') THEN regexp_extract({x}, '[^:]*$') ELSE {x} END"


_T = " UNION ALL ".join(
    [f"SELECT {s} AS s, {p} AS p, {o.format(date='strftime(o_orderdate, $$%Y-%m-%d$$)')} AS o, {seq} AS seq FROM {table} WHERE {where}" for seq, table, s, p, o, where in _PARTS]
    + [f"SELECT '{a}', 'rdfs:subClassOf', '{b}', 4" for a, b in _CLASSES]
)
#: e: edges; n: nodes; m: metadata; ty: types of instances.
BASE = f"""WITH RECURSIVE t AS ({_T}), e AS (
  SELECT s || '-' || p || '-' || o AS id, s AS src, o AS dst, CASE WHEN p = 'rdf:type' THEN 'rdf:type' ELSE {_local('p')} END AS label, CASE WHEN p <> 'rdf:type' THEN p END AS property,
    CASE WHEN p = 'rdf:type' THEN 'instanceOf' WHEN p = 'rdfs:subClassOf' THEN 'subClassOf' ELSE 'relationship' END AS kind FROM t WHERE NOT starts_with(o, '"')
), cl AS (SELECT DISTINCT dst AS id FROM e WHERE kind = 'instanceOf' UNION SELECT src FROM e WHERE kind = 'subClassOf' UNION SELECT dst FROM e WHERE kind = 'subClassOf'
), ids AS (SELECT s AS id FROM t UNION SELECT dst FROM e
), ic AS (SELECT s AS id, arg_max(o, seq) AS cls FROM t WHERE p = 'rdf:type' GROUP BY s
), n AS (SELECT ids.id, {_local('ids.id')} AS label, CASE WHEN cl.id IS NOT NULL THEN 'type' ELSE 'instance' END AS role, CASE WHEN cl.id IS NOT NULL THEN ids.id ELSE cls END AS ontology_class FROM ids LEFT JOIN cl USING (id) LEFT JOIN ic USING (id)
), m AS (SELECT s AS id, {_local('p')} AS key, regexp_extract(o, '^"([^"]*)"', 1) AS value FROM t WHERE starts_with(o, '"')
), ty AS (SELECT DISTINCT src AS id, dst AS type FROM e WHERE label = 'rdf:type'
), sc AS (SELECT src AS sub, dst AS sup FROM e WHERE kind = 'subClassOf'
), up AS (SELECT sub, sup, 1 AS depth FROM sc UNION SELECT up.sub, sc.sup, up.depth + 1 FROM up JOIN sc ON sc.sub = up.sup WHERE up.depth < 20
), ev AS (SELECT n.id, n.label, (SELECT max(value) FROM m WHERE m.id = n.id AND m.key = 'occurredOnDate') AS date FROM n WHERE n.id IN (SELECT id FROM ty WHERE contains(type, 'Event')) OR n.id IN (SELECT id FROM m WHERE key = 'occurredOnDate')
), dg AS (SELECT n.id, (SELECT count(*) FROM e WHERE e.dst = n.id) AS i, (SELECT count(*) FROM e WHERE e.src = n.id) AS o FROM n)
"""
CUSTOMER = "tp:customer7"


@query(BASE + "SELECT id, label, role, ontology_class FROM n")
def graph_from_triples(spark, sf_dir):
    return graph(spark, sf_dir).nodes.select("id", "label", "role", "ontology_class")


@query(BASE + "SELECT id, src, dst, label, property, kind FROM e")
def graph_edges(spark, sf_dir):
    return graph(spark, sf_dir).edges


@query(BASE + "SELECT id, key, value FROM m")
def graph_literals(spark, sf_dir):
    return graph(spark, sf_dir).nodes.select("id", F.explode("metadata").alias("key", "value"))


@query("SELECT 'part' || l_partkey AS id, 'part' || l_partkey AS label, 'instance' AS role FROM lineitem UNION SELECT 'supplier' || l_suppkey, 'supplier' || l_suppkey, 'instance' FROM lineitem")
def graph_from_records(spark, sf_dir):
    records = read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("rid"), F.concat(F.lit("part"), "l_partkey").alias("a"), F.concat(F.lit("supplier"), "l_suppkey").alias("b"))
    return G.from_records(records, "rid", "a", "b", None, "suppliedBy").nodes.select("id", "label", "role")


def _ontology(spark: SparkSession, sf_dir: str):
    """Regions and nations as classes; nations are subclasses of their region."""
    region, nation = read(spark, sf_dir, "region"), read(spark, sf_dir, "nation")
    name = lambda k: F.concat(F.lit("tp:R"), F.col(k).cast("string"))
    classes = region.select(name("r_regionkey").alias("iri"), F.col("r_name").alias("label"), F.lit("a region").alias("comment")).unionByName(nation.select(F.concat(F.lit("tp:N"), "n_nationkey").alias("iri"), F.lit(None).cast("string").alias("label"), F.lit(None).cast("string").alias("comment")))
    subs = nation.select(F.concat(F.lit("tp:N"), "n_nationkey").alias("sub"), name("n_regionkey").alias("sup"))
    props = region.where("r_regionkey < 2").select(F.concat(F.lit("tp:near"), "r_regionkey").alias("iri"), F.lit(None).cast("string").alias("label"), F.array(name("r_regionkey")).alias("domains"), F.array(F.lit("tp:R2"), F.lit("tp:R3")).alias("ranges"))
    data = region.where("r_regionkey < 2").select(F.lit("tp:size").alias("iri"), F.lit("size").alias("label"), F.array(name("r_regionkey")).alias("domains"), F.array().cast("array<string>").alias("ranges"))
    equal = spark.createDataFrame([(["tp:R0", "tp:R1", "tp:R4"],)], "iris array<string>")
    return classes, subs, props, data, equal


@query("""SELECT 'subClassOf-tp:N' || n_nationkey || '-tp:R' || n_regionkey AS id, 'tp:N' || n_nationkey AS src, 'tp:R' || n_regionkey AS dst, 'subClassOf' AS label, 'subClassOf' AS kind FROM nation
UNION ALL SELECT 'objProp-tp:near' || a || '-tp:R' || a || '-tp:R' || b, 'tp:R' || a, 'tp:R' || b, 'near' || a, 'property' FROM (VALUES (0, 2), (0, 3), (1, 2), (1, 3)) v(a, b)
UNION ALL SELECT 'equivalentTo-tp:R' || a || '-tp:R' || b, 'tp:R' || a, 'tp:R' || b, 'equivalentTo', 'relationship' FROM (VALUES (0, 1), (0, 4), (1, 4)) v(a, b)""")
def graph_from_ontology(spark, sf_dir):
    return G.from_ontology(*_ontology(spark, sf_dir)).edges.select("id", "src", "dst", "label", "kind")


@query("""SELECT 'tp:R' || r_regionkey AS id, r_name AS label, 'type' AS role, 'a region' AS comment, CASE WHEN r_regionkey < 2 THEN 'Literal' END AS size FROM region
UNION ALL SELECT 'tp:N' || n_nationkey, 'N' || n_nationkey, 'type', NULL, NULL FROM nation""")
def graph_ontology_nodes(spark, sf_dir):
    nodes = G.from_ontology(*_ontology(spark, sf_dir)).nodes
    return nodes.select("id", "label", "role", F.try_element_at("metadata", F.lit("comment")).alias("comment"), F.try_element_at("metadata", F.lit("dp:size")).alias("size"))


@query(BASE + "SELECT id, label, role FROM n UNION ALL SELECT 'tp:R' || r_regionkey, r_name, 'type' FROM region UNION ALL SELECT 'tp:N' || n_nationkey, 'N' || n_nationkey, 'type' FROM nation")
def graph_merge_ontology(spark, sf_dir):
    classes, subs, *_ = _ontology(spark, sf_dir)
    return G.merge_ontology(graph(spark, sf_dir), classes, subs).nodes.select("id", "label", "role")


@query(BASE + "SELECT id, label FROM n WHERE id <> 'owl:Thing'")
def graph_drop_thing(spark, sf_dir):
    return G.drop_thing(graph(spark, sf_dir)).nodes.select("id", "label")


@query(f"SELECT DISTINCT p, {_local('p')} AS name, o, {_local('o')} AS o_name FROM ({_T}) WHERE p IN ('rdfs:subClassOf', 'tp:inRegion')")
def graph_local_name(spark, sf_dir):
    return triples(spark, sf_dir).where("p in ('rdfs:subClassOf', 'tp:inRegion')").select("p", R.local_name(F.col("p")).alias("name"), "o", R.local_name(F.col("o")).alias("o_name")).distinct()


@query(f"""SELECT s, p, regexp_extract(o, '^"([^"]*)"', 1) AS lexical, CASE WHEN contains(o, '"^^') THEN 'xsd:date' WHEN contains(o, '"@') THEN NULL ELSE 'xsd:string' END AS datatype, CASE WHEN contains(o, '"@') THEN 'en' END AS language FROM ({_T}) WHERE starts_with(o, '"')""")
def rdf_literal(spark, sf_dir):
    return triples(spark, sf_dir).where("startswith(o, '\"')").select("s", "p", R.literal(F.col("o")).alias("l")).select("s", "p", "l.*")


@query(BASE + "SELECT id, i AS in_degree, o AS out_degree, i + o AS degree FROM dg")
def graph_degree(spark, sf_dir):
    return G.degrees(graph(spark, sf_dir))


@query(BASE + "SELECT id, round(1 + log2(i + o + 1) * 0.5, 8)::DOUBLE AS radius FROM dg")
def graph_radius(spark, sf_dir):
    return G.degrees(graph(spark, sf_dir)).select("id", F.round(G.radius(F.col("degree")), 8).alias("radius"))


@query(BASE + "SELECT label, count(*) AS count FROM e GROUP BY label")
def graph_edge_counts(spark, sf_dir):
    return G.edge_counts(graph(spark, sf_dir))


@query(BASE + "SELECT role, count(*) AS count FROM n GROUP BY role")
def graph_by_role(spark, sf_dir):
    return G.by_role(graph(spark, sf_dir))


@query(BASE + "SELECT id FROM n WHERE role = 'type' UNION SELECT id FROM (SELECT id FROM dg ORDER BY i + o DESC, id LIMIT (SELECT least(200, greatest(30, count(*) // 5)) FROM n))")
def graph_backbone(spark, sf_dir):
    return G.backbone(graph(spark, sf_dir))


@query("""SELECT id, CASE WHEN c = 1 THEN 0 WHEN k % 2 = 0 THEN -(k // 2 + 1) * 0.4 ELSE (k // 2 + 1) * 0.4 END::DOUBLE AS curvature FROM (
  SELECT id, count(*) OVER (PARTITION BY least(src, dst), greatest(src, dst)) AS c, row_number() OVER (PARTITION BY least(src, dst), greatest(src, dst) ORDER BY id) - 1 AS k
  FROM (SELECT event_id AS id, 'u' || user_id AS src, event_type AS dst FROM events))""")
def graph_curvature(spark, sf_dir):
    return G.curvature(read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.concat(F.lit("u"), "user_id").alias("src"), F.col("event_type").alias("dst")))


_BOTH = "b AS (SELECT src AS x, dst AS y FROM e WHERE kind <> 'subClassOf' UNION SELECT dst, src FROM e WHERE kind <> 'subClassOf')"


@query(BASE + f", {_BOTH} SELECT '{CUSTOMER}' AS id UNION SELECT y FROM b WHERE x = '{CUSTOMER}'")
def graph_nhop1(spark, sf_dir):
    return G.neighbourhood(graph(spark, sf_dir), CUSTOMER, 1)


@query(BASE + f", {_BOTH}, h AS (SELECT y FROM b WHERE x = '{CUSTOMER}') SELECT '{CUSTOMER}' AS id UNION SELECT y FROM h UNION SELECT b.y FROM h JOIN b ON b.x = h.y")
def graph_nhop2(spark, sf_dir):
    return G.neighbourhood(graph(spark, sf_dir), CUSTOMER, 2)


@query(BASE + f"SELECT id, label, src AS other, 'in' AS direction FROM e WHERE dst = '{CUSTOMER}' UNION ALL SELECT id, label, dst, 'out' FROM e WHERE src = '{CUSTOMER}'")
def graph_incident(spark, sf_dir):
    return G.incident(graph(spark, sf_dir), CUSTOMER)


@query(BASE + "SELECT sup AS id, label FROM sc JOIN n ON n.id = sup WHERE sub = 'tp:Supplier'")
def graph_superclasses(spark, sf_dir):
    return G.super_classes(graph(spark, sf_dir), "tp:Supplier")


@query(BASE + "SELECT sub AS id, label FROM sc JOIN n ON n.id = sub WHERE sup = 'tp:Place'")
def graph_subclasses(spark, sf_dir):
    return G.sub_classes(graph(spark, sf_dir), "tp:Place")


@query(BASE + "SELECT id, ancestor FROM (SELECT id, CASE WHEN label = 'Place' OR label = 'Party' THEN label ELSE (SELECT arg_min(n2.label, depth) FROM up JOIN n n2 ON n2.id = up.sup WHERE up.sub = n.id AND n2.label IN ('Place', 'Party')) END AS ancestor FROM n WHERE role = 'type') WHERE ancestor IS NOT NULL")
def graph_ancestor(spark, sf_dir):
    return G.nearest_ancestors(graph(spark, sf_dir), F.col("label").isin("Place", "Party"))


_ROOTS = ", ".join(f"'{c}'" for c in G.ROOT_CLASSES)


@query(BASE + f""", own AS (SELECT id, CASE WHEN label IN ({_ROOTS}) THEN label ELSE (SELECT arg_min(n2.label, depth) FROM up JOIN n n2 ON n2.id = up.sup WHERE up.sub = n.id AND n2.label IN ({_ROOTS})) END AS ancestor FROM n WHERE role = 'type')
SELECT id, ancestor FROM own WHERE ancestor IS NOT NULL UNION ALL SELECT ty.id, arg_min(ancestor, type) FROM ty JOIN own ON own.id = type WHERE ancestor IS NOT NULL GROUP BY ty.id""")
def graph_class_color(spark, sf_dir):
    return G.class_roots(graph(spark, sf_dir))


@query("SELECT * FROM (VALUES (0, 'tp:Customer'), (1, 'tp:Party'), (2, 'owl:Thing')) v(depth, id)")
def graph_class_chain(spark, sf_dir):
    return G.class_chain(graph(spark, sf_dir), CUSTOMER)


@query(BASE + "SELECT id, type FROM ty WHERE id NOT IN (SELECT id FROM cl) AND NOT EXISTS (SELECT 1 FROM ty o JOIN up ON up.sub = o.type AND up.sup = ty.type WHERE o.id = ty.id)")
def graph_leaf_types(spark, sf_dir):
    return G.leaf_types(graph(spark, sf_dir))


@query("""SELECT id, parent, depth, 'tree' AS part FROM (VALUES ('tp:Event', NULL, 0), ('tp:Party', NULL, 0), ('tp:Place', NULL, 0), ('tp:OrderEvent', 'tp:Event', 1), ('tp:Customer', 'tp:Party', 1), ('tp:Supplier', 'tp:Party', 1), ('tp:Nation', 'tp:Place', 1), ('tp:Region', 'tp:Place', 1)) v(id, parent, depth)""")
def graph_class_tree(spark, sf_dir):
    return G.class_tree(graph(spark, sf_dir))


@query(BASE + "SELECT count(*) AS classes FROM cl")
def graph_class_counts(spark, sf_dir):
    return G.class_ids(graph(spark, sf_dir)).agg(F.count("*").alias("classes"))


@query(BASE + "SELECT id FROM n WHERE role = 'instance' AND id NOT IN (SELECT id FROM ty)")
def graph_untyped(spark, sf_dir):
    return G.untyped(graph(spark, sf_dir))


@query(BASE + f"SELECT DISTINCT type AS id, {_local('type')} AS label FROM ty")
def graph_types(spark, sf_dir):
    return G.individual_types(graph(spark, sf_dir))


@query(BASE + "SELECT id FROM n WHERE contains(lower(label), 'nation1') OR id IN (SELECT id FROM m WHERE contains(lower(value), 'nation1'))")
def graph_node_search(spark, sf_dir):
    return G.matching_nodes(graph(spark, sf_dir), " Nation1 ")


@query(BASE + "SELECT id FROM e WHERE kind = 'relationship' AND label IN ('inNation', 'inRegion') AND (src IN (SELECT id FROM m WHERE key = 'segment' AND contains(lower(value), 'auto')) OR dst IN (SELECT id FROM m WHERE key = 'segment' AND contains(lower(value), 'auto')))")
def graph_facets(spark, sf_dir):
    return G.apply_facets(graph(spark, sf_dir), [G.Facet("edgeKind", ("relationship",)), G.Facet("edgeLabel", ("inNation", "inRegion")), G.Facet("metadataContains", ("segment", "Auto"))]).select("id")


@query(BASE + "SELECT id FROM e WHERE src IN (SELECT id FROM ty WHERE type = 'tp:Nation') OR dst IN (SELECT id FROM ty WHERE type = 'tp:Nation') OR src = 'tp:Nation' OR dst = 'tp:Nation'")
def graph_facets_include(spark, sf_dir):
    return G.apply_facets(graph(spark, sf_dir), [G.Facet("nodeType", ("tp:Nation",))]).select("id")


@query(BASE + "SELECT id FROM e WHERE NOT (src IN (SELECT id FROM dg WHERE i + o > 3) AND dst IN (SELECT id FROM dg WHERE i + o > 3))")
def graph_facets_exclude(spark, sf_dir):
    return G.apply_facets(graph(spark, sf_dir), [G.Facet("metricThreshold", ("degree", ">", 3), exclude=True)]).select("id")


_VISIBLE = "SELECT * FROM e WHERE src NOT IN (SELECT id FROM cl) AND dst NOT IN (SELECT id FROM cl) AND (src IN (SELECT id FROM m WHERE contains(lower(value), 'build')) OR dst IN (SELECT id FROM m WHERE contains(lower(value), 'build'))) AND label = 'inNation'"


@query(BASE + f"SELECT id FROM ({_VISIBLE})")
def graph_visible_edges(spark, sf_dir):
    return G.visible_edges(graph(spark, sf_dir), show_classes=False, text="build", facets=[G.Facet("edgeLabel", ("inNation",))]).select("id")


@query(BASE + f"SELECT id, label FROM n WHERE id IN (SELECT src FROM ({_VISIBLE}) UNION SELECT dst FROM ({_VISIBLE}) UNION SELECT '{CUSTOMER}')")
def graph_visible_nodes(spark, sf_dir):
    g = graph(spark, sf_dir)
    edges = G.visible_edges(g, show_classes=False, text="build", facets=[G.Facet("edgeLabel", ("inNation",))])
    return G.visible_nodes(g, edges, CUSTOMER, show_classes=False).select("id", "label")


@query(BASE + "SELECT 'node' AS what, 'removed' AS change, id AS value FROM n WHERE starts_with(id, 'tp:order') UNION ALL SELECT 'node', 'removed', 'tp:OrderEvent' UNION ALL SELECT 'node', 'removed', 'tp:Event' UNION ALL SELECT 'label', 'removed', 'placedBy'")
def graph_update_delta(spark, sf_dir):
    old = graph(spark, sf_dir)
    kept = triples(spark, sf_dir).where("not startswith(s, 'tp:order') and s not in ('tp:OrderEvent', 'tp:Event')")
    return G.delta(old, G.from_triples(kept))


@query(BASE + "SELECT id, label, date::DATE AS date FROM ev")
def graph_events(spark, sf_dir):
    return G.events(graph(spark, sf_dir))


@query(BASE + "SELECT id, value AS raw, value::DATE AS date FROM m WHERE key = 'occurredOnDate'")
def event_dates(spark, sf_dir):
    dated = graph(spark, sf_dir).nodes.select("id", F.try_element_at("metadata", F.lit("occurredOnDate")).alias("raw"), G.event_date(F.col("metadata")).alias("date"))
    return dated.where("raw is not null")


@query(BASE + f"SELECT row_number() OVER (ORDER BY date, ev.id) AS place, ev.id, date::DATE AS date, e.label AS role FROM ev JOIN e ON e.src = ev.id WHERE e.dst = '{CUSTOMER}'")
def graph_related_events(spark, sf_dir):
    return G.related_events(graph(spark, sf_dir), CUSTOMER)


@query(BASE + "SELECT src AS id, label AS role FROM e WHERE dst = 'tp:region1' AND label = 'inRegion' UNION ALL SELECT dst, label FROM e WHERE src = 'tp:region1' AND dst IN ('tp:Region', 'tp:Nation', 'tp:Place')")
def graph_related_nodes(spark, sf_dir):
    return G.related_nodes(graph(spark, sf_dir), "tp:region1", "Place")


@query(BASE + "SELECT id, date::DATE AS date, (-(10.0 * (count(*) OVER () - 1)) / 2 + 10.0 * (row_number() OVER (ORDER BY date, id) - 1))::DOUBLE AS \"offset\" FROM ev WHERE date IS NOT NULL")
def graph_timeline(spark, sf_dir):
    return G.timeline(graph(spark, sf_dir), 10.0)


@query(BASE + "SELECT ev.id, string_agg(e.label || ': ' || n.label, ' · ' ORDER BY e.id) AS summary FROM ev JOIN e ON e.src = ev.id JOIN n ON n.id = e.dst WHERE e.label NOT IN ('rdf:type', 'type') GROUP BY ev.id")
def graph_event_summary(spark, sf_dir):
    return G.event_summaries(graph(spark, sf_dir))


@query(BASE + "SELECT src AS s, coalesce(property, label) AS p, dst AS o FROM e UNION ALL SELECT id, key, '\"' || value || '\"' FROM m UNION ALL SELECT id, 'rdfs:label', '\"' || label || '\"' FROM n")
def sparql_dataset(spark, sf_dir):
    return G.dataset(graph(spark, sf_dir))


@query(BASE + "SELECT e.id FROM e JOIN n a ON a.id = e.src JOIN n b ON b.id = e.dst WHERE a.role = 'type' OR b.role = 'type'")
def graph_preset(spark, sf_dir):
    g = graph(spark, sf_dir)
    return G.visible_edges(g, facets=[WS.PRESETS[0].facet]).select("id")


@query(BASE + "SELECT id, CASE WHEN id IN ('tp:Customer', 'tp:Supplier', 'tp:Party') THEN 'party' WHEN id = 'tp:OrderEvent' OR id = 'tp:Event' THEN 'event' ELSE 'none' END AS icon FROM n WHERE role = 'type'")
def graph_class_icons(spark, sf_dir):
    return G.class_icons(graph(spark, sf_dir), {"Party": "party", "Event": "event"}, "none")


@query(BASE + f"SELECT id, i AS in_degree, o AS out_degree, i + o AS degree, (SELECT count(*) FROM m WHERE m.id = dg.id) AS fields FROM dg WHERE id = '{CUSTOMER}'")
def graph_inspect(spark, sf_dir):
    return G.inspected(graph(spark, sf_dir), CUSTOMER).select("id", "in_degree", "out_degree", "degree", F.size("fields").cast("bigint").alias("fields"))
