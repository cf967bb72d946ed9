"""Property graphs: building, degrees, neighbourhoods, class hierarchies, facets, events.

A graph is two tables: nodes (id, label, role, ontology_class, source, metadata map) and edges (id, src, dst, label,
property, kind). Loops over hops are joins of frontiers, those over class levels go twice as far each time and end
where nothing new is found; what a round finds is written to the shared folder, so that plans stay short and a lost executor costs one level.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veldspar.functions import terms as R
from veldspar.shared import written

DATE_KEYS = ("occurredOnDate", "occurredAtTime", "startDate", "endDate")
#: The root classes, and the edge labels that say nothing of an event.
ROOT_CLASSES = (
    "Person", "Organization", "Place", "Event", "Product", "Activity", "Award", "CreativeWork", "Education", "Facility", "GeographicFeature", "Industry", "Market", "Method", "Metric",
    "MilitaryOrganization", "PoliticalOrganization", "Occupation", "Organism", "Regulation", "Service", "Technology",
)
NOISE_LABELS = ("type", "rdf:type", "a", "hasParticipant", "participant", "label", "rdfs:label", "comment", "rdfs:comment")


#: Ids that a join sends to all tasks instead of sorting both sides; a key of more than HUB_ROWS rows is a hub, and its rows go to parts of about as many.
BROADCAST_IDS, HUB_ROWS = 100_000, 100_000


@dataclass(frozen=True)
class Graph:
    """`ids`, where given, are the ids of all nodes, among them both ends of every edge, and `types` those of the nodes
    that are types: cheaper than the nodes."""

    nodes: DataFrame
    edges: DataFrame
    ids: DataFrame | None = None
    types: DataFrame | None = None

    @property
    def type_ids(self) -> DataFrame:
        return self.nodes.where("role = 'type'").select("id") if self.types is None else self.types


# -- building


def from_triples(triples: DataFrame) -> Graph:
    """From (s, p, o, seq): types promote their objects, literals become metadata of their subjects (the last of a
    predicate wins), subClassOf promotes both ends, all else are relationships."""
    t = triples.withColumns({"is_type": R.is_type(F.col("p")), "local": R.local_name(F.col("p"))}).withColumn("is_literal", ~F.col("is_type") & F.col("o").startswith('"'))
    t = t.withColumn("is_sub", ~F.col("is_type") & ~F.col("is_literal") & (F.lower("local") == "subclassof"))
    edges = t.where("not is_literal").select(
        F.concat("s", F.lit("-"), F.when(F.col("is_type"), F.lit("rdf:type")).otherwise(F.col("p")), F.lit("-"), "o").alias("id"),
        F.col("s").alias("src"),
        F.col("o").alias("dst"),
        F.when(F.col("is_type"), F.lit("rdf:type")).otherwise(F.col("local")).alias("label"),
        F.when(~F.col("is_type"), F.col("p")).alias("property"),
        F.when(F.col("is_type"), "instanceOf").when(F.col("is_sub"), "subClassOf").otherwise("relationship").alias("kind"),
    )
    ids = t.select(F.explode(F.array("s", F.when(~F.col("is_literal"), F.col("o")))).alias("id")).where("id is not null").distinct()
    promoted = F.when(F.col("is_type"), F.array("o")).when(F.col("is_sub"), F.array("s", "o"))
    types = t.where("is_type or is_sub").select(F.explode(promoted).alias("id")).where("id is not null").distinct()
    return Graph(_nodes(t), edges, ids, types)


def from_records(records: DataFrame, id_col: str, from_col: str, to_col: str, edge_col: str | None, index_name: str) -> Graph:
    """The same rules over records with from, edge and to fields; rows without from or to are left out, an edge's
    id is its record's, and without an edge field the index names all edges."""
    label = F.coalesce(F.col(edge_col), F.lit("")) if edge_col else F.lit(index_name)
    t = records.where(F.col(from_col).isNotNull() & F.col(to_col).isNotNull()).select(F.col(id_col).cast("string").alias("rid"), F.col(from_col).cast("string").alias("s"), label.alias("p"), F.col(to_col).cast("string").alias("o"), F.col(id_col).alias("seq"))
    t = t.withColumns({"local": R.local_name(F.col("p")), "is_literal": F.col("o").startswith('"')})
    t = t.withColumns({"is_type": ~F.col("is_literal") & R.is_type(F.col("p")), "is_sub": ~F.col("is_literal") & (F.lower("local") == "subclassof")})
    kind = F.when(F.col("is_type"), "instanceOf").when(F.col("is_sub"), "subClassOf").otherwise("relationship")
    edges = t.where("not is_literal").select(F.col("rid").alias("id"), F.col("s").alias("src"), F.col("o").alias("dst"), F.col("local").alias("label"), F.col("p").alias("property"), kind.alias("kind"))
    return Graph(_nodes(t), edges)


def _nodes(t: DataFrame) -> DataFrame:
    """One aggregate over the ends of all triples: role, class and metadata of each node."""
    none = F.lit(None)
    ends = t.select(
        F.explode(
            F.array(
                F.struct(F.col("s").alias("id"), F.when(F.col("is_sub"), F.lit(1)).alias("promotes"), F.when(F.col("is_type"), F.col("o")).alias("cls"), F.when(F.col("is_literal"), F.col("local")).alias("key"), F.when(F.col("is_literal"), R.literal(F.col("o"))["lexical"]).alias("value"), (F.col("seq").cast("bigint") * 2 + 1).alias("at")),
                F.struct(F.when(~F.col("is_literal"), F.col("o")).alias("id"), F.when(F.col("is_type"), F.lit(2)).when(F.col("is_sub"), F.lit(1)).alias("promotes"), F.when(F.col("is_type"), F.col("o")).alias("cls"), none.cast("string").alias("key"), none.cast("string").alias("value"), (F.col("seq").cast("bigint") * 2).alias("at")),
            )
        ).alias("e")
    ).select("e.*").where("id is not null")
    literals = ends.where("key is not null").groupBy("id", "key").agg(F.max_by("value", "at").alias("value")).groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("metadata"))
    roles = ends.groupBy("id").agg(
        F.bool_or(F.col("promotes").isNotNull()).alias("is_type"),
        F.min_by(F.when(F.col("promotes").isNotNull(), F.col("promotes")), F.when(F.col("promotes").isNotNull(), F.col("at"))).alias("first"),
        F.min(F.when(F.col("promotes").isNotNull(), F.col("at"))).alias("promoted"),
        F.max_by("cls", F.when(F.col("cls").isNotNull(), F.col("at"))).alias("cls"),
        F.max(F.when(F.col("cls").isNotNull(), F.col("at"))).alias("classed"),
    )
    own = (F.col("first") == 1) & (F.col("classed").isNull() | (F.col("promoted") > F.col("classed")))
    return roles.join(literals, "id", "left").select(
        "id",
        R.local_name(F.col("id")).alias("label"),
        F.when(F.col("is_type"), "type").otherwise("instance").alias("role"),
        F.when(own, F.col("id")).otherwise(F.col("cls")).alias("ontology_class"),
        F.lit("graphIndex").alias("source"),
        F.coalesce("metadata", F.create_map().cast("map<string,string>")).alias("metadata"),
    )


def from_ontology(classes: DataFrame, sub_class_of: DataFrame, object_properties: DataFrame, data_properties: DataFrame, equivalents: DataFrame | None = None) -> Graph:
    """classes (iri, label, comment), sub_class_of (sub, sup), object_properties (iri, label, domains, ranges),
    data_properties (iri, label, domains, ranges), equivalents (iris): all classes of a set pairwise."""
    named = lambda label, iri: F.coalesce(label, R.local_name(iri))
    subs = sub_class_of.select(F.concat(F.lit("subClassOf-"), "sub", F.lit("-"), "sup").alias("id"), F.col("sub").alias("src"), F.col("sup").alias("dst"), F.lit("subClassOf").alias("label"), F.lit(None).cast("string").alias("property"), F.lit("subClassOf").alias("kind"))
    props = object_properties.select("iri", named(F.col("label"), F.col("iri")).alias("label"), F.explode("domains").alias("d"), "ranges").select("iri", "label", "d", F.explode("ranges").alias("r"))
    props = props.select(F.concat(F.lit("objProp-"), "iri", F.lit("-"), "d", F.lit("-"), "r").alias("id"), F.col("d").alias("src"), F.col("r").alias("dst"), "label", F.col("iri").alias("property"), F.lit("property").alias("kind"))
    edges = subs.unionByName(props)
    if equivalents is not None:
        pairs = equivalents.select(F.posexplode("iris").alias("i", "a"), "iris").select("i", "a", F.posexplode("iris").alias("j", "b")).where("i < j")
        edges = edges.unionByName(pairs.select(F.concat(F.lit("equivalentTo-"), "a", F.lit("-"), "b").alias("id"), F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("equivalentTo").alias("label"), F.lit(None).cast("string").alias("property"), F.lit("relationship").alias("kind")))
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    known = classes.select(F.col("iri").alias("id"), "label", "comment")
    data = data_properties.select(F.concat(F.lit("dp:"), named(F.col("label"), F.col("iri"))).alias("key"), F.when(F.size("ranges") > 0, F.array_join("ranges", ", ")).otherwise("Literal").alias("value"), F.explode("domains").alias("id"))
    data = data.groupBy("id", "key").agg(F.max("value").alias("value")).groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("dp"))
    comment = F.when(F.col("comment").isNotNull(), F.create_map(F.lit("comment"), F.col("comment"))).otherwise(F.create_map().cast("map<string,string>"))
    nodes = known.join(ends, "id", "full").join(data, "id", "left").select("id", named(F.col("label"), F.col("id")).alias("label"), F.lit("type").alias("role"), F.col("id").alias("ontology_class"), F.lit("ontology").alias("source"), F.map_concat(comment, F.coalesce("dp", F.create_map().cast("map<string,string>"))).alias("metadata"))
    return Graph(nodes, edges)


def merge_ontology(graph: Graph, classes: DataFrame, sub_class_of: DataFrame) -> Graph:
    """Adds classes (existing nodes become types and take the comment) and the subClassOf edges that are missing."""
    new_edges = from_ontology(classes, sub_class_of, *_no_properties(classes)).edges.join(graph.edges.select("id"), "id", "left_anti").dropDuplicates(["id"])
    ends = new_edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    known = classes.select(F.col("iri").alias("id"), F.col("label").alias("class_label"), "comment", F.lit(True).alias("is_class"))
    both = graph.nodes.join(known, "id", "full").join(ends.withColumn("is_end", F.lit(True)), "id", "full")
    new = F.col("role").isNull()
    none = F.create_map().cast("map<string,string>")
    comment = F.when(F.col("comment").isNotNull(), F.create_map(F.lit("comment"), F.col("comment"))).otherwise(none)
    own = F.map_filter(F.coalesce("metadata", none), lambda k, v: (k != "comment") | F.col("comment").isNull())
    nodes = both.select(
        "id",
        F.coalesce("label", "class_label", R.local_name(F.col("id"))).alias("label"),
        F.when(F.col("is_class") | new, "type").otherwise(F.col("role")).alias("role"),
        F.when(new, F.col("id")).otherwise(F.col("ontology_class")).alias("ontology_class"),
        F.coalesce("source", F.lit("ontology")).alias("source"),
        F.map_concat(own, comment).alias("metadata"),
    )
    return Graph(nodes, graph.edges.unionByName(new_edges))


def _no_properties(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    empty = df.sparkSession.createDataFrame([], "iri string, label string, domains array<string>, ranges array<string>")
    return empty, empty


def drop_thing(graph: Graph) -> Graph:
    """Without owl:Thing and its edges."""
    thing = lambda c: (F.col(c) == "owl:Thing") | F.col(c).endswith("#Thing")
    return Graph(graph.nodes.where(~thing("id")), graph.edges.where(~thing("src") & ~thing("dst")))


def dataset(graph: Graph) -> DataFrame:
    """Triples (s, p, o) for queries: edges, metadata as literals, labels."""
    edges = graph.edges.select(F.col("src").alias("s"), F.coalesce("property", "label").alias("p"), F.col("dst").alias("o"))
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    data = graph.nodes.select(F.col("id").alias("s"), F.explode("metadata").alias("p", "v")).select("s", "p", quoted(F.col("v")).alias("o"))
    labels = graph.nodes.select(F.col("id").alias("s"), F.lit("rdfs:label").alias("p"), quoted(F.col("label")).alias("o"))
    return edges.unionByName(data).unionByName(labels)


def at_hubs(rows: DataFrame, ids: DataFrame, key: str, how: str, counted: DataFrame | None = None) -> DataFrame:
    """rows joined to ids (a written table in which `key` is unique) by `key`, of which single values may hold most
    rows, as a class or a nation does. Few ids go to all tasks. More are sorted, by hint, as their size is guessed from a
    compressed file; a hub's rows are dealt over parts that each get its id. counted, where given, has the keys of rows
    and is cheaper to count."""
    if ids.count() <= BROADCAST_IDS:
        return rows.join(F.broadcast(ids), key, how)
    hubs, parts = F.broadcast(_hubs(rows if counted is None else counted, key)), F.coalesce("__parts", F.lit(1))
    dealt = rows.join(hubs, key, "left").withColumn("__part", F.pmod(F.xxhash64(*rows.columns), parts).cast("int")).drop("__parts")
    spread = ids.join(hubs, key, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    return dealt.join(spread.hint("merge"), [key, "__part"], how).drop("__part")


def _hubs(rows: DataFrame, key: str) -> DataFrame:
    """(key, __parts) of the hubs; of more than BROADCAST_IDS, those that hold at least such a share of their rows."""
    hubs = written(rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > HUB_ROWS))
    total = hubs.agg(F.sum("n")).first()[0] or 0
    return hubs.where(F.col("n") * BROADCAST_IDS >= total).select(key, F.ceil(F.col("n") / HUB_ROWS).cast("int").alias("__parts"))


# -- counts and degrees


def degrees(graph: Graph) -> DataFrame:
    """(id, in_degree, out_degree, degree); edges count whose ends both exist, a loop counts twice."""
    ids, sound = graph.ids, graph.edges
    if ids is None:
        ids = graph.nodes.select("id")
        sound = sound.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    ends = sound.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")
    all_ends = ends.unionByName(ids.select("id", F.lit(0).alias("o"), F.lit(0).alias("i")))
    counts = all_ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    return counts.select("id", "in_degree", "out_degree", (F.col("in_degree") + F.col("out_degree")).alias("degree"))


def edge_counts(graph: Graph) -> DataFrame:
    return graph.edges.groupBy("label").agg(F.count("*").alias("count"))


def by_role(graph: Graph) -> DataFrame:
    return graph.nodes.groupBy("role").agg(F.count("*").alias("count"))


def radius(degree: Column) -> Column:
    return 1 + F.log2(degree + 1) * 0.5


def backbone(graph: Graph) -> DataFrame:
    """Ids: all of a graph of fewer than 50 nodes, else all types and the min(200, max(30, n / 5)) of most edges."""
    n = graph.nodes.count()
    if n < 50:
        return graph.nodes.select("id")
    top = degrees(graph).orderBy(F.col("degree").desc(), "id").limit(min(200, max(30, n // 5))).select("id")
    return graph.nodes.where("role = 'type'").select("id").unionByName(top).distinct()


def curvature(edges: DataFrame) -> DataFrame:
    """(id, curvature): edges between two nodes bend apart, alternately, by id; a single edge is straight."""
    pair = [F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi")]
    keyed = edges.select("id", *pair)
    by = Window.partitionBy("lo", "hi")
    i = F.row_number().over(by.orderBy("id")) - 1
    level = (F.floor(i / 2) + 1) * 0.4
    return keyed.select("id", F.when(F.count("*").over(by) == 1, 0.0).when(i % 2 == 0, -level).otherwise(level).alias("curvature"))


# -- neighbourhoods


def neighbourhood(graph: Graph, start: str, hops: int = 1, labels: list[str] | None = None) -> DataFrame:
    """Ids within so many hops, whatever the direction, over edges of the labels that aren't subClassOf."""
    edges = graph.edges.where(~R.is_sub_class_of(F.col("label")))
    if labels is not None:
        edges = edges.where(F.col("label").isin(labels))
    seen = frontier = graph.nodes.sparkSession.createDataFrame([(start,)], "id string")
    for hop in range(hops):
        if hop == 0:
            out, back = edges.where(F.col("src") == start), edges.where(F.col("dst") == start)
        else:
            out, back = (at_hubs(edges.select("src", "dst"), frontier.withColumnRenamed("id", end), end, "left_semi") for end in ("src", "dst"))
        near = out.select(F.col("dst").alias("id")).unionByName(back.select(F.col("src").alias("id"))).distinct()
        frontier = near.join(seen, "id", "left_anti")
        if hop + 1 < hops:
            frontier = written(frontier)
        seen = seen.unionByName(frontier)
    return seen


def incident(graph: Graph, node: str) -> DataFrame:
    """(id, label, other, direction) of a node's edges."""
    e = graph.edges
    return e.where(F.col("dst") == node).select("id", "label", F.col("src").alias("other"), F.lit("in").alias("direction")).unionByName(e.where(F.col("src") == node).select("id", "label", F.col("dst").alias("other"), F.lit("out").alias("direction")))


# -- classes


def node_types(graph: Graph) -> DataFrame:
    """(id, type) of the edges labelled rdf:type or type."""
    return _types(graph).distinct()


def _types(graph: Graph) -> DataFrame:
    return graph.edges.where(F.col("label").isin("rdf:type", "type")).select(F.col("src").alias("id"), F.col("dst").alias("type"))


def parents(graph: Graph) -> DataFrame:
    return graph.edges.where(R.is_sub_class_of(F.col("label"))).select(F.col("src").alias("sub"), F.col("dst").alias("sup")).distinct()


def class_ids(graph: Graph) -> DataFrame:
    """Ids of types and of the ends of subClassOf that are nodes."""
    p = parents(graph)
    ids = graph.type_ids.unionByName(p.select(F.explode(F.array("sub", "sup")).alias("id"))).distinct()
    return ids if graph.ids is not None else ids.join(graph.nodes.select("id"), "id", "left_semi")


def closure(graph: Graph) -> DataFrame:
    """(sub, sup, depth): every class above each class, at its least depth; cycles end."""
    return _reach(parents(graph))


def _reach(step: DataFrame) -> DataFrame:
    """(sub, sup, depth) of all ways along steps (sub, sup): each round joins the ways so far to each other, so a chain
    of any length takes rounds as its logarithm."""
    now, was = written(step.select("sub", "sup", F.lit(1).alias("depth")).distinct()), None
    while (size := now.agg(F.count("*"), F.sum("depth")).first()) != was:
        more = now.select(F.col("sub").alias("sup"), F.col("sup").alias("far"), F.col("depth").alias("more"))
        longer = now.join(more, "sup").select("sub", F.col("far").alias("sup"), (F.col("depth") + F.col("more")).alias("depth"))
        now, was = written(now.unionByName(longer).groupBy("sub", "sup").agg(F.min("depth").alias("depth"))), size
    return now


def super_classes(graph: Graph, class_id: str) -> DataFrame:
    return parents(graph).where(F.col("sub") == class_id).select(F.col("sup").alias("id")).join(graph.nodes.select("id", "label"), "id")


def sub_classes(graph: Graph, class_id: str) -> DataFrame:
    return parents(graph).where(F.col("sup") == class_id).select(F.col("sub").alias("id")).join(graph.nodes.select("id", "label"), "id")


def nearest_ancestors(graph: Graph, matches: Column) -> DataFrame:
    """(id, ancestor): of each class the label of the nearest class, itself first, whose label column matches; of
    several at one depth that of the least id."""
    ids = class_ids(graph)
    up = ids.select(F.col("id").alias("sub"), F.col("id").alias("sup"), F.lit(0).alias("depth")).unionByName(closure(graph))
    named = up.join(graph.nodes.select(F.col("id").alias("sup"), "label"), "sup").where(matches)
    return named.groupBy(F.col("sub").alias("id")).agg(F.min_by("label", F.struct("depth", "sup")).alias("ancestor"))


def class_roots(graph: Graph, roots: tuple[str, ...] = ROOT_CLASSES) -> DataFrame:
    """(id, ancestor): classes by their nearest root class; instances by the first of their types that has one."""
    own = written(nearest_ancestors(graph, F.col("label").isin(*roots)))
    through = node_types(graph).join(own.withColumnRenamed("id", "type"), "type").groupBy("id").agg(F.min_by("ancestor", "type").alias("through"))
    return own.join(through, "id", "full").select("id", F.coalesce("through", "ancestor").alias("ancestor"))


def class_chain(graph: Graph, instance: str) -> DataFrame:
    """(depth, id): the instance's first type, then the first parent of each; stops where a class comes back."""
    first_parent = written(parents(graph).join(graph.nodes.select(F.col("id").alias("sup")), "sup", "left_semi").groupBy("sub").agg(F.min("sup").alias("sup")))
    start = node_types(graph).where(F.col("id") == instance).agg(F.min("type").alias("id")).where("id is not null")
    chain, jump, far, size = written(start.select(F.lit(0).alias("depth"), "id")), first_parent, 1, 0
    while (now := chain.count()) != size:  # a jump goes twice as far in every round; a class that comes back is no new one
        more = chain.join(jump, chain["id"] == jump["sub"]).select((F.col("depth") + far).alias("depth"), F.col("sup").alias("id"))
        chain, size = written(chain.unionByName(more).groupBy("id").agg(F.min("depth").alias("depth")).select("depth", "id")), now
        jump, far = written(jump.join(jump.select(F.col("sub").alias("sup"), F.col("sup").alias("next")), "sup").select("sub", F.col("next").alias("sup"))), 2 * far
    return chain


def leaf_types(graph: Graph) -> DataFrame:
    """(id, type): an instance's types of which none of its other types is a subclass."""
    classes = written(class_ids(graph))
    types = _types(graph)
    if graph.ids is None:
        types = types.join(graph.nodes.where("role = 'instance'").select("id"), "id", "left_semi")
    else:  # what has a type is a node, so it is no instance only if it is among the few that are types
        types = at_hubs(types, written(graph.type_ids), "id", "left_anti")
    types = at_hubs(types, classes.withColumnRenamed("id", "type"), "type", "left_semi")
    above = closure(graph).where("sub <> sup").join(types.select(F.col("type").alias("sup")).distinct(), "sup", "left_semi")
    above = written(above.groupBy(F.col("sub").alias("type")).agg(F.collect_set("sup").alias("above")))
    own = lambda t, covered: F.struct(t.alias("type"), F.lit(covered).alias("covered"))
    marked = at_hubs(types, above, "type", "left").select("id", F.explode(F.concat(F.array(own(F.col("type"), False)), F.transform(F.coalesce("above", F.array().cast("array<string>")), lambda t: own(t, True)))).alias("t"))
    return marked.groupBy("id", "t.type").agg(F.bool_or("t.covered").alias("covered")).where("not covered").select("id", "type")


def class_tree(graph: Graph) -> DataFrame:
    """(id, parent, depth, part): part tree for classes under the roots (Thing is skipped and its subclasses become
    roots; a class of several parents hangs under the one that is reached first, by label), cycle for classes of
    a hierarchy that no root reaches, orphan for classes outside it."""
    classes = written(class_ids(graph).join(graph.nodes.select("id", "label"), "id"))
    ids = classes.select("id")
    p = parents(graph).join(ids.withColumnRenamed("id", "sub"), "sub", "left_semi")
    p = written(p.join(classes.select(F.col("id").alias("sup"), F.col("label").alias("sup_label")), "sup"))
    members = p.select(F.explode(F.array("sub", "sup")).alias("id")).distinct()
    tops = members.join(p.select(F.col("sub").alias("id")).distinct(), "id", "left_anti").join(classes, "id")
    skipped = tops.where("label = 'Thing'").select("id")
    promoted = p.join(skipped.withColumnRenamed("id", "sup"), "sup", "left_semi").select(F.col("sub").alias("id"))
    roots = written(tops.where("label <> 'Thing'").select("id").unionByName(promoted).distinct())
    below = _reach(p.select("sub", "sup")).join(roots.select(F.col("id").alias("sup")), "sup", "left_semi").groupBy(F.col("sub").alias("id")).agg(F.min("depth").alias("depth"))
    below = below.join(roots, "id", "left_anti")
    depths = written(roots.select("id", F.lit(0).alias("depth")).unionByName(below))
    above = p.join(depths.select(F.col("id").alias("sup"), F.col("depth").alias("at")), "sup").join(below.select(F.col("id").alias("sub"), "depth"), "sub").where("at = depth - 1")
    hung = above.groupBy(F.col("sub").alias("id")).agg(F.min_by("sup", F.struct("sup_label", "sup")).alias("parent"))
    done = depths.join(hung, "id", "left").select("id", "parent", "depth")
    tree = done.withColumn("part", F.lit("tree"))
    rest = members.join(done.select("id"), "id", "left_anti").join(skipped, "id", "left_anti")
    flat = lambda df, part: df.select("id", F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth"), F.lit(part).alias("part"))
    return tree.unionByName(flat(rest, "cycle")).unionByName(flat(ids.join(members, "id", "left_anti"), "orphan"))


def untyped(graph: Graph) -> DataFrame:
    return graph.nodes.where("role = 'instance'").join(node_types(graph).select("id").distinct(), "id", "left_anti").select("id")


def individual_types(graph: Graph) -> DataFrame:
    return node_types(graph).select(F.col("type").alias("id")).distinct().join(graph.nodes.select("id", "label"), "id", "left").select("id", F.coalesce("label", R.local_name(F.col("id"))).alias("label"))


# -- search, facets, visibility


def class_icons(graph: Graph, icons: dict[str, str], default: str) -> DataFrame:
    """(id, icon): of each class its own icon, else that of its nearest ancestor that has one, else the default."""
    known = graph.nodes.sparkSession.createDataFrame(list(icons.items()), "ancestor string, icon string")
    near = nearest_ancestors(graph, F.col("label").isin(*icons)).join(F.broadcast(known), "ancestor")
    return class_ids(graph).join(near.select("id", "icon"), "id", "left").select("id", F.coalesce("icon", F.lit(default)).alias("icon"))


def first_ontology(axioms: DataFrame) -> DataFrame:
    """Of a store of ontologies, rows (ontology, ...), those of the first by name; none where the store is empty."""
    first = axioms.agg(F.min("ontology").alias("ontology"))
    return axioms.join(F.broadcast(first), "ontology", "left_semi")


def inspected(graph: Graph, node: str) -> DataFrame:
    """One row of a node: id, in_degree, out_degree, degree, and its metadata apart from and with links."""
    own = graph.nodes.where(F.col("id") == node).select("id", "metadata")
    near = incident(graph, node).agg(F.count_if(F.col("direction") == "in").alias("in_degree"), F.count_if(F.col("direction") == "out").alias("out_degree"))
    link = lambda k, v: v.startswith("http://") | v.startswith("https://")
    both = own.crossJoin(F.broadcast(near))  # one row each
    return both.select("id", "in_degree", "out_degree", (F.col("in_degree") + F.col("out_degree")).alias("degree"), F.map_filter("metadata", lambda k, v: ~link(k, v)).alias("fields"), F.map_filter("metadata", link).alias("links"))


def matching_nodes(graph: Graph, text: str) -> DataFrame:
    low = F.lit(text.strip().lower())
    hit = F.contains(F.lower("label"), low) | F.exists(F.map_values("metadata"), lambda v: F.contains(F.lower(v), low))
    return graph.nodes.where(hit).select("id")


@dataclass(frozen=True)
class Facet:
    """kind: nodeRole, nodeType, nodeSource, edgeKind, edgeLabel (values), metricThreshold (metric, op, value: the
    degree) or metadataContains (key or None, text)."""

    kind: str
    values: tuple = ()
    exclude: bool = False

    @property
    def of_edges(self) -> bool:
        return self.kind in ("edgeKind", "edgeLabel")


def facet_nodes(graph: Graph, facet: Facet) -> DataFrame:
    """Ids of the nodes that a node facet matches."""
    n = graph.nodes
    if facet.kind == "nodeRole":
        return graph.type_ids if facet.values == ("type",) else n.where(F.col("role").isin(*facet.values)).select("id")
    if facet.kind == "nodeSource":
        return n.where(F.col("source").isin(*facet.values)).select("id")
    if facet.kind == "nodeType":
        typed = node_types(graph).groupBy("id").agg(F.bool_or(F.col("type").isin(*facet.values)).alias("hit"))
        hit = F.coalesce(F.col("ontology_class").isin(*facet.values), F.lit(False)) | F.coalesce("hit", F.col("id").isin(*facet.values))
        return n.join(typed, "id", "left").where(hit).select("id")
    if facet.kind == "metricThreshold":
        _, op, value = facet.values
        d = F.col("degree")
        return degrees(graph).where({">": d > value, "<": d < value, ">=": d >= value, "<=": d <= value}[op]).select("id")
    key, text = facet.values
    low = F.lit(text.lower())
    if key is not None:
        return n.where(F.coalesce(F.contains(F.lower(F.try_element_at("metadata", F.lit(key))), low), F.lit(False))).select("id")
    return n.where(F.exists(F.map_values("metadata"), lambda v: F.contains(F.lower(v), low))).select("id")


def apply_facets(graph: Graph, facets: list[Facet]) -> DataFrame:
    """Edges that pass all facets. A node facet keeps an edge of which either end matches; excluding drops an edge
    only if both ends match."""
    edges = graph.edges
    for facet in facets:
        if facet.of_edges:
            hit = F.col("kind" if facet.kind == "edgeKind" else "label").isin(*facet.values)
            edges = edges.where(~hit if facet.exclude else hit)
            continue
        ids = facet_nodes(graph, facet).distinct()
        flagged = _flagged(edges, ids)
        s, d = F.coalesce("__s", F.lit(False)), F.coalesce("__d", F.lit(False))
        edges = flagged.where(~(s & d) if facet.exclude else s | d).select(*graph.edges.columns)
    return edges


def _flagged(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with __s and __d: true where src and where dst is among the ids, else null."""
    ids, flagged = written(ids), edges
    for end, flag in (("src", "__s"), ("dst", "__d")):
        flagged = at_hubs(flagged, ids.select(F.col("id").alias(end), F.lit(True).alias(flag)), end, "left", edges)
    return flagged


def visible_edges(graph: Graph, labels: list[str] | None = None, show_classes: bool = True, on_backbone: bool = False, selected: str | None = None, hops: int | None = None, text: str = "", facets: list[Facet] | None = None) -> DataFrame:
    """Edges by label, then class nodes, backbone, neighbourhood, search and facets."""
    edges = graph.edges if labels is None else graph.edges.where(F.col("label").isin(labels))
    inside = lambda e, ids: e.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")
    if not show_classes:
        types, labelled = written(graph.type_ids), edges
        for end in ("src", "dst"):
            edges = at_hubs(edges, types.withColumnRenamed("id", end), end, "left_anti", labelled)
    if on_backbone and hops is None and not text.strip():
        edges = inside(edges, written(backbone(graph)))
    if selected is not None and hops is not None:
        edges = inside(edges, neighbourhood(graph, selected, hops, labels).distinct())
    if text.strip():
        hit = matching_nodes(graph, text)
        flagged = _flagged(edges, hit)
        edges = flagged.where("__s or __d").select(*graph.edges.columns)
    edges = edges.select(*graph.edges.columns)
    return apply_facets(replace(graph, edges=edges), facets) if facets else edges


def visible_nodes(graph: Graph, edges: DataFrame, selected: str | None = None, show_classes: bool = True, with_backbone: bool = False) -> DataFrame:
    ids = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    if selected is not None:
        ids = ids.unionByName(graph.nodes.sparkSession.createDataFrame([(selected,)], "id string"))
    if with_backbone:
        ids = ids.unionByName(backbone(graph))
    out = graph.nodes.join(ids.distinct(), "id", "left_semi")
    return out if show_classes else out.where("role <> 'type'")


def delta(old: Graph, new: Graph) -> DataFrame:
    """(what, change, value): ids of nodes and labels of edges that came or went."""
    out = None
    for what, a, b in (("node", old.nodes.select("id"), new.nodes.select("id")), ("label", old.edges.select("label"), new.edges.select("label"))):
        for change, x, y in (("added", b, a), ("removed", a, b)):
            rows = x.subtract(y).toDF("value").select(F.lit(what).alias("what"), F.lit(change).alias("change"), "value")
            out = rows if out is None else out.unionByName(rows)
    return out


# -- events


def event_date(metadata: Column) -> Column:
    return F.coalesce(*[R.xsd_date(F.try_element_at(metadata, F.lit(k))) for k in ("occurredOnDate", "startDate", "endDate")])


def events(graph: Graph) -> DataFrame:
    """(id, label, date): nodes with a type whose label holds Event, or with a date."""
    types = _types(graph)
    used = written(types.select("type").distinct())
    labels = at_hubs(graph.nodes.select(F.col("id").alias("type"), F.col("label").alias("type_label")), used, "type", "left_semi")
    named = used.join(labels, "type", "left").where(F.coalesce("type_label", R.local_name(F.col("type"))).contains("Event")).select("type")
    typed = at_hubs(types, written(named), "type", "left_semi").select("id", F.lit(True).alias("typed")).distinct()
    dated = F.exists(F.map_keys("metadata"), lambda k: k.isin(*DATE_KEYS))
    return graph.nodes.join(typed, "id", "left").where(F.coalesce("typed", F.lit(False)) | dated).select("id", "label", event_date(F.col("metadata")).alias("date"))


def related_events(graph: Graph, node: str) -> DataFrame:
    """(place, id, date, role): events by an edge of the node, each once (edges that come in first), by date, those
    without a date last by label."""
    near = incident(graph, node).select(F.col("other").alias("id"), F.col("label").alias("role"), "direction", F.col("id").alias("edge"))
    once = near.groupBy("id").agg(F.min_by("role", F.struct("direction", "edge")).alias("role"))
    found = events(graph).join(once, "id")
    order = Window.orderBy(F.col("date").asc_nulls_last(), F.when(F.col("date").isNull(), F.col("label")).asc_nulls_first(), "id")
    return found.select(F.row_number().over(order).alias("place"), "id", "date", "role")


def related_nodes(graph: Graph, node: str, root: str) -> DataFrame:
    """(id, role): the node's neighbours of a root class, each once."""
    near = incident(graph, node).select(F.col("other").alias("id"), F.col("label").alias("role"), "direction", F.col("id").alias("edge"))
    own = written(nearest_ancestors(graph, F.col("label").isin(*ROOT_CLASSES)))
    labels = graph.nodes.select(F.col("id").alias("type"), F.col("label").alias("type_label"))
    types = node_types(graph).join(own.withColumnRenamed("id", "type"), "type", "left").join(labels, "type", "left")
    through = types.where((F.col("ancestor") == root) | F.coalesce("type_label", R.local_name(F.col("type"))).contains(root)).select("id")
    direct = own.where(F.col("ancestor") == root).join(graph.nodes.where("role = 'type'").select("id"), "id", "left_semi").select("id")
    once = near.groupBy("id").agg(F.min_by("role", F.struct("direction", "edge")).alias("role"))
    return once.join(through.unionByName(direct).distinct(), "id", "left_semi").join(graph.nodes.select("id"), "id", "left_semi").select("id", "role")


def timeline(graph: Graph, spacing: float) -> DataFrame:
    """(id, date, offset): dated events evenly spaced about 0, by date and id. Places are counted by date first,
    so that no task sorts all events."""
    dated = events(graph).where("date is not null")
    per = dated.groupBy("date").agg(F.count("*").alias("n"))
    before = per.select("date", (F.sum("n").over(Window.orderBy("date")) - F.col("n")).alias("before"))
    total = per.agg(F.sum("n").alias("total"))
    own = F.row_number().over(Window.partitionBy("date").orderBy("id")) - 1
    placed = dated.withColumn("own", own).join(before, "date").crossJoin(F.broadcast(total))
    return placed.select("id", "date", (-(F.lit(spacing) * (F.col("total") - 1)) / 2 + F.lit(spacing) * (F.col("before") + F.col("own"))).alias("offset"))


def event_summaries(graph: Graph) -> DataFrame:
    """(id, summary): label: target of each event's edges but those that say nothing, by edge id."""
    out = graph.edges.select("id", "src", "dst", R.local_name(F.col("label")).alias("label")).where(~F.col("label").isin(*NOISE_LABELS))
    named = out.join(graph.nodes.select(F.col("id").alias("dst"), F.col("label").alias("target")), "dst", "left")
    parts = F.struct("id", F.concat("label", F.lit(": "), F.coalesce("target", R.local_name(F.col("dst")))).alias("text"))
    per = named.groupBy(F.col("src").alias("node")).agg(F.array_sort(F.collect_list(parts)).alias("parts"))
    return events(graph).join(per, F.col("id") == F.col("node")).select("id", F.array_join(F.transform("parts", lambda p: p["text"]), " · ").alias("summary"))
