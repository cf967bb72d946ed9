"""What surrounds the evaluators: entity trees, index descriptions, filter presets, saved queries, panels."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldspar.operators.analytics import Aggregation, aggregate
from veldspar.operators.graph import Facet
from veldspar.operators.ranks import placed
from veldspar.sources.readers import tables

#: Index kinds, the structures they have and the states an index is in.
INDEX_KINDS = ("scalar", "vector", "fulltext", "spatial", "graph", "rank", "bitmap", "version", "relationship", "leaderboard", "permuted", "count", "sum", "average", "min", "max")
INDEX_STRUCTURES = ("flat", "hierarchical", "aggregation")
INDEX_STATES = ("readable", "writeOnly", "disabled")
TOOL_KINDS = {"graph": "graph", "spatial": "map", "fulltext": "search", "vector": "vector"}
HISTORY_KEPT, CONNECTIONS_KEPT = 20, 10


@dataclass(frozen=True)
class Index:
    name: str
    kind: str
    fields: tuple[str, ...] = ()
    state: str = "readable"
    unique: bool = False
    sparse: bool = False

    def __post_init__(self):
        if self.kind not in INDEX_KINDS or self.state not in INDEX_STATES:
            raise ValueError(f"unknown index kind or state: {self.kind}, {self.state}")


@dataclass(frozen=True)
class Entity:
    name: str
    path: tuple[str, ...] = ()
    partitions: tuple[str, ...] = ()
    indexes: tuple[Index, ...] = ()

    @property
    def tools(self) -> tuple[str, ...]:
        """Tools that the entity's indexes offer; analytics always."""
        return tuple(dict.fromkeys([*(TOOL_KINDS[i.kind] for i in self.indexes if i.kind in TOOL_KINDS), "analytics"]))


def entity_tree(spark: SparkSession, entities: list[Entity]) -> DataFrame:
    """(path, parent, name, depth, is_entity): folders of the static paths and entities; an entity without a path
    stands under _root."""
    rows: dict[str, tuple] = {}
    for e in sorted(entities, key=lambda e: e.name):
        parent = None
        for k, step in enumerate(e.path or ("_root",)):
            path = step if parent is None else f"{parent}/{step}"
            rows.setdefault(path, (path, parent, step, k, False))
            parent = path
        rows[f"{parent}/{e.name}"] = (f"{parent}/{e.name}", parent, e.name, len(e.path or ("_root",)), True)
    return spark.createDataFrame(list(rows.values()), "path string, parent string, name string, depth int, is_entity boolean")


def load_entities(spark: SparkSession, folder: str) -> list[Entity]:
    """The tables of a folder, by name; a missing folder fails."""
    return [Entity(name) for name in tables(spark, folder)]


@dataclass(frozen=True)
class Preset:
    name: str
    facet: Facet


#: The roles and sources of nodes, the kinds of edges, and the filters that are offered ready-made.
NODE_ROLES, NODE_SOURCES = ("type", "instance", "property", "literal"), ("ontology", "graphIndex", "persistable", "derived")
EDGE_KINDS = ("subClassOf", "instanceOf", "relationship", "property")
PRESETS = (
    Preset("Types Only", Facet("nodeRole", ("type",))),
    Preset("Instances Only", Facet("nodeRole", ("instance",))),
    Preset("Hide Literals", Facet("nodeRole", ("literal",), exclude=True)),
    Preset("Ontology Only", Facet("nodeSource", ("ontology",))),
    Preset("Graph Data Only", Facet("nodeSource", ("graphIndex",))),
)


def initial_facet(kind: str) -> Facet:
    """What a new filter of a kind starts with: everything where its values are known, else nothing chosen."""
    known = {"nodeRole": NODE_ROLES, "nodeSource": NODE_SOURCES, "edgeKind": EDGE_KINDS, "nodeType": (), "edgeLabel": (), "metricThreshold": ("degree", ">", 0.0), "metadataContains": (None, "")}
    if kind not in known:
        raise ValueError(f"unknown kind of filter: {kind}")
    return Facet(kind, known[kind])


def pick_fields(profile: DataFrame, text: str = "") -> DataFrame:
    """Fields that are no objects and whose path or name holds the text."""
    low = F.lit(text.strip().lower())
    return profile.where("type <> 'object'").where(F.contains(F.lower("path"), low) | F.contains(F.lower("name"), low))


def robust_bounds(df: DataFrame, value_cols: list[str], trim: float = 0.025, least: int = 50) -> DataFrame:
    """One row of low_<c> and high_<c>: without the outer 2.5 % on each side where there are 50 rows or more."""
    n = df.count()
    out = None
    for c in value_cols:
        if n < least:
            one = df.agg(F.min(c).alias(f"low_{c}"), F.max(c).alias(f"high_{c}"))
        else:
            lo, hi = int(n * trim), n - 1 - int(n * trim)
            ranked = placed(df, c)
            one = ranked.agg(F.min(F.when(F.col("upto") > lo, F.col("x"))).alias(f"low_{c}"), F.min(F.when(F.col("upto") > hi, F.col("x"))).alias(f"high_{c}"))
        out = one if out is None else out.crossJoin(one)  # one row each
    return out


@dataclass
class SavedQueries:
    """History of queries: the newest first, so many kept; the most used."""

    kept: int = HISTORY_KEPT
    _items: list[str] = field(default_factory=list)
    _uses: dict[str, int] = field(default_factory=dict)

    def add(self, text: str) -> None:
        self._items = [text, *(x for x in self._items if x != text)][: self.kept]
        self._uses[text] = self._uses.get(text, 0) + 1

    def recent(self, n: int = 5) -> list[str]:
        return self._items[:n]

    def frequent(self, n: int = 5) -> list[str]:
        return sorted(self._items, key=lambda x: (-self._uses[x], x))[:n]


@dataclass
class Connections:
    """Paths of stores: the newest first; favourites stay, of others so many."""

    kept: int = CONNECTIONS_KEPT
    _items: list[str] = field(default_factory=list)
    _favourites: set[str] = field(default_factory=set)

    def add(self, path: str, favourite: bool = False) -> None:
        if favourite:
            self._favourites.add(path)
        ordered = [path, *(x for x in self._items if x != path)]
        others = [x for x in ordered if x not in self._favourites][: self.kept]
        self._items = [x for x in ordered if x in self._favourites or x in others]

    def all(self) -> list[str]:
        return list(self._items)


class Panels:
    """Aggregations over one table; each runs again when asked."""

    def __init__(self, df: DataFrame):
        self.df, self.queries = df, []

    def add(self, query: Aggregation) -> int:
        self.queries.append(query)
        return len(self.queries) - 1

    def remove(self, k: int) -> None:
        del self.queries[k]

    def kind(self, k: int) -> str:
        return "bar" if self.queries[k].group_by else "kpi"

    def results(self, k: int) -> DataFrame:
        return aggregate(self.df, self.queries[k])


def node_links(metadata: dict[str, str]) -> tuple[dict[str, str], dict[str, str]]:
    """A node's metadata, and those of its values that are links."""
    links = {k: v for k, v in metadata.items() if v.startswith(("http://", "https://"))}
    return {k: v for k, v in metadata.items() if k not in links}, links
