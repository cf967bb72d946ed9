"""SPARQL queries over the graph's triples."""

from __future__ import annotations

from pyspark.sql import functions as F

from veldspar.functions import values as V
from veldspar.operators import graph as G
from veldspar.plans import sparql
from veldspar.plans.catalog import query
from veldspar.plans.q_graph import BASE, graph
from veldspar.plans.sparql import compiler

D = BASE + """, d AS (SELECT src AS s, coalesce(property, label) AS p, dst AS o FROM e UNION ALL SELECT id, key, '"' || value || '"' FROM m UNION ALL SELECT id, 'rdfs:label', '"' || label || '"' FROM n),
seg AS (SELECT s, trim(o, '"') AS v FROM d WHERE p = 'segment'), bal AS (SELECT s, TRY_CAST(trim(o, '"') AS BIGINT) AS v FROM d WHERE p = 'balance'), nat AS (SELECT s, o FROM d WHERE p = 'tp:inNation'), reg AS (SELECT s, o FROM d WHERE p = 'tp:inRegion') """


def _run(spark, sf_dir, text: str, dialect: str = "compat"):
    return sparql.select(G.dataset(graph(spark, sf_dir)), text, dialect)


def _register(name: str, text: str, sql: str | None, dialect: str = "compat"):
    def run(spark, sf_dir):
        return _run(spark, sf_dir, text, dialect)

    run.__name__ = run.__qualname__ = name
    run.__doc__ = text
    query(D + sql if sql else None)(run)


#: (name, query, SQL over d and its parts)
CASES = [
    ("sparql_triple", "SELECT ?s WHERE { ?s tp:inNation tp:nation7 }", "SELECT s FROM nat WHERE o = 'tp:nation7'"),
    ("sparql_bgp2", "SELECT ?c ?r WHERE { ?c tp:inNation ?n . ?n tp:inRegion ?r . }", "SELECT nat.s AS c, reg.o AS r FROM nat JOIN reg ON reg.s = nat.o"),
    ("sparql_bgp3", "SELECT ?o ?c ?r WHERE { ?o tp:placedBy ?c ; <occurredOnDate> ?d . ?c tp:inNation ?n . ?n tp:inRegion ?r , ?r }", "SELECT p.s AS o, p.o AS c, reg.o AS r FROM d p JOIN d o ON o.s = p.s AND o.p = 'occurredOnDate' JOIN nat ON nat.s = p.o JOIN reg ON reg.s = nat.o WHERE p.p = 'tp:placedBy'"),
    ("sparql_repeated", "SELECT ?x WHERE { ?x ?p ?x }", "SELECT s AS x FROM d WHERE s = o"),
    ("sparql_select_all", "SELECT * WHERE { ?n tp:inRegion ?r OPTIONAL { ?n <segment> ?none } }", "SELECT s AS n, '' AS none, o AS r FROM reg"),
    ("sparql_select_vars", "SELECT ?v ?missing WHERE { ?c <segment> ?v }", "SELECT v, '' AS missing FROM seg"),
    ("sparql_select_expr", "SELECT (?v + 1 AS ?w) WHERE { ?c <balance> ?v } GROUP BY ?c", "SELECT (v + 1)::VARCHAR AS w FROM bal"),
    ("sparql_expr_not_grouped", "SELECT (?v + 1 AS ?w) WHERE { ?c <balance> ?v }", "SELECT '' AS w FROM bal"),
    ("sparql_prefix", "PREFIX x: <tp:> SELECT ?r WHERE { x:nation3 x:inRegion ?r }", "SELECT o AS r FROM reg WHERE s = 'tp:nation3'"),
    ("sparql_type_full", "SELECT ?s WHERE { ?s a tp:Region }", "SELECT s FROM d WHERE false"),
    ("sparql_type_text", "SELECT ?s WHERE { ?s <rdf:type> tp:Region }", "SELECT s FROM d WHERE p = 'rdf:type' AND o = 'tp:Region'"),
    ("sparql_filter", "SELECT ?c ?v WHERE { ?c <balance> ?v FILTER(?v > 5000 && ?v <= 6000.5) }", "SELECT s AS c, v::VARCHAR AS v FROM bal WHERE v > 5000 AND v <= 6000.5"),
    ("sparql_filter_first", "SELECT ?c WHERE { FILTER(?v > 5000) ?c <balance> ?v }", "SELECT s AS c FROM d WHERE false"),
    ("sparql_compare", "SELECT ?c WHERE { ?c <balance> ?v FILTER(?v != 100 && ?v >= 8000 || ?v < 0) }", "SELECT s AS c FROM bal WHERE (v <> 100 AND v >= 8000) OR v < 0"),
    ("sparql_compare_text", "SELECT ?c WHERE { ?c <segment> ?v FILTER(?v = \"BUILDING\") }", "SELECT s AS c FROM d WHERE false"),
    ("sparql_logic", "SELECT ?c WHERE { ?c <balance> ?v FILTER(!(?v > 0) || ?v = 7 || !?v) }", "SELECT s AS c FROM bal WHERE v <= 0 OR v = 7"),
    ("sparql_arith", "SELECT ?c ?w ?x ?y WHERE { ?c <balance> ?v BIND(?v * 2 - 10 AS ?w) BIND(?v + \"a\" AS ?x) BIND(?c * 3 AS ?y) }", "SELECT s AS c, (v * 2 - 10)::VARCHAR AS w, v || 'a' AS x, '0' AS y FROM bal"),
    ("sparql_divide", "SELECT ?c ?w WHERE { ?c <balance> ?v BIND(?v / 4 AS ?w) FILTER(?c / 2 = 0) }", "SELECT s AS c, CASE WHEN v % 4 = 0 THEN (v // 4)::VARCHAR ELSE (v / 4)::DOUBLE::VARCHAR END AS w FROM bal"),
    ("sparql_bound", "SELECT ?c WHERE { ?c tp:inNation ?n OPTIONAL { ?c <balance> ?v } FILTER(!BOUND(?v)) }", "SELECT s AS c FROM nat WHERE s NOT IN (SELECT s FROM bal)"),
    ("sparql_isiri", "SELECT ?x WHERE { tp:customer7 ?p ?x FILTER(ISIRI(?x) && !ISLITERAL(?x)) }", "SELECT CASE WHEN starts_with(o, '\"') THEN trim(o, '\"') ELSE o END AS x FROM d WHERE s = 'tp:customer7' AND (NOT starts_with(o, '\"') OR regexp_matches(o, '^\"-?[0-9]+\"$'))"),
    ("sparql_str", "SELECT ?c ?t WHERE { ?c <segment> ?v BIND(STR(?v) AS ?t) FILTER(STR(?v) = \"BUILDING\") }", "SELECT s AS c, v AS t FROM seg WHERE v = 'BUILDING'"),
    ("sparql_lang", "SELECT ?n ?l WHERE { ?n <name> ?v BIND(LANG(?v) AS ?l) }", "SELECT s AS n, '' AS l FROM d WHERE p = 'name'"),
    ("sparql_regex", "SELECT ?c WHERE { ?c <segment> ?v FILTER(REGEX(?v, \"^auto|TURE$\", \"i\")) }", "SELECT s AS c FROM seg WHERE regexp_matches(lower(v), '^auto|ture$')"),
    ("sparql_bind", "SELECT ?c ?t ?u WHERE { ?c <segment> ?v BIND(STR(?v) AS ?t) BIND(?none AS ?u) FILTER(BOUND(?u)) }", "SELECT s AS c, v AS t, '' AS u FROM seg"),
    ("sparql_join", "SELECT ?c ?v ?n WHERE { { ?c <segment> ?v } { ?c tp:inNation ?n } }", "SELECT seg.s AS c, v, o AS n FROM seg JOIN nat ON nat.s = seg.s"),
    ("sparql_optional", "SELECT ?c ?v WHERE { ?c tp:inNation ?n OPTIONAL { ?c <balance> ?v FILTER(?v > 1000) } }", "SELECT nat.s AS c, coalesce(v::VARCHAR, '') AS v FROM nat LEFT JOIN bal ON bal.s = nat.s AND v > 1000"),
    ("sparql_optional_join", "SELECT ?c ?v ?w WHERE { ?c tp:inNation tp:nation3 OPTIONAL { ?c <segment> ?v } OPTIONAL { ?x <segment> ?v . ?x <balance> ?w FILTER(?w > 9900) } }", "SELECT a.s AS c, coalesce(a.v, b.v, '') AS v, coalesce(b.w::VARCHAR, '') AS w FROM (SELECT nat.s, seg.v FROM nat LEFT JOIN seg ON seg.s = nat.s WHERE nat.o = 'tp:nation3') a LEFT JOIN (SELECT seg.v, bal.v AS w FROM seg JOIN bal ON bal.s = seg.s WHERE bal.v > 9900) b ON a.v = b.v OR a.v IS NULL"),
    ("sparql_minus", "SELECT ?c WHERE { ?c tp:inNation ?n MINUS { ?c <segment> ?s FILTER(STR(?s) != \"BUILDING\") } }", "SELECT s AS c FROM nat WHERE s NOT IN (SELECT s FROM seg WHERE v <> 'BUILDING')"),
    ("sparql_minus_none", "SELECT ?c WHERE { ?c tp:inNation ?n MINUS { ?x <segment> ?s } }", "SELECT s AS c FROM nat"),
    ("sparql_union", "SELECT ?x ?n ?r WHERE { { ?x tp:inNation ?n } UNION { ?x tp:inRegion ?r } }", "SELECT s AS x, o AS n, '' AS r FROM nat UNION ALL SELECT s, '', o FROM reg"),
    ("sparql_order", "SELECT ?c ?v WHERE { ?c <balance> ?v } ORDER BY DESC(?v) ?c LIMIT 50", "SELECT s AS c, v::VARCHAR AS v FROM bal ORDER BY bal.v DESC, s LIMIT 50"),
    ("sparql_order_lenient", "SELECT ?c WHERE { ?c <balance> ?v } ORDER BY (?v / 0) ?c LIMIT 9", "SELECT s AS c FROM bal ORDER BY s LIMIT 9"),
    ("sparql_distinct", "SELECT DISTINCT ?v WHERE { ?c <segment> ?v }", "SELECT v FROM seg"),
    ("sparql_limit", "SELECT ?c WHERE { ?c <segment> ?v } ORDER BY ?c OFFSET 5 LIMIT 10", "SELECT s AS c FROM seg ORDER BY s LIMIT 10 OFFSET 5"),
    ("sparql_group", "SELECT ?v (COUNT(*) AS ?n) WHERE { ?c <segment> ?v } GROUP BY ?v", "SELECT v, count(*)::VARCHAR AS n FROM seg GROUP BY v"),
    ("sparql_group_none", "SELECT (COUNT(*) AS ?n) (SUM(?v) AS ?t) WHERE { ?c <nothing> ?v }", "SELECT '0' AS n, '0' AS t"),
    ("sparql_group_first", "SELECT ?v ?c WHERE { ?c <segment> ?v } GROUP BY ?v", "SELECT v, min(s) AS c FROM seg GROUP BY v"),
    ("sparql_count", "SELECT ?n (COUNT(?v) AS ?a) (COUNT(DISTINCT ?v) AS ?b) (COUNT(DISTINCT *) AS ?d) WHERE { ?c tp:inNation ?n OPTIONAL { ?c <balance> ?v } } GROUP BY ?n", "SELECT o AS n, count(v)::VARCHAR AS a, count(DISTINCT v)::VARCHAR AS b, count(DISTINCT nat.s)::VARCHAR AS d FROM nat LEFT JOIN bal ON bal.s = nat.s GROUP BY o"),
    ("sparql_sum", "SELECT ?n (SUM(?v) AS ?t) (SUM(DISTINCT ?v) AS ?u) WHERE { ?c tp:inNation ?n ; <balance> ?v } GROUP BY ?n", "SELECT o AS n, sum(v)::BIGINT::VARCHAR AS t, sum(DISTINCT v)::BIGINT::VARCHAR AS u FROM nat JOIN bal ON bal.s = nat.s GROUP BY o"),
    ("sparql_minmax", "SELECT ?n (MIN(?v) AS ?a) (MAX(?v) AS ?b) (MIN(?g) AS ?x) (MAX(?g) AS ?y) WHERE { ?c tp:inNation ?n ; <balance> ?v ; <segment> ?g } GROUP BY ?n", "SELECT o AS n, min(bal.v)::VARCHAR AS a, max(bal.v)::VARCHAR AS b, min(seg.v) AS x, max(seg.v) AS y FROM nat JOIN bal ON bal.s = nat.s JOIN seg ON seg.s = nat.s GROUP BY o"),
    ("sparql_agg_expr", "SELECT ?n (SUM(?v) * 2 + COUNT(?v) AS ?t) WHERE { ?c tp:inNation ?n ; <balance> ?v } GROUP BY ?n", "SELECT o AS n, (sum(v) * 2 + count(*))::BIGINT::VARCHAR AS t FROM nat JOIN bal ON bal.s = nat.s GROUP BY o"),
    ("sparql_having", "SELECT ?n (COUNT(*) AS ?k) WHERE { ?c tp:inNation ?n } GROUP BY ?n HAVING(?k > 5)", "SELECT o AS n, count(*)::VARCHAR AS k FROM nat GROUP BY o HAVING count(*)::VARCHAR > '5'"),
    ("sparql_typed", "SELECT ?s ?o WHERE { ?s <occurredOnDate> ?o FILTER(?o < 3 || STR(?o) > \"1998\") }", "SELECT s, trim(o, '\"') AS o FROM d WHERE p = 'occurredOnDate' AND (o < '3' OR trim(o, '\"') > '1998')"),
]
for _name, _text, _sql in CASES:
    _register(_name, _text, _sql)

#: The same grammar with standard semantics.
W3C = [
    ("w3c_type", "SELECT ?s WHERE { ?s a tp:Region }", "SELECT s FROM d WHERE p = 'rdf:type' AND o = 'tp:Region'"),
    ("w3c_filter_first", "SELECT ?c WHERE { FILTER(?v > 5000) ?c <balance> ?v }", "SELECT s AS c FROM bal WHERE v > 5000"),
    ("w3c_compare_text", "SELECT ?c WHERE { ?c <segment> ?v FILTER(?v = \"BUILDING\") }", "SELECT s AS c FROM seg WHERE v = 'BUILDING'"),
    ("w3c_distinct", "SELECT DISTINCT ?v WHERE { ?c <segment> ?v }", "SELECT DISTINCT v FROM seg"),
    ("w3c_expr", "SELECT ?c (?v + 1 AS ?w) WHERE { ?c <balance> ?v }", "SELECT s AS c, (v + 1)::VARCHAR AS w FROM bal"),
    ("w3c_having", "SELECT ?n (COUNT(*) AS ?k) WHERE { ?c tp:inNation ?n } GROUP BY ?n HAVING(COUNT(*) > 65)", "SELECT o AS n, count(*)::VARCHAR AS k FROM nat GROUP BY o HAVING count(*) > 65"),
]
for _name, _text, _sql in W3C:
    _register(_name, _text, _sql, "w3c")


@query(D + "SELECT o AS n, round(avg(v), 6) AS mean FROM nat JOIN bal ON bal.s = nat.s GROUP BY o")
def sparql_avg(spark, sf_dir):
    out = _run(spark, sf_dir, "SELECT ?n (AVG(?v) AS ?m) WHERE { ?c tp:inNation ?n ; <balance> ?v } GROUP BY ?n")
    return out.select("n", F.round(V.number_of_text(F.col("m")), 6).alias("mean"))


@query(D + "SELECT s || chr(9) || v AS row FROM seg")
def sparql_tsv(spark, sf_dir):
    out = compiler.to_tsv(_run(spark, sf_dir, "SELECT ?c ?v WHERE { ?c <segment> ?v }"))
    return out.toDF("row")
