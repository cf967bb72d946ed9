"""Queries over records: predicates, JSON, paging, aggregation, profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldspar.functions import values as V
from veldspar.operators import analytics as A
from veldspar.operators import profile as P
from veldspar.operators import records as R
from veldspar.operators.predicate import Condition, Group, filter_records
from veldspar.operators.predicate import search_records as search
from veldspar.plans.catalog import query


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dynamic_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their JSON as a variant."""
    return read(spark, sf_dir, "events").withColumn("props", F.parse_json("props"))


NUM = "^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$"


@query("SELECT event_id, event_type, value FROM events WHERE contains(lower(event_type), 'c') AND value > 50")
def filter_group(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    return filter_records(events, Group((Condition("event_type", "contains", "C"), Condition("value", ">", 50)))).select("event_id", "event_type", "value")


@query("SELECT event_id FROM events WHERE (lower(event_type) = 'click' OR value > 90) AND (user_id < 50 OR (lower(event_type) <> 'view' AND value <= 30))")
def filter_nested(spark, sf_dir):
    tree = Group((
        Group((Condition("event_type", "=", "CLICK"), Condition("value", ">", 90), Condition("", "=", "no path")), any_of=True),
        Group((Condition("user_id", "<", 50), Group((Condition("event_type", "!=", "View"), Condition("value", "<=", 30)))), any_of=True),
    ))
    return filter_records(read(spark, sf_dir, "events"), tree).select("event_id")


@query("SELECT event_id FROM events WHERE user_id = 3 OR true")
def filter_empty_group(spark, sf_dir):
    return filter_records(read(spark, sf_dir, "events"), Group((Condition("user_id", "=", 3), Group()), any_of=True)).select("event_id")


@query("SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = 'building'")
def filter_eq_ci(spark, sf_dir):
    return filter_records(read(spark, sf_dir, "customer"), Group((Condition("c_mktsegment", "=", "building"),))).select("c_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice >= 1000 AND o_totalprice < 200000 AND lower(o_orderpriority) > '2-high'")
def filter_range(spark, sf_dir):
    tree = Group((Condition("o_totalprice", ">=", 1000), Condition("o_totalprice", "<", 200000), Condition("o_orderpriority", ">", "2-HIGH")))
    return filter_records(read(spark, sf_dir, "orders"), tree).select("o_orderkey")


@query("SELECT event_id FROM events WHERE json_extract(props, '$.k') IS NOT NULL AND json_extract(props, '$.missing') IS NULL")
def filter_null(spark, sf_dir):
    return filter_records(dynamic_events(spark, sf_dir), Group((Condition("props.k", "is not null"), Condition("props.missing", "is null")))).select("event_id")


@query("SELECT event_id FROM events WHERE true")
def filter_missing_is_less(spark, sf_dir):
    tree = Group((Condition("props.missing", "<", 5), Condition("props.missing", "!=", "x"), Condition("props.missing", "=", None)))
    return filter_records(dynamic_events(spark, sf_dir), tree).select("event_id")


@query("SELECT p_partkey FROM part WHERE contains(lower(p_type), 'brass')")
def filter_contains(spark, sf_dir):
    return filter_records(read(spark, sf_dir, "part"), Group((Condition("p_type", "contains", "Brass"), Condition("p_type", "is not null")))).select("p_partkey")


@query("SELECT c_custkey FROM customer WHERE starts_with(lower(c_name), 'customer') AND ends_with(lower(c_mktsegment), 'ing')")
def filter_affix(spark, sf_dir):
    return filter_records(read(spark, sf_dir, "customer"), Group((Condition("c_name", "starts with", "CUSTOMER"), Condition("c_mktsegment", "ends with", "ING")))).select("c_custkey")


@query("SELECT event_id, (props->>'$.k')::DOUBLE AS k FROM events WHERE (props->>'$.k')::DOUBLE >= 40 AND value < 80.5 AND event_type > '7'")
def filter_coerce(spark, sf_dir):
    tree = Group((Condition("props.k", ">=", "40"), Condition("value", "<", "80.5"), Condition("event_type", ">", "7")))
    events = dynamic_events(spark, sf_dir)
    return filter_records(events, tree).select("event_id", F.try_variant_get("props", "$.k", "double").alias("k"))


@query("SELECT c_custkey FROM customer WHERE contains(lower(c_name), '12') OR contains(lower(c_mktsegment), '12') OR contains(c_custkey::VARCHAR, '12') OR contains(c_nationkey::VARCHAR, '12')")
def search_records(spark, sf_dir):
    return search(read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"), "12", "c_custkey").select("c_custkey")


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k, CAST(NULL AS VARCHAR) AS deeper FROM events")
def json_path(spark, sf_dir):
    return dynamic_events(spark, sf_dir).select("event_id", F.try_variant_get("props", "$.k", "bigint").alias("k"), F.try_variant_get("props", "$.k.deeper", "string").alias("deeper"))


@query("SELECT event_id, '{1 fields}' AS shown, (props->>'$.k')::BIGINT::VARCHAR AS k, '-' AS none FROM events")
def json_display(spark, sf_dir):
    v = F.col("props")
    return dynamic_events(spark, sf_dir).select("event_id", V.display(v).alias("shown"), V.display(F.try_variant_get(v, "$.k", "variant")).alias("k"), V.display(F.try_variant_get(v, "$.none", "variant")).alias("none"))


@query("SELECT event_id, '$' AS path, 0 AS depth, '{1 fields}' AS display, 'object' AS type FROM events UNION ALL SELECT event_id, '$.k', 1, (props->>'$.k')::BIGINT::VARCHAR, 'number' FROM events")
def json_tree(spark, sf_dir):
    return R.json_tree(dynamic_events(spark, sf_dir), "event_id", "props")


@query("SELECT event_id, json_valid(props) AS ok, false AS text_ok FROM events")
def json_validate(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", R.is_json_object(F.col("props")).alias("ok"), R.is_json_object(F.col("event_type")).alias("text_ok"))


@query("""SELECT n_nationkey, '{ n_name: "' || n_name || '", n_nationkey: ' || n_nationkey || ', n_regionkey: ' || n_regionkey || ' }' AS preview FROM nation""")
def row_preview(spark, sf_dir):
    nation = read(spark, sf_dir, "nation")
    return nation.select("n_nationkey", R.preview(nation).alias("preview"))


@query("""SELECT n_nationkey::VARCHAR AS _id, 'Nation' AS _type, strlen('{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}')::BIGINT AS _json_bytes FROM nation""")
def record_sizes(spark, sf_dir):
    return R.with_sizes(read(spark, sf_dir, "nation"), "n_nationkey", "Nation").select("_id", "_type", "_json_bytes")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_nationkey = 7 ORDER BY c_custkey LIMIT 20")
def scan_limit(spark, sf_dir):
    return read(spark, sf_dir, "customer").where("c_nationkey = 7").orderBy("c_custkey").limit(20).select("c_custkey", "c_name", "c_acctbal")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = (SELECT min(o_orderkey) + 31 FROM orders)")
def scan_point_lookup(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    first = orders.agg(F.min("o_orderkey")).first()[0]
    return orders.where(F.col("o_orderkey") == first + 31).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT s_suppkey, s_name, true AS has_more FROM (SELECT * FROM supplier ORDER BY s_suppkey LIMIT 20 OFFSET 40)")
def page_records(spark, sf_dir):
    return R.page(read(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), "s_suppkey", 40, 20)


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 100")
def sort_records(spark, sf_dir):
    return R.sort_records(read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey", True).limit(100)


@query("SELECT n_nationkey, CASE WHEN n_nationkey < 5 THEN upper(n_name) || '!' ELSE n_name END AS n_name, n_regionkey FROM nation UNION ALL SELECT 100 + r_regionkey, r_name, r_regionkey FROM region")
def dml_upsert(spark, sf_dir):
    nation = read(spark, sf_dir, "nation")
    changed = nation.where("n_nationkey < 5").withColumn("n_name", F.concat(F.upper("n_name"), F.lit("!")))
    added = read(spark, sf_dir, "region").select((F.col("r_regionkey") + 100).alias("n_nationkey"), F.col("r_name").alias("n_name"), F.col("r_regionkey").alias("n_regionkey"))
    return R.upsert(nation, changed.unionByName(added), "n_nationkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def dml_delete(spark, sf_dir):
    gone = read(spark, sf_dir, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    return R.delete(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), gone, "o_custkey")


@query("SELECT r_regionkey, trim(regexp_replace(lower(hex(r_name)), '(..)', '\\1 ', 'g')) AS dump, lower(hex(r_name)) AS compact, hex(r_name) AS raw FROM region")
def fmt_hex(spark, sf_dir):
    return read(spark, sf_dir, "region").select("r_regionkey", R.hexdump(F.col("r_name")).alias("dump"), F.lower(F.hex("r_name")).alias("compact"), F.hex("r_name").alias("raw"))


@query("""SELECT o_orderkey, CASE WHEN o_totalprice = round(o_totalprice) AND abs(o_totalprice) < 1000000 THEN printf('%.0f', o_totalprice) WHEN abs(o_totalprice) >= 1000000 THEN printf('%.1fM', o_totalprice / 1000000)
  WHEN abs(o_totalprice) >= 1000 THEN printf('%.1fK', o_totalprice / 1000) ELSE printf('%.2f', o_totalprice) END AS label FROM (SELECT o_orderkey, floor(o_totalprice / 100) * 128 AS o_totalprice FROM orders)""")
def fmt_number(spark, sf_dir):
    # multiples of 128 keep halves out of the last shown place
    return read(spark, sf_dir, "orders").select("o_orderkey", V.short_number(F.floor(F.col("o_totalprice") / 100).cast("double") * 128).alias("label"))


# -- aggregation

EVENTS = "(SELECT event_type, value, props->>'$.k' AS k FROM events)"


def _grouped(sql: str, key: str = "event_type") -> str:
    return f"SELECT {key} AS group_key, {sql} AS value, {key} AS label FROM events GROUP BY {key}"


@query("SELECT event_type AS group_key, count(*)::DOUBLE AS value, event_type AS label FROM events GROUP BY event_type")
def agg_group(spark, sf_dir):
    return A.aggregate(read(spark, sf_dir, "events"), A.Aggregation("count", group_by="event_type"))


@query("SELECT 'Total' AS group_key, count(*)::DOUBLE AS value, 'COUNT(*)' AS label FROM events")
def agg_count(spark, sf_dir):
    return A.aggregate(read(spark, sf_dir, "events"), A.Aggregation("count"))


@query("SELECT event_type AS group_key, round(sum(value), 4) AS value, event_type AS label FROM events GROUP BY event_type")
def agg_sum(spark, sf_dir):
    return A.aggregate(read(spark, sf_dir, "events"), A.Aggregation("sum", "value", "event_type")).withColumn("value", F.round("value", 4))


@query("SELECT event_type AS group_key, round(avg(value), 6) AS value, event_type AS label FROM events GROUP BY event_type")
def agg_avg(spark, sf_dir):
    return A.aggregate(read(spark, sf_dir, "events"), A.Aggregation("avg", "value", "event_type")).withColumn("value", F.round("value", 6))


@query(_grouped("min(value)"))
def agg_min(spark, sf_dir):
    return A.aggregate(read(spark, sf_dir, "events"), A.Aggregation("min", "value", "event_type"))


@query(_grouped("max(value)"))
def agg_max(spark, sf_dir):
    return A.aggregate(read(spark, sf_dir, "events"), A.Aggregation("max", "value", "event_type"))


@query(_grouped("list_sort(list(value))[1 + floor((count(value) - 1) * 0.95::DOUBLE)::INT]"))
def agg_percentile(spark, sf_dir):
    return A.aggregate(read(spark, sf_dir, "events"), A.Aggregation("percentile", "value", "event_type", 0.95))


@query("SELECT 'Total' AS group_key, max(l_extendedprice) AS value, 'MAX(l_extendedprice)' AS label FROM lineitem")
def agg_scalar(spark, sf_dir):
    return A.aggregate(read(spark, sf_dir, "lineitem"), A.Aggregation("max", "l_extendedprice"))


@query(f"SELECT event_type AS group_key, sum(CASE WHEN regexp_matches(k, '{NUM}') THEN k::DOUBLE END) AS value, event_type AS label FROM {EVENTS} GROUP BY event_type")
def agg_coerce(spark, sf_dir):
    events = dynamic_events(spark, sf_dir).withColumn("k", F.try_variant_get("props", "$.k", "string"))
    return A.aggregate(events, A.Aggregation("sum", "k", "event_type"))


@query("SELECT o_custkey::VARCHAR AS group_key, round(sum(o_totalprice), 2) AS value, o_custkey::VARCHAR AS label FROM orders GROUP BY o_custkey")
def agg_group_number(spark, sf_dir):
    return A.aggregate(read(spark, sf_dir, "orders"), A.Aggregation("sum", "o_totalprice", "o_custkey")).withColumn("value", F.round("value", 2))


@query("""SELECT 0 AS panel, 'Total' AS group_key, count(*)::DOUBLE AS value, 'Total Count' AS label FROM orders
UNION ALL SELECT 1, 'Total', sum(o_custkey)::DOUBLE, 'Sum of o_custkey' FROM orders
UNION ALL SELECT 2, o_orderpriority, count(*)::DOUBLE, o_orderpriority FROM orders GROUP BY o_orderpriority
UNION ALL SELECT 3, o_orderstatus, sum(o_custkey)::DOUBLE, o_orderstatus FROM orders GROUP BY o_orderstatus""")
def analytics_dashboard(spark, sf_dir):
    return A.run_dashboard(read(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_orderstatus"))


# -- profiles

_PROFILE = """SELECT 'k' AS path, 'k' AS name, 0 AS depth, 'number' AS type, array_to_string(list_sort(list(DISTINCT k))[1:5], '|') AS samples FROM (SELECT (props->>'$.k')::BIGINT::VARCHAR AS k FROM events)"""


@query(_PROFILE)
def profile_fields(spark, sf_dir):
    return P.profile(dynamic_events(spark, sf_dir), "props").withColumn("samples", F.array_join("samples", "|"))


@query("SELECT 'c_custkey' AS field, true AS numeric UNION ALL SELECT 'c_mktsegment', false UNION ALL SELECT 'c_name', false UNION ALL SELECT 'c_acctbal', true UNION ALL SELECT 'c_nationkey', true")
def profile_numeric(spark, sf_dir):
    return P.numeric_fields(read(spark, sf_dir, "customer"))


@query("SELECT 'number' AS type, 2::BIGINT AS fields, 'n_nationkey,n_regionkey' AS names UNION ALL SELECT 'string', 1::BIGINT, 'n_name'")
def profile_by_type(spark, sf_dir):
    nation = read(spark, sf_dir, "nation")
    found = P.profile(nation.select(R.variant_row(nation).alias("v")), "v")
    return found.groupBy("type").agg(F.count("*").alias("fields"), F.array_join(F.array_sort(F.collect_list("path")), ",").alias("names"))



@query("""SELECT event_type AS type, count(*) AS count, sum(strlen(props))::BIGINT AS bytes, floor(sum(strlen(props)) / count(*))::BIGINT AS avg_bytes, round(count(*) / sum(count(*)) OVER (), 9)::DOUBLE AS share FROM events GROUP BY event_type""")
def type_stats(spark, sf_dir):
    sized = read(spark, sf_dir, "events").select("event_type", F.octet_length("props").alias("bytes"))
    return P.type_stats(sized, "event_type", "bytes").withColumn("share", F.round("share", 9))
