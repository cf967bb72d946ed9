"""Queries of reading and writing: what is written is read back from the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldspar import shared
from veldspar.plans.catalog import query
from veldspar.plans.q_records import read
from veldspar.sources import readers, writers


def folder(spark: SparkSession, extension: str) -> str:
    """A new path in the folder that the session names for checkpoints, with an extension."""
    return shared.new_path(spark, f"io-*.{extension}")


def _nation(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "nation")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def src_jsonl(spark, sf_dir):
    path = folder(spark, "jsonl")
    writers.write_records(_nation(spark, sf_dir), path, "jsonl", "n_nationkey", "Nation")
    return readers.read_records(spark, path).select("n_nationkey", "n_name", "n_regionkey")


@query("SELECT n_nationkey, n_name FROM nation")
def src_json(spark, sf_dir):
    path = folder(spark, "json")
    writers.write_records(_nation(spark, sf_dir).repartition(3), path, "json", "n_nationkey", "Nation")
    return readers.read_records(spark, path).select("n_nationkey", "n_name")


@query("SELECT n_nationkey::VARCHAR AS n_nationkey, 'a \"' || n_name || '\", b' AS n_name FROM nation")
def src_csv(spark, sf_dir):
    path = folder(spark, "csv")
    odd = _nation(spark, sf_dir).withColumn("n_name", F.concat(F.lit('a "'), "n_name", F.lit('", b')))
    writers.write_records(odd, path, "csv", "n_nationkey", "Nation")
    return readers.read_records(spark, path).select("n_nationkey", "n_name")


@query("SELECT c_custkey, c_acctbal, c_custkey % 2 = 0 AS even, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS segment FROM customer")
def src_csv_infer(spark, sf_dir):
    text = read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("k"), F.col("c_acctbal").cast("string").alias("b"), F.when(F.col("c_custkey") % 2 == 0, "TRUE").otherwise("false").alias("e"), F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit(" "), "c_mktsegment")).otherwise(" ").alias("s"))
    cells = readers.inferred_cells(text)
    get = lambda c, t: F.try_variant_get(c, "$", t)
    return cells.select(get("k", "bigint").alias("c_custkey"), get("b", "double").alias("c_acctbal"), get("e", "boolean").alias("even"), get("s", "string").alias("segment"))


_JSON = """'{"_id":"' || n_nationkey || '","_type":"Nation","n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}'"""


@query(f"SELECT n_nationkey::VARCHAR AS _id, {_JSON} AS value FROM nation")
def snk_jsonl(spark, sf_dir):
    return writers.json_lines(_nation(spark, sf_dir), "n_nationkey", "Nation")


@query(f"SELECT '[' || string_agg({_JSON}, ',' ORDER BY n_nationkey::VARCHAR) || ']' AS value FROM nation")
def snk_json(spark, sf_dir):
    """The file that one task writes, its lines joined."""
    path = folder(spark, "json")
    nation = _nation(spark, sf_dir).repartition(1).sortWithinPartitions(F.col("n_nationkey").cast("string"))
    writers.write_records(nation, path, "json", "n_nationkey", "Nation")
    return spark.read.text(path, wholetext=True).select(F.translate("value", "\n", "").alias("value"))


@query("SELECT n_nationkey, n_name FROM nation")
def src_orc(spark, sf_dir):
    path = folder(spark, "orc")
    writers.write_records(_nation(spark, sf_dir), path, "orc", "n_nationkey", "Nation")
    return readers.read_records(spark, path).select("n_nationkey", "n_name")


@query("SELECT n_nationkey::VARCHAR AS _id, n_name FROM nation")
def src_ids(spark, sf_dir):
    return readers.with_ids(_nation(spark, sf_dir), "n_nationkey").select("_id", "n_name")


@query("SELECT n_nationkey::VARCHAR AS _id, n_nationkey || ',Nation,\"' || n_name || ', \"\"' || n_regionkey || '\"\"\",' || n_nationkey AS value FROM nation")
def snk_csv(spark, sf_dir):
    odd = _nation(spark, sf_dir).select("n_nationkey", F.concat("n_name", F.lit(', "'), F.col("n_regionkey").cast("string"), F.lit('"')).alias("n_name"), F.array("n_name").alias("list"))
    return writers.csv_lines(odd, "n_nationkey", "Nation")[1]


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def export_selected(spark, sf_dir):
    chosen = read(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return writers.selected(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_custkey", chosen).select("o_orderkey", "o_totalprice")
