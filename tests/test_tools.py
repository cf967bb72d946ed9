import math
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from veldspar.functions import values as V
from veldspar.operators import geo as G
from veldspar.operators import opsmetrics as O
from veldspar.operators import search as S
from veldspar.operators import vector as X
from veldspar.operators import versions as W
from veldspar.streaming import ops as ST


def test_bm25_by_formula(spark):
    docs = [(1, "Spark spark language", "a"), (2, "rust language", None), (3, "", "spark")]
    df = spark.createDataFrame(docs, "id int, title string, body string")
    got = {r["id"]: r["score"] for r in S.score(df, "id", ["title", "body"], "Spark spark x").collect()}
    idf = math.log((3 - 1 + 0.5) / (1 + 0.5) + 1)
    title = idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / (5 / 3)))
    body = idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 1 / (1 / 3)))
    assert got == {1: pytest.approx(2 * title), 3: pytest.approx(2 * body)}
    assert [r["id"] for r in S.score(df, "id", ["title", "body"], "language spark", "all").collect()] == [1]
    assert [r["id"] for r in S.score(df, "id", ["title", "body"], "rust lang", "phrase").collect()] == [2]
    assert S.score(df, "id", ["title", "body"], "a !").collect() == []


def test_index_scores_as_the_scans_do(spark, tmp_path):
    docs = [(1, "Spark spark language", "a b1"), (2, "rust language", None), (3, "", "spark"), (4, None, None), (5, "language of spark", "rust rust"), (6, "the spark spark", "the")]
    df = spark.createDataFrame(docs, "id int, title string, body string")
    S.write_index(df, "id", ["title", "body"], str(tmp_path / "index"))
    index = S.open_index(spark, str(tmp_path / "index"), ["title", "body"])
    rows = lambda df: sorted(tuple(round(x, 9) for x in r) for r in df.select("id", "score", "score_title", "score_body").collect())
    for query, mode in (("Spark spark x", "any"), ("language spark", "all"), ("rust lang", "phrase"), ("rust rust", "any"), ("rust rust", "all"), ("of spark", "phrase"), ("a !", "any"), ("absent", "all")):
        assert rows(S.score_index(index, query, mode, df)) == rows(S.score(df, "id", ["title", "body"], query, mode)), query
    with pytest.raises(ValueError, match="documents"):
        S.score_index(index, "spark", "phrase")
    empty = S.write_index(df.where("id > 9"), "id", ["title", "body"])
    assert S.score_index(empty, "spark").collect() == []


def test_index_counts_terms_where_the_texts_are(spark):
    """Only postings move, once: no shuffle counts tokens, and none samples for ranges."""
    df = spark.createDataFrame([(1, "bb aa bb", "cc"), (2, "", None), (3, "aa", "aa aa")], "id int, title string, body string")
    index = S.write_index(df, "id", ["title", "body"])
    got = sorted(tuple(r) for r in index.postings.select("field", "term", "id", "tf", "length").collect())
    assert got == [("body", "aa", 3, 2, 2), ("body", "cc", 1, 1, 1), ("title", "aa", 1, 1, 3), ("title", "aa", 3, 1, 1), ("title", "bb", 1, 2, 3)]
    assert index.postings.where(F.col("key") != F.xxhash64("term")).count() == 0
    assert "In(key" in S.score_index(index, "aa bb")._jdf.queryExecution().executedPlan().toString()


def test_ranges_and_highlights(spark):
    df = spark.createDataFrame([(1, "Café cafe CAFÉ"), (2, None)], "id int, t string")
    ranges = S.match_ranges(df, "id", "t", "cafe af")
    assert sorted((r["start"], r["end"]) for r in ranges.where("token = 'cafe'").collect()) == [(0, 4), (5, 9), (10, 14)]
    assert sorted((r["start"], r["end"]) for r in S.merged_ranges(ranges, "id").collect()) == [(0, 4), (5, 9), (10, 14)]


def test_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 0.1]), (2, [0.0, 1.0]), (3, [0.0, 0.0])], "id int, v array<float>")
    assert [r["id"] for r in X.nearest(df, "id", "v", 0, 2).collect()] == [1, 2]
    assert X.nearest(df, "id", "v", 0, 3).where("id = 3").first()["score"] == 0.0
    bad = spark.createDataFrame([(0, [1.0, 2.0]), (1, []), (2, [float("nan"), 1.0]), (3, [1.0]), (4, [3.0, 1.0])], "id int, v array<double>")
    assert {r["id"]: r["problem"] for r in X.problems(bad, "id", "v").collect()} == {1: "empty", 2: "not finite", 3: "other length"}


def test_pca_matches_numpy(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(60, 5)) * [5, 3, 1, 0.5, 0.1] + 7
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(m)], "id int, v array<double>")
    got = np.array([(r["x"], r["y"]) for r in X.pca(df, "id", "v").orderBy("id").collect()])
    c = m - m.mean(0)
    axes = np.linalg.svd(c, full_matrices=False)[2][:2]
    assert np.allclose(np.abs(got), np.abs(c @ axes.T), atol=1e-6)
    assert abs(got.mean(0)).max() < 1e-9
    flat = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.0])], "id int, v array<double>")
    assert {(r["x"], r["y"]) for r in X.pca(flat, "id", "v").collect()} == {(0.0, 0.0)}
    one = spark.createDataFrame([(0, [4.0])], "id int, v array<double>")
    assert tuple(X.pca(one, "id", "v").first()) == (0, 4.0, 0.0)
    assert X.pca(flat.where("id > 5"), "id", "v").collect() == []


def test_geo(spark):
    df = spark.createDataFrame([("tokyo", "35.68", "139.69"), ("osaka", "34.69", "135.5"), ("none", "x", "1")], "id string, a string, b string")
    points = G.points(df, F.col("a"), F.col("b"))
    near = G.nearest(points, "id", 35.68, 139.69).collect()
    assert [r["id"] for r in near] == ["tokyo", "osaka"] and near[0]["distance"] == pytest.approx(0) and near[1]["distance"] == pytest.approx(396e3, rel=0.02)
    assert [r["id"] for r in G.within(points, "id", 35.68, 139.69, 1000).collect()] == ["tokyo"]
    assert G.bounds(points.where("id = 'tokyo'")).first()["span_lat"] == 0.01


def test_rounded_numbers_read_as_printf_writes_them(spark):
    metres = [17.0 * k for k in range(1, 3001)] + [0.5, 1.5, 2.5, 999.5, 1150.0, 1250.0, 2350.0, 1e12 + 50, 1e19]
    df = spark.createDataFrame([(x,) for x in metres], "x double")
    shown = df.select("x", G.distance_text(F.col("x")).alias("d"), V.fixed(F.col("x") / 1000, 2).alias("two"), V.fixed(-F.col("x") / 1024, 1).alias("below")).collect()
    assert [r["d"] for r in shown] == ["%.0f m" % r["x"] if r["x"] < 1000 else "%.1f km" % (r["x"] / 1000) for r in shown]
    assert [r["two"] for r in shown] == ["%.2f" % (r["x"] / 1000) for r in shown]
    assert [r["below"] for r in shown] == ["%.1f" % (-r["x"] / 1024) for r in shown]


def test_versions(spark):
    df = spark.createDataFrame([(1, 1, {"a": "x", "b": "y"}), (1, 2, {"a": "z", "c": "y"}), (2, 1, None)], "k int, v int, s map<string,string>")
    got = {(r["v"], r["field"]): r["change"] for r in W.history(df, "k", "v", "s").collect()}
    assert got == {(1, "a"): "added", (1, "b"): "added", (2, "a"): "modified", (2, "b"): "removed", (2, "c"): "added"}
    assert W.summary(W.changes_only(W.history(df, "k", "v", "s")), "v").where("v = 2").first()["removed"] == 1


def test_ops_metrics(spark):
    rows = [(i, datetime(2024, 1, 1, 0, i // 60, i % 60), float(i % 10), i % 4 == 0) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, ts timestamp_ntz, s double, failed boolean")
    got = O.summary(df, "ts", "s", "failed").first().asDict()
    values = sorted(r[2] for r in rows)
    assert got["total"] == 200 and got["successes"] == 150 and got["p50"] == values[100] and got["p99"] == values[198]
    assert got["ops_per_second"] == pytest.approx(61 / 60)
    slow = O.slow(df.withColumn("d", F.lit("q")), "ts", "s", "failed", "d", 9.0, "id", 3).collect()
    assert len(slow) == 3 and slow[0]["id"] == 199
    seen = []
    with pytest.raises(RuntimeError), O.measured(lambda *a: seen.append(a), "x"):
        raise RuntimeError
    assert seen[0][0] == "x" and seen[0][2]


def test_streams(spark, tmp_path):
    rows = [(datetime(2024, 1, 1, 0, 0, i), i / 10) for i in range(60)]
    spark.createDataFrame(rows, "ts timestamp, seconds double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, seconds double").parquet(str(tmp_path / "in"))
    rates = ST.run_to_memory(ST.rates(stream, window="60 seconds", slide="60 seconds"), "rates", "complete").collect()
    assert [(r["operations"], r["ops_per_second"]) for r in rates] == [(60, 1.0)]
    lat = ST.run_to_memory(ST.latencies(stream), "latencies", "complete").first()
    assert lat["p50"] == pytest.approx(3.0, abs=0.3)
    assert ST.run_to_memory(ST.slow(stream, 5.5), "slow").count() == 5
    described = stream.withColumns({"what": F.lit("q"), "failed": F.col("seconds") > 5.85})
    found = ST.run_to_memory(ST.slow(described, 5.5, text_col="what", failed_col="failed"), "failures")
    assert [r["what"] for r in ST.latest(found, keep=3).collect()] == ["[FAILED] q", "q", "q"]
    q = ST.start(ST.slow(stream, 5.5), "renewed", seconds=1)
    q.processAllAvailable()
    q.stop()
    assert spark.table("renewed").count() == 5


def test_slow_operations_stay_off_the_driver(spark, tmp_path):
    spark.createDataFrame([(datetime(2024, 1, 1, 0, 0, i), i / 10) for i in range(60)], "ts timestamp, seconds double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, seconds double").parquet(str(tmp_path / "in"))
    found = ST.run_to_files(ST.slow(stream, 5.5))
    assert "FileScan parquet" in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["seconds"] for r in found.collect()) == [5.5, 5.6, 5.7, 5.8, 5.9]
    assert ST.run_to_files(ST.slow(stream, 99)).collect() == []


def test_search_of_scripts_with_marks_and_of_all_fields(spark):
    df = spark.createDataFrame([(1, "यह हिन्दी है", None, 5), (2, None, "other_text", 6), (3, None, None, 7)], "id int, title string, body string, n int")
    assert S.query_tokens("हिन्दी, A_bc!") == ["हिन्दी", "bc"]
    assert [r["id"] for r in S.score(df, "id", ["title"], "हिन्दी").collect()] == [1]
    texts = {r["id"]: r["search_text"] for r in S.search_text(df, ["title", "n2"]).collect()}
    assert texts == {1: "यह हिन्दी है", 2: "other_text", 3: ""}
    assert {r["id"]: r["search_text"] for r in S.search_text(df, ["n"]).collect()}[2] == "6"
