import pytest

from veldspar.sources import readers as R
from veldspar.sources import writers as W


def put(tmp_path, name, text):
    path = tmp_path / name
    path.write_bytes(text.encode())
    return str(path)


def test_jsonl_line_ends(spark, tmp_path):
    df = R.read_records(spark, put(tmp_path, "a.jsonl", '{"id":"one","value":1}\r\n  \r\n{"id":"two","value":2}'))
    assert sorted((r["id"], r["value"]) for r in df.collect()) == [("one", 1), ("two", 2)]


@pytest.mark.parametrize("text", ['{"a":1}\n[1]', "{bad}", "\n \n", ""])
def test_jsonl_failures(spark, tmp_path, text):
    with pytest.raises(R.ImportFailure):
        R.read_records(spark, put(tmp_path, "a.jsonl", text))


def test_json_roots(spark, tmp_path):
    assert R.read_records(spark, put(tmp_path, "a.json", '[{"a":1},{"a":2}]')).count() == 2
    assert R.read_records(spark, put(tmp_path, "b.json", '{"a":1}')).count() == 1
    for bad in ("[]", "3", "[1]", "{", "", '{"a":1}\n{"a":2}', '[{"a":1}] x', '{"a":1},{"a":2}', '[{"a":1}][{"a":2}]'):
        with pytest.raises(R.ImportFailure):
            R.read_records(spark, put(tmp_path, "c.json", bad))


def test_csv(spark, tmp_path):
    df = R.read_records(spark, put(tmp_path, "a.csv", 'name,note,count\r\n"Alice, A.","said ""hello""",42\r\n'))
    assert tuple(df.first()) == ("Alice, A.", 'said "hello"', "42")
    cells = R.inferred_cells(df)
    assert cells.selectExpr("variant_get(count, '$', 'int')").first()[0] == 42
    for ragged in ("name,count\nAlice,1,unexpected\n", "name,count\nAlice,1\nBob\n"):
        with pytest.raises(R.ImportFailure, match="expected 2"):
            R.read_records(spark, put(tmp_path, "b.csv", ragged))
    for empty in ("a,,b\n1,2,3\n", "a,b\n", ""):
        with pytest.raises(R.ImportFailure):
            R.read_records(spark, put(tmp_path, "c.csv", empty))
    assert R.read_records(spark, put(tmp_path, "d.csv", "id,_created,_c1\n1,2,3\n")).columns == ["id", "_created", "_c1"]


@pytest.mark.parametrize("kind", ["json", "jsonl", "csv", "parquet", "orc"])
def test_round_trips(spark, tmp_path, kind):
    df = spark.range(100).selectExpr("id", "concat('t ', id, ', \"x\"\n') as note").repartition(3)
    path = str(tmp_path / f"r.{kind}")
    W.write_records(df, path, kind, "id", "T")
    got = R.read_records(spark, path)
    assert sorted((int(r["id"]), r["note"].strip()) for r in got.collect()) == [(k, f't {k}, "x"') for k in range(100)]


def test_json_files_are_arrays(spark, tmp_path):
    import json

    path = tmp_path / "a.json"
    W.write_records(spark.range(5).repartition(1), str(path), "json", "id", "T")
    whole = [json.loads(f.read_text()) for f in path.glob("part-*")]
    assert sorted(x["id"] for f in whole for x in f) == list(range(5))
    with pytest.raises(R.ImportFailure):
        W.write_records(spark.range(0), str(tmp_path / "e.json"), "json", "id", "T")
        R.read_records(spark, str(tmp_path / "e.json"))


def test_jdbc(spark):
    url = "jdbc:derby:memory:veldspar;create=true"
    try:
        spark.range(50).selectExpr("id", "id * 2 as twice").write.format("jdbc").option("url", url).option("dbtable", "t").save()
    except Exception as e:
        pytest.skip(f"no JDBC driver here: {str(e)[:80]}")
    got = R.read_jdbc(spark, url, "t", by="id", bounds=(0, 50), partitions=4)
    assert got.count() == 50 and got.rdd.getNumPartitions() == 4 and got.agg({"twice": "sum"}).first()[0] == 2450


def test_formats():
    assert R.format_of("x/y.JSONL") == "jsonl"
    for bad in ("x/y", "x.", "x.exe"):
        with pytest.raises(R.ImportFailure):
            R.format_of(bad)


def test_ids(spark):
    df = spark.createDataFrame([("a", "T", 1), (None, "T", 2)], "id string, _type string, v int")
    got = {r["v"]: r["_id"] for r in R.with_ids(df).collect()}
    assert got[1] == "a" and len(got[2]) == 36 and "_type" not in R.with_ids(df).columns


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a,"b"', 2.0, None), (2, None, 2.5, ["x"])], "id int, t string, n double, l array<string>")
    header, lines = W.csv_lines(df, "id", "T")
    assert header == "_id,_type,id,n,t"
    assert sorted(r["value"] for r in lines.collect()) == ['1,T,1,2,"a,""b"""', "2,T,2,2.5,"]
    W.write_records(df, str(tmp_path / "o.jsonl"), "jsonl", "id", "T")
    assert R.read_records(spark, str(tmp_path / "o.jsonl")).count() == 2
    with pytest.raises(W.ExportFailure):
        W.write_records(df, str(tmp_path / "o.x"), "xml", "id", "T")


def test_tables(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "d" / "n.parquet"))
    assert R.tables(spark, str(tmp_path / "d")) == ["n"]
