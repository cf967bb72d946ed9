"""Reading records from JSON, JSON lines, CSV and columnar files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veldspar.functions.values import NUMBER


class ImportFailure(ValueError):
    """A source that can't be read as records."""


FORMATS = {"json": "json", "jsonl": "jsonl", "ndjson": "jsonl", "csv": "csv", "parquet": "parquet", "orc": "orc"}


def format_of(path: str) -> str:
    """The format by a path's last extension."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    if "." not in name or not name.rsplit(".", 1)[1]:
        raise ImportFailure(f"{path}: no file extension")
    extension = name.rsplit(".", 1)[1].lower()
    if extension not in FORMATS:
        raise ImportFailure(f"{path}: unknown file extension {extension}")
    return FORMATS[extension]


def _needs_rows(df: DataFrame, path: str) -> DataFrame:
    if df.isEmpty():
        raise ImportFailure(f"{path}: no records")
    return df


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Files whose root is an array of objects, or one object; other roots, text after the root and no objects at all
    fail. A file is one value, so each is parsed whole; large data come as JSON lines."""
    text = spark.read.text(path, wholetext=True).where(F.trim(F.translate("value", "\t\r\n", "   ")) != "")
    # inside brackets whatever follows the root makes the text invalid or a longer list
    roots = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), "value", F.lit("]"))), "$", "array<variant>")
    rooted = text.select(roots.alias("roots")).select((F.size("roots") == 1).alias("one"), F.get("roots", F.lit(0)).alias("root"))
    kind = F.schema_of_variant("root")
    if not rooted.where(~F.coalesce(F.col("one") & (kind.startswith("ARRAY") | kind.startswith("OBJECT")), F.lit(False))).isEmpty():
        raise ImportFailure(f"{path}: the root is no array of objects and no object")
    items = rooted.where(kind.startswith("ARRAY")).select(F.explode(F.try_variant_get("root", "$", "array<variant>")).alias("v"))
    if not items.where(~F.schema_of_variant("v").startswith("OBJECT")).isEmpty():
        raise ImportFailure(f"{path}: an item of the array is no object")
    df = spark.read.option("multiLine", True).option("mode", "FAILFAST").json(path)
    if not df.columns:
        raise ImportFailure(f"{path}: no records")
    return _needs_rows(df, path)


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """One object a line; LF, CR and CRLF end lines, blank lines don't count; a line that is no object fails with
    the file and the text it starts with."""
    lines = spark.read.text(path).select(F.explode(F.split("value", "\r")).alias("value"), F.col("_metadata.file_name").alias("file")).where(F.trim(F.translate("value", "\t", " ")) != "")
    root = F.try_parse_json("value")
    bad = lines.where(root.isNull() | ~F.schema_of_variant(root).startswith("OBJECT")).select("file", F.substring("value", 1, 60).alias("start")).first()
    if bad is not None:
        raise ImportFailure(f"{path}: a line of {bad['file']} is no object: {bad['start']}")
    schema = lines.agg(F.schema_of_variant_agg(root).alias("s")).first()["s"]
    if schema is None or schema == "VOID":
        raise ImportFailure(f"{path}: no records")
    return lines.select(F.from_json("value", schema.replace("OBJECT<", "STRUCT<")).alias("r")).select("r.*")


def read_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Text columns by the header; quotes by RFC 4180, unquoted blanks trimmed; a row of another width fails, before
    any row is used. Without multi_line no cell holds a line end, and large files are read in pieces."""
    reader = spark.read.option("quote", '"').option("escape", '"').option("multiLine", multi_line)
    reader = reader.option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
    head = reader.csv(path).first()
    if head is None or any(x is None or not x.strip() for x in head):
        raise ImportFailure(f"{path}: the header has an empty name")
    names = reader.option("header", True).csv(path).columns
    broken = free_name(names, "broken")
    typed = T.StructType([T.StructField(n, T.StringType()) for n in names])
    checked = reader.option("header", True).schema(T.StructType([*typed.fields, T.StructField(broken, T.StringType())])).option("columnNameOfCorruptRecord", broken).csv(path)
    bad = checked.where(F.col(broken).isNotNull()).first()
    if bad is not None:
        raise ImportFailure(f"{path}: a row isn't as wide as the header, expected {len(names)}: {str(bad[-1])[:60]}")
    return _needs_rows(reader.option("header", True).schema(typed).option("mode", "FAILFAST").csv(path), path)


def free_name(taken: list[str], stem: str) -> str:
    name = f"__{stem}"
    while name.lower() in {x.lower() for x in taken}:
        name = f"_{name}"
    return name


def read_jdbc(spark: SparkSession, url: str, table: str, by: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 1, **options: str) -> DataFrame:
    """A table of a database that has a JDBC driver, SQLite too; with `by`, a whole-number column and its bounds, in so
    many parallel reads."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if by is not None and bounds is not None:
        reader = reader.option("partitionColumn", by).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", partitions)
    return reader.load()


def cell(text: Column) -> Column:
    """A CSV cell as a variant: empty is null, true and false of any case, numbers, else trimmed text."""
    t = F.trim(text)
    low = F.lower(t)
    encoded = F.when(t == "", F.lit("null")).when(low.isin("true", "false"), low).when(t.rlike(r"^[+-]?[0-9]+$") & t.try_cast("bigint").isNotNull(), t.try_cast("bigint").cast("string"))
    encoded = encoded.when(t.rlike(NUMBER), t.try_cast("double").cast("string")).otherwise(F.to_json(F.struct(t.alias("t"))).substr(F.lit(6), F.length(F.to_json(F.struct(t.alias("t")))) - 6))
    return F.parse_json(F.coalesce(encoded, F.lit("null")))


def inferred_cells(df: DataFrame) -> DataFrame:
    return df.select(*[cell(df[f"`{c}`"]).alias(c) for c in df.columns])


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """By the extension."""
    kind = format_of(path)
    if kind in ("parquet", "orc"):
        return getattr(spark.read, kind)(path)
    return {"json": read_json, "jsonl": read_jsonl, "csv": read_csv}[kind](spark, path)


def with_ids(df: DataFrame, id_field: str | None = None) -> DataFrame:
    """_id from the chosen field, else from _id or id, else a new one; without _type. Missing ids are new ones."""
    chosen = id_field or next((c for c in ("_id", "id") if c in df.columns), None)
    found = df[chosen].cast("string") if chosen else F.lit(None).cast("string")
    out = df.withColumn("__id", F.coalesce(found, F.expr("uuid()")))
    return out.drop("_type", "_id").withColumnRenamed("__id", "_id")


def tables(spark: SparkSession, folder: str) -> list[str]:
    """Names of the parquet tables of a folder, in order, by Hadoop's file system, so that any store will do."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        raise ImportFailure(f"{folder}: no such folder")
    return sorted(s.getPath().getName().removesuffix(".parquet") for s in fs.listStatus(path) if s.getPath().getName().endswith(".parquet"))
