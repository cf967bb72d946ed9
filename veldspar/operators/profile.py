"""Schema inference from values: paths, types, samples, type statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veldspar.functions import values as V
from veldspar.shared import written

MAX_SAMPLES = 5


def inferred_type(v: Column) -> Column:
    """string, number, boolean, array, vector (64 numbers or more), object or unknown."""
    kind = V.variant_type(v)
    items = F.try_variant_get(v, "$", "array<variant>")
    vector = (F.size(items) >= V.VECTOR_LENGTH) & F.forall(items, lambda x: V.variant_type(x) == "number")
    return F.when((kind == "array") & vector, "vector").otherwise(kind)


def leaves(df: DataFrame, variant_col: str) -> DataFrame:
    """(path, depth, type, sample) for every field of every row's object, nested objects by dotted paths, however deep.

    The levels of nesting are flattened inside a row, all in one scan and without a shuffle."""
    level, levels = df.select(F.array(F.struct(F.lit("").alias("path"), F.col(variant_col).alias("v"))).alias("at")), []

    def inner(x: Column) -> Column:
        keys = F.map_entries(F.try_variant_get(x["v"], "$", "map<string,variant>"))
        named = lambda e: F.struct(F.when(x["path"] == "", e["key"]).otherwise(F.concat(x["path"], F.lit("."), e["key"])).alias("path"), e["value"].alias("v"))
        return F.when(V.variant_type(x["v"]) == "object", F.transform(keys, named)).otherwise(F.array().cast("array<struct<path:string,v:variant>>"))

    for k in range(V.nesting(df, variant_col, "{", "}")):
        level = level.withColumn(f"at{k}", F.flatten(F.transform(f"at{k - 1}" if k else "at", inner)))
        levels.append(F.transform(f"at{k}", V.at_depth(k)))
    if not levels:
        return df.limit(0).select(F.lit("").alias("path"), F.lit(0).alias("depth"), F.lit("").alias("type"), F.lit("").alias("sample"))
    out = level.select(F.explode(F.concat(*levels)).alias("x")).select("x.*")
    scalar = V.variant_type(F.col("v")).isin("string", "number", "boolean", "unknown")
    return out.select("path", "depth", inferred_type(F.col("v")).alias("type"), F.when(scalar, F.coalesce(V.display(F.col("v")), F.lit("null"))).alias("sample"))


def profile(df: DataFrame, variant_col: str, max_samples: int = MAX_SAMPLES) -> DataFrame:
    """(path, name, depth, type, samples): the merged type of each path and its least distinct samples.

    One type keeps its name; several are mixed. The order of rows decides nothing: an object met with scalars
    is mixed whichever came first.
    """
    each = written(leaves(df, variant_col).distinct())
    types = each.groupBy("path", "depth").agg(F.collect_set("type").alias("types"))
    # a rank below a limit is cut off in every partition before the samples of a path meet
    by = Window.partitionBy("path", "depth").orderBy("sample")
    first = each.where("sample is not null").select("path", "depth", "sample").distinct().withColumn("k", F.row_number().over(by)).where(F.col("k") <= max_samples)
    samples = first.groupBy("path", "depth").agg(F.array_sort(F.collect_list("sample")).alias("samples"))
    return types.join(samples, ["path", "depth"], "left").select(
        "path", F.substring_index("path", ".", -1).alias("name"), "depth", F.when(F.size("types") > 1, "mixed").otherwise(F.get("types", F.lit(0))).alias("type"), F.coalesce("samples", F.array().cast("array<string>")).alias("samples")
    )


def type_stats(df: DataFrame, type_col: str, bytes_col: str) -> DataFrame:
    """Per type: rows, bytes, whole average and share of all rows."""
    per = df.groupBy(F.col(type_col).alias("type")).agg(F.count("*").alias("count"), F.sum(bytes_col).cast("bigint").alias("bytes"))
    total = per.agg(F.sum("count").alias("total"))
    return per.crossJoin(F.broadcast(total)).select("type", "count", "bytes", F.floor(F.col("bytes") / F.col("count")).cast("bigint").alias("avg_bytes"), (F.col("count") / F.col("total")).alias("share"))


def numeric_fields(df: DataFrame) -> DataFrame:
    """(field, numeric) of every column, by values: a text column is numeric if one of its values reads as a number."""
    checks = [F.coalesce(F.bool_or(V.coerced(V.resolve(df, f.name)).isNotNull()), F.lit(False)).alias(f.name) for f in df.schema.fields]
    one = df.agg(*checks)
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"`{c}`").alias("numeric")) for c in df.columns])).alias("r")).select("r.field", "r.numeric")
