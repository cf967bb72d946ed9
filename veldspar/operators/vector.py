"""Vectors: similarity, nearest neighbours, statistics, two-dimensional PCA."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veldspar.shared import written


class VectorError(ValueError):
    """Vectors that can't be compared."""


def _doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, 0.0).otherwise(dot(a, b) / F.when(norms == 0, 1.0).otherwise(norms))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def nearest(df: DataFrame, id_col: str, vector_col: str, query_id, k: int = 5, metric: str = "cosine") -> DataFrame:
    """The k rows most like the row query_id, itself left out: (id, score); exact, one scan and a top-k."""
    query = df.where(df[id_col] == query_id).select(F.col(vector_col).alias("__q")).limit(1)
    both = df.where(df[id_col] != query_id).crossJoin(F.broadcast(query))  # one row
    measure = cosine(F.col(vector_col), F.col("__q")) if metric == "cosine" else 1 / (1 + euclidean(F.col(vector_col), F.col("__q")))
    return both.select(id_col, measure.alias("score")).orderBy(F.col("score").desc(), F.col(id_col).asc()).limit(k)


def stats(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = _doubles(df[vector_col])
    total = F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    return df.select(id_col, F.size(v).alias("dimensions"), F.slice(v, 1, 8).alias("first"), F.array_min(v).alias("min"), F.array_max(v).alias("max"), (total / F.size(v)).alias("mean"))


def problems(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, problem) of vectors that are empty, not finite, or of another length than most."""
    v = _doubles(df[vector_col])
    size = df.where(df[vector_col].isNotNull()).groupBy(F.size(vector_col).alias("size")).count().orderBy(F.col("count").desc(), "size").limit(1).select(F.col("size").alias("__size"))
    checked = df.crossJoin(F.broadcast(size))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    problem = F.when(v.isNull() | (F.size(v) == 0), "empty").when(bad, "not finite").when(F.size(v) != F.col("__size"), "other length")
    return checked.select(id_col, problem.alias("problem")).where("problem is not null")


def colors(df: DataFrame, id_col: str, value_col: str, palette: int = 12) -> DataFrame:
    """A colour for each distinct value, by its place among the sorted values."""
    values = df.select(value_col).distinct().where(F.col(value_col).isNotNull()).orderBy(value_col).withColumn("__n", F.monotonically_increasing_id())
    values = written(values)  # sorted by ranges: a number tells the range, and the place in it
    part, at = F.shiftright("__n", 33), F.col("__n").bitwiseAND((1 << 33) - 1)
    sizes = values.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row a range
    placed = values.withColumn("part", part).join(F.broadcast(before), "part").select(value_col, ((F.col("before") + at) % palette).cast("int").alias("color"))
    return df.join(placed, value_col).select(id_col, value_col, "color")


def pca(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, x, y): centred projections on the first two principal axes; an axis points where its largest
    component is positive. One dimension gives (v, 0) uncentred; no variance gives (0, 0); an empty table none.

    The covariance is gathered by treeAggregate inside Spark ML; what reaches the driver is d by d.
    """
    import numpy as np
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    first = df.select(F.size(vector_col)).first()
    if first is None:
        return df.select(id_col, F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    if first[0] == 1:
        return df.select(id_col, _doubles(df[vector_col])[0].alias("x"), F.lit(0.0).alias("y"))
    rows = df.select(id_col, array_to_vector(_doubles(df[vector_col])).alias("__v"))
    summary = rows.select(Summarizer.metrics("mean", "variance").summary(F.col("__v")).alias("s")).select("s.mean", "s.variance").first()
    if float(np.sum(summary["variance"].toArray())) == 0.0:
        return df.select(id_col, F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    basis = PCA(k=2, inputCol="__v", outputCol="__p").fit(rows).pc.toArray()
    basis = basis * np.where(basis[np.abs(basis).argmax(0), range(2)] < 0, -1.0, 1.0)
    mean = summary["mean"].toArray()
    v = vector_to_array("__v")
    axis = lambda k: F.array(*[F.lit(float(x)) for x in basis[:, k]])
    return rows.select(id_col, (dot(v, axis(0)) - float(mean @ basis[:, 0])).alias("x"), (dot(v, axis(1)) - float(mean @ basis[:, 1])).alias("y"))
