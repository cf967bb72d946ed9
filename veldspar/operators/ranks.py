"""Exact positions in sorted values without a task that holds all of a group's values."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Ranges at least, and rows of a range.
PARTS, PART_ROWS = 32, 2_000_000


def placed(df: DataFrame, value_col: str, group_cols: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """(groups, x, n, upto, total): each distinct value of a group, how many rows have it, how many have it or less,
    and how many the group has. Nulls are left out.

    Values are counted map-side and dealt out by ranges, whose bounds come from a sketch and decide only which task
    does the work; sums of the ranges make the positions exact. The ranges grow in number with the rows.
    """
    keys = group_cols or []
    parts = parts or max(PARTS, math.ceil(df.count() / PART_ROWS))
    counts = df.where(F.col(value_col).isNotNull()).groupBy(*keys, F.col(value_col).alias("x")).agg(F.count("*").alias("n"))
    bounds = sorted({b for b in df.approxQuantile(value_col, [k / parts for k in range(1, parts)], min(0.02, 0.25 / parts))})
    part = sum(((F.col("x") > b).cast("int") for b in bounds), F.lit(0))
    ranged = counts.withColumn("part", part)
    own = ranged.groupBy(*keys, "part").agg(F.sum("n").alias("own"))
    by = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))  # a row for each range
    before = own.select(*keys, "part", F.coalesce(F.sum("own").over(by.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("own").over(by).alias("total"))
    upto = ranged.withColumn("upto", F.sum("n").over(Window.partitionBy(*keys, "part").orderBy("x")))
    return upto.join(before, [*keys, "part"]).select(*keys, "x", "n", (F.col("upto") + F.col("before")).alias("upto"), "total")
