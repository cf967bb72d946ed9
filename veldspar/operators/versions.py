"""Versions of records: field-level differences of snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def diff(before: Column, after: Column) -> Column:
    """array<struct<field, change, before, after>> of two maps, in the order of fields; a null map is empty."""
    none = F.create_map().cast("map<string,string>")
    left, right = F.coalesce(before, none), F.coalesce(after, none)
    names = F.array_sort(F.array_union(F.map_keys(left), F.map_keys(right)))

    def one(name: Column) -> Column:
        was, now = F.try_element_at(left, name), F.try_element_at(right, name)
        had, has = F.map_contains_key(left, name), F.map_contains_key(right, name)
        change = F.when(~had, "added").when(~has, "removed").when(was.eqNullSafe(now), "unchanged").otherwise("modified")
        return F.struct(name.alias("field"), change.alias("change"), was.alias("before"), now.alias("after"))

    return F.transform(names, one)


def history(df: DataFrame, key_col: str, version_col: str, snapshot_col: str) -> DataFrame:
    """(key, version, field, change, before, after): each version against the one before; the first adds all."""
    by = Window.partitionBy(key_col).orderBy(version_col)
    pairs = df.select(key_col, version_col, F.lag(snapshot_col).over(by).alias("__was"), F.col(snapshot_col).alias("__now"))
    return pairs.select(key_col, version_col, F.explode(diff(F.col("__was"), F.col("__now"))).alias("d")).select(key_col, version_col, "d.*")


def changes_only(changes: DataFrame) -> DataFrame:
    return changes.where("change <> 'unchanged'")


def summary(changes: DataFrame, *keys: str) -> DataFrame:
    return changes.groupBy(*keys).agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("added", "removed", "modified")])


def snapshot_diff(old: DataFrame, new: DataFrame, key_col: str, value_col: str) -> DataFrame:
    """(key, change, before, after) of two tables by key: one full outer join."""
    a = old.select(F.col(key_col), F.col(value_col).alias("before"), F.lit(True).alias("had"))
    b = new.select(F.col(key_col), F.col(value_col).alias("after"), F.lit(True).alias("has"))
    change = F.when(F.col("had").isNull(), "added").when(F.col("has").isNull(), "removed").when(F.col("before").eqNullSafe(F.col("after")), "unchanged").otherwise("modified")
    return a.join(b, key_col, "full").select(key_col, change.alias("change"), "before", "after")
