"""Aggregation of one field with at most one group key."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldspar.functions import values as V
from veldspar.operators.ranks import placed

FUNCTIONS = ("count", "sum", "avg", "min", "max", "percentile")
NO_GROUP = "(null)"


@dataclass(frozen=True)
class Aggregation:
    function: str
    field: str | None = None
    group_by: str | None = None
    percentile: float = 0.95
    title: str | None = None

    def __post_init__(self):
        if self.function not in FUNCTIONS:
            raise ValueError(f"unknown function: {self.function}")

    @property
    def label(self) -> str:
        if self.title:
            return self.title
        name = f"P{int(self.percentile * 100)}" if self.function == "percentile" else self.function.upper()
        return f"{name}({self.field or '*'})"


def _value(function: str, x: Column) -> Column:
    if function == "count":
        return F.count("*").cast("double")
    if function == "sum":
        return F.coalesce(F.sum(x), F.lit(0.0))
    return {"avg": F.avg, "min": F.min, "max": F.max}[function](x)


def group_text(df: DataFrame, name: str) -> Column:
    found = V.resolve(df, name)
    shown = V.number_text(found.column.cast("double")) if found.kind == "number" else found.column.cast("string")
    return F.coalesce(shown, F.lit(NO_GROUP))


def aggregate(df: DataFrame, query: Aggregation) -> DataFrame:
    """Rows (group_key, value, label). Values are numbers and number-like text. sum of nothing is 0; other
    functions of nothing, and minima or maxima that aren't finite, give no row."""
    x = V.coerced(V.resolve(df, query.field)) if query.field else F.lit(None).cast("double")
    key = group_text(df, query.group_by) if query.group_by else F.lit("Total")
    rows = df.select(key.alias("group_key"), x.alias("x"))
    if query.function == "percentile":
        out = _at_index(rows, query.percentile)
    elif query.group_by:
        out = rows.groupBy("group_key").agg(_value(query.function, F.col("x")).alias("value"))
    else:
        out = rows.agg(_value(query.function, F.col("x")).alias("value")).select(F.lit("Total").alias("group_key"), "value")
    if query.function != "count":
        out = out.where(F.col("value").isNotNull())
    if query.function in ("min", "max"):
        out = out.where(~F.isnan("value") & (F.abs("value") != float("inf")))
    label = F.col("group_key") if query.group_by else F.lit(query.label)
    return out.select("group_key", "value", label.alias("label"))


def _at_index(rows: DataFrame, p: float) -> DataFrame:
    """The value at index floor((n - 1) * p) of each group's sorted values."""
    at = F.floor((F.col("total") - 1) * F.lit(p))
    return placed(rows, "x", ["group_key"]).where(F.col("upto") > at).groupBy("group_key").agg(F.min("x").alias("value"))


def dashboard(df: DataFrame) -> list[Aggregation]:
    """The panels that a table starts with: its count, the sum of its first number by name, the count by its first
    field that is no number, and the sum by its second."""
    fields = sorted(df.schema.fields, key=lambda f: f.name)
    numbers = [f.name for f in fields if V.kind_of(f.dataType) == "number"]
    others = [f.name for f in fields if f.name not in numbers and f.name not in ("id", "_id")]
    out = [Aggregation("count", title="Total Count")]
    if numbers:
        out.append(Aggregation("sum", numbers[0], title=f"Sum of {numbers[0]}"))
    if others:
        out.append(Aggregation("count", group_by=others[0], title=f"Count by {others[0]}"))
    if numbers and len(others) > 1:
        out.append(Aggregation("sum", numbers[0], others[1], title=f"{numbers[0]} by {others[1]}"))
    return out


def run_dashboard(df: DataFrame) -> DataFrame:
    """All panels' rows with the panel's number."""
    out = None
    for k, query in enumerate(dashboard(df)):
        rows = aggregate(df, query).select(F.lit(k).alias("panel"), "*")
        out = rows if out is None else out.unionByName(rows)
    return out
