"""Nested AND/OR predicates over records, compiled to one Column."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import types as T

from veldspar.functions import values as V

OPERATORS = ("=", "!=", ">", ">=", "<", "<=", "contains", "starts with", "ends with", "is null", "is not null")
#: Operators offered for a field of a kind; other kinds get all.
ALLOWED = {
    "string": ("=", "!=", "contains", "starts with", "ends with", "is null", "is not null"),
    "number": ("=", "!=", ">", ">=", "<", "<=", "is null", "is not null"),
    "boolean": ("=", "!=", "is null", "is not null"),
}


@dataclass(frozen=True)
class Condition:
    path: str
    operator: str
    value: str | float | bool | None = None

    def __post_init__(self):
        if self.operator not in OPERATORS:
            raise ValueError(f"unknown operator: {self.operator}")


@dataclass(frozen=True)
class Group:
    items: tuple = field(default_factory=tuple)
    any_of: bool = False


def allowed_operators(kind: str) -> tuple[str, ...]:
    return ALLOWED.get(kind, OPERATORS)


def parsed_value(kind: str, text: str) -> str | float | bool | None:
    """A typed value for a field of a kind from what a user types; text that is no number stays text."""
    if kind == "number":
        return float(text) if V._number_of(text) is not None else text
    if kind == "boolean" and text.strip().lower() in ("true", "false"):
        return text.strip().lower() == "true"
    return text


def _plain(df: DataFrame, c: Condition, found: V.Field) -> Column | None:
    """Comparisons of a number with a number, and with null, in a form that scans can push down; None for others.

    A missing field comes before every value; NaN is equal to every number."""
    column = found.column
    if c.value is None:
        return {"=": column.isNull(), "!=": column.isNotNull(), ">": column.isNotNull(), ">=": F.lit(True), "<": F.lit(False), "<=": column.isNull()}[c.operator] if found.kind != "variant" else None
    if found.kind != "number" or isinstance(c.value, bool):
        return None
    value = V._number_of(c.value) if isinstance(c.value, str) else float(c.value)
    if value is None:
        return None
    kind = V.data_type(df, c.path)
    fraction = isinstance(kind, (T.FloatType, T.DoubleType))
    if not fraction and value == int(value) and abs(value) < 2**31:
        left, right = column, F.lit(int(value))
    else:
        left, right = column.cast("double"), F.lit(value)
    nan = F.isnan(column) if fraction else F.lit(False)
    missing = column.isNull()
    return {
        "=": (left == right) | nan,
        "!=": missing | ((left != right) & ~nan),
        ">": (left > right) & ~nan,
        ">=": left >= right,
        "<": missing | (left < right),
        "<=": missing | (left <= right) | nan,
    }[c.operator]


def _condition(df: DataFrame, c: Condition) -> Column:
    found = V.resolve(df, c.path)
    if c.operator in ("is null", "is not null"):
        missing = F.coalesce(V.is_missing(found), F.lit(True))
        return missing if c.operator == "is null" else ~missing
    if c.operator in ("contains", "starts with", "ends with"):
        if not isinstance(c.value, str):
            return F.lit(False)
        test = {"contains": F.contains, "starts with": F.startswith, "ends with": F.endswith}[c.operator]
        return F.coalesce(test(F.lower(V.text_of(found)), F.lit(c.value.lower())), F.lit(False))
    plain = _plain(df, c, found)
    if plain is not None:
        return plain
    order = V.compare(found, c.value)
    return {"=": order == 0, "!=": order != 0, ">": order > 0, ">=": order >= 0, "<": order < 0, "<=": order <= 0}[c.operator]


def compile_predicate(df: DataFrame, item: Group | Condition) -> Column:
    """Conditions without a path don't count; a group without a result is true, also inside OR."""
    if isinstance(item, Condition):
        return _condition(df, item)
    parts = [compile_predicate(df, x) for x in item.items if not (isinstance(x, Condition) and not x.path.strip())]
    if not parts:
        return F.lit(True)
    return reduce(lambda a, b: a | b if item.any_of else a & b, parts)


def filter_records(df: DataFrame, query: Group) -> DataFrame:
    return df.where(compile_predicate(df, query))


def search_records(df: DataFrame, text: str, id_col: str, ids_only: bool = False) -> DataFrame:
    """Rows whose id, or with ids_only False any string or number leaf, holds the text, whatever its case."""
    low = F.lit(text.strip().lower())
    hit = F.contains(F.lower(df[id_col].cast("string")), low)
    if not ids_only:
        for f in df.schema.fields:
            if f.name != id_col:
                hit = hit | _holds(df[f"`{f.name}`"], f.dataType, low)
    return df.where(hit)


def _holds(column: Column, kind: T.DataType, low: Column, in_list: bool = False) -> Column:
    """Whether a leaf of a column holds the text: texts and numbers, in structs and maps too; in a list texts and what
    its structs hold, but no numbers."""
    hit = F.lit(False)
    if isinstance(kind, T.StructType):
        for f in kind.fields:
            hit = hit | _holds(column[f.name], f.dataType, low)
    elif isinstance(kind, T.MapType):
        hit = F.exists(F.map_values(column), lambda x: _holds(x, kind.valueType, low))
    elif isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.StructType, T.MapType)):
            hit = F.exists(column, lambda x: _holds(x, kind.elementType, low, True))
    elif V.kind_of(kind) == "string":
        hit = F.contains(F.lower(column), low)
    elif V.kind_of(kind) == "number" and not in_list:
        hit = F.contains(F.lower(V.number_text(column)), low)
    return F.coalesce(hit, F.lit(False))
