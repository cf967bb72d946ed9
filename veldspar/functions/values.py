"""Dynamic values as typed columns: number text, three-way comparison, display text, JSON paths."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text that reads as a number: no blanks, no suffixes.
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
VECTOR_LENGTH = 64


@dataclass(frozen=True)
class Field:
    """A resolved field path: its column and its kind (string, number, boolean, variant or other)."""

    column: Column
    kind: str


def kind_of(data_type: T.DataType) -> str:
    if isinstance(data_type, T.StringType):
        return "string"
    if isinstance(data_type, NUMERIC):
        return "number"
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    return "variant" if isinstance(data_type, T.VariantType) else "other"


def resolve(df: DataFrame, path: str) -> Field:
    """The field at a dotted path; a path that the schema doesn't have is a null of no kind.

    Steps go through structs by schema and through variants by value, so a predicate on a struct's field still
    reaches the scan.
    """
    steps = path.split(".")
    schema: T.DataType = df.schema
    column: Column | None = None
    for k, step in enumerate(steps):
        if isinstance(schema, T.StructType):
            found = next((f for f in schema.fields if f.name == step), None)
            if found is None:
                return Field(F.lit(None).cast("string"), "other")
            column = df[f"`{step}`"] if column is None else column.getField(step)
            schema = found.dataType
        elif isinstance(schema, T.VariantType):
            rest = "".join(f"['{s}']" for s in steps[k:])
            return Field(F.try_variant_get(column, f"${rest}", "variant"), "variant")
        else:
            return Field(F.lit(None).cast("string"), "other")
    return Field(column, kind_of(schema))


def data_type(df: DataFrame, path: str) -> T.DataType | None:
    """The type at a dotted path through structs."""
    kind: T.DataType | None = df.schema
    for step in path.split("."):
        kind = next((f.dataType for f in kind.fields if f.name == step), None) if isinstance(kind, T.StructType) else None
    return kind


def number_of_text(text: Column) -> Column:
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def number_text(number: Column) -> Column:
    """Integral numbers without a fraction, others as they print."""
    whole = (number == F.floor(number)) & (F.abs(number) < 1e15)
    return F.when(whole, F.floor(number).cast("bigint").cast("string")).otherwise(number.cast("double").cast("string"))


def variant_type(v: Column) -> Column:
    """string, number, boolean, array, object or unknown (null)."""
    tag = F.schema_of_variant(v)
    return (
        F.when(v.isNull() | F.is_variant_null(v), "unknown")
        .when(tag == "STRING", "string")
        .when(tag == "BOOLEAN", "boolean")
        .when(tag.startswith("ARRAY"), "array")
        .when(tag.startswith("OBJECT"), "object")
        .otherwise("number")
    )


def _ordered(left: Column, right: Column) -> Column:
    """-1, 0 or 1; pairs without an order (NaN) are equal."""
    return F.when(F.isnan(left), 0).when(left < right, -1).when(left > right, 1).otherwise(0)


def _texts(left: Column, right: str) -> Column:
    low, value = F.lower(left), F.lit(right.lower())
    return F.when(low < value, -1).when(low > value, 1).otherwise(0)


def _number_of(value: str) -> float | None:
    import re

    return float(value) if re.match(NUMBER, value) else None


def _against(column: Column, kind: str, value) -> Column:
    """Three-way order of a present value of a kind against a literal."""
    if value is None:
        return F.lit(1)
    if kind == "string":
        if isinstance(value, str):
            return _texts(column, value)
        if isinstance(value, bool):
            return F.lit(-1)
        number = number_of_text(column)
        return F.when(number.isNotNull(), _ordered(number, F.lit(float(value)))).otherwise(F.lit(-1))
    if kind == "number":
        number = column.cast("double")
        if isinstance(value, str):
            parsed = _number_of(value)
            return _texts(number_text(number), value) if parsed is None else _ordered(number, F.lit(parsed))
        return _ordered(number, F.lit(float(value)))
    if kind == "boolean":
        if isinstance(value, bool):
            return F.when(column == F.lit(value), 0).when(column, 1).otherwise(-1)
        return _texts(column.cast("string"), value) if isinstance(value, str) else _ordered(column.cast("int").cast("double"), F.lit(float(value)))
    return _texts(column.cast("string"), value) if isinstance(value, str) else F.lit(-1)


def compare(field: Field, value) -> Column:
    """-1, 0 or 1 for the order of a field against a literal; a missing field comes before every value, and is
    equal to null; text has no case; anything comes after null."""
    column = field.column
    missing = F.lit(0 if value is None else -1)
    if field.kind != "variant":
        return F.when(column.isNull(), missing).otherwise(_against(column, field.kind, value))
    kind = variant_type(column)
    text, number, flag = (F.try_variant_get(column, "$", t) for t in ("string", "double", "boolean"))
    return (
        F.when(kind == "unknown", missing)
        .when(kind == "string", _against(text, "string", value))
        .when(kind == "number", _against(number, "number", value))
        .when(kind == "boolean", _against(flag, "boolean", value))
        .otherwise(_texts(F.to_json(column), value) if isinstance(value, str) else F.lit(1 if value is None else -1))
    )


def text_of(field: Field) -> Column:
    """The value as text if it is a string, else null."""
    if field.kind == "variant":
        return F.when(variant_type(field.column) == "string", F.try_variant_get(field.column, "$", "string"))
    return field.column if field.kind == "string" else F.lit(None).cast("string")


def coerced(field: Field) -> Column:
    """Numbers and number-like text as double; booleans and all else null."""
    if field.kind == "number":
        return field.column.cast("double")
    if field.kind == "string":
        return number_of_text(field.column)
    if field.kind == "variant":
        kind = variant_type(field.column)
        return F.when(kind == "number", F.try_variant_get(field.column, "$", "double")).when(kind == "string", number_of_text(F.try_variant_get(field.column, "$", "string")))
    return F.lit(None).cast("double")


def is_missing(field: Field) -> Column:
    return field.column.isNull() | F.is_variant_null(field.column) if field.kind == "variant" else field.column.isNull()


def display(v: Column) -> Column:
    """A variant as cell text: -, null, plain scalars, [n items], [vector: nd] or {n fields}."""
    kind = variant_type(v)
    items = F.size(F.try_variant_get(v, "$", "array<variant>"))
    fields = F.size(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>")))
    return (
        F.when(v.isNull(), "-")
        .when(F.is_variant_null(v), "null")
        .when(kind == "array", F.when(items > VECTOR_LENGTH, F.concat(F.lit("[vector: "), items.cast("string"), F.lit("d]"))).otherwise(F.concat(F.lit("["), items.cast("string"), F.lit(" items]"))))
        .when(kind == "object", F.concat(F.lit("{"), fields.cast("string"), F.lit(" fields}")))
        .when(kind == "number", number_text(F.try_variant_get(v, "$", "double")))
        .otherwise(F.try_variant_get(v, "$", "string"))
    )


def fixed(x: Column, digits: int, unit: str = "") -> Column:
    """A double with so many decimals as C's printf rounds it, by its exact value and halves to even; Java's rounds the
    shortest decimal that reads as the double, and halves up."""
    scale = 10**digits
    p = x * scale
    c = x * 134_217_729  # 2**27 + 1 halves the bits, so that high * scale is exact
    high = c - (c - x)
    rest = (high * scale - p) + (x - high) * scale  # x * scale without rounding is p + rest
    half = (F.abs(p - F.rint(p)) == 0.5) & (rest != 0)
    whole = F.when(half, F.when(rest > 0, F.ceil(p)).otherwise(F.floor(p)).cast("double")).otherwise(F.rint(p))
    return F.format_string(f"%.{digits}f{unit}", F.when(F.abs(p) < 2**51, whole / scale).otherwise(x))


def short_number(x: Column) -> Column:
    """Chart labels: whole numbers below a million, M, K, else two decimals."""
    x = x.cast("double")
    return (
        F.when((x == F.round(x)) & (F.abs(x) < 1e6), fixed(x, 0))
        .when(F.abs(x) >= 1e6, fixed(x / 1e6, 1, "M"))
        .when(F.abs(x) >= 1e3, fixed(x / 1e3, 1, "K"))
        .otherwise(fixed(x, 2))
    )


def at_depth(k: int) -> Callable[[Column], Column]:
    """Of a struct (path, v) the same with its depth."""
    return lambda x: F.struct(x["path"].alias("path"), F.lit(k).alias("depth"), x["v"].alias("v"))


def nesting(df: DataFrame, variant_col: str, opening: str, closing: str) -> int:
    """How deep brackets of the given kinds nest in the JSON of a column, over all rows; one scan."""
    bare = F.regexp_replace(F.to_json(F.struct(F.col(variant_col).alias("v"))), r'"(?:[^"\\\\]|\\\\.)*+"', "")
    marks = F.split(F.regexp_replace(bare, f"[^{re.escape(opening + closing)}]", ""), "")

    def step(state: Column, c: Column) -> Column:
        now = state["now"] + F.when(F.contains(F.lit(opening), c) & (c != ""), 1).when(F.contains(F.lit(closing), c) & (c != ""), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(state["most"], now).alias("most"))

    deep = F.aggregate(marks, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step, lambda s: s["most"])
    # the struct around the column is one level of its own
    return (df.where(F.col(variant_col).isNotNull()).agg(F.max(deep)).first()[0] or 1) - ("{" in opening)
