"""Records: sizes, paging, upsert and delete, previews, JSON trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldspar.functions import values as V


#: Fields by path that a list of records shows at most.
PATH_COLUMNS = 4


class RecordError(ValueError):
    """A record that can't be used as it is."""


def with_sizes(df: DataFrame, id_col: str, type_name: str) -> DataFrame:
    """_id, _type and _json_bytes before the columns; a row without an id fails the job."""
    key = F.when(df[id_col].isNotNull(), df[id_col].cast("string")).otherwise(F.raise_error(F.lit(f"{type_name}: a record has no {id_col}")))
    body = F.to_json(F.struct(*[df[f"`{c}`"] for c in sorted(df.columns)]))
    return df.select(key.alias("_id"), F.lit(type_name).alias("_type"), F.octet_length(body).cast("bigint").alias("_json_bytes"), "*")


def page(df: DataFrame, id_col: str, offset: int = 0, size: int = 100) -> DataFrame:
    """One page by id, with has_more: whether a row follows the page; one row more than the page is read."""
    some = df.orderBy(id_col).offset(offset).limit(size + 1)
    numbered = some.select("*", F.count("*").over(_all()).alias("__n"), F.row_number().over(_all().orderBy(id_col)).alias("__k"))
    return numbered.where(F.col("__k") <= size).withColumn("has_more", F.col("__n") > size).drop("__n", "__k")


def _all():
    from pyspark.sql.window import Window

    return Window.partitionBy(F.lit(0))  # at most a page and one row


def sort_records(df: DataFrame, by: str, id_col: str, descending: bool = False) -> DataFrame:
    key = df[by]
    return df.orderBy(key.desc() if descending else key.asc(), df[id_col].asc())


def upsert(df: DataFrame, changes: DataFrame, id_col: str) -> DataFrame:
    """Rows of changes replace those of the same id or are added."""
    return df.join(changes.select(id_col), id_col, "left_anti").unionByName(changes, allowMissingColumns=True)


def delete(df: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    return df.join(ids.select(id_col).distinct(), id_col, "left_anti")


def preview(df: DataFrame) -> Column:
    """The first three keys in order: strings quoted, other scalars plain, the rest as three dots."""
    parts = []
    for name in sorted(df.columns)[:3]:
        column, kind = df[f"`{name}`"], V.kind_of(df.schema[name].dataType)
        shown = {"string": F.concat(F.lit('"'), column, F.lit('"')), "number": V.number_text(column) if kind == "number" else None, "boolean": column.cast("string")}.get(kind)
        parts.append(F.concat(F.lit(f"{name}: "), F.coalesce(shown if shown is not None else F.lit("..."), F.lit("null"))))
    return F.concat(F.lit("{ "), F.concat_ws(", ", *parts), F.lit(" }"))


def json_tree(df: DataFrame, id_col: str, variant_col: str) -> DataFrame:
    """(id, path, depth, display, type) of every node of a JSON tree, keys in order, however deep. A row's tree is
    flattened inside the row, all in one scan."""
    root = F.struct(F.lit("$").alias("path"), F.col(variant_col).alias("v"))
    level, levels = df.select(F.col(id_col), F.array(root).alias("at0")), []
    none = F.array().cast("array<struct<path:string,v:variant>>")

    def inner(x: Column) -> Column:
        kind = V.variant_type(x["v"])
        keys = F.map_entries(F.try_variant_get(x["v"], "$", "map<string,variant>"))
        named = F.transform(keys, lambda e: F.struct(F.concat(x["path"], F.lit("."), e["key"]).alias("path"), e["value"].alias("v")))
        items = F.try_variant_get(x["v"], "$", "array<variant>")
        listed = F.transform(items, lambda v, k: F.struct(F.concat(x["path"], F.lit("["), k.cast("string"), F.lit("]")).alias("path"), v.alias("v")))
        return F.when(kind == "object", named).when(kind == "array", listed).otherwise(none)

    for k in range(V.nesting(df, variant_col, "{[", "}]") + 1):
        if k:
            level = level.withColumn(f"at{k}", F.flatten(F.transform(f"at{k - 1}", inner)))
        levels.append(F.transform(f"at{k}", V.at_depth(k)))
    out = level.select(id_col, F.explode(F.concat(*levels)).alias("x")).select(id_col, "x.*")
    return out.select(id_col, "path", "depth", V.display(F.col("v")).alias("display"), V.variant_type(F.col("v")).alias("type"))


def configured(df: DataFrame, id_col: str, type_name: str, paths: list[str], shows: tuple[str, ...] = ("id", "preview", "size")) -> DataFrame:
    """The columns of a list of records: id, preview and size as chosen, and up to four fields by path."""
    if len(paths) > PATH_COLUMNS:
        raise RecordError(f"at most {PATH_COLUMNS} fields")
    fixed = {"id": F.col("_id"), "preview": preview(df).alias("preview"), "size": byte_size(F.col("_json_bytes")).alias("size")}
    sized = with_sizes(df, id_col, type_name)
    found = [F.coalesce(V.text_of(V.resolve(df, p)), F.lit("-")).alias(p) for p in paths]
    return sized.select(*[fixed[x] for x in shows], *found)


def hexdump(column: Column) -> Column:
    """Lower-case pairs of digits with a blank between bytes."""
    return F.trim(F.regexp_replace(F.lower(F.hex(column.cast("binary"))), "(..)", "$1 "))


def byte_size(n: Column) -> Column:
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024 * 1024, V.fixed(n / 1024, 1, " KB")).otherwise(V.fixed(n / (1024 * 1024), 1, " MB"))


def is_json_object(text: Column) -> Column:
    """Whether a text is JSON whose root is an object."""
    return F.coalesce(V.variant_type(F.try_parse_json(text)) == "object", F.lit(False))


def storage_kind(path: str) -> str:
    low = path.lower()
    return "sqlite" if low.endswith((".sqlite", ".db")) else "cluster"


def variant_row(df: DataFrame, columns: list[str] | None = None) -> Column:
    """The row as one variant."""
    return F.parse_json(F.to_json(F.struct(*[df[f"`{c}`"] for c in columns or df.columns])))

