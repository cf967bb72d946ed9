"""Writing records as JSON, JSON lines and CSV."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldspar.functions import values as V


class ExportFailure(ValueError):
    """Records that a format can't hold."""


def _keyed(df: DataFrame, id_col: str, type_name: str) -> DataFrame:
    return df.withColumns({"_id": df[id_col].cast("string"), "_type": F.lit(type_name)})


def json_lines(df: DataFrame, id_col: str, type_name: str) -> DataFrame:
    """(_id, value): one object a row, keys in order, with _id and _type; nulls stay out."""
    k = _keyed(df, id_col, type_name)
    return k.select("_id", F.to_json(F.struct(*[k[f"`{c}`"] for c in sorted(k.columns)])).alias("value"))


def csv_columns(df: DataFrame) -> list[str]:
    """Paths of the fields that CSV holds: texts, numbers, truths, also inside structs."""
    out: list[str] = []

    def walk(schema, prefix: str) -> None:
        for f in schema.fields:
            if hasattr(f.dataType, "fields"):
                walk(f.dataType, f"{prefix}{f.name}.")
            elif V.kind_of(f.dataType) in ("string", "number", "boolean"):
                out.append(prefix + f.name)

    walk(df.schema, "")
    return sorted(out)


def quoted(text: Column) -> Column:
    needs = text.contains(",") | text.contains('"') | text.contains("\n")
    return F.when(needs, F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_lines(df: DataFrame, id_col: str, type_name: str) -> tuple[str, DataFrame]:
    """The header and (_id, value): one line a row; null is empty."""
    k = _keyed(df, id_col, type_name)
    names = [c for c in csv_columns(df) if c not in ("_id", "_type")]
    cells = []
    for name in ("_id", "_type", *names):
        found = V.resolve(k, name)
        shown = V.number_text(found.column) if found.kind == "number" else found.column.cast("string")
        cells.append(quoted(F.coalesce(shown, F.lit(""))))
    return ",".join(("_id", "_type", *names)), k.select("_id", F.concat_ws(",", *cells).alias("value"))


def write_records(df: DataFrame, path: str, format_name: str, id_col: str, type_name: str) -> None:
    """Writes in parallel to a folder: jsonl as one object a line, json as one array a file, csv with a header in each
    file. Rows without any make a file without a record, which no reader takes for records."""
    if format_name == "jsonl":
        json_lines(df, id_col, type_name).select("value").write.text(path)
    elif format_name == "json":
        json_lines(df, id_col, type_name).select("value").mapInArrow(_as_array, "value string").write.text(path)
    elif format_name == "csv":
        k = _keyed(df, id_col, type_name)
        names = [c for c in csv_columns(df) if c not in ("_id", "_type")]
        k.select("_id", "_type", *[V.resolve(k, n).column.alias(n) for n in names]).write.option("header", True).option("escape", '"').option("emptyValue", "").csv(path)
    elif format_name in ("parquet", "orc"):
        df.write.format(format_name).save(path)
    else:
        raise ExportFailure(f"unknown format: {format_name}")


def _as_array(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of objects with the brackets and commas that make an array of a task's file."""
    held = None
    for batch in batches:
        lines = batch.column(0).to_pylist()
        if not lines:
            continue
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([*(f"{x}," for x in held)], pa.string())], names=["value"])
        else:
            yield pa.RecordBatch.from_arrays([pa.array(["["])], names=["value"])
        held = lines
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([*(f"{x}," for x in held[:-1]), held[-1], "]"], pa.string())], names=["value"])


def selected(df: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    return df.join(ids.select(id_col).distinct(), id_col, "left_semi")


def default_name(type_name: str, at: datetime) -> str:
    return f"{type_name}_{at.strftime('%Y-%m-%dT%H-%M-%SZ')}"
