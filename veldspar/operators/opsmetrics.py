"""Metrics of operations: totals, percentiles, rate, slow operations."""

from __future__ import annotations

import contextlib
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldspar.operators.ranks import placed

SLOW_KEPT, RATE_SECONDS = 100, 60


def at_quantiles(df: DataFrame, value_col: str, quantiles: list[float]) -> DataFrame:
    """One row of p<q>: the value at index min(floor(n * q), n - 1) of the sorted values."""
    index = lambda q: F.least(F.floor(F.col("total") * F.lit(q)), F.col("total") - 1)
    return placed(df, value_col).agg(*[F.min(F.when(F.col("upto") > index(q), F.col("x"))).alias(f"p{round(q * 100)}") for q in quantiles])


def summary(df: DataFrame, ts_col: str, seconds_col: str, failed_col: str, window_seconds: int = RATE_SECONDS) -> DataFrame:
    """One row: total, successes, success_rate, p50, p99 and operations a second in the last window."""
    last = df.agg(F.max(ts_col).alias("last"))
    cut = df.crossJoin(F.broadcast(last))
    recent = F.col(ts_col) >= F.col("last") - F.expr(f"INTERVAL {window_seconds} SECONDS")
    totals = cut.agg(F.count("*").alias("total"), F.count_if(~F.col(failed_col)).alias("successes"), (F.count_if(recent) / F.lit(float(window_seconds))).alias("ops_per_second"))
    totals = totals.withColumn("success_rate", F.when(F.col("total") > 0, F.col("successes") / F.col("total")).otherwise(1.0))
    return totals.crossJoin(at_quantiles(df, seconds_col, [0.5, 0.99]))  # one row each


def slow(df: DataFrame, ts_col: str, seconds_col: str, failed_col: str, text_col: str, threshold: float, id_col: str, keep: int = SLOW_KEPT) -> DataFrame:
    """The newest operations at or above a threshold; failures are marked."""
    text = F.when(F.col(failed_col), F.concat(F.lit("[FAILED] "), F.col(text_col))).otherwise(F.col(text_col))
    return df.where(F.col(seconds_col) >= threshold).select(id_col, ts_col, text.alias("description"), F.col(seconds_col).alias("seconds")).orderBy(F.col(ts_col).desc(), F.col(id_col).desc()).limit(keep)


@contextlib.contextmanager
def measured(record: Callable[[str, float, bool], None], description: str) -> Iterator[None]:
    """Reports (description, seconds, failed) of what runs inside."""
    began, failed = time.perf_counter(), True
    try:
        yield
        failed = False
    finally:
        record(description, time.perf_counter() - began, failed)
