"""The operation metrics over a stream: rate, latency sketch, slow operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veldspar.shared import new_path

#: Slow operations that are shown, and the seconds after which a table is renewed.
SLOW_KEPT, REFRESH_SECONDS = 100, 5


def rates(stream: DataFrame, ts_col: str = "ts", window: str = "60 seconds", slide: str = "5 seconds", late: str = "2 minutes") -> DataFrame:
    """Operations a second in sliding windows; rows later than the watermark don't count."""
    seconds = F.unix_timestamp(F.col("w.end")) - F.unix_timestamp(F.col("w.start"))
    counted = stream.withWatermark(ts_col, late).groupBy(F.window(ts_col, window, slide).alias("w")).agg(F.count("*").alias("operations"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "operations", (F.col("operations") / seconds).alias("ops_per_second"))


def latencies(stream: DataFrame, ts_col: str = "ts", seconds_col: str = "seconds", window: str = "60 seconds", late: str = "2 minutes") -> DataFrame:
    """p50 and p99 in tumbling windows from mergeable sketches, whose state has a bound."""
    counted = stream.withWatermark(ts_col, late).groupBy(F.window(ts_col, window).alias("w")).agg(F.expr(f"kll_sketch_agg_double({seconds_col})").alias("sketch"))
    at = lambda q: F.expr(f"kll_sketch_get_quantile_double(sketch, {q}D)")
    return counted.select(F.col("w.start").alias("start"), at(0.5).alias("p50"), at(0.99).alias("p99"))


def slow(stream: DataFrame, threshold: float, seconds_col: str = "seconds", text_col: str | None = None, failed_col: str | None = None) -> DataFrame:
    """Operations at or above a threshold; the description of a failed one says so."""
    found = stream.where(F.col(seconds_col) >= threshold)
    if text_col and failed_col:
        found = found.withColumn(text_col, F.when(F.col(failed_col), F.concat(F.lit("[FAILED] "), F.col(text_col))).otherwise(F.col(text_col)))
    return found


def latest(found: DataFrame, ts_col: str = "ts", keep: int = SLOW_KEPT) -> DataFrame:
    """Of the rows that a stream of slow operations has written, so many, the newest first."""
    return found.orderBy(F.col(ts_col).desc()).limit(keep)


def start(df: DataFrame, name: str, mode: str = "append", seconds: int = REFRESH_SECONDS) -> StreamingQuery:
    """Runs a stream into a table in memory, renewed every so many seconds."""
    return df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(processingTime=f"{seconds} seconds").start()


def run_to_memory(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now and gives its result table, which the driver holds: for few rows."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def run_to_files(df: DataFrame) -> DataFrame:
    """Runs a stream that only appends over what is there now and gives its result as a table of the shared folder:
    rows stay off the driver, however many there are."""
    path = new_path(df.sparkSession, "stream-*")
    q = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)
