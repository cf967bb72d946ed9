"""Packing: optimal length buckets by dynamic programming over the global histogram, which chooses the bucket
boundaries that minimise padding; token-budget batches form inside each bucket.

The histogram has one bin for each distinct length, so the boundaries are optimal. What reaches the driver are
16 bytes a distinct length, and texts of T tokens in all have fewer than sqrt(2 T) + 1 of them, 1.4 million in 1e12.
Documents are numbered inside (bucket, chunk) and shifted by the chunks' counts, so that no bucket,
however large, meets in one task; rows are dealt to chunks by their number, so repeats of one row spread too.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import _common as C

BUCKETS, TOKEN_BUDGET = 8, 32_768


def best_splits(cost: np.ndarray, top: np.ndarray, n: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each length j the least padding of all up to j where the bucket before the last ends at some i < j, and
    the least such i. That i never falls as j grows, so j of one level search only between their neighbours' i."""
    d = len(top)
    value, choice = np.full(d, np.iinfo(np.int64).max), np.zeros(d, np.int64)
    step = 1 << max(0, (d - 1).bit_length() - 1)
    while step:
        j = np.arange(step, d, 2 * step)
        low, high = choice[j - step], j - 1
        inner = j + step < d
        high[inner] = np.minimum(high[inner], choice[j[inner] + step])
        size = high - low + 1
        start = np.cumsum(size) - size
        i, at = np.arange(size.sum()) + np.repeat(low - start, size), np.repeat(j, size)
        t = cost[i] + top[at] * (n[at + 1] - n[i + 1]) - (s[at + 1] - s[i + 1])
        value[j] = np.minimum.reduceat(t, start)
        least = np.flatnonzero(t == np.repeat(value[j], size))
        choice[j] = i[least[np.searchsorted(least, start)]]
        step //= 2
    return value, choice


def optimal_boundaries(lengths: np.ndarray, counts: np.ndarray, totals: np.ndarray, buckets: int) -> list[int]:
    """The upper ends, from sorted distinct lengths, of at most `buckets` buckets with the least padding; totals are
    the sums of the lengths. The last is the largest length."""
    d = len(lengths)
    if not d:
        return []
    top = np.asarray(lengths, np.int64)
    n, s = (np.concatenate(([0], np.cumsum(np.asarray(x, np.int64)))) for x in (counts, totals))
    cost = top * n[1:] - s[1:]  # one bucket for all bins up to j
    back: list[np.ndarray] = []
    for _ in range(1, min(buckets, d)):
        value, choice = best_splits(cost, top, n, s)
        better = value < cost
        cost, choice = np.where(better, value, cost), np.where(better, choice, -1)
        back.append(choice)
    ends, j = [d - 1], d - 1
    for choice in reversed(back):
        if choice[j] >= 0:
            j = int(choice[j])
            ends.append(j)
    return [int(top[k]) for k in reversed(ends)]


def _length(column: Column) -> Column:
    return F.greatest(F.coalesce(column.cast("long"), F.lit(0)), F.lit(0))


def length_boundaries(df: DataFrame, length_col: str, buckets: int = BUCKETS) -> list[int]:
    lengths = df.select(_length(F.col(f"`{length_col}`")).alias("n"))
    bins = lengths.groupBy("n").agg(F.count("*").alias("docs")).toArrow()
    top, docs = (bins.column(k).to_numpy() for k in range(2))
    order = np.argsort(top)
    top, docs = top[order], docs[order]
    return optimal_boundaries(top, docs, top * docs, buckets)


def pack(df: DataFrame, id_col: str = "doc_id", length_col: str = "n_tokens", buckets: int = BUCKETS, token_budget: int = TOKEN_BUDGET) -> DataFrame:
    """One row per input row: id_col, length_col, bucket (from 0, by length), bucket_length (its padded length),
    batch (from 0 inside the bucket), slot (from 0 inside the batch) and padding.

    A batch of a bucket holds floor(token_budget / bucket_length) documents, one at least: a document longer
    than the budget is a batch of its own and isn't cut. A null or negative length counts as 0, a null id is packed
    like any other. Repeated rows each get a slot; ties go by length, then id. Other columns play no part. An empty
    table gives an empty result.
    """
    return _packed(C.checkpointed(_numbered(df, id_col, F.col(f"`{length_col}`"))), id_col, length_col, buckets, token_budget)


def _numbered(df: DataFrame, id_col: str, length: Column) -> DataFrame:
    return df.select(F.col(f"`{id_col}`").alias("id"), _length(length).alias("n"), F.monotonically_increasing_id().alias("row"))


def _packed(slim: DataFrame, id_col: str, length_col: str, buckets: int, token_budget: int) -> DataFrame:
    ends = length_boundaries(slim, "n", buckets) or [0]
    bucket = F.lit(len(ends) - 1)
    for k in range(len(ends) - 2, -1, -1):
        bucket = F.when(F.col("n") <= ends[k], F.lit(k)).otherwise(bucket)
    length = F.element_at(F.lit(ends).cast("array<bigint>"), F.col("bucket") + 1)
    chunks = 4 * C.partitions_for(slim, slim.count(), 1_000_000)
    placed = slim.select("id", "n", "row", bucket.cast("int").alias("bucket"), F.pmod(F.xxhash64("row"), F.lit(chunks)).cast("int").alias("chunk"))
    counts = placed.groupBy("bucket", "chunk").agg(F.count("*").alias("docs"))
    before = Window.partitionBy("bucket").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("bucket", "chunk", F.coalesce(F.sum("docs").over(before), F.lit(0)).alias("offset"))
    own = placed.withColumn("rank", F.row_number().over(Window.partitionBy("bucket", "chunk").orderBy("n", "id", "row")))
    numbered = own.join(offsets, ["bucket", "chunk"]).withColumn("at", F.col("offset") + F.col("rank") - 1).withColumn("bucket_length", length)
    room = F.greatest(F.lit(1), F.floor(F.lit(token_budget) / F.greatest(F.col("bucket_length"), F.lit(1)))).cast("long")
    return numbered.withColumn("room", room).select(
        F.col("id").alias(id_col),
        F.col("n").alias(length_col),
        "bucket",
        "bucket_length",
        F.floor(F.col("at") / F.col("room")).cast("long").alias("batch"),
        (F.col("at") % F.col("room")).cast("long").alias("slot"),
        (F.col("bucket_length") - F.col("n")).alias("padding"),
    )


def word_count(column: Column) -> Column:
    """Words of a text; the length by which documents are packed where no tokenizer has run."""
    return F.regexp_count(C.text_or_empty(column), F.lit(C.WORD)).cast(T.LongType())


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, token_budget: int = TOKEN_BUDGET) -> DataFrame:
    """pack() by the number of words of each whole text, however long; a null or empty text has none."""
    return _packed(C.checkpointed(_numbered(df, id_col, word_count(F.col(f"`{text_col}`")))), id_col, "n_tokens", buckets, token_budget)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(C.table(spark, sf_dir, "documents").select("doc_id", "text"))
