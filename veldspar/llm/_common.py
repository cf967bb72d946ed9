"""Shared pieces of the training-data operators."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space that separates words: what bytes.split() cuts at.
WORD = r"[^\x20\x09-\x0D]+"

_MASK = (1 << 64) - 1
#: Odd bases of the polynomial hashes.
BASE, OTHER_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the folder that the session names. Only a local master, as in tests, gets one made where none is set: the
    executors of a cluster don't see a folder of the driver."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="veldspar-checkpoint-"))


def checkpointed(df: DataFrame) -> DataFrame:
    """df as a table written to the shared folder: later reads take only their columns, and its size is its true one,
    where the estimate of a checkpoint() inside a loop of joins squares with every round."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions_for(df: DataFrame, units: float, per_partition: float) -> int:
    """Shuffle partitions for a load: the session's number at least, more where the load asks for it."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(units / per_partition), 1)


def free_name(taken: Iterable[str], stem: str) -> str:
    """A column name that clashes with none of those taken, whatever their case."""
    low, name = {x.lower() for x in taken}, f"__{stem}"
    while name.lower() in low:
        name = f"_{name}"
    return name


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Drops input columns whose names an operator's outputs take."""
    low = {x.lower() for x in names}
    return df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in low])


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64 over an array of unsigned 64-bit integers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), np.uint64(base & _MASK), dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class WordHashes(dict):
    """64-bit hashes of words; the cache empties itself when full, so its memory has a bound."""

    def __init__(self, limit: int = 200_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


class Rolling:
    """Rabin-Karp hashes of all windows of n items over one array of item hashes, modulo 2**64."""

    def __init__(self, n: int, base: int = BASE):
        self.n, self.bases = n, (base, pow(base, -1, 1 << 64))
        self.up, self.down = (powers(b, 1) for b in self.bases)

    def __call__(self, items: np.ndarray) -> np.ndarray:
        size = len(items)
        if size < self.n:
            return np.empty(0, np.uint64)
        if size > len(self.up):
            self.up, self.down = (powers(b, 2 * size) for b in self.bases)
        prefix = np.zeros(size + 1, np.uint64)
        np.cumsum(items * self.up[:size], out=prefix[1:])
        return mix((prefix[self.n :] - prefix[: -self.n]) * self.down[: size - self.n + 1])


def text_or_empty(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (a, b): rows (node, component), the component named by
    its smallest node.

    Each round every node takes the least of its own and its neighbours' names (partial aggregates keep hubs cheap)
    and then that node's; edges between the new names go on, so a chain of any length takes rounds as its logarithm.
    What a round finds is written, so that a lost executor costs one round. Nulls and loops are ignored; an empty
    table gives an empty result.
    """

    def forward(a: Column, b: Column) -> list[Column]:
        return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]

    links = checkpointed(edges.where("a is not null and b is not null and a <> b").select(*forward(F.col("a"), F.col("b"))).distinct())
    names = None
    while names is None or not links.isEmpty():
        both = links.select(F.col("a").alias("node"), F.col("b").alias("near")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("near")))
        least = both.groupBy("node").agg(F.least("node", F.min("near")).alias("name"))
        up = least.select(F.col("node").alias("name"), F.col("name").alias("above"))
        step = checkpointed(least.join(up, "name").select("node", F.col("above").alias("name")))
        renamed = step.select(F.col("node").alias("name"), F.col("name").alias("new"))
        names = step if names is None else names.join(renamed, "name", "left").select("node", F.coalesce("new", "name").alias("name"))
        ends = [step.select(F.col("node").alias(x), F.col("name").alias(f"{x}_name")) for x in "ab"]
        links = checkpointed(links.join(ends[0], "a").join(ends[1], "b").where("a_name <> b_name").select(*forward(F.col("a_name"), F.col("b_name"))).distinct())
    return names.select("node", F.col("name").alias("component"))


def field(name: str, kind: T.DataType) -> T.StructField:
    return T.StructField(name, kind, True)
