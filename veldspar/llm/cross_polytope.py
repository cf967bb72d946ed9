"""Embedding near-dedup: cross-polytope hashing after fast Hadamard rotations, with multiprobe buckets and verified
candidate pairs.

Equal vectors are one class and go on once. Every class is put into its best few buckets of each table; the
number of hashes that make a bucket grows with the number of classes, so buckets stay small. Inside a bucket a
256-bit sign sketch drops pairs that are far apart; the others name the two blocks that they lie in, so that a group
of vectors that are all alike makes a few rows for each, not one for each pair. Vectors of equal pairs of blocks meet
once more, where every pair is verified in double precision; what leaves a meeting are counts and a spanning forest of
its links.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C
from . import _pairs as P

THRESHOLD, TABLES, PROBES, PER_BUCKET = 0.95, 12, 6, 64
#: Bits of a sketch, and the most that a pair's sketches may differ in: at a cosine of 0.95 they differ in 26 on
#: average, with a standard deviation of 4.8.
SKETCH_BITS, MOST_APART = 256, 56
#: Vectors of a block.
LINK_BLOCK = 1024
_SEED = 7_919


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows; their length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.concatenate((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(n, d)
        h *= 2
    return x


def rotated(x: np.ndarray, draw: np.random.Generator) -> np.ndarray:
    """Three rounds of random signs and a Hadamard transform."""
    for _ in range(3):
        x = hadamard(x * draw.choice((-1.0, 1.0), x.shape[1]))
    return x


def probe(x: np.ndarray, hashes: int, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """Of rotated rows for each hash (hashes, n, d): bucket codes (n, probes), best first, and their worth."""
    codes = worth = None
    for turned in x:
        size = np.abs(turned)
        top = min(probes, size.shape[1])
        near = np.argpartition(-size, top - 1, axis=1)[:, :top] if top < size.shape[1] else np.tile(np.arange(size.shape[1]), (len(size), 1))
        value = np.take_along_axis(size, near, 1)
        code = (2 * near + (np.take_along_axis(turned, near, 1) < 0)).astype(np.uint64)
        if codes is None:
            codes, worth = code, value
        else:
            codes = (codes[:, :, None] * np.uint64(2 * turned.shape[1]) + code[:, None, :]).reshape(len(code), -1)
            worth = (worth[:, :, None] + value[:, None, :]).reshape(len(code), -1)
        keep = np.argsort(-worth, axis=1, kind="stable")[:, :probes]
        codes, worth = np.take_along_axis(codes, keep, 1), np.take_along_axis(worth, keep, 1)
    return codes, worth


def hashes_for(classes: int, dimensions: int, per_bucket: int = PER_BUCKET) -> int:
    return max(1, math.ceil(math.log(max(2, classes / per_bucket)) / math.log(2 * dimensions)))


def _padded(vectors: list[np.ndarray]) -> np.ndarray:
    d = 1 << max(0, (len(vectors[0]) - 1).bit_length())
    out = np.zeros((len(vectors), d))
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids, a digest and the packed doubles of each vector; null where it can link with nothing."""
    import xxhash

    for batch in batches:
        digests, packed = [], []
        for v in batch.column(1):
            value = np.array(v.values, float) if v.is_valid else np.empty(0)
            value = value + 0.0  # one zero
            good = len(value) and np.isfinite(value).all() and (top := np.abs(value).max()) > 0
            if good and not 1e-100 < top < 1e100:
                value = value / top  # squares stay in range
            raw = value.tobytes() if good else None
            packed.append(raw)
            digests.append(xxhash.xxh3_128_digest(raw) if good else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(packed, pa.binary())], names=["id", "digest", "vector"])


def _coder(classes: int, tables: int, probes: int, per_bucket: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, raw = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            sizes = np.array([len(r) // 8 for r in raw])
            for size in np.unique(sizes):  # vectors of different lengths never meet
                mine = np.flatnonzero(sizes == size)
                for a in range(0, len(mine), 2048):
                    rows = mine[a : a + 2048]
                    x = _padded([np.frombuffer(raw[k]) for k in rows])
                    d = x.shape[1]
                    hashes = hashes_for(classes, d, per_bucket)
                    bits = np.concatenate([rotated(x, np.random.default_rng((_SEED, 1, k))) for k in range(-(-SKETCH_BITS // d))], axis=1)[:, :SKETCH_BITS] > 0
                    sketch = np.packbits(bits, axis=1)
                    buckets = []
                    for t in range(tables):
                        turned = np.stack([rotated(x, np.random.default_rng((_SEED, 2, t, h))) for h in range(hashes)])
                        codes, _ = probe(turned, hashes, probes)
                        buckets.append(C.mix(codes * np.uint64(2 * tables + 1) + np.uint64((t + int(size) * C.BASE) % (1 << 64))))
                    found = np.concatenate(buckets, axis=1).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array([s.tobytes() for s in sketch], pa.binary()), pa.array(found.tolist(), pa.list_(pa.int64()))], names=["node", "sketch", "buckets"])

    return run


def _linker(threshold: float) -> Callable[[], Callable[[list], np.ndarray]]:
    def linked(vectors: list) -> np.ndarray:
        out = np.zeros((len(vectors), len(vectors)), bool)
        sizes = np.array([len(v) for v in vectors])
        for size in np.unique(sizes):  # vectors of different lengths never link
            mine = np.flatnonzero(sizes == size)
            x = np.stack([np.frombuffer(vectors[k]) for k in mine])
            norm = np.sqrt(np.einsum("ij,ij->i", x, x))
            links = x @ x.T >= threshold * norm[:, None] * norm[None, :]
            out[np.ix_(mine, mine)] = links | links.T
        return out

    return lambda: linked


def embedding_links(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """One row per input row: id_col, n_links (other rows with a cosine of `threshold` or more), component_id
    (smallest id reachable by links, itself included) and kept (id = component_id).

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing; so do vectors of
    different lengths with each other. A row with a null id has no links and is kept. Equal vectors link, repeated
    rows too. Ids may be of any type that has an order. Other columns of df, however named, play no part. An empty
    table gives an empty result. Pairs below the threshold never link; of those above it the tables miss a few in a
    million.
    """
    kind = df.schema[id_col].dataType.simpleString()
    slim = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    read = C.checkpointed(slim.mapInArrow(_reader, f"id {kind}, digest binary, vector binary"))
    classes = read.where("id is not null and digest is not null").groupBy("digest").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.any_value("vector").alias("vector"))
    classes = C.checkpointed(classes.withColumn("node", F.monotonically_increasing_id()).withColumn("first_row", F.col("node")))
    total = classes.count()
    coded = C.checkpointed(classes.select("node", "vector").mapInArrow(_coder(total, tables, probes, PER_BUCKET), "node long, sketch binary, buckets array<long>"))
    # a vector's best bucket of the first table is its cell
    nodes = P.in_blocks(coded.withColumn("cell", F.get("buckets", F.lit(0))), "cell", F.ceil(F.count("*") / LINK_BLOCK))
    entries = nodes.select("node", "block", "sketch", F.explode("buckets").alias("bucket"))
    met = P.meeting(entries, lambda x, y: np.bitwise_count(x.view(np.uint64) ^ y.view(np.uint64)).sum(1, dtype=np.int64) <= MOST_APART, C.partitions_for(df, total * tables * probes, 500_000))
    placed = met.join(nodes.select("node", "block"), "node").join(classes.select("node", "copies", F.col("vector").alias("value")), "node")
    found = P.verified(placed, _linker(threshold), C.partitions_for(df, met.count(), 100_000))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = classes.select("digest", "node", "id", "copies").join(counts, "node", "left").join(P.members_of(found, classes), "node", "left")
    known = known.select("digest", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    # the second key makes Spark deal both sides anew, so that it can split a vector with very many copies
    digest = F.when(F.col("id").isNotNull(), F.col("digest"))
    out = read.select("id", digest.alias("digest"), F.xxhash64(digest).alias("key")).join(known.withColumn("key", F.xxhash64("digest")), ["key", "digest"], "left")
    out = out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(f"`{id_col}`") == F.col("component_id"), F.lit(True)))


def op6_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links(C.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


#: All pairs of vectors, in double precision; components by recursion.
SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings
), good AS (
  SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND n > 0
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM good a JOIN good b ON a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) >= 0.95 * a.n * b.n
), reach AS (
  SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y
)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM (SELECT x AS vec_id, min(y) AS component_id FROM reach GROUP BY x) LEFT JOIN (SELECT x AS vec_id, count(*) AS n FROM links GROUP BY x) USING (vec_id)
"""
