"""N-gram Jaccard join: MinHash banding with band and row counts chosen for a target recall, a shuffle on band
hashes, and pairs verified on full n-gram sets.

Documents with the same words are one class; only a class's smallest document goes on. Documents that share a band
hash meet as sketches, a byte of each permutation; pairs whose sketches are near name the two blocks that they lie
in, and documents of equal pairs of blocks meet once more, where every pair is verified on its whole n-gram sets.
What leaves a meeting are counts and a spanning forest of its links.
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

N_GRAM, THRESHOLD, RECALL, MAX_PERMUTATIONS = 5, 0.8, 0.9999, 128
#: Documents and characters of one block.
BLOCK_DOCS, BLOCK_CHARS = 512, 6_000_000
OUTPUTS = ("class_id", "n_links", "component_id", "kept")


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MAX_PERMUTATIONS) -> tuple[int, int]:
    """(bands, rows): the most rows, so the fewest false candidates, with which a pair at the threshold shares
    a band with probability `recall` and that need no more than `most` permutations."""
    best = None
    for rows in range(1, most + 1):
        p = threshold**rows
        bands = 1 if p >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - p))
        if bands * rows <= most:
            best = (bands, rows)
    if best is None:
        raise ValueError("no bands reach this recall with so few permutations")
    return best


def shingles(text: str, n: int, words: C.WordHashes, rolling: C.Rolling) -> np.ndarray:
    """Sorted distinct hashes of n lower-cased words in a row; a shorter text is one n-gram, an empty one none."""
    found = text.lower().encode("utf-8", "surrogatepass").split()
    if not found:
        return np.empty(0, np.uint64)
    if len(found) < n:
        return C.mix(words.array(found) * C.powers(C.BASE, len(found))).sum(keepdims=True, dtype=np.uint64)
    return np.unique(rolling(words.array(found)))


def _signer(n: int, bands: int, rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        words, rolling = C.WordHashes(), C.Rolling(n)
        draw = np.random.default_rng(20_240_501)
        times = draw.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        plus = draw.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
        weights = draw.integers(0, 1 << 63, (bands, rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        own = draw.integers(0, 1 << 63, bands, dtype=np.uint64)
        for batch in batches:
            digests, chars, sketches, signed = [], [], [], []
            for text in batch.column(3):
                text = text.as_py() or ""
                got = shingles(text, n, words, rolling)
                chars.append(len(text))
                digests.append(xxhash.xxh3_128_digest(b" ".join(text.lower().encode("utf-8", "surrogatepass").split())) if len(got) else None)
                if not len(got):
                    sketches.append(None)
                    signed.append([])
                    continue
                least = np.full(bands * rows, np.uint64(0xFFFFFFFFFFFFFFFF))
                for at in range(0, len(got), 4096):
                    least = np.minimum(least, (times[:, None] * got[None, at : at + 4096] + plus[:, None]).min(1))
                sketches.append((C.mix(least) & np.uint64(255)).astype(np.uint8).tobytes())
                signed.append(C.mix((C.mix(least).reshape(bands, rows) * weights).sum(1, dtype=np.uint64) + own).view(np.int64).tolist())
            made = [pa.array(digests, pa.binary()), pa.array(chars, pa.int64()), pa.array(sketches, pa.binary()), pa.array(signed, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *made], names=["row", "id", "hash", "digest", "chars", "sketch", "bands"])

    return run


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets, from products of incidence matrices of bounded width."""
    m = len(sets)
    items = np.concatenate(sets)
    row = np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(items, kind="stable")
    items, row = items[order], row[order]
    new = np.concatenate(([True], items[1:] != items[:-1])) if len(items) else np.empty(0, bool)
    size = np.diff(np.append(np.flatnonzero(new), len(items)))
    shared = np.repeat(size > 1, size)
    column, row = (np.cumsum(new) - 1)[shared], row[shared]
    out = np.zeros((m, m), np.float64)
    if not len(column):
        return out
    column = np.cumsum(np.concatenate(([False], column[1:] != column[:-1])))
    width = max(256, min(4096, 4_000_000 // m))
    cuts = np.append(np.searchsorted(column, np.arange(0, column[-1] + 1, width)), len(column))
    for k in range(len(cuts) - 1):
        a, b = cuts[k], cuts[k + 1]
        if a < b:
            table = np.zeros((m, min(width, int(column[b - 1]) - k * width + 1)), np.float32)
            table[row[a:b], column[a:b] - k * width] = 1
            out += table @ table.T
    return out


def linker(n: int, threshold: float) -> Callable[[], Callable[[list], np.ndarray]]:
    def make() -> Callable[[list], np.ndarray]:
        words, rolling = C.WordHashes(), C.Rolling(n)

        def linked(texts: list) -> np.ndarray:
            sets = [shingles(t or "", n, words, rolling) for t in texts]
            size = np.array([len(s) for s in sets], np.float64)
            both = shared_counts(sets)
            return (both > 0) & (both >= threshold * (size[:, None] + size[None, :] - both) - 1e-9)

        return linked

    return make


def _nearness(threshold: float, permutations: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Sketches are one byte of each permutation's least value. Those of a pair at the threshold agree in t * p of p
    on average; the cut is six standard deviations below."""
    cut = threshold * permutations - 6 * math.sqrt(permutations * threshold * (1 - threshold))
    return lambda x, y: (x == y).sum(1) >= cut


def _signed(df: DataFrame, id_col: str, text_col: str, n: int, bands: int, rows: int) -> DataFrame:
    """(row, id, hash, digest, chars, sketch, bands) of every row, checkpointed; id and hash name a row's text."""
    text = F.col(f"`{text_col}`").cast("string")
    slim = df.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"), F.xxhash64(C.text_or_empty(text)).alias("hash"), text.alias("text"))
    kind = df.schema[id_col].dataType.simpleString()
    return C.checkpointed(slim.mapInArrow(_signer(n, bands, rows), f"row long, id {kind}, hash long, digest binary, chars long, sketch binary, bands array<long>"))


def _judged(df: DataFrame, id_col: str, text_col: str, n: int, threshold: float, recall: float) -> DataFrame:
    """(row, id, hash, class_id, n_links, component_id, kept) of every row."""
    bands, rows = bands_for(threshold, recall)
    signed = _signed(df, id_col, text_col, n, bands, rows)
    whole = signed.where("id is not null and digest is not null")
    least = F.min_by(F.struct("id", F.col("row").alias("first_row"), "hash", "chars", "sketch", "bands"), F.struct("id", "row"))
    classes = whole.groupBy("digest").agg(least.alias("r"), F.count("*").alias("copies")).select("digest", "r.*", "copies")
    classes = C.checkpointed(classes.withColumn("node", F.monotonically_increasing_id()))

    # rows whose least neighbour over all buckets is one lie in one block, as near copies mostly do
    banded = classes.select("node", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.min("node").alias("leader"), F.count("*").alias("n")).where("n > 1").withColumn("key", F.xxhash64("bucket"))
    entries = C.checkpointed(banded.withColumn("key", F.xxhash64("bucket")).join(shared, ["key", "bucket"]).select("node", "bucket", "leader"))
    cells = entries.groupBy("node").agg(F.min("leader").alias("cell")).join(classes.select("node", "chars", "sketch"), "node")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("chars") / BLOCK_CHARS))
    nodes = P.in_blocks(cells, "cell", blocks).select("node", "block", "sketch")
    met = P.meeting(entries.select("node", "bucket").join(nodes, "node"), _nearness(threshold, bands * rows), C.partitions_for(df, entries.count(), 500_000))

    text = F.col(f"`{text_col}`").cast("string")
    texts = df.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(C.text_or_empty(text)).alias("hash"), text.alias("value"))
    # of rows that share id and text, each meeting takes one
    placed = met.join(nodes.select("node", "block"), "node").join(classes.select("node", "id", "hash", "copies"), "node")
    found = P.verified(texts.join(placed, ["id", "hash"]), linker(n, threshold), C.partitions_for(df, met.count(), 20_000))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = classes.join(links, "node", "left").join(P.members_of(found, classes), "node", "left").select(
        "digest",
        F.col("id").alias("class_id"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
        F.coalesce("keeper", "first_row").alias("keeper"),
    )
    # the second key makes Spark deal both sides anew, so that it can split a class with very many copies
    digest = F.when(F.col("id").isNotNull(), F.col("digest"))
    out = signed.select("row", "id", "hash", digest.alias("digest"), F.xxhash64(digest).alias("key")).join(known.withColumn("key", F.xxhash64("digest")), ["key", "digest"], "left")
    return out.select(
        "row",
        "id",
        "hash",
        F.coalesce("class_id", "id").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
        F.coalesce(F.col("row") == F.col("keeper"), F.lit(True)).alias("kept"),
    )


def jaccard_join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N_GRAM, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per input row: id_col, class_id (smallest id with the same words), n_links (other rows whose n-gram
    Jaccard similarity is `threshold` or more, copies included), component_id (smallest id reachable by links)
    and kept (true for one row of each component: the row of the smallest id, of repeated ones the first).

    N-grams are n lower-cased words in a row. A text of fewer words is one n-gram of all of them; texts of any length
    are read whole. A null or empty text has no n-grams and links with nothing; a null id gets null class and
    component; both are kept. A repeated row counts as a copy. Rows that share an id but not a text are told apart.
    Ids may be of any type that has an order. Other columns of df, however named, play no part. An empty table gives
    an empty result. A pair at the threshold is found with probability `recall`, others with more.
    """
    judged = _judged(df, id_col, text_col, n, threshold, recall)
    return judged.select(F.col("id").alias(id_col), *OUTPUTS)


def without_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N_GRAM, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """The rows of df that jaccard_join() keeps, with df's own columns. Rows that share an id go or stay by their own
    text; of rows that share id and text one stays."""
    names = (C.free_name(df.columns, "id"), C.free_name(df.columns, "hash"))
    judged = _judged(df, id_col, text_col, n, threshold, recall).where("id is not null").groupBy("id", "hash").agg(F.count("*").alias("rows"), F.sum(F.col("kept").cast("long")).alias("stay"))
    judged = C.checkpointed(judged.where("stay < rows").select(F.col("id").alias(names[0]), F.col("hash").alias(names[1]), "stay"))
    keyed = df.withColumn(names[0], F.col(f"`{id_col}`")).withColumn(names[1], F.xxhash64(C.text_or_empty(F.col(f"`{text_col}`"))))
    own = [F.col(f"`{c}`") for c in df.columns]
    stay = keyed.join(judged.drop("stay"), list(names), "left_anti").select(*own)
    again = judged.where("stay > 0").drop("stay")
    if again.isEmpty():
        return stay
    return stay.unionByName(keyed.join(again, list(names)).dropDuplicates(list(names)).select(*own))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(C.table(spark, sf_dir, "documents").select("doc_id", "text"))


#: All pairs that share a 5-gram, exactly; components by recursion.
SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), classes AS (
  SELECT doc_id, w, CASE WHEN len(w) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY array_to_string(w, ' ')) END AS class_id FROM words
), reps AS (
  SELECT class_id, any_value(w) AS w, count(*) AS copies FROM classes WHERE len(w) > 0 GROUP BY class_id
), grams AS (
  SELECT DISTINCT class_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM reps
), sizes AS (
  SELECT class_id, count(*) AS n FROM grams GROUP BY class_id
), shared AS (
  SELECT a.class_id AS x, b.class_id AS y, count(*) AS common FROM grams a JOIN grams b ON a.g = b.g AND a.class_id <> b.class_id GROUP BY ALL
), links AS (
  SELECT x, y FROM shared JOIN sizes s ON s.class_id = x JOIN sizes t ON t.class_id = y WHERE common >= 0.8 * (s.n + t.n - common) - 1e-9
), reach AS (
  SELECT class_id AS x, class_id AS y FROM reps UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y
), comps AS (
  SELECT x, min(y) AS component_id FROM reach GROUP BY x
), counts AS (
  SELECT x, sum(copies) AS n FROM links JOIN reps ON reps.class_id = y GROUP BY x
)
SELECT c.doc_id, c.class_id, (coalesce(n, 0) + coalesce(copies, 1) - 1)::BIGINT AS n_links, coalesce(component_id, c.class_id) AS component_id, c.doc_id = coalesce(component_id, c.class_id) AS kept
FROM classes c LEFT JOIN reps r ON r.class_id = c.class_id LEFT JOIN comps ON comps.x = c.class_id LEFT JOIN counts k ON k.x = c.class_id
"""
