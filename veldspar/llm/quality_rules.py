"""Quality rules: cross-document line frequency. Normalised lines are hashed, distinct documents are counted per
host and line, lines above the limits go, and documents that lose most of their words are rejected.

Distinct documents are distinct texts: copies of one text are one document here. Counted by ids, a text that is
copied often would make boilerplate of all its own lines, and the one copy that should stay would be rejected too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _common as C

MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT_WINDOW = 50, 50, 3
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
#: A line is frequent if this many documents of a host have it, and more than this share of the host's documents; the
#: share makes the rule behave alike in a host of a thousand documents and in one of a thousand million.
LINE_DOCS, LINE_SHARE = 20, 0.05
#: A document is depleted if less than this percentage of its words is left.
LEFT_PERCENT = 30
LINE_OUTPUTS = ("kept_text", "removed_lines")
_DIGITS = {ord(c): "0" for c in "123456789"}
FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, digest long, lines array<struct<hash:long,words:long>>"


def _line_key(line: str) -> bytes:
    """Lower-cased words by one space each, with all digits alike."""
    return b" ".join(line.lower().translate(_DIGITS).encode("utf-8", "surrogatepass").split())


def repeated_words(hashes: np.ndarray, n: int) -> int:
    """Words under windows of n hashes that stand twice or more."""
    size = len(hashes) + n - 1
    order = np.argsort(hashes, kind="stable")
    again = hashes[order][1:] == hashes[order][:-1]
    if not again.any():
        return 0
    flags = np.zeros(len(hashes), bool)
    flags[order[1:][again]] = True
    flags[order[:-1][again]] = True
    cover = np.zeros(size, bool)
    for k in range(n):
        cover[k : k + len(hashes)] |= flags
    return int(cover.sum())


def _features(window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    lines_type = pa.list_(pa.struct([("hash", pa.int64()), ("words", pa.int64())]))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        signed = lambda x: x - (1 << 64) if x >> 63 else x
        words, rolling = C.WordHashes(), C.Rolling(window)
        for batch in batches:
            rows: list[tuple] = []
            for text in batch.column(2):
                text = text.as_py() or ""
                found = text.encode("utf-8", "surrogatepass").split()
                kept: dict[int, int] = {}
                seen: set[str] = set()
                dup = 0
                for line in text.split("\n"):
                    key = _line_key(line)
                    if key:
                        dup += line in seen
                        seen.add(line)
                        h = signed(xxhash.xxh64_intdigest(key))
                        kept[h] = kept.get(h, 0) + key.count(b" ") + 1
                rows.append((
                    len(found), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), dup, repeated_words(h, window) if len(h := rolling(words.array(found))) else 0,
                    signed(xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), seed=42)), [{"hash": h, "words": n} for h, n in kept.items()],
                ))
            made = [pa.array([r[i] for r in rows], pa.int64()) for i in range(6)] + [pa.array([r[6] for r in rows], lines_type)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["id", "host", *names, "digest", "lines"])

    return run


def line_features(df: DataFrame, id_col: str, text_col: str, host_col: str | None) -> DataFrame:
    host = F.col(host_col).cast("string") if host_col else F.lit(None).cast("string")
    slim = df.select(F.col(id_col).alias("id"), F.coalesce(host, F.lit("")).alias("host"), F.col(text_col).cast("string").alias("text"))
    kind = df.schema[id_col].dataType.simpleString()
    return slim.mapInArrow(_features(REPEAT_WINDOW), f"id {kind}, host string, {FEATURES}")


def frequent_lines(features: DataFrame, line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE) -> DataFrame:
    """(host, hash): lines that stand in too many distinct texts of a host."""
    lines = features.select("host", "digest", F.explode("lines.hash").alias("hash"))
    counts = lines.groupBy("host", "hash").agg(F.countDistinct("digest").alias("docs")).where(F.col("docs") >= line_docs)
    hosts = features.groupBy("host").agg(F.countDistinct("digest").alias("all_docs"))
    return counts.join(hosts, "host").where(F.col("docs") > line_share * F.col("all_docs")).select("host", "hash")


def _judged(features: DataFrame, line_docs: int, line_share: float, left_percent: int) -> DataFrame:
    """Features of rows, checkpointed and numbered by `row`, with n_frequent_words, gone (hashes of the row's frequent
    lines, null if none), base_failed and kept."""
    # the join's own key makes Spark deal both sides anew, so that it can split a line that very many documents have
    frequent = frequent_lines(features, line_docs, line_share).withColumn("key", F.xxhash64("host", "hash"))
    lines = features.select("row", "host", F.explode("lines").alias("line")).select("row", "host", F.col("line.hash").alias("hash"), F.col("line.words").alias("words"))
    met = lines.withColumn("key", F.xxhash64("host", "hash")).join(frequent, ["key", "host", "hash"])
    lost = met.groupBy("row").agg(F.sum("words").alias("lost"), F.collect_list("hash").alias("gone"))
    out = features.drop("lines").join(lost, "row", "left").withColumn("n_frequent_words", F.coalesce("lost", F.lit(0)))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    depleted = 100 * (F.col("n_words") - F.col("n_frequent_words")) < left_percent * F.col("n_words")
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & ~depleted)


def quality_rules(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str | None = "source", line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE, left_percent: int = LEFT_PERCENT
) -> DataFrame:
    """One row per input row: id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    n_frequent_words (words of lines above the limits) and kept.

    A null or empty text has no words, so it fails. Rows with a null host form one host. Repeated rows are one
    text to the line counts and each gets its row. base_failed: fewer than 50 words, or more than half of the
    words repeat. kept is false if base_failed, or if less than left_percent of the words is left. A line is frequent
    if at least line_docs texts and more than line_share of the host's texts hold it. Texts of any length are read
    whole; ids of any type pass through; other columns play no part; an empty table gives an empty result.
    """
    features = C.checkpointed(line_features(df, id_col, text_col, host_col).withColumn("row", F.monotonically_increasing_id()))
    out = _judged(features, line_docs, line_share, left_percent)
    return out.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_frequent_words")


def _remover(text_at: int, gone_at: int, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            texts, removed = batch.column(text_at).to_pylist(), []
            for k, gone in enumerate(batch.column(gone_at)):
                lost: list[str] = []
                if gone.is_valid:
                    hashes, left = {h % (1 << 64) for h in gone.as_py()}, []
                    for line in (texts[k] or "").split("\n"):
                        key = _line_key(line)
                        (lost if key and xxhash.xxh64_intdigest(key) in hashes else left).append(line)
                    texts[k] = "\n".join(left)
                removed.append(lost)
            columns = [c for at, c in enumerate(batch.columns) if at != gone_at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array(removed, pa.list_(pa.string()))], names=[*names, *LINE_OUTPUTS])

    return run


def without_frequent_lines(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str | None = "source", line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE, left_percent: int = LEFT_PERCENT
) -> DataFrame:
    """The rows of df that quality_rules() keeps, with kept_text (the text without the lines above the limits) and
    removed_lines. Input columns named like an output are replaced; other columns stay, however named. Null ids,
    hosts and texts, long texts and repeated rows are treated as by quality_rules().

    The verdict and the lines follow from host and text alone, so rows find them by these and not by their ids.
    """
    df = C.without(df, [x for x in LINE_OUTPUTS if x not in (id_col, text_col, host_col)])
    features = C.checkpointed(line_features(df, id_col, text_col, host_col).withColumn("row", F.monotonically_increasing_id()))
    judged = _judged(features, line_docs, line_share, left_percent).where("kept")
    host, digest, key, gone = (C.free_name(df.columns, x) for x in ("host", "digest", "key", "gone"))
    met = [F.col(x) for x in (host, digest)]
    verdicts = judged.groupBy(F.col("host").alias(host), F.col("digest").alias(digest)).agg(F.any_value("gone").alias(gone)).withColumn(key, F.xxhash64(*met))
    # as in the features: Spark's xxhash64 of one text is XXH64 with a seed of 42
    own = C.text_or_empty(F.col(f"`{host_col}`")) if host_col else F.lit("")
    texts = df.withColumn(host, own).withColumn(digest, F.xxhash64(C.text_or_empty(F.col(f"`{text_col}`")))).withColumn(key, F.xxhash64(*met))
    found = texts.join(verdicts, [key, host, digest]).select(*[F.col(f"`{c}`") for c in df.columns], gone)
    out = T.StructType([*df.schema.fields, C.field("kept_text", T.StringType()), C.field("removed_lines", T.ArrayType(T.StringType()))])
    return found.mapInArrow(_remover(df.columns.index(text_col), len(df.columns), df.columns), out)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(C.table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), lines AS (
  SELECT doc_id, host, t, line, regexp_extract_all(lower(regexp_replace(line, '[1-9]', '0', 'g')), '[^\\x20\\x09-\\x0D]+') AS lw
  FROM (SELECT doc_id, host, t, unnest(string_split(t, chr(10))) AS line FROM d)
), worded AS (
  SELECT doc_id, host, t, line, array_to_string(lw, ' ') AS norm, len(lw) AS n FROM lines WHERE len(lw) > 0
), dups AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM worded GROUP BY doc_id
), hosts AS (
  SELECT host, count(DISTINCT t) AS all_docs FROM d GROUP BY host
), frequent AS (
  SELECT host, norm FROM worded JOIN hosts USING (host) GROUP BY host, norm, all_docs HAVING count(DISTINCT t) >= {LINE_DOCS} AND count(DISTINCT t) > {LINE_SHARE}::DOUBLE * all_docs
), lost AS (
  SELECT doc_id, sum(n) AS lost FROM worded JOIN frequent USING (host, norm) GROUP BY doc_id
), words AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d
), wins AS (
  SELECT doc_id, pos, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS win
  FROM words QUALIFY count(*) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) = 3
), again AS (
  SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, win) > 1 AS rep FROM wins
), covered AS (
  SELECT w.doc_id, max(CASE WHEN rep THEN 1 ELSE 0 END) OVER (PARTITION BY w.doc_id ORDER BY w.pos ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS c
  FROM words w LEFT JOIN again a USING (doc_id, pos)
), reps AS (
  SELECT doc_id, sum(c) AS n FROM covered GROUP BY doc_id
), facts AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(reps.n, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0)::BIGINT AS n_frequent_words
  FROM d LEFT JOIN dups USING (doc_id) LEFT JOIN reps USING (doc_id) LEFT JOIN lost USING (doc_id)
), judged AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM facts
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 100 * (n_words - n_frequent_words) >= {LEFT_PERCENT} * n_words AS kept, n_frequent_words FROM judged
"""
