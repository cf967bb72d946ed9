"""Substring dedup: Rabin-Karp hashes of every window of n words, counted in Spark; repeated windows merge
into maximal removal intervals.

1. Every task reads documents in chunks of about half a million words and hashes all windows at once. Windows
   that repeat inside the chunk are settled there; of each window hash, the chunk's first start goes on, as
   packed arrays, to the partition that owns the hash. A window that a third of all documents hold costs one
   entry a chunk, not one a document.
2. The owner of a hash keeps its smallest document and names the hash to all others.
3. The documents meet their hashes by bundles of ids, hash their windows again and cut the union of the
   repeated ones.

A window has two hashes of 64 bits each, of two bases: one chooses the range, the other names the window in it, so
that two windows are taken for each other with a chance of the windows of one range in 2**64, however many ranges
there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _common as C

WINDOW = 20
#: Words that a task holds at once, and windows that one range of hashes holds. Ranges and bundles of documents grow
#: with the input; a task works on them one after the other, so its memory is that of one, and there are at most so
#: many tasks (or the session's shuffle partitions, if more).
CHUNK_WORDS, RANGE_WINDOWS, MOST_TASKS = 500_000, 1_500_000, 20_000
#: Hashes that a task of many ranges takes apart at once.
REGROUP = 4_000_000
OUTPUTS = ("n_words", "n_removed", "kept_text", "removed_spans")


def _runs(covered: np.ndarray) -> list[tuple[int, int]]:
    """Maximal intervals [start, end) of covered words."""
    if not covered.any():
        return []
    edges = np.flatnonzero(np.diff(np.concatenate(([False], covered, [False])).astype(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


#: Packed rows: of a task or range the ids of documents, how many items each has, and the items.
_PACKED = pa.schema([("part", pa.int64()), ("ids", pa.binary()), ("counts", pa.binary()), ("items", pa.binary()), ("settled", pa.bool_())])


def _counter(n: int, parts: int, tasks: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    schema = _PACKED

    def chunk(docs: list[tuple[int, np.ndarray]], rolling: C.Rolling, ranging: C.Rolling) -> pa.RecordBatch | None:
        docs.sort(key=lambda x: x[0])
        sizes = np.array([len(x) for _, x in docs])
        words = np.concatenate([x for _, x in docs])
        hashes = rolling(words)
        row = np.repeat(np.arange(len(docs)), sizes)[: len(hashes)]
        start = np.arange(len(hashes)) - (np.cumsum(sizes) - sizes)[row]
        inside = np.flatnonzero(start + n <= sizes[row])
        if not len(inside):
            return None
        hashes, row, start = hashes[inside], row[inside], start[inside]
        ids = np.array([i for i, _ in docs], np.int64)
        rank = np.concatenate(([0], np.cumsum(ids[1:] != ids[:-1])))  # rows that share an id are one document
        place = (rank[row].astype(np.uint64) << np.uint64(32)) | start.astype(np.uint64)
        order = np.argsort(hashes, kind="stable")
        new = np.concatenate(([True], hashes[order][1:] != hashes[order][:-1]))
        group = np.cumsum(new) - 1
        least = np.minimum.reduceat(place[order], np.flatnonzero(new))[group]
        repeated = np.empty(len(order), bool)
        repeated[order] = place[order] > least
        first = np.empty(len(order), bool)
        first[order] = new
        columns: list[list] = [[], [], [], [], []]

        def put(part: int, rows: np.ndarray, items: np.ndarray, settled: bool) -> None:
            own, counts = np.unique(rows, return_counts=True)
            for column, value in zip(columns, (part, ids[own].tobytes(), counts.astype(np.int32).tobytes(), items.tobytes(), settled), strict=True):
                column.append(value)

        go = np.flatnonzero(first)
        part = (ranging(words)[inside][go] % np.uint64(parts)).astype(np.int64)
        task = part % tasks
        by = np.argsort(task, kind="stable")  # keeps the order of rows inside each task
        ends = np.append(np.flatnonzero(np.concatenate(([True], task[by][1:] != task[by][:-1]))), len(by))
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            mine = by[a:b]
            put(int(task[mine[0]]), row[go[mine]], hashes[go[mine]] if parts == tasks else np.stack((hashes[go[mine]], part[mine].astype(np.uint64)), 1), False)
        if repeated.any():
            mine = np.flatnonzero(repeated)
            step = (np.diff(row[mine]) != 0) | (np.diff(start[mine]) > n)
            opens, closes = np.concatenate(([0], np.flatnonzero(step) + 1)), np.concatenate((np.flatnonzero(step), [len(mine) - 1]))
            spans = np.stack((start[mine][opens], start[mine][closes] + n), 1).astype(np.int32)
            put(int(ids[0] % tasks), row[mine][opens], spans, True)
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, rolling, ranging, docs, held = C.WordHashes(), C.Rolling(n), C.Rolling(n, C.OTHER_BASE), [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                found = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                if doc.is_valid and len(found) >= n:
                    docs.append((doc.as_py(), words.array(found)))
                    held += len(found)
                if held >= CHUNK_WORDS:
                    if (out := chunk(docs, rolling, ranging)) is not None:
                        yield out
                    docs, held = [], 0
        if docs and (out := chunk(docs, rolling, ranging)) is not None:
            yield out

    return run


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where a task has many ranges: takes its hashes apart by range, REGROUP at a time, so that neither the chunks
    nor this task make a row for each hash."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def out() -> Iterator[pa.RecordBatch]:
        ids, items = (np.concatenate([x[k] for x in held]) for k in (0, 1))
        held.clear()
        order = np.lexsort((ids, items[:, 1]))
        ids, items = ids[order], items[order]
        edges = np.append(np.flatnonzero(np.concatenate(([True], items[1:, 1] != items[:-1, 1]))), len(ids)).tolist()
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            own, counts = np.unique(ids[a:b], return_counts=True)
            row = (int(items[a, 1]), own.tobytes(), counts.astype(np.int32).tobytes(), items[a:b, 0].tobytes(), False)
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _PACKED, strict=True)], schema=_PACKED)

    for batch in batches:
        rest = [k for k, settled in enumerate(batch.column(4).to_pylist()) if settled]
        if rest:
            yield batch.take(pa.array(rest)).cast(_PACKED)
        for _, ids, counts, items, settled in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not settled:
                held.append((np.repeat(np.frombuffer(ids, np.int64), np.frombuffer(counts, np.int32)), np.frombuffer(items, np.uint64).reshape(-1, 2)))
                size += len(held[-1][0])
        if size >= REGROUP:
            yield from out()
            size = 0
    if held:
        yield from out()


def _owner(bundles: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Ranges of hashes, one after the other: names to each document the hashes that a smaller document holds.
    Documents are addressed in bundles, so that a document costs no row for each range that has found something."""
    schema = _PACKED

    def rows(ids: np.ndarray, items: np.ndarray, settled: bool) -> Iterator[pa.RecordBatch]:
        if not len(ids):
            return
        order = np.lexsort((ids, ids % bundles))
        ids, items = ids[order], items[order]
        bundle = ids % bundles
        edges = np.flatnonzero(np.concatenate(([True], bundle[1:] != bundle[:-1], [True])))
        columns: list[list] = [[], [], [], [], []]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            own, counts = np.unique(ids[a:b], return_counts=True)
            for column, value in zip(columns, (int(bundle[a]), own.tobytes(), counts.astype(np.int32).tobytes(), items[a:b].tobytes(), settled), strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)

    def settle(all_ids: list[np.ndarray], all_hashes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if not all_ids:
            return
        hashes = np.concatenate(all_hashes)
        all_hashes.clear()
        order = np.argsort(hashes, kind="stable")
        hashes, ids = hashes[order], np.concatenate(all_ids)[order]
        all_ids.clear()
        del order
        new = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
        later = np.flatnonzero(ids > np.repeat(np.minimum.reduceat(ids, new), np.diff(np.append(new, len(ids)))))
        yield from rows(ids[later], hashes[later], False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_ids, all_hashes, now = [], [], None
        for batch in batches:
            for part, ids, counts, items, settled in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if part != now:
                    yield from settle(all_ids, all_hashes)
                    now = part
                owner = np.repeat(np.frombuffer(ids, np.int64), np.frombuffer(counts, np.int32))
                if settled:
                    yield from rows(owner, np.frombuffer(items, np.int32).reshape(-1, 2), True)
                else:
                    all_ids.append(owner)
                    all_hashes.append(np.frombuffer(items, np.uint64))
        yield from settle(all_ids, all_hashes)

    return run


class _Named:
    """What the owners have named to the documents of one bundle."""

    def __init__(self, kind: type, width: int):
        self.kind, self.width, self.ids, self.items = kind, width, [], []

    def add(self, ids: bytes, counts: bytes, items: bytes) -> None:
        self.ids.append(np.repeat(np.frombuffer(ids, np.int64), np.frombuffer(counts, np.int32)))
        self.items.append(np.frombuffer(items, self.kind).reshape(-1, self.width))

    def close(self) -> None:
        ids = np.concatenate([np.empty(0, np.int64), *self.ids])
        items = np.concatenate([np.empty((0, self.width), self.kind), *self.items])
        order = np.argsort(ids, kind="stable")
        self.ids, self.items = ids[order], items[order]

    def of(self, doc: int | None) -> np.ndarray:
        if doc is None:
            return self.items[:0]
        a, b = np.searchsorted(self.ids, [doc, doc + 1])
        return self.items[a:b]


def _cutter(n: int, id_at: str, text_at: str, names: list[str], schema: pa.Schema, lines: bool, own: dict[str, str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    import re

    word = re.compile(rb"[^\x20\x09-\x0D]+")

    def cut_lines(raw: bytes, gone: np.ndarray) -> str:
        """The text without the words that go, and with the white space before each word that stays."""
        out, at = [], 0
        for k, m in enumerate(word.finditer(raw)):
            if not gone[k]:
                out.append(raw[at : m.end()])
            at = m.end()
        return b"".join(out).decode("utf-8", "surrogatepass").strip(" \t\n\r\v\f")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, rolling, named, settled = C.WordHashes(), C.Rolling(n), _Named(np.uint64, 1), _Named(np.int32, 2)
        now, closed = None, False
        for batch in (whole.slice(k, 1000) for whole in batches for k in range(0, whole.num_rows, 1000)):
            at = lambda name, batch=batch: batch.column(batch.schema.get_field_index(name))
            n_words, n_removed, kept, spans = [], [], [], []
            documents = []
            for k, (bundle, document) in enumerate(zip(at(own["bundle"]).to_pylist(), at(own["document"]).to_pylist(), strict=True)):
                if bundle != now:
                    named, settled, now, closed = _Named(np.uint64, 1), _Named(np.int32, 2), bundle, False
                if not document:  # what is named to a bundle comes before its documents
                    (settled if at(own["settled"])[k].as_py() else named).add(*(at(own[x])[k].as_py() for x in ("ids", "counts", "items")))
                    continue
                if not closed:
                    named.close()
                    settled.close()
                    closed = True
                documents.append(k)
                doc, text = at(id_at)[k].cast(pa.int64()).as_py(), at(text_at)[k]
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                found = raw.split()
                cover = np.zeros(len(found) + 1, np.int64)
                if len(found) >= n:
                    if len(hashes := named.of(doc)):
                        starts = np.flatnonzero(np.isin(rolling(words.array(found)), hashes))
                        cover[starts] += 1
                        cover[starts + n] -= 1
                    pairs = settled.of(doc)
                    pairs = pairs[pairs[:, 1] <= len(found)]
                    np.add.at(cover, pairs[:, 0], 1)
                    np.add.at(cover, pairs[:, 1], -1)
                covered = np.cumsum(cover)[:-1] > 0
                n_words.append(len(found))
                n_removed.append(int(covered.sum()))
                if not n_removed[-1]:
                    kept.append((text.as_py() or "") if lines else b" ".join(found).decode("utf-8", "surrogatepass"))
                elif lines:
                    kept.append(cut_lines(raw, covered))
                else:
                    kept.append(b" ".join([w for w, x in zip(found, covered.tolist(), strict=True) if not x]).decode("utf-8", "surrogatepass"))
                spans.append([{"start": a, "end": b} for a, b in _runs(covered)])
            if not documents:
                continue
            kept_columns = [at(x).take(pa.array(documents)) for x in names]
            made = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, schema.field("removed_spans").type)]
            yield pa.RecordBatch.from_arrays([*kept_columns, *made], names=schema.names)

    return run


def _prime(most: int) -> int:
    """The largest prime up to `most`, 2 at least: ids of any stride spread evenly over so many bundles."""
    while most > 2 and any(most % k == 0 for k in range(2, int(most**0.5) + 1)):
        most -= 1
    return max(2, most)


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, keep_white_space: bool = False) -> DataFrame:
    """The rows of df with n_words, n_removed, kept_text and removed_spans (intervals of words, end exclusive).

    A word goes if a window of `window` words that covers it also starts earlier: in a document of a smaller
    id, or in the same document further left. Ids are integers. kept_text joins the kept words by one space, or
    with keep_white_space leaves the text's own white space (a text that loses nothing stays as it is).
    A null text counts as empty. A row with a null id has no place in the order: it loses nothing and nothing
    is removed because of it. Rows with one id are one document and don't remove each other's equal starts, so
    repeated rows keep the same words. Texts of any length are read whole. An empty table gives an empty result.
    Input columns named like an output are replaced; other columns stay, however named.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    df = C.without(df, OUTPUTS)
    slim = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    chars = slim.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = C.partitions_for(df, chars / 6, RANGE_WINDOWS)
    tasks = min(parts, C.partitions_for(df, MOST_TASKS, 1))
    bundles = _prime(parts)
    packed = "part long, ids binary, counts binary, items binary, settled boolean"
    counted = slim.mapInArrow(_counter(window, parts, tasks), packed).repartitionById(tasks, F.pmod("part", F.lit(tasks)).cast("int"))
    ranges = counted if parts == tasks else counted.mapInArrow(_ranges, packed)
    named = ranges.sortWithinPartitions("part").mapInArrow(_owner(bundles), packed)
    own = {x: C.free_name(df.columns, x) for x in ("bundle", "document", "ids", "counts", "items", "settled")}
    named = named.select(F.col("part").alias(own["bundle"]), *[F.col(x).alias(own[x]) for x in ("ids", "counts", "items", "settled")], F.lit(False).alias(own["document"]))
    docs = df.withColumn(own["bundle"], F.coalesce(F.pmod(F.col(f"`{id_col}`").cast("long"), F.lit(bundles)), F.lit(0)).cast("long")).withColumn(own["document"], F.lit(True))
    both = named.unionByName(docs, allowMissingColumns=True)
    both = both.repartitionById(tasks, F.pmod(own["bundle"], F.lit(tasks)).cast("int")).sortWithinPartitions(own["bundle"], own["document"])
    added = [
        C.field("n_words", T.LongType()),
        C.field("n_removed", T.LongType()),
        C.field("kept_text", T.StringType()),
        C.field("removed_spans", T.ArrayType(T.StructType([C.field("start", T.IntegerType()), C.field("end", T.IntegerType())]))),
    ]
    out = T.StructType([*df.schema.fields, *added])
    return both.mapInArrow(_cutter(window, id_col, text_col, df.columns, to_arrow_schema(out), keep_white_space, own), out)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


#: Every window of every document; a window goes if the same words start earlier.
SQL = """
WITH words AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos, len(w) AS n
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents)
), windows AS (
  SELECT doc_id, pos, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS win
  FROM words QUALIFY count(*) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) = 20
), ranked AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) > 1 AS again FROM windows
), marked AS (
  SELECT w.doc_id, w.pos, w.word, coalesce(max(CASE WHEN r.again THEN 1 ELSE 0 END) OVER (PARTITION BY w.doc_id ORDER BY w.pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 0) AS gone
  FROM words w LEFT JOIN ranked r USING (doc_id, pos)
), per AS (
  SELECT doc_id, count(*) AS n_words, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (gone = 0) AS kept FROM marked GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN per USING (doc_id)
"""
