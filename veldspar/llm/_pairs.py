"""From buckets of rows that may be alike to blocks in which every pair is verified, once.

Rows lie in blocks of bounded size, chosen so that rows that are alike often share one. Buckets don't emit pairs:
of each row that a sketch finds near another they emit the two blocks of that pair. Rows of equal pairs of blocks
meet and are verified on whole values. A pair of rows has one pair of blocks, so its link counts once however many
buckets find it; a group of m rows that are all alike costs m rows a block of the group, a chain of any length costs
a few rows a link, and nothing is verified because a third row lies between.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _common as C

#: Rows of a bucket that are compared at once (a larger bucket is dealt out as pairs of such parts); pairs at once.
BUCKET_ROWS, PAIRS = 4096, 200_000


def in_blocks(nodes: DataFrame, cell: str, blocks: Column) -> DataFrame:
    """nodes (node, cell, ...) with `block`: its cell, cut into as many blocks as the aggregate `blocks` asks for."""
    sizes = nodes.groupBy(cell).agg(blocks.cast("int").alias("blocks")).where("blocks > 1")
    # the second key makes Spark deal both sides anew, so that it can split a crowded cell
    met = nodes.withColumn("key", F.xxhash64(cell)).join(sizes.withColumn("key", F.xxhash64(cell)), ["key", cell], "left")
    return met.withColumn("block", F.xxhash64(cell, F.pmod(F.xxhash64("node"), F.coalesce("blocks", F.lit(1))))).drop("key", "blocks")


def _dealt(entries: DataFrame, rows: int) -> DataFrame:
    """entries (bucket, node, ...) with `group`: the bucket, or of a crowded one each pair of its parts."""
    sizes = entries.groupBy("bucket").agg(F.ceil(F.count("*") / rows).cast("int").alias("parts")).where("parts > 1")
    met = entries.withColumn("key", F.xxhash64("bucket")).join(sizes.withColumn("key", F.xxhash64("bucket")), ["key", "bucket"], "left")
    met = met.withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return met.withColumn("group", F.xxhash64("bucket", F.least("part", "other"), F.greatest("part", "other"))).drop("key", "parts", "part", "other")


def _met(group: np.ndarray, node: np.ndarray, block: np.ndarray, sketch: np.ndarray, near: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> list[np.ndarray]:
    """Columns lo, hi, node of rows sorted by group: the blocks of the pairs inside a group whose sketches are near."""
    n = len(group)
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    size = np.diff(np.append(first, n))
    later = np.repeat(first + size, size) - np.arange(n) - 1  # rows of its group that follow each row
    until = np.cumsum(later)
    blocks, code = np.unique(block, return_inverse=True)
    nodes, own = np.unique(node, return_inverse=True)
    keys, a = [np.empty(0, np.int64)], 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(until, (until[a - 1] if a else 0) + PAIRS, side="right")))
        reps = later[a:b]
        i = np.repeat(np.arange(a, b), reps)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(reps) - reps, reps)
        if len(i):
            good = near(sketch[i], sketch[j])
            i, j = i[good], j[good]
            at = (np.minimum(code[i], code[j]) * len(blocks) + np.maximum(code[i], code[j])) * len(nodes)
            keys.append(np.unique(np.concatenate((at + own[i], at + own[j]))))
        a = b
    key = np.unique(np.concatenate(keys))
    pair = key // len(nodes)
    return [blocks[pair // len(blocks)], blocks[pair % len(blocks)], nodes[key % len(nodes)]]


def _meeter(near: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def out(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            made = _met(*columns, near)
            if len(made[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in made], names=["lo", "hi", "node"])

        for batch in batches:
            if not batch.num_rows:
                continue
            sketch = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            columns = [*(batch.column(k).to_numpy() for k in range(3)), sketch]
            held = columns if held is None else [np.concatenate(x) for x in zip(held, columns, strict=True)]
            cut = int(np.searchsorted(held[0], held[0][-1], side="left"))  # the last group may go on
            if cut:
                yield from out([x[:cut] for x in held])
                held = [x[cut:] for x in held]
        if held is not None:
            yield from out(held)

    return run


def meeting(entries: DataFrame, near: Callable[[np.ndarray, np.ndarray], np.ndarray], partitions: int) -> DataFrame:
    """(lo, hi, node), checkpointed: of entries (bucket, node, block, sketch) the nodes that meet in each pair of
    blocks. `near` takes two arrays of sketches, rows of bytes, and says which are near."""
    dealt = _dealt(entries, BUCKET_ROWS).select("group", "node", "block", "sketch")
    found = dealt.repartition(partitions, "group").sortWithinPartitions("group").mapInArrow(_meeter(near), "lo long, hi long, node long")
    return C.checkpointed(found.distinct())


def forest_of(near: np.ndarray) -> list[tuple[int, int]]:
    """(member, root) for every row that a symmetric boolean matrix connects to a smaller one."""
    out: list[tuple[int, int]] = []
    open_ = near.any(1)
    for start in range(len(near)):
        if open_[start]:
            reached = np.zeros(len(near), bool)
            reached[start] = True
            edge = reached
            while edge.any():
                edge = near[edge].any(0) & ~reached
                reached |= edge
            open_ &= ~reached
            out += [(int(k), start) for k in np.flatnonzero(reached) if k != start]
    return out


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows (lo, hi, node, block, copies, value) of each pair of blocks of a sorted stream, one for each node."""
    held: list[tuple] = []
    order = lambda rows: sorted({r[2]: r for r in rows}.values(), key=lambda r: r[2])
    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
            if held and held[0][:2] != row[:2]:
                yield order(held)
                held = []
            held.append(row)
    if held:
        yield order(held)


def _verifier(linked: Callable[[], Callable[[list], np.ndarray]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links_of, out = linked(), []
        pack = lambda: pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(3)], names=["node", "links", "root"])
        for rows in _groups(batches):
            links = links_of([r[5] for r in rows])
            np.fill_diagonal(links, False)
            if rows[0][0] != rows[0][1]:  # two blocks: the pairs inside either have their own meeting
                side = np.array([r[3] for r in rows])
                links &= side[:, None] != side[None, :]
            count = links @ np.array([r[4] for r in rows], np.int64)
            root = dict(forest_of(links))
            out += [(r[2], int(count[k]), rows[root[k]][2] if k in root else None) for k, r in enumerate(rows) if count[k]]
            if len(out) > 20_000:
                yield pack()
                out = []
        if out:
            yield pack()

    return run


def verified(meetings: DataFrame, linked: Callable[[], Callable[[list], np.ndarray]], partitions: int) -> DataFrame:
    """(node, links, root), checkpointed, of rows (lo, hi, node, block, copies, value): the copies that each node is
    linked to, and a spanning forest of the links. `linked` makes, in the task, a function from a list of values to a
    symmetric boolean matrix."""
    dealt = meetings.select("lo", "hi", "node", "block", "copies", "value").repartition(partitions, "lo", "hi").sortWithinPartitions("lo", "hi")
    return C.checkpointed(dealt.mapInArrow(_verifier(linked), "node long, links long, root long"))


def members_of(found: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, component_id, keeper) of the nodes that verified() has linked: the least id of the component, and the
    row that has it. classes has node, id and first_row."""
    groups = C.components(found.where("root is not null").select(F.col("root").alias("a"), F.col("node").alias("b")))
    members = C.checkpointed(groups.join(classes.select("node", "id", "first_row"), "node"))
    least = members.groupBy("component").agg(F.min(F.struct("id", "first_row")).alias("least")).withColumn("key", F.xxhash64("component"))
    met = members.withColumn("key", F.xxhash64("component")).join(least, ["key", "component"])
    return met.select("node", F.col("least.id").alias("component_id"), F.col("least.first_row").alias("keeper"))
