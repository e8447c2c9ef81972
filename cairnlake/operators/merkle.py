"""Merkle index over object hashes: leaves, nodes, summary, proofs.

Leaves are the distinct hashes in byte order. A parent is the SHA3-256 of its two
children; the last node of an odd level pairs with itself; one leaf is its own root; no
leaves have the hash of no bytes. Level 0 is the first level above the leaves.

Positions come from a range sort and the partitions' counts, not from a one-partition
window. Sixteen levels are built at a time: a block of 65,536 neighbours is one group,
so a trillion leaves need three rounds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnlake.errors import Integrity, MissingMeta
from cairnlake.functions.hashing import digest
from cairnlake.runtime import materialize, partitions

EMPTY_ROOT = digest(b"")
BLOCK_BITS = 16


def ranked(df: DataFrame, order: list[str], name: str = "pos") -> DataFrame:
    """``df`` with its 0-based rank in this order, written.

    Range partitions are numbered locally and shifted by the counts of the partitions
    before them: one number a partition reaches the driver.
    """
    spark = df.sparkSession
    columns = [f.name for f in df.schema.fields]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid, n = TaskContext.get().partitionId(), 0
        for b in batches:
            extra = [pa.array(np.full(b.num_rows, pid, np.int32)), pa.array(np.arange(n, n + b.num_rows))]
            n += b.num_rows
            yield pa.record_batch([*b.columns, *extra], names=[*b.schema.names, "_pid", "_at"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", _pid int, _at long"
    local = materialize(df.repartitionByRange(partitions(df), *order).sortWithinPartitions(*order).mapInArrow(number, schema), "ranked")
    counts = sorted((r["_pid"], r["n"]) for r in local.groupBy("_pid").agg(F.count(F.lit(1)).alias("n")).collect())
    before, starts = 0, []
    for pid, n in counts:
        starts.append((pid, before))
        before += n
    offsets = spark.createDataFrame(starts, "_pid int, _before long")
    return local.join(F.broadcast(offsets), "_pid").select(*columns, (F.col("_before") + F.col("_at")).alias(name))


def leaves(objects: DataFrame) -> DataFrame:
    """``hash, pos``: the distinct hashes in byte order; null hashes are none."""
    return ranked(objects.select("hash").filter("hash is not null").distinct(), ["hash"])


def _climb(first: int, bits: int, alone: bool):
    """All levels of one block of up to 2**bits neighbours as (level, pos, hash) rows."""

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("pos").to_numpy(), kind="stable")
        block = int(table.column("block")[0].as_py())
        row = [h for h in table.column("hash").take(pa.array(order)).to_pylist()]
        levels, places, hashes = [], [], []
        for up in range(1, bits + 1):
            if alone and len(row) == 1:
                break
            row = [hashlib.sha3_256(row[i] + row[min(i + 1, len(row) - 1)]).digest() for i in range(0, len(row), 2)]
            levels += [first + up - 1] * len(row)
            places += range(block << (bits - up), (block << (bits - up)) + len(row))
            hashes += row
        return pa.table({"level": pa.array(levels, pa.int64()), "pos": pa.array(places, pa.int64()), "hash": pa.array(hashes, pa.binary())})

    return run


def nodes(leaf_rows: DataFrame, leaf_count: int) -> DataFrame:
    """``level, pos, hash`` of all inner nodes, written."""
    spark = leaf_rows.sparkSession
    built, level, count, row = [], 0, leaf_count, leaf_rows.select("pos", "hash")
    while count > 1:
        blocks = row.withColumn("block", F.shiftright("pos", BLOCK_BITS))
        # a block holds at most 65,536 hashes
        step = materialize(blocks.groupBy("block").applyInArrow(_climb(level, BLOCK_BITS, count <= 1 << BLOCK_BITS), "level long, pos long, hash binary"), "nodes")
        built.append(step)
        level += BLOCK_BITS
        count = -(-count >> BLOCK_BITS)
        row = step.filter(F.col("level") == level - 1).select("pos", "hash")
    out = spark.createDataFrame([], "level long, pos long, hash binary")
    for step in built:
        out = out.unionAll(step)
    return out


@dataclass(frozen=True)
class Index:
    """Leaves, nodes and the meta values of one Merkle index."""

    leaves: DataFrame
    nodes: DataFrame
    leaf_count: int
    root: bytes

    def meta(self, spark: SparkSession) -> DataFrame:
        values = {"leaf_count": str(self.leaf_count), "root_hash": self.root.hex(), "algo": "sha3-256", "tree": "merkle-set-v1", "sorted": "byte-lex"}
        return spark.createDataFrame(list(values.items()), "key string, value string")


def build(objects: DataFrame) -> Index:
    """The index over the distinct hashes of ``objects``."""
    rows = leaves(objects)
    count = rows.count()
    inner = nodes(rows, count)
    if count == 0:
        root = EMPTY_ROOT
    elif count == 1:
        root = bytes(rows.first()["hash"])
    else:
        root = bytes(inner.filter((F.col("level") == depth(count) - 1) & (F.col("pos") == 0)).first()["hash"])
    return Index(rows, inner, count, root)


def depth(leaf_count: int) -> int:
    """Number of siblings in a proof."""
    return max(0, leaf_count - 1).bit_length()


def summary(meta: DataFrame) -> tuple[bytes, int]:
    """(root, leaf count) from stored meta values."""
    values = {r["key"]: r["value"] for r in meta.filter(F.col("key").isin("root_hash", "leaf_count")).collect()}
    for key in ("root_hash", "leaf_count"):
        if key not in values:
            raise MissingMeta(key)
    try:
        return bytes.fromhex(values["root_hash"]), int(values["leaf_count"])
    except ValueError as e:
        raise Integrity(str(e)) from e


def recompute(index_leaves: DataFrame) -> tuple[bytes, int]:
    """(root, leaf count) from the leaf table alone; objects put since are not in it."""
    x = build(index_leaves)
    return x.root, x.leaf_count


def staleness(index_leaves: DataFrame, objects: DataFrame) -> DataFrame:
    """``hash, state``: objects that are not in the index (unindexed) and leaves without an object (dangling)."""
    have = objects.select("hash").distinct()
    return (
        have.join(index_leaves, "hash", "left_anti").select("hash", F.lit("unindexed").alias("state"))
        .unionAll(index_leaves.select("hash").join(have, "hash", "left_anti").select("hash", F.lit("dangling").alias("state")))
    )


def _beside(base: int, size: int, steps: int):
    """Siblings of the positions in one block, over ``steps`` levels; ``size`` is the number of nodes at the lowest."""

    def run(wanted: pa.Table, nodes: pa.Table) -> pa.Table:
        if not wanted.num_rows:
            return pa.table({"pos": pa.array([], pa.int64()), "siblings": pa.array([], pa.list_(pa.binary()))})
        at, level, place = wanted.column("pos").to_numpy(), nodes.column("level").to_numpy(), nodes.column("pos").to_numpy()
        order = np.lexsort([place, level])
        hashes = nodes.column("hash").combine_chunks().take(pa.array(order))
        level, place = level[order], place[order]
        index = np.zeros((len(at), steps), np.int64)
        for j in range(steps):
            mine = at >> j
            beside = mine ^ 1
            beside = np.where(beside >= -(-size >> j), mine, beside)  # the last node of an odd level is its own sibling
            first = int(np.searchsorted(level, base - 1 + j))
            index[:, j] = first + beside - place[first]  # a block's nodes of one level are neighbours
        offsets = np.arange(len(at) + 1, dtype=np.int32) * steps
        return pa.table({"pos": pa.array(at), "siblings": pa.ListArray.from_arrays(pa.array(offsets), hashes.take(pa.array(index.ravel())))})

    return run


def _siblings(index: Index, positions: DataFrame, step: int = 0) -> DataFrame:
    """``pos, siblings`` of distinct positions at level ``16 * step - 1``, up to the root.

    A position meets its block of 65,536 neighbours, which holds its siblings of sixteen
    levels; those above are found once for each block, so that no node near the root is
    a join key of many targets.
    """
    base = BLOCK_BITS * step
    size = -(-index.leaf_count >> base)
    steps = min(BLOCK_BITS, depth(index.leaf_count) - base)
    if steps <= 0:
        return positions.select("pos", F.array().cast("array<binary>").alias("siblings"))
    every = index.nodes.filter(F.col("level").between(base - 1, base + steps - 2))
    if step == 0:
        every = every.unionAll(index.leaves.select(F.lit(-1).cast("long").alias("level"), "pos", "hash"))
    high = F.expr(f"shiftright(pos, cast({BLOCK_BITS + base - 1} - level as int))").alias("block")
    own = F.shiftright("pos", BLOCK_BITS).alias("block")
    both = positions.select(own, "pos").groupBy("block").cogroup(every.select(high, "level", "pos", "hash").groupBy("block"))
    found = both.applyInArrow(_beside(base, size, steps), "pos long, siblings array<binary>")
    if base + steps >= depth(index.leaf_count):
        return found
    above = _siblings(index, positions.select(F.shiftright("pos", BLOCK_BITS).alias("pos")).distinct(), step + 1)
    above = above.select(F.col("pos").alias("block"), F.col("siblings").alias("higher"))
    return found.join(above, F.shiftright(found["pos"], BLOCK_BITS) == F.col("block")).select("pos", F.concat("siblings", "higher").alias("siblings"))


def prove(index: Index, targets: DataFrame) -> DataFrame:
    """``hash, leaf_pos, siblings`` for each distinct target; both are null where it is no leaf."""
    wanted = targets.select("hash").filter("hash is not null").distinct()
    placed = materialize(wanted.join(index.leaves, "hash", "left"), "placed")
    proofs = _siblings(index, placed.select("pos").filter("pos is not null"))
    return placed.join(proofs, "pos", "left").select("hash", F.col("pos").alias("leaf_pos"), "siblings")


def verify(target: bytes, leaf_pos: int, siblings: list[bytes], root: bytes, leaf_count: int, compat: bool = False) -> bool:
    """Whether the proof leads from the target to the root.

    Strict: the position must exist and the number of siblings must be the tree's depth;
    ``compat`` accepts what only folds to the root.
    """
    if leaf_count <= 0:
        return False
    if not compat and (not 0 <= leaf_pos < leaf_count or len(siblings) != depth(leaf_count)):
        return False
    now, at = target, leaf_pos
    for s in siblings:
        now = digest(s + now if at & 1 else now + s)
        at >>= 1
    return now == root


def verified(proofs: DataFrame, root: bytes, leaf_count: int, compat: bool = False) -> DataFrame:
    """``proofs`` with a column ``valid``; a missing proof is not valid."""

    @F.arrow_udf(T.BooleanType())
    def check(target: pa.Array, pos: pa.Array, siblings: pa.Array) -> pa.Array:
        rows = zip(target.to_pylist(), pos.to_pylist(), siblings.to_pylist())
        return pa.array([p is not None and s is not None and verify(t, p, s, root, leaf_count, compat) for t, p, s in rows], pa.bool_())

    return proofs.withColumn("valid", check("hash", "leaf_pos", "siblings"))
