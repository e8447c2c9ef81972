"""Per-key results where a few keys hold most records.

Method: the records are range-partitioned on the composite of key and secondary order
(table, key, record, position) with quantiles sampled by the range exchange, so a heavy
key is cut into as many partitions as its rows fill. Each sorted partition is scanned
once into one partial state for each key. Only the first and the last key of a
partition can go on elsewhere; their states, two a partition, are stitched, all others
are final.

Defined results:

* a record delivered twice (same key, record id and position) counts once: equal
  composite keys are neighbours in one partition;
* null keys are skipped; a null weight counts as 0 bytes; null or empty arrays hold no
  entries; an empty table gives no keys;
* further columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnlake.runtime import materialize, partitions

_STATE = "pid int, open boolean, tab int, key binary, entries long, bytes long, records long, first_record long, last_record long"
_NAMES = [x.split()[0] for x in _STATE.split(", ")]
_ORDER = ["tab", "key", "record", "pos"]


def recipe_entries(recipes: DataFrame, tab: int = 0) -> DataFrame:
    """Chunk entries of recipes as ``tab, key, record, pos, weight``."""
    rows = recipes.select("recipe_id", F.posexplode("chunks").alias("pos", "c"))
    return rows.select(F.lit(tab).alias("tab"), F.col("c.hash").alias("key"), F.col("recipe_id").alias("record"), "pos", F.col("c.len").alias("weight"))


def object_puts(objects: DataFrame, tab: int = 1) -> DataFrame:
    """Puts of objects as ``tab, key, record, pos, weight``."""
    return objects.select(F.lit(tab).alias("tab"), F.col("hash").alias("key"), F.col("put_seq").alias("record"), F.lit(0).alias("pos"), F.col("size").alias("weight"))


def _changes(batch: pa.RecordBatch, names: list[str], before: tuple | None) -> np.ndarray:
    """Where a sorted batch's values of these columns differ from the row above."""
    n = batch.num_rows
    out = np.zeros(n, bool)
    for name in names:
        c = batch.column(name)
        if n > 1:
            same = pc.fill_null(pc.equal(c[1:], c[:-1]), False)
            same = pc.or_(same, pc.and_(pc.is_null(c[1:]), pc.is_null(c[:-1])))
            out[1:] |= ~same.to_numpy(zero_copy_only=False)
    out[0] = before is None or tuple(batch.column(x)[0].as_py() for x in names) != before
    return out


def scan_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial states of one partition sorted by tab, key, record, pos."""
    from pyspark import TaskContext

    pid = TaskContext.get().partitionId()
    row_before = key_before = record_before = None
    held: list | None = None  # the state of the key that may go on: tab, key, entries, bytes, records, first, last
    first = True

    def states(rows: list[list], open_: list[bool]) -> pa.RecordBatch:
        tab, key, entries, size, records, lo, hi = zip(*rows)
        longs = [pa.array(list(map(int, x)), pa.int64()) for x in (entries, size, records)]
        ends = [pa.array(x, pa.int64()) for x in (lo, hi)]
        return pa.record_batch([pa.array([pid] * len(rows), pa.int32()), pa.array(open_), pa.array(tab, pa.int32()), pa.array(key, pa.binary()), *longs, *ends], names=_NAMES)

    for batch in batches:
        if not batch.num_rows:
            continue
        new_row = _changes(batch, _ORDER, row_before)
        new_record = _changes(batch, ["tab", "key", "record"], record_before)
        new_key = _changes(batch, ["tab", "key"], key_before)
        value = lambda i, names: tuple(batch.column(x)[i].as_py() for x in names)  # noqa: B023, E731
        last = batch.num_rows - 1
        row_before, record_before, key_before = value(last, _ORDER), value(last, ["tab", "key", "record"]), value(last, ["tab", "key"])
        weight = np.where(new_row, pc.fill_null(batch.column("weight"), 0).to_numpy(), 0)
        bounds = np.flatnonzero(new_key)
        runs = bounds if new_key[0] else np.concatenate([[0], bounds])
        if not len(runs):
            runs = np.zeros(1, int)
        entries, size, records = (np.add.reduceat(x.astype(np.int64), runs) for x in (new_row, weight, new_record))
        ends = np.concatenate([runs[1:], [batch.num_rows]]) - 1
        n = len(runs)
        at = lambda column, places, i, j: batch.column(column).take(pa.array(places[i:j]))  # noqa: B023, E731
        one = lambda i: [*(at(c, runs, i, i + 1)[0].as_py() for c in ("tab", "key")), entries[i], size[i], records[i], *(at("record", p, i, i + 1)[0].as_py() for p in (runs, ends))]  # noqa: B023, E731
        begin = 0
        if held is not None and not new_key[0]:  # the key of the batch before goes on
            held[2:5] = held[2] + entries[0], held[3] + size[0], held[4] + records[0]
            held[6] = one(0)[6]
            begin = 1
        if begin == n:
            continue
        if held is not None:
            yield states([held], [first])
            first = False
        elif n > 1:  # the partition's first key, which may have begun before it
            yield states([one(0)], [True])
            first, begin = False, 1
        if begin < n - 1:
            # keys that begin and end in this batch: no Python object each
            longs = [pa.array(x[begin : n - 1]) for x in (entries, size, records)]
            blank = [pa.array(np.full(n - 1 - begin, pid, np.int32)), pa.array(np.zeros(n - 1 - begin, bool))]
            columns = [*blank, at("tab", runs, begin, n - 1), at("key", runs, begin, n - 1), *longs, at("record", runs, begin, n - 1), at("record", ends, begin, n - 1)]
            yield pa.record_batch(columns, names=_NAMES)
        held = one(n - 1)
    if held is not None:
        yield states([held], [True])


def key_states(entries: DataFrame) -> DataFrame:
    """Partial states, written: final ones (open is false) and at most two open ones for each partition."""
    rows = entries.filter("key is not null")
    n = partitions(rows)
    return materialize(rows.repartitionByRange(n, *_ORDER).sortWithinPartitions(*_ORDER).mapInArrow(scan_partition, _STATE), "heavy")


def stitch(states: DataFrame) -> DataFrame:
    """Per-key results ``tab, key, entries, bytes, records`` from the partial states.

    A record that a boundary cuts is in both states and counts once.
    """
    # open states: at most two for each partition, so these groups are bounded by the partition count
    along = Window.partitionBy("tab", "key").orderBy("pid")
    twice = F.lag("last_record").over(along).eqNullSafe(F.col("first_record")) & (F.row_number().over(along) > 1)
    columns = ["tab", "key", "entries", "bytes", "records"]
    cut = states.filter("open").withColumn("records", F.col("records") - twice.cast("long"))
    whole = cut.groupBy("tab", "key").agg(*[F.sum(x).alias(x) for x in columns[2:]])
    return states.filter("not open").select(columns).unionAll(whole.select(columns))


def per_key(recipes: DataFrame, objects: DataFrame) -> DataFrame:
    """For every hash of both tables ``tab, key, entries, bytes, records``; records are referring recipes or puts."""
    return stitch(key_states(recipe_entries(recipes).unionAll(object_puts(objects))))


def heavy(results: DataFrame, share: float = 0.015) -> DataFrame:
    """The keys that hold at least ``share`` of their table's entries; at most 1/share a table."""
    totals = {r.tab: r.n for r in results.groupBy("tab").agg(F.sum("entries").alias("n")).collect()}  # one row a table
    least = F.lit(None).cast("double")
    for tab, n in totals.items():
        least = F.when(F.col("tab") == tab, F.lit(share * n)).otherwise(least)
    return results.filter(F.col("entries") >= least)


def table_name(column: str = "tab"):
    return F.when(F.col(column) == 0, "recipes").otherwise("objects").alias("tab")


def found(recipes: DataFrame, objects: DataFrame) -> DataFrame:
    """The heavy hashes: ``tab, hash_hex``."""
    return heavy(per_key(recipes, objects)).select(table_name(), F.lower(F.hex("key")).alias("hash_hex"))
