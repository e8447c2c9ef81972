"""References to objects that are not available at the time of the referring record.

Method: references and parent events (base rows, deletions, puts) become one stream
that is range-partitioned and sorted on (hash, time, order). Each partition is merged
linearly: the last parent event before a reference decides whether the reference is
inside a validity interval of its target. The composite key lets a hot hash spread over
many partitions; what a partition does not know about its first hash is filled in from
the partitions before it, of which one small tail row each is needed.

Defined results:

* null hashes, null reference times and null arrays are no references; they are skipped;
* a parent row without a time or without a hash is no event;
* at equal times a deletion counts before a put, and both before the reference;
* repeated rows change nothing; a case comes out once;
* empty tables give an empty result; further columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnlake.runtime import materialize, partitions

RECIPES, CACHE, REPORTS = "recipes", "file_recipe_cache", "closure_reports"
TABLES = (RECIPES, CACHE, REPORTS)
BASE, DELETE, PUT, REF = 0, 1, 2, 3
ANY_KIND = 0
BEFORE_ALL = -(2**62)

CASE, OPEN, TAIL, LATER = 0, 1, 2, 3
MISSING, DELETED, WRONG_KIND, ABSENT = "missing", "deleted", "wrong_kind", "absent"

_MERGED = T.StructType(
    [
        T.StructField("what", T.IntegerType()),
        T.StructField("pid", T.IntegerType()),
        T.StructField("hash", T.BinaryType()),
        T.StructField("tab", T.IntegerType()),
        T.StructField("key_num", T.LongType()),
        T.StructField("key_bin", T.BinaryType()),
        T.StructField("at", T.LongType()),
        T.StructField("kind", T.IntegerType()),
        T.StructField("base", T.IntegerType()),
        T.StructField("last", T.IntegerType()),
        T.StructField("first_hash", T.BinaryType()),
    ]
)


def reference_stream(recipes: DataFrame, cache: DataFrame, reports: DataFrame) -> DataFrame:
    """All references as (hash, at, ord, kind, tab, key_num, key_bin), one row for each."""
    nothing = F.lit(None).cast("binary")
    a = recipes.select("recipe_id", "created_at", F.explode("chunks").alias("c")).select(
        F.col("c.hash").alias("hash"), F.col("created_at").alias("at"), F.lit(REF).alias("ord"), F.lit(1).alias("kind"),
        F.lit(0).alias("tab"), F.col("recipe_id").alias("key_num"), nothing.alias("key_bin"),
    )
    b = cache.select(
        F.col("recipe_hash").alias("hash"), F.col("updated_at").alias("at"), F.lit(REF).alias("ord"), F.lit(2).alias("kind"),
        F.lit(1).alias("tab"), F.lit(None).cast("long").alias("key_num"), F.col("file_hash").alias("key_bin"),
    )
    c = reports.select("report_id", "checked_at", F.explode("missing_objects").alias("hash")).select(
        "hash", F.col("checked_at").alias("at"), F.lit(REF).alias("ord"), F.lit(ANY_KIND).alias("kind"),
        F.lit(2).alias("tab"), F.col("report_id").alias("key_num"), nothing.alias("key_bin"),
    )
    return a.unionAll(b).unionAll(c).filter("hash is not null and at is not null")


def parent_stream(objects: DataFrame, deletions: DataFrame, base: DataFrame) -> DataFrame:
    """Parent events in the columns of :func:`reference_stream`."""

    def event(df: DataFrame, at, order: int, kind) -> DataFrame:
        return df.select(
            "hash", at.cast("long").alias("at"), F.lit(order).alias("ord"), kind.cast("int").alias("kind"),
            F.lit(-1).alias("tab"), F.lit(None).cast("long").alias("key_num"), F.lit(None).cast("binary").alias("key_bin"),
        )

    return (
        event(objects, F.col("created_at"), PUT, F.col("kind"))
        .unionAll(event(deletions, F.col("deleted_at"), DELETE, F.lit(-1)))
        .unionAll(event(base, F.lit(BEFORE_ALL), BASE, F.col("kind")))
        .filter("hash is not null and at is not null and kind is not null")
    )


def _available(base: np.ndarray, last: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Whether a target with this base kind (0: none) and last event (0: none, -1: deleted, else kind) serves."""
    any_kind = need == ANY_KIND
    return ((base > 0) & (any_kind | (base == need))) | ((last > 0) & (any_kind | (last == need)))


def _rows(n: int, what: int, pid: int, **columns) -> pa.RecordBatch:
    out = []
    for f in _MERGED.fields:
        kind = pa.int32() if f.dataType == T.IntegerType() else pa.int64() if f.dataType == T.LongType() else pa.binary()
        if f.name == "what" or f.name == "pid":
            out.append(pa.array(np.full(n, what if f.name == "what" else pid, np.int32)))
        elif (v := columns.get(f.name)) is None:
            out.append(pa.nulls(n, kind))
        else:
            out.append(v if isinstance(v, pa.Array) else pa.array(v, kind))
    return pa.record_batch(out, names=_MERGED.names)


def _fill(starts: np.ndarray, marked: np.ndarray, values: np.ndarray, carry: int, unset: int) -> np.ndarray:
    """For each row the value of the last marked row of its run up to it, else ``unset``; the first run continues ``carry``."""
    n = len(values)
    index = np.arange(n)
    at = np.maximum.accumulate(np.where(marked, index, -1))
    run = np.maximum.accumulate(np.where(starts, index, -1))
    out = np.where((at >= 0) & (at >= run), values[np.maximum(at, 0)], unset)
    first = run < 0
    return np.where(first & (at < 0), carry, out)


def merge_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Linear merge of one sorted partition.

    Emits the references that are not available (CASE), those of the partition's first
    hash that came before any event of it here (OPEN), a put after an unavailable
    reference of the same hash (LATER), and what is known at the end (TAIL).
    ``base`` and ``last`` are -2 where earlier partitions decide.
    """
    from pyspark import TaskContext

    pid = TaskContext.get().partitionId()
    unknown = -2
    hash_before, first_hash = None, None
    base, last, absent = unknown, unknown, True
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        keys = batch.column("hash")
        starts = np.zeros(n, bool)
        starts[1:] = pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)
        if first_hash is None:
            first_hash = keys[0].as_py()
        elif keys[0].as_py() != hash_before:
            starts[0] = True
        order = batch.column("ord").to_numpy()
        kind = batch.column("kind").to_numpy()
        of_base = _fill(starts, order == BASE, kind, base, 0)
        of_last = _fill(starts, (order == PUT) | (order == DELETE), kind, last, 0)
        is_ref = order == REF
        undecided = is_ref & (of_base == unknown) & ~_available(np.zeros(n, int), of_last, kind)
        missed = is_ref & ~undecided & ~_available(of_base, of_last, kind)
        for mask, what in ((missed, CASE), (undecided, OPEN)):
            if mask.any():
                some = batch.filter(pa.array(mask))
                yield _rows(
                    some.num_rows, what, pid, hash=some.column("hash"), tab=some.column("tab"), key_num=some.column("key_num"),
                    key_bin=some.column("key_bin"), at=some.column("at"), kind=some.column("kind"), base=of_base[mask].astype(np.int32), last=of_last[mask].astype(np.int32),
                )
        # a put right after an absent reference of its hash: that target came late. The
        # first run of a partition may continue such a reference, hence absent is true at first
        gap = (missed | undecided) & (of_last != -1) & (of_last <= 0)
        put = order == PUT
        lacking = _fill(starts, gap | put, gap.astype(int), int(absent), 0)
        before = np.concatenate([[int(absent)], lacking[:-1]])
        later = put & (before == 1) & ~starts
        if later.any():
            some = batch.filter(pa.array(later))
            yield _rows(some.num_rows, LATER, pid, hash=some.column("hash"), at=some.column("at"))
        hash_before, base, last, absent = keys[n - 1].as_py(), int(of_base[-1]), int(of_last[-1]), bool(lacking[-1])
    if first_hash is not None:
        yield _rows(1, TAIL, pid, hash=[hash_before], first_hash=[first_hash], base=[base], last=[last])


def _carries(tails: list) -> dict[int, tuple[int, int]]:
    """For each partition, the base kind and last event that its first hash has from the partitions before it."""
    out: dict[int, tuple[int, int]] = {}
    hash_before, base, last = None, 0, 0
    for t in sorted(tails, key=lambda t: t.pid):
        if t.first_hash != hash_before:
            base, last = 0, 0
        out[t.pid] = (base, last)
        hash_before, base, last = t.hash, base if t.base == -2 else t.base, last if t.last == -2 else t.last
    return out


def orphan_references(
    recipes: DataFrame, cache: DataFrame, reports: DataFrame, objects: DataFrame, deletions: DataFrame, base: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """References whose target is not available at their time.

    Returns (cases, later): cases has ``tab, key_num, key_bin, hash, at, state`` with state
    deleted, wrong_kind or absent, a row for each reference (repetitions possible);
    later has ``hash, at`` of puts that came after an absent reference to their hash.
    """
    spark = recipes.sparkSession
    stream = reference_stream(recipes, cache, reports).unionAll(parent_stream(objects, deletions, base))
    order = ["hash", "at", "ord"]
    # key_num and key_bin only spread rows of one hash and time over partitions
    merged = stream.repartitionByRange(partitions(stream), *order, "key_num", "key_bin").sortWithinPartitions(*order).mapInArrow(merge_partition, _MERGED)
    merged = materialize(merged, "references")
    # one row for each partition: bounded by the partition count, not by the data
    carries = _carries(merged.filter(F.col("what") == TAIL).select("pid", "hash", "first_hash", "base", "last").collect())
    rows = [(p, b, l) for p, (b, l) in carries.items()]
    known = spark.createDataFrame(rows, "pid int, base_in int, last_in int")
    open_ = merged.filter(F.col("what") == OPEN).join(F.broadcast(known), "pid")
    base_kind = F.when(F.col("base") == -2, F.col("base_in")).otherwise(F.col("base"))
    last_event = F.when(F.col("last") == -2, F.col("last_in")).otherwise(F.col("last"))
    columns = ["tab", "key_num", "key_bin", "hash", "at", "kind", "base", "last"]
    cases = (
        merged.filter(F.col("what") == CASE)
        .select(columns)
        .unionAll(open_.withColumn("base", base_kind).withColumn("last", last_event).select(columns))
    )
    fits = lambda c: (F.col(c) > 0) & ((F.col("kind") == ANY_KIND) | (F.col(c) == F.col("kind")))
    state = F.when(F.col("last") == -1, DELETED).when((F.col("base") > 0) | (F.col("last") > 0), WRONG_KIND).otherwise(ABSENT)
    cases = cases.filter(~(fits("base") | fits("last"))).select("tab", "key_num", "key_bin", "hash", "at", state.alias("state"))
    return cases, merged.filter(F.col("what") == LATER).select("hash", "at")


def _named(cases: DataFrame):
    name = F.element_at(F.array(*map(F.lit, TABLES)), F.col("tab") + 1)
    key = F.when(F.col("tab") == 1, F.lower(F.hex("key_bin"))).otherwise(F.col("key_num").cast("string"))
    return name.alias("ref_table"), key.alias("ref_key")


def found(cases: DataFrame) -> DataFrame:
    """Each case once: ``ref_table, ref_key, target_hex``."""
    return cases.select(*_named(cases), F.lower(F.hex("hash")).alias("target_hex")).distinct()


def report(cases: DataFrame, later: DataFrame) -> DataFrame:
    """Orphan references by table, month and state: ``ref_table, period, state, cases, targets``.

    state is deleted, late (put only after the reference), missing (never put) or
    wrong_kind. A case counts once in its month and state.
    """
    # puts per hash collapse map-side; then the two sides meet on the hash
    last_put = later.groupBy("hash").agg(F.max("at").alias("put_at"))
    distinct = cases.groupBy("tab", "key_num", "key_bin", "hash", "at").agg(F.first("state").alias("state"))
    joined = distinct.join(last_put, "hash", "left")
    state = F.when((F.col("state") == ABSENT) & (F.col("put_at") > F.col("at")), "late").when(F.col("state") == ABSENT, MISSING).otherwise(F.col("state"))
    month = F.date_format(F.timestamp_seconds("at"), "yyyy-MM")
    name, _ = _named(joined)
    per_case = joined.select(name, month.alias("period"), state.alias("state"), "hash", "key_num", "key_bin").distinct()
    return per_case.groupBy("ref_table", "period", "state").agg(F.count(F.lit(1)).alias("cases"), F.count_distinct("hash").alias("targets"))
