"""Has this key been seen before?

Method: keys are hash-partitioned into buckets of a bounded number of different keys. Each bucket
is streamed in order of arrival through its own blocked Bloom filter, which is asked
first and then takes the key, so memory is one filter and one batch, however many keys
came before. Keys known to be absent (longer than any real key) measure the rate of
wrong answers. A filter never denies a key it has taken, so only its "seen" answers can
be wrong: a key whose every row was answered "seen" has no first row, and its lowest row
is the wrong one. That exact check runs on the filter's output.

A key that holds a third of all rows does not fill one bucket: within each input batch
every row but the first of its key is already known to be a repetition and travels to
any bucket, without its key.

Defined results:

* a null key or null sequence number is never seen and is no earlier key; a negative
  sequence number is one like others;
* rows delivered twice (same sequence number and key) are one row; the copy does not make
  the other one seen;
* keys are compared byte for byte; shortened keys are keys of their own, as is an empty one;
* empty tables give no rows; further columns are never read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlake.runtime import materialize, partitions

KEYS_PER_BUCKET = 1_000_000
TARGET = 0.001
PROBES = 4096
MOST_PARTITIONS = 10_000  # beyond it, a partition streams several buckets one after the other
MOST_BROADCAST = 500_000  # wrong answers that are broadcast; more are joined
BEFORE_ALL = -(1 << 63)  # the place of keys that came before every record

_LANES = 8


def _multipliers() -> np.ndarray:
    """Unrelated odd numbers, one for each lane: multiples of one another would tie the lanes' bits together."""
    x = np.arange(1, _LANES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) | np.uint64(1)


_ODD = _multipliers()


class BlockedBloom:
    """Blocks of eight 32-bit lanes; a key sets one bit in each lane of its block."""

    def __init__(self, keys: int, target: float = TARGET):
        per_key = -_LANES / np.log(1 - target ** (1 / _LANES)) * 1.2  # blocks fill unevenly
        self.blocks = max(1, int(np.ceil(max(1, keys) * per_key / (32 * _LANES))))
        self.lanes = np.zeros((self.blocks, _LANES), np.uint32)

    def _place(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = hashes.astype(np.uint64, copy=False)
        block = ((h >> np.uint64(32)) * np.uint64(self.blocks)) >> np.uint64(32)
        low = (h & np.uint64(0xFFFFFFFF)) | np.uint64(1 << 32)
        bit = (low[:, None] * _ODD[None, :]) >> np.uint64(59)
        return block.astype(np.int64), np.left_shift(np.uint32(1), bit.astype(np.uint32))

    def query(self, hashes: np.ndarray) -> np.ndarray:
        block, mask = self._place(hashes)
        return ((self.lanes[block] & mask) == mask).all(axis=1)

    def insert(self, hashes: np.ndarray) -> None:
        block, mask = self._place(hashes)
        order = np.argsort(block, kind="stable")
        block, mask = block[order], mask[order]
        starts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else np.zeros(0, int)
        if len(starts):
            self.lanes[block[starts]] |= np.bitwise_or.reduceat(mask, starts, axis=0)


def absent_hashes(n: int, longest: int, salt: int) -> np.ndarray:
    """Hashes of n keys that are one byte or more longer than any real key."""
    width = longest + 9
    made = (xxhash.xxh64_intdigest(f"{salt}:{i}".encode().rjust(width, b"\0"), 42) for i in range(n))
    return np.fromiter(made, np.uint64, n)


@dataclass(frozen=True)
class Plan:
    """Bucket count and expected keys in a bucket, by table; the longest key in bytes."""

    buckets: tuple[int, ...]
    keys: tuple[int, ...]
    longest: int
    target: float = TARGET
    probes: int = PROBES


def plan(tables: list[DataFrame], at_least: int, target: float = TARGET) -> Plan:
    """Sizes from estimates of the numbers of different keys: three numbers a table come to the driver."""
    sizes = [t.agg(F.count("key"), F.approx_count_distinct("key", 0.03), F.max(F.octet_length("key"))).first() for t in tables]
    rows = [max(1, s[0]) for s in sizes]
    distinct = [max(1, s[1]) * 1.1 for s in sizes]  # above the estimate's error
    buckets = [max(1, -(-int(k) // KEYS_PER_BUCKET), round(at_least * n / sum(rows))) for k, n in zip(distinct, rows)]
    keys = [int(k / b + 4 * (k / b) ** 0.5 + 64) for k, b in zip(distinct, buckets)]
    return Plan(tuple(buckets), tuple(keys), max(s[2] or 0 for s in sizes), target)


_LOCAL = "tab int, seq long, key binary, h long, bucket int"


def _local_repetitions(p: Plan) -> Callable:
    """Route rows to buckets; what a batch itself proves to be a repetition loses its key and goes anywhere."""
    first_bucket = np.concatenate([[0], np.cumsum(p.buckets)]).astype(np.int64)
    count = np.array(p.buckets, np.int64)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            tab, seq, h = (b.column(x).to_numpy() for x in ("tab", "seq", "h"))
            key = b.column("key")
            order = np.lexsort((seq, h, tab))
            t, s, x = tab[order], seq[order], h[order]
            new = np.concatenate([[True], (t[1:] != t[:-1]) | (x[1:] != x[:-1])])
            head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            same = pc.equal(key.take(pa.array(order)), key.take(pa.array(order[head]))).to_numpy(zero_copy_only=False)
            repeated = np.zeros(n, bool)
            repeated[order] = same & (s > s[head])
            anywhere = seq.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            spread = np.where(repeated, anywhere, h.view(np.uint64))
            bucket = first_bucket[tab] + (spread % count[tab].astype(np.uint64)).astype(np.int64)
            key = pc.if_else(pa.array(repeated), pa.nulls(n, pa.binary()), key)
            yield pa.record_batch([b.column("tab"), b.column("seq"), key, b.column("h"), pa.array(bucket.astype(np.int32))], names=["tab", "seq", "key", "h", "bucket"])

    return route


_ANSWERS = "tab int, seq long, key binary, seen boolean, bucket int, keys long, probes long, wrong long"


def _through_filters(p: Plan) -> Callable:
    """Stream a partition sorted by bucket and seq through one filter a bucket."""

    def answers(tab, seq, key, seen) -> pa.RecordBatch:
        n = len(seq)
        arrays = [tab, seq, key, pa.array(seen), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())]
        return pa.record_batch(arrays, names=[x.split()[0] for x in _ANSWERS.split(", ")])

    def measured(tab: int, bucket: int, taken: int, bloom: BlockedBloom) -> pa.RecordBatch:
        wrong = int(bloom.query(absent_hashes(p.probes, p.longest, bucket)).sum())
        values = [tab, None, None, None, bucket, taken, p.probes, wrong]
        kinds = [pa.int32(), pa.int64(), pa.binary(), pa.bool_(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        return pa.record_batch([pa.array([v], k) for v, k in zip(values, kinds)], names=[x.split()[0] for x in _ANSWERS.split(", ")])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket_now, tab_now, bloom, taken, before = None, 0, None, 0, None
        for batch in batches:
            ids = batch.column("bucket").to_numpy()
            cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
            for a, z in zip(cuts, cuts[1:]):
                if a == z:
                    continue
                b = batch.slice(a, z - a)
                if ids[a] != bucket_now:
                    if bloom is not None:
                        yield measured(tab_now, bucket_now, taken, bloom)
                    bucket_now, tab_now = int(ids[a]), int(b.column("tab")[0].as_py())
                    bloom, taken, before = BlockedBloom(p.keys[tab_now], p.target), 0, None
                known = b.column("key").is_null().to_numpy(zero_copy_only=False)
                if known.any():
                    some = b.filter(pa.array(known))
                    yield answers(some.column("tab"), some.column("seq"), some.column("key"), np.ones(some.num_rows, bool))
                    b = b.filter(pa.array(~known))
                if not b.num_rows:
                    continue
                seq, h = b.column("seq").to_numpy(), b.column("h").to_numpy().view(np.uint64)
                copy = np.concatenate([[before == (seq[0], h[0])], (seq[1:] == seq[:-1]) & (h[1:] == h[:-1])])
                before = (seq[-1], h[-1])
                if copy.any():
                    b = b.filter(pa.array(~copy))
                    seq, h = seq[~copy], h[~copy]
                if not len(h):
                    continue
                seen = np.ones(len(h), bool)
                once = np.unique(h, return_index=True)[1]  # a later row of the batch has been seen in it
                seen[once] = bloom.query(h[once])
                bloom.insert(h[once])
                taken += int((~seen).sum())
                yield answers(b.column("tab"), b.column("seq"), b.column("key"), seen)
        if bloom is not None:
            yield measured(tab_now, bucket_now, taken, bloom)

    return stream


def bloom_answers(tables: list[tuple[DataFrame, str, str]], before: DataFrame, target: float = TARGET) -> DataFrame:
    """The filters' answers, written: a row for each record and one for each bucket.

    ``tables`` are (table, key column, sequence column), judged apart; ``before`` has the
    keys (column ``hash``) that came before everything else.
    """
    rows = [t.select(F.lit(i).alias("tab"), F.col(s).alias("seq"), F.col(k).alias("key")).filter("seq is not null and key is not null") for i, (t, k, s) in enumerate(tables)]
    first = before.select(F.col("hash").alias("key")).filter("key is not null")
    least = max(map(partitions, rows))
    p = plan(rows, least, target)
    for i in range(len(tables)):
        rows.append(first.select(F.lit(i).alias("tab"), F.expr(f"cast({BEFORE_ALL} as long)").alias("seq"), "key"))
    keyed = rows[0]
    for r in rows[1:]:
        keyed = keyed.unionAll(r)
    routed = keyed.withColumn("h", F.xxhash64("key")).mapInArrow(_local_repetitions(p), _LOCAL)
    parts = min(sum(p.buckets), MOST_PARTITIONS)
    routed = routed.repartitionById(parts, F.pmod("bucket", F.lit(parts))).sortWithinPartitions("bucket", "seq", "h")
    return materialize(routed.mapInArrow(_through_filters(p), _ANSWERS), "seen")


def false_answers(answers: DataFrame) -> DataFrame:
    """Exact check: ``tab, seq, key`` of records answered "seen" whose key did not occur before."""
    keyed = answers.filter("key is not null").groupBy("tab", "key").agg(F.min("seq").alias("seq"), F.every("seen").alias("all_seen"))
    return keyed.filter("all_seen").select("tab", "seq", "key")


def seen_records(answers: DataFrame) -> DataFrame:
    """``tab, seq`` of each record whose key occurred before, once."""
    rows = answers.filter(F.col("seen") & (F.col("seq") > BEFORE_ALL)).select("tab", "seq", "key")
    wrong = materialize(false_answers(answers), "wrong")  # the target share of the keys, at most
    if wrong.count() <= MOST_BROADCAST:
        wrong = F.broadcast(wrong)
    # rows without a key were repetitions within their batch, and never wrong
    return rows.join(wrong, ["tab", "seq", "key"], "left_anti").select("tab", "seq").distinct()


def error_rates(answers: DataFrame, target: float = TARGET) -> DataFrame:
    """By table: keys taken, known absent keys asked, wrong answers to them, their rate, the target, and wrong answers among the records."""
    asked = answers.filter("bucket is not null").groupBy("tab").agg(*[F.sum(x).alias(x) for x in ("keys", "probes", "wrong")])
    wrong = false_answers(answers).groupBy("tab").agg(F.count(F.lit(1)).alias("wrong_records"))
    return asked.join(wrong, "tab", "left").select(
        "tab", "keys", "probes", "wrong", F.try_divide("wrong", "probes").alias("rate"), F.lit(target).alias("target_rate"), F.coalesce("wrong_records", F.lit(0)).alias("wrong_records"),
    )
