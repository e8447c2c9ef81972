"""Differences between two copies of a keyed table, field by field.

Method: only digests travel first, of the key (128 bits), of the fields (64 bits), and the
order. Each partition reads them in order and numbers the keys with ordinals that both
sides share; a side's bitmap (containers of 65,536 ordinals, each held as a sorted array,
a bit set or runs, whichever is smallest) says which keys it has. AND-NOT of the bitmaps
finds the keys missing on a side; the digests of their intersection are compared ordinal
by ordinal. The keys found are a bitmap of hash slots, bounded in size, that keeps all
other rows at home: only for these do keys and fields themselves travel, to be compared in
the same way, now field by field. A slot that another key shares brings that key along,
which then shows no difference.

A difference is missed only where two keys agree in 128 bits, or the fields of one key
differ and agree in 64.

Defined results:

* of the rows of one key the given order decides; null order values come last (the
  largest long counts as null), and full ties are broken by the digest of the compared
  values, so that repeated rows change nothing;
* two nulls are equal, null and a value differ; rows with a null key are skipped;
* an empty side makes every key of the other ``only_a`` or ``only_b``;
* columns beside the key, the order and the fields are never read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlake.runtime import materialize

CONTAINER = 1 << 16
LEAST_SLOTS, MOST_SLOTS = 1 << 16, 1 << 27  # slots of the bitmap of differing keys; 16 MB at most
SLOTS_A_KEY = 64


class PresenceBitmap:
    """A set of ordinals in containers of 65,536, each in its smallest form."""

    def __init__(self, containers: dict[int, tuple[str, np.ndarray]]):
        self.containers = containers

    @classmethod
    def of(cls, present: np.ndarray, first: int = 0) -> PresenceBitmap:
        """The ordinals ``first + i`` of the true entries; ``first`` is a multiple of 65,536."""
        out = {}
        for at in range(0, len(present), CONTAINER):
            packed = cls._pack(present[at : at + CONTAINER])
            if packed is not None:
                out[(first + at) // CONTAINER] = packed
        return cls(out)

    @staticmethod
    def _pack(bits: np.ndarray) -> tuple[str, np.ndarray] | None:
        count = int(bits.sum())
        if not count:
            return None
        edges = np.flatnonzero(np.diff(np.concatenate([[False], bits, [False]]).astype(np.int8)))
        sizes = {"runs": 4 * len(edges) // 2, "array": 2 * count, "bits": CONTAINER // 8}
        form = min(sizes, key=sizes.get)
        if form == "runs":
            return form, edges.astype(np.int32)
        if form == "array":
            return form, np.flatnonzero(bits).astype(np.uint16)
        return form, np.packbits(np.pad(bits, (0, CONTAINER - len(bits))))

    def _bits(self, key: int) -> np.ndarray:
        out = np.zeros(CONTAINER, bool)
        if key in self.containers:
            form, data = self.containers[key]
            if form == "bits":
                return np.unpackbits(data).astype(bool)
            if form == "array":
                out[data] = True
            else:
                for a, b in data.reshape(-1, 2):
                    out[a:b] = True
        return out

    def _combine(self, other: PresenceBitmap, keys, how: Callable) -> PresenceBitmap:
        packed = {k: self._pack(how(self._bits(k), other._bits(k))) for k in keys}
        return PresenceBitmap({k: v for k, v in packed.items() if v is not None})

    def and_not(self, other: PresenceBitmap) -> PresenceBitmap:
        return self._combine(other, self.containers, lambda a, b: a & ~b)

    def intersect(self, other: PresenceBitmap) -> PresenceBitmap:
        return self._combine(other, self.containers.keys() & other.containers.keys(), lambda a, b: a & b)

    def ordinals(self) -> np.ndarray:
        """The set's ordinals in ascending order."""
        parts = [k * CONTAINER + np.flatnonzero(self._bits(k)) for k in sorted(self.containers)]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    def nbytes(self) -> int:
        return sum(data.nbytes for _, data in self.containers.values())


def _differs(x: pa.Array, y: pa.Array) -> np.ndarray:
    """Null-safe inequality of two aligned arrays."""
    unequal = pc.fill_null(pc.not_equal(x, y), False)
    one_null = pc.xor(pc.is_null(x), pc.is_null(y))
    return pc.or_(unequal, one_null).to_numpy(zero_copy_only=False)


def _rank(columns: Sequence[str]) -> list[str]:
    """The columns that tell which of a key's rows stands for it."""
    return [*(c for c in columns if c[0] == "o" and c[1:].isdigit()), "digest"]


def _changes(b: pa.RecordBatch, names: Sequence[str]) -> np.ndarray:
    """Where a value of these columns, none of them null, differs from the row above; the first row is no change."""
    out = np.zeros(b.num_rows, bool)
    for name in names if b.num_rows > 1 else ():
        c = b.column(name)
        out[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
    return out


def _first_of_batch(key: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of the rows of one key and side in a batch only the one that stands for it, so that a hot key does not travel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ranks = [b.column(c).to_numpy() for c in _rank(b.schema.names)]
            b = b.take(pa.array(np.lexsort([*reversed(ranks), b.column("side").to_numpy(), b.column("h").to_numpy()])))
            new = _changes(b, [*key, "side"])
            new[:1] = True
            yield b.filter(pa.array(new))

    return run


def _blocks(batches: Iterator[pa.RecordBatch], key: Sequence[str]) -> Iterator[tuple[int, pa.Table, np.ndarray, np.ndarray]]:
    """Containers of keys that arrive in order: (first ordinal, rows, their ordinals, their sides), the first row a key and side."""
    held: list[tuple[pa.RecordBatch, np.ndarray]] = []
    last, side_before, ordinal = None, None, -1

    def block():
        rows = pa.Table.from_batches([r for r, _ in held]).combine_chunks()
        at = np.concatenate([o for _, o in held])
        held.clear()
        return int(at[0]) // CONTAINER * CONTAINER, rows, at, rows.column("side").to_numpy()

    for b in batches:
        if not b.num_rows:
            continue
        side, new = b.column("side").to_numpy(), _changes(b, key)
        value = lambda i: tuple(b.column(c)[i].as_py() for c in key)  # noqa: B023, E731
        new[0] = value(0) != last
        first = new | np.concatenate([[side[0] != side_before], side[1:] != side[:-1]])
        ordinals = ordinal + np.cumsum(new)
        last, side_before, ordinal = value(b.num_rows - 1), side[-1], int(ordinals[-1])
        rows, ordinals = b.filter(pa.array(first)), ordinals[first]
        while len(ordinals):
            now = held[0][1][0] if held else ordinals[0]
            cut = int(np.searchsorted(ordinals, (now // CONTAINER + 1) * CONTAINER))
            if cut:
                held.append((rows.slice(0, cut), ordinals[:cut]))
            rows, ordinals = rows.slice(cut), ordinals[cut:]
            if len(ordinals):
                yield block()
    if held:
        yield block()


def _sides(first: int, at: np.ndarray, side: np.ndarray) -> tuple[dict[int, PresenceBitmap], dict[int, np.ndarray]]:
    """Each side's bitmap of a container, and the row of each ordinal."""
    have, row = {}, {}
    for s in (0, 1):
        mine = np.flatnonzero(side == s)
        present = np.zeros(CONTAINER, bool)
        present[at[mine] - first] = True
        have[s] = PresenceBitmap.of(present, first)
        row[s] = np.zeros(CONTAINER, np.int64)
        row[s][at[mine] - first] = mine
    return have, row


_KEY = ("h", "h2")


def _unlike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``h`` of the keys that a side lacks or whose digests differ."""
    for first, rows, at, side in _blocks(batches, _KEY):
        have, row = _sides(first, at, side)
        both = have[0].intersect(have[1]).ordinals() - first
        digest, h = (rows.column(c).to_numpy() for c in ("digest", "h"))
        found = [row[s][have[s].and_not(have[1 - s]).ordinals() - first] for s in (0, 1)]
        found.append(row[0][both[digest[row[0][both]] != digest[row[1][both]]]])
        yield pa.record_batch([pa.array(h[np.concatenate(found)])], names=["h"])


def _compare(fields: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``row_key, field``: sides that lack a key, and names of the fields that differ."""
    names = list(fields)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for first, rows, at, side in _blocks(batches, ("row_key",)):
            have, row = _sides(first, at, side)
            keys = rows.column("row_key").combine_chunks()

            def out(places: np.ndarray, field: str) -> pa.RecordBatch:
                return pa.record_batch([keys.take(pa.array(places)), pa.array([field] * len(places), pa.string())], names=["row_key", "field"])  # noqa: B023

            for s, name in ((0, "only_a"), (1, "only_b")):
                missing = have[s].and_not(have[1 - s]).ordinals() - first
                if len(missing):
                    yield out(row[s][missing], name)
            both = have[0].intersect(have[1]).ordinals() - first
            if not len(both):
                continue
            left, right = (rows.take(pa.array(row[s][both])).combine_chunks() for s in (0, 1))
            for name in names:
                unequal = _differs(left.column(f"f_{name}").combine_chunks(), right.column(f"f_{name}").combine_chunks())
                if unequal.any():
                    yield out(row[0][both[unequal]], name)

    return compare


def _rows(df: DataFrame, side: int, key: Column, digests: dict[str, Column], order: Sequence[Column], values: dict[str, Column]) -> DataFrame:
    """``h, side``, the order as ``o0, ...``, ``digest`` and ``values``."""
    ranks = [F.coalesce(o.cast("long"), F.lit(2**63 - 1)).alias(f"o{i}") for i, o in enumerate(order)]
    nulls = sum((c.isNull().cast("long") * (1 << i) for i, c in enumerate(digests.values())), F.lit(0).cast("long"))
    digest = F.xxhash64(nulls, *digests.values()).alias("digest")
    kept = [c.alias(n) for n, c in values.items()]
    return df.filter(key.isNotNull()).select(F.xxhash64(key).alias("h"), F.lit(side).cast("byte").alias("side"), *ranks, digest, *kept)


def _aligned(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Both sides of a key in one partition, in order."""
    rows = rows.mapInArrow(_first_of_batch(key), rows.schema)
    return rows.repartition(*key).sortWithinPartitions(*key, "side", *_rank(rows.columns))


def _among(found: DataFrame, rows: Sequence[DataFrame]) -> list[DataFrame]:
    """Those of ``rows`` whose ``h`` falls into a slot that one of ``found`` takes; no row of theirs is lost.

    The bitmap has some slots a key, up to a bound: beyond it more rows pass, none is lost.
    """
    spark, n = found.sparkSession, found.count()
    slots = min(MOST_SLOTS, max(LEAST_SLOTS, 1 << (SLOTS_A_KEY * n).bit_length()))
    bitmap = np.zeros(slots // 64, np.int64)
    if n <= len(bitmap):  # fewer hashes than words
        slot = found.toArrow().column("h").to_numpy() & (slots - 1)
        np.bitwise_or.at(bitmap, slot >> 6, np.left_shift(1, slot & 63))
    else:
        taken = found.select(F.col("h").bitwiseAND(F.lit(slots - 1).cast("long")).alias("slot")).groupBy(F.shiftright("slot", 6).alias("word"))
        words = taken.agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits")).toArrow()  # a word at most for each 64 slots
        bitmap[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    shared = spark.sparkContext.broadcast(bitmap)

    def passes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column("h").to_numpy() & (slots - 1)
            yield b.filter(pa.array((shared.value[at >> 6] >> (at & 63)) & 1 == 1))

    return [r.mapInArrow(passes, r.schema) for r in rows]


def differences(a: DataFrame, b: DataFrame, key: Column, fields: dict[str, Column], order: Sequence[Column], digests: dict[str, Column] | None = None) -> DataFrame:
    """Rows ``row_key, field``: field is ``only_a``, ``only_b`` or the name of a differing field.

    ``fields`` maps names to the expressions compared; ``digests`` may give a cheaper
    expression for the digest of one (of the same values). ``order``, of numbers, names
    the row that stands for a key.
    """
    digests = fields | (digests or {})
    kind = a.select(key.alias("row_key")).schema["row_key"].dataType.simpleString()
    sides = lambda values: [_rows(x, side, key, digests, order, values) for side, x in enumerate((a, b))]
    brief = sides({"h2": F.xxhash64(F.lit(CONTAINER), key)})
    unlike = materialize(_aligned(brief[0].unionAll(brief[1]), _KEY).mapInArrow(_unlike, "h long"), "unlike")
    few = _among(unlike, sides({"row_key": key, **{f"f_{n}": c for n, c in fields.items()}}))
    return _aligned(few[0].unionAll(few[1]), ("row_key",)).mapInArrow(_compare(list(fields)), f"row_key {kind}, field string")


def normalized_codec(name: str = "codec") -> Column:
    """A codec name without letter case and surrounding blanks."""
    return F.lower(F.trim(F.col(name)))


def object_differences(objects: DataFrame, mirror: DataFrame) -> DataFrame:
    """Differences of the object records of two stores by hash: ``row_key`` (hash), ``field``."""
    fields = {n: F.col(n) for n in ("pack_id", "kind", "size", "stored_size")}
    fields |= {"codec": normalized_codec(), "content": F.sha2("content", 256), "created_at": F.col("created_at")}
    return differences(objects, mirror, F.col("hash"), fields, [F.col("created_at"), F.col("put_seq")], {"content": F.col("content")})


def summary_differences(summaries: DataFrame) -> DataFrame:
    """Differences of the two sides' stored summaries by pack: ``row_key`` (pack_id), ``field``."""
    fields = {n: F.col(n) for n in ("root", "leaf_count")}
    a, b = (summaries.filter(F.col("side") == s) for s in "ab")
    return differences(a, b, F.col("pack_id"), fields, [-F.col("computed_at")])


def found(objects: DataFrame, mirror: DataFrame, summaries: DataFrame) -> DataFrame:
    """All differences of both data sets: ``ds, row_key, field``."""
    with ThreadPoolExecutor(2) as both:  # the two first passes need not wait for each other
        x, y = both.submit(object_differences, objects, mirror), both.submit(summary_differences, summaries)
    x = x.result().select(F.lit("objects").alias("ds"), F.lower(F.hex("row_key")).alias("row_key"), "field")
    y = y.result().select(F.lit("summaries").alias("ds"), F.col("row_key").cast("string").alias("row_key"), "field")
    return x.unionAll(y)


def report(found: DataFrame) -> DataFrame:
    """Number of keys by data set and field: ``ds, field, n``."""
    return found.groupBy("ds", "field").agg(F.count(F.lit(1)).alias("n"))
