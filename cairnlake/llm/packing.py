"""Filling containers of fixed capacity with texts.

Method: the plan is made over the histogram of sizes, not over documents. Sizes go from
large to small; all items of one size are placed at once into the open containers with
the least room that still fits, then into new ones. A step of the plan is a row (size,
first rank, count, first container, offset): items of that size with ranks from .. take
the containers from .. one each. The histogram has at most one row a size, so the plan
depends on the capacity and not on the number of documents. Documents get their rank
within their size from the rank inside their partition and the counts of the partitions
before it, and look their slot up in the plan. The counts, one a partition and size, are
broadcast while they are few (``MOST_COUNTS``), so that no document moves; beyond that
documents (their sizes, not their texts) are joined with them by an exchange.

Defined results:

* a text of more than the capacity is cut into full containers and one rest, which is
  packed like any other item; no other text is split;
* null and empty texts take no container: one row with null container, piece 0 and 0 tokens;
* repeated rows are packed as often as they occur; equal sizes are interchangeable;
* an empty table gives an empty result; further columns are never read.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnlake.llm.batches import by_text
from cairnlake.llm.tokens import VOCABULARY, encoder
from cairnlake.runtime import materialize, spread

CAPACITY = 2048
MOST_COUNTS = 250_000  # 10 MB

_SIZED = "doc_id {}, tokens long, size int, pid int, rank long, full_before long"
_PLACED = "doc_id {}, piece int, container long, start long, tokens long, offset int"


def sized(documents: DataFrame, capacity: int = CAPACITY, path: str = VOCABULARY) -> DataFrame:
    """Sizes in tokens, written.

    ``size`` is that of the item to pack (the rest of a longer text, 0 if there is none),
    ``rank`` its rank among the items of this size in partition ``pid``, ``full_before`` the
    number of full containers that documents before it in the partition take.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid, e = TaskContext.get().partitionId(), encoder(path)
        met, full = np.zeros(capacity + 1, np.int64), 0
        for b in by_text(batches):
            tokens = e.sizes(b.column("text").to_pylist())
            size = np.where(tokens <= capacity, tokens, tokens % capacity)
            whole = np.where(tokens <= capacity, 0, tokens // capacity)
            order = np.argsort(size, kind="stable")
            s = size[order]
            new = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.zeros(0, bool)
            head = np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))
            rank = np.empty(len(s), np.int64)
            rank[order] = met[s] + np.arange(len(s)) - head
            met += np.bincount(size, minlength=capacity + 1)
            before = full + np.cumsum(whole) - whole
            full += int(whole.sum())
            columns = [pa.array(tokens.astype(np.int64)), pa.array(size.astype(np.int32)), pa.array(np.full(len(s), pid, np.int32)), pa.array(rank), pa.array(before.astype(np.int64))]
            yield pa.record_batch([b.column("doc_id"), *columns], names=["doc_id", "tokens", "size", "pid", "rank", "full_before"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = spread(documents.select("doc_id", F.col("text").cast("string").alias("text"))).mapInArrow(run, _SIZED.format(kind))
    return materialize(rows, "sizes")


def best_fit(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """The plan: steps (size, first rank, count, first container, offset), and the number of containers."""
    steps: list[tuple[int, int, int, int, int]] = []
    open_: dict[int, list[tuple[int, int]]] = {}  # room: ranges (first container, count)
    rooms: list[int] = []
    used = 0

    def keep(room: int, first: int, count: int) -> None:
        if room > 0 and count:
            if room not in open_:
                open_[room] = []
                insort(rooms, room)
            open_[room].append((first, count))

    for size in sorted((s for s, n in histogram.items() if s > 0 and n > 0), reverse=True):
        left, rank = histogram[size], 0

        def fill(first: int, count: int, room: int) -> None:
            """Put items into each of these containers, as many as fit or are left."""
            nonlocal left, rank
            each = room // size  # noqa: B023
            whole = min(count, left // each)
            for k in range(each if whole else 0):
                steps.append((size, rank, whole, first, capacity - room + k * size))  # noqa: B023
                rank += whole
            left -= whole * each
            keep(room - each * size, first, whole)  # noqa: B023
            if whole < count and left:
                for k in range(left):
                    steps.append((size, rank, 1, first + whole, capacity - room + k * size))  # noqa: B023
                    rank += 1
                keep(room - left * size, first + whole, 1)  # noqa: B023
                whole, left = whole + 1, 0
            keep(room, first + whole, count - whole)

        while left:
            i = bisect_left(rooms, size)
            if i == len(rooms):
                need = -(-left // (capacity // size))
                first, used = used, used + need
                fill(first, need, capacity)
                continue
            room = rooms[i]
            first, count = open_[room].pop()
            if not open_[room]:
                del open_[room], rooms[i]
            fill(first, count, room)
    return steps, used


def _place(plan, capacity: int, total: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds, ranks, counts, firsts, offsets = plan.value
        for b in batches:
            tokens, size, rank, full_rank = (b.column(x).to_numpy() for x in ("tokens", "size", "place", "full_place"))
            whole = np.where(tokens > capacity, tokens // capacity, 0)
            rows = np.where((size > 0) | (tokens == 0), whole + 1, whole)
            row = np.repeat(np.arange(len(rows)), rows)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(rows) - rows, rows)
            is_full = piece < whole[row]
            container, offset = total + full_rank[row] + piece, np.zeros(len(row), np.int64)
            item = ~is_full & (tokens[row] > 0)
            s, r = size[row][item], rank[row][item]
            step = np.empty(len(s), np.int64)
            for one in np.unique(s):  # at most one pass a size
                at = s == one
                lo, hi = bounds[one], bounds[one + 1]
                step[at] = lo + np.searchsorted(ranks[lo:hi], r[at], side="right") - 1
            container[item] = firsts[step] + r - ranks[step]
            offset[item] = offsets[step]
            held = np.where(is_full, capacity, size[row])
            none = tokens[row] == 0
            yield pa.record_batch(
                [
                    b.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(container, mask=none),
                    pa.array(piece.astype(np.int64) * capacity), pa.array(held.astype(np.int64)), pa.array(offset.astype(np.int32), mask=none),
                ],
                names=["doc_id", "piece", "container", "start", "tokens", "offset"],
            )

    return run


def pack(sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, container, start, tokens, offset`` for every document.

    ``start`` is the piece's first token in the text, ``offset`` its first token in the container.
    """
    spark = sizes.sparkSession
    # one row a size: at most capacity + 1
    rows = sizes.groupBy("size").agg(F.count(F.lit(1)).alias("n"), F.max("pid").alias("last")).collect()
    histogram = {r["size"]: r["n"] for r in rows}
    most_counts = len(rows) * (max((r["last"] for r in rows), default=0) + 1)
    steps, total = best_fit(histogram, capacity)
    columns = np.array(sorted(steps), np.int64).reshape(-1, 5)
    bounds = np.searchsorted(columns[:, 0], np.arange(capacity + 2))
    plan = spark.sparkContext.broadcast((bounds, *(columns[:, i].copy() for i in range(1, 5))))
    # counts of the partitions before: a row for each partition and size it has
    along = Window.partitionBy("size").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    counts = sizes.groupBy("size", "pid").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select("size", "pid", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("ranks_before"))
    whole = F.when(F.col("tokens") > capacity, F.floor(F.col("tokens") / capacity)).otherwise(0)
    fulls = sizes.groupBy("pid").agg(F.sum(whole).cast("long").alias("n"))
    over = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    fulls = fulls.select("pid", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("fulls_before"))
    if most_counts <= MOST_COUNTS:
        counts, fulls = F.broadcast(counts), F.broadcast(fulls)  # no more partitions than counts
    placed = sizes.join(counts, ["size", "pid"]).join(fulls, "pid")
    placed = placed.select("doc_id", "tokens", "size", (F.col("rank") + F.col("ranks_before")).alias("place"), (F.col("full_before") + F.col("fulls_before")).alias("full_place"))
    return placed.mapInArrow(_place(plan, capacity, total), _PLACED.format(sizes.schema["doc_id"].dataType.simpleString()))


def report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens held, room left, and the share of the room left."""
    used = packed.agg(F.count_distinct("container").alias("containers"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
    room = F.col("containers") * capacity - F.col("tokens")
    share = F.when(F.col("containers") > 0, F.round(room / (F.col("containers") * capacity), 6)).otherwise(F.lit(0.0))
    return used.select("containers", "tokens", room.alias("room"), share.alias("room_share"))


def audit(packed: DataFrame, documents: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: documents, ``unplaced`` ones without a container, and what must not be: ``lost`` documents, ``overlapping`` of pieces,
    pieces that are ``overfull``, ``split_small`` documents that fit, ``unfilled`` pieces before the last of their text.

    A container holds at most ``capacity`` pieces.
    """
    here = Window.partitionBy("container").orderBy("offset", "doc_id", "piece")
    ends = packed.filter("container is not null").withColumn("before", F.lag(F.col("offset") + F.col("tokens")).over(here))
    no = lambda c: F.coalesce(c, F.lit(False))
    bad = ends.agg(F.count_if(no(F.col("before") > F.col("offset"))).alias("overlapping"), F.count_if(F.col("offset") + F.col("tokens") > capacity).alias("overfull"))
    per = packed.groupBy("doc_id").agg(F.sum("tokens").alias("n"), F.count(F.lit(1)).alias("pieces"), F.count_if(F.col("container").isNull()).alias("unplaced"), F.count_if(F.col("tokens") == capacity).alias("full"))
    rows = documents.select("doc_id", (F.coalesce(F.length("text"), F.lit(0)) == 0).alias("empty")).join(per, "doc_id", "left")
    lost = F.col("n").isNull() | (F.col("empty") != (F.col("unplaced") > 0))
    of_docs = rows.agg(
        F.count(F.lit(1)).alias("documents"), F.count_if("empty").alias("unplaced"), F.count_if(lost).alias("lost"), F.count_if(no((F.col("n") <= capacity) & (F.col("pieces") > 1))).alias("split_small"),
        F.count_if(no(F.col("full") < F.col("pieces") - 1)).alias("unfilled"),
    )
    zero = F.lit(0).cast("long")
    both = of_docs.select("documents", "unplaced", "lost", zero.alias("overlapping"), zero.alias("overfull"), "split_small", "unfilled")
    both = both.unionAll(bad.select(zero, zero, zero, "overlapping", "overfull", zero, zero))
    return both.agg(*[F.sum(c).alias(c) for c in both.columns])
