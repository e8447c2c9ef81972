"""Exact spans of chunk hashes shared between recipes of different files.

Method: paragraph MinHash banding. A paragraph is a window of 8 consecutive chunk hashes;
every window of every recipe is one, so that a shared run of at least 8 consists of whole
paragraphs wherever it begins. A paragraph's signature is the smallest of several hashes
of its members each; ``ROWS`` of them make a band, and paragraphs of different files that
agree in a band collide. For paragraphs of similarity ``s`` a band of ``r`` rows collides
with probability ``s ** r``, ``b`` bands with ``1 - (1 - s ** r) ** b`` (:func:`recall`).
Shared spans are verbatim, ``s`` is 1, so that one band already has recall 1; its rows
keep paragraphs apart that only share members.

Colliding paragraphs are verified exactly: the members in their order (edit distance 0),
by 128-bit fingerprints of the ordered hashes. A band or fingerprint whose lowest and
highest file differ has several files; these minima and maxima combine before the
exchange, so a paragraph that a third of all recipes contain costs one row per map task,
and no pairs are made. Keys that hold more rows than a partition should are broadcast,
as many as there can be, and met without an exchange.

Recipes that share paragraphs are linked to the lowest recipe that has them; components
of these links are the clusters, in which every copy of a paragraph but the first is
removable.

Defined results:

* a null chunk hash equals other null hashes at its place; shortened hashes are values of
  their own; ``len`` is not compared;
* recipes with fewer than 8 chunks, null or empty chunks share nothing; they are in the
  report with 0 and are clusters of their own;
* a recipe delivered twice is one recipe; a null file hash is a file of its own for each
  recipe_id; rows without recipe_id are skipped;
* empty tables give empty results; further columns are never read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlake.runtime import materialize

SPAN = 8
ROWS = 4  # minima in a band
HEAVY_ROWS = 100_000  # a key of more rows is not left to one task
MOST_HEAVY = 1_000_000  # keys that are broadcast, at most; others then hold less than a millionth of all rows each

_WINDOWS = "recipe_id long, pos int, f1 long, f2 long, band long, a long, b long"


def recall(similarity: float, bands: int, rows: int) -> float:
    """The share of paragraph pairs of a similarity that collide in at least one band."""
    return 1 - (1 - similarity**rows) ** bands


def _factors(span: int, seed: int) -> np.ndarray:
    """Odd weights of the places of a window."""
    x = (np.arange(1, span + 1, dtype=np.uint64) * np.uint64(2 * seed + 1)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _fingerprints(span: int, rows: int) -> Callable:
    weights = [_factors(span, s) for s in (3, 11)]
    seeds = _factors(rows, 23)

    def band(values: np.ndarray, start: np.ndarray) -> np.ndarray:
        """The band of each window: the smallest hash of its members, for each seed."""
        x = np.zeros(len(start), np.uint64)
        for seed in seeds:
            h = _mix((values ^ seed) * seed)
            least = h[start]
            for k in range(1, span):
                np.minimum(least, h[start + k], out=least)
            x = _mix(x * seed + least)
        return x

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first = b.column("c1")
            offsets = first.offsets.to_numpy().astype(np.int64)
            n = np.diff(offsets)
            count = np.maximum(n - span + 1, 0)
            total = int(count.sum())
            if not total:
                continue
            row = np.repeat(np.arange(len(n)), count)
            pos = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
            start = offsets[:-1][row] + pos
            prints = [pa.array(band(b.column("c1").values.to_numpy().view(np.uint64), start).view(np.int64))]
            for name, w in zip(("c1", "c2"), weights):
                c = b.column(name)
                values = c.values.to_numpy().view(np.uint64)
                x = np.zeros(total, np.uint64)
                for k in range(span):
                    x = _mix(x + values[start + k] * w[k])
                prints.append(pa.array(x.view(np.int64)))
            ids = [b.column(x).take(pa.array(row)) for x in ("recipe_id", "f1", "f2")]
            yield pa.record_batch([ids[0], pa.array(pos.astype(np.int32)), ids[1], ids[2], *prints], names=[x.split()[0] for x in _WINDOWS.split(", ")])

    return windows


def windows(recipes: DataFrame, span: int = SPAN, rows: int = ROWS) -> DataFrame:
    """Every window of ``span`` entries: ``recipe_id, pos, f1, f2`` (file), ``band``, ``a, b`` (fingerprint)."""
    file = lambda seed: F.when(F.col("original_file_hash").isNull(), F.xxhash64("recipe_id", F.lit(seed + 100))).otherwise(F.xxhash64("original_file_hash", F.lit(seed)))
    hashed = lambda seed: F.transform("chunks", lambda c: F.xxhash64(c["hash"], F.lit(seed)))
    long = recipes.filter((F.size("chunks") >= span) & F.col("recipe_id").isNotNull())
    long = long.select("recipe_id", file(1).alias("f1"), file(2).alias("f2"), hashed(1).alias("c1"), hashed(2).alias("c2"))
    return long.mapInArrow(_fingerprints(span, rows), _WINDOWS)


def _of_several_files(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that rows of at least two files have, and their number of rows ``n``."""
    files = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("f1").alias("l1"), F.max("f1").alias("h1"), F.min("f2").alias("l2"), F.max("f2").alias("h2"))
    return files.filter("l1 <> h1 or l2 <> h2").select(*keys, "n")


def _with_key(rows: DataFrame, keys: DataFrame, on: list[str], total: int) -> DataFrame:
    """The rows whose key is among ``keys``; those of many rows are few, and broadcast."""
    many = max(HEAVY_ROWS, total // MOST_HEAVY)
    heavy = keys.filter(F.col("n") > many).select(*on)
    rare = keys.filter(F.col("n") <= many).select(*on)
    return rows.join(F.broadcast(heavy), on, "left_semi").unionAll(rows.join(rare, on, "left_semi"))


def shared_windows(recipes: DataFrame, span: int = SPAN) -> DataFrame:
    """Windows that occur in recipes of at least two files: ``recipe_id, pos, a, b``, repetitions possible."""
    every = materialize(windows(recipes, span), "windows")
    colliding = materialize(_of_several_files(every, ["band"]), "bands")
    candidates = materialize(_with_key(every, colliding, ["band"], every.count()), "candidates")  # counts come from the files' footers
    equal = materialize(_of_several_files(candidates, ["a", "b"]), "shared")
    return _with_key(candidates, equal, ["a", "b"], candidates.count()).select("recipe_id", "pos", "a", "b")


def covered(shared: DataFrame, span: int = SPAN) -> DataFrame:
    """Maximal shared spans: ``recipe_id, start, stop`` (exclusive).

    Gaps and islands over a recipe's windows; a recipe's windows are bounded by its length.
    """
    from pyspark.sql import Window

    one = shared.select("recipe_id", "pos").distinct()
    along = Window.partitionBy("recipe_id").orderBy("pos")
    apart = (F.col("pos") - F.lag("pos").over(along) > span).cast("int")
    islands = one.withColumn("apart", F.coalesce(apart, F.lit(1))).withColumn("island", F.sum("apart").over(along))
    return islands.groupBy("recipe_id", "island").agg(F.min("pos").alias("start"), (F.max("pos") + span).alias("stop")).drop("island")


def found(spans: DataFrame) -> DataFrame:
    """Every position inside a shared span: ``recipe_id, pos``."""
    inside = F.sequence(F.col("start").cast("long"), F.col("stop").cast("long") - 1)
    return spans.select("recipe_id", F.explode(inside).alias("pos"))


def report(recipes: DataFrame, spans: DataFrame) -> DataFrame:
    """For every recipe ``recipe_id, chunks, shared, spans, share``: how much of it other files share."""
    sizes = recipes.filter("recipe_id is not null").groupBy("recipe_id").agg(F.max(F.greatest(F.size("chunks"), F.lit(0))).cast("long").alias("chunks"))
    mine = spans.groupBy("recipe_id").agg(F.sum(F.col("stop") - F.col("start")).alias("shared"), F.count(F.lit(1)).alias("spans"))
    joined = sizes.join(mine, "recipe_id", "left")
    shared = F.coalesce("shared", F.lit(0))
    return joined.select(
        "recipe_id", "chunks", shared.alias("shared"), F.coalesce("spans", F.lit(0)).alias("spans"),
        F.when(F.col("chunks") > 0, F.round(shared / F.col("chunks"), 6)).otherwise(F.lit(0.0)).alias("share"),
    )


def components(links: DataFrame) -> DataFrame:
    """``id, label``: the smallest id of the component of each end of the links ``u, v``, written.

    Each round gives every id the smallest label of its neighbours and then that label's
    own; the labels fall along chains of ids by doubling steps.
    """
    links = materialize(links.distinct(), "links")
    both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    labels = materialize(both.select(F.col("u").alias("id"), F.least("u", "v").alias("label")).groupBy("id").agg(F.min("label").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("v"), "label"), "v").select(F.col("u").alias("id"), "label").unionAll(labels)
        least = near.groupBy("id").agg(F.min("label").alias("label"))
        own = labels.select(F.col("id").alias("label"), F.col("label").alias("of"))
        jumped = least.join(own, "label", "left").select("id", F.least("label", F.coalesce("of", "label")).alias("label"))
        moved = materialize(jumped.join(labels.withColumnRenamed("label", "old"), "id").select("id", "label", (F.col("label") < F.col("old")).alias("moved")), "labels")
        if moved.filter("moved").isEmpty():
            return labels
        labels = moved.select("id", "label")


def clusters(recipes: DataFrame, shared: DataFrame, span: int = SPAN) -> DataFrame:
    """One row a recipe: ``recipe_id, cluster`` (smallest recipe_id of its component), ``links`` (different paragraphs
    shared with other files), ``removable`` (positions that lie in a copy of a paragraph another place has first).

    The first place of a paragraph is the lowest (recipe_id, position).
    """
    once = materialize(shared.distinct(), "once")
    first = once.groupBy("a", "b").agg(F.min("recipe_id").alias("lead"))
    place = once.groupBy("a", "b", "recipe_id").agg(F.min("pos").alias("first_pos"))
    heads = place.join(first.select("a", "b", "lead"), ["a", "b"])
    ids = components(heads.filter(F.col("recipe_id") > F.col("lead")).select(F.col("recipe_id").alias("u"), F.col("lead").alias("v")))
    linked = heads.groupBy("recipe_id").agg(F.count(F.lit(1)).alias("links"))
    copies = once.join(heads, ["a", "b", "recipe_id"]).filter((F.col("recipe_id") > F.col("lead")) | (F.col("pos") > F.col("first_pos")))
    gone = covered(copies.select("recipe_id", "pos"), span).groupBy("recipe_id").agg(F.sum(F.col("stop") - F.col("start")).cast("long").alias("removable"))
    every = recipes.select("recipe_id").filter("recipe_id is not null").distinct()
    rows = every.join(ids.withColumnRenamed("id", "recipe_id"), "recipe_id", "left").join(linked, "recipe_id", "left").join(gone, "recipe_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return rows.select("recipe_id", F.coalesce("label", "recipe_id").alias("cluster"), zero("links"), zero("removable"))
