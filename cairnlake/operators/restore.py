"""Restore files from recipes and chunks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlake import errors, schema
from cairnlake.functions import recipe as R
from cairnlake.functions.hashing import digest
from cairnlake.operators.pipeline import BATCH_BYTES
from cairnlake.operators.store import verify
from cairnlake.operators.transforms import Registry
from cairnlake.runtime import materialize
from cairnlake.sources.paths import write_file

ENTRIES_A_PART = 10_000


@dataclass(frozen=True)
class Limits:
    """Most chunks, stored bytes and original bytes of one file."""

    chunks: int = schema.MAX_CHUNKS
    stored: int = schema.MAX_STORED
    original: int = schema.MAX_ORIGINAL


def _load(data: bytes | None, hash_: bytes, kind: int | None, error: str | None, limits: Limits) -> dict:
    """Header and entries of one recipe, or its first failing check in the order kind, chunk count, file size, bytes, stored size."""
    try:
        if kind is None:
            raise errors.ObjectNotFound
        if error:
            return {"error_class": error}
        if kind != schema.RECIPE:
            raise errors.ObjectKindMismatch
        size, count = R.preflight(data)
        if count > limits.chunks:
            raise errors.FileReadLimitExceeded("chunk count")
        if size > limits.original:
            raise errors.FileReadLimitExceeded("original file bytes")
        row = R.parsed(data, hash_)
        if row.get("error_class"):
            return {"error_class": errors.InvalidRecipe.__name__}
        if row["stored_stream_size"] > limits.stored:
            raise errors.FileReadLimitExceeded("stored stream bytes")
        return row
    except errors.LakeError as e:
        return {"error_class": type(e).__name__}


def load_recipes(wanted: DataFrame, objects: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``recipe_hash, r`` (parsed, with ``error_class``) for each distinct wanted recipe hash."""

    @F.arrow_udf(R.PARSED)
    def load(data: pa.Array, hash_: pa.Array, kind: pa.Array, error: pa.Array) -> pa.Array:
        return pa.array([_load(*r, limits) for r in zip(*(x.to_pylist() for x in (data, hash_, kind, error)))], R._ARROW)

    asked = wanted.select("recipe_hash").filter("recipe_hash is not null").distinct()
    read = verify(objects.join(asked.select(F.col("recipe_hash").alias("hash")), "hash", "left_semi"))
    joined = asked.join(read.withColumnRenamed("hash", "recipe_hash"), "recipe_hash", "left")
    return joined.select("recipe_hash", load("bytes", "recipe_hash", "kind", "error_class").alias("r"))


_RESTORED = "recipe_hash binary, bytes binary, error_class string"


def read_stored_streams(wanted: DataFrame, objects: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``recipe_hash, bytes, error_class``: the stored stream of each distinct wanted recipe, before any decoder."""
    loaded, parts = _parts(wanted, objects, limits)
    return _finished(loaded, parts, None)


def _with_content(entries: DataFrame, objects: DataFrame) -> DataFrame:
    """``entries`` with ``kind, bytes, object_error`` of their chunks.

    A chunk in many entries would bring its content so many times into one task: its
    entries are spread over as many parts as they fill by ``ENTRIES_A_PART``, and each
    part gets the content once. The counts come from the entries, before content is read.
    """
    counts = materialize(entries.groupBy("hash").agg(F.count(F.lit(1)).alias("n")), "uses")
    parts = F.ceil(F.col("n") / ENTRIES_A_PART).cast("int")
    used = counts.select("hash", parts.alias("parts"))
    read = verify(objects.join(used.select("hash"), "hash", "left_semi")).select("hash", "kind", "bytes", F.col("error_class").alias("object_error"))
    hot = used.filter("parts > 1")  # each has more than ENTRIES_A_PART entries
    if hot.isEmpty():
        return entries.join(read, "hash", "left")
    many = _in_parts(entries, hot)
    copies = read.join(hot, "hash", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("parts") - 1, F.lit(0)).cast("long")))).drop("parts")
    return many.join(copies, ["hash", "part"], "left").drop("part")


def _in_parts(entries: DataFrame, hot: DataFrame) -> DataFrame:
    """``entries`` with the ``part`` of their chunk's entries that each belongs to; ``hot`` has hashes and their ``parts``."""
    spread = F.pmod(F.xxhash64("recipe_hash", "ordinal"), F.col("parts").cast("long"))
    return entries.join(hot, "hash", "left").withColumn("part", F.coalesce(spread, F.lit(0).cast("long"))).drop("parts")


def _parts(wanted: DataFrame, objects: DataFrame, limits: Limits) -> tuple[DataFrame, DataFrame]:
    """The wanted recipes, and ``recipe_hash, parts``: the content of their chunks in order, or what is wrong with them."""
    loaded = load_recipes(wanted, objects, limits)
    entries = loaded.filter("r.error_class is null").select("recipe_hash", F.posexplode("r.chunks").alias("ordinal", "c")).select("recipe_hash", "ordinal", "c.hash", "c.len")
    joined = _with_content(materialize(entries, "entries"), objects)
    error = (
        F.when(F.col("kind").isNull(), errors.ObjectNotFound.__name__)
        .when(F.col("object_error").isNotNull(), F.col("object_error"))
        .when(F.col("kind") != schema.CHUNK, errors.ObjectKindMismatch.__name__)
        .when(F.octet_length("bytes") != F.col("len"), errors.RecipeChunkLengthMismatch.__name__)
    )
    part = F.struct("ordinal", error.alias("error_class"), F.when(error.isNull(), F.col("bytes")).alias("bytes"))
    return loaded, joined.groupBy("recipe_hash").agg(F.sort_array(F.collect_list(part)).alias("parts"))


def restore(wanted: DataFrame, objects: DataFrame, registry: Registry | None = None, limits: Limits = Limits()) -> DataFrame:
    """``recipe_hash, bytes, error_class``: the original bytes of each distinct wanted recipe.

    Hashes are resolved against records first; chunk contents join last, and one file's
    chunks meet in one row, which the limits bound. A chunk's kind is checked before its
    length; the decoder is looked up after the chunks, and stops where its output is
    longer than the file.
    """
    loaded, parts = _parts(wanted, objects, limits)
    return _finished(loaded, parts, registry or Registry())


def _finished(loaded: DataFrame, parts: DataFrame, registry: Registry | None) -> DataFrame:
    """The restored files, or without a registry their stored streams."""
    rows = loaded.join(parts, "recipe_hash", "left").select("recipe_hash", "r.error_class", "r.original_file_size", "r.original_file_hash", "r.transform_id", "r.transform_version", "parts")

    def finish(error_class, size, file_hash, tid, tver, parts):
        if error_class:
            return None, error_class
        for p in parts or ():
            if p["error_class"]:
                return None, p["error_class"]
        try:
            stored = [p["bytes"] for p in parts or ()]
            if registry is None:
                return b"".join(stored), None
            registry.decoder(tid, tver)
            try:
                data = registry.decode(tid, tver, b"".join(stored), size)
            except Exception as e:
                raise errors.OriginalFileMismatch from e
            if len(data) != size or digest(data) != file_hash:
                raise errors.OriginalFileMismatch
            return data, None
        except errors.LakeError as e:
            return None, type(e).__name__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            start, data, failed, held = 0, [], [], 0
            for i in range(b.num_rows):
                one, error = finish(*(b.column(c)[i].as_py() for c in b.schema.names[1:]))
                data.append(one)
                failed.append(error)
                held += len(one or b"")
                if held >= BATCH_BYTES or i == b.num_rows - 1:  # never many large files at once
                    yield pa.record_batch([b.column(0).slice(start, len(data)), pa.array(data, pa.binary()), pa.array(failed, pa.string())], names=["recipe_hash", "bytes", "error_class"])
                    start, data, failed, held = i + 1, [], [], 0

    return rows.mapInArrow(run, _RESTORED)


def write_files(restored: DataFrame, folder: str) -> DataFrame:
    """Write restored files to ``folder`` (shared by all executors), named by recipe hash; returns ``recipe_hash, path``.

    Each file is written under another name first and then renamed, so none is ever partial.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths = [write_file(f"{folder.rstrip('/')}/{h.hex()}", data.as_py()) for h, data in zip(b.column("recipe_hash").to_pylist(), b.column("bytes"))]
            yield pa.record_batch([b.column("recipe_hash"), pa.array(paths, pa.string())], names=["recipe_hash", "path"])

    return restored.filter("error_class is null").select("recipe_hash", "bytes").mapInArrow(run, "recipe_hash binary, path string")
