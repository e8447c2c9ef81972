"""Ingest: files to chunk plans, objects and recipes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlake.functions import codec as C
from cairnlake.functions import recipe as R
from cairnlake.functions.chunking import Splitter
from cairnlake.functions.hashing import digest
from cairnlake.schema import CHUNK, RAW, RECIPE

AUTO = "auto"

#: (hash, bytes, extension, policy) -> (codec, stored bytes)
Compressor = Callable[[bytes, bytes, str | None, str], tuple[str, bytes]]


def default_compressor(_hash: bytes, data: bytes, extension: str | None, policy: str) -> tuple[str, bytes]:
    """``auto`` chooses a codec and falls back to raw, a codec name forces that codec."""
    return C.compress_auto(data, extension) if policy == AUTO else (policy, C.compress(policy, data))


@dataclass(frozen=True)
class Config:
    """Splitter, policy (``auto``, ``raw`` or a codec to force) and whether payloads are dropped."""

    splitter: Splitter = field(default_factory=Splitter)
    policy: str = AUTO
    discard_payload: bool = False


_CHUNK = [("hash", pa.binary()), ("raw_len", pa.int64()), ("codec", pa.string()), ("stored_len", pa.int64()), ("payload", pa.binary())]
_PLAN = "struct<hash:binary,raw_len:bigint,codec:string,stored_len:bigint,payload:binary>"
PLANS = (
    "file_id {}, transform_id int, transform_version int, original_size long, original_hash binary, stored_stream_size long,"
    f" estimated_bytes long, recipe_hash binary, recipe binary, chunks array<{_PLAN}>"
)


def plan_stream(stream: bytes, size: int, file_hash: bytes, transform: tuple[int, int], extension: str | None, config: Config, compressor: Compressor) -> dict:
    """The plan of one file whose stored stream is given."""
    extension = extension if transform[0] == 0 else None  # a transformed stream has no format of its own
    chunks = []
    for offset, length in config.splitter.split(stream):
        part = stream[offset : offset + length]
        h = digest(part)
        codec, stored = compressor(h, part, extension, config.policy)
        chunks.append({"hash": h, "raw_len": length, "codec": codec, "stored_len": len(stored), "payload": None if config.discard_payload else stored})
    recipe = R.build(size, file_hash, [(c["hash"], c["raw_len"]) for c in chunks], *transform)
    return {
        "transform_id": transform[0], "transform_version": transform[1], "original_size": size, "original_hash": file_hash, "stored_stream_size": len(stream),
        "estimated_bytes": sum(c["stored_len"] for c in chunks) + len(recipe), "recipe_hash": digest(recipe), "recipe": recipe, "chunks": chunks,
    }


_ARROW = [
    ("transform_id", pa.int32()), ("transform_version", pa.int32()), ("original_size", pa.int64()), ("original_hash", pa.binary()), ("stored_stream_size", pa.int64()),
    ("estimated_bytes", pa.int64()), ("recipe_hash", pa.binary()), ("recipe", pa.binary()), ("chunks", pa.list_(pa.struct(_CHUNK))),
]


def as_batch(ids: pa.Array, plans: list[dict]) -> pa.RecordBatch:
    return pa.record_batch([ids, *(pa.array([p[n] for p in plans], t) for n, t in _ARROW)], names=["file_id", *(n for n, _ in _ARROW)])


BATCH_BYTES = 8 << 20


def planned(batches: Iterator[pa.RecordBatch], plan: Callable[[bytes, str | None], dict]) -> Iterator[pa.RecordBatch]:
    """The plans of all files that have bytes, in batches that hold about 8 MB of files, or one file."""
    for b in batches:
        rows, made, held = [], [], 0
        for i, (data, extension) in enumerate(zip(b.column("bytes"), b.column("extension"))):
            data, extension = data.as_py(), extension.as_py()
            if data is None:
                continue
            rows.append(i)
            made.append(plan(data, extension))
            held += len(data)
            if held >= BATCH_BYTES:
                yield as_batch(b.column("file_id").take(pa.array(rows)), made)
                rows, made, held = [], [], 0
        if rows:
            yield as_batch(b.column("file_id").take(pa.array(rows)), made)


def plan_files(files: DataFrame, config: Config = Config(), compressor: Compressor = default_compressor) -> DataFrame:
    """A plan for each row of ``files`` (file_id, bytes, extension).

    Null bytes are no file and give no plan; no bytes give a plan without chunks.
    """
    plan = lambda data, extension: plan_stream(data, len(data), digest(data), (0, 0), extension, config, compressor)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from planned(batches, plan)

    kind = files.schema["file_id"].dataType.simpleString()
    extension = F.col("extension") if "extension" in files.columns else F.lit(None)
    return files.select("file_id", F.col("bytes").cast("binary").alias("bytes"), extension.cast("string").alias("extension")).mapInArrow(run, PLANS.format(kind))


def chunk_plan(plans: DataFrame) -> DataFrame:
    """One row a chunk: ``file_id, ordinal, hash, raw_len, codec, stored_len, payload``."""
    return plans.select("file_id", F.posexplode("chunks").alias("ordinal", "c")).select("file_id", "ordinal", "c.*")


def plan_objects(plans: DataFrame, created_at: int = 0) -> DataFrame:
    """The chunk and recipe objects of plans in the columns of the object table, with ``input_ordinal`` (file_id, ordinal)."""
    order = lambda n: F.struct("file_id", n.cast("int").alias("ordinal")).alias("input_ordinal")
    at = F.lit(created_at).cast("long").alias("created_at")
    chunks = chunk_plan(plans).select(
        "hash", F.lit(CHUNK).alias("kind"), F.col("raw_len").alias("size"), F.col("stored_len").alias("stored_size"), "codec", F.col("payload").alias("content"), at, order(F.col("ordinal"))
    )
    size = F.octet_length("recipe").cast("long")
    recipes = plans.select(
        F.col("recipe_hash").alias("hash"), F.lit(RECIPE).alias("kind"), size.alias("size"), size.alias("stored_size"), F.lit(RAW).alias("codec"), F.col("recipe").alias("content"), at, order(F.lit(2**31 - 1))
    )
    return chunks.unionAll(recipes)
