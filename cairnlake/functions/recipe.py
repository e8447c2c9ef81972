"""Recipe bytes: build, parse, preflight.

All numbers are little-endian. Version 3, the only one written: u8 3, u64 file size,
32 bytes file hash, u16 transform id, u16 transform version, u32 n, then n times 32
bytes chunk hash and u32 length. Versions 1 and 2: u8 version, u64 file size, u32 n, n
entries, 32 bytes file hash, and no transform.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnlake.errors import HashMismatch, InvalidRecipe
from cairnlake.functions.hashing import digest
from cairnlake.schema import HASH_BYTES, RECIPE_ENTRY, RECIPE_HEADER

_V3, _V1 = struct.Struct("<BQ32sHHI"), struct.Struct("<BQI")
_ENTRY = np.dtype([("hash", "V32"), ("len", "<u4")])

_LONG, _INT, _BINARY = T.LongType(), T.IntegerType(), T.BinaryType()
PARSED = T.StructType(
    [
        T.StructField("recipe_version", _INT), T.StructField("original_file_size", _LONG), T.StructField("original_file_hash", _BINARY),
        T.StructField("transform_id", _INT), T.StructField("transform_version", _INT),
        T.StructField("chunks", T.ArrayType(T.StructType([T.StructField("hash", _BINARY), T.StructField("len", _LONG)]))),
        T.StructField("stored_stream_size", _LONG), T.StructField("error_class", T.StringType()), T.StructField("detail", T.StringType()),
    ]
)


@dataclass(frozen=True)
class Recipe:
    version: int
    original_file_size: int
    original_file_hash: bytes
    transform_id: int
    transform_version: int
    chunks: list[tuple[bytes, int]]

    @property
    def stored_stream_size(self) -> int:
        return sum(n for _, n in self.chunks)


def recipe_bytes_len(chunks: Column | int):
    """Size of a version 3 recipe with so many chunks."""
    return chunks * RECIPE_ENTRY + RECIPE_HEADER


def build(size: int, file_hash: bytes, chunks: list[tuple[bytes, int]], transform_id: int = 0, transform_version: int = 0) -> bytes:
    head = _V3.pack(3, size, file_hash, transform_id, transform_version, len(chunks))
    return head + b"".join(h + n.to_bytes(4, "little") for h, n in chunks)


def preflight(data: bytes) -> tuple[int, int]:
    """(file size, chunk count) from the header alone."""
    if not data:
        raise InvalidRecipe("empty recipe")
    at = {1: 9, 2: 9, 3: 45}.get(data[0])
    if len(data) < 9:
        raise InvalidRecipe("recipe too short")
    if at is None:
        raise InvalidRecipe(f"unexpected recipe version {data[0]}")
    if len(data) < at + 4:
        raise InvalidRecipe("recipe too short")
    return int.from_bytes(data[1:9], "little"), int.from_bytes(data[at : at + 4], "little")


def parse(data: bytes, expected: bytes | None = None) -> Recipe:
    """The recipe in these bytes, whose hash must be ``expected`` where that is given."""
    if expected is not None and digest(data) != expected:
        raise HashMismatch("recipe hash mismatch for " + expected.hex())
    if not data:
        raise InvalidRecipe("empty recipe")
    version = data[0]
    if version == 3:
        if len(data) < _V3.size:
            raise InvalidRecipe("recipe too short")
        _, size, file_hash, tid, tver, n = _V3.unpack_from(data)
        at = _V3.size
    elif version in (1, 2):
        if len(data) < _V1.size + HASH_BYTES:
            raise InvalidRecipe("recipe too short")
        _, size, n = _V1.unpack_from(data)
        tid = tver = 0
        at = _V1.size
    else:
        raise InvalidRecipe(f"unexpected recipe version {version}")
    end = at + n * RECIPE_ENTRY
    if len(data) < end:
        raise InvalidRecipe("recipe truncated")
    entries = np.frombuffer(data, _ENTRY, n, at)
    chunks = [(bytes(h), int(k)) for h, k in zip(entries["hash"].tolist(), entries["len"].tolist())]
    if version != 3:
        if len(data) < end + HASH_BYTES:
            raise InvalidRecipe("recipe missing file hash")
        file_hash, end = data[end : end + HASH_BYTES], end + HASH_BYTES
    if end != len(data):
        raise InvalidRecipe("recipe has trailing bytes")
    return Recipe(version, size, file_hash, tid, tver, chunks)


def parsed(data: bytes | None, expected: bytes | None = None) -> dict | None:
    """A row of the parsed column."""
    if data is None:
        return None
    try:
        r = parse(data, expected)
    except (InvalidRecipe, HashMismatch) as e:
        return {"error_class": type(e).__name__, "detail": str(e)}
    return {
        "recipe_version": r.version, "original_file_size": r.original_file_size, "original_file_hash": r.original_file_hash,
        "transform_id": r.transform_id, "transform_version": r.transform_version,
        "chunks": [{"hash": h, "len": n} for h, n in r.chunks], "stored_stream_size": r.stored_stream_size,
    }


_ARROW = pa.struct(
    [
        ("recipe_version", pa.int32()), ("original_file_size", pa.int64()), ("original_file_hash", pa.binary()), ("transform_id", pa.int32()),
        ("transform_version", pa.int32()), ("chunks", pa.list_(pa.struct([("hash", pa.binary()), ("len", pa.int64())]))),
        ("stored_stream_size", pa.int64()), ("error_class", pa.string()), ("detail", pa.string()),
    ]
)


@F.arrow_udf(PARSED)
def parse_recipe(data: pa.Array) -> pa.Array:
    """Parse a column of recipe bytes; malformed ones give ``error_class`` and ``detail``, null gives null."""
    return pa.array([parsed(x) for x in data.to_pylist()], _ARROW)


@F.arrow_udf(PARSED)
def parse_recipe_checked(data: pa.Array, expected: pa.Array) -> pa.Array:
    """As :func:`parse_recipe`, and the bytes must have the expected hash."""
    return pa.array([parsed(x, h) for x, h in zip(data.to_pylist(), expected.to_pylist())], _ARROW)


@F.arrow_udf(T.BinaryType())
def build_recipe(size: pa.Array, file_hash: pa.Array, chunks: pa.Array, transform_id: pa.Array, transform_version: pa.Array) -> pa.Array:
    """Version 3 bytes from columns; ``chunks`` is ``array<struct<hash, len>>`` in order, null is none."""
    rows = zip(*(x.to_pylist() for x in (size, file_hash, chunks, transform_id, transform_version)))
    return pa.array([build(s, h, [(x["hash"], x["len"]) for x in c or []], i, v) for s, h, c, i, v in rows], pa.binary())
