"""SHA3-256 and hexadecimal text as columns. Null stays null."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnlake.errors import InvalidHashLength, InvalidHex
from cairnlake.schema import HASH_BYTES


def digest(data: bytes) -> bytes:
    return hashlib.sha3_256(data).digest()


def digest_reader(reader, buffer: int = 8192) -> bytes:
    """The digest of what a file object still holds, read piece by piece."""
    h = hashlib.sha3_256()
    while part := reader.read(buffer):
        h.update(part)
    return h.digest()


@F.arrow_udf(T.BinaryType())
def _sha3(values: pa.Array) -> pa.Array:
    sha3 = hashlib.sha3_256
    return pa.array([None if v is None else sha3(v).digest() for v in values.to_pylist()], pa.binary())


def sha3_256(column: Column | str) -> Column:
    """SHA3-256 of a binary column; one Arrow batch at a time, since Spark has no built-in."""
    return _sha3(column)


def hash_pair(left: Column | str, right: Column | str) -> Column:
    """The parent of two Merkle nodes."""
    return _sha3(F.concat(left, right))


def to_hex(column: Column | str) -> Column:
    return F.lower(F.hex(column))


def parse_hex(column: Column | str) -> Column:
    """``struct<hash binary, error_class string>`` of a text in either letter case."""
    c = F.col(column) if isinstance(column, str) else column
    ok = c.rlike("^([0-9a-fA-F]{2})*$")
    value = F.when(ok, F.unhex(c))
    error = F.when(c.isNull(), None).when(~ok, InvalidHex.__name__).when(F.octet_length(value) != HASH_BYTES, InvalidHashLength.__name__)
    return F.struct(F.when(error.isNull(), value).alias("hash"), error.alias("error_class"))


def is_hash(column: Column | str) -> Column:
    return F.octet_length(column) == HASH_BYTES
