"""Schemas, kinds, codecs, limits and names."""

from __future__ import annotations

import re

from pyspark.sql import types as T

from cairnlake.errors import InvalidConfig

CHUNK, RECIPE = 1, 2
KINDS = {CHUNK: "chunk", RECIPE: "recipe"}

RAW, ZSTD, BROTLI = "raw", "zstd", "brotli"
CODEC_IDS = {RAW: 0, ZSTD: 1, BROTLI: 2}
CODECS = {v: k for k, v in CODEC_IDS.items()}

HASH_BYTES = 32

# fixed values: limits and constants that show in results
CDC_MIN, CDC_AVG, CDC_MAX = 4 << 10, 64 << 10, 4 << 20
ENTROPY_SAMPLE = 64 << 10
RAW_AT, ZSTD_AT = 7.7, 6.9
RAW_RATIO = 0.98
ZSTD_LEVEL, BROTLI_QUALITY = 5, 5
COMPRESSED_EXTENSIONS = ("jpg", "jpeg", "png", "webp", "zip", "epub", "gz", "tgz", "bz2", "xz", "br", "zst", "mp4", "mov")
RECIPE_HEADER, RECIPE_ENTRY = 49, 36
MAX_CHUNKS, MAX_STORED, MAX_ORIGINAL = 1_000_000, 256 << 20, 256 << 20
FRAME = 256 << 10

OBJECTS = T.StructType(
    [
        T.StructField("hash", T.BinaryType()),
        T.StructField("kind", T.IntegerType()),
        T.StructField("size", T.LongType()),
        T.StructField("stored_size", T.LongType()),
        T.StructField("codec", T.StringType()),
        T.StructField("content", T.BinaryType()),
        T.StructField("created_at", T.LongType()),
    ]
)
CACHE = T.StructType([T.StructField("file_hash", T.BinaryType()), T.StructField("recipe_hash", T.BinaryType()), T.StructField("updated_at", T.LongType())])
LEAVES = T.StructType([T.StructField("hash", T.BinaryType()), T.StructField("pos", T.LongType())])
NODES = T.StructType([T.StructField("level", T.LongType()), T.StructField("pos", T.LongType()), T.StructField("hash", T.BinaryType())])
META = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())])


NAMESPACE = "[A-Za-z0-9_]+"


def is_namespace(name):
    """Whether a column's values may name a namespace; null may not."""
    from pyspark.sql import functions as F

    return F.coalesce(F.regexp_like(name, F.lit(f"^{NAMESPACE}\\z")), F.lit(False))


def namespace(name: str | None) -> str:
    """The prefix of a namespace's tables: ASCII letters, digits and underscores; ``None`` has no prefix."""
    if name is None:
        return ""
    if not re.fullmatch(NAMESPACE, name):
        raise InvalidConfig(f"bad namespace: {name!r}")
    return name + "_"
