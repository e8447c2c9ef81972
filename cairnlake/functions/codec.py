"""Entropy, choice of codec, compression and decompression."""

from __future__ import annotations

import io
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnlake.errors import CompressError, DecompressError, InvalidCodec
from cairnlake.schema import BROTLI, BROTLI_QUALITY, COMPRESSED_EXTENSIONS, ENTROPY_SAMPLE, RAW, RAW_AT, RAW_RATIO, ZSTD, ZSTD_AT, ZSTD_LEVEL


def shannon_entropy(data: bytes) -> float:
    """Bits a byte over the first 64 KiB; 0 for no bytes."""
    sample = np.frombuffer(data, np.uint8, min(len(data), ENTROPY_SAMPLE))
    if not len(sample):
        return 0.0
    share = np.bincount(sample, minlength=256) / len(sample)
    share = share[share > 0]
    return float(-(share * np.log2(share)).sum()) + 0.0


@F.arrow_udf(T.DoubleType())
def entropy(values: pa.Array) -> pa.Array:
    """Entropy of a binary column."""
    return pa.array([None if v is None else shannon_entropy(v) for v in values.to_pylist()], pa.float64())


def is_compressed_extension(column: Column | str) -> Column:
    """Whether a file extension, in any letter case, names a compressed format; null is not."""
    return F.coalesce(F.lower(column).isin(*COMPRESSED_EXTENSIONS), F.lit(False))


def codec_of(bits: Column, extension: Column | None = None) -> Column:
    """The codec for content of this entropy and extension."""
    by_entropy = F.when(bits >= RAW_AT, RAW).when(bits >= ZSTD_AT, ZSTD).otherwise(BROTLI)
    return by_entropy if extension is None else F.when(is_compressed_extension(extension), RAW).otherwise(by_entropy)


def decide_codec(data: bytes, extension: str | None = None) -> str:
    if extension and extension.lower() in COMPRESSED_EXTENSIONS:
        return RAW
    bits = shannon_entropy(data)
    return RAW if bits >= RAW_AT else ZSTD if bits >= ZSTD_AT else BROTLI


@cache
def _zstd() -> zstandard.ZstdCompressor:
    """This worker's compressor: its tables are made once, not for every chunk."""
    return zstandard.ZstdCompressor(level=ZSTD_LEVEL)


@cache
def _unzstd() -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor()


def compress(codec: str, data: bytes) -> bytes:
    try:
        if codec == RAW:
            return data
        if codec == ZSTD:
            return _zstd().compress(data)
        if codec == BROTLI:
            return pa.Codec("brotli", BROTLI_QUALITY).compress(data, asbytes=True)
    except (zstandard.ZstdError, pa.ArrowException, OSError) as e:
        raise CompressError(str(e)) from e
    raise InvalidCodec(codec)


def decompress(codec: str, data: bytes, most: int | None = None) -> bytes:
    """Decoded bytes; with ``most``, one byte more than that at most."""
    try:
        if codec == RAW:
            return data
        if codec == ZSTD:
            with _unzstd().stream_reader(io.BytesIO(data), read_across_frames=True) as r:
                out = r.read() if most is None else r.read(most + 1)
            if most is None and not out and not data:
                raise DecompressError("no frame")
            return out
        if codec == BROTLI:
            with pa.CompressedInputStream(pa.BufferReader(data), "brotli") as r:
                return r.read() if most is None else r.read(most + 1)
    except (zstandard.ZstdError, pa.ArrowException, OSError) as e:
        raise DecompressError(str(e)) from e
    raise InvalidCodec(codec)


def compress_or_raw(codec: str, data: bytes) -> tuple[str, bytes]:
    """Compressed bytes, or the content itself where that saves less than two per cent."""
    if codec == RAW:
        return RAW, data
    packed = compress(codec, data)
    return (RAW, data) if len(packed) / max(1, len(data)) >= RAW_RATIO else (codec, packed)


def compress_auto(data: bytes, extension: str | None = None) -> tuple[str, bytes]:
    return compress_or_raw(decide_codec(data, extension), data)


def brotli_window_bits(first: int) -> int:
    """Window bits declared by the first byte of a Brotli stream; large windows are refused."""
    if not first & 1:
        return 16
    if n := (first >> 1) & 7:
        return 17 + n
    n = (first >> 4) & 7
    if n == 1:
        raise DecompressError("large window")
    return 17 if n == 0 else 8 + n


#: fixed values: dictionary sizes of LZMA streams
DICT_SIZE_MIN, DICT_SIZE_MAX = 4096, 4_294_967_280


def clamp_dict_size(size: str | Column) -> Column:
    """A dictionary size within what LZMA streams allow; null stays null."""
    column = F.col(size) if isinstance(size, str) else size
    bounded = F.greatest(F.least(column.cast("long"), F.lit(DICT_SIZE_MAX)), F.lit(DICT_SIZE_MIN).cast("long"))
    return F.when(column.isNotNull(), bounded)


def window_bits(first: str | Column) -> Column:
    """As :func:`brotli_window_bits`, of a column of first bytes; null where that would raise, or for null."""
    b = F.col(first) if isinstance(first, str) else first
    three, four = F.shiftright(b, 1).bitwiseAND(7), F.shiftright(b, 4).bitwiseAND(7)
    return F.when(b.bitwiseAND(1) == 0, 16).when(three != 0, three + 17).when(four == 0, 17).when(four != 1, four + 8)


_PACKED = T.StructType([T.StructField("codec", T.StringType()), T.StructField("bytes", T.BinaryType()), T.StructField("error_class", T.StringType())])
_ARROW = pa.struct([("codec", pa.string()), ("bytes", pa.binary()), ("error_class", pa.string())])


def _row(run, codec: str | None, data: bytes | None) -> dict | None:
    if data is None:
        return None
    try:
        done, out = run(codec, data)
        return {"codec": done, "bytes": out}
    except (CompressError, DecompressError, InvalidCodec) as e:
        return {"codec": codec, "error_class": type(e).__name__}


@F.arrow_udf(_PACKED)
def compressed(codec: pa.Array, data: pa.Array) -> pa.Array:
    """``struct<codec, bytes, error_class>``; the codec ``auto`` chooses and falls back to raw. Null data gives null."""
    run = lambda c, d: compress_auto(d) if c == "auto" else (c, compress(c, d))
    return pa.array([_row(run, c, d) for c, d in zip(codec.to_pylist(), data.to_pylist())], _ARROW)


@F.arrow_udf(_PACKED)
def decompressed(codec: pa.Array, data: pa.Array) -> pa.Array:
    """``struct<codec, bytes, error_class>`` of stored bytes. Null data gives null."""
    return pa.array([_row(lambda c, d: (c, decompress(c, d)), c, d) for c, d in zip(codec.to_pylist(), data.to_pylist())], _ARROW)
