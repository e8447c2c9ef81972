"""Content-defined chunking.

Normalized chunking after the FastCDC papers (Xia et al. 2016, 2020) with a gear table
made by rule. The gear value at a byte depends on the 64 bytes up to it, so it is
computed for a whole stream by six doubling steps instead of byte by byte; cut points
are then found by binary search among the matching positions.

Promises: chunks are contiguous and cover the stream in order; every chunk but the last
has min <= length <= max; equal bytes give equal cuts; an empty stream has no chunks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlake.errors import InvalidCdcParams
from cairnlake.schema import CDC_AVG, CDC_MAX, CDC_MIN


def _gear_table() -> np.ndarray:
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


GEAR = _gear_table()
REACH = 63  # bytes before a place that its hash mixes
WINDOW = 1 << 20  # bytes hashed at once, at eight bytes of memory each


@dataclass(frozen=True)
class Splitter:
    """Chunk bounds: 0 < min <= avg <= max, all even."""

    min_size: int = CDC_MIN
    avg_size: int = CDC_AVG
    max_size: int = CDC_MAX

    def __post_init__(self) -> None:
        bounds = (self.min_size, self.avg_size, self.max_size)
        if not 0 < self.min_size <= self.avg_size <= self.max_size or any(b % 2 for b in bounds):
            raise InvalidCdcParams(str(bounds))

    def split(self, data: bytes) -> list[tuple[int, int]]:
        """(offset, length) of each chunk."""
        n = len(data)
        if n <= self.min_size:
            return [(0, n)] if n else []
        bits = max(1, int(round(np.log2(self.avg_size))))
        # a harder test before the average, an easier one behind it; the high bits mix the most bytes
        tests = [np.uint64(64 - min(63, b)) for b in (bits + 1, max(1, bits - 1))]
        found: list[list[np.ndarray]] = [[], []]
        whole = np.frombuffer(data, np.uint8)
        for at in range(0, n, WINDOW):
            first = max(0, at - REACH)
            h = GEAR[whole[first : at + WINDOW]]
            for k in (1, 2, 4, 8, 16, 32):
                shifted = h.copy()
                shifted[k:] += h[:-k] << np.uint64(k)
                h = shifted
            h = h[at - first :]
            for places, shift in zip(found, tests):
                places.append(np.flatnonzero(h >> shift == 0) + at)
        hard, easy = (np.concatenate(x) for x in found)
        out, start = [], 0
        while n - start > self.min_size:
            least, usual, most = start + self.min_size, start + self.avg_size, min(n, start + self.max_size)
            end = most
            i = np.searchsorted(hard, least - 1)
            if i < len(hard) and hard[i] + 1 <= min(usual, most):
                end = int(hard[i]) + 1
            else:
                i = np.searchsorted(easy, max(least, usual) - 1)
                if i < len(easy) and easy[i] + 1 <= most:
                    end = int(easy[i]) + 1
            out.append((start, end - start))
            start = end
        if start < n:
            out.append((start, n - start))
        return out


ONE_CHUNK = Splitter(CDC_MAX, CDC_MAX, CDC_MAX)


def chunk_spans(files: DataFrame, splitter: Splitter = Splitter()) -> DataFrame:
    """``file_id, ordinal, offset, length`` of every chunk of ``files`` (file_id, bytes); null bytes have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, spans = b.column("file_id"), [splitter.split(x) if x else [] for x in b.column("bytes").to_pylist()]
            row = np.repeat(np.arange(len(spans)), [len(s) for s in spans])
            flat = [(i, *s) for one in spans for i, s in enumerate(one)]
            ordinal, offset, length = zip(*flat) if flat else ((), (), ())
            yield pa.record_batch([ids.take(pa.array(row, pa.int64())), pa.array(ordinal, pa.int32()), pa.array(offset, pa.int64()), pa.array(length, pa.int64())], names=["file_id", "ordinal", "offset", "length"])

    kind = files.schema["file_id"].dataType.simpleString()
    return files.select("file_id", F.col("bytes").cast("binary").alias("bytes")).mapInArrow(run, f"file_id {kind}, ordinal int, offset long, length long")
