"""Reversible transforms: registry and selection.

A decoder has an id and a version and is found by both, never by one alone. Selection
tries every enabled candidate on one file inside one call: encode, decode, compare,
estimate; the smallest estimate wins where it saves enough, of equal ones the earliest.
"""

from __future__ import annotations

import lzma
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlake.errors import DuplicateTransformDecoder, FileReadLimitExceeded, LakeError, UnsupportedTransform
from cairnlake.functions.batches import by_bytes
from cairnlake.functions.hashing import digest
from cairnlake.functions.spool import Spool
from cairnlake.operators import pipeline as P

NONE = (0, 0)
#: ids of other implementations, which decode only where their decoder is registered
RESERVED = range(1, 4)
OWN_FIRST_ID = 1000

OUTCOMES = ("Skipped", "BufferUnavailable", "EncodeFailed", "DecodeFailed", "VerificationFailed", "EvaluationFailed", "InsufficientGain", "LargerCandidate", "Selected")

# fixed values: the smallest file worth a try, and the extensions of formats that hold compressed data
MIN_SIZE = 32 << 10
ALLOWED_EXTENSIONS = ("png", "zip", "gz", "pdf", "docx", "xlsx", "pptx", "svgz")

# fixed values: what known container formats begin with
MAGIC = (b"\x89PNG\r\n\x1a\n", b"\x1f\x8b", b"PK\x03\x04", b"%PDF", b"UnityFS\x00")


@dataclass(frozen=True)
class Transform:
    """``encode`` and ``decode`` are functions from bytes to bytes."""

    id: int
    version: int
    name: str
    encode: Callable[[bytes], bytes]
    decode: Callable[[bytes], bytes]
    enabled: bool = True
    selectable: bool = True
    quick_check: Callable[[int, str | None, bytes], bool] | None = None
    #: decodes no more than so many bytes, raising beyond them
    decode_within: Callable[[bytes, int], bytes] | None = None


class Registry:
    """Decoders by (id, version); (0, 0) is the identity and always there."""

    def __init__(self, transforms: tuple[Transform, ...] = ()):
        self.decoders: dict[tuple[int, int], Callable[[bytes], bytes]] = {NONE: lambda data: data}
        self.within: dict[tuple[int, int], Callable[[bytes, int], bytes]] = {}
        for t in transforms:
            if (t.id, t.version) in self.decoders:
                raise DuplicateTransformDecoder(f"{t.id} version {t.version}")
            self.decoders[t.id, t.version] = t.decode
            if t.decode_within is not None:
                self.within[t.id, t.version] = t.decode_within

    def decoder(self, id_: int, version: int) -> Callable[[bytes], bytes]:
        try:
            return self.decoders[id_, version]
        except KeyError:
            raise UnsupportedTransform(f"{id_} version {version}") from None


    def decode(self, id_: int, version: int, data: bytes, most: int) -> bytes:
        """Decoded bytes; ``FileReadLimitExceeded`` where they are more than ``most``. A decoder that can stops there."""
        decoder = self.decoder(id_, version)
        within = self.within.get((id_, version))
        out = decoder(data) if within is None else within(data, most)
        if len(out) > most:
            raise FileReadLimitExceeded("decoded bytes")
        return out


def _no_more(out: bytes, most: int) -> bytes:
    if len(out) > most:
        raise FileReadLimitExceeded("decoded bytes")
    return out


def _unzstd_within(data: bytes, most: int) -> bytes:
    with zstandard.ZstdDecompressor().stream_reader(data) as r:
        return _no_more(r.read(most + 1), most)


def _unlzma_within(data: bytes, most: int) -> bytes:
    return _no_more(lzma.LZMADecompressor().decompress(data, most + 1), most)


def _inflate(data: bytes) -> bytes:
    """A zlib stream unpacked, where packing again gives the same bytes."""
    plain = zlib.decompress(data)
    for level in (6, 9, 1):
        if zlib.compress(plain, level) == data:
            return bytes([level]) + plain
    raise ValueError("not reproducible")


OWN = (
    Transform(OWN_FIRST_ID, 1, "inflate", _inflate, lambda d: zlib.compress(d[1:], d[0])),
    Transform(OWN_FIRST_ID + 1, 1, "zstd-long", lambda d: zstandard.ZstdCompressor(level=6).compress(d), lambda d: zstandard.ZstdDecompressor().decompress(d), decode_within=_unzstd_within),
    Transform(OWN_FIRST_ID + 2, 1, "lzma", lambda d: lzma.compress(d, preset=6), lzma.decompress, decode_within=_unlzma_within),
)


@dataclass(frozen=True)
class Selection:
    """Bounds of the selection.

    Files under ``min_size`` or over ``max_size``, or whose extension is not in
    ``allow_ext`` while they begin like no known container, are not tried; ``allow_ext``
    of ``None`` allows all. ``min_gain`` is the share to save. Streams of more than
    ``max_in_memory`` bytes go to files in ``spill_folder``, which all executors share;
    without one such files are not tried.
    """

    enabled: bool = True
    min_gain: float = 0.01
    min_size: int = MIN_SIZE
    max_size: int = 1 << 30
    allow_ext: tuple[str, ...] | None = ALLOWED_EXTENSIONS
    max_in_memory: int = 100 << 20
    spill_folder: str | None = None
    pipeline: P.Config = field(default_factory=P.Config)


def gated(size: int, extension: str | None, head: bytes, bounds: Selection) -> bool:
    """Whether a file is worth a try; the same as :func:`gate` for one file."""
    if not bounds.min_size <= size <= bounds.max_size:
        return False
    return bounds.allow_ext is None or (extension is not None and extension.lower() in bounds.allow_ext) or head.startswith(MAGIC)


@dataclass(frozen=True)
class Selected:
    """What became of one file: transform, stored stream, its plan, and a report row for each candidate."""

    transform: tuple[int, int]
    stream: Spool
    plan: dict
    report: list[dict]


def select(data: bytes, extension: str | None, transforms: tuple[Transform, ...], bounds: Selection, compressor: P.Compressor = P.default_compressor) -> Selected:
    """The smallest of one file's candidates, or the file as it is.

    A candidate's failure is an outcome and never raises; the baseline's failure does.
    Each stream is encoded and planned once: the winner's plan is the file's.
    """
    spool = lambda stream: Spool(stream, bounds.max_in_memory, bounds.spill_folder)
    file_hash = digest(data)
    plan = lambda stream, chosen, ext: P.plan_stream(stream, len(data), file_hash, chosen, ext, bounds.pipeline, compressor)
    candidates = [t for t in transforms if t.selectable and t.enabled]
    baseline = plan(data, NONE, extension)
    report, best = [], None
    if not bounds.enabled or len(data) > bounds.max_size or not candidates:
        return Selected(NONE, Spool(data, len(data) + 1), baseline, report)
    most = int(baseline["estimated_bytes"] * (1 - bounds.min_gain))
    worth = gated(len(data), extension, data[:64], bounds)
    for t in candidates:
        row = {"transform_id": t.id, "estimated_bytes": None, "outcome": "Skipped"}
        report.append(row)
        if not worth or (t.quick_check is not None and not t.quick_check(len(data), extension, data[:64])):
            continue
        if len(data) > bounds.max_in_memory and bounds.spill_folder is None:
            row["outcome"] = "BufferUnavailable"
            continue
        try:
            stream = t.encode(data)
        except Exception:
            row["outcome"] = "EncodeFailed"
            continue
        try:
            back = t.decode(stream)
        except Exception:
            row["outcome"] = "DecodeFailed"
            continue
        if back != data:
            row["outcome"] = "VerificationFailed"
            continue
        del back
        try:
            planned = plan(stream, (t.id, t.version), None)
        except LakeError:
            row["outcome"] = "EvaluationFailed"
            continue
        row["estimated_bytes"] = planned["estimated_bytes"]
        if row["estimated_bytes"] > most:
            row["outcome"] = "InsufficientGain"
        elif best is None or row["estimated_bytes"] < best.plan["estimated_bytes"]:
            if best is not None:
                best.report[0]["outcome"] = "LargerCandidate"
                best.stream.close()
            row["outcome"] = "Selected"
            best = Selected((t.id, t.version), spool(stream), planned, [row])  # beyond the bound the stream waits in a file
        else:
            row["outcome"] = "LargerCandidate"
    if best is None:
        return Selected(NONE, Spool(data, len(data) + 1), baseline, report)
    return Selected(best.transform, best.stream, best.plan, report)


def plan_with_selection(files: DataFrame, transforms: tuple[Transform, ...] = OWN, bounds: Selection = Selection()) -> DataFrame:
    """As :func:`pipeline.plan_files`, each file by its selected transform."""

    def plan(data: bytes, extension: str | None) -> dict:
        found = select(data, extension, transforms, bounds)
        found.stream.close()
        return found.plan

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from P.planned(batches, plan)

    kind = files.schema["file_id"].dataType.simpleString()
    extension = F.col("extension") if "extension" in files.columns else F.lit(None)
    return files.select("file_id", F.col("bytes").cast("binary").alias("bytes"), extension.cast("string").alias("extension")).mapInArrow(run, P.PLANS.format(kind))


def selection_report(files: DataFrame, transforms: tuple[Transform, ...] = OWN, bounds: Selection = Selection()) -> DataFrame:
    """``file_id, transform_id, estimated_bytes, outcome``, a row for each file and candidate."""
    bounds = replace(bounds, pipeline=replace(bounds.pipeline, discard_payload=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "bytes"):
            ids, rows = [], []
            for file_id, data, extension in zip(*(b.column(c).to_pylist() for c in ("file_id", "bytes", "extension"))):
                found = [] if data is None else select(data, extension, transforms, bounds).report
                rows += found
                ids += [file_id] * len(found)
            columns = [pa.array(ids, b.column("file_id").type), pa.array([r["transform_id"] for r in rows], pa.int32()), pa.array([r["estimated_bytes"] for r in rows], pa.int64()), pa.array([r["outcome"] for r in rows], pa.string())]
            yield pa.record_batch(columns, names=["file_id", "transform_id", "estimated_bytes", "outcome"])

    kind = files.schema["file_id"].dataType.simpleString()
    extension = F.col("extension") if "extension" in files.columns else F.lit(None)
    rows = files.select("file_id", F.col("bytes").cast("binary").alias("bytes"), extension.cast("string").alias("extension"))
    return rows.mapInArrow(run, f"file_id {kind}, transform_id int, estimated_bytes long, outcome string")


def magic_match(head):
    """Whether binary content begins like a known container format; null does not."""
    column = F.col(head) if isinstance(head, str) else head
    test = F.lit(False)
    for m in MAGIC:
        test = test | (F.substring(column, 1, len(m)) == F.lit(m))
    return F.coalesce(test, F.lit(False))


def gate(size, extension, head, least: int, most: int, extensions: tuple[str, ...]):
    """Whether a file is worth a try: its size in bounds, and its extension allowed or its beginning known."""
    size, extension = (F.col(x) if isinstance(x, str) else x for x in (size, extension))
    allowed = F.coalesce(F.lower(extension).isin(*extensions), F.lit(False)) if extensions else F.lit(False)
    return F.coalesce(size.between(least, most), F.lit(False)) & (allowed | magic_match(head))


def select_best(candidates: DataFrame, baseline: DataFrame, min_gain: float = 0.01) -> DataFrame:
    """``file_id, transform_id, estimated_bytes`` of the best candidate for each file.

    ``candidates`` has file_id, transform_id, spec_order, estimated_bytes; ``baseline``
    file_id, baseline_bytes. No row where none saves enough.
    """
    most = F.floor(F.col("baseline_bytes") * (1 - min_gain))
    fits = candidates.join(baseline, "file_id").filter(F.col("estimated_bytes") <= most)
    best = F.min(F.struct("estimated_bytes", "spec_order", "transform_id")).alias("b")
    return fits.groupBy("file_id").agg(best).select("file_id", "b.transform_id", "b.estimated_bytes")
