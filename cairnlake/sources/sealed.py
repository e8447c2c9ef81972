"""Sealed packs: one immutable file with the closure of a root recipe.

Layout, all numbers little-endian: a header of 140 bytes (16 bytes tag, u16 revision 1,
u16 suite, u64 stored index length, 32 bytes pack id, 32 bytes salt, 16 bytes key slot,
32 bytes index digest), the stored index, the payloads in hash order without gaps. The
index is one Zstandard frame of the root hash and 50 bytes an object (hash, u8 kind, u8
codec, u64 decoded length, u64 stored length). Suite 0 is plain, with zero salt and slot;
suite 1 adds a tag to the index and to every 256 KiB of payload.

The labels that separate the hashes and keys of a format family are parameters
(:class:`Labels`), so packs of other writers can be read with theirs.

``spark.read.format("sealedpack")`` reads the directory and payloads of packs by path or
URI; each partition takes ranges of bytes and reads only the payloads that begin there.
Options: ``path`` (a file, a folder or a glob), ``tag``, ``secret`` and ``slot`` in
hexadecimal, ``verify`` (default true), ``errors`` (``raise``, the default, or ``column``:
a pack that cannot be read is one row with its ``error_class``), ``partitionbytes``,
``pushdown`` (default false) and the labels (``label_pack_id`` and so on).
"""

from __future__ import annotations

import hashlib
import os
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, fields
from functools import cache

import zstandard
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition

from cairnlake import errors, schema
from cairnlake.errors import InvalidSealed
from cairnlake.functions import codec as C
from cairnlake.functions import recipe as R
from cairnlake.functions.crypto import FrameKey
from cairnlake.functions.hashing import digest
from cairnlake.sources.paths import list_files, open_file, write_file

# fixed values of the format
HEADER, REVISION, PLAIN, SEALED = 140, 1, 0, 1
_HEAD = struct.Struct("<16sHHQ32s32s16s")
_RECORD = struct.Struct("<32sBBQQ")
MAX_OBJECT, MAX_OBJECTS, MAX_INDEX, MAX_STORED_INDEX = 64 << 20, 1_000_000, 8 << 20, 3 << 20
ZSTD_WINDOW, BROTLI_WINDOW, INDEX_WINDOW = 22, 20, 20
DEFAULT_TAG = b"\0" * 16


@dataclass(frozen=True)
class Labels:
    """What is hashed in front of the parts of a pack."""

    pack_id: bytes = b"cairnlake.sealed.pack-id.v1\0"
    stored_index: bytes = b"cairnlake.sealed.index.stored.v1\0"
    index_key: bytes = b"cairnlake.sealed.index.v1\0"
    frame_key: bytes = b"cairnlake.sealed.frame.v1\0"


@dataclass(frozen=True)
class Entry:
    """One directory record; ``offset`` is where its payload begins in the file."""

    hash: bytes
    kind: int
    codec: str
    decoded: int
    stored: int
    offset: int = 0


@dataclass(frozen=True)
class Directory:
    """A pack's header and entries."""

    tag: bytes
    suite: int
    pack_id: bytes
    salt: bytes
    slot: bytes
    root: bytes
    entries: list[Entry]

    @property
    def encrypted(self) -> bool:
        return self.suite == SEALED


def frames(stored: int) -> int:
    return -(-stored // schema.FRAME)


def frame_spans(objects):
    """``hash, frame, length``: the frames of 256 KiB of each stored object (hash, stored_size); none for empty ones."""
    from pyspark.sql import functions as F

    last = F.ceil(F.col("stored_size") / schema.FRAME) - 1
    rows = objects.filter("stored_size > 0").select("hash", "stored_size", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("frame"))
    return rows.select("hash", F.col("frame").cast("int").alias("frame"), F.least(F.lit(schema.FRAME).cast("long"), F.col("stored_size") - schema.FRAME * F.col("frame")).alias("length"))


def pack_id(root: bytes, entries: Iterable[Entry], labels: Labels = Labels()) -> bytes:
    """Identity of the contents: codec, stored length and place do not count."""
    h = hashlib.sha3_256(labels.pack_id + root)
    for e in entries:
        h.update(e.hash + bytes([e.kind]) + struct.pack("<Q", e.decoded))
    return h.digest()


def _index_context(head: bytes, labels: Labels) -> tuple[bytes, bytes]:
    return labels.index_key + head, head


def _frame_context(d: Directory, e: Entry, i: int, size: int, labels: Labels) -> tuple[bytes, bytes]:
    about = d.tag + struct.pack("<H", REVISION) + d.pack_id + e.hash + bytes([e.kind, schema.CODEC_IDS[e.codec]]) + struct.pack("<QQQQ", e.decoded, e.stored, i, frames(e.stored))
    return labels.frame_key + about, about + struct.pack("<Q", size)


def read_directory(size: int, head: bytes, index: bytes, tag: bytes = DEFAULT_TAG, key: FrameKey | None = None, labels: Labels = Labels()) -> Directory:
    """Checked directory of a pack of ``size`` bytes from its header and stored index."""
    if len(head) < HEADER:
        raise InvalidSealed("shorter than its header")
    own_tag, revision, suite, length, identity, salt, slot = _HEAD.unpack_from(head)
    if own_tag != tag:
        raise InvalidSealed("another tag")
    if revision != REVISION:
        raise InvalidSealed("unknown revision")
    if suite not in (PLAIN, SEALED):
        raise InvalidSealed("unknown suite")
    packed_size = length - 16 * (suite == SEALED)
    if not 0 <= packed_size <= MAX_STORED_INDEX or HEADER + length > size or len(index) != length:
        raise InvalidSealed("index length")
    if suite == PLAIN and any(salt + slot):
        raise InvalidSealed("a plain pack has no salt or key slot")
    if suite == SEALED and (key is None or not key.accepts(slot)):
        raise errors.AuthenticationFailed("key slot")
    if digest(labels.stored_index + head[: _HEAD.size] + index) != head[_HEAD.size : HEADER]:
        raise InvalidSealed("index digest")
    if suite == SEALED:
        index = key.unseal(salt, slot, *_index_context(head[: _HEAD.size], labels), index[:-16], index[-16:])
    root, entries = _read_index(index)
    at, placed = HEADER + length, []
    for e in entries:
        placed.append(Entry(e.hash, e.kind, e.codec, e.decoded, e.stored, at))
        at += e.stored + (16 * frames(e.stored) if suite == SEALED else 0)
    if at != size:
        raise InvalidSealed("payloads do not fill the file")
    own = {e.hash: e.kind for e in entries}.get(root)
    if own != schema.RECIPE:
        raise InvalidSealed("root is no recipe of the pack")
    if pack_id(root, entries, labels) != identity:
        raise InvalidSealed("pack identity")
    return Directory(tag, suite, identity, salt, slot, root, placed)


def _read_index(packed: bytes) -> tuple[bytes, list[Entry]]:
    try:
        if zstandard.get_frame_parameters(packed).window_size > 1 << INDEX_WINDOW:
            raise InvalidSealed("index window")
        d = zstandard.ZstdDecompressor(max_window_size=1 << INDEX_WINDOW).decompressobj()
        plain = d.decompress(packed)
    except zstandard.ZstdError as e:
        raise InvalidSealed(str(e)) from e
    if not d.eof or d.unused_data:
        raise InvalidSealed("index is not exactly one frame")
    if len(plain) > MAX_INDEX or len(plain) <= schema.HASH_BYTES or (len(plain) - schema.HASH_BYTES) % _RECORD.size:
        raise InvalidSealed("index size")
    entries, before = [], b""
    for h, kind, codec, decoded, stored in _RECORD.iter_unpack(plain[schema.HASH_BYTES :]):
        if kind not in schema.KINDS or codec not in schema.CODECS or max(decoded, stored) > MAX_OBJECT or h <= before:
            raise InvalidSealed("directory record")
        entries.append(Entry(h, kind, schema.CODECS[codec], decoded, stored))
        before = h
    return plain[: schema.HASH_BYTES], entries


@cache
def _index_compressor() -> zstandard.ZstdCompressor:
    parameters = zstandard.ZstdCompressionParameters.from_level(19, window_log=INDEX_WINDOW, write_content_size=False, write_checksum=False, write_dict_id=False)
    return zstandard.ZstdCompressor(compression_params=parameters)


def _pack_index(root: bytes, entries: list[Entry]) -> bytes:
    plain = root + b"".join(_RECORD.pack(e.hash, e.kind, schema.CODEC_IDS[e.codec], e.decoded, e.stored) for e in entries)
    if len(entries) > MAX_OBJECTS or len(plain) > MAX_INDEX:
        raise InvalidSealed("too many objects")
    packed = _index_compressor().compress(plain)
    if len(packed) > MAX_STORED_INDEX:
        raise InvalidSealed("stored index too long")
    return packed


def open_payload(d: Directory, e: Entry, raw: bytes, key: FrameKey | None, labels: Labels = Labels()) -> bytes:
    """The stored bytes of one entry from what lies in the file."""
    if not d.encrypted:
        return raw
    out = []
    for i in range(frames(e.stored)):
        part = raw[i * (schema.FRAME + 16) : (i + 1) * (schema.FRAME + 16)]
        out.append(key.unseal(d.salt, d.slot, *_frame_context(d, e, i, len(part) - 16, labels), part[:-16], part[-16:]))
    return b"".join(out)


def decode(e: Entry, stored: bytes) -> bytes:
    """Verified content of one entry; windows beyond the limits and empty Brotli payloads are refused."""
    if e.codec == schema.BROTLI:
        if not stored:
            raise InvalidSealed("empty Brotli payload")
        if C.brotli_window_bits(stored[0]) > BROTLI_WINDOW:
            raise InvalidSealed("Brotli window")
    if e.codec == schema.ZSTD:
        try:
            if zstandard.get_frame_parameters(stored).window_size > 1 << ZSTD_WINDOW:
                raise errors.DecompressError("window")
        except zstandard.ZstdError as x:
            raise errors.DecompressError(str(x)) from x
    data = C.decompress(e.codec, stored, e.decoded)
    if len(data) != e.decoded:
        raise errors.ObjectLengthMismatch
    if digest(data) != e.hash:
        raise errors.ObjectHashMismatch
    return data


def transcoded(codec: str, stored: bytes) -> tuple[str, bytes]:
    """Brotli payloads as Zstandard: our Brotli declares a window that packs do not allow. Hash and pack id stay."""
    if codec != schema.BROTLI or (stored and C.brotli_window_bits(stored[0]) <= BROTLI_WINDOW):
        return codec, stored
    return C.compress_or_raw(schema.ZSTD, C.decompress(codec, stored))


def validated(root: bytes, objects: Iterable[dict]) -> list[dict]:
    """Objects (hash, kind, size, codec, content) in hash order; the graph must be closed and each object sound."""
    by_hash: dict[bytes, dict] = {}
    recipes = []
    for o in objects:
        if o["size"] > MAX_OBJECT or len(o["content"]) > MAX_OBJECT:
            raise InvalidSealed("object too large")
        data = C.decompress(o["codec"], o["content"], o["size"])
        if len(data) != o["size"] or digest(data) != o["hash"]:
            raise errors.HashMismatch(o["hash"].hex())
        if o["hash"] in by_hash:
            raise InvalidSealed("duplicate hash")
        by_hash[o["hash"]] = o
        if o["kind"] == schema.RECIPE:
            recipes.append(R.parse(data))
    if root not in by_hash or by_hash[root]["kind"] != schema.RECIPE:
        raise InvalidSealed("root recipe")
    for r in recipes:
        for h, n in r.chunks:
            chunk = by_hash.get(h)
            if chunk is None or chunk["kind"] != schema.CHUNK or chunk["size"] != n:
                raise InvalidSealed("recipe chunk " + h.hex())
    return [by_hash[h] for h in sorted(by_hash)]


def build(root: bytes, objects: Iterable[dict], tag: bytes = DEFAULT_TAG, key: FrameKey | None = None, labels: Labels = Labels(), salt: bytes | None = None) -> bytes:
    """A pack of these objects, encrypted where a key is given. A pack is bounded to 167,771 objects by its index."""
    rows = []
    for o in validated(root, objects):
        codec, content = transcoded(o["codec"], o["content"])
        rows.append((Entry(o["hash"], o["kind"], codec, o["size"], len(content)), content))
    return _assemble(root, rows, tag, key, labels, salt)


def _assemble(root: bytes, rows: list[tuple[Entry, bytes]], tag: bytes, key: FrameKey | None, labels: Labels, salt: bytes | None = None) -> bytes:
    if len(tag) != 16 or (key is not None and tag == DEFAULT_TAG):
        raise errors.InvalidConfig("an encrypted pack needs a tag of its own")
    entries = [e for e, _ in rows]
    index, identity = _pack_index(root, entries), pack_id(root, entries, labels)
    suite, slot = (PLAIN, bytes(16)) if key is None else (SEALED, key.slot)
    salt = bytes(32) if key is None else salt or os.urandom(32)
    head = _HEAD.pack(tag, REVISION, suite, len(index) + 16 * suite, identity, salt, slot)
    if key is not None:
        sealed, mark = key.seal(salt, slot, *_index_context(head, labels), index)
        index = sealed + mark
    d = Directory(tag, suite, identity, salt, slot, root, entries)
    out = [head, digest(labels.stored_index + head + index), index]
    for e, content in rows:
        if key is None:
            out.append(content)
        else:
            for i in range(frames(e.stored)):
                part = content[i * schema.FRAME : (i + 1) * schema.FRAME]
                out.extend(key.seal(salt, slot, *_frame_context(d, e, i, len(part), labels), part))
    return b"".join(out)


def parse(pack: bytes, tag: bytes = DEFAULT_TAG, key: FrameKey | None = None, labels: Labels = Labels()) -> Directory:
    length = struct.unpack_from("<Q", pack, 20)[0] if len(pack) >= HEADER else 0
    return read_directory(len(pack), pack[:HEADER], pack[HEADER : HEADER + length], tag, key, labels)


def raw_payload(d: Directory, e: Entry, pack: bytes) -> bytes:
    return pack[e.offset : e.offset + e.stored + (16 * frames(e.stored) if d.encrypted else 0)]


def reseal(pack: bytes, key: FrameKey, tag: bytes, source_tag: bytes = DEFAULT_TAG, labels: Labels = Labels(), salt: bytes | None = None) -> bytes:
    """A plain pack as an encrypted one; payloads are copied as they are and not decoded."""
    d = parse(pack, source_tag, None, labels)
    return _assemble(d.root, [(e, raw_payload(d, e, pack)) for e in d.entries], tag, key, labels, salt)


SCHEMA = "path string, pack_id binary, encrypted boolean, root_recipe binary, object_count long, hash binary, kind int, codec string, size long, stored_size long, payload_offset long, content binary, error_class string"
BYTES_PER_PARTITION, PACKS_PER_PARTITION = 128 << 20, 200
#: bytes and objects of one pack, at most: a pack is one value of a row, and its index is bounded
MOST_PACK, MOST_PACKED = 1 << 30, (MAX_INDEX - schema.HASH_BYTES) // _RECORD.size


class _Ranges(InputPartition):
    """Byte ranges of packs: (path, start, stop)."""

    def __init__(self, ranges: list[tuple[str, int, int]]):
        self.ranges = ranges


class SealedReader(DataSourceReader):
    """Reads the entries whose payload begins in ranges of bytes.

    Planning lists files and their sizes only; every task reads the directories of its
    own packs. Small packs share a partition.
    """

    def __init__(self, options: dict):
        self.options = options
        self.wanted: bytes | None = None

    def _settings(self):
        o = self.options
        hexed = lambda n, default=None: bytes.fromhex(o[n]) if n in o else default
        key = FrameKey(hexed("secret"), hexed("slot")) if "secret" in o else None
        labels = Labels(**{f.name: hexed("label_" + f.name, f.default) for f in fields(Labels)})
        return hexed("tag", DEFAULT_TAG), key, labels

    def partitions(self) -> list[InputPartition]:
        found = list_files(self.options["path"])
        if not found:
            raise errors.InvalidConfig("no pack at " + self.options["path"])
        most = int(self.options.get("partitionbytes", BYTES_PER_PARTITION))
        out, ranges, held = [], [], 0
        for path, size in found:
            for start in range(0, max(1, size), most):
                stop = min(max(1, size), start + most)
                if ranges and (held + stop - start > most or len(ranges) >= PACKS_PER_PARTITION):
                    out.append(_Ranges(ranges))
                    ranges, held = [], 0
                ranges.append((path, start, stop))
                held += stop - start
        return [*out, _Ranges(ranges)]

    def read(self, part: _Ranges) -> Iterator[tuple]:
        tag, key, labels = self._settings()
        check = str(self.options.get("verify", "true")).lower() == "true"
        raises = str(self.options.get("errors", "raise")).lower() != "column"
        for path, start, stop in part.ranges:
            with open_file(path) as f:
                size = f.size()
                try:
                    head = f.read(HEADER)
                    length = struct.unpack_from("<Q", head, 20)[0] if len(head) == HEADER else 0
                    d = read_directory(size, head, f.read(min(length, MAX_STORED_INDEX + 16)), tag, key, labels)
                except errors.LakeError as x:
                    if raises:
                        raise
                    if start == 0:
                        yield (path, *[None] * 11, type(x).__name__)
                    continue
                for e in d.entries:
                    # an empty payload may begin where the file ends
                    if not start <= min(e.offset, size - 1) < stop or (self.wanted is not None and e.hash != self.wanted):
                        continue
                    f.seek(e.offset)
                    content, error = None, None
                    try:
                        content = open_payload(d, e, f.read(e.stored + (16 * frames(e.stored) if d.encrypted else 0)), key, labels)
                        if check:
                            decode(e, content)
                    except errors.LakeError as x:
                        content, error = None, type(x).__name__
                    yield (path, d.pack_id, d.encrypted, d.root, len(d.entries), e.hash, e.kind, e.codec, e.decoded, e.stored, e.offset, content, error)


class PushdownReader(SealedReader):
    """A reader that takes equality on hash down to the directory; Spark allows it only with ``spark.sql.python.filterPushdown.enabled``."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("hash",):
                self.wanted = bytes(f.value)
            yield f


class SealedPack(DataSource):
    """The ``sealedpack`` format; register with ``spark.dataSource.register(SealedPack)``."""

    @classmethod
    def name(cls) -> str:
        return "sealedpack"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        options = dict(self.options)
        return (PushdownReader if options.get("pushdown", "false").lower() == "true" else SealedReader)(options)


def packs(closures, tag: bytes = DEFAULT_TAG, key: FrameKey | None = None, labels: Labels = Labels()):
    """``root_recipe, pack, error_class``: one pack for each root of ``closures`` (root_recipe, hash, kind, size, codec, content).

    The objects of one pack meet in one group. Roots that have too many objects or bytes
    for a pack are told from the lengths alone; their content never meets.
    """
    import pyarrow as pa
    from pyspark.sql import functions as F

    from cairnlake.runtime import materialize

    def one(rows: pa.Table) -> pa.Table:
        root, pack, failed = rows.column("root_recipe")[0].as_py(), None, None
        try:
            pack = build(root, rows.to_pylist(), tag, key, labels)
        except errors.LakeError as e:
            failed = type(e).__name__
        return pa.table({"root_recipe": pa.array([root], pa.binary()), "pack": pa.array([pack], pa.binary()), "error_class": pa.array([failed], pa.string())})

    sizes = closures.groupBy("root_recipe").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("content").cast("long")).alias("bytes"))
    large = materialize(sizes.filter((F.col("n") > MOST_PACKED) | (F.col("bytes") > MOST_PACK)).select("root_recipe"), "large")
    fit = closures if large.isEmpty() else closures.join(large, "root_recipe", "left_anti")
    made = fit.groupBy("root_recipe").applyInArrow(one, "root_recipe binary, pack binary, error_class string")
    return made.unionAll(large.select("root_recipe", F.lit(None).cast("binary").alias("pack"), F.lit(InvalidSealed.__name__).alias("error_class")))


def directories(built):
    """``root_recipe, hash, kind, codec, size, stored_size`` of the entries of packs (root_recipe, pack), as their directories say."""
    import pyarrow as pa

    from cairnlake.functions.batches import by_bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "pack"):
            rows = [(root, e.hash, e.kind, e.codec, e.decoded, e.stored) for root, pack in zip(b.column("root_recipe").to_pylist(), b.column("pack").to_pylist()) for e in parse(pack).entries]
            types = (pa.binary(), pa.binary(), pa.int32(), pa.string(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["root_recipe", "hash", "kind", "codec", "size", "stored_size"])

    return built.mapInArrow(run, "root_recipe binary, hash binary, kind int, codec string, size long, stored_size long")


def resealed(built, key: FrameKey, tag: bytes, source_tag: bytes = DEFAULT_TAG, labels: Labels = Labels()):
    """``root_recipe, pack, error_class``: plain packs (root_recipe, pack) encrypted, their payloads copied as they are."""
    import pyarrow as pa

    from cairnlake.functions.batches import by_bytes

    def one(pack: bytes | None) -> tuple[bytes | None, str | None]:
        try:
            return reseal(pack or b"", key, tag, source_tag, labels), None
        except errors.LakeError as e:
            return None, type(e).__name__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "pack"):
            packs_, failed = zip(*map(one, b.column("pack").to_pylist()))
            yield pa.record_batch([b.column("root_recipe"), pa.array(packs_, pa.binary()), pa.array(failed, pa.string())], names=["root_recipe", "pack", "error_class"])

    return built.select("root_recipe", "pack").mapInArrow(run, "root_recipe binary, pack binary, error_class string")


def write_packs(built, folder: str):
    """Write packs into ``folder`` (shared by all executors); each is renamed into place. Returns ``root_recipe, path``."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths = [write_file(f"{folder.rstrip('/')}/{root.hex()}.pack", pack) for root, pack in zip(b.column("root_recipe").to_pylist(), (x.as_py() for x in b.column("pack")))]
            yield pa.record_batch([b.column("root_recipe"), pa.array(paths, pa.string())], names=["root_recipe", "path"])

    return built.filter("error_class is null").select("root_recipe", "pack").mapInArrow(run, "root_recipe binary, path string")
