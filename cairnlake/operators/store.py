"""The object store: lookups, verified puts, insert-ignore, upsert, deletion, commits.

A store is a set of immutable DataFrames; every change gives a new one. On disk it is a
folder of commits and a manifest that is replaced as a whole, so a change is seen
entirely or not at all. A commit writes what is new and nothing else: added objects
(content apart from the rest), hashes that are gone (tombstones) and cache rows, each
with the commit's version. A reader takes an object unless a later version has its
tombstone, and of a file's cache rows the latest. ``compact`` writes the state as one
commit, ``vacuum`` removes what no manifest names any more. There is one writer at a
time; a second one is refused when it commits.

The Merkle index is stored too: ``rebuild_merkle`` writes leaves, nodes and meta values
with the commit, and deletions rebuild a stored index in the same commit.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlake import errors, schema
from cairnlake.functions import codec as C
from cairnlake.functions.batches import by_bytes
from cairnlake.functions.hashing import digest
from cairnlake.operators import merkle
from cairnlake.runtime import materialize

_FIELDS = [f.name for f in schema.OBJECTS.fields]
META_FIELDS = ["hash", "kind", "size", "stored_size", "codec", "created_at"]


def first_writer_wins(rows: DataFrame, order: Column, fields: list[str] | None = None) -> DataFrame:
    """One row for each hash: the one with the smallest order. Combined before the exchange; null hashes are dropped."""
    fields = fields or _FIELDS
    row = F.struct(order.alias("o"), F.struct(*fields).alias("v"))
    return rows.filter("hash is not null").groupBy("hash").agg(F.min(row).alias("r")).select("r.v.*")


def unseen(objects: DataFrame, new: DataFrame, order: Column) -> DataFrame:
    """The rows of ``new`` whose hash ``objects`` lacks; of equal new hashes the smallest order.

    What is stored is met by the new hashes first, which are few: if they fit a broadcast,
    the stored hashes do not move.
    """
    wanted = first_writer_wins(new, order)
    known = objects.select("hash").join(new.select("hash").distinct(), "hash", "left_semi")
    return wanted.join(known, "hash", "left_anti").select(_FIELDS)


def insert_ignore(objects: DataFrame, new: DataFrame, order: Column) -> DataFrame:
    """``objects`` and the rows of ``new`` whose hash it lacks; of equal new hashes the smallest order. Nothing is verified."""
    return objects.select(_FIELDS).unionAll(unseen(objects, new, order))


def upsert_cache(cache: DataFrame, new: DataFrame, order: list[str]) -> DataFrame:
    """``cache`` overwritten by ``new``; of equal new file hashes the largest order wins."""
    fields = [f.name for f in schema.CACHE.fields]
    side = lambda df, mine, o: df.select("file_hash", F.struct(F.lit(mine).alias("side"), *o, F.struct(*fields).alias("v")).alias("r"))
    old = side(cache, 0, [F.lit(None).cast(new.schema[c].dataType).alias(c + "_") for c in order])
    rows = old.unionAll(side(new, 1, [F.col(c).alias(c + "_") for c in order])).filter("file_hash is not null")
    return rows.groupBy("file_hash").agg(F.max("r").alias("r")).select("r.v.*")


def existing(objects: DataFrame, requested: DataFrame) -> DataFrame:
    """The requested hashes that are stored, each once."""
    return requested.select("hash").filter("hash is not null").distinct().join(objects.select("hash"), "hash", "left_semi")


def lookup(objects: DataFrame, value: bytes) -> DataFrame:
    """The stored record of one hash: a filter that reaches the scan."""
    return objects.filter(F.col("hash") == F.lit(value))


def read_object(objects: DataFrame, value: bytes) -> DataFrame:
    """``hash, kind, bytes`` of one hash, decoded and checked; no row where it is not stored, an error where it is not sound."""
    return strict(verify(lookup(objects, value)))


def chunk_sizes(objects: DataFrame) -> DataFrame:
    """``hash, stored_size`` of all chunks; payloads are not read."""
    return objects.filter(F.col("kind") == schema.CHUNK).select("hash", "stored_size")


def chunk_stored_bytes(objects: DataFrame, requested: DataFrame) -> DataFrame:
    """``hash, stored_size`` of requested hashes; null where absent or no chunk."""
    return requested.select("hash").filter("hash is not null").distinct().join(chunk_sizes(objects), "hash", "left")


def page(objects: DataFrame, after: bytes | None, size: int) -> DataFrame:
    """The next ``size`` stored records in hash order behind ``after``: a top-k, without a full sort."""
    rows = objects if after is None else objects.filter(F.col("hash") > F.lit(after))
    return rows.orderBy("hash").limit(size)


def recipes_for_files(cache: DataFrame, files: DataFrame) -> DataFrame:
    """``file_hash, recipe_hash`` of requested file hashes; null where unknown."""
    wanted = files.select("file_hash").filter("file_hash is not null").distinct()
    return wanted.join(cache.select("file_hash", "recipe_hash"), "file_hash", "left")


def without_dangling(cache: DataFrame, objects: DataFrame) -> DataFrame:
    """Cache rows whose recipe is stored as a recipe."""
    return cache.join(objects.filter(F.col("kind") == schema.RECIPE).select(F.col("hash").alias("recipe_hash")), "recipe_hash", "left_semi").select(cache.columns)


def dangling(cache: DataFrame, objects: DataFrame) -> DataFrame:
    """Cache rows whose recipe is not stored as a recipe; a null recipe hash dangles."""
    return cache.join(objects.filter(F.col("kind") == schema.RECIPE).select(F.col("hash").alias("recipe_hash")), "recipe_hash", "left_anti").select(cache.columns)


def check_object(hash_: bytes, kind: int, size: int, codec: str, stored: bytes) -> tuple[bytes | None, str | None]:
    """(content, error class); the first failing of kind, size, codec, decoding, length and hash decides."""
    try:
        if kind not in schema.KINDS or size is None or size < 0:
            raise errors.Integrity
        if stored is None:
            raise errors.DecompressError
        data = C.decompress(codec, stored, size)
        if len(data) != size:
            raise errors.ObjectLengthMismatch
        if digest(data) != hash_:
            raise errors.ObjectHashMismatch
        return data, None
    except errors.LakeError as e:
        return None, type(e).__name__


def verify(objects: DataFrame, *beside: str) -> DataFrame:
    """``hash, kind, bytes, error_class``: decoded content, or why there is none; columns named in ``beside`` stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "content"):
            data, error = zip(*[check_object(*r) for r in zip(*(b.column(c).to_pylist() for c in ("hash", "kind", "size", "codec", "content")))])
            columns = [*(b.column(c) for c in beside), b.column("hash"), b.column("kind"), pa.array(data, pa.binary()), pa.array(error, pa.string())]
            yield pa.record_batch(columns, names=[*beside, "hash", "kind", "bytes", "error_class"])

    kept = "".join(f"`{c}` {objects.schema[c].dataType.simpleString()}, " for c in beside)
    return objects.select(*beside, "hash", "kind", "size", "codec", "content").mapInArrow(run, kept + "hash binary, kind int, bytes binary, error_class string")


def strict(verified: DataFrame) -> DataFrame:
    """``hash, kind, bytes``; fails on a row with an error."""
    ok = F.when(F.col("error_class").isNull(), F.col("bytes")).otherwise(F.raise_error(F.concat(F.col("error_class"), F.lit(": "), F.lower(F.hex("hash")))))
    return verified.select("hash", "kind", ok.alias("bytes"))


def all_objects(objects: DataFrame) -> DataFrame:
    """``hash, kind, bytes`` of everything in hash order; fails on a bad object."""
    return strict(verify(objects)).orderBy("hash")


def audit(objects: DataFrame) -> DataFrame:
    """``rule, violations`` of the constraints of the object table."""
    once = objects.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n")).select(F.lit("unique_hash").alias("rule"), F.col("n").alias("violations"))
    tests = {
        "hash_length": F.col("hash").isNull() | (F.octet_length("hash") != schema.HASH_BYTES),
        "kind": F.col("kind").isNull() | ~F.col("kind").isin(*schema.KINDS),
        "codec": F.col("codec").isNull() | ~F.col("codec").isin(*schema.CODEC_IDS),
        "size": F.col("size").isNull() | (F.col("size") < 0),
        "stored_size": F.col("content").isNotNull() & ~F.col("stored_size").eqNullSafe(F.octet_length("content").cast("long")),
    }
    counted = objects.agg(*[F.count_if(F.coalesce(t, F.lit(True))).alias(n) for n, t in tests.items()])
    return once.unionAll(counted.select(F.explode(F.create_map(*[x for n in tests for x in (F.lit(n), F.col(n))])).alias("rule", "violations")))


def unix_timestamp() -> int:
    """Whole seconds since 1970."""
    return max(0, int(time.time()))


_STORED = "hash binary, kind int, size long, stored_size long, codec string, content binary, created_at long, error_class string"


def prepare_objects(rows: DataFrame, kind: int, codec: str, created_at: int = 0) -> DataFrame:
    """Records of content (columns ``hash, bytes``) as they are stored, with ``error_class``.

    Content that does not have its hash, or that is null, is refused (``HashMismatch``);
    content that ``codec`` shortens by less than two per cent is stored raw. Other columns
    stay beside the records.
    """
    if kind not in schema.KINDS:
        raise errors.InvalidConfig(f"unknown kind: {kind}")
    others = [c for c in rows.columns if c not in ("hash", "bytes")]

    def one(hash_: bytes | None, data: bytes | None) -> tuple:
        try:
            if data is None or digest(data) != hash_:
                raise errors.HashMismatch
            used, stored = C.compress_or_raw(codec, data)
            return kind, len(data), len(stored), used, stored, created_at, None
        except errors.LakeError as e:
            return kind, None, None, None, None, created_at, type(e).__name__

    names = [x.split()[0] for x in _STORED.split(", ")][1:]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "bytes"):
            made = [one(h, d) for h, d in zip(b.column("hash").to_pylist(), b.column("bytes").to_pylist())]
            columns = [pa.array(c, t) for c, t in zip(zip(*made), types)]
            yield pa.record_batch([*(b.column(c) for c in others), b.column("hash"), *columns], names=[*others, "hash", *names])

    kept = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in others)
    return rows.select(*others, "hash", F.col("bytes").cast("binary").alias("bytes")).mapInArrow(run, (kept + ", " if kept else "") + _STORED)


_META, _CONTENT = "hash binary, kind int, size long, stored_size long, codec string, created_at long, version long", "hash binary, content binary, version long"
_GONE, _CACHE = "hash binary, version long", "file_hash binary, recipe_hash binary, updated_at long, gone boolean, version long"
_PARTS = {"meta": _META, "content": _CONTENT, "gone": _GONE, "cache": _CACHE}
_INDEX = {"leaves": "hash binary, pos long", "nodes": "level long, pos long, hash binary", "values": "key string, value string"}


@dataclass(frozen=True)
class Pending:
    """What a store has beyond its last commit."""

    added: DataFrame | None = None  # objects
    gone: DataFrame | None = None  # hash
    cache: DataFrame | None = None  # file_hash, recipe_hash, updated_at, gone, n (number of the change)
    changes: int = 0
    rebuild: bool = False

    def with_cache(self, rows: DataFrame, gone: bool) -> Pending:
        rows = rows.select("file_hash", "recipe_hash", "updated_at", F.lit(gone).alias("gone"), F.lit(self.changes).alias("n"))
        return replace(self, cache=rows if self.cache is None else self.cache.unionAll(rows), changes=self.changes + 1)


@dataclass(frozen=True)
class Store:
    """One state of a store."""

    objects: DataFrame
    cache: DataFrame
    path: str | None = None
    namespace: str | None = None
    read_only: bool = False
    merkle: bool = True
    version: int = 0
    commits: tuple = ()
    index: str | None = None
    records: DataFrame | None = None  # the objects without content
    pending: Pending = field(default_factory=Pending)

    @classmethod
    def empty(cls, spark: SparkSession, **options) -> Store:
        schema.namespace(options.get("namespace"))
        return cls(spark.createDataFrame([], schema.OBJECTS), spark.createDataFrame([], schema.CACHE), **options)

    @classmethod
    def from_dataframes(cls, objects: DataFrame, cache: DataFrame, **options) -> Store:
        schema.namespace(options.get("namespace"))
        return cls(objects, cache, pending=Pending(added=objects.select(_FIELDS)).with_cache(cache, False), **options)

    @classmethod
    def open(cls, spark: SparkSession, path: str, namespace: str | None = None, read_only: bool = False, merkle: bool = True) -> Store:
        """The last committed state in ``path``, or an empty store."""
        pointer = _read_text(spark, f"{path}/{schema.namespace(namespace)}current.json")
        if pointer is None:
            if read_only:
                raise errors.InvalidConfig(f"no store in {path}")
            return cls.empty(spark, path=path, namespace=namespace, merkle=merkle)
        found = json.loads(pointer)
        commits = tuple((c["name"], tuple(c["parts"])) for c in found["commits"])

        def part(name: str) -> DataFrame | None:
            places = [f"{path}/{c}/{name}" for c, parts in commits if name in parts]
            return spark.read.schema(_PARTS[name]).parquet(*places) if places else None

        blank = lambda s: spark.createDataFrame([], s)
        meta, content, gone, rows = (part(name) for name in _PARTS)
        records = blank(_META) if meta is None else meta
        if gone is not None:
            last = gone.groupBy("hash").agg(F.max("version").alias("gone_at"))
            records = records.join(last, "hash", "left").filter("gone_at is null or version >= gone_at").drop("gone_at")
        # content lies apart, and is joined only by plans that use it
        objects = records.join(blank(_CONTENT) if content is None else content, ["hash", "version"], "left").select(_FIELDS)
        cache = blank(_CACHE) if rows is None else rows
        latest = F.max(F.struct("version", "recipe_hash", "updated_at", "gone")).alias("r")
        cache = cache.groupBy("file_hash").agg(latest).filter("not r.gone").select("file_hash", "r.recipe_hash", "r.updated_at")
        return cls(objects, cache, path, namespace, read_only, merkle, found["version"], commits, found.get("index"), records.select(META_FIELDS))

    def meta(self) -> DataFrame:
        """The object table without payloads; of what is committed only that part is read."""
        return self.objects.select(META_FIELDS) if self.records is None else self.records

    def _writable(self) -> None:
        if self.read_only:
            raise errors.InvalidConfig("the store is read-only")

    def put_objects(self, new: DataFrame, order: Column) -> Store:
        """With those records whose hash is not stored; nothing is verified."""
        self._writable()
        added = unseen(self.meta(), new, order)
        pending = replace(self.pending, added=added if self.pending.added is None else self.pending.added.unionAll(added))
        return replace(self, objects=self.objects.select(_FIELDS).unionAll(added), records=self.meta().unionAll(added.select(META_FIELDS)), pending=pending)

    def _put(self, rows: DataFrame, kind: int, codec: str, order: Column, created_at: int | None) -> Store:
        self._writable()
        made = materialize(prepare_objects(rows.withColumn("input_order", order), kind, codec, unix_timestamp() if created_at is None else created_at), "prepared")
        bad = made.filter("error_class is not null").orderBy("hash").select("hash", "error_class").first()
        if bad is not None:
            raise getattr(errors, bad["error_class"], errors.Integrity)(bytes(bad["hash"] or b"").hex())
        return self.put_objects(made, F.col("input_order"))

    def put_chunks(self, rows: DataFrame, codec: str = schema.ZSTD, order: Column | None = None, created_at: int | None = None) -> Store:
        """With chunks (columns ``hash, bytes``), each checked against its hash; one that does not match raises, and nothing is put."""
        return self._put(rows, schema.CHUNK, codec, F.lit(0) if order is None else order, created_at)

    def put_recipes(self, rows: DataFrame, codec: str = schema.RAW, order: Column | None = None, created_at: int | None = None) -> Store:
        """With recipes, as :meth:`put_chunks`."""
        return self._put(rows, schema.RECIPE, codec, F.lit(0) if order is None else order, created_at)

    def put_cache(self, new: DataFrame, order: list[str]) -> Store:
        self._writable()
        last = upsert_cache(new.sparkSession.createDataFrame([], schema.CACHE), new, order)
        return replace(self, cache=upsert_cache(self.cache, new, order), pending=self.pending.with_cache(last, False))

    def delete_objects(self, hashes: DataFrame) -> Store:
        """Without these objects, and without any cache row that dangles then; a stored Merkle index is rebuilt with the commit."""
        self._writable()
        gone = hashes.select("hash").filter("hash is not null").distinct()
        without = lambda df: df.join(gone, "hash", "left_anti")
        left, records = without(self.objects).select(_FIELDS), without(self.meta()).select(META_FIELDS)
        p = self.pending
        pending = replace(
            p, added=None if p.added is None else without(p.added).select(_FIELDS), gone=gone if p.gone is None else p.gone.unionAll(gone), rebuild=p.rebuild or (self.merkle and self.index is not None)
        ).with_cache(dangling(self.cache, records), True)
        return replace(self, objects=left, records=records, cache=without_dangling(self.cache, records), pending=pending)

    def transaction(self, change: Callable[[Store], Store]) -> Store:
        """The committed result of ``change``; where it raises, the last committed state stays as it was."""
        self._writable()
        return change(self).commit()

    def require_merkle(self) -> None:
        if not self.merkle:
            raise errors.Integrity("the Merkle index is disabled")

    def rebuild_merkle(self) -> Store:
        """The next commit writes the index of its objects."""
        self._writable()
        self.require_merkle()
        return replace(self, pending=replace(self.pending, rebuild=True))

    def merkle_index(self):
        """The stored index: its leaves may be stale where objects were put since."""
        self.require_merkle()
        if self.index is None:
            raise errors.MissingMeta("root_hash")
        spark = self.objects.sparkSession
        leaves, nodes, values = (spark.read.schema(s).parquet(f"{self.path}/{self.index}/{name}") for name, s in _INDEX.items())
        root, count = merkle.summary(values)
        return merkle.Index(leaves, nodes, count, root)

    def commit(self) -> Store:
        """Write what is new since the last commit, then swing the manifest to it."""
        self._writable()
        if not self.path:
            raise errors.InvalidConfig("the store has no path")
        p, version = self.pending, self.version + 1
        at = F.lit(version).cast("long").alias("version")
        rows: dict[str, DataFrame] = {}
        if p.added is not None:
            added = materialize(p.added, "added")  # a plan that reads the store is evaluated once
            rows["meta"] = added.select(*META_FIELDS, at).sortWithinPartitions("hash")
            rows["content"] = added.filter("content is not null").select("hash", "content", at)
        if p.gone is not None:
            rows["gone"] = p.gone.distinct().select("hash", at)
        if p.cache is not None:
            last = p.cache.groupBy("file_hash").agg(F.max(F.struct("n", "recipe_hash", "updated_at", "gone")).alias("r"))
            rows["cache"] = last.select("file_hash", "r.recipe_hash", "r.updated_at", "r.gone", at)
        return self._write(rows, self.commits, version)

    def _write(self, rows: dict[str, DataFrame], before: tuple, version: int) -> Store:
        spark, prefix = self.objects.sparkSession, schema.namespace(self.namespace)
        pointer = f"{self.path}/{prefix}current.json"
        name, parts = f"{prefix}commit-{version:08d}-{uuid.uuid4().hex}", []
        for part, df in rows.items():
            df.write.parquet(f"{self.path}/{name}/{part}")
            if spark.read.schema(_PARTS[part]).parquet(f"{self.path}/{name}/{part}").isEmpty():
                _delete(spark, f"{self.path}/{name}/{part}")
            else:
                parts.append(part)
        commits = [*({"name": c, "parts": list(had)} for c, had in before), *([{"name": name, "parts": parts}] if parts else [])]
        manifest = {"version": version, "commits": commits, "index": self.index}
        if self.pending.rebuild:
            manifest["index"] = self._write_index(manifest)
        found = _read_text(spark, pointer)
        if (json.loads(found)["version"] if found else 0) != self.version:
            raise errors.Integrity("another writer has committed")
        _replace_text(spark, pointer, json.dumps(manifest))
        return Store.open(spark, self.path, self.namespace, self.read_only, self.merkle)

    def _write_index(self, manifest: dict) -> str:
        spark, prefix = self.objects.sparkSession, schema.namespace(self.namespace)
        index = merkle.build(self.meta())
        name = f"{prefix}index-{manifest['version']:08d}-{uuid.uuid4().hex}"
        for part, df in zip(_INDEX, (index.leaves, index.nodes, index.meta(spark))):
            df.write.parquet(f"{self.path}/{name}/{part}")
        return name

    def compact(self) -> Store:
        """The committed state written again as one commit, so that readers meet no tombstones."""
        self._writable()
        at = F.lit(self.version + 1).cast("long").alias("version")
        content = self.objects.filter("content is not null").select("hash", "content", at)
        cache = self.cache.select("file_hash", "recipe_hash", "updated_at", F.lit(False).alias("gone"), at)
        return self._write({"meta": self.meta().select(*META_FIELDS, at).sortWithinPartitions("hash"), "content": content, "cache": cache}, (), self.version + 1)

    def vacuum(self) -> list[str]:
        """Delete the commits and indexes of this namespace that the manifest does not name; readers of older states lose them."""
        self._writable()
        spark, prefix = self.objects.sparkSession, schema.namespace(self.namespace)
        kept = {c for c, _ in self.commits} | {self.index}
        fs, root = _fs(spark, self.path)
        names = sorted(s.getPath().getName() for s in fs.listStatus(root) if s.isDirectory())
        gone = [n for n in names if n.startswith((f"{prefix}commit-", f"{prefix}index-")) and n not in kept]
        for n in gone:
            _delete(spark, f"{self.path}/{n}")
        return gone


def _delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _read_text(spark: SparkSession, path: str) -> str | None:
    fs, p = _fs(spark, path)
    return spark.read.text(path, wholetext=True).first()[0] if fs.exists(p) else None


def _replace_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _fs(spark, path)
    temporary = spark._jvm.org.apache.hadoop.fs.Path(path + "." + uuid.uuid4().hex)
    out = fs.create(temporary, True)
    out.write(bytearray(text.encode()))
    out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context.rename(temporary, p, options)
