"""Sealed packs, encryption, SQLite files, file sources and streaming."""

import sqlite3

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairnlake import errors, schema
from cairnlake.functions import codec as C
from cairnlake.functions import crypto as K
from cairnlake.functions import recipe as R
from cairnlake.functions.hashing import digest
from cairnlake.operators import pipeline as P
from cairnlake.operators.store import Store
from cairnlake.sources import files as files_source
from cairnlake.sources import sealed as S
from cairnlake.sources.sqlite_file import SqliteStore
from cairnlake.streaming.ingest import ingest_stream, put_files

KEY = K.FrameKey(b"s" * 32, b"k" * 16)
TAG = b"pack-tag-16bytes"


def obj(data, kind=1, codec="raw"):
    return {"hash": digest(data), "kind": kind, "size": len(data), "codec": codec, "content": C.compress(codec, data)}


def graph(codec="raw", parts=(b"alpha" * 8, b"beta" * 8), order=(0, 1, 0)):
    chosen = [parts[i] for i in order]
    whole = b"".join(chosen)
    recipe = R.build(len(whole), digest(whole), [(digest(c), len(c)) for c in chosen])
    return digest(recipe), [obj(recipe, 2, codec), *(obj(parts[i], 1, codec) for i in sorted(set(order)))], whole


def content(pack, tag=S.DEFAULT_TAG, key=None):
    d = S.parse(pack, tag, key)
    return d, {e.hash: S.decode(e, S.open_payload(d, e, S.raw_payload(d, e, pack), key)) for e in d.entries}


@pytest.mark.parametrize("codec", ["raw", "zstd", "brotli"])
@pytest.mark.parametrize("order", [(), (0,), (0, 1), (0, 1, 0)])
@pytest.mark.parametrize("key", [None, KEY])
def test_matrix(codec, order, key):
    root, objects, whole = graph(codec, order=order)
    tag = S.DEFAULT_TAG if key is None else TAG
    d, read = content(S.build(root, objects, tag, key), tag, key)
    assert d.root == root and d.encrypted == (key is not None) and len(d.entries) == len(objects)
    assert b"".join(read[h] for h, _ in R.parse(read[root]).chunks) == whole
    assert [e.hash for e in d.entries] == sorted(read)
    assert not any(e.codec == "brotli" for e in d.entries)


def test_identity_ignores_codecs():
    packs = [S.build(*graph(c)[:2]) for c in ("raw", "zstd")]
    assert len({p[28:60] for p in packs}) == 1 and packs[0] != packs[1]


def test_directory_layout():
    root, objects, _ = graph()
    d = S.parse(S.build(root, objects))
    at = d.entries[0].offset
    for e in d.entries:
        assert e.offset == at
        at += e.stored
    assert S.frames(0) == 0 and S.frames(1) == S.frames(262_144) == 1 and S.frames(262_145) == 2


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 255), st.sampled_from([("raw", False), ("raw", True), ("zstd", False), ("zstd", True)]))
def test_every_flip_is_found(at, by, how):
    """No changed byte gives other content.

    A plain pack has no digest of its stored payloads: bits of a Zstandard frame header
    that decoders ignore can change there, and the content is still the right one.
    """
    codec, encrypted = how
    root, objects, _ = graph(codec)
    key, tag = (KEY, TAG) if encrypted else (None, S.DEFAULT_TAG)
    whole = S.build(root, objects, tag, key, salt=b"n" * 32)
    pack = bytearray(whole)
    at %= len(pack)
    pack[at] ^= by
    try:
        read = content(bytes(pack), tag, key)[1]
    except errors.LakeError:
        return
    d, right = content(whole, tag, key)
    assert codec == "zstd" and not encrypted and at >= d.entries[0].offset and read == right


def test_truncation_is_found():
    pack = S.build(*graph()[:2])
    for n in range(0, len(pack), 7):
        with pytest.raises(errors.LakeError):
            content(pack[:n])
    with pytest.raises(errors.InvalidSealed):
        S.parse(pack + b"!")


def test_build_refuses():
    root, objects, _ = graph()
    for rows in (objects + objects[:1], objects[1:], objects[:2], [*objects[:1], {**objects[1], "kind": 2}, *objects[2:]]):
        with pytest.raises(errors.LakeError):
            S.build(root, rows)
    with pytest.raises(errors.HashMismatch):
        S.build(root, [{**objects[0], "hash": digest(b"?")}, *objects[1:]])
    with pytest.raises(errors.InvalidSealed):
        S.build(objects[1]["hash"], objects)
    with pytest.raises(errors.InvalidConfig):
        S.build(root, objects, key=KEY)
    S.build(root, [*objects, obj(b"unreferenced")])


def test_reseal_and_wrong_keys():
    root, objects, whole = graph("zstd", (b"a" * 600_000, b"b"), (0, 1))
    plain = S.build(root, objects)
    sealed = S.reseal(plain, KEY, TAG)
    assert content(sealed, TAG, KEY)[1] == content(plain)[1] and plain[28:60] == sealed[28:60]
    for key in (None, K.FrameKey(b"s" * 32, b"o" * 16), K.FrameKey(b"x" * 32, b"k" * 16)):
        with pytest.raises(errors.AuthenticationFailed):
            S.parse(sealed, TAG, key)
    with pytest.raises(errors.InvalidSealed):
        S.parse(sealed, S.DEFAULT_TAG, KEY)
    other = S.Labels(pack_id=b"another family\0")
    assert S.parse(S.build(root, objects, labels=other), labels=other).root == root
    with pytest.raises(errors.InvalidSealed):
        S.parse(S.build(root, objects, labels=other))


def test_cipher():
    key, nonce = bytes(range(0x80, 0xA0)), bytes.fromhex("070000004041424344454647")
    text = b"Ladies and Gentlemen of the class of '99: If I could offer you only one tip for the future, sunscreen would be it."
    aad = bytes.fromhex("50515253c0c1c2c3c4c5c6c7")
    sealed, tag = K.seal(key, nonce, text, aad)
    assert tag.hex() == "1ae10b594f09e26a7e902ecbd0600691" and K.unseal(key, nonce, sealed, tag, aad) == text
    with pytest.raises(errors.AuthenticationFailed):
        K.unseal(key, nonce, sealed, tag, aad + b"!")
    okm = K.hkdf_sha256(bytes(range(13)), b"\x0b" * 22, bytes(range(0xF0, 0xFA)), 42)
    assert okm.hex().startswith("3cb25f25faacd57a90434f64d0362f2a")


def test_pack_source(spark, tmp_path, monkeypatch):
    spark.dataSource.register(S.SealedPack)
    roots = []
    rows = []
    for i in range(3):
        root, objects, _ = graph("zstd", (b"alpha%d" % i * 8, b"beta" * 8))
        roots.append(root)
        rows += [(root, o["hash"], o["kind"], o["size"], o["codec"], o["content"]) for o in objects]
    closures = spark.createDataFrame(rows, "root_recipe binary, hash binary, kind int, size long, codec string, content binary")
    built = S.packs(closures)
    assert built.filter("error_class is null").count() == 3
    assert S.packs(closures.filter("kind = 1")).filter("error_class = 'InvalidSealed'").count() == 3
    assert S.write_packs(built, str(tmp_path)).count() == 3
    read = spark.read.format("sealedpack").load(str(tmp_path))
    assert read.count() == 9 and read.filter("error_class is null").count() == 9
    assert {bytes(r.root_recipe) for r in read.select("root_recipe").distinct().collect()} == set(roots)
    # ranges of bytes cut a pack between its entries, and planning opens none
    cut = spark.read.format("sealedpack").option("partitionbytes", "60").load(str(tmp_path))
    assert cut.rdd.getNumPartitions() > 9 and sorted(bytes(r.hash) for r in cut.collect()) == sorted(bytes(r.hash) for r in read.collect())
    torn = tmp_path / "torn"
    torn.mkdir()
    (torn / "a.pack").write_bytes(next(tmp_path.glob("*.pack")).read_bytes()[:-1])
    (torn / "b.pack").write_bytes(next(tmp_path.glob("*.pack")).read_bytes())
    with pytest.raises(Exception, match="InvalidSealed"):
        spark.read.format("sealedpack").load(str(torn)).count()
    assert sorted(str(r.error_class) for r in spark.read.format("sealedpack").option("errors", "column").load(f"file://{torn}/?.pack").collect()) == ["InvalidSealed", "None", "None", "None"]
    monkeypatch.setattr(S, "MOST_PACKED", 2)
    assert {(r.pack, r.error_class) for r in S.packs(closures).collect()} == {(None, "InvalidSealed")}
    monkeypatch.undo()
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for option in ("true", "false"):
        one = spark.read.format("sealedpack").option("pushdown", option).load(str(tmp_path)).filter(F.col("hash") == F.lit(rows[0][1]))
        assert [bytes(r.hash) for r in one.collect()] == [rows[0][1]]
    sealed = tmp_path / "enc"
    sealed.mkdir()
    (sealed / "a.pack").write_bytes(S.reseal(next(p for p in tmp_path.glob("*.pack")).read_bytes(), KEY, TAG))
    options = {"tag": TAG.hex(), "secret": KEY.secret.hex(), "slot": KEY.slot.hex()}
    assert spark.read.format("sealedpack").options(**options).load(str(sealed)).filter("encrypted and error_class is null").count() == 3


def test_sqlite(spark, tmp_path):
    spark.dataSource.register(SqliteStore)
    path = tmp_path / "store.db"
    with sqlite3.connect(path) as c:
        c.execute("create table ns_objects (hash blob primary key, kind integer, size integer, stored_size integer, codec text, content blob, created_at integer)")
        c.executemany("insert into ns_objects values (?, 1, 1, 1, 'raw', ?, 5)", [(digest(bytes([i])), bytes([i])) for i in range(50)])
        c.execute("create table ns_file_recipe_cache (file_hash blob primary key, recipe_hash blob, updated_at integer)")
    load = lambda **o: spark.read.format("sqlitestore").options(namespace="ns", **o).load(str(path))
    rows = load(partitions="4").collect()
    assert len(rows) == 50 and {bytes(r.hash) for r in rows} == {digest(bytes([i])) for i in range(50)}
    assert load(table="file_recipe_cache").count() == 0
    few = load(partitions="7", columns="created_at, hash")
    assert few.columns == ["created_at", "hash"] and few.rdd.getNumPartitions() == 7 and few.filter("created_at = 5").count() == 50
    for bad in ({"table": "nothing"}, {"columns": "hash,nothing"}):
        with pytest.raises(Exception, match="InvalidConfig|unknown"):
            load(**bad).count()


def test_sqlite_write(spark, tmp_path):
    spark.dataSource.register(SqliteStore)
    folder = str(tmp_path / "out")
    rows = spark.createDataFrame([(bytes([i % 40]), 1, 1, 1, "raw", bytes([i]), i) for i in range(50)], schema.OBJECTS)
    rows.repartition(3, "hash").write.format("sqlitestore").options(namespace="ns").mode("append").save(folder)
    load = lambda **o: spark.read.format("sqlitestore").options(namespace="ns", **o).load(folder)
    assert {bytes(r.hash) for r in load().collect()} == {bytes([i]) for i in range(40)} and load().count() == 40
    assert load(table="merkle_nodes").count() == 0  # all tables are there
    with pytest.raises(Exception, match="InvalidConfig|unknown"):
        rows.withColumnRenamed("size", "sizes").write.format("sqlitestore").mode("append").save(folder)


def test_files(spark, tmp_path):
    (tmp_path / "a.PDF").write_bytes(b"%PDF")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "noext").write_bytes(b"x")
    (tmp_path / "empty").write_bytes(b"")
    got = {r.file_id.rsplit("/", 1)[1]: (bytes(r.bytes), r.extension) for r in files_source.binary_files(spark, str(tmp_path)).collect()}
    assert got == {"a.PDF": (b"%PDF", "PDF"), "noext": (b"x", None)}


def test_stream_is_idempotent(spark, tmp_path):
    source, path = tmp_path / "in", str(tmp_path / "store")
    rows = spark.createDataFrame([(i, b"file %d " % (i % 7) * 50, "txt") for i in range(20)], "file_id long, bytes binary, extension string")
    rows.repartition(4).write.parquet(str(source))
    stream = lambda mark: ingest_stream(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(str(source)), path, str(tmp_path / mark)).awaitTermination()
    stream("one")
    first = {bytes(r.hash) for r in Store.open(spark, path).meta().collect()}
    assert len(first) == 14 and Store.open(spark, path).cache.count() == 7
    stream("two")  # all over again
    assert {bytes(r.hash) for r in Store.open(spark, path).meta().collect()} == first
    assert put_files(Store.empty(spark), rows, P.Config()).objects.count() == 14
    ingest_stream(spark.readStream.schema(rows.schema).parquet(str(source)), path, str(tmp_path / "three"), compact_after=1).awaitTermination()
    store = Store.open(spark, path)
    assert len(store.commits) == 1 and {bytes(r.hash) for r in store.meta().collect()} == first and store.cache.count() == 7
