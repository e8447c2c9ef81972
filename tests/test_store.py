"""Store, closure and garbage collection."""

import pytest
from pyspark.sql import functions as F

from cairnlake import errors, schema
from cairnlake.functions import codec as C
from cairnlake.functions import recipe as R
from cairnlake.functions.hashing import digest
from cairnlake.operators import closure, store

ORDERED = "hash binary, kind int, size long, stored_size long, codec string, content binary, created_at long, n long"


def obj(data, kind=1, codec="raw", n=0, **other):
    stored = C.compress(codec, data)
    return (other.get("hash", digest(data)), kind, other.get("size", len(data)), len(stored), codec, other.get("content", stored), 0, n)


def recipe(*chunks, file=b"file"):
    return R.build(len(file), digest(file), [(digest(c), n) for c, n in chunks])


def objects(spark, *rows):
    return spark.createDataFrame(list(rows), ORDERED)


def build(spark, rows, cache=(), **options):
    s = store.Store.empty(spark, **options).put_objects(objects(spark, *rows), F.col("n"))
    return s.put_cache(spark.createDataFrame(list(cache), "file_hash binary, recipe_hash binary, updated_at long, n long"), ["n"])


def test_first_writer_and_last_writer(spark):
    h = digest(b"x")
    s = build(spark, [obj(b"x", n=2, size=9), obj(b"x", n=1, size=8), obj(b"y", n=3)], [(b"f", b"1", 1, 1), (b"f", b"2", 1, 2), (b"g", None, 1, 1)])
    assert {bytes(r.hash): r.size for r in s.objects.collect()} == {h: 8, digest(b"y"): 1}
    assert {bytes(r.file_hash): r.recipe_hash and bytes(r.recipe_hash) for r in s.cache.collect()} == {b"f": b"2", b"g": None}
    s = s.put_objects(objects(spark, obj(b"x", size=7), obj(b"z")), F.col("n"))
    assert {bytes(r.hash): r.size for r in s.objects.collect()} == {h: 8, digest(b"y"): 1, digest(b"z"): 1}


def test_lookups(spark):
    s = build(spark, [obj(b"a"), obj(b"b", kind=2)])
    asked = spark.createDataFrame([(digest(b"a"),), (digest(b"a"),), (digest(b"b"),), (digest(b"q"),), (None,)], "hash binary")
    assert {bytes(r.hash) for r in store.existing(s.objects, asked).collect()} == {digest(b"a"), digest(b"b")}
    assert {bytes(r.hash): r.stored_size for r in store.chunk_stored_bytes(s.objects, asked).collect()} == {digest(b"a"): 1, digest(b"b"): None, digest(b"q"): None}
    order = sorted([digest(b"a"), digest(b"b")])
    assert [bytes(r.hash) for r in store.page(s.objects, None, 5).collect()] == order
    assert [bytes(r.hash) for r in store.page(s.objects, order[0], 5).collect()] == order[1:]
    assert [bytes(r.bytes) for r in store.read_object(s.objects, digest(b"a")).collect()] == [b"a"] and store.read_object(s.objects, b"").count() == 0
    assert store.lookup(s.objects, digest(b"a")).count() == 1 and store.lookup(s.objects, b"").count() == 0


def test_verify_errors(spark):
    rows = [obj(b"raw" * 9), obj(b"z" * 900, codec="zstd"), obj(b"b" * 900, codec="brotli"), obj(b"", codec="zstd")]
    bad = [
        obj(b"1" * 90, codec="zstd", content=b"not-zstd"), obj(b"2", size=2), obj(b"3", hash=digest(b"4")), (digest(b"5"), 3, 1, 1, "raw", b"5", 0, 0), (digest(b"6"), 1, 1, 1, "lz4", b"6", 0, 0),
        (digest(b"7"), 1, -1, 1, "raw", b"7", 0, 0), (digest(b"8"), 1, 1, 1, None, b"8", 0, 0), (digest(b"9"), 1, 1, 1, "raw", None, 0, 0),
    ]
    read = store.verify(objects(spark, *rows, *bad)).collect()
    assert [r.error_class for r in read] == [None] * 4 + ["Decompress", "ObjectLengthMismatch", "ObjectHashMismatch", "Integrity", "InvalidCodec", "Integrity", "InvalidCodec", "Decompress"]
    assert bytes(read[2].bytes) == b"b" * 900 and bytes(read[3].bytes) == b""
    with pytest.raises(Exception, match="ObjectLengthMismatch"):
        store.read_object(objects(spark, bad[1]), bad[1][0]).collect()
    with pytest.raises(Exception, match="ObjectLengthMismatch"):
        store.strict(store.verify(objects(spark, bad[1]))).collect()


def test_snapshots(spark, tmp_path):
    path = str(tmp_path)
    s = store.Store.open(spark, path, "ns").put_objects(objects(spark, obj(b"a"), obj(b"b")), F.col("n")).commit()
    assert s.meta().count() == 2 and "content" not in s.meta().columns
    gone = s.delete_objects(spark.createDataFrame([(digest(b"a"),)], "hash binary"))
    assert store.Store.open(spark, path, "ns").objects.count() == 2  # not committed
    gone.commit()
    again = store.Store.open(spark, path, "ns", read_only=True)
    assert [bytes(r.content) for r in again.objects.collect()] == [b"b"]
    with pytest.raises(errors.InvalidConfig):
        again.commit()
    with pytest.raises(errors.InvalidConfig):
        store.Store.open(spark, path, "other", read_only=True)
    for name in ("", "a-b", "ä"):
        with pytest.raises(errors.InvalidConfig):
            store.Store.open(spark, path, name)
    with pytest.raises(errors.Integrity):
        store.Store.empty(spark, merkle=False).require_merkle()


def test_garbage(spark):
    live, dead = recipe((b"shared", 4), file=b"l"), recipe((b"shared", 4), file=b"d")
    rows = [obj(b"shared"), obj(b"orphan"), obj(live, 2), obj(dead, 2)]
    s = build(spark, rows, [(b"f", digest(live), 1, 1), (b"g", digest(dead), 1, 1), (b"h", digest(b"nowhere"), 1, 1)])
    wanted = spark.createDataFrame([(digest(live),), (digest(live),)], "hash binary")
    after, report = closure.collect_garbage(s, wanted)
    assert report == {"deleted_chunks": 1, "deleted_recipes": 1, "freed_bytes": 6 + 85}
    assert {bytes(r.hash) for r in after.objects.collect()} == {digest(b"shared"), digest(live)}
    assert [bytes(r.file_hash) for r in after.cache.collect()] == [b"f"]
    none, report = closure.collect_garbage(s, wanted.limit(0))
    assert none.objects.count() == 0 and none.cache.count() == 0 and report["deleted_chunks"] == 2


@pytest.mark.parametrize(
    ("rows", "live", "error"),
    [
        ([obj(b"a")], b"nowhere", errors.Integrity),
        ([obj(b"\xff\xff", 2)], b"\xff\xff", errors.InvalidRecipe),
        ([obj(recipe((b"lost", 4)), 2)], recipe((b"lost", 4)), errors.Integrity),
        ([obj(recipe((b"odd", 3)), 2), obj(b"odd", 2)], recipe((b"odd", 3)), errors.ObjectKindMismatch),
        ([obj(b"chunk")], b"chunk", errors.ObjectKindMismatch),
    ],
)
def test_garbage_refused(spark, rows, live, error):
    s = build(spark, rows)
    with pytest.raises(error):
        closure.collect_garbage(s, spark.createDataFrame([(digest(live),)], "hash binary"))


def test_closure_report(spark):
    entries = spark.createDataFrame([(b"r", 0, b"a", 1), (b"r", 1, b"a", 1), (b"r", 2, b"b", 1)], "recipe_hash binary, ordinal int, hash binary, len long")
    stored = spark.createDataFrame([(b"r", 2, 1), (b"a", 1, 1), (b"c", 1, 1), (b"s", 2, 1)], "hash binary, kind int, size long")
    live = spark.createDataFrame([(b"r",), (None,)], "hash binary")
    assert tuple(closure.closure_report(live, entries, stored).first()) == (1, 1, 1)
    assert [bytes(r.hash) for r in closure.missing(live, entries, stored).collect()] == [b"b"]
    assert tuple(closure.gc_report(live, entries, stored.withColumn("stored_size", F.lit(3))).first()) == (1, 1, 6)


def test_resolve(spark):
    entries = spark.createDataFrame([(b"r", 0, b"a", 1), (b"r", 1, b"b", 2), (b"r", 2, b"k", 1), (b"r", 3, b"no", 1), (b"r", 4, b"n", None)], "recipe_hash binary, ordinal int, hash binary, len long")
    stored = spark.createDataFrame([(b"a", 1, 1), (b"b", 1, 1), (b"k", 2, 1), (b"n", 1, 1)], "hash binary, kind int, size long")
    got = {bytes(r.hash): r.error_class for r in closure.resolve(entries, stored).collect()}
    assert got == {b"a": None, b"b": "RecipeChunkLengthMismatch", b"k": "ObjectKindMismatch", b"no": "ObjectNotFound", b"n": "RecipeChunkLengthMismatch"}


def test_audit(spark):
    rows = objects(spark, obj(b"a"), obj(b"a"), (b"short", 9, -1, 5, "lz4", b"x", 0, 0), (None, None, None, None, None, None, 0, 0))
    assert {r.rule: r.violations for r in store.audit(rows).collect()} == {"unique_hash": 1, "hash_length": 2, "kind": 2, "codec": 2, "size": 2, "stored_size": 1}
    assert schema.namespace(None) == "" and schema.namespace("a_1") == "a_1_"


def test_transaction_and_scan(spark, tmp_path):
    s = store.Store.open(spark, str(tmp_path)).put_objects(objects(spark, obj(b"a")), F.col("n")).commit()
    with pytest.raises(ZeroDivisionError):
        s.transaction(lambda x: 1 / 0)
    assert store.Store.open(spark, str(tmp_path)).objects.count() == 1
    s = s.transaction(lambda x: x.put_objects(objects(spark, obj(b"b"), obj(b"c")), F.col("n")).delete_objects(spark.createDataFrame([(digest(b"a"),)], "hash binary")))
    rows = store.all_objects(s.objects).collect()
    assert [bytes(r.hash) for r in rows] == sorted([digest(b"b"), digest(b"c")]) and {bytes(r.bytes) for r in rows} == {b"b", b"c"}


def folders(path):
    return {p.name for p in path.iterdir() if p.is_dir()}


def rows_in(spark, path, part):
    return sum(spark.read.parquet(str(p)).count() for p in path.glob(f"commit-*/{part}"))


def test_a_commit_writes_what_is_new(spark, tmp_path):
    path = str(tmp_path)
    hashes = lambda *data: spark.createDataFrame([(digest(d),) for d in data], "hash binary")
    content = lambda s: {bytes(r.content) for r in s.objects.collect()}
    s = store.Store.open(spark, path).put_objects(objects(spark, *[obj(b"%d" % i) for i in range(50)]), F.col("n")).commit()
    s = s.put_objects(objects(spark, obj(b"7"), obj(b"new")), F.col("n")).commit()
    assert rows_in(spark, tmp_path, "meta") == rows_in(spark, tmp_path, "content") == 51 and s.objects.count() == 51
    s = s.delete_objects(hashes(b"7", b"new", b"nowhere")).commit()
    assert rows_in(spark, tmp_path, "content") == 51 and s.objects.count() == s.meta().count() == 49
    s = s.transaction(lambda x: x.put_objects(objects(spark, obj(b"7"), obj(b"8")), F.col("n")).delete_objects(hashes(b"8")).put_objects(objects(spark, obj(b"9"), obj(b"8")), F.col("n")))
    assert content(s) == {b"%d" % i for i in range(50)} and rows_in(spark, tmp_path, "content") == 53
    assert s.transaction(lambda x: x).version == 5 and len(folders(tmp_path)) == 4  # nothing new, nothing written
    want = content(s)
    small = store.Store.open(spark, path).compact()
    assert len(small.commits) == 1 and content(small) == want
    with pytest.raises(errors.Integrity):
        s.put_objects(objects(spark, obj(b"late")), F.col("n")).commit()  # the state it began with is no longer the last
    assert len(small.vacuum()) == 5 and content(store.Store.open(spark, path)) == want and len(folders(tmp_path)) == 1


def test_cache_over_commits(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(list(r), "file_hash binary, recipe_hash binary, updated_at long, n long")
    r1, r2 = recipe(file=b"1"), recipe(file=b"2")
    s = store.Store.open(spark, str(tmp_path)).put_objects(objects(spark, obj(r1, 2), obj(r2, 2)), F.col("n"))
    s = s.put_cache(rows((b"f", digest(r1), 1, 1), (b"g", digest(r1), 1, 1)), ["n"]).commit()
    s = s.put_cache(rows((b"f", digest(r2), 2, 1)), ["n"]).commit()
    got = lambda x: {bytes(r.file_hash): bytes(r.recipe_hash) for r in x.cache.collect()}
    assert got(s) == {b"f": digest(r2), b"g": digest(r1)}
    s = s.delete_objects(spark.createDataFrame([(digest(r1),)], "hash binary"))
    assert got(s) == got(s.commit()) == {b"f": digest(r2)}


def test_verified_puts(spark):
    content = lambda *d: spark.createDataFrame([(digest(x), x) for x in d], "hash binary, bytes binary")
    s = store.Store.empty(spark).put_chunks(content(b"a" * 900, b"short", b""), created_at=5).put_recipes(content(recipe((b"short", 5))))
    got = {bytes(r.hash): (r.kind, r.codec, r.size, r.created_at) for r in s.objects.collect()}
    assert got[digest(b"a" * 900)] == (1, "zstd", 900, 5) and got[digest(b"short")] == (1, "raw", 5, 5) and got[digest(b"")] == (1, "raw", 0, 5)
    assert len(got) == 4 and got[digest(recipe((b"short", 5)))][:2] == (2, "raw")
    assert {r.error_class for r in store.verify(s.objects).collect()} == {None}
    bad = spark.createDataFrame([(digest(b"x"), b"y", 1), (digest(b"z"), None, 2), (digest(b"ok"), b"ok", 3)], "hash binary, bytes binary, n int")
    with pytest.raises(errors.HashMismatch):
        s.put_chunks(bad)
    assert [r.error_class for r in store.prepare_objects(bad, schema.CHUNK, "zstd").orderBy("n").collect()] == ["HashMismatch", "HashMismatch", None]
    assert store.prepare_objects(bad.limit(0), schema.CHUNK, "zstd").count() == 0
    assert [r.error_class for r in store.prepare_objects(bad.filter("n = 3"), schema.CHUNK, "lz4").collect()] == ["InvalidCodec"]
    with pytest.raises(errors.InvalidConfig):
        store.prepare_objects(bad, 7, "zstd")


def test_stored_merkle_index(spark, tmp_path):
    from cairnlake.operators import merkle

    path, some = str(tmp_path), [b"%d" % i for i in range(9)]
    s = store.Store.open(spark, path).put_objects(objects(spark, *map(obj, some)), F.col("n"))
    with pytest.raises(errors.MissingMeta):
        s.commit().merkle_index()
    s = store.Store.open(spark, path).rebuild_merkle().commit()
    index = s.merkle_index()
    assert index.leaf_count == 9 and index.root == merkle.build(s.meta()).root
    later = s.put_objects(objects(spark, obj(b"new")), F.col("n")).commit()
    assert later.merkle_index().root == index.root  # puts leave it stale
    assert {r.state for r in merkle.staleness(later.merkle_index().leaves, later.meta()).collect()} == {"unindexed"}
    gone = later.delete_objects(spark.createDataFrame([(digest(b"3"),)], "hash binary")).commit()
    assert gone.merkle_index().leaf_count == 9 and gone.merkle_index().root == merkle.build(gone.meta()).root != index.root
    assert merkle.staleness(gone.merkle_index().leaves, gone.meta()).count() == 0
    assert all(r.valid for r in merkle.verified(merkle.prove(gone.merkle_index(), gone.meta()), gone.merkle_index().root, 9).collect())
    closed = store.Store.open(spark, path, merkle=False)
    for call in (closed.merkle_index, closed.rebuild_merkle):
        with pytest.raises(errors.Integrity):
            call()
    kept = closed.delete_objects(spark.createDataFrame([(digest(b"4"),)], "hash binary")).commit()
    assert kept.index == gone.index  # nothing is rebuilt where the index is disabled
