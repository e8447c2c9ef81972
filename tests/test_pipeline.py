"""Hashing, codecs, recipes, chunking, ingest and restore."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairnlake import errors, schema
from cairnlake.functions import codec as C
from cairnlake.functions import hashing as H
from cairnlake.functions import recipe as R
from cairnlake.functions.chunking import ONE_CHUNK, Splitter, chunk_spans
from cairnlake.operators import pipeline as P
from cairnlake.operators import restore as X
from cairnlake.operators import store
from cairnlake.operators import transforms as T

HELLO = "3338be694f50c5f338814986cdf0686453a888b84f424d792af4b9202398f392"


def test_hash_and_hex(spark):
    assert H.digest(b"hello").hex() == HELLO
    rows = spark.createDataFrame([(HELLO,), (HELLO.upper(),), ("abcd",), ("zz" * 32,), ("abc",), (None,), ("",)], "x string").select(H.parse_hex("x").alias("p")).collect()
    assert [r.p.error_class for r in rows] == [None, None, "InvalidHashLength", "InvalidHex", "InvalidHex", None, "InvalidHashLength"]
    assert bytes(rows[1].p.hash).hex() == HELLO
    row = spark.createDataFrame([(b"a", b"b", None)], "l binary, r binary, n binary").select(H.hash_pair("l", "r").alias("h"), H.sha3_256("n").alias("n"), H.to_hex("l").alias("x")).first()
    assert bytes(row.h) == H.digest(b"ab") and row.n is None and row.x == "61"


def test_codec_choice(spark):
    noise = random.Random(1).randbytes(4096)
    assert C.compress_auto(b"\1" * 4096)[0] == "brotli"
    assert C.compress_auto(b"\0" * 8)[0] == "raw"
    assert C.compress_auto(bytes(range(256)) * 256)[0] == "raw" and C.shannon_entropy(bytes(range(256))) == 8
    assert C.compress_auto(noise, "JPG")[0] == "raw" and C.decide_codec(b"text", "pdf") == "brotli"
    assert C.shannon_entropy(b"") == 0 and C.decide_codec(bytes(range(128)) * 9) == "zstd"
    for codec in ("raw", "zstd", "brotli"):
        for data in (b"", b"x", b"abc" * 5000, noise):
            assert C.decompress(codec, C.compress(codec, data)) == data
    for codec in ("zstd", "brotli"):
        with pytest.raises(errors.DecompressError):
            C.decompress(codec, b"not a stream")
    with pytest.raises(errors.InvalidCodec):
        C.compress("lz4", b"")
    rows = spark.createDataFrame([("PNG",), ("pdf",), (None,)], "e string").select(C.is_compressed_extension("e").alias("x"), C.codec_of(F.lit(1.0), F.col("e")).alias("c")).collect()
    assert [tuple(r) for r in rows] == [(True, "raw"), (False, "brotli"), (False, "brotli")]


def test_splitter_bounds():
    for bad in ((0, 2, 4), (4, 2, 8), (2, 8, 4), (3, 4, 8), (2, 5, 8), (2, 4, 9)):
        with pytest.raises(errors.InvalidCdcParams):
            Splitter(*bad)
    assert Splitter().split(b"") == [] and Splitter().split(b"\1" * 1024) == [(0, 1024)]
    assert len(ONE_CHUNK.split(b"x" * 100_000)) == 1


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**32), st.integers(0, 60_000), st.sampled_from([(64, 256, 1024), (256, 1024, 4096), (2, 2, 2), (128, 128, 256)]))
def test_splitter_covers(seed, size, bounds):
    data = random.Random(seed).randbytes(size)
    s = Splitter(*bounds)
    spans = s.split(data)
    at = 0
    for i, (offset, length) in enumerate(spans):
        assert offset == at and 0 < length <= s.max_size
        assert length >= s.min_size or i == len(spans) - 1
        at += length
    assert at == size and s.split(data) == spans


def test_cuts_follow_content():
    """A byte put in front moves the cuts with the content."""
    data = random.Random(5).randbytes(200_000)
    s = Splitter(256, 1024, 4096)
    parts = lambda d: {d[a : a + n] for a, n in s.split(d)}
    assert len(parts(data) & parts(b"!" + data)) > 0.9 * len(s.split(data))


def test_chunk_spans(spark):
    files = spark.createDataFrame([(1, b"x" * 5000, 1), (2, b"", 1), (3, None, 1)], "file_id long, bytes binary, offset int")
    got = chunk_spans(files, Splitter(256, 1024, 4096)).collect()
    assert {r.file_id for r in got} == {1} and sum(r.length for r in got) == 5000


def test_recipe_round_trip():
    chunks = [(H.digest(b"chunk-a"), 5), (H.digest(b"chunk-b"), 7)]
    data = R.build(42, H.digest(b"f"), chunks, 9, 3)
    r = R.parse(data, H.digest(data))
    assert (r.original_file_size, r.chunks, r.transform_id, r.transform_version, r.stored_stream_size) == (42, chunks, 9, 3, 12)
    assert R.preflight(data) == (42, 2) and len(data) == R.recipe_bytes_len(2)
    old = b"\1" + (11).to_bytes(8, "little") + (1).to_bytes(4, "little") + chunks[0][0] + (5).to_bytes(4, "little") + H.digest(b"f")
    assert R.parse(old).transform_id == 0 and R.parse(b"\2" + old[1:]).version == 2 and R.preflight(old) == (11, 1)
    for bad in (b"", b"\4" + data[1:], data[:20], data[:60], data + b"!", old[:-1], old + b"!", old[:30]):
        with pytest.raises(errors.InvalidRecipe):
            R.parse(bad)
    with pytest.raises(errors.HashMismatch):
        R.parse(data, H.digest(b"other"))


def test_known_graph():
    """Golden hashes of a small object graph."""
    c = [b"raw-object-fixture" * 3, b"zstd-object-fixture" * 128, b"brotli-object-fixture" * 128]
    assert H.digest(c[1]).hex() == "bbd79c3ccc53c3524587c69e8a3d5ea01fcff5c1849cceeb46db5438ec86896b"
    whole = c[0] + c[1] + c[2] + c[0]
    recipe = R.build(len(whole), H.digest(whole), [(H.digest(x), len(x)) for x in (c[0], c[1], c[2], c[0])])
    assert len(recipe) == 193 and H.digest(recipe).hex() == "37ff4a38084a11a23f2d990a768691109c7b6f6e8a6f6be5e8a8a3f75f3c5fb8"


def plans(spark, files, **config):
    rows = spark.createDataFrame(files, "file_id long, bytes binary, extension string")
    return P.plan_files(rows, P.Config(Splitter(64, 256, 1024), **config))


FILES = [(1, b"", None), (2, b"a", None), (3, b"block of text " * 400, "txt"), (4, b"block of text " * 400, None), (5, bytes(range(256)) * 30, "JPG"), (6, None, None)]


def test_plans(spark):
    got = {r.file_id: r for r in plans(spark, FILES).collect()}
    assert set(got) == {1, 2, 3, 4, 5} and got[1].chunks == [] and got[1].estimated_bytes == 49
    assert got[3].recipe_hash == got[4].recipe_hash and {c.codec for c in got[5].chunks} == {"raw"}
    assert got[3].estimated_bytes == sum(c.stored_len for c in got[3].chunks) + len(got[3].recipe)
    forced = plans(spark, FILES[1:2], policy="zstd", discard_payload=True).first()
    assert forced.chunks[0].codec == "zstd" and forced.chunks[0].payload is None and forced.chunks[0].stored_len > 1


def stored(spark, files=FILES):
    p = plans(spark, files)
    return p, store.first_writer_wins(P.plan_objects(p), F.col("input_ordinal"))


def test_restore(spark):
    p, objects = stored(spark)
    back = {bytes(r.recipe_hash): r for r in X.restore(p.select("recipe_hash"), objects).collect()}
    for r in p.select("file_id", "recipe_hash").collect():
        assert bytes(back[bytes(r.recipe_hash)].bytes) == dict((f[0], f[1]) for f in FILES)[r.file_id]
    assert all(r.error_class is None for r in back.values())


def rows(objects, change):
    """The objects with one of them changed or dropped."""
    out = [list(r) for r in objects.collect()]
    return [tuple(r) for r in out if change(r) is not False]


@pytest.mark.parametrize(
    ("change", "error"),
    [
        (lambda r: r[1] != 2, "ObjectNotFound"),
        (lambda r: r[1] != 1, "ObjectNotFound"),
        (lambda r: r.__setitem__(1, 3 - r[1]), "ObjectKindMismatch"),
        (lambda r: r.__setitem__(1, 2) if r[1] == 1 else None, "ObjectKindMismatch"),
        (lambda r: r.__setitem__(5, bytes([r[5][0] ^ 1]) + r[5][1:]) if r[1] == 1 else None, "ObjectHashMismatch"),
    ],
)
def test_restore_errors(spark, change, error):
    p, objects = stored(spark, [(2, b"a", None)])
    broken = spark.createDataFrame(rows(objects, change), objects.schema)
    assert [r.error_class for r in X.restore(p.select("recipe_hash"), broken).collect()] == [error]


def test_restore_limits_and_transforms(spark):
    p, objects = stored(spark, [(2, b"ab" * 300, None)])
    restore = lambda limits: X.restore(p.select("recipe_hash"), objects, limits=limits).first().error_class
    assert restore(X.Limits(chunks=0)) == restore(X.Limits(stored=599)) == restore(X.Limits(original=599)) == "FileReadLimitExceeded"
    assert restore(X.Limits()) is None
    chunk = b"ab"
    for size, version, file, error in ((2, 4, chunk, "UnsupportedTransform"), (3, 0, chunk, "OriginalFileMismatch"), (2, 0, b"xx", "OriginalFileMismatch")):
        data = R.build(size, H.digest(file), [(H.digest(chunk), 2)], 0, version)
        made = spark.createDataFrame([(H.digest(chunk), 1, 2, 2, "raw", chunk, 0), (H.digest(data), 2, len(data), len(data), "raw", data, 0)], objects.schema)
        assert X.restore(spark.createDataFrame([(H.digest(data),)], "recipe_hash binary"), made).first().error_class == error
    long = R.build(3, H.digest(b"abc"), [(H.digest(chunk), 3)])
    made = spark.createDataFrame([(H.digest(chunk), 1, 2, 2, "raw", chunk, 0), (H.digest(long), 2, len(long), len(long), "raw", long, 0), (H.digest(b"\xff"), 2, 1, 1, "raw", b"\xff", 0)], objects.schema)
    got = X.restore(spark.createDataFrame([(H.digest(long),), (H.digest(b"\xff"),)], "recipe_hash binary"), made).collect()
    assert {r.error_class for r in got} == {"RecipeChunkLengthMismatch", "InvalidRecipe"}


def test_write_files(spark, tmp_path):
    p, objects = stored(spark, [(2, b"ab" * 300, None)])
    out = X.write_files(X.restore(p.select("recipe_hash"), objects), str(tmp_path)).first()
    assert open(out.path, "rb").read() == b"ab" * 300 and len(list(tmp_path.iterdir())) == 1


def failing(name, id_, encode=lambda d: d, decode=lambda d: d, **k):
    return T.Transform(id_, 1, name, encode, decode, **k)


def boom(_):
    raise ValueError


def test_selection():
    data = b"some text that repeats " * 500
    config = P.Config(ONE_CHUNK, "raw")
    cases = (
        failing("skip", 11, quick_check=lambda *_: False), failing("enc", 12, boom), failing("dec", 13, decode=boom), failing("ver", 14, decode=lambda d: d[1:]), failing("same", 15),
        failing("half", 16, lambda d: d[: len(d) // 2], lambda _: data), failing("small", 17, lambda d: d[:9], lambda _: data), failing("tie", 18, lambda d: d[:9], lambda _: data), failing("off", 19, enabled=False),
    )
    every = {"min_size": 0, "allow_ext": None, "pipeline": config}
    found = T.select(data, None, cases, T.Selection(**every))
    report = found.report
    assert found.transform == (17, 1) and found.stream.into_bytes() == data[:9] and found.plan["stored_stream_size"] == 9
    assert [r["outcome"] for r in report] == ["Skipped", "EncodeFailed", "DecodeFailed", "VerificationFailed", "InsufficientGain", "LargerCandidate", "Selected", "LargerCandidate"]
    assert set(r["outcome"] for r in report) <= set(T.OUTCOMES)
    assert T.select(data, None, cases, T.Selection(enabled=False)).transform == T.NONE
    assert T.select(data, None, cases, T.Selection(max_size=5)).report == []
    none = T.select(data, None, cases[4:5], T.Selection(**every, max_in_memory=5))
    assert none.transform == T.NONE and none.report[0]["outcome"] == "BufferUnavailable" and none.plan["stored_stream_size"] == len(data)
    # the gate: too small, an extension that is not allowed, an allowed one, and content that begins like a known container
    outcome = lambda d, e, **k: T.select(d, e, (failing("small", 17, lambda x: x[:1], lambda _: d),), T.Selection(pipeline=config, **k)).report[0]["outcome"]
    big = b"%PDF" + bytes(40_000)
    assert [outcome(data, "png"), outcome(big[4:], "txt"), outcome(big[4:], "PNG"), outcome(big, None)] == ["Skipped", "Skipped", "Selected", "Selected"]
    assert outcome(big[4:], "txt", allow_ext=("txt",)) == outcome(data, "png", min_size=5) == "Selected"


def test_selected_stream_beyond_memory(tmp_path):
    data = bytes(50_000)
    case = (T.Transform(1005, 1, "half", lambda d: d[:20_000], lambda _: data),)
    found = T.select(data, "png", case, T.Selection(max_in_memory=100, spill_folder=str(tmp_path)))
    assert found.transform == (1005, 1) and not found.stream.in_memory and len(list(tmp_path.iterdir())) == 1
    assert found.stream.into_bytes() == data[:20_000] and not list(tmp_path.iterdir())


def test_decoders_stop():
    """A stream that unpacks to more than its file has is refused before all of it is unpacked."""
    import lzma
    import tracemalloc

    import zstandard

    huge = bytes(64 << 20)
    registry = T.Registry(T.OWN)
    streams = {T.OWN_FIRST_ID + 1: zstandard.ZstdCompressor().compress(huge), T.OWN_FIRST_ID + 2: lzma.compress(huge, preset=0)}
    del huge
    for id_, stream in streams.items():
        tracemalloc.start()
        with pytest.raises(errors.FileReadLimitExceeded):
            registry.decode(id_, 1, stream, 1000)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 32 << 20
    assert registry.decode(0, 0, b"abc", 3) == b"abc"
    with pytest.raises(errors.FileReadLimitExceeded):
        registry.decode(0, 0, b"abc", 2)


def test_a_chunk_with_half_of_all_entries_is_spread(spark):
    entries = spark.range(4000).select(F.encode(F.format_string("%04d", F.col("id") % 97), "UTF-8").alias("recipe_hash"), F.col("id").cast("int").alias("ordinal"), F.when(F.col("id") % 2 == 0, F.lit(b"hot")).otherwise(F.encode(F.col("id").cast("string"), "UTF-8")).alias("hash"))
    rows = X._in_parts(entries, spark.createDataFrame([(b"hot", 20)], "hash binary, parts int"))
    counts = sorted(r["count"] for r in rows.groupBy("hash", "part").count().filter(F.col("hash") == F.lit(b"hot")).collect())
    assert len(counts) == 20 and sum(counts) == 2000 and counts[-1] <= 2 * counts[10]
    assert rows.filter("hash <> 'hot' and part <> 0").count() == 0 and rows.count() == 4000


def test_hot_chunk_and_stored_streams(spark, monkeypatch):
    """A chunk that every file has comes to as many parts as its entries fill."""
    monkeypatch.setattr(X, "ENTRIES_A_PART", 3)
    splitter = Splitter(2, 2, 2)
    files = spark.createDataFrame([(i, b"ab" * 5 + b"%02d" % i, None) for i in range(8)], "file_id long, bytes binary, extension string")
    p = P.plan_files(files, P.Config(splitter))
    objects = store.first_writer_wins(P.plan_objects(p), F.col("input_ordinal"))
    back = X.restore(p.select("recipe_hash"), objects).collect()
    assert sorted(bytes(r.bytes) for r in back) == [b"ab" * 5 + b"%02d" % i for i in range(8)]
    stored_ = X.read_stored_streams(p.select("recipe_hash"), objects.filter(F.col("hash") != H.digest(b"07"))).collect()
    assert sorted((bytes(r.bytes) if r.bytes else None, r.error_class) for r in stored_ if r.bytes) == [(b"ab" * 5 + b"%02d" % i, None) for i in range(7)]
    assert [r.error_class for r in stored_ if not r.bytes] == ["ObjectNotFound"]


def test_transformed_ingest(spark):
    import zlib

    data = zlib.compress(b"some text that repeats " * 3000, 6)
    p = T.plan_with_selection(spark.createDataFrame([(1, data, "bin")], "file_id long, bytes binary, extension string"), bounds=T.Selection(min_size=0, allow_ext=None))
    row = p.first()
    assert row.transform_id >= T.OWN_FIRST_ID
    objects = store.first_writer_wins(P.plan_objects(p), F.col("input_ordinal"))
    back = X.restore(p.select("recipe_hash"), objects, T.Registry(T.OWN)).first()
    assert bytes(back.bytes) == data
    assert X.restore(p.select("recipe_hash"), objects).first().error_class == "UnsupportedTransform"
    with pytest.raises(errors.DuplicateTransformDecoder):
        T.Registry((*T.OWN, T.OWN[0]))


def test_gate(spark):
    rows = spark.createDataFrame([(10, "PNG", b"x"), (10, None, b"\x89PNG\r\n\x1a\nrest"), (10, None, b"%PD"), (1, "png", b"x"), (None, "png", None), (10, "txt", b"%PDF-1")], "size long, ext string, head binary")
    assert [r[0] for r in rows.select(T.gate("size", "ext", "head", 5, 20, ("png",))).collect()] == [True, True, False, False, False, True]


def test_codec_columns(spark):
    rows = spark.createDataFrame([("zstd", b"abc" * 99), ("auto", b"abc" * 99), ("lz4", b"x"), ("raw", None)], "c string, b binary").select(C.compressed("c", "b").alias("p"))
    got = rows.select("p", C.decompressed("p.codec", "p.bytes").alias("d")).collect()
    assert [r.p and r.p.error_class for r in got] == [None, None, "InvalidCodec", None] and got[1].p.codec == "brotli"
    assert bytes(got[0].d.bytes) == bytes(got[1].d.bytes) == b"abc" * 99 and got[3].p is None
    bad = spark.createDataFrame([("zstd", b"no")], "c string, b binary").select(C.decompressed("c", "b").alias("d")).first()
    assert bad.d.error_class == "Decompress"


def test_spool_and_reader(tmp_path):
    import io

    from cairnlake.functions.spool import Spool, temporary_folder

    small, large, unbounded = Spool(b"abc", 10, tmp_path), Spool(b"abc" * 10, 10, tmp_path), Spool(b"abc" * 10, 10)
    assert small.in_memory and not large.in_memory and len(large) == 30 and unbounded.in_memory
    large.write(b"!")
    with large.reader() as one, large.reader() as other:
        assert one.read(3) == other.read(3) == b"abc"
    assert large.into_bytes() == b"abc" * 10 + b"!" and not list(tmp_path.iterdir())
    assert unbounded.into_bytes() == b"abc" * 10 and small.into_bytes() == b"abc"
    assert H.digest_reader(io.BytesIO(b"x" * 20_000)) == H.digest(b"x" * 20_000)
    assert [temporary_folder(x, "/r") and temporary_folder(x, "/r").as_posix() for x in ("/a", "b/c", "", None)] == ["/a", "/r/b/c", None, None]


def test_chunked_queries_against_brute_force(spark, tmp_path):
    from cairnlake.plans import lake

    r = random.Random(8)
    shared = "".join(r.choice("abcdefgh ") for _ in range(30_000))
    texts = [shared, "One line before. " + shared, shared[:20_000] + " another end", shared, "short", "", None, "äöü" * 3000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    chunks, recipes, estimates = {}, set(), {}
    for i, text in enumerate(texts):
        if text is None:
            continue
        data, parts, at = text.encode(), [], 0
        for offset, length in lake.SMALL.split(data):
            assert offset == at
            part, at = data[at : at + length], at + length
            parts.append((H.digest(part), length))
            chunks[H.digest(part)] = len(C.compress_auto(part, None)[1])
        recipe = R.build(len(data), H.digest(data), parts)
        recipes.add(recipe)
        estimates[i] = (sum(chunks[h] for h, _ in parts) + len(recipe), len(data))
    got = {x.doc_id: (x.estimated_bytes, x.stored_stream_size) for x in lake.ingest_chunked_estimated_bytes(spark, str(tmp_path)).collect()}
    assert got == estimates
    (s,) = lake.ingest_chunked_dedup_summary(spark, str(tmp_path)).collect()
    total = sum(len(t.encode()) for t in texts if t)
    assert (s.files, s.bytes, s.recipes, s.chunks, s.stored_bytes) == (7, total, len(recipes), len(chunks), sum(chunks.values()))
    (whole,) = lake.ingest_dedup_summary(spark, str(tmp_path)).collect()
    assert whole.stored_bytes > 2 * s.stored_bytes
    (v,) = lake.ingest_chunked_verify_objects(spark, str(tmp_path)).collect()
    assert v.objects == v.verified == len(chunks)


def test_codec_parameters(spark):
    got = {r.b: r.w for r in spark.range(256).select(F.col("id").cast("int").alias("b"), C.window_bits(F.col("id").cast("int")).alias("w")).collect()}
    for b in range(256):
        try:
            assert got[b] == C.brotli_window_bits(b)
        except errors.DecompressError:
            assert got[b] is None
    sizes = spark.createDataFrame([(None,), (-1,), (4096,), (5000,), (1 << 40,)], "n long").select(C.clamp_dict_size("n").alias("n")).collect()
    assert [r.n for r in sizes] == [None, 4096, 4096, 5000, 4_294_967_280]
    names = spark.createDataFrame([("a_1",), ("a-b",), ("",), (None,), ("ä",), ("a\n",)], "n string").select(schema.is_namespace("n").alias("ok")).collect()
    assert [r.ok for r in names] == [True, False, False, False, False, False]


def test_windows_do_not_change_cut_points(monkeypatch):
    from cairnlake.functions import chunking

    data = random.Random(3).randbytes(300_000)
    whole = Splitter(256, 1024, 4096).split(data)
    for window in (64, 1000, 70_001):
        monkeypatch.setattr(chunking, "WINDOW", window)
        assert Splitter(256, 1024, 4096).split(data) == whole
