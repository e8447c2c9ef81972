"""Differences between copies against a brute-force comparison."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairnlake.operators import differences as X

SCHEMA = "hash binary, pack_id long, put_seq long, kind int, size long, stored_size long, codec string, content binary, created_at long, row_key string, field string, a int"
FIELDS = ("pack_id", "kind", "size", "stored_size", "codec", "content", "created_at")


def brute(a, b):
    def side(rows):
        out = {}
        for r in rows:
            if r[0] is None:
                continue
            rank = ((r[8] is None, r[8] or 0), (r[2] is None, r[2] or 0))
            if r[0] not in out or rank < out[r[0]][0]:
                out[r[0]] = (rank, r)
        norm = lambda c: None if c is None else c.strip(" ").lower()
        return {h: dict(zip(FIELDS, (r[1], r[3], r[4], r[5], norm(r[6]), r[7], r[8]))) for h, (_, r) in out.items()}

    x, y = side(a), side(b)
    out = {(h, "only_a") for h in x.keys() - y.keys()} | {(h, "only_b") for h in y.keys() - x.keys()}
    return out | {(h, f) for h in x.keys() & y.keys() for f in FIELDS if x[h][f] != y[h][f]}


def check(spark, a, b):
    got = X.object_differences(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA)).collect()
    pairs = [(bytes(r.row_key), r.field) for r in got]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == brute(a, b)


def test_nulls_ties_and_empty(spark):
    row = lambda h, seq, **k: (h, k.get("pack", 1), seq, k.get("kind", 1), k.get("size", 5), 5, k.get("codec", "raw"), k.get("content"), k.get("at", 7), "x", "y", 1)
    a = [row(b"1", 1), row(b"1", 1), row(b"1", 2, size=9), row(b"2", 3, codec=None), row(b"3", 4, content=b""), row(None, 5), row(b"5", 6, at=None), row(b"6", 7)]
    b = [row(b"1", 9, codec=" RAW "), row(b"2", 8), row(b"3", 4), row(b"4", 4), row(b"5", 1, at=None), row(b"6", 7, kind=None)]
    check(spark, a, b)
    check(spark, [], b)
    check(spark, a, [])
    check(spark, [], [])


def test_random_with_hot_key(spark):
    r = random.Random(3)
    rows = lambda: [(bytes([0 if r.random() < 0.4 else r.randint(0, 80)]), r.randint(1, 2), i, r.choice([1, 2, None]), r.randint(1, 3), 1, r.choice(["raw", "Raw ", "zstd", None]), r.choice([None, b"x"]), r.randint(1, 40), "x", "y", 1) for i in range(500)]
    check(spark, rows(), rows())


def test_more_differences_than_words(spark, monkeypatch):
    """Where differing keys outnumber the bitmap's words, it is put together before it comes to the driver."""
    monkeypatch.setattr(X, "LEAST_SLOTS", 128)
    monkeypatch.setattr(X, "MOST_SLOTS", 128)
    row = lambda h, kind: (h, 1, 1, kind, 1, 1, "raw", None, 1, "x", "y", 1)
    check(spark, [row(b"%d" % i, 1) for i in range(60)], [row(b"%d" % i, 1 + i % 2) for i in range(20, 90)])


def test_summaries(spark):
    s = "pack_id long, side string, root binary, leaf_count long, computed_at long"
    rows = [(1, "a", b"x", 1, 5), (1, "a", b"y", 1, 9), (1, "a", b"y", 1, 9), (1, "b", b"y", 2, 1), (2, "a", None, 1, 1), (2, "b", None, 1, 1), (3, "b", b"q", 1, 1), (4, "a", None, 3, 1), (4, "b", b"z", 3, 1)]
    got = {(r.row_key, r.field) for r in X.summary_differences(spark.createDataFrame(rows, s)).collect()}
    assert got == {(1, "leaf_count"), (3, "only_b"), (4, "root")}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.booleans(), max_size=300), st.lists(st.booleans(), max_size=300), st.integers(0, 3))
def test_bitmaps(x, y, far):
    pad = np.zeros(far * X.CONTAINER, bool)
    a, b = (np.concatenate([pad, np.array(v, bool)]) for v in (x, y))
    n = max(len(a), len(b))
    a, b = np.pad(a, (0, n - len(a))), np.pad(b, (0, n - len(b)))
    p, q = X.PresenceBitmap.of(a), X.PresenceBitmap.of(b)
    assert (p.and_not(q).ordinals() == np.flatnonzero(a & ~b)).all()
    assert (p.intersect(q).ordinals() == np.flatnonzero(a & b)).all()


def test_bitmap_forms():
    run, sparse, dense = np.ones(X.CONTAINER, bool), np.zeros(X.CONTAINER, bool), np.arange(X.CONTAINER) % 2 == 0
    sparse[::5000] = True
    forms = [X.PresenceBitmap.of(v) for v in (run, sparse, dense)]
    assert [m.containers[0][0] for m in forms] == ["runs", "array", "bits"]
    assert [len(m.ordinals()) for m in forms] == [X.CONTAINER, sparse.sum(), X.CONTAINER // 2]
    assert forms[0].nbytes() < 64


def test_report(spark):
    rows = spark.createDataFrame([("objects", "1", "size"), ("objects", "2", "size")], "ds string, row_key string, field string")
    assert [tuple(r) for r in X.report(rows).collect()] == [("objects", "size", 2)]
    assert X.report(rows.filter(F.lit(False))).count() == 0
