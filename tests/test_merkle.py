"""Merkle index, proofs and their verification."""

import random

import pytest
from pyspark.sql import functions as F

from cairnlake import errors
from cairnlake.functions.hashing import digest
from cairnlake.operators import merkle as X


def frame(spark, values):
    return spark.createDataFrame([(v, "x") for v in values], "hash binary, pos string")


def brute(values):
    rows = [sorted({v for v in values if v is not None})]
    while len(rows[-1]) > 1:
        r = rows[-1]
        rows.append([digest(r[i] + r[min(i + 1, len(r) - 1)]) for i in range(0, len(r), 2)])
    return rows


def test_golden(spark):
    index = X.build(frame(spark, [digest(x) for x in (b"foo", b"bar", b"baz")]))
    assert index.leaf_count == 3 and index.root.hex() == "a9d8351dec4f8e3406133cef0551cba10f0202542da4ef8c3001f3ce2adf19aa"
    proofs = X.prove(index, frame(spark, [digest(b"bar"), digest(b"none")]))
    got = {bytes(r.hash): r for r in X.verified(proofs, index.root, 3).collect()}
    assert got[digest(b"bar")].valid and not got[digest(b"none")].valid and got[digest(b"none")].siblings is None
    assert X.summary(index.meta(spark)) == (index.root, 3) == X.recompute(index.leaves)
    with pytest.raises(errors.MissingMeta):
        X.summary(index.meta(spark).filter("key <> 'root_hash'"))


@pytest.mark.parametrize("n", [0, 1, 2, 5, 8, 33])
@pytest.mark.parametrize("bits", [2, 16])
def test_levels(spark, monkeypatch, n, bits):
    monkeypatch.setattr(X, "BLOCK_BITS", bits)
    values = [digest(bytes([i])) for i in range(n)]
    index = X.build(frame(spark, values + values[:2] + [None]))
    want = brute(values)
    got = {(r.level, r.pos): bytes(r.hash) for r in index.nodes.collect()}
    assert got == {(k, i): h for k, row in enumerate(want[1:]) for i, h in enumerate(row)}
    assert index.root == (want[-1][0] if n else X.EMPTY_ROOT)
    assert {bytes(r.hash): r.pos for r in index.leaves.collect()} == {h: i for i, h in enumerate(want[0])}
    proofs = X.verified(X.prove(index, frame(spark, values)), index.root, index.leaf_count)
    assert proofs.filter("valid").count() == n


def test_verify_is_strict():
    rows = brute([digest(x) for x in (b"a", b"b", b"c")])
    leaf, root = rows[0][2], rows[-1][0]
    proof = [leaf, rows[1][0]]
    assert X.verify(leaf, 2, proof, root, 3)
    assert not X.verify(leaf, 3, proof, root, 3) and X.verify(leaf, 3, proof, root, 3, compat=True)
    assert not X.verify(leaf, 2, proof, root, 0) and not X.verify(leaf, 2, proof[:1], root, 3) and not X.verify(leaf, 1, proof, root, 3)
    for i in range(2):
        bad = list(proof)
        bad[i] = digest(bad[i])
        assert not X.verify(leaf, 2, bad, root, 3)


def test_staleness(spark):
    index = X.leaves(frame(spark, [b"a", b"b"]))
    got = {(bytes(r.hash), r.state) for r in X.staleness(index, frame(spark, [b"b", b"c", b"c"])).collect()}
    assert got == {(b"a", "dangling"), (b"c", "unindexed")}


def test_ranked(spark):
    r = random.Random(2)
    values = [(r.randint(0, 50), i) for i in range(500)]
    got = X.ranked(spark.createDataFrame(values, "k int, i int"), ["k", "i"]).collect()
    assert [(x.k, x.i) for x in sorted(got, key=lambda x: x.pos)] == sorted(values)
    assert X.ranked(spark.createDataFrame([], "k int"), ["k"]).agg(F.count("pos")).first()[0] == 0
