"""Per-key results against a brute-force count."""

import random
from collections import defaultdict

import pytest

from cairnlake.operators import heavy_keys as X

RECIPES = "recipe_id long, chunks array<struct<hash:binary,len:long>>, key string, tab string"
OBJECTS = "put_seq long, hash binary, size long, record string"


def brute(recipes, objects):
    out = defaultdict(lambda: [0, 0, set()])
    for rid, chunks in {r[0]: r[1] for r in recipes}.items():
        for h, n in chunks or ():
            if h is not None:
                e = out[0, h]
                e[0], e[1] = e[0] + 1, e[1] + (n or 0)
                e[2].add(rid)
    for seq, (h, n) in {o[0]: o[1:3] for o in objects}.items():
        if h is not None:
            e = out[1, h]
            e[0], e[1] = e[0] + 1, e[1] + (n or 0)
            e[2].add(seq)
    return {k: (a, b, len(c)) for k, (a, b, c) in out.items()}


def check(spark, recipes, objects):
    got = X.per_key(spark.createDataFrame(recipes, RECIPES), spark.createDataFrame(objects, OBJECTS)).collect()
    assert len(got) == len({(r.tab, bytes(r.key)) for r in got})
    want = brute(recipes, objects)
    assert {(r.tab, bytes(r.key)): (r.entries, r.bytes, r.records) for r in got} == want
    totals = defaultdict(int)
    for (t, _), (n, *_rest) in want.items():
        totals[t] += n
    found = X.found(spark.createDataFrame(recipes, RECIPES), spark.createDataFrame(objects, OBJECTS)).collect()
    names = {0: "recipes", 1: "objects"}
    assert {(r.tab, r.hash_hex) for r in found} == {(names[t], h.hex()) for (t, h), (n, *_r) in want.items() if n >= 0.015 * totals[t]}


def test_small(spark):
    recipes = [(1, [(b"a", 3), (b"a", None), (None, 2), (b"", 1)], "x", "y"), (1, [(b"a", 3), (b"a", None), (None, 2), (b"", 1)], "x", "y"), (2, None, "x", "y"), (3, [], "x", "y"), (4, [(b"a", 1)], "x", "y")]
    check(spark, recipes, [(1, b"a", 5, "z"), (1, b"a", 5, "z"), (2, b"a", None, "z"), (3, None, 1, "z")])


def test_empty(spark):
    check(spark, [], [])


@pytest.mark.parametrize("seed", range(3))
def test_hot_keys(spark, seed):
    r = random.Random(seed)
    pick = lambda: b"hot" if r.random() < 0.5 else bytes([r.randint(0, 60)])
    recipes = [(i, [(pick(), r.randint(1, 9)) for _ in range(r.randint(0, 30))], "x", "y") for i in range(300)]
    recipes += recipes[:40]
    objects = [(i, pick(), r.randint(1, 9), "z") for i in range(500)]
    check(spark, recipes, objects + objects[:60])


def test_one_record_across_partitions(spark):
    """A single record whose entries fill several partitions is one referring record."""
    check(spark, [(1, [(b"k", 1)] * 20000, "x", "y")], [])
