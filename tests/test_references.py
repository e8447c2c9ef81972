"""Orphan references against a brute-force reading of the rules."""

import random

import pytest
from pyspark.sql import functions as F

from cairnlake.operators import references as X

RECIPES = "recipe_id long, created_at long, chunks array<struct<hash:binary,len:long>>, hash string"
CACHE = "file_hash binary, recipe_hash binary, updated_at long"
REPORTS = "report_id long, checked_at long, missing_objects array<binary>"
OBJECTS = "hash binary, kind int, created_at long, at string"
DELETIONS = "hash binary, deleted_at long"
BASE = "hash binary, kind int"


def frames(spark, recipes=(), cache=(), reports=(), objects=(), deletions=(), base=()):
    make = lambda rows, s: spark.createDataFrame(list(rows), s)
    return make(recipes, RECIPES), make(cache, CACHE), make(reports, REPORTS), make(objects, OBJECTS), make(deletions, DELETIONS), make(base, BASE)


def brute(recipes=(), cache=(), reports=(), objects=(), deletions=(), base=()):
    refs = [("recipes", str(r[0]), c[0], r[1], 1) for r in recipes for c in r[2] or ()]
    refs += [("file_recipe_cache", c[0].hex(), c[1], c[2], 2) for c in cache]
    refs += [("closure_reports", str(r[0]), h, r[1], 0) for r in reports for h in r[2] or ()]
    out = {}
    for table, key, target, at, need in refs:
        if target is None or at is None:
            continue
        ok = any(h == target and need in (0, k) for h, k in base)
        past = [(t, 2, k) for h, k, t, _ in objects if h == target and t is not None and t <= at] + [(t, 1, -1) for h, t in deletions if h == target and t is not None and t <= at]
        if past:
            kind = max(past)[2]
            ok = ok or (kind > 0 and need in (0, kind))
        if not ok:
            later = any(h == target and t is not None and t > at for h, k, t, _ in objects)
            in_base = any(h == target for h, _ in base)
            state = "deleted" if past and max(past)[2] == -1 else "wrong_kind" if past or in_base else "late" if later else "missing"
            out[table, key, target, at] = state
    return out


def check(spark, data):
    cases, later = X.orphan_references(*frames(spark, **data))
    want = brute(**data)
    got = {tuple(r) for r in X.found(cases).collect()}
    assert got == {(t, k, h.hex()) for t, k, h, _ in want}
    assert X.found(cases).count() == len(got)
    totals = {(r.ref_table, r.state): r.n for r in X.report(cases, later).groupBy("ref_table", "state").agg(F.sum("cases").alias("n")).collect()}
    counted = {}
    for t, _, _, s in {(t, k, h, s) for (t, k, h, _), s in want.items()}:  # all within one month
        counted[t, s] = counted.get((t, s), 0) + 1
    assert totals == counted


def test_states(spark):
    h = [bytes([i]) * 32 for i in range(9)]
    data = dict(
        objects=[(h[0], 1, 10, "x"), (h[0], 1, 10, "x"), (h[1], 1, 10, None), (h[1], 1, 30, None), (h[2], 1, 50, None), (h[3], 2, 5, None)],
        deletions=[(h[1], 20), (h[4], 3)],
        base=[(h[5], 1), (h[6], 2)],
        recipes=[(1, 15, [(h[0], 1), (h[1], 1), (h[2], 1), (h[3], 1), (h[5], None)], "z"), (2, 25, [(h[1], 1), (h[1], 2), (None, 1)], "z"), (2, 25, [(h[1], 1), (h[1], 2), (None, 1)], "z"), (3, 35, [(h[1], 1)], "z"), (4, 35, None, "z"), (5, 35, [], "z")],
        cache=[(h[7], h[6], 1), (h[7], h[3], 9), (h[7], h[0], 9), (h[7], None, 9), (h[8], h[2], 9), (h[8], h[3], None)],
        reports=[(1, 12, [h[0], h[0], h[4], h[7], h[6]]), (2, 12, []), (3, 12, None)],
    )
    check(spark, data)


def test_empty(spark):
    check(spark, {})
    check(spark, dict(recipes=[(1, 5, [(b"a", 1)], "z")]))


@pytest.mark.parametrize("seed", range(4))
def test_random_with_hot_key(spark, seed):
    r = random.Random(seed)
    keys = [bytes([i]) * 4 for i in range(30)]
    pick = lambda: keys[0] if r.random() < 0.4 else r.choice(keys)
    t = lambda: r.randint(0, 60)
    data = dict(
        objects=[(pick(), 1, 2 * t(), "x") for _ in range(60)] + [(keys[-1], 2, 2 * t(), "x")],
        deletions=[(pick(), 2 * t() + 1) for _ in range(20)],
        base=[(keys[3], 1)],
        recipes=[(i, t(), [(pick(), 1) for _ in range(r.randint(0, 40))], "z") for i in range(40)],
        cache=[(pick(), pick(), t()) for _ in range(20)],
        reports=[(i, t(), [pick() for _ in range(3)]) for i in range(5)],
    )
    check(spark, data)


def test_hot_key_that_fills_partitions(spark):
    """One hash in nearly all references: partitions without any event of it are decided by those before."""
    hot = b"h" * 32
    recipes = [(i, i, [(hot, 1)] * 3, "z") for i in range(400)]
    data = dict(objects=[(hot, 1, 100, "x"), (hot, 1, 300, "x")], deletions=[(hot, 200)], recipes=recipes)
    check(spark, data)
