"""Seen-before answers against a plain count, and the filters' error rate."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cairnlake.llm import seen as X

ROWS = "seq long, hash binary, key string, tab string, h string"
BASE = "hash binary, size int"


def brute(rows, base):
    first = {}
    for s, h, *_ in rows:
        if s is not None and h is not None:
            first[h] = min(first.get(h, s), s)
    return {s for s, h, *_ in rows if s is not None and h is not None and (h in base or first[h] < s)}


def check(spark, a, b, base=(), target=X.TARGET):
    before = spark.createDataFrame([(h, 1) for h in base], BASE)
    tables = [(spark.createDataFrame(t, ROWS), "hash", "seq") for t in (a, b)]
    answers = X.bloom_answers(tables, before, target)
    got = X.seen_records(answers).collect()
    assert len(got) == len({tuple(r) for r in got})
    assert {r.seq for r in got if r.tab == 0} == brute(a, set(base)) and {r.seq for r in got if r.tab == 1} == brute(b, set(base))
    return answers


def test_small(spark):
    r = lambda s, h: (s, h, "k", "t", "h")
    a = [r(1, b"x"), r(1, b"x"), r(2, b"y"), r(3, b"x"), r(3, b"x"), r(4, None), r(None, b"x"), r(5, b"x" * 31), r(6, b"x" * 32), r(7, b""), r(8, b""), r(9, b"base"), r(0, b"z"), r(10, b"z")]
    check(spark, a, [r(5, b"y"), r(4, b"y")], [b"base"])
    check(spark, [], [])
    check(spark, a, [], [None, b"x"])


@pytest.mark.parametrize("target", [0.001, 0.9])
def test_hot_key_and_false_answers(spark, target):
    """A poor filter gives many wrong answers; the exact check finds all of them."""
    r = random.Random(7)
    rows = [(i, b"hot" if r.random() < 0.4 else b"%d" % r.randint(0, 4000), "k", "t", "h") for i in range(6000)]
    r.shuffle(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "200")
    try:
        answers = check(spark, rows, rows[:100], target=target)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    rate = {x.tab: x for x in X.error_rates(answers, target).collect()}
    assert rate[0].probes >= X.PROBES and rate[0].rate <= 1.5 * target + 0.001
    if target > 0.1:
        assert rate[0].wrong_records > 10


def test_seeds_of_duplicated_deliveries(spark):
    """Filters that err in a tenth of their answers, rows delivered twice in other batches, shared, negative and damaged values."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        for seed in range(4):
            r = random.Random(seed)
            key = lambda: r.choice((b"hot", b"", b"%d" % r.randint(0, 900), bytes([r.randint(0, 255)]) * 31, None))  # noqa: B023, E731
            tables = []
            for _ in range(2):
                rows = [(r.choice((None, r.randint(-300, 1500))), key(), "k", "t", "h") for _ in range(1500)]
                rows += r.sample(rows, 400)
                r.shuffle(rows)
                tables.append(rows)
            check(spark, *tables, [b"hot", b"5", b"77", b"77"] if seed % 2 else [], target=0.1)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_filter():
    keys = np.array([xxhash.xxh64_intdigest(str(i)) for i in range(20_000)], np.uint64)
    bloom = X.BlockedBloom(20_000, 0.01)
    assert not bloom.query(keys).any()
    bloom.insert(keys)
    assert bloom.query(keys).all()
    assert 0.0005 < bloom.query(X.absent_hashes(20_000, 32, 1)).mean() < 0.02


def test_hashes_agree_with_spark(spark):
    row = spark.createDataFrame([(b"some bytes",)], "b binary").select(F.xxhash64("b").alias("h")).first()
    assert row.h % 2**64 == xxhash.xxh64_intdigest(b"some bytes", 42)
