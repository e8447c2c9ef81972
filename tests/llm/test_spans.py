"""Shared spans against a brute-force search."""

import random
from collections import defaultdict

import pytest

from cairnlake.llm import spans as X

SCHEMA = "recipe_id long, original_file_hash binary, chunks array<struct<hash:binary,len:long>>, pos int, start int"


def brute(rows, span):
    recipes = {r[0]: r for r in rows if r[0] is not None}
    where = defaultdict(set)
    runs = []
    for rid, f, chunks, *_ in recipes.values():
        file = ("own", rid) if f is None else f
        hashes = [c[0] for c in chunks or ()]
        for i in range(len(hashes) - span + 1):
            w = tuple(hashes[i : i + span])
            where[w].add(file)
            runs.append((rid, i, w))
    return {(rid, i + k) for rid, i, w in runs if len(where[w]) > 1 for k in range(span)}


def brute_clusters(rows, span):
    """Union-find over shared windows; positions in copies of windows that stand somewhere before."""
    recipes = {r[0]: r for r in rows if r[0] is not None}
    where = defaultdict(list)
    for rid in sorted(recipes):
        f, hashes = recipes[rid][1], [c[0] for c in recipes[rid][2] or ()]
        for i in range(len(hashes) - span + 1):
            where[tuple(hashes[i : i + span])].append((rid, i, ("own", rid) if f is None else f))
    root = {rid: rid for rid in recipes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links, gone = defaultdict(int), defaultdict(set)
    for places in where.values():
        if len({f for *_, f in places}) > 1:
            for rid in {p[0] for p in places}:
                links[rid] += 1
                a, b = find(rid), find(places[0][0])
                root[max(a, b)] = min(a, b)
            for rid, i, _ in places[1:]:
                gone[rid].update(range(i, i + span))
    return {(rid, find(rid), links[rid], len(gone[rid])) for rid in recipes}


def check(spark, rows, span=8):
    df = spark.createDataFrame(rows, SCHEMA)
    shared = X.shared_windows(df, span)
    clusters = [tuple(r) for r in X.clusters(df, shared, span).select("recipe_id", "cluster", "links", "removable").collect()]
    assert len(clusters) == len(set(clusters)) and set(clusters) == brute_clusters(rows, span)
    spans = X.covered(shared, span)
    got = [tuple(r) for r in X.found(spans).collect()]
    want = brute(rows, span)
    assert len(got) == len(set(got)) and set(got) == want
    counts = defaultdict(int)
    for rid, _ in want:
        counts[rid] += 1
    report = {r.recipe_id: r for r in X.report(df, spans).collect()}
    assert set(report) == {r[0] for r in rows if r[0] is not None}
    assert all(report[k].shared == counts.get(k, 0) for k in report)


def row(rid, f, names, n=1):
    return (rid, f, None if names is None else [(None if c == "_" else c.encode(), n) for c in names], 1, 1)


def test_cases(spark):
    run = "abcdefgh"
    rows = [
        row(1, b"1", "xy" + run + "z"), row(2, b"2", run), row(2, b"2", run), row(3, b"3", run[:7]), row(4, b"4", "12345678" + "12345678"), row(5, b"5", "qrstuvwxy"), row(6, b"5", "qrstuvwxy"),
        row(7, b"7", None), row(8, b"8", ""), row(9, None, "ABCDEFGHI"), row(10, None, "ABCDEFGHI"), row(11, b"9", "_" * 9), row(12, b"10", "_" * 8), row(None, b"11", run), row(13, b"13", "ponmlkji" + run[::-1]),
    ]
    check(spark, rows)
    check(spark, [])


@pytest.mark.parametrize("seed", range(3))
def test_random(spark, seed):
    r = random.Random(seed)
    pieces = ["".join(r.choice("abcdef") for _ in range(r.randint(3, 12))) for _ in range(12)]
    rows = [row(i, b"%d" % r.randint(0, 25), "".join(r.choice(pieces) for _ in range(r.randint(0, 8)))) for i in range(60)]
    check(spark, rows + rows[:5])


def test_one_window_in_most_recipes(spark, monkeypatch):
    """A window that most recipes contain goes through the broadcast side."""
    monkeypatch.setattr(X, "HEAVY_ROWS", 5)
    monkeypatch.setattr(X, "MOST_HEAVY", 20)
    rows = [row(i, b"%d" % i, "abcdefghij" + "xyz"[i % 3] * (i % 4)) for i in range(80)]
    check(spark, rows)


def test_bands():
    """Verbatim paragraphs collide in every band; the more rows, the fewer others do."""
    assert X.recall(1.0, 1, X.ROWS) == 1 and X.recall(0.5, 1, X.ROWS) < 0.1
    assert X.recall(0.8, 6, 4) > 0.95


def test_long_chain_of_links(spark):
    ids = list(range(1, 200))
    random.Random(4).shuffle(ids)
    links = spark.createDataFrame([(max(a, b), min(a, b)) for a, b in zip(ids, ids[1:])] + [(301, 300)], "u long, v long")
    assert {(r.id, r.label) for r in X.components(links).collect()} == {(i, 1) for i in ids} | {(300, 300), (301, 300)}
