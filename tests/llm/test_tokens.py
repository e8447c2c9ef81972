"""Encoding against the public libraries, and container filling."""

import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cairnlake.llm import packing as P
from cairnlake.llm import tokens as X

pytestmark = pytest.mark.skipif(not os.path.exists(X.VOCABULARY), reason="no vocabulary here")

DOCS = "doc_id long, text string, tokens int, size int, pid int, rank string"


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=X.read_ranks(), special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200) | st.text("ab'sre \t\n\x1c\x85\xa0　Ⅷ²½_9", max_size=200))
def test_any_text(text):
    import public_tokenizers
    import tiktoken

    global _made
    if "_made" not in globals():
        _made = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=X.read_ranks(), special_tokens={})
    ids, offsets = X.encoder().encode([text])
    assert ids.tolist() == _made.encode_ordinary(text) and offsets.tolist() == [0, len(ids)]
    assert X.encoder().sizes([None, text, ""]).tolist() == [0, len(ids), 0]


def test_long_runs(reference):
    e = X.encoder()
    r = random.Random(1)
    for text in ("a" * 50_000, "ab" * 20_000, " " * 5_000, "".join(r.choice("abcd") for _ in range(30_000)), "\0" * 999):
        assert e.encode([text])[0].tolist() == reference.encode_ordinary(text)


def test_forgetting(reference, monkeypatch):
    monkeypatch.setattr(X, "REMEMBERED", 3)
    e = X.Encoder(X.read_ranks())
    for text in ("one two three four five", "six seven eight one two", "x" * 100):
        assert e.encode([text])[0].tolist() == reference.encode_ordinary(text)


def test_rank_queue():
    q, r = X.RankQueue(50_000), random.Random(4)
    items = [(r.randint(0, 50_000), r.randint(0, 9)) for _ in range(500)]
    for rank, place in items:
        q.push(rank, place)
    out = []
    while (x := q.pop()) is not None:
        out.append(x)
    assert out == sorted(items) and not q.top and not any(q.low) and not any(q.mid)


def test_documents(spark, reference):
    rows = [(1, "Hello world's <|endoftext|> text", 1, 1, 1, "r"), (2, None, 1, 1, 1, "r"), (3, "", 1, 1, 1, "r"), (3, "", 1, 1, 1, "r"), (4, "   ", 1, 1, 1, "r"), (5, "日本語 ünï 🌻", 1, 1, 1, "r")]
    got = X.encode(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r.doc_id, r.ids) for r in got) == sorted((r[0], reference.encode_ordinary(r[1] or "")) for r in rows)
    assert X.encode(spark.createDataFrame([], DOCS)).collect() == []


def fits(packed, sizes, capacity):
    """The packing rules, and the number of containers."""
    spans = {}
    pieces = {}
    for r in packed:
        if r.container is None:
            assert r.tokens == 0 and sizes[r.doc_id] == 0
            continue
        spans.setdefault(r.container, []).append((r.offset, r.offset + r.tokens))
        pieces.setdefault(r.doc_id, []).append(r)
    for filled in spans.values():
        filled.sort()
        assert filled[0][0] >= 0 and filled[-1][1] <= capacity
        assert all(a[1] <= b[0] for a, b in zip(filled, filled[1:]))
    for doc, rows in pieces.items():
        rows.sort(key=lambda r: r.piece)
        assert sum(r.tokens for r in rows) == sizes[doc] and (len(rows) == 1 or sizes[doc] > capacity)
        at = 0
        for i, r in enumerate(rows):
            assert r.piece == i and r.start == at
            at += r.tokens
    assert set(sizes) == {r.doc_id for r in packed}
    return len(spans)


def test_containers(spark):
    r = random.Random(2)
    texts = {i: " word" * (r.randint(1, 60) if r.random() < 0.6 else 7) for i in range(300)} | {300: None, 301: "", 302: " word" * 64, 303: " word" * 65, 304: " word" * 200}
    rows = spark.createDataFrame([(k, t, 1, 1, 1, "r") for k, t in texts.items()], DOCS).repartition(5)
    sizes = {k: len((t or "").split()) for k, t in texts.items()}
    packed = P.pack(P.sized(rows, 64), 64)
    used = fits(packed.collect(), sizes, 64)
    assert used <= -(-sum(sizes.values()) // 64) + 2
    row = P.report(packed, 64).first()
    assert row.containers == used and row.tokens == sum(sizes.values())


def test_no_documents(spark):
    packed = P.pack(P.sized(spark.createDataFrame([], DOCS)))
    assert packed.collect() == [] and P.report(packed).first().containers == 0


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(0, 20), st.integers(0, 30), max_size=12))
def test_plan(histogram):
    steps, used = P.best_fit(histogram, 20)
    room = {}
    ranks = {s: 0 for s in histogram}
    for size, rank, count, first, offset in sorted(steps, key=lambda s: (s[0], s[1])):
        assert rank == ranks[size]
        ranks[size] += count
        for c in range(first, first + count):
            assert 0 <= c < used
            room.setdefault(c, []).append((offset, offset + size))
    assert all(ranks[s] == n for s, n in histogram.items() if s > 0)
    for filled in room.values():
        filled.sort()
        assert filled[-1][1] <= 20 and all(a[1] <= b[0] for a, b in zip(filled, filled[1:]))
    if room:
        total = sum(s * n for s, n in histogram.items())
        assert used <= 11 / 9 * -(-total // 20) * 1.5 + 1
