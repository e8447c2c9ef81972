"""Encoding of texts with a public byte-level BPE vocabulary.

Method: a text is cut into pre-tokens; the ids of a pre-token come from a rank queue.
Every merge rank has a bucket of linked-list positions, three levels of 64-way bitmaps
mark the buckets in use, find-first-set picks the lowest rank, and entries whose pair has
changed since are skipped. A merge costs a few bitmap steps, so pre-tokens of any length
take time in proportion to their length. Pre-tokens of usual length are remembered by
each worker, up to a bound, so that a batch is mostly one lookup per pre-token.

Defined results:

* null and empty texts have an empty list of ids; no document is dropped, repeated rows
  give repeated results;
* strings of special tokens inside a text are ordinary text; no special tokens are added;
* lone surrogates cannot occur in a Spark string; every other character is encoded;
* an empty table gives an empty result; further columns are never read.
"""

from __future__ import annotations

import base64
import re
import sys
import unicodedata
from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlake.llm.batches import by_text
from cairnlake.runtime import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
REMEMBERED = 400_000
LONGEST_REMEMBERED = 40


def _ranges(wanted: Callable[[str], bool]) -> str:
    """A character class body of all characters with this property."""
    out, start, last = [], None, None
    for i in range(sys.maxunicode + 1):
        if wanted(chr(i)):
            if start is None:
                start = i
            last = i
        elif start is not None:
            out.append((start, last))
            start = None
    return "".join(f"\\U{a:08x}" if a == b else f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


def pre_token_pattern() -> re.Pattern:
    """Contractions, letters, numbers and other signs, each with one blank before it, and white space.

    Letters, numbers and white space are written out as character classes, since the
    standard library's classes differ from the Unicode properties.
    """
    letter = _ranges(lambda c: unicodedata.category(c)[0] == "L")
    number = _ranges(lambda c: unicodedata.category(c)[0] == "N")
    # fixed values: the characters with the property White_Space
    space = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")


def read_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class RankQueue:
    """Positions by merge rank; the lowest rank comes first, of one rank the leftmost position."""

    def __init__(self, ranks: int):
        words = (ranks >> 6) + 1
        self.low, self.mid, self.top = [0] * words, [0] * ((words >> 6) + 1), 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            heappush(bucket, position)
            return
        self.buckets[rank] = [position]
        word = rank >> 6
        self.low[word] |= 1 << (rank & 63)
        self.mid[word >> 6] |= 1 << (word & 63)
        self.top |= 1 << (word >> 6)

    def pop(self) -> tuple[int, int] | None:
        if not self.top:
            return None
        group = (self.top & -self.top).bit_length() - 1
        word = self.mid[group]
        word = group << 6 | (word & -word).bit_length() - 1
        rank = self.low[word]
        rank = word << 6 | (rank & -rank).bit_length() - 1
        bucket = self.buckets[rank]
        position = heappop(bucket)
        if not bucket:
            del self.buckets[rank]
            self.low[word] &= ~(1 << (rank & 63))
            if not self.low[word]:
                self.mid[group] &= ~(1 << (word & 63))
                if not self.mid[group]:
                    self.top &= ~(1 << group)
        return rank, position


class Encoder:
    """Byte-level BPE over a table of token ranks, which are also the ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.find = pre_token_pattern().findall
        self.queue = RankQueue(max(ranks.values(), default=0) + 1)
        self.place: dict[str, int] = {}
        self._reset()

    def _reset(self) -> None:
        self.place.clear()
        self.ids = np.zeros(1 << 16, np.int32)
        self.start, self.used = np.zeros(1 << 16, np.int64), 0

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        n, queue = len(piece), self.queue
        part = [piece[i : i + 1] for i in range(n)]
        after, before, queued = list(range(1, n + 1)), list(range(-1, n - 1)), [-1] * n
        for i in range(n - 1):
            rank = ranks.get(piece[i : i + 2])
            if rank is not None:
                queued[i] = rank
                queue.push(rank, i)
        while (item := queue.pop()) is not None:
            rank, i = item
            if queued[i] != rank:  # its pair has changed
                continue
            j = after[i]
            part[i] += part[j]
            part[j] = b""
            queued[j] = queued[i] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                rank = ranks.get(part[i] + part[k])
                if rank is not None:
                    queued[i] = rank
                    queue.push(rank, i)
            h = before[i]
            if h >= 0:
                rank = ranks.get(part[h] + part[i])
                queued[h] = -1 if rank is None else rank
                if rank is not None:
                    queue.push(rank, h)
        return [ranks[p] for p in part if p]

    def _remember(self, piece: str) -> int:
        """The place of a pre-token's ids."""
        ids = self.merge(piece.encode())
        end = int(self.start[self.used]) + len(ids)
        if self.used + 2 > len(self.start):
            self.start = np.concatenate([self.start, np.zeros(len(self.start), np.int64)])
        while end > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.int32)])
        at = self.used
        self.ids[self.start[at] : end] = ids
        self.used += 1
        self.start[self.used] = end
        return at

    def places(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The places of all pre-tokens of these texts in order, and each text's number of them."""
        if self.used > REMEMBERED:
            self._reset()
        place, find, remember = self.place, self.find, self._remember
        out, counts = [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if not text:
                continue
            pieces = find(text)
            counts[i] = len(pieces)
            for piece in pieces:
                at = place.get(piece)
                if at is None:
                    at = remember(piece)
                    if len(piece) <= LONGEST_REMEMBERED:
                        place[piece] = at
                out.append(at)
        return np.array(out, np.int64), counts

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order and each text's offsets into them."""
        at, counts = self.places(texts)
        begin = self.start[at]
        length = self.start[at + 1] - begin
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ends) else 0
        index = np.arange(total) + np.repeat(begin - (ends - length), length)
        offsets = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return self.ids[index], offsets

    def sizes(self, texts: list[str | None]) -> np.ndarray:
        """Each text's number of ids."""
        at, counts = self.places(texts)
        ends = np.concatenate([[0], np.cumsum(self.start[at + 1] - self.start[at])])
        bounds = np.concatenate([[0], np.cumsum(counts)])
        return ends[bounds[1:]] - ends[bounds[:-1]]


_encoders: dict[str, Encoder] = {}


def encoder(path: str = VOCABULARY) -> Encoder:
    """This worker's encoder, built once."""
    if path not in _encoders:
        _encoders[path] = Encoder(read_ranks(path))
    return _encoders[path]


def encode(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """``doc_id, ids`` of every document. ``path`` must be readable on every executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in by_text(batches):
            ids, offsets = e.encode(b.column("text").to_pylist())
            yield pa.record_batch([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))], names=["doc_id", "ids"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = spread(documents.select("doc_id", F.col("text").cast("string").alias("text")))
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>")
