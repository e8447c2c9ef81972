"""Page furniture, learned from the repetition of lines.

Menus, notices, footers, tags and invitations to read on are lines that many texts
repeat in different surroundings. No phrase is known beforehand: every line of every text
is counted under a key in which numbers, and capitalised words behind the first word,
stand for their kind (``© 0 A · A``), so that years and names do not hide the repetition.
A line is a unit of furniture if

* it follows at least ``CONTEXTS`` different sentences or lines,
* of the lines that begin with its first words, it is no small share (the beginning of a
  sentence that a cut happened to repeat goes on in a thousand ways, a footer in one), and
* it does not stop at a sign that announces more.

Units that often stand behind the last sentence are *closing* ones: they are recognised
behind a sentence of the same line too, as in texts whose line breaks were lost, and so
are units of at least ``NOTICE`` words that mostly stand before the first sentence. Beside
whole lines there are labels (``Tags: ...``): first words before a colon after which the
rest varies and mostly has no full stop.

The units are far fewer than the lines; up to ``MOST_BROADCAST`` of them go to the
workers, beyond that each text is joined with its own.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONTEXTS = 5
SHARE = 0.02  # of the lines with the same first words
SINGLE_SHARE = 0.5  # a line of one word: of the lines that begin with it
SINGLE_LINES = 1e-5  # and of all lines
CLOSING = 0.3  # of a unit's lines that stand behind the last sentence of their text
FIRM = 0.8  # the same for units of one or two words
NOTICE = 4
OPENING = 0.8  # of a terminated unit's lines that stand before the first sentence
LABEL_WORDS = 3
LABEL_OPEN = 0.5  # of a label's lines that have no full stop
MOST_BROADCAST = 200_000

GRAM, LINE, BEGIN, LABEL = 1, 2, 3, 4
CLOSES, INVITES, OPENS, LABELS, FIRMLY, LEADS = 1, 2, 4, 8, 16, 32

WORD, STOP, SIGN, BREAK, EDGE = 0, 1, 2, 3, 4
TOKEN = re.compile("[぀-ヿ㐀-鿿]|\\d+(?:[.,]\\d+)*|[^\\W\\d_぀-鿿]+(?:['’-][^\\W\\d_]+)*|[.!?。？！…;|·•»]+|\n|[^\\w\\s]|_+|\x00")

_FINAL = frozenset(".!?。？！")
_CLOSERS = frozenset("”“\"»’'‘)]}」』*")
_ANNOUNCES = frozenset(",;:([{„“«‚¿¡–—-/&@#©·|")
_PRIME = 0x9E3779B97F4A7C15
_ALL = (1 << 64) - 1
LINES_KEY = 0


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


_CAPITAL, _NUMBER, _COLONS = _hash("shape A"), _hash("shape 0"), (":", "：")


def _finish(total, salt: int):
    """A key from a polynomial; the same for a Python number and an array."""
    if isinstance(total, int):
        x = (total ^ (total >> 31)) * 0xBF58476D1CE4E5B9 + salt & _ALL
        x ^= x >> 29
        return x - (1 << 64) if x >> 63 else x
    x = (total ^ (total >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(salt)
    return (x ^ (x >> np.uint64(29))).view(np.int64)


class Vocabulary:
    """What is known about each different token, kept while a partition is read."""

    MOST = 500_000

    def __init__(self) -> None:
        self.at: dict[str, int] = {}
        self.rows: list[tuple[int, int, int, int, int, int]] = []
        self.table: np.ndarray | None = None

    def facts(self, token: str) -> tuple[int, int, int, int, int, int]:
        """(exact, norm, shape, first, kind, flags); flags: 1 capital, 2 final, 4 closer, 8 announces, 16 colon, 32 ellipsis."""
        h, sign = _hash(token), token[0]
        shape = _NUMBER if sign.isdigit() else _CAPITAL if sign.isupper() else 0
        kind = EDGE if sign == "\x00" else BREAK if sign == "\n" else STOP if sign in ".!?。？！…;|·•»" else WORD if sign.isalnum() else SIGN
        ellipsis = token[-1] == "…" or token[-3:] == "..."
        flags = (shape == _CAPITAL) | 2 * (sign in _FINAL and not ellipsis) | 4 * (sign in _CLOSERS) | 8 * (token[-1] in _ANNOUNCES) | 16 * (token in _COLONS) | 32 * ellipsis
        return h, shape or h, shape, _NUMBER if shape == _NUMBER else h, kind, flags

    def read(self, tokens: list[str]) -> tuple[np.ndarray, ...]:
        """The facts of a sequence of tokens, one array each."""
        if len(self.at) > self.MOST:
            self.__init__()
        at, rows = self.at, self.rows
        try:
            index = np.fromiter(map(at.__getitem__, tokens), np.int64, len(tokens))
        except KeyError:
            for t in set(tokens).difference(at):
                at[t] = len(rows)
                rows.append(self.facts(t))
            self.table = None
            index = np.fromiter(map(at.__getitem__, tokens), np.int64, len(tokens))
        if self.table is None:
            self.table = np.array(rows, np.uint64).T.copy() if rows else np.zeros((6, 0), np.uint64)
        exact, norm, shape, first = (x[index] for x in self.table[:4])
        return exact, norm, shape, first, self.table[4].astype(np.int8)[index], self.table[5].astype(np.int8)[index]


#: columns of a count beside its key, and how two of them become one
COUNTS = {"total": np.add, "closing": np.add, "opening": np.add, "contexts": np.bitwise_or, "begin": np.maximum, "head": np.maximum, "info": np.maximum, "size": np.maximum}


def line_counts(exact, norm, first, kind, flags) -> dict[int, tuple[np.ndarray, ...]]:
    """Keys and counts of all lines of a sequence of texts, of their beginnings and of their labels: ``{what: (key, *COUNTS)}``."""
    edge = np.flatnonzero(kind >= BREAK)
    full = np.diff(edge) > 1
    start, last = edge[:-1][full] + 1, edge[1:][full] - 1
    n = len(start)
    if not n:
        return {}
    u = np.uint64
    prime = u(_PRIME)
    capital = (flags & 1).astype(bool)
    at_start = np.zeros(len(kind), bool)
    at_start[start] = True
    kept = kind < BREAK
    kept[1:] &= ~(capital[1:] & capital[:-1] & ~at_start[:-1])
    of = np.where(at_start, first, norm)
    seen = np.cumsum(kept)
    rank = seen - 1
    rank -= np.repeat(np.concatenate([[0], seen[start] - 1]), np.diff(np.concatenate([[0], start, [len(kind)]])))
    words = rank[last] + 1
    power = np.multiply.accumulate(np.concatenate([[u(1)], np.full(max(int(words.max()), LABEL_WORDS + 1), prime)]))
    terms = np.where(kept, of * power[np.clip(rank, 0, len(power) - 1)], u(0))
    sums = np.concatenate([[u(0)], np.add.accumulate(terms)])
    key = _finish(sums[last + 1] - sums[start], 11)
    # whether a line has a full stop, ends with an ellipsis or announces more
    final = (flags & 2).astype(bool)
    term = final[last] | ((flags[last] & 4).astype(bool) & (last > start) & final[np.maximum(last - 1, 0)])
    info = words.astype(np.int64) * 8 + term + 2 * (flags[last] & 32).astype(bool) + 4 * ((flags[last] & 8).astype(bool) | ((last == start) & (kind[last] != WORD)))
    # lines behind the last sentence of their text, and up to the first one
    text = np.cumsum(kind == EDGE)[start]
    index = np.arange(n)
    new = np.concatenate([[True], text[1:] != text[:-1]])
    head = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    none = -1
    final_line = np.concatenate([new[1:], [True]])
    last_term = np.maximum.reduceat(np.where(term, index, none), head)[group]
    first_term = np.minimum.reduceat(np.where(term, index, n), head)[group]
    closing = ((index > last_term) | final_line) & (last_term >= 0)  # a text without sentences shows no ends
    opening = (index <= first_term) & (last_term >= 0)
    # what a line follows: the last sentence before it, since other units often come along, or else the line before
    sentence = np.concatenate([[none], np.maximum.accumulate(np.where(term, index, none))[:-1]])
    context = np.where(new, 0, key[np.where(sentence >= head[group], sentence, np.maximum(index - 1, 0))])
    bit = np.left_shift(u(1), context.view(u) % u(64)).view(np.int64)
    two = _finish(of[start] + prime * of[np.minimum(start + 1, len(of) - 1)], 12)
    one = _finish(of[start], 13)
    begin = np.where(words >= 3, two, one)
    some = np.ones(n, np.int64)
    zero = np.zeros(n, np.int64)
    head_word = first[start].view(np.int64)
    out = {LINE: (key, some, closing.astype(np.int64), opening.astype(np.int64), bit, begin, head_word, info, last - start + 1)}
    longer = last > start
    starts = np.concatenate([np.full(1, LINES_KEY), one, two[longer]])
    total = np.concatenate([[n], some, some[longer]])
    blank = np.zeros(len(starts), np.int64)
    out[BEGIN] = (starts, total, *[blank] * 7)
    colon = np.flatnonzero((flags & 16).astype(bool))
    if len(colon):
        line = np.searchsorted(start, colon, side="right") - 1
        ok = (line >= 0) & (np.concatenate([[True], line[1:] != line[:-1]]))
        colon, line = colon[ok], line[ok]
        before = colon - start[line]
        ok = (before >= 1) & (before <= LABEL_WORDS) & (colon < last[line]) & (kind[start[line]] == WORD)
        colon, line, before = colon[ok], line[ok], before[ok]
        label = np.zeros(len(colon), u)
        for k in range(LABEL_WORDS):
            label += np.where(k < before, exact[np.minimum(start[line] + k, len(exact) - 1)] * power[k], u(0))
        spread = np.left_shift(u(1), key[line].view(u) % u(64)).view(np.int64)
        out[LABEL] = (_finish(label, 14), some[line], closing[line].astype(np.int64), (~term[line]).astype(np.int64), spread, zero[line], head_word[line], zero[line], zero[line])
    return out


class Counts:
    """Counts by key, added up while a partition is read; handed on early beyond a bound."""

    def __init__(self, columns: tuple[str, ...], most: int = 2_000_000) -> None:
        self.how = [COUNTS[c] for c in columns]
        self.most, self.held, self.parts = most, 0, []

    def _sum(self, columns: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        order = np.argsort(columns[0], kind="stable")
        key = columns[0][order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        return key[first], *(f.reduceat(c[order], first) for f, c in zip(self.how, columns[1:]))

    def add(self, *columns: np.ndarray) -> None:
        if len(columns[0]):
            self.parts.append(self._sum(columns))
            self.held += len(self.parts[-1][0])
            if self.held > self.most:
                merged = self.merged()
                self.parts, self.held = [merged], len(merged[0])

    def merged(self) -> tuple[np.ndarray, ...]:
        """All counts by distinct key; nothing is held after that."""
        parts, self.parts, self.held = self.parts, [], 0
        if not parts:
            return (np.zeros(0, np.int64),) * (1 + len(self.how))
        return parts[0] if len(parts) == 1 else self._sum([np.concatenate(x) for x in zip(*parts)])

    def overflow(self) -> tuple[np.ndarray, ...]:
        """The counts, where merging has left more than half the bound; else nothing."""
        full = self.held > self.most // 2 and len(self.parts) == 1
        return self.merged() if full else (np.zeros(0, np.int64),) * (1 + len(self.how))


def units(counts: DataFrame) -> DataFrame:
    """``key, class, words, head`` (hash of the first word)``, size`` (most tokens)``, begin`` (key of the first words): the furniture among the counted lines and labels (columns ``what, key`` and those of ``COUNTS``)."""
    added = [F.sum(c).alias(c) for c in ("total", "closing", "opening")]
    lines = counts.filter(F.col("what") == LINE).groupBy("key").agg(*added, F.bit_or("contexts").alias("contexts"), F.max("begin").alias("begin"), F.max("head").alias("head"), F.max("info").alias("info"), F.max("size").alias("size"))
    info = F.col("info")
    lines = lines.filter((F.bit_count("contexts") >= CONTEXTS) & (info.bitwiseAND(4) == 0)).withColumn("words", F.shiftright(info, 3))
    term, closes = info.bitwiseAND(1) == 1, F.col("closing") >= CLOSING * F.col("total")
    opens = F.col("opening") >= OPENING * F.col("total")
    lines = lines.filter(~term | closes | opens)
    begins = counts.filter(F.col("what") == BEGIN).select("key", "total")
    least = max(CONTEXTS, SINGLE_LINES * (begins.filter(F.col("key") == LINES_KEY).agg(F.sum("total")).first()[0] or 0))
    wanted = lines.select(F.col("begin").alias("key")).distinct()
    alike = begins.join(wanted, "key", "left_semi").groupBy(F.col("key").alias("begin")).agg(F.sum("total").alias("alike"))
    single = (F.col("words") == 1) & (F.col("total") >= SINGLE_SHARE * F.col("alike")) & (F.col("total") >= least)
    lines = lines.join(alike, "begin").filter(single | ((F.col("words") > 1) & (F.col("total") >= SHARE * F.col("alike"))))
    flag = lambda c, bit: F.when(c, bit).otherwise(0)
    lines = lines.select("key", (flag(closes, CLOSES) + flag(closes & (info.bitwiseAND(2) == 2), INVITES) + flag(opens | ~term, OPENS) + flag(F.col("closing") >= FIRM * F.col("total"), FIRMLY) + flag(opens, LEADS)).alias("class"), "words", "head", "size", "begin")
    labels = counts.filter(F.col("what") == LABEL).groupBy("key").agg(*added, F.bit_or("contexts").alias("contexts"), F.max("head").alias("head"))
    labels = labels.filter((F.bit_count("contexts") >= CONTEXTS) & (F.col("opening") >= LABEL_OPEN * F.col("total")))
    labels = labels.select("key", (flag(closes, CLOSES) + LABELS).alias("class"), F.lit(0).cast("bigint").alias("words"), "head", F.lit(0).cast("bigint").alias("size"), F.lit(0).cast("bigint").alias("begin"))
    return lines.unionAll(labels)


class Units:
    """The known units, as rows (those of :func:`units`), and the most tokens that one may have."""

    COLUMNS = ["key", "class", "words", "head", "size", "begin"]

    MOST_REMEMBERED = 50_000

    def __init__(self, rows=(), most: int = 0):
        self.tokens, self.most = {}, most
        self.know(rows)

    def know(self, rows) -> None:
        rows = list(rows)
        self.classes = {key: kind for key, kind, *_ in rows}
        #: first words, with the most tokens of a line that begins with them
        self.heads: dict[int, int] = {}
        for _, kind, _, head, size, _ in rows:
            self.heads[head] = max(self.heads.get(head, 0), 1 << 60 if kind & LABELS else size)
        #: how that begins which is recognised behind other words of its line: first words, and for longer units the first two
        inner = [r for r in rows if r[1] & CLOSES or (r[1] & LEADS and r[2] >= NOTICE)]
        self.inner = {head for _, _, _, head, _, _ in inner}
        self.short = {head for _, _, words, head, _, _ in inner if words < 3}
        self.pairs = {begin for _, _, words, _, _, begin in inner if words >= 3}
        self.lines: dict[str, int] = {}
        self.words: dict[str, bool] = {}

    def _facts(self, token: str) -> tuple[int, int, int, bool, int]:
        if len(self.tokens) > 100_000:
            self.tokens.clear()
        exact, norm, _, first, _, flags = Vocabulary.facts(None, token)
        facts = self.tokens[token] = exact, norm, first, bool(flags & 1), first - (1 << 64) if first >> 63 else first
        return facts

    def _of(self, tokens: list[str]) -> list[tuple[int, int, int, bool, int]]:
        get, facts = self.tokens.get, self._facts
        return [get(t) or facts(t) for t in tokens]

    def _tail(self, text: str, start: int, end: int) -> int:
        """Where the last tokens of a line begin, more than a unit has, or all of them."""
        size = 64 + 8 * self.most
        while True:
            at = max(start, end - size)
            while at > start and not text[at - 1].isspace():
                at -= 1
            if at == start or text.count(" ", at, end) > self.most:
                return at
            size *= 2

    def _key(self, facts: list[tuple[int, int, int, bool, int]], i: int, rests: list[int]) -> int:
        """The key of the tokens from the i-th on; ``rests`` are those of :meth:`_rests`."""
        return _finish((facts[i][2] + _PRIME * rests[i + 1]) & _ALL, 11)

    @staticmethod
    def _rests(facts: list[tuple[int, int, int, bool, int]], least: int) -> list[int]:
        """The polynomial of the tokens behind each place, down to ``least``."""
        out, rest, before = [0] * (len(facts) + 1), 0, False
        for i in range(len(facts) - 1, least, -1):
            _, norm, _, capital, _ = facts[i]
            if not (capital and before):
                rest = (norm + _PRIME * rest) & _ALL
            out[i], before = rest, capital
        return out

    def of_line(self, text: str, start: int, end: int) -> int:
        """The class of a whole line, 0 if it is no unit."""
        m = TOKEN.search(text, start, end)
        most = self.heads.get(self._of([m.group()])[0][4]) if m else None
        if most is None or text.count(" ", start, end) >= most:
            return 0
        line = text[start:end]
        kind = self.lines.get(line)
        if kind is None:
            tokens = TOKEN.findall(line)
            facts = self._of(tokens)
            kind = self.classes.get(self._key(facts, 0, self._rests(facts, 0)), 0) or self._label(tokens)
            if len(self.lines) > self.MOST_REMEMBERED:
                self.lines.clear()
            self.lines[line] = kind
        return kind

    def _begins(self, word: str) -> bool:
        """Whether what a word begins with may begin a unit."""
        if len(self.words) > self.MOST_REMEMBERED:
            self.words.clear()
        m = TOKEN.search(word)
        # a mark that wrong decoding leaves before a sign
        found = self.words[word] = bool(m) and (self._of([m.group()])[0][4] in self.inner or word[0] == "Â")
        return found

    def _goes_on(self, words: list[str], i: int) -> bool:
        """Whether a unit may begin with the i-th word and the next one."""
        word = words[i].lstrip("Â")
        (_, _, first, _, head), *rest = self._of(TOKEN.findall(f"{word} {' '.join(words[i + 1 : i + 2])}")[:2]) or [(0, 0, 0, False, 0)]
        return head in self.short or bool(rest) and _finish((first + _PRIME * rest[0][1]) & _ALL, 12) in self.pairs

    def _label(self, tokens: list[str], colon: int = -1, length: int = 0) -> int:
        """The class of the label before the first colon of a line, or of the ``length`` tokens before ``colon``."""
        if colon < 0:
            colon = next((i for i, t in enumerate(tokens[: LABEL_WORDS + 1]) if t in _COLONS), -1)
            length = colon
        if not 1 <= length <= LABEL_WORDS or colon >= len(tokens) - 1:
            return 0
        return self.classes.get(self._label_key(tokens[colon - length : colon]), 0)

    def _label_key(self, tokens: list[str]) -> int:
        total = 0
        for facts in reversed(self._of(tokens)):
            total = (facts[0] + _PRIME * total) & _ALL
        return _finish(total, 14)

    def candidates(self, text: str) -> set[int]:
        """All keys under which a part of a text may be known."""
        out: set[int] = set()
        for line in text.split("\n"):
            tokens = TOKEN.findall(line)
            for stop in range(1, len(tokens) + 1):  # behind a unit of the line another one may stand
                facts = self._of(tokens[max(0, stop - self.most) : stop])
                rests = self._rests(facts, 0)
                out.update(self._key(facts, i, rests) for i in range(len(facts)))
            for c, t in enumerate(tokens):
                if t in _COLONS:
                    out.update(self._label_key(tokens[c - n : c]) for n in range(1, min(LABEL_WORDS, c) + 1))
        return out

    def strip(self, text: str, end: int | None = None) -> tuple[int, int, bool, int]:
        """(end, taken, invited, measured) of a text without the furniture behind it.

        ``taken`` parts were taken off, one of them an invitation to read on if
        ``invited``; ``measured`` is the end without closing units only.
        """
        end = len(text) if end is None else end
        taken, invited, measured = 0, False, None
        while True:
            while end and text[end - 1].isspace():
                end -= 1
            if measured is None:
                measured = end
            if not end or not self.classes:
                return end, taken, invited, measured
            start = text.rfind("\n", 0, end) + 1
            at, kind = end, self.of_line(text, start, end) if start else 0
            if kind:
                at = start
            else:
                at, kind = self._inside(text, start, end)
            if at == end:
                return end, taken, invited, measured
            end, taken, invited = at, taken + 1, invited or bool(kind & INVITES)
            if kind & CLOSES:
                measured = None

    def _inside(self, text: str, start: int, end: int) -> tuple[int, int]:
        """Where the longest unit behind other words of its line begins, and its class; units of one word may follow it."""
        begin = self._tail(text, start, end)
        known, look = self.words.get, self._begins
        part = text[begin:end]
        if not part.isascii():
            for stop in "。！？":
                part = part.replace(stop, stop + " ")
        words = part.split()
        hits = [i for i, w in enumerate(words) if (look(w) if (k := known(w)) is None else k)]
        if not any(self._goes_on(words, i) for i in hits):
            return end, 0
        tokens = TOKEN.findall(text, begin, end)
        facts = self._of(tokens)
        starts = [i for i, f in enumerate(facts) if f[4] in self.inner]
        if not starts:
            return end, 0
        places: list[int] = []

        def place(i: int) -> int:
            """Where a token begins, if that is at the beginning of a word, else -1."""
            if not places:
                places.extend(m.start() for m in TOKEN.finditer(text, begin, end))
            at = places[i]
            return at if not at or text[at - 1].isspace() or text[at - 1] in "。！？Â" else -1

        n = len(tokens)
        while n and starts and starts[0] < n:
            rests = self._rests(facts[:n], starts[0])
            for i in starts:
                if i >= n:
                    break
                kind = self.classes.get(self._key(facts, i, rests), 0)
                if kind and (kind & CLOSES and (n - i > 2 or kind & FIRMLY) or kind & LEADS and n - i >= NOTICE) and (at := place(i)) >= 0:
                    return (at - 1 if at and text[at - 1] == "Â" else at), kind
            for c in range(n - 2, 0, -1):
                if tokens[c][-1] in _FINAL:
                    break
                if tokens[c] in _COLONS:
                    for length in range(1, min(LABEL_WORDS, c) + 1):
                        if self._label(tokens[:n], c, length) & CLOSES and (at := place(c - length)) >= 0:
                            return at, CLOSES
            if facts[n - 1][4] not in self.heads or not self.classes.get(self._key(facts, n - 1, [0] * (n + 1)), 0):
                break
            n -= 1
        return end, 0

    def head(self, text: str, short: int) -> int:
        """Where the main content begins: behind lines that are units, menus or ``short`` and without a full stop."""
        at = 0
        for line in text.split("\n"):
            bare = line.rstrip()
            long = len(bare) > short or (bare and (bare[-1] in _FINAL or (bare[-1] in _CLOSERS and bare[-2:-1] and bare[-2] in _FINAL)))
            if long and bare.count(" | ") < 3 and not self.of_line(text, at, at + len(bare)) & (OPENS | LABELS):
                return at
            at += len(line) + 1
        return 0
