"""Texts that were cut off by a field limit or in transfer.

Method: a stack automaton reads quotes, brackets, markup comments and tags of the whole
text and says what its end leaves open; beside it the end is checked for character
references, escapes and multibyte sequences that break off, and for a terminator. What
follows the main content (menus, footers, tags, signatures, invitations to read on) is
taken off first; which lines these are is learned from their repetition over the corpus
(:mod:`cairnlake.llm.furniture`), no phrase is known beforehand. An end without a
terminator alone proves nothing, so two baselines over the whole corpus decide:

* per source, lengths (in characters and in bytes) at which far more different open
  texts end than at the lengths around them: those are the source's field limits, and a
  text that ends with a terminator just there was cut as well;
* for each word and pair of words, how often a terminator or a line end follows: a text
  that stops where sentences and lines hardly ever stop, or inside a word, was cut; one
  whose author left out the full stop ends like others do.

A stored length beyond that of the text says so directly.

The texts are read twice: once to count words and lines, once to read the ends with the
furniture known.

Defined results:

* null, empty and blank texts are whole; null source is a source of its own, a null
  ``n_chars`` says nothing;
* a text of nothing but furniture, or that an invitation to read on ends, is whole;
* texts that are no prose at their end (numbers, hex, noise, one long run) are whole
  unless their structure breaks off;
* repeated rows count once in the baselines of limits; an empty table gives empty
  results; further columns are never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from cairnlake.llm import furniture
from cairnlake.llm.batches import by_text
from cairnlake.llm.furniture import BREAK, EDGE, SIGN, STOP, TOKEN, WORD, Counts, Units, Vocabulary
from cairnlake.runtime import materialize, spread

# parameters of the baselines
NEAR = 15  # a limit that backs up to a word or a whole character ends texts over so many lengths
AROUND = 200
CHAIN = 0.02
LEAST_PILE = 3
LEAST_LENGTH = 100  # shorter limits must be SURE: short pages have few lengths
LEAST_SHARE = 0.15  # of a source's texts that stop in the middle: enough for a pile that is not SURE
SURE = 20.0  # a pile is no chance: minus the logarithm of how likely the lengths around it make one as large
CLOSING_SHARE = 0.10
KNOWN = 5
# parameters of what an end looks like
GARBLED_TAIL = 200
GARBLED_SHARE = 0.02  # of U+FFFD in the tail; fewer are stray signs
CONTEXT = 60  # characters before broken markup that must be text
TITLE_WORDS = 3
SHORT_LINE = 75  # longer lines begin the main content

_CLOSERS = {"”": "“„", "»": "«", ")": "(", "]": "[", "}": "{", "」": "「", "』": "『"}
_OPENERS = set("“„«([{「『")
_DELIMITER = re.compile("[“”„«»()\\[\\]{}「」『』\"]|<!--|-->")
_OPENING = re.compile("[“„«(\\[{「『\"]|<!--")
_SENTENCE_END = re.compile("[.!?。？！…][”“\"»’')\\]]*\\s|\n")
_STOPS = re.compile("[.!?。？！]")
_ENDS, _BEHIND = ".!?。？！…‽", "”“\"»’'‘)]}」』*"
_GREEK = re.compile("[Ͱ-Ͽἀ-῿]")
_SMILE = re.compile("(?:[:;]-?[)D(P]|[\U0001f300-\U0001faff☀-➿][️‍]?)$")
#: a tag whose attributes, all but the last one with a value, go on to the end of the text
_OPEN_TAG = re.compile(r"<(?:/?[A-Za-z][\w:-]*(?:\s+[\w:-]+\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'<>]+))*(?:\s+[\w:-]*(?:\s*=\s*(?:\"[^\"]*|'[^']*|[^\s\"'<>]*))?)?\s*)?$")
_BROKEN_REFERENCE = re.compile(r"&(?:#[xX]?[0-9a-fA-F]{0,6}|[A-Za-z]{1,8})$")
_BROKEN_ESCAPE = re.compile(r"\\(?:u[0-9a-fA-F]{0,3}|x[0-9a-fA-F]?)?$|%[0-9A-F]?$")
_LONGEST_BROKEN = 9  # characters of the longest reference or escape that can be broken
_MARK = re.compile("\\s*(?:\\[(?:\\.\\.\\.|…)\\]|\\((?:\\.\\.\\.|…)\\)|…|\\.\\.\\.)$")
_MARKS = ("…", "...", "…]", "...]", "…)", "...)")
_GARBLED_SIGNS = re.compile("[ÃâÂÐÑãÎÏ]")
_GARBLED = re.compile("Ã[-¿]|â€|â\x80|Â[^\\w\\s]|[ÐÑ][-¿ŒœŠšŽžƒ]|ã[-¿€‚ƒ]|[ÎÏ][-¿]")
#: what each byte looks like when UTF-8 was read as Windows-1252; undefined bytes come out as U+FFFD
_READ_WRONG = {ord(bytes([b]).decode("cp1252")): b for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)} | {0xFFFD: 0x9D}
_WIDE_TITLE = re.compile("(?:[A-Za-z]+ ?)?[゠-ヿ㐀-鿿ー]{1,8}")  # a name and signs without any inflection

_LINE_WORDS = 8  # longer lines are judged by their last words

_FEATURES = (
    "doc_id {}, source string, text_key long, uid long, chars long, bytes long, body long, main long, verdict int, open boolean, marked boolean, terminated boolean,"
    " asks array<struct<line:bigint,pair:bigint,shape:bigint,word:bigint,three:bigint,left:bigint,lower:boolean,prose:boolean>>"
)
_KEYS = ("line", "pair", "shape", "word", "three", "left")
_ASK = pa.list_(pa.struct([*((k, pa.int64()) for k in _KEYS), ("lower", pa.bool_()), ("prose", pa.bool_())]))
_COUNTED = "what int, key long, " + ", ".join(f"{c} long" for c in furniture.COUNTS)
WHOLE, CUT, ASK = 0, 1, 2
_NOTHING = Units()


def structure(text: str) -> list[tuple[str, int]]:
    """The stack of quotes, brackets and comments that a text leaves open: signs and places.

    A closing sign takes its nearest opening one off the stack, with what was left open
    inside it; without one it is stray. A straight quote opens before a word and closes
    behind one. Within a comment only its end counts.
    """
    stack: list[tuple[str, int]] = []
    for m in _DELIMITER.finditer(text):
        sign, at = m.group(), m.start()
        if stack and stack[-1][0] == "<!--":
            if sign == "-->":
                stack.pop()
            continue
        if sign == '"':
            opens = (not at or text[at - 1].isspace() or text[at - 1] in _OPENERS) and not text[at + 1 : at + 2].isspace()
            closes = "" if opens else '"“„'
        elif sign == "“":  # closes a low quote, opens otherwise
            closes = "„" if any(s == "„" for s, _ in stack) else ""
        else:
            closes = "" if sign in _OPENERS or sign == "<!--" else _CLOSERS.get(sign, "-")
        if not closes:
            stack.append((sign, at))
            continue
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in closes:
                del stack[i:]
                break
    return stack


def _terminated(line: str) -> bool:
    """Whether a line ends with a terminator; the Greek question mark is a semicolon."""
    last = line.rstrip(_BEHIND)[-1:]
    return bool(last) and (last in _ENDS or (last == ";" and _GREEK.search(line) is not None)) or _SMILE.search(line[-8:]) is not None


def open_delimiters(text: str) -> list[str]:
    """The quotes and brackets that the last sentence opens and the text leaves open."""
    begin = _fragment_start(text, 0, len(text))
    return [sign for sign, at in structure(text) if at >= begin]


def _fragment_start(text: str, start: int, end: int) -> int:
    """Where, behind the last sentence or line end of ``text[start:end]``, its last words begin."""
    size = 256
    while True:
        low = max(start, end - size)
        at = max((m.end() for m in _SENTENCE_END.finditer(text, low, end)), default=-1)
        if at >= 0 or low == start:
            return max(at, start)
        size *= 4


def _broken_at(text: str) -> int:
    """Where a comment, tag, reference or escape begins that the end of the text breaks off; -1 where none does."""
    comment = text.rfind("<!--")
    if comment > text.rfind("-->"):
        return comment
    tag = text.rfind("<")
    if tag >= 0 and text.find(">", tag) < 0 and _OPEN_TAG.match(text, tag):
        return tag
    for broken in (_BROKEN_REFERENCE, _BROKEN_ESCAPE):
        m = broken.search(text, max(0, len(text) - _LONGEST_BROKEN))
        if m:
            return m.start()
    return -1


def without_furniture(text: str, units: Units = _NOTHING) -> tuple[str, int]:
    """The text without the page furniture at its end, and how many parts were taken off; ``-1``: an invitation to read on follows."""
    end, taken, invited, _ = units.strip(text)
    return text[:end], -1 if invited else taken


def _repaired(text: str) -> str | None:
    """A text whose UTF-8 bytes were read as Windows-1252 or Latin-1, read rightly; ``None`` where it is no such text."""
    try:
        right = text.translate(_READ_WRONG).encode("latin-1").decode("utf-8", "replace")
    except UnicodeEncodeError:
        return None
    return right if len(_GARBLED.findall(right)) < 3 and right.count("�") <= 0.02 * len(right) + 1 else None


def _is_prose(fragment: str) -> bool:
    """Words of usual length, mostly letters, and not a row of capitalised menu items."""
    n = len(fragment)
    if not n:
        return False
    words = fragment.split()
    wide = any(c > "⿿" for c in fragment)
    letters = sum(c.isalpha() or c in " ,'’-“”„«»" for c in fragment)
    capitals = sum(w[0].isupper() for w in words)
    return letters >= 0.75 * n and (wide or max(map(len, words), default=0) <= 24) and (wide or len(words) < 4 or capitals <= 0.6 * len(words))


_START = np.uint64(0x5EED)


def _mix(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + np.uint64(salt))
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(29))).view(np.int64)


def _shifted(x: np.ndarray, word: np.ndarray, by: int) -> np.ndarray:
    """What stands so many words before, or the mark of a beginning where a stop or edge lies between."""
    out = np.full(len(x), _START, np.uint64)
    if len(x) > by:
        unbroken = np.logical_and.reduce([word[by - k : len(x) - k] for k in range(1, by + 1)])
        out[by:] = np.where(unbroken, x[:-by], _START)
    return out


def _keys(exact, norm, shape, kind) -> dict[str, np.ndarray]:
    """Keys of each position: pair, pair with the word's shape (0: none), word, three words, and the pair one place to the left."""
    word = kind == WORD
    before, far = _shifted(norm, word, 1), _shifted(norm, word, 2)
    pair = _mix(before, exact, 1)
    left = np.concatenate([[0], pair[:-1]]) if len(pair) else pair
    return {
        "pair": pair, "shape": np.where(shape != 0, _mix(before, shape, 2), 0), "word": _mix(exact, exact, 3),
        "three": _mix(_mix(far, before, 4).view(np.uint64), exact, 6), "left": np.where(before != _START, left, 0),
    }


def _line_keys(exact, norm, kind) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The last positions, keys and numbers of words of all lines of up to eight words and nothing else.

    One word stands for itself; in longer lines a capitalised word or a number stands for its kind.
    """
    edge = np.flatnonzero(kind >= BREAK)
    gap = np.diff(edge) - 1
    inside = np.concatenate([[0], np.cumsum(kind == STOP)])
    fits = (gap >= 1) & (gap <= _LINE_WORDS) & (inside[edge[1:]] == inside[edge[:-1]]) if len(edge) > 1 else np.zeros(0, bool)
    start, gap = edge[:-1][fits] + 1, gap[fits]
    key = np.where(gap == 1, exact[start], norm[start])
    for k in range(1, _LINE_WORDS):
        more = gap > k
        key[more] = _mix(key[more], norm[start[more] + k], 7).view(np.uint64)
    return start + gap - 1, _mix(key, key, 5), gap


def read_end(text: str, n_chars: int | None, units: Units = _NOTHING) -> tuple[int, bool, bool, list[tuple[str, bool]], str, bool, int]:
    """(verdict, open, marked, ends, main, terminated, inner): what one text tells about its end.

    ``main`` is its main content without closing furniture, ``inner`` the length of that
    without any furniture.

    ``terminated``: it is whole only because it ends with a terminator, where a limit can fall too.

    ``ends`` are the ends that the baselines have to judge, with whether they are prose:
    the last line of the text without page furniture and, above short lines such as menu
    items, the line before them.
    """
    size, main, end = len(text), "", 0
    if n_chars is not None and n_chars > size and n_chars != len(text.encode()) and n_chars != len(text.encode("utf-16-le")) // 2:
        return CUT, True, False, [], main, False, end
    bare = text.rstrip()
    misread = not bare.isascii() and _GARBLED_SIGNS.search(bare) is not None and len(_GARBLED.findall(bare)) >= 3
    if misread and (right := _repaired(bare)):
        bare, misread = right, False
    tail = bare[-GARBLED_TAIL - 3 : -3]
    garbled = tail.count("�") > max(1, GARBLED_SHARE * len(tail)) or misread
    if not garbled:
        if bare.endswith("�"):
            return CUT, True, False, [], main, False, end
        broken = _broken_at(bare)
        if broken >= 0:
            before = bare[max(0, broken - CONTEXT) : broken]
            if " " in before and sum(c.isalnum() or c in " .,–-\n" for c in before) >= 0.85 * len(before):
                return CUT, True, False, [], main, False, end
    end, taken, invited, measured = units.strip(bare)
    main = bare[:end]
    # furniture around a title is a page without content of its own
    title = main[main.rfind("\n") + 1 :]
    titled = taken and len(title) <= SHORT_LINE and len(title.split()) <= TITLE_WORDS and not _STOPS.search(main)
    if invited or titled or not main:
        return WHOLE, False, False, [], bare[:measured], False, end
    mark = _MARK.search(main) if main.endswith(_MARKS) else None
    if garbled and mark:
        return ASK, True, True, [], bare[:measured], False, end
    if garbled:
        closed = bool(re.search("[.!?]|ã€‚|ã\x80\x82|。", main[-7:]))
        if closed:
            return WHOLE, False, False, [], bare[:measured], True, end
        fragment = main[_fragment_start(main, 0, end) :].strip()
        if not (fragment.isascii() and len(fragment.split()) >= 4 and _is_prose(fragment[-160:])):
            return ASK, True, False, [], bare[:measured], False, end
    if bare[-1] in "©·|":
        return CUT, True, False, [], bare[:measured], False, end
    if mark:
        rest = main[: mark.start()]
        fragment = rest[_fragment_start(rest, 0, len(rest)) :].strip()
        prose = _is_prose(fragment[-80:]) and len(fragment.split()) >= 2
        return ASK, prose, True, [(rest[rest.rfind("\n") + 1 :], prose)], bare[:measured], False, end
    open_, stops, ends, at = False, False, [], end
    stack = None
    seen: set[str] = set()
    while True:  # the look back ends at a line that is not short
        start = main.rfind("\n", 0, at) + 1
        line = main[start:at]
        begin = _fragment_start(main, start, at)
        left: list[str] = []
        if not garbled and _OPENING.search(main, begin, at):  # what the last sentence may leave open
            stack = structure(main) if stack is None else stack
            left = [s for s, p in stack if begin <= p < at]
        fragment = main[begin:at].strip()
        if _terminated(line):
            # a quote that opened in the last sentence and never closed
            if any(s in "“„«「『\"" for s in left) and _is_prose(fragment[-80:]):
                return CUT, True, False, [], bare[:measured], False, end
            break
        prose = _is_prose(fragment[-160:]) and not (not start and line.isalpha()) and not _WIDE_TITLE.fullmatch(fragment)
        wide = any(c > "⿿" for c in fragment)
        words = len(fragment) // 3 if wide else len(fragment.split())
        if prose and left:
            return CUT, True, False, [], bare[:measured], False, end
        if prose and words >= 3 and re.search("[,:;(\\[„“«‚¿¡–—-]$", line):
            return CUT, True, False, [], bare[:measured], False, end
        open_ |= prose and words >= 4
        stops = True
        if "�" not in (fragment.split() or [""])[-1] and line not in seen:  # a damaged word tells nothing
            seen.add(line)
            ends.append((line, prose))
        if not start or words > 3 or len(line) > len(fragment) + 2:
            break
        at, _, invited, closed = units.strip(main, start)
        if invited or not at:
            break
        measured = min(measured, closed) if closed < len(main[:start].rstrip()) else measured
    return (ASK if stops else WHOLE), open_, False, ends, bare[:measured], not stops, end


def _last_words(line: str) -> list[str]:
    """The last tokens of a line that are no signs: all of them, or more than a line key takes behind a stop."""
    size = 120
    while True:
        at = max(0, len(line) - size)
        while at and not line[at - 1].isspace():
            at -= 1
        words = [w for w in TOKEN.findall(line, at) if w[0].isalnum() or w[0] in ".!?。？！…;|·•»"]
        if not at and len(words) <= _LINE_WORDS:
            return words
        if len(words) > _LINE_WORDS or not at:
            return [".", *words[-_LINE_WORDS:]]
        size *= 4


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words, pairs and lines over a partition's texts."""
    names = ["what", "key", *furniture.COUNTS]
    v, grams, lines = Vocabulary(), Counts(("total", "closing")), {}

    def rows(what: int, counted: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(counted[0]), 100_000):
            some = [pa.array(c[at : at + 100_000]) for c in counted]
            n = len(some[0])
            yield pa.record_batch([pa.array(np.full(n, what, np.int32)), *some, *[pa.nulls(n, pa.int64())] * (len(names) - 1 - len(some))], names=names)

    for b in by_text(batches):
        tokens: list[str] = ["\x00"]
        for text in b.column("text").to_pylist():
            if text is not None and text.strip():
                tokens += TOKEN.findall(text)
                tokens.append("\x00")
        exact, norm, shape, first, kind, flags = v.read(tokens)
        for what, counted in furniture.line_counts(exact, norm, first, kind, flags).items():
            lines.setdefault(what, Counts(tuple(furniture.COUNTS), 500_000)).add(*counted)
        said = kind != SIGN
        exact, norm, shape, kind = exact[said], norm[said], shape[said], kind[said]
        # the words that something follows: how often is it a stop or a line end
        k = _keys(exact, norm, shape, kind)
        at = np.flatnonzero((kind[:-1] == WORD) & (kind[1:] != EDGE))
        closes = (kind[at + 1] == STOP) | (kind[at + 1] == BREAK)
        shaped = at[k["shape"][at] != 0]
        line_end, line, words = _line_keys(exact, norm, kind)
        line = line[(kind[line_end + 1] == BREAK) | (words >= 3)]  # at the end of a text short lines prove nothing
        keys = np.concatenate([k["pair"][at], k["word"][at], k["three"][at], k["shape"][shaped], line])
        flags = np.concatenate([closes, closes, closes, closes[k["shape"][at] != 0], np.ones(len(line), bool)]).astype(np.int64)
        grams.add(keys, np.ones(len(keys), np.int64), flags)
        yield from rows(furniture.GRAM, grams.overflow())
        for what, counts in lines.items():
            yield from rows(what, counts.overflow())
    yield from rows(furniture.GRAM, grams.merged())
    for what, counts in lines.items():
        yield from rows(what, counts.merged())


def _features(doc_kind: str, id_type: pa.DataType, shared, longest: int):
    """Read the ends of texts; ``shared`` holds the known units, or each row brings its own (column ``known``); the longest has so many tokens."""
    names = [x.split()[0] for x in _FEATURES.format(doc_kind).split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid, count, v = TaskContext.get().partitionId(), 0, Vocabulary()
        units = Units(shared.value if shared is not None else (), longest)
        for b in by_text(batches):
            n = b.num_rows
            texts, stored = b.column("text").to_pylist(), b.column("n_chars").to_pylist()
            own = b.column("known").to_pylist() if shared is None else [None] * n
            rows, asked = [], []
            for text, n_chars, known in zip(texts, stored, own):
                if text is None or not text.strip():
                    rows.append((0, 0, 0, 0, WHOLE, False, False, False))
                    asked.append([])
                    continue
                if shared is None:
                    units.know(tuple(x[c] for c in Units.COLUMNS) for x in known or ())
                verdict, open_, marked, ends, main, terminated, inner = read_end(text, n_chars, units)
                head = units.head(main, SHORT_LINE)
                size = len(text) if text.isascii() else len(text.rstrip("�").encode())
                rows.append((len(text), size, len(main) - head, max(0, inner - head), verdict, open_, marked, terminated))
                asked.append(ends)
            # the last words of the ends to be judged, with their line where it is short
            last: list[str] = ["\x00"]
            places: list[list[tuple[int, bool, bool]]] = []
            for ends in asked:
                mine = []
                for line, prose in ends:
                    words = _last_words(line)
                    if words and words[-1][0].isalnum():
                        last += words
                        mine.append((len(last) - 1, words[-1][0].islower(), prose))
                        last.append("\x00")
                places.append(mine)
            e, m, h, _, kinds, _ = v.read(last)
            of_end = {c: x.tolist() for c, x in _keys(e, m, h, kinds).items()}
            lines = dict(zip(*(x.tolist() for x in _line_keys(e, m, kinds)[:2])))
            # a word of up to three letters is often a piece of another one: alone it tells nothing
            short = {j for mine in places for j, low, _ in mine if low and len(last[j]) <= 3}
            asks = [
                [{"line": lines.get(j), **{c: None if c == "word" and j in short else x[j] or None for c, x in of_end.items()}, "lower": low, "prose": prose} for j, low, prose in mine]
                for mine in places
            ]
            chars, size, body, bare, verdict, open_, marked, terminated = (list(x) for x in zip(*rows))
            text_key = [_text_key(t) if t else None for t in texts]
            columns = [
                b.column("doc_id"), b.column("source"), pa.array(text_key, pa.int64()), pa.array((pid << 40) + count + np.arange(n)),
                pa.array(chars, pa.int64()), pa.array(size, pa.int64()), pa.array(body, pa.int64()), pa.array(bare, pa.int64()), pa.array(verdict, pa.int32()), pa.array(open_, pa.bool_()), pa.array(marked, pa.bool_()), pa.array(terminated, pa.bool_()),
                pa.array(asks, _ASK),
            ]
            count += n
            yield pa.record_batch(columns, names=names)

    return run


def _text_key(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - 2**63


def _parts(longest: int):
    """``text_key, key``: the keys under which parts of a text may be known as furniture of so many tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units(most=longest)
        for b in by_text(batches):
            for text in b.column("text").to_pylist():
                if text:
                    keys = pa.array(sorted(units.candidates(text)), pa.int64())
                    yield pa.record_batch([pa.array(np.full(len(keys), _text_key(text))), keys], names=["text_key", "key"])

    return run


def ends(documents: DataFrame, most_broadcast: int = furniture.MOST_BROADCAST) -> tuple[DataFrame, DataFrame]:
    """(ends, counts), both written: one row a document with what its end tells, and the counts of words, pairs and lines.

    The furniture is learned from the counts. Up to ``most_broadcast`` units it goes to
    all workers; beyond that the texts are joined with their own units.
    """
    spark: SparkSession = documents.sparkSession
    kind = documents.schema["doc_id"].dataType.simpleString()
    counts = materialize(spread(documents.select(F.col("text").cast("string").alias("text"))).mapInArrow(_count, _COUNTED), "counts")
    rows = documents.select("doc_id", F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"), F.col("n_chars").cast("long").alias("n_chars"))
    id_type, shared = to_arrow_type(documents.schema["doc_id"].dataType), None
    known = furniture.units(counts)
    few = known.limit(most_broadcast + 1).toPandas()
    if len(few) <= most_broadcast:
        longest = int(few["size"].max()) if len(few) else 0
        shared = spark.sparkContext.broadcast([r.tolist() for r in few[Units.COLUMNS].to_numpy()])
    else:
        known = materialize(known, "furniture")
        longest = known.agg(F.max("size").cast("int")).first()[0]
        parts = rows.select("text").mapInArrow(_parts(longest), "text_key long, key long").join(known, "key")
        mine = parts.distinct().groupBy("text_key").agg(F.collect_list(F.struct(*Units.COLUMNS)).alias("known"))
        keyed = rows.mapInArrow(_with_text_key, f"doc_id {kind}, source string, text string, n_chars long, text_key long")
        rows = keyed.join(mine, "text_key", "left").drop("text_key")
    features = _features(kind, id_type, shared, longest)
    return materialize((spread(rows) if shared else rows).mapInArrow(features, _FEATURES.format(kind)), "ends"), counts


def _with_text_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in by_text(batches):
        # rows without text spread over the partitions
        keys = [_text_key(t) if t else i for i, t in enumerate(b.column("text").to_pylist())]
        yield pa.record_batch([*b.columns, pa.array(keys, pa.int64())], names=[*b.schema.names, "text_key"])


def naturalness(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """``uid, source, doc_id, text_key, chars, bytes, body, main, verdict, open, marked, terminated, broken, broken_prose``, written.

    ``broken``: one of the ends stops where hardly any sentence or line does.
    """
    asks = docs.select("uid", F.explode("asks").alias("a")).select("uid", F.monotonically_increasing_id().alias("ask"), "a.*")
    keys = F.array(*[F.struct(F.lit(c).alias("what"), F.col(c).alias("key")) for c in _KEYS])
    keyed = asks.select("uid", "ask", "lower", "prose", F.explode(keys).alias("k")).select("uid", "ask", "lower", "prose", "k.*").filter("key is not null")
    grams = counts.filter(F.col("what") == furniture.GRAM).select("key", "total", "closing")
    known = grams.join(keyed.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.sum("total").alias("total"), F.sum("closing").alias("closing"))
    of = lambda c, kind: F.coalesce(F.max(F.when(F.col("what") == kind, F.col(c))), F.lit(0)).alias(f"{c}_{kind}")
    of_end = keyed.join(known, "key", "left").groupBy("uid", "ask").agg(*[of(c, k) for c in ("total", "closing") for k in _KEYS], F.first("lower").alias("lower"), F.first("prose").alias("prose"))
    # the most exact of the four that is known decides; a lower-case word that is not known is broken off
    few = F.col("lower")
    for kind in ("word", "shape", "pair", "line"):
        few = F.when(F.col(f"total_{kind}") >= KNOWN, F.col(f"closing_{kind}") < CLOSING_SHARE * F.col(f"total_{kind}")).otherwise(few)
    # a "word" that nothing ever follows, where another word nearly always stands, is the beginning of that word
    piece = F.col("lower") & (F.col("closing_word") >= 0.9 * F.col("total_word")) & (F.col("total_three") < CHAIN * F.col("total_left")) & (F.col("total_line") < KNOWN)
    broken = few | piece
    of_doc = of_end.groupBy("uid").agg(F.max(broken).alias("broken"), F.max(broken & F.col("prose")).alias("broken_prose"))
    columns = ["uid", "doc_id", "source", "text_key", "chars", "bytes", "body", "main", "verdict", "open", "marked", "terminated"]
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("broken", "broken_prose")]
    return materialize(docs.select(columns).join(of_doc, "uid", "left").select(*columns, *flags), "broken")


UNITS = ("chars", "bytes", "body", "main")


def limits(natural: DataFrame) -> DataFrame:
    """``source, unit, length, exact`` where a source's texts that stop in the middle pile up.

    Units are characters and bytes of the text and characters of its main content without
    closing furniture and without any. Counts
    different texts by source and length; a window of one source holds its distinct
    lengths, not its rows. ``exact``: the pile is on one length. A pile that is clear
    against the lengths around it counts whatever its share of the source's stops is.
    """
    stopped = natural.filter((F.col("verdict") == CUT) | F.col("broken_prose") | (F.col("marked") & F.col("open")))
    units = F.create_map(*[x for u in UNITS for x in (F.lit(u), F.col(u))])
    sizes = stopped.select("source", "text_key", F.explode(units).alias("unit", "length")).filter("length > 0")
    counts = sizes.distinct().groupBy("source", "unit", "length").agg(F.count(F.lit(1)).alias("n"))
    along = Window.partitionBy("source", "unit").orderBy("length")
    near = F.sum("n").over(along.rangeBetween(-NEAR, NEAR))
    far = F.sum("n").over(along.rangeBetween(-AROUND, AROUND)) - near
    total = F.sum("n").over(Window.partitionBy("source", "unit"))
    width = 2 * (AROUND - NEAR)
    one = (F.col("n") >= LEAST_PILE) & (F.col("n") >= 12 * F.col("far") / width)
    wide = (F.col("near") >= 2 * LEAST_PILE) & (F.col("near") >= 5 * F.col("far") * (2 * NEAR + 1) / width)
    exact = one & (2 * F.col("n") >= F.col("near"))
    large = (F.col("near") >= LEAST_SHARE * F.col("total")) & (F.col("length") >= LEAST_LENGTH)

    def sure(n, lengths: int):
        """Chernoff's bound for so many where the lengths around, with one text more, would make ``usual``."""
        usual = (F.col("far") + 1) * lengths / width
        return (n > usual) & (n * F.log(n / usual) - n + usual >= SURE)

    piles = (one & (large | sure(F.col("n"), 1))) | (wide & (large | sure(F.col("near"), 2 * NEAR + 1)))
    counts = counts.withColumn("near", near).withColumn("far", far).withColumn("total", total)
    return counts.filter(piles).select("source", "unit", "length", exact.alias("exact"))


def judged(read: tuple[DataFrame, DataFrame]) -> DataFrame:
    """``doc_id, source, cut`` for every document, of what :func:`ends` read."""
    docs = naturalness(*read)
    piles = limits(docs)
    for unit in UNITS:
        # a source's distinct pile lengths: far fewer than its rows
        at = piles.filter(F.col("unit") == unit).select(F.col("source").alias("s"), F.col("length").alias("l"), F.col("exact").alias(f"at_{unit}"))
        docs = docs.join(at, F.col("source").eqNullSafe(F.col("s")) & (F.col(unit) == F.col("l")), "left").drop("s", "l")
    exact = F.coalesce(*[F.when(F.col(f"at_{u}"), True) for u in UNITS], F.lit(False))
    at_limit = F.coalesce(*[F.col(f"at_{u}").isNotNull() | F.lit(None) for u in UNITS], F.lit(False))
    cut = (
        F.when(F.col("verdict") == CUT, True)
        .when(F.col("terminated"), exact)
        .when(F.col("verdict") == WHOLE, False)
        .when(F.col("marked"), at_limit | F.col("broken_prose"))
        .otherwise(F.col("broken_prose") | exact | (at_limit & (F.col("open") | F.col("broken"))))
    )
    return docs.select("doc_id", "source", cut.alias("cut"))


def found(judged: DataFrame) -> DataFrame:
    """The truncated documents: ``doc_id``."""
    return judged.filter("cut").select("doc_id").distinct()


def report(judged: DataFrame) -> DataFrame:
    """By source: documents, truncated ones and their share."""
    return judged.groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if("cut").alias("truncated"), F.round(F.count_if("cut") / F.count(F.lit(1)), 6).alias("share")
    )
