"""Truncated texts on a small made-up corpus."""

import random

import pytest

from cairnlake.llm import furniture
from cairnlake.llm import truncation as X

DOCS = "doc_id long, source string, text string, n_chars long, uid string, cut string, what int"
WORDS = ("harbour lantern kettle quarry orchard museum ferry ladder garden bridge valley tunnel market pattern library archive").split()
ENDS = ("two volunteers", "a rainy afternoon", "the winter break", "the second week")


def sentence(r):
    return f"The {r.choice(WORDS)} near the {r.choice(WORDS)} was {r.choice(['painted', 'moved', 'cleaned'])} during {r.choice(ENDS)}."


def corpus(seed=1, n=400):
    r = random.Random(seed)
    rows, cut = [], set()
    for i in range(n):
        body = f"{r.choice(WORDS).title()} {r.choice(WORDS)}\n" + " ".join(sentence(r) for _ in range(r.randint(6, 12)))
        kind = i % 10
        source = "limited" if i % 4 == 0 else "free"
        if source == "limited" and len(body) > 500:
            body = body[:500]
            if not body.endswith("."):
                cut.add(i)
        elif kind == 1:
            body = body[: r.randint(200, 400)] + "<a hre"
            cut.add(i)
        elif kind == 2:
            body = body[:-1]  # its author left out the full stop
        elif kind == 3:
            body += "\nBack to top"
        elif kind == 5:
            body += "\nTags: ferry, ladder\n© 2020 Some Society · Imprint · Privacy"
        elif kind == 6:
            body += "\nRead more …"
        elif kind == 7:
            body = "\n".join(f"{r.choice(WORDS)} – {r.randint(1, 99)},50 kr" for _ in range(30))
        elif kind == 9:
            body = body[: r.randint(200, 300)].rsplit(" ", 1)[0]
            if not body.endswith((".", *ENDS)):
                cut.add(i)
            body += "\nBack to top"
        rows.append((i, source, body, None, "u", "c", 1))
    return rows, cut


def cut_ids(spark, rows):
    judged = X.judged(X.ends(spark.createDataFrame(rows, DOCS)))
    got = [r.doc_id for r in X.found(judged).collect()]
    assert len(got) == len(set(got))
    return set(got), judged


def test_corpus(spark):
    rows, want = corpus()
    got, judged = cut_ids(spark, rows)
    assert len(got - want) <= 0.03 * len(want) and len(want - got) <= 0.05 * len(want)
    report = {r.source: r for r in X.report(judged).collect()}
    assert sum(r.documents for r in report.values()) == len(rows) and report["limited"].truncated > 50


def test_nulls_blanks_and_empty(spark):
    rows = [(1, None, None, None, "u", "c", 1), (2, "s", "", 5, "u", "c", 1), (3, "s", " \n ", None, "u", "c", 1), (4, None, "Done.", 5, "u", "c", 1), (5, "s", "Half of it", 900, "u", "c", 1), (5, "s", "Half of it", 900, "u", "c", 1), (6, "s", "x" * 200_000, None, "u", "c", 1), (7, "s", "é", 2, "u", "c", 1)]
    got, judged = cut_ids(spark, rows)
    assert got == {5} and judged.count() == len(rows)
    got, judged = cut_ids(spark, [])
    assert got == set() and X.report(judged).count() == 0


@pytest.mark.parametrize(
    ("text", "open_"),
    [
        ("“We moved it,” she said, “and it", ["“"]), ("„Die Uhr bleibt“, sagte er.", []), ("„Die Uhr", ["„"]), ("He left (in a hurry", ["("]), ("Odd ( sign. A new sentence", []),
        ("a ( b\nnext", []), ("« Oui », dit-il", []), ("« Oui", ["«"]), (") closed", []), ("「はい", ["「"]),
    ],
)
def test_automaton(text, open_):
    assert X.open_delimiters(text) == open_


#: furniture that no code knows: invented words, and every one of the usual forms
LINES = (
    "Zurb Klonk to top", "Made with Grooble", "\N{COPYRIGHT SIGN} {n} {Name} Society · Imprint · Privacy", "Tags: {word}, {word}", "\N{EM DASH} {Name} {Name}", "Flim more …", "Frob all notices. Yes | No | Perhaps",
    "Every right is {Name} Ltd.",
)


def line(r, form):
    name = lambda: "".join(r.choice(("ra", "vo", "thel", "min", "kas")) for _ in range(3)).title()
    while "{Name}" in form:
        form = form.replace("{Name}", name(), 1)
    while "{word}" in form:
        form = form.replace("{word}", r.choice(WORDS), 1)
    return form.replace("{n}", str(r.randint(1990, 2030)))


def furnished(seed=3, n=1200):
    """Texts with furniture that nothing has seen; every sixth is cut before it, some lost their line breaks."""
    r = random.Random(seed)
    rows, cut = [], set()
    for i in range(n):
        body = f"{r.choice(WORDS).title()} {r.choice(WORDS)}\n" + " ".join(sentence(r) for _ in range(r.randint(4, 9)))
        if i % 6 == 0:
            end = r.randint(120, len(body) - 3)
            if body[end - 1].isalpha() and body[end].isalpha():  # within a word
                body = body[:end]
                cut.add(i)
        gap = " " if i % 5 == 4 else "\n"
        for _ in range(r.randint(0, 2)):
            form = r.choice([f for f in LINES if "…" not in f or i not in cut])
            body += gap + line(r, form)
        rows.append((i, f"s{i % 7}", body, None, "u", "c", 1))
    return rows, cut


@pytest.fixture(scope="module")
def units(spark):
    rows, _ = furnished()
    counts = spark.createDataFrame(rows, DOCS).select("text").mapInArrow(X._count, X._COUNTED).cache()
    few = furniture.units(counts).toPandas()
    return furniture.Units(few[furniture.Units.COLUMNS].itertuples(index=False), int(few["size"].max()))


def test_furniture_never_seen_before(spark, capsys):
    rows, want = furnished()
    got, judged = cut_ids(spark, rows)
    recall, precision = len(got & want) / len(want), len(got & want) / len(got)
    with capsys.disabled():
        print(f" unseen furniture: recall {recall:.3f}, precision {precision:.3f} ", end="")
    assert recall >= 0.95 and precision >= 0.95
    # beyond the bound the texts are joined with their own units: the same answers
    joined = X.judged(X.ends(spark.createDataFrame(rows + [(9000 + i, "s", t, None, "u", "c", 1) for i, t in enumerate((None, "", " "))], DOCS), most_broadcast=0))
    assert {r.doc_id for r in X.found(joined).collect()} == got


@pytest.mark.parametrize(
    ("text", "verdict"),
    [
        ("The ferry was moved.", X.WHOLE), ("The ferry was mo<a hre", X.CUT), ("The ferry was mo</di", X.CUT), ("The ferry was mo&am", X.CUT), ("The ferry was mo&#82", X.CUT), ("The ferry was mo\ufffd", X.CUT),
        ("The ferry was moved by the crew,", X.CUT), ("The ferry said “we moved", X.CUT), ("The ferry was moved.\n© 2020 Thelra Society · Imprint · Privacy", X.WHOLE), ("The ferry was moved.\n\n© ", X.CUT), ("It runs. Flim more …", X.WHOLE),
        ("The ferry was moved", X.ASK), ("The ferry was mo [...]", X.ASK), ("It was moved. :)", X.WHOLE), ("Γιατί άνοιξε η αυλή;", X.WHOLE), ("“It cost 5 crowns.", X.CUT),
        ('The ferry said "we moved', X.CUT), ('The ferry said "we moved it".', X.WHOLE), ("The ferry was moved <!-- and then. " + "It ran. " * 100, X.CUT), ("The ferry was moved <!-- no --> at noon.", X.WHOLE),
        ('The ferry was mo<a href="/a' + "b" * 500, X.CUT), ("The ferry was x <b and then it was moved again.", X.WHOLE),
    ],
)
def test_read_end(text, verdict, units):
    assert X.read_end(text, None, units)[0] == verdict


def test_structure_over_the_whole_text():
    assert [s for s, _ in X.structure("( a [ b ) c “d” \"e\" „f“")] == []
    assert X.structure('a ( b. c "d e. f') == [("(", 2), ('"', 9)]
    assert X.structure("x <!-- ( “ ") == [("<!--", 2)]


def test_furniture(units):
    assert X.without_furniture("It ran.\nTags: ferry, ladder\n— Rava Thel\nZurb Klonk to top", units) == ("It ran.", 3)
    assert X.without_furniture("сад — нет.", units) == ("сад — нет.", 0)
    assert X.without_furniture("It ran.\nFlim more …\nMade with Grooble", units) == ("It ran.", -1)
    assert X.without_furniture("It ran.\nMade with Grooble") == ("It ran.\nMade with Grooble", 0)  # nothing is known


def test_wrongly_read_text_is_repaired():
    text = "„Die Uhr bleibt“, sagte er. Für die große Brücke — schön – „Die Zeit"
    for how in ("cp1252", "latin-1"):
        wrong = text.encode().decode(how, "replace")
        assert X._repaired(wrong) == text and X.read_end(wrong, None)[0] == X.CUT
    assert X._repaired("сад — нет") is None


def test_notices_behind_the_text(units):
    for notice in ("Frob all notices. Yes | No | Perhaps", "Zurb Klonk to top", "Every right is Rathel Ltd."):
        for gap in (" ", "\n"):
            assert X.without_furniture("It was painted. It was mo" + gap + notice, units) == ("It was painted. It was mo", 1)


def words_of(r, size):
    """Sentences and the first words of one more, just so long."""
    text = sentence(r)
    while len(text) <= size:
        text += " " + sentence(r)
    return text[:size]


def ending(r, size):
    """Sentences, just so long, the last one with its full stop."""
    return words_of(r, size - 1).rstrip(" .").ljust(size - 1, "e") + "."


def test_a_terminated_text_on_the_exact_limit_of_its_source_is_cut(spark):
    r = random.Random(5)
    stopped = [t for t in (words_of(r, 500) for _ in range(90)) if not t.endswith((".", " "))]
    on, off = [ending(r, 500) for _ in range(4)], [ending(r, n) for n in (430, 470, 499, 501, 520, 560)]
    assert all(len(t) == 500 and t.endswith(".") for t in on)
    rows = [(i, "limited", t, None, "u", "c", 1) for i, t in enumerate(stopped + on + off)]
    rows += [(1000 + i, "free", t, None, "u", "c", 1) for i, t in enumerate(on)]
    got, _ = cut_ids(spark, rows)
    n = len(stopped)
    assert {n, n + 1, n + 2, n + 3} <= got and not {i for i in got if i >= n + len(on)}


def test_a_clear_pile_counts_whatever_its_share(spark):
    """Most texts of a source stop anywhere; two limits hold less than 15 % of the stops each."""
    r = random.Random(6)
    natural = [("s", i, n, n, n, n, n, X.CUT, True, False, False, False, False) for i, n in enumerate(r.randint(300, 3000) for _ in range(1500))]
    limited = [("s", 2000 + i, n, n, n, n, n, X.CUT, True, False, False, False, False) for i, n in enumerate([800] * 40 + [2000] * 60)]
    few = [("t", 3000 + i, n, n, n, n, n, X.CUT, True, False, False, False, False) for i, n in enumerate(r.randint(300, 2300) for _ in range(300))]
    columns = "source string, text_key long, chars long, bytes long, body long, main long, uid long, verdict int, open boolean, marked boolean, broken boolean, broken_prose boolean, terminated boolean"
    piles = X.limits(spark.createDataFrame(natural + limited + few, columns)).collect()
    assert {(p.source, p.length) for p in piles if p.exact} == {("s", 800), ("s", 2000)}
    assert all(p.source == "s" and min(abs(p.length - 800), abs(p.length - 2000)) <= X.NEAR for p in piles)


def test_one_stray_sign_does_not_hide_an_end(units):
    stray = "Die alte Br�cke wurde im Frühjahr gestrichen. " + "Die Uhr am Markt geht seit dem Winter wieder richtig. " * 5
    for cut in ("Die Fähre wurde früh am Morgen verscho", "Паром перенесли рано утр", "Η γέφυρα άνοιξε χωρίς προειδοποί"):
        for footer in ("", "\nZurb Klonk to top", "\n© 2020 Verein Society · Imprint · Privacy"):
            verdict, _, _, ends, main, terminated, _ = X.read_end(stray + cut + footer, None, units)
            assert verdict == X.ASK and len(ends) == 1 and ends[0][0].endswith(cut) and main.endswith(cut) and not terminated
    for cut in ("Die Fähre wurde mo<a hre", "Die Fähre sagte „wir sind", "Die Fähre wurde mo&am"):
        assert X.read_end(stray + cut, None)[0] == X.CUT
    assert X.read_end(stray + "Die Fähre wurde versch�ben", None)[3] == []  # the damaged word itself is not judged
    heavy = "������ ��� ������� " * 20
    assert X.read_end(heavy + "������� ����\n© 2020 Verein Society · Imprint · Privacy", None, units)[:2] == (X.ASK, True)


def test_the_look_back_ends_at_a_line_that_is_not_short(units):
    body = "The ferry was moved. The lantern near the harbour was pain"
    menu = "".join(f"\nItem {w.title()}" for w in WORDS)
    _, _, _, ends, main, *_ = X.read_end(body + menu, None)
    assert len(ends) == len(WORDS) + 1 and ends[-1][0].endswith("harbour was pain")
    assert X.read_end("The ferry said “we moved the lantern" + menu, None)[0] == X.CUT
    footer = "".join(f"\n© 20{i} Some Society · Imprint · Privacy" for i in range(10, 40))
    assert X.without_furniture(body + footer, units) == (body, 30)
    _, open_, _, ends, main, *_ = X.read_end(body + footer, None, units)
    assert main == body and open_ and len(ends) == 1
    assert [e[0] for e in X.read_end(body + "\nHome" * 1000, None)[3]][-1].endswith("pain")
