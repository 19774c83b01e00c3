import random

import pytest
from pyspark.sql import functions as F

from tintwerk.functions import persons, text, tokens
from tintwerk.functions.page import Page

TOKENS = ["„Kinzel,“", "Hauptstraße", "Hauptstr.", "Hauptstrasse", "(15)", "Kin-", "-", "", "  ", "Müller–Lüdenscheidt", "STRASSE", "»ÄÖÜß«", "a-"]
PAIRS = [("kinzel", "kinzei"), ("meier", "maier"), ("max", "mai"), ("15", "l5"), ("65589", "65588"), ("kinzel", "kinzels"), ("anna", "anna’s"), ("mustermann", "mustremann"), ("", "x"), ("abcde", "abcdef")]
NAMES = ["Robin Kinzel", "Kinzel, Robin", "Erika Maria Mustermann", "Ursula von der Leyen", "Anna-Lena Schmidt-Weber", "Mustermann", "Herr Dr. Robin Kinzel", "Frau Gül Yilmaz", "", "von", "Dr. Prof.", "Müller, Hans, Dr.", "O'Brien Émile"]


def test_norm_and_names_agree_in_python_and_columns(spark):
    rows = spark.createDataFrame([(t,) for t in TOKENS], "t string").select("t", text.norm(F.col("t")).alias("n")).collect()
    assert [(r.t, r.n) for r in rows] == [(t, tokens.norm(t)) for t in TOKENS]
    assert [tokens.norm(t) for t in TOKENS[:4]] == ["kinzel", "hauptstr", "hauptstr", "hauptstr"]
    rows = spark.createDataFrame([(n,) for n in NAMES], "n string").select(
        "n", text.name_tokens(F.col("n")).alias("t"), text.initials(F.col("n")).alias("i"), text.initials(F.col("n"), 2, 3).alias("j"), text.name_words(F.col("n")).alias("w")
    )
    for r in rows.collect():
        assert r.t == tokens.name_tokens(r.n) and (r.i, r.j) == (persons.initials(r.n), persons.initials(r.n, 2, 3)), r
        assert [tuple(x) for x in r.w] == persons.name_words(r.n)
    assert [persons.initials(n) for n in NAMES[:8]] == ["R.K.", "R.K.", "E.M.M.", "U.v.d.L.", "A.-L.S.-W.", "M.", "R.K.", "G.Y."]


@pytest.mark.parametrize("possessive", [False, True])
def test_alike_agrees_in_python_and_columns(spark, possessive):
    r = random.Random(1)
    pairs = PAIRS + [("".join(r.choice("abs1l'") for _ in range(r.randrange(9))), "".join(r.choice("abs1l'") for _ in range(r.randrange(9)))) for _ in range(300)]
    pairs += [(a, a[:3] + r.choice("xs") + a[r.choice([3, 4]) :]) for a, _ in pairs]
    rows = spark.createDataFrame(pairs, "a string, b string")
    got = rows.select("a", "b", text.alike(F.col("a"), F.col("b"), True, possessive).alias("m"), text.alike(F.col("a"), F.col("b"), False, possessive).alias("e")).collect()
    for x in got:
        assert (x.m, x.e) == (tokens.alike(x.a, x.b, True, possessive), tokens.alike(x.a, x.b, False, possessive)), x
    assert [tokens.alike(a, b) for a, b in PAIRS[:5]] == [True, True, False, True, False]


def page(t):
    return Page([{"text": w, "line": i, "x0": 0.0, "y0": 0.0, "x1": 1.0, "y1": 1.0} for i, line in enumerate(t.split("\n")) for w in line.split()])


@pytest.mark.parametrize(
    ("t", "phrase", "more", "want"),
    [
        ("An Herrn Robin Kinzei, Musterweg 15", "Robin Kinzel", {}, ["Robin Kinzei,"]),
        ("Robin Kin-\nzel", "Robin Kinzel", {}, ["Robin Kin-\nzel"]),
        ("RobinKinzel kam", "Robin Kinzel", {}, ["RobinKinzel"]),
        ("Herr Kin zel kam", "Kinzel", {}, ["Kin zel"]),
        ("Kinzels Auto. Der kinzel-Test", "Kinzel", {"possessive": True, "capital": True}, ["Kinzels"]),
        ("Bahnhofstr. 7, 35578 Wetzlar", "Bahnhofstraße 7", {}, ["Bahnhofstr. 7,"]),
        ("Bahnhofstr. 7, 35578 Wetzlar", "35578 Wetzlar", {}, ["35578 Wetzlar"]),
        ("Robin , Kinzel . Robin Kinzel", "Robin Kinzel", {}, ["Robin , Kinzel", "Robin Kinzel"]),
        ("", "x", {}, []),
    ],
)
def test_phrase_search(t, phrase, more, want):
    p = page(t)
    found = tokens.PageScanner(p.texts, p.lines).find(tokens.tokenize(phrase), **more)
    assert [p.segment_text([(w, None, None) for w in range(*f)]) for f in found] == want


def test_labels(spark):
    labels = ["Mandant", "Person C", "Adresse Person B", "R.K.", "R.K./H.K.", "Adresse R.K.", "geschwärzt", "Arbeitgeber", "Ort", "Mandant/Gegner", "Haus am See", "H.M. (2)", "Adresse Mandant"]
    want = ["Mdt.", "P. C", "Adr. B", "R.K.", "R.K./H.K.", "Adr. R.K.", "X", "Arbe.", "Ort", "Mdt./Ggn.", "HAS", "H.M. (2)", "Adr. Mdt."]
    rows = spark.createDataFrame([(x,) for x in labels], "l string")
    assert [r[0] for r in rows.select(text.short_label(F.col("l"))).collect()] == want
    mapping = F.create_map(F.lit("Person A"), F.lit("R.K."), F.lit("a/b"), F.lit("c"))
    rows = spark.createDataFrame([("Person A",), ("Person A/Mandant",), ("a/b",), ("x",)], "l string")
    assert [r[0] for r in rows.select(text.relabel(F.col("l"), mapping)).collect()] == ["R.K.", "R.K./Mandant", "c", "x"]


def test_persons_in_order():
    book = persons.PersonBook(["Robin Kinzel"], [])
    assert book.resolve("Kinzel").label == "Mandant" and book.resolve("Erika Mustermann").label == "Person A"
    assert book.resolve("Mustermann").label == "Person A" and book.resolve("Erika Maria Mustermann").label == "Person A"
    assert book.resolve("Jens Beispiel").label == "Person B" and book.resolve("Herr Dr.") is None and book.resolve("Gegenseite").kind == "gegner"
    assert book.resolve("Unbekannt Neu", create=False) is None
    clash = persons.PersonBook()
    for n in ("Rita Kiesel", "Rolf Klein", "Hans Müller", "Hanna Müller", "Jens Beispiel"):
        clash.persons.append(persons.Person(f"Person {len(clash.persons)}").spelled(n))
    clash.final_labels()
    assert [p.label for p in clash.persons] == ["R.Ki.", "R.Kl.", "H.M.", "H.M. (2)", "J.B."] and clash.final_labels() == {}


def test_chunks_and_values(spark):
    row = spark.createDataFrame([("aaaa\nbb\ncccccccc\nd",)], "t string")
    assert row.select(text.chunks(F.col("t"), 8)).first()[0] == ["aaaa\nbb\n", "cccccccc\n", "d\n"]
    one = spark.createDataFrame([(" A ; B\n;C", "Musterweg 15, 12345 Musterstadt;x, Ort")], "a string, b string")
    got = one.select(text.split_values(F.col("a")).alias("v"), text.address_parts(F.col("b")).alias("p")).first()
    assert got.v == ["A", "B", "C"] and got.p == ["Musterweg 15", "12345 Musterstadt", "Ort"]
