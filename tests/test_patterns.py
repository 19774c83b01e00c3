import pytest
from pyspark.sql import functions as F

from tintwerk.operators.names import professional, salutation_names
from tintwerk.operators.patterns import detect_patterns, iban_valid

CASES = [
    ("E-Mail: robin.kinzel@web.de", [("E-Mail", "robin.kinzel@web.de")]),
    ("an robin.kinzel@web.de.", [("E-Mail", "robin.kinzel@web.de")]),
    ("info @ example.com bitte", [("E-Mail", "info @ example.com")]),
    ("Tel.: 06433/123456", [("Telefon", "06433/123456")]),
    ("Telefon 06433 9452-0", [("Telefon", "06433 9452-0")]),
    ("Fax: (06433) 9452-20", [("Fax", "(06433) 9452-20")]),
    ("Mobil: 0171 1234567", [("Handy", "0171 1234567")]),
    ("erreichbar unter +49 171 1234567", [("Handy", "+49 171 1234567")]),
    ("Tel +49 (0) 6431 12 34 56", [("Telefon", "+49 (0) 6431 12 34 56")]),
    ("Limburg, den 12.03.2024", []),
    ("Az. 012345/2024", []),
    ("Betrag 1.234,56 EUR", []),
    ("65589 Hadamar", []),
    ("IBAN: DE89 3704 0044 0532 0130 00", [("IBAN", "DE89 3704 0044 0532 0130 00")]),
    ("DE89370400440532013000 COBADEFFXXX", [("IBAN", "DE89370400440532013000")]),
    ("Konto AT611904300234573201", [("IBAN", "AT611904300234573201")]),
    ("DE89370400440532013001", [("IBAN", "DE89370400440532013001")]),
    ("Konto-Nr.: 123 456 789", [("Konto-Nr.", "123 456 789")]),
    ("Rentenversicherungsnummer 12 150380 M 015", [("SV-Nr.", "12 150380 M 015")]),
    ("Ihre SV-Nr.: 12150380M015", [("SV-Nr.", "12150380M015")]),
    ("Versichertennummer: A123456789", [("Vers.-Nr.", "A123456789")]),
    ("Versicherungsschein-Nr. 4711-0815/23 vom 3. Mai", [("Vers.-Nr.", "4711-0815/23")]),
    ("Mitgliedsnummer 123 456 789", [("Vers.-Nr.", "123 456 789")]),
    ("geb. 01.01.2001", [("Geb.-Datum", "01.01.2001")]),
    ("geb. am 1.1.2001", [("Geb.-Datum", "1.1.2001")]),
    ("geboren am 3. März 1980 in Limburg", [("Geb.-Datum", "3. März 1980"), ("Geb.-Ort", "Limburg")]),
    ("geboren in Köln am 3.4.1980", [("Geb.-Datum", "3.4.1980"), ("Geb.-Ort", "Köln")]),
    ("Geburtsdatum: 24.12.1975", [("Geb.-Datum", "24.12.1975")]),
    ("* 05.06.1970", [("Geb.-Datum", "05.06.1970")]),
    ("geb. Beispiel, geboren am 3. März 1980 in Limburg", [("Geb.-Datum", "3. März 1980"), ("Geb.-Ort", "Limburg"), ("Geburtsname", "Beispiel")]),
    (None, []),
    ("", []),
]


def found(spark, texts, **more):
    rows = [(i, t) for i, t in enumerate(texts)]
    out = detect_patterns(spark.createDataFrame(rows, "i int, text string"), **more).collect()
    return {x.i: [(h.label, (x.text or "")[h.s : h.e], h.category) for h in x.found or []] for x in out}


def test_rules(spark):
    got = found(spark, [c[0] for c in CASES])
    for i, (text, want) in enumerate(CASES):
        assert [g[:2] for g in got[i]] == want, text


def test_switches(spark):
    text = "a@b.de Tel. 06433/123456 geb. 01.01.1970"
    assert found(spark, [text], enabled=["email"])[0] == [("E-Mail", "a@b.de", "email")]
    assert found(spark, [text], enabled=[])[0] == []
    assert {g[2] for g in found(spark, [text])[0]} == {"email", "telefon", "geburtsdatum"}


def test_iban_check_digits(spark):
    rows = spark.createDataFrame([("DE89370400440532013000",), ("DE89370400440532013001",), ("GB29NWBK60161331926819",), ("XX",)], "c string")
    assert [r[0] for r in rows.select(iban_valid(F.col("c"))).collect()] == [True, False, True, False]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Ihre Nachbarin Frau Gül Yilmaz kann dies bezeugen.", ["Gül Yilmaz"]),
        ("Herrn\nRobin Kinzel\nMusterweg 15", ["Robin Kinzel"]),
        ("dass Herr Schneider Zahlungen verweigert", ["Schneider"]),
        ("Herr Dr. Hans-Peter von der Heide sagte", ["Hans-Peter von der Heide"]),
        ("Sehr geehrte Frau Vorsitzende,", []),
        ("Sehr geehrte Damen und Herren,", []),
        ("Die Frauen und Herrlichkeiten", []),
        (None, []),
    ],
)
def test_salutations(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(salutation_names(F.col("t")).alias("x"), professional(F.lit("Rechtsanwalt ")).alias("p")).first()
    assert [x.name for x in got.x or []] == want and got.p
    assert all(text[x.s : x.e].rstrip(".,;:").endswith(x.name.split()[-1]) for x in got.x or [])
