import pytest
from pyspark.sql import functions as F

from tintwerk import schemas
from tintwerk.operators import findings as fd
from tintwerk.operators import groups, words
from tintwerk.plans import analysis


def make_pages(spark, docs, case="c"):
    rows = [(case, d, d, n, text) for d, pages in enumerate(docs) for n, text in enumerate(pages)]
    raw = spark.createDataFrame(rows, "case_id string, doc_id long, doc_seq int, page_no int, t string")
    return raw.select("case_id", "doc_id", "doc_seq", "page_no", F.lit(595.0).alias("width"), F.lit(842.0).alias("height"), F.lit("text").alias("source"), words.page_words(F.col("t")).alias("words"), F.array().cast(f"array<{schemas.RECT}>").alias("unread"))


def make_inputs(spark, client="", client_address="", opponent="", opponent_address="", custom=(), closed=False):
    return spark.createDataFrame([("c", client, client_address, opponent, opponent_address, [tuple(c) for c in custom], closed)], schemas.INPUTS)


def make_findings(spark, *rows):
    return spark.createDataFrame([("c", 0, 0, n, *r, *[False, ""][len(r) - 3 :]) for n, r in enumerate(rows)], schemas.FINDINGS)


def run(spark, docs, inputs=None, settings=analysis.Settings(), **more):
    out = analysis.analyze(make_pages(spark, docs), inputs if inputs is not None else make_inputs(spark), settings, **more)
    return out, {(h.label, h.text) for h in out.hits.collect()}


def test_names_without_a_model(spark):
    text = "Sehr geehrter Herr Kinzel,\nIhre Nachbarin Frau Gül Yilmaz und Herr Jens Beispiel.\nFrau Yilmaz bestätigte."
    _, hits = run(spark, [[text]], make_inputs(spark, "Robin Kinzel"))
    assert hits == {("Mandant", "Kinzel"), ("G.Y.", "Gül Yilmaz"), ("J.B.", "Jens Beispiel"), ("G.Y.", "Yilmaz")}
    _, hits = run(spark, [["Rechtsanwalt Hans Meier vertritt Herrn Jens Beispiel."]], settings=analysis.Settings(exclude_professionals=True))
    assert {t for _, t in hits} == {"Jens Beispiel"}


def test_inputs(spark):
    letter = "Robin Kinzel, Musterweg 15\n12345 Musterstadt\nSehr geehrter Herr R. Kinzel und Kinzel"
    _, hits = run(spark, [[letter]], make_inputs(spark, "Robin Kinzel", "Musterweg 15, 12345 Musterstadt"))
    assert {("Mandant", "Robin Kinzel"), ("Mandant", "R. Kinzel"), ("Mandant", "Kinzel"), ("Adresse Mandant", "Musterweg 15"), ("Adresse Mandant", "12345 Musterstadt")} <= hits
    _, hits = run(spark, [["Anna Schmidt arbeitet bei Volkswagen in Wolfsburg"]], make_inputs(spark, opponent="Anna Schmidt", custom=[("Volkswagen", "Arbeitgeber"), ("Wolfsburg", "")]))
    assert hits == {("Gegner", "Anna Schmidt"), ("Arbeitgeber", "Volkswagen"), ("geschwärzt", "Wolfsburg")}
    _, hits = run(spark, [["Die Familie Kinzel kam"]], make_inputs(spark, "Robin Kinzel", opponent="Sonja Kinzel"))
    assert hits == {("Mandant/Gegner", "Kinzel")}
    _, hits = run(spark, [["Die Deutsche Bank schrieb. Deutsche Post."]], make_inputs(spark, opponent="Deutsche Bank"))
    assert hits == {("Gegner", "Deutsche Bank")}


def test_opposing_organisation_stays_readable(spark):
    text = "Muster Wohnbau GmbH, Amtsweg 3, 12345 Musterstadt\nSehr geehrter Herr Robin Kinzel,\nIhre Sachbearbeiterin Frau Petra Schulze. Die Muster Wohnbau GmbH lehnt ab."
    found = make_findings(spark, ("Muster Wohnbau GmbH", "sonstiges", "Gegner"), ("Muster Wohnbau", "name", "Gegner"), ("Amtsweg 3", "adresse", "Gegner"), ("Petra Schulze", "name", "Gegner"))
    own = make_inputs(spark, "Robin Kinzel", "", "Muster Wohnbau GmbH", "Amtsweg 3, 12345 Musterstadt", closed=True)
    out, hits = run(spark, [[text]], own, findings=found)
    assert hits == {("Mandant", "Robin Kinzel"), ("P.S.", "Petra Schulze")}
    assert out.report.first().skipped_organisation == 3
    _, hits = run(spark, [[text]], make_inputs(spark, "Robin Kinzel", "", "Muster Wohnbau GmbH", "Amtsweg 3, 12345 Musterstadt"))
    assert ("Gegner", "Muster Wohnbau GmbH") in hits and ("Adresse Gegner", "Amtsweg 3") in hits


def test_findings(spark):
    docs = [["Frau Erika Mustermann, geb. 05.05.1960, und Peter Lustig am 01.02.2023", "Mustermann kam. Peter Lustig auch."]]
    found = make_findings(spark, ("Peter Lustig", "name", "Peter Lustig", True, "nur dienstlich"), ("Klaus Erfunden", "name", "Klaus Erfunden"), ("01.02.2023", "geburtsdatum", "Peter Lustig"), ("01.02.2023", "sonstiges", ""))
    out, hits = run(spark, docs, findings=found)
    assert {("P.L.", "Peter Lustig"), ("E.M.", "Erika Mustermann"), ("E.M.", "Mustermann"), ("Geb.-Datum", "05.05.1960")} == hits
    rows = out.hits.where("label = 'P.L.'").collect()
    assert {(r.page_no, r.priority, r.question) for r in rows} == {(0, 30, "nur dienstlich"), (1, 50, "nur dienstlich")}
    assert "K.E." not in {p.label for p in out.persons.collect()}
    _, hits = run(spark, [["Robin Kinzel und Anna Schmidt in der Hauptstr. 3"]], make_inputs(spark, "Robin Kinzel", "Musterweg 15"), findings=make_findings(spark, ("Anna Schmidt", "name", "Mandant"), ("Hauptstr. 3", "adresse", "Mandant")))
    assert hits == {("Mandant", "Robin Kinzel"), ("A.S.", "Anna Schmidt"), ("Adresse", "Hauptstr. 3")}


def docs_ab():
    return [["Herr Robin Kinzel und Frau Erika Mustermann.\nMustermann sagte zu.", "Kinzel widersprach. Tel. 06433/123456"], ["Frau Mustermann erschien nicht. Tel. 06433/123456"]]


def test_groups_and_decisions_span_documents(spark):
    out, _ = run(spark, docs_ab(), make_inputs(spark, "Robin Kinzel"))
    hits = out.hits.cache()
    assert {"name|Mandant", "name|E.M."} <= {h.grp for h in hits.collect()}
    phone = hits.where("category = 'telefon'").first().grp
    assert {h.doc_id for h in groups.members(hits, phone).collect()} == {0, 1}
    log = spark.createDataFrame([("c", "name|E.M.", None, None, None, True, 1), ("c", "name|E.M.", None, None, None, False, 2)], "case_id string, grp string, doc_id long, page_no int, seq int, enabled boolean, at int")
    decided = groups.apply_decisions(hits, log).collect()
    assert sum(not h.enabled for h in decided) == 3 and {h.label for h in decided if not h.enabled} == {"E.M."}
    asked = hits.withColumn("question", F.when((F.col("label") == "E.M.") & (F.col("page_no") == 0) & (F.col("doc_id") == 1), "Dienstlich?").otherwise(""))
    assert {h.question for h in groups.assign_groups(asked.drop("grp")).collect() if h.label == "E.M."} == {"Dienstlich?"}
    renamed = groups.rename_label(hits, "E.M.", "Zeugin")
    assert "E.M." not in {h.label for h in renamed.collect()}


def test_manual_hits_survive(spark):
    manual = spark.createDataFrame(
        [("c", 0, 0, 0, 0, [], "(manueller Bereich)", "geschwärzt", "manuell", 0, [(10.0, 10.0, 50.0, 20.0)], True, ""), ("c", 0, 0, 1, 0, [(0, None, None)], "Kinzel", "Zeuge", "benutzer", 0, [], True, ""), ("c", 0, 0, 1, 1, [(1, None, None)], "x", "alt", "name", 20, [], True, "")],
        schemas.HITS,
    )
    _, hits = run(spark, docs_ab(), make_inputs(spark, "Robin Kinzel"), manual=manual)
    assert {("(manueller Bereich)", "geschwärzt"), ("Kinzel", "Zeuge")} <= {(t, lab) for lab, t in hits} and "alt" not in {lab for lab, _ in hits}


@pytest.mark.parametrize(
    ("reply", "want"),
    [
        ('{"funde": []}', []),
        ('<think>hmm</think>\n```json\n{"funde": [{"text": "A"}]}\n```', ["A"]),
        ('Hier: {"funde": [{"text": "B", "kategorie": "name"}]} fertig', ["B"]),
        ('{"funde": [{"text": "Erika", "kategorie": "name", "bezug": ""}, {"text": "Mus', ["Erika"]),
        ("nichts", None),
        (None, None),
    ],
)
def test_replies(spark, reply, want):
    got = spark.createDataFrame([(reply,)], "r string").select(fd.parse_reply(F.col("r")).alias("x")).first().x
    assert (None if got is None else [f.text for f in got]) == want


def test_cleaning(spark):
    raw = [
        ("Zeugin Dr. Petra  Muster", "Name", "x", "ja", "h" * 200),
        ("Herr", "name", "", "false", ""),
        ("12 Müller", "name", "", "false", ""),
        ("amtsgericht", "name", "", "false", ""),
        ("Amtsgericht Limburg", "name", "", "false", ""),
        ("ABC-77", "quatsch", "", "false", ""),
        ("Limburg", "geburtsort", " a  b ", "false", "unwichtig"),
        ("x", "name", "", None, None),
        (None, None, None, None, None),
    ]
    rows = fd.clean_findings(spark.createDataFrame(raw, "text string, kategorie string, bezug string, unsicher string, hinweis string")).collect()
    assert {(r.text, r.kategorie, r.bezug, r.unsicher, r.hinweis) for r in rows} == {("Petra Muster", "name", "x", True, "h" * 120), ("ABC-77", "sonstiges", "", True, "Kategorie unklar"), ("Limburg", "geburtsort", "a b", False, "")}


def test_a_detector_is_asked_piece_by_piece(spark):
    def strict(told, piece):
        raise fd.Refused("HTTP 400")

    def plain(told, piece):
        if "kaputt" in piece:
            raise OSError("weg")
        if "stumm" in piece:
            return "nichts"
        names = [w for w in piece.split() if w[:1].isupper()]
        return '{"funde": [' + ", ".join(f'{{"text": "{n}", "kategorie": "name", "bezug": "{told}"}}' for n in names) + "]}"

    pages = spark.createDataFrame([("c", 1, 0, "Anna\nund Bernd\nund Anna"), ("c", 1, 1, "kaputt"), ("c", 2, 0, "stumm"), ("d", 3, 0, " x "), ("d", 3, 1, "Clara")], "case_id string, doc_id long, page_no int, text string")
    context = spark.createDataFrame([("c", "wer")], "case_id string, told string")
    found, failed = fd.read_findings(pages, [strict, plain], context, limit=12)
    assert sorted((f.case_id, f.doc_id, f.page_no, f.seq, f.text, f.bezug) for f in found.collect()) == [("c", 1, 0, 0, "Anna", "wer"), ("c", 1, 0, 100_000, "Bernd", "wer"), ("d", 3, 1, 0, "Clara", "")]
    assert sorted((f.doc_id, f.page_no, f.error) for f in failed.collect()) == [(1, 1, "OSError: weg"), (2, 0, "the reply holds no findings")]
    only, failed = fd.read_findings(pages, [strict], context)
    assert only.count() == 0 and {f.error for f in failed.collect()} == {"HTTP 400"}
