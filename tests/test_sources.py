import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tests.test_analysis import docs_ab, make_inputs, make_pages
from tintwerk import schemas
from tintwerk.operators import export, words
from tintwerk.plans import analysis, edits
from tintwerk.sources import files, session


@pytest.fixture(scope="module")
def case(spark):
    pages = make_pages(spark, docs_ab()).cache()
    inputs = make_inputs(spark, "Robin Kinzel", custom=[("Köln", "Ort")])
    out = analysis.analyze(pages, inputs)
    return pages, inputs, out.hits.cache(), out.persons.cache()


def test_session_comes_back(spark, case, tmp_path):
    pages, inputs, hits, persons = case
    hits = hits.withColumn("enabled", F.col("seq") != 0).withColumn("question", F.when(F.col("seq") == 0, "Berufsträger?").otherwise(""))
    docs = spark.createDataFrame([("c", 0, "a.pdf", True, 2, {"0": [[1.0, 2.0, 3.0, 4.0]]}), ("c", 1, "b.pdf", True, 1, {})], "case_id string, doc_id long, path string, analyzed boolean, pages int, unread map<string,array<array<double>>>")
    session.write_sessions(session.to_session(docs, hits, inputs, persons), str(tmp_path / "s"))
    back = session.load_sessions(spark, str(tmp_path / "s")).withColumn("case_id", F.lit("c")).cache()
    assert [tuple(r) for r in session.session_inputs(back).collect()] == [tuple(r) for r in inputs.collect()]
    assert [r.path for r in session.session_paths(back).orderBy("doc_seq").collect()] == ["a.pdf", "b.pdf"]
    assert [(p.label, p.kind) for p in session.session_persons(back).orderBy("person_seq").collect()] == [("Mandant", "mandant"), ("E.M.", "person")]
    again, counts = session.reanchor(back, pages, docs)
    key = lambda rows: sorted((r.doc_id, r.page_no, r.text, r.label, r.enabled, r.question) for r in rows)
    assert key(again.collect()) == key(hits.collect()) and all(c.dropped == 0 for c in counts.collect())
    moved = make_pages(spark, [["Betreff: Akte\n" + docs_ab()[0][0], "leer"], docs_ab()[1]])
    again, counts = session.reanchor(back, moved, docs)
    found = again.where("doc_id = 0").collect()
    assert {"Robin Kinzel", "Erika Mustermann", "Mustermann"} == {r.text for r in found} and {c.path: c.dropped for c in counts.collect()} == {"a.pdf": 2, "b.pdf": 0}
    with pytest.raises(Exception, match="not a session"):
        session.read_sessions(spark.createDataFrame([("x", '{"format": 7}')], "case_id string, value string")).collect()


def test_known_persons_go_on(spark, case):
    known = spark.createDataFrame([("c", 1, "Zeugin", "person", ["Erika Mustermann"], True)], "case_id string, person_seq int, label string, kind string, names array<string>, fixed boolean")
    out = analysis.analyze(case[0], make_inputs(spark), known=known)
    assert {h.label for h in out.hits.where("text LIKE '%Mustermann'").collect()} == {"Zeugin"}


def test_term_after_the_analysis(spark, case):
    pages, _, hits, _ = case
    merged, new = edits.apply_user_term(pages, hits, "Frau", "Anrede")
    rows = [r for r in merged.collect() if r.text == "Frau"]
    assert {(r.doc_id, r.label, r.priority) for r in rows} == {(0, "Anrede", 5), (1, "Anrede", 5)} and len({r.grp for r in rows}) == 1 and new.count() == 2
    merged, _ = edits.apply_user_term(pages, hits, "Robin Kinzel", "Kläger")
    assert {(r.text, r.label) for r in merged.collect() if "Robin" in r.text} == {("Robin Kinzel", "Kläger")}
    assert edits.apply_user_term(pages, hits, " ", "x")[1].count() == 0
    each = words.exploded(pages)
    assert {(r.doc_id, r.term) for r in edits.term_in_rect(each, 75, 40, 160, 62).where("page_no = 0").collect()} == {(0, "Robin Kinzel"), (1, "Mustermann")}
    drawn = edits.drawn_hit({"case_id": "c", "doc_id": 1, "doc_seq": 1, "page_no": 0}, (0.0, 0.0, 5.0, 5.0), "geschwärzt", spark)
    both = edits.merge_hits(pages, hits, drawn).where("doc_id = 1").collect()
    assert {r.text for r in both} >= {"(manueller Bereich)", "Mustermann"}
    one = next(r for r in both if r.text == "(manueller Bereich)")
    assert edits.without_manual(edits.merge_hits(pages, hits, drawn), 1, 0, one.seq).where("category = 'manuell'").count() == 0


def test_settings():
    s = session.StoredSettings.loads('{"fuzzy_matching": false, "neu": 1, "categories": {"iban": false}}')
    assert not s.fuzzy_matching and not s.category_on("iban") and s.category_on("name")
    assert session.StoredSettings.loads(s.dumps()) == s and session.StoredSettings.loads("{") == session.StoredSettings()


def test_files(spark, tmp_path):
    body = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>Klage</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", body)
    (tmp_path / "x.DOCX").write_bytes(data.getvalue())
    (tmp_path / "kaputt.docx").write_bytes(b"nichts")
    (tmp_path / "y.pdf").write_bytes(b"%PDF")
    (tmp_path / "z.exe").write_bytes(b"MZ")
    found = files.folder(spark, str(tmp_path))
    got = {r.path.rsplit("/", 1)[-1]: (r.text, r.error) for r in files.load_texts(found).collect()}
    assert got.keys() == {"x.DOCX", "kaputt.docx", "y.pdf"} and got["x.DOCX"] == ("Klage\na | b", None)
    assert got["kaputt.docx"][0] is None and "no reader" in got["y.pdf"][1]
    known = found.where("path LIKE '%pdf'").select("path")
    assert files.new_files(found.unionByName(found), known).count() == 2


def test_no_secret_survives_the_export(spark, case):
    pages, _, hits, _ = case
    text = pages.select("doc_id", "page_no", words.page_text(F.col("words")).alias("text"), words.word_spans(F.col("words")).alias("spans"))
    marks = hits.join(text, ["doc_id", "page_no"]).select("doc_id", "page_no", F.explode("segments").alias("g"), "spans", "label", "enabled", hits.text)
    span = F.col("spans")[F.col("g.word")]
    marks = marks.select("doc_id", "page_no", (span["s"] + F.coalesce("g.c0", F.lit(0))).alias("s"), F.when(F.col("g.c1").isNull(), span["e"]).otherwise(span["s"] + F.col("g.c1")).alias("e"), "label", "enabled", "text")
    redacted = export.redact_pages(text.drop("spans"), marks).cache()
    shown = " ".join(r.redacted for r in redacted.collect())
    assert not any(s in shown for s in ("Kinzel", "Mustermann", "Erika", "06433"))
    assert export.leaks(hits, redacted).count() == 0
    kept = hits.withColumn("text", F.lit("widersprach"))
    assert {(r.doc_id, r.page_no) for r in export.leaks(kept, redacted).collect()} == {(0, 1)}
    with pytest.raises(ValueError):
        export.guard_overwrite("/a/x.pdf", "/a/x.pdf")


def test_overlaps(spark):
    page = spark.createDataFrame([("c", 0, 0, 0, "Hans Meier, Wetzlar")], "case_id string, doc_id long, doc_seq int, page_no int, t string").select("case_id", "doc_id", "doc_seq", "page_no", F.lit(595.0).alias("width"), F.lit(842.0).alias("height"), words.page_words(F.col("t")).alias("words"))
    row = lambda nth, segments, text, label, priority, question="": ("c", 0, 0, 0, 0, nth, segments, text, label, "name", priority, [], True, question)
    hits = spark.createDataFrame([row(0, [(1, 0, 5)], "Meier", "A", 30, "fraglich"), row(1, [(0, None, None), (1, 0, 5)], "Hans Meier", "A", 40), row(2, [(1, None, None)], "Meier,", "B", 50), row(3, [(1, 2, None), (2, None, None)], "ier, Wetzlar", "C", 20)], f"case_id string, doc_id long, doc_seq int, page_no int, stage int, nth int, {schemas.HIT}")
    out = analysis.resolve_pages(page, hits).orderBy("seq").collect()
    assert [(h.text, h.label, h.priority, h.question) for h in out] == [("Hans Me", "A", 30, "fraglich"), ("ier, Wetzlar", "C", 20, "")]
    assert all(h.rects for h in out)
