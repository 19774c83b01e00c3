from tests.test_analysis import make_inputs, make_pages
from tintwerk.plans import analysis
from tintwerk.streaming.incremental import each_batch, stream_pattern_hits


def test_rules_on_a_stream(spark, tmp_path):
    spark.createDataFrame([(1, 0, "Mail a@b.de"), (2, 0, "nichts"), (3, 0, "Tel. 06433/123456")], "doc_id long, page_no int, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, page_no int, text string").parquet(str(tmp_path / "in"))
    q = stream_pattern_hits(stream).writeStream.format("memory").queryName("rule_hits").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.doc_id, r.value, r.label) for r in spark.table("rule_hits").collect()} == {(1, "a@b.de", "E-Mail"), (3, "06433/123456", "Telefon")}


def test_batches_know_the_persons_before(spark, tmp_path):
    def analyze(batch, known):
        out = analysis.analyze(batch, make_inputs(spark), known=known)
        return out.hits, out.persons

    step = each_batch(analyze, str(tmp_path / "hits"), str(tmp_path / "persons"))
    step(make_pages(spark, [["Frau Erika Mustermann kam."]]), 0)
    step(make_pages(spark, [["Frau Mustermann ging. Herr Emil Maier auch."]]), 1)
    hits = spark.read.parquet(str(tmp_path / "hits")).select("batch", "text", "label").collect()
    assert {(r.batch, r.text, r.label) for r in hits} == {(0, "Erika Mustermann", "E.M."), (1, "Mustermann", "E.M."), (1, "Emil Maier", "E.Ma.")}
