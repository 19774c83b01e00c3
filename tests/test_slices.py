"""Arrow passes over pages in slices: bounded in memory, with the rows of one pass."""

import pyarrow as pa
from pyspark.sql import functions as F

from tintwerk.functions import tokens as tk
from tintwerk.operators import words


def test_words_in_slices(spark, monkeypatch):
    spans = F.arrow_udf  # the pass as Spark gets it
    lists = []

    def watched(f, kind):
        lists.append(f)
        return spans(f, kind)

    monkeypatch.setattr(words.F, "arrow_udf", watched)
    monkeypatch.setattr(words, "SLICE_BYTES", 64)
    words.page_words(F.lit("x"))
    texts = pa.array(["ab cd\nef", None, "", "x " * 50, "y"] * 20)
    parts = list(lists[-1](iter([texts])))
    assert len(parts) > 10 and sum(map(len, parts)) == len(texts)
    monkeypatch.setattr(words, "SLICE_BYTES", 1 << 30)
    (whole,) = lists[-1](iter([texts]))
    assert [x for p in parts for x in p.to_pylist()] == whole.to_pylist()


def test_phrases_found_as_by_trying_every_word():
    texts = "Herr K1nzel und Kinzels, Kin- zel Robin RobinKinzel Großmann GROSSMANN Grossmnan Vogt's vogt V0gt Müllers Mü ller a ab".split()
    lines = [i // 5 for i in range(len(texts))]
    scan = tk.PageScanner(texts, lines)
    for query in (["kinzel"], ["robin", "kinzel"], ["grossmann"], ["vogt"], ["müller"], ["ab"], ["fremd"], ["herr", "kinzel"]):
        for fuzzy in (False, True):
            for possessive in (False, True):
                for capital in (False, True):
                    out, i = [], 0
                    while i < len(texts):
                        upper = texts[i].lstrip(tk.enums.TOKEN_EDGE)[:1].isupper()
                        end = scan._match(i, query, fuzzy, possessive) if scan.norms[i] and (not capital or upper) else 0
                        if end:
                            out.append((i, end))
                        i = end or i + 1
                    assert scan.find(query, fuzzy, possessive, capital) == out
