import random

import numpy as np
from pyspark.sql import functions as F

from tintwerk.llm import quality


def corpus(n=900, seed=6):
    r = random.Random(seed)
    words = ["".join(r.choice("aeinrstu") for _ in range(r.randrange(2, 8))) for _ in range(200)]
    docs, labels = [], []
    for d in range(n):
        good = r.random() < 0.7
        text = " ".join(r.choice(words) for _ in range(r.randrange(20, 120)))
        if not good:
            text = r.choice([text.upper() + "!!", text.replace(" ", " | "), text.replace(" ", "%%% "), "\n".join([text[:30]] * 20)])
        docs.append((d, text))
        labels.append((d, int(good), None))
    return docs, labels


def test_held_out_accuracy_and_filter(spark):
    docs, labels = corpus()
    d = spark.createDataFrame([(*x, "s", 0.5) for x in docs + [(5000, None), (5001, ""), (None, "ein Text")]], "doc_id long, text string, source string, score double")
    lab = spark.createDataFrame(labels + labels[:50] + [(None, 1, 0), (99999, 0, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(d, lab.where(~quality.held_out(F.col("doc_id"))))
    got = {r.doc_id: r.score for r in quality.score(d, model).collect()}
    assert len(got) == len(docs) + 3 and all(0 <= s <= 1 for s in got.values())
    held = {r.doc_id for r in lab.where(quality.held_out(F.col("doc_id"))).collect()}
    truth = {x[0]: x[1] for x in labels}
    right = [(got[i] >= 0.5) == (truth[i] == 1) for i in held if i in truth]
    assert len(right) > 100 and np.mean(right) > 0.97
    kept = quality.accepted(d, model)
    assert kept.columns == d.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, s in got.items() if s >= 0.3}


def test_scores_are_sums_of_table_entries():
    docs, labels = corpus(300)
    x = np.random.default_rng(0).normal(size=(300, 4))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    model = quality.fitted(x, y)
    assert ((model.scores(x) > 0.5) == (y > 0)).mean() > 0.9, "an interaction of two features needs their pair"
    row = x[:1]
    total = model.base + sum(t[np.searchsorted(e, row[0, k], "right")] for k, (e, t) in enumerate(zip(model.edges, model.tables, strict=True)))
    total += sum(t[np.searchsorted(ea, row[0, a], "right"), np.searchsorted(eb, row[0, b], "right")] for a, b, ea, eb, t in model.pairs)
    assert abs(model.logits(row)[0] - total) < 1e-12


def test_without_labels_and_empty(spark):
    d = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.score(d, quality.train(d, none)).collect()} == {0.5}
    ones = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    assert {round(r.score, 6) for r in quality.score(d, quality.train(d, ones)).collect()} == {0.75}
    assert quality.score(d.limit(0), quality.train(d, ones)).count() == 0
