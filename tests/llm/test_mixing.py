import math
import random
from collections import Counter
from functools import cache

import numpy as np
import pytest

from tintwerk.llm import _bytes as by
from tintwerk.llm import mixing

WORDS = {"de": "der die das und ist".split(), "en": "the and of is to".split(), "fr": "le la les et de".split()}


def corpus(seed=4, n=240):
    r = random.Random(seed)
    rows = []
    for d in range(n):
        lang = r.choice(["en", "en", "en", "de", "fr"])
        mixed = WORDS[lang] + (r.choice(list(WORDS.values())) if d % 4 == 0 else [])
        rows.append((d, " ".join(r.choice(mixed) for _ in range(r.randrange(0, 60))) if d else None, lang if d % 3 else None))
    return rows


def test_rates_meet_the_targets_and_are_nearest_to_one(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, domain string")
    domains = mixing.train(docs, docs)
    assert domains.names == ["de", "en", "fr"]
    out, report = mixing.mix(docs, domains, {"de": 0.4, "en": 0.4, "fr": 0.2})
    rows = out.collect()
    assert len(rows) == 240 and all(x.rate >= 0 and abs(sum(x.posterior) - 1) < 1e-9 for x in rows)
    t = np.array([x.n_tokens for x in rows], float)
    p = np.array([x.posterior for x in rows])
    rate = np.array([x.rate for x in rows])
    target = np.array([report[n][0] for n in domains.names])
    assert abs(target - t.sum() * np.array([0.4, 0.4, 0.2])).max() < 1e-6
    assert abs((rate * t) @ p - target).sum() < 1e-3 * t.sum()
    if rate.min() > 1e-9:  # then the rates are the weighted least change from 1
        nu = np.linalg.solve((p * t[:, None]).T @ p, target - t @ p)
        assert abs(rate - 1 - p @ nu).max() < 1e-2


def test_projection_keeps_rates_from_falling_below_zero(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, domain string")
    out, report = mixing.mix(docs, mixing.train(docs, docs), {"de": 1.0})
    rates = [x.rate for x in out.collect()]
    assert min(rates) == 0.0 and max(rates) > 1.5
    t, p, target = as_arrays(mixing.memberships(docs, mixing.train(docs, docs)).collect(), report)
    assert np.allclose(nearest(t, p, target, 0.0), [report[n][1] for n in sorted(report)], rtol=0.01, atol=0.005 * t.sum())


def as_arrays(rows, report):
    return np.array([x.n_tokens for x in rows], float), np.array([x.posterior for x in rows]), np.array([report[n][0] for n in sorted(report)])


def nearest(t, p, target, floor):
    """Plain projected gradient, very many small steps: the tokens nearest to the target."""
    m = (p * t[:, None]).T @ p
    inverse, r = np.linalg.pinv(m, rcond=1e-9, hermitian=True), np.ones(len(t))
    for _ in range(20_000):
        r = np.maximum(floor, r - 0.5 * p @ (inverse @ ((r * t) @ p - target)))
    return (r * t) @ p


@pytest.mark.parametrize(("weights", "total", "floor"), [({"de": 0.5, "en": 0.25, "fr": 0.25}, float("inf"), 1.0), ({"de": 1.0}, None, 0.0), ({"de": 0.05, "fr": 0.9, "en": 0.05}, None, 0.2), ({"de": 1, "fr": 1}, None, 1.0)])
def test_fit_is_the_nearest_there_is(spark, weights, total, floor):
    docs = spark.createDataFrame(corpus(9), "doc_id long, text string, domain string")
    domains = mixing.train(docs, docs)
    members = mixing.memberships(docs, domains).cache()
    _, report = mixing.mix(docs, domains, weights, total, floor)
    t, p, target = as_arrays(members.collect(), report)
    assert np.allclose(nearest(t, p, target, floor), [report[n][1] for n in sorted(report)], rtol=0.01, atol=0.005 * t.sum())


def test_posteriors_equal_plain_naive_bayes(spark):
    rows = corpus(11) + [(900, "the " * 200_000 + "und", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, domain string")
    bucket = cache(lambda w: int(by.words(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[2][0] % by.U(mixing.BUCKETS)))
    seen, counts = Counter(d for _, _, d in rows if d), {d: Counter() for _, _, d in rows if d}
    for _, text, d in rows:
        if d:
            counts[d].update(bucket(w) for w in (text or "").split())
    got = {x.doc_id: x for x in mixing.memberships(docs, mixing.train(docs, docs)).collect()}
    for i, text, _ in rows:
        words = (text or "").split()
        logit = {}
        for d in sorted(counts):
            total = sum(counts[d].values()) + 0.5 * mixing.BUCKETS
            mean = sum(math.log((counts[d][bucket(w)] + 0.5) / total) for w in words) / max(1, len(words))
            logit[d] = math.log(seen[d] / sum(seen.values())) + mean * min(len(words), mixing.EVIDENCE)
        top = max(logit.values())
        whole = sum(math.exp(v - top) for v in logit.values())
        assert got[i].n_tokens == len(words)
        assert np.allclose(got[i].posterior, [math.exp(v - top) / whole for v in logit.values()], atol=1e-6)


def test_resampling_follows_the_rates_and_edges(spark):
    schema = "doc_id long, text string, domain string, rate string, posterior int"
    rows = [(*x, "r", None) for x in corpus()]
    docs = spark.createDataFrame(rows, schema)
    domains = mixing.train(docs, docs)
    more = mixing.resampled(docs, domains, {"de": 1, "en": 1, "fr": 1}, float("inf"), floor=1.0)
    assert more.columns == docs.columns and {x.doc_id for x in more.collect()} >= {x[0] for x in rows}
    none = spark.createDataFrame([], schema)
    assert mixing.train(none, none).names == ["all"] and mixing.resampled(none, mixing.train(none, none), {"de": 1}).count() == 0
    assert mixing.mix(none, domains, {"de": 1})[0].count() == 0
    odd = spark.createDataFrame([(None, None, None, None, 1), (None, "der die", "de", None, 1), (3, "", None, None, None)], schema)
    assert {x.rate for x in mixing.mix(odd, mixing.train(odd, odd), {"de": 1})[0].collect()} == {1.0}
