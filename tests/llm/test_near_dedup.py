import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tintwerk.llm import _bytes as by
from tintwerk.llm import near_dedup
from tintwerk.llm.components import connected_components, joined

LOWER = {c: c + 32 for c in range(65, 91)}


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute_force(rows, least):
    sets = [(d, shingle_set(t)) for d, t in rows]
    of = {i: i for i in range(len(sets))}

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= least * len(a | b):
                of[root(i)] = root(j)
    groups = {}
    for i, (d, _) in enumerate(sets):
        groups.setdefault(root(i), []).append(d)
    return {(d, len(s), min(groups[root(i)])) for i, (d, s) in enumerate(sets)}


def corpus(seed, n=160):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(300)]
    texts = []
    for _ in range(n // 8):
        base = [r.choice(words) for _ in range(r.choice([3, 6, 40, 150, 400]))]
        for _ in range(8):
            copy = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
                copy[r.randrange(len(copy))] = r.choice(words)
            texts.append(r.choice([" ", "\n"]).join(copy))
    r.shuffle(texts)
    return list(enumerate(texts + [None, "", " \n", "Ein  Wort", "ein wort", "e f"]))


@pytest.mark.parametrize(("leaf", "block", "most"), [(128, 512, 16 << 20), (4, 3, 16 << 20), (3, 2, 4000)])
def test_components_equal_brute_force(spark, leaf, block, most):
    rows = corpus(3)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 85, leaf, block, most).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == brute_force(rows, 85)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got) and len(got) == len(rows)


def test_shingles():
    texts = [t for _, t in corpus(9)]
    data, offsets = by.texts(pa.array(texts, pa.string()))
    keys, at = by.shingles(data, offsets)
    assert np.diff(at).tolist() == [len(shingle_set(t)) for t in texts]
    for i in range(0, len(texts), 7):
        for j in range(0, len(texts), 5):
            both = np.intersect1d(keys[at[i] : at[i + 1]], keys[at[j] : at[j + 1]])
            assert len(both) == len(shingle_set(texts[i]) & shingle_set(texts[j]))


def test_leaves():
    r = random.Random(4)
    for _ in range(200):
        n = r.randrange(1, 40)
        prefix, size = np.array([r.randrange(5, 9) for _ in range(n)]), np.array([r.randrange(1, 9) for _ in range(n)])
        got = near_dedup.leaves(prefix, size, 5, 20)
        assert [x for a, b in got for x in range(a, b)] == list(range(n))
        assert all(b - a == 1 or b - a <= 5 and size[a:b].sum() <= 20 for a, b in got)


def test_long_and_crowded_texts(spark):
    """Long texts in a crowd of copies, over the bound of a unit's bytes."""
    r = random.Random(12)
    base = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(60_000)]
    texts = []
    for k in range(6):
        own = list(base)
        own[1000 * k] = "anders"
        texts.append(" ".join(own))
    texts += [" ".join(reversed(base)), "kurz"]
    got = near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 85, most=500_000).collect()
    assert {(x.doc_id, x.component_id) for x in got} == {(d, 0 if d < 6 else d) for d in range(8)}


def test_edges(spark):
    schema = "doc_id long, text string, component string, unit int"
    got = near_dedup.near_duplicates(spark.createDataFrame([(None, "a b c d e f", "x", 1), (4, "a b c d e f", None, None), (4, "a b c d e f", None, None), (None, None, None, 2), (9, None, None, 3)], schema)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=str) == sorted([(None, 2, 4, False), (4, 2, 4, True), (4, 2, 4, True), (None, 0, None, True), (9, 0, 9, True)], key=str)
    assert near_dedup.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    several = [(1, "a b c d e f g"), (1, "x y z u v w"), (1, None), (2, "A b c d e f g"), (3, "x y z u v w"), (4, "q r s t")]
    got = near_dedup.near_duplicates(spark.createDataFrame(several, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == [(1, 0, 1), (1, 2, 1), (1, 3, 1), (2, 3, 1), (3, 2, 1), (4, 1, 4)]
    kept = near_dedup.deduplicated(spark.createDataFrame([(1, "a b c d e", "x", 1), (1, "a b c d e", "x", 1), (2, "A b c d e", "y", 2), (3, "z", "y", 2)], schema))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3] and kept.columns == ["doc_id", "text", "component", "unit"]


def crowd(seed, n, shared, own, last=3):
    """Forms alike in ``shared`` of their words; each has one partner, with a word within and the ``last`` ones changed."""
    r = random.Random(seed)
    new = lambda k: ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(k)]
    head, texts = new(shared), []
    for _ in range(n):
        form = head + new(own)
        texts += [" ".join(form), " ".join(form[: -last - 5] + new(1) + form[-last - 4 : -last] + new(last))]
    r.shuffle(texts)
    return texts


def test_partners_meet_in_a_crowd(spark):
    rows = list(enumerate(crowd(5, 40, 100, 12) + [t for _, t in corpus(3)]))
    want = brute_force(rows, 85)
    assert len({c for d, _, c in want if d < 80}) == 40
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 85, leaf=4, block=3).collect()
    apart = {(r.doc_id, r.n_shingles, r.component_id) for r in got} ^ want
    assert not apart, len(apart)


def test_depth_is_the_same_in_crowds(spark):
    """Pairs of low similarity, which the forest finds by chance: a crowded region must give the same ones."""
    texts = crowd(7, 100, 100, 30, last=17)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole, parts = ({(x.doc_id, x.component_id) for x in near_dedup.near_duplicates(docs, 68, leaf=m, block=m).collect()} for m in (4096, 4))
    assert 100 <= len({c for _, c in whole}) < 110
    assert whole == parts, len(whole ^ parts)


def test_components_by_stars_and_in_one_task(spark):
    r = random.Random(3)
    edges = [(r.randrange(-50, 400), r.randrange(-50, 400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(1, 40)] + [(7, 7)]
    of = {}
    for a, b in edges:
        of.setdefault(a, {a}), of.setdefault(b, {b})
        both = of[a] | of[b]
        for x in both:
            of[x] = both
    want = {n: min(c) for n, c in of.items() if len(c) > 1}
    table = spark.createDataFrame(edges, "a long, b long").repartition(3)
    for most in (0, 1 << 20):
        got = connected_components(table, one_task=most).collect()
        assert {x.node: x.component for x in got} == want and len(got) == len(want)
    assert connected_components(table.limit(0)).count() == 0
    chain = np.arange(100_000)
    assert (joined(chain[:-1], chain[1:])[1] == 0).all()
