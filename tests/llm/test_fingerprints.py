import hashlib
import random

import numpy as np
import pyarrow as pa

from tintwerk.llm import fingerprints as fp


def digests(text):
    keys, at = fp._all_pieces(pa.array([text], pa.large_string()))
    return set(keys.tolist())


def test_peeling_recovers_differences_of_any_size():
    r = np.random.default_rng(1)
    rows_a, rows_b = [], []
    for n in (0, 1, 5, 50, 3000):
        common = r.integers(1, 1 << 48, n).tolist()
        rows_a.append(sorted(set(common + r.integers(1, 1 << 48, n).tolist())))
        rows_b.append(sorted(set(common + r.integers(1, 1 << 48, 2 * n).tolist())))
    flat = lambda rows: (np.array(sum(rows, []), np.uint64), np.cumsum([0, *map(len, rows)]))
    at = np.arange(len(rows_a))
    a, b, tries = fp.differences(flat(rows_a), flat(rows_b), at, at)
    assert a.tolist() == [len(set(x) - set(y)) for x, y in zip(rows_a, rows_b, strict=True)]
    assert b.tolist() == [len(set(y) - set(x)) for x, y in zip(rows_a, rows_b, strict=True)]
    assert tries[0] == 0 and tries[-1] >= 1


def test_contract_against_brute_force(spark):
    r = random.Random(5)
    pool = ["Ein Satz über Öl. ", "😀 kurz!\n", "Noch ein Absatz ohne Ende\n", "x" * 400, "A. B. C. "]
    rows = [(i * 3, "".join(r.choice(pool) for _ in range(r.randrange(9)))) for i in range(90)] + [(1000, None), (1001, ""), (1002, rows_text := "Ein Satz. " * 2000)]
    got = {x.doc_id: x for x in fp.fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), rows_per_range=10).collect()}
    assert len(got) == len(rows)
    texts = [(d, t or "") for d, t in rows]
    for k, (d, t) in enumerate(texts):
        after = texts[(k + 1) % len(texts)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        x = got[d]
        assert x.n_chars == len(t) and x.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for near, other in ((x.near_edited, edited), (x.near_next, after)):
            a, b = digests(t), digests(other)
            assert abs(near - (len(a & b) / len(a | b) if a | b else 1.0)) < 1e-12
    same = {}
    for d, t in texts:
        same.setdefault(t, set()).add(got[d].fingerprint)
    assert all(len(v) == 1 for v in same.values()) and len({min(v) for v in same.values()}) == len({frozenset(digests(t)) for t in same})


def test_edges(spark):
    schema = "doc_id long, text string, near_next int, range string"
    assert fp.fingerprint_edits(spark.createDataFrame([], schema)).count() == 0
    one = fp.fingerprint_edits(spark.createDataFrame([(5, "ab", None, None)], schema)).collect()
    assert [(x.doc_id, x.near_next) for x in one] == [(5, 1.0)]
    some = fp.fingerprint_edits(spark.createDataFrame([(None, None, 1, "a"), (5, "a", 1, "a"), (5, "a", 2, "b"), (5, "b", 2, "b")], schema)).collect()
    assert len(some) == 4
