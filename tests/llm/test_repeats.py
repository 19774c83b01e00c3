import hashlib
import random

import numpy as np
import pytest

from tintwerk.llm import queries, repeats


def brute_force(rows, window):
    texts = [(t or "").encode() for _, t in rows]
    seen = {}
    for i, t in enumerate(texts):
        for p in range(len(t) - window + 1):
            seen.setdefault(t[p : p + window], []).append((i, p))
    gone = [bytearray(len(t)) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for i, p in places:
                gone[i][p : p + window] = b"\1" * window
    out = []
    for (d, _), t, g in zip(rows, texts, gone, strict=True):
        spans = sum(1 for i, x in enumerate(g) if x and (not i or not g[i - 1]))
        out.append((d, len(t), sum(g), spans, hashlib.sha256(bytes(c for c, x in zip(t, g, strict=True) if not x)).hexdigest()))
    return sorted(out, key=str)


def test_statistics_equal_brute_force():
    r = random.Random(3)
    for _ in range(150):
        anchor = "".join(r.choice("ab") for _ in range(4))
        parts = ["".join(r.choice("ab") for _ in range(r.randrange(0, 13))) for _ in range(4)]
        contexts = {}
        for _ in range(r.randrange(2, 14)):
            x, y = r.choice(parts)[-8:], r.choice(parts)[:8]
            x = x if r.random() < 0.5 else (r.choice("ab") + x)[-8:]
            contexts[r.randrange(2), x, y] = None
        rows = sorted((g, (x + anchor + y).encode(), len(x)) for g, x, y in contexts)
        rows = [c for c in rows if len(c[1]) - c[2] <= 12]
        left, right = repeats.marked(rows, 12, 4)
        for i, (g, a, at) in enumerate(rows):
            want = (0, 0)
            for j, (h, b, to) in enumerate(rows):
                if i != j and g == h:
                    n = next((n for n in range(min(at, to) + 1) if n == min(at, to) or a[at - n - 1] != b[to - n - 1]))
                    m = next((m for m in range(13) if m == min(len(a) - at, len(b) - to) or a[at + m] != b[to + m]))
                    if n + m >= 12:
                        want = max(want[0], n), max(want[1], m)
            assert (left[i], right[i]) == want


def corpus(seed):
    r = random.Random(seed)
    passages = ["".join(r.choice("abcdeé") for _ in range(r.randrange(18, 70))) for _ in range(8)]
    rows = []
    for d in range(90):
        parts = []
        for _ in range(r.randrange(0, 5)):
            parts.append(r.choice(passages) if r.random() < 0.6 else "".join(r.choice("abcdeé") for _ in range(r.randrange(1, 40))))
        text = "".join(parts)
        if text and r.random() < 0.3:
            at = r.randrange(len(text))
            text = text[:at] + "z" + text[at + 1 :]
        rows.append((d, text))
    return rows + [(500, None), (501, ""), (502, "ab" * 80), (503, "a" * 90), (504, rows[3][1]), (504, rows[3][1]), (None, passages[0] * 2)]


def test_runs_compress():
    """Contexts alike but for one byte give few runs, and the stream still tells each one's longest match."""
    r = random.Random(8)
    base = bytes(r.randrange(97, 123) for _ in range(672))
    contexts = [(0, base[:i] + b"#" + base[i + 1 :], 272) for i in range(0, 272, 2)]
    index = repeats.RunIndex(contexts, 400, 128)
    rows = sum(len(c) for _, c, _ in index.matching_statistics())
    assert rows > 10 * index.runs
    left, right = repeats.marked(contexts, 400, 128)
    assert (right == 400).all() and left.max() == 269


def test_long_texts_in_pieces():
    r = random.Random(6)
    text = bytes(r.choice(b"ab") for _ in range(900)) + bytes(r.choice(b"abcdef") for _ in range(3000))
    data, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    whole = repeats.anchors(data, offsets, 20, 6)
    for piece in (30, 64, 1000):
        parts = [np.concatenate(x) for x in zip(*repeats._in_pieces(data, offsets, 20, 6, piece), strict=True)]
        assert all((a == b).all() and len(a) == len(b) for a, b in zip(whole, parts, strict=True))


@pytest.mark.parametrize(("seed", "block", "hot", "piece"), [(1, 2 << 20, 4096, 4 << 20), (2, 2 << 20, 2, 4 << 20), (3, 300, 4096, 40)])
def test_marks_equal_brute_force(spark, seed, block, hot, piece, monkeypatch):
    monkeypatch.setattr(repeats.index_contexts, "__defaults__", (block,))
    monkeypatch.setattr(repeats.find_anchors, "__defaults__", (piece,))
    rows = corpus(seed)
    schema = "doc_id long, text string, spans int, anchor string"
    docs = spark.createDataFrame([(*x, None, "y") for x in rows], schema).repartition(6)
    got = repeats.remove_repeats(docs, 20, 6, hot).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    want = brute_force(rows, 20)
    assert sorted((tuple(x) for x in got), key=str) == want and sum(w[2] for w in want) > 500


def test_long_text(spark):
    """A text of several MB beside a short one that it holds."""
    r = random.Random(2)
    words = ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(40_000)]
    long = " ".join(r.choice(words) for _ in range(1_500_000))
    rows = [(1, long), (2, long[5_000_000:5_001_000]), (3, long[:399])]
    got = {x.doc_id: x for x in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].n_bytes, got[1].n_removed, got[1].n_spans) == (len(long), 1000, 1) and got[1].spans == [[5_000_000, 5_001_000]]
    assert got[2].n_removed == 1000 and got[3].n_removed == 0


def test_planted_passages(spark, tmp_path):
    """Passages of 55 words in several documents: those of 400 bytes or more go, shorter ones stay; ``n_bytes`` is the input's length."""
    r = random.Random(4)
    prose = lambda n, size: " ".join("".join(r.choice("abcdefghijklmnoprstuvwé") for _ in range(size)) for _ in range(n))
    long, short = [prose(55, 8) for _ in range(4)], [prose(55, 5) for _ in range(4)]
    rows = [(d, " ".join([prose(r.randrange(5, 200), 6), *([(long, short)[d % 3][d % 4]] if d % 3 < 2 else []), prose(r.randrange(5, 200), 6)])) for d in range(60)]
    assert all(len(p.encode()) >= 400 for p in long) and all(len(p.encode()) < 390 for p in short)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op2_run_index(spark, str(tmp_path)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted((tuple(x) for x in got), key=str) == brute_force(rows, 400)
    assert {x.doc_id for x in got if x.n_removed} == {d for d in range(60) if d % 3 == 0}
    assert all(x.n_bytes == len(rows[x.doc_id][1].encode()) for x in got)


def test_empty(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
