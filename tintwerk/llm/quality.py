"""Quality classifier: a generalised additive model with pairwise interactions.

Each text gives a few counts and shares (``FEATURES``), computed from its bytes in NumPy. Training runs on the driver over
a bounded, documented sample (``SAMPLE`` labelled rows, those of the least hashes of doc_id, so the choice doesn't depend on
order): every feature is cut into quantile bins, and boosting goes round the features in turn; each turn fits a tree of a
few leaves to the residuals of one feature's bins and adds it to that feature's lookup table. Then the pairs of features
whose residual grid explains most get tables of their own in the same way. A score is the logistic of the sum of the
table entries: scoring is a vectorised lookup and addition for each bin.

Defined cases: null and empty texts have all counts 0 and a score like any text; a row without a label isn't learnt from;
repeated rows of one document and label count once; without labels, or with labels of one kind, every score is
the smoothed share of label 1; a null doc_id is held out; extra columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tintwerk.llm import _bytes as by
from tintwerk.llm._work import written

SAMPLE = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE, LEAVES = 120, 40, 0.15, 3

FEATURES = [
    "log_bytes", "log_words", "bytes_per_word", "upper", "digits", "blank", "beyond_ascii",
    "commas_stops", "bars", "symbols", "bangs", "other_marks", "mark_ends",
    "distinct_words", "top_short", "log_lines", "bytes_per_line", "distinct_lines", "brackets", "word_spread",
]


def _table(chars: str) -> np.ndarray:
    t = np.zeros(256, bool)
    t[[ord(c) for c in chars]] = True
    return t


_UPPER, _DIGIT = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table("0123456789")
_KINDS = [_UPPER, _DIGIT, by._SPACE, np.arange(256) >= 128, _table(",."), _table("|"), _table("%$#*&~^@+=_\\"), _table("!?"), _table("'\"-:;/"), _table("<>[]{}()")]
_MARKS = _table("%$#*&!|")


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return sums[at[1:]] - sums[at[:-1]]


def _distinct(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    rows = len(at) - 1
    keys = np.sort((hashes >> by.U(16)) | (np.repeat(np.arange(rows), np.diff(at)).astype(by.U) << by.U(48)))
    new = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
    return np.bincount((keys[new] >> by.U(48)).astype(np.int64), minlength=rows)


def measured(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, features) of the texts."""
    n = np.diff(offsets).astype(float)
    start, end, hashes, at = by.words(data, offsets)
    words, length = np.diff(at).astype(float), (end - start).astype(float)
    per_byte, per_word = 1 / np.maximum(n, 1), 1 / np.maximum(words, 1)
    upper, digits, blank, beyond, stops, bars, symbols, bangs, others, brackets = (_sums(k[data], offsets) * per_byte for k in _KINDS)
    mean = _sums(length, at) * per_word
    cut = np.zeros(len(data) + 1, bool)
    cut[1:] = data == 10
    cut[offsets] = True
    line = np.flatnonzero(cut[:-1]) if len(data) else np.zeros(0, np.int64)
    line_end = np.append(line[1:], len(data))
    line_at = np.searchsorted(line, offsets)
    lines = np.diff(line_at).astype(float)
    line_hashes = by.Prefix(data).hashes(line, np.where(line_end > line, np.maximum(line_end - (data[line_end - 1] == 10), line), line)) if len(line) else np.zeros(0, by.U)
    return np.stack(
        [
            np.log1p(n), np.log1p(words), mean, upper, digits, blank, beyond, stops, bars, symbols, bangs, others,
            _sums(_MARKS[data[end - 1]] if len(end) else end, at) * per_word,
            _distinct(hashes, at) * per_word,
            _sums(length <= 3, at) * per_word,
            np.log1p(lines), n / np.maximum(lines, 1), _distinct(line_hashes, line_at) / np.maximum(lines, 1), brackets,
            np.sqrt(np.maximum(_sums(length * length, at) * per_word - mean * mean, 0)),
        ],
        axis=1,
    )


def features(docs: DataFrame) -> DataFrame:
    """``doc_id`` and an array of the features of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = by.texts(b.column(1))
            for i, j in by.slices(offsets):
                x = measured(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]).astype(np.float32)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel()))], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, x array<float>")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(0)) % 5 == 0


@dataclass
class Model:
    """Bin edges, a table for each feature, and (feature, feature, coarse edges, coarse edges, table) for each pair."""

    base: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for k, (edges, values) in enumerate(zip(self.edges, self.tables, strict=True)):
            out += values[np.searchsorted(edges, x[:, k], "right")]
        for a, b, ea, eb, values in self.pairs:
            out += values[np.searchsorted(ea, x[:, a], "right"), np.searchsorted(eb, x[:, b], "right")]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _leaves(g: np.ndarray, h: np.ndarray, leaves: int = LEAVES) -> np.ndarray:
    """The update of each bin by a tree of at most ``leaves`` leaves over ordered bins with gradient and curvature sums."""
    cuts = [0, len(g)]
    gs, hs = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    value = lambda i, j: (gs[j] - gs[i]) ** 2 / (hs[j] - hs[i] + 1.0)
    for _ in range(leaves - 1):
        best, where = 1e-9, None
        for i, j in zip(cuts, cuts[1:], strict=False):
            mid = np.arange(i + 1, j)
            if not len(mid):
                continue
            gain = value(i, mid) + value(mid, j) - value(i, j)
            if gain.max() > best:
                best, where = gain.max(), mid[gain.argmax()]
        if where is None:
            break
        cuts = sorted([*cuts, where])
    out = np.zeros(len(g))
    for i, j in zip(cuts, cuts[1:], strict=False):
        out[i:j] = (gs[j] - gs[i]) / (hs[j] - hs[i] + 1.0)
    return out


def fitted(x: np.ndarray, y: np.ndarray) -> Model:
    share = (y.sum() + 1) / (len(y) + 2)
    model = Model(float(np.log(share / (1 - share))))
    if len(y) < 2 or y.min() == y.max():
        return model
    logit = np.full(len(y), model.base)
    wide = [_edges(x[:, k], BINS) for k in range(x.shape[1])]
    bins = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(wide)]
    tables = [np.zeros(len(e) + 1) for e in wide]

    def turn(where: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-logit))
        return np.bincount(where, y - p, size), np.bincount(where, p * (1 - p), size)

    for _ in range(ROUNDS):
        for k, where in enumerate(bins):
            step = RATE * _leaves(*turn(where, len(tables[k])))
            tables[k] += step
            logit += step[where]
    narrow = [_edges(x[:, k], PAIR_BINS) for k in range(x.shape[1])]
    coarse = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(narrow)]
    gains = []
    for a in range(x.shape[1]):
        for b in range(a):
            g, h = turn(coarse[a] * PAIR_BINS + coarse[b], PAIR_BINS * PAIR_BINS)
            gains.append(((g * g / (h + 1.0)).sum(), a, b))
    chosen = [(a, b, np.zeros((len(narrow[a]) + 1, len(narrow[b]) + 1))) for _, a, b in sorted(gains, reverse=True)[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for a, b, values in chosen:
            where = coarse[a] * values.shape[1] + coarse[b]
            g, h = (s.reshape(values.shape) for s in turn(where, values.size))
            # A shallow tree: split on the first feature, then each part on the second.
            first = _leaves(g.sum(1), h.sum(1), 2)
            step = np.zeros(values.shape)
            for v in np.unique(first):
                rows = first == v
                step[rows] = _leaves(g[rows].sum(0), h[rows].sum(0), 2)
            values += RATE * step
            logit += RATE * step.ravel()[where]
    model.edges, model.tables = wide, tables
    model.pairs = [(a, b, narrow[a], narrow[b], v) for a, b, v in chosen]
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Model:
    """Fits on at most ``sample`` rows of ``labels`` (doc_id and a 0/1 column), those whose doc_id has the least hash."""
    chosen = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y"))
    chosen = chosen.distinct().withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id", "y").limit(sample).drop("h")
    chosen = F.broadcast(written(chosen, "labels"))  # at most ``sample`` rows of 16 bytes
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen.select("doc_id").distinct(), "doc_id", "left_semi")
    rows = features(own).join(chosen, "doc_id").groupBy("doc_id", "y").agg(F.min("x").alias("x")).toArrow()
    if not rows.num_rows:
        return Model(0.0)
    rows = rows.sort_by([("doc_id", "ascending"), ("y", "ascending")])
    x = np.array(rows["x"].combine_chunks().flatten()).reshape(rows.num_rows, -1).astype(float)
    return fitted(x, np.array(rows["y"]))


def _scores(model: Model, column: pa.Array) -> np.ndarray:
    data, offsets = by.texts(column)
    parts = [model.scores(measured(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]).astype(np.float32).astype(float)) for i, j in by.slices(offsets)]
    return np.concatenate(parts) if parts else np.zeros(0)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` of each row: features and score in one pass over the scan, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_scores(model, b.column(1)))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def accepted(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that the model scores at ``threshold`` or above."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = _scores(model, b.column(names.index("text"))) >= threshold
            if keep.any():
                yield b.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
