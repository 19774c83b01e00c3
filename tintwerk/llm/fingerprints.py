"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is cut into paragraph pieces (at line breaks and ends of sentences; a longer piece every ``PIECE`` bytes), each
distinct piece gives a 64-bit digest, and a sketch adds every digest to ``HASHES`` cells (count, key sum, check sum).
Two sketches of one size subtract cell by cell; peeling cells that hold a single key recovers the digests in which the
versions differ. If peeling gets stuck, both sketches are built again larger, until it succeeds. The likeness of two versions is the
weight of their common digests over that of all.

The fingerprint itself is the smallest sketch, with the number of digests, in hexadecimal. All pairs of a batch
are subtracted and peeled together in NumPy.

The edited text's next document is found without a global sort: sampled splitters cut the doc_ids into ranges, and the
first row of each range also goes, as a guest, to the range before it.

Defined cases: a null text is empty, two empty texts have likeness 1, an empty and another one 0; rows of one doc_id are ordered
by the text's hash; a null doc_id sorts first; a single document is its own next; extra columns are ignored; an empty
table gives no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tintwerk.llm import _bytes as by
from tintwerk.llm._work import constant, searched

PIECE = 160
HASHES = 3
CELLS = 12  # of the fingerprint
U = np.uint64
_END = np.zeros(256, bool)
_END[[10, 13]] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in ".!?"]] = True


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's sorted distinct piece digests (as 48-bit values, 0 never), and len+1 offsets by row."""
    n = len(data)
    cut = np.zeros(n + 1, bool)
    if n:
        cut[1:] = _END[data]
        cut[2:] |= _MARK[data[:-1]] & ((data[1:] == 32) | _END[data[1:]])
    cut[offsets] = True
    at = np.flatnonzero(cut)
    at = at[at < n]
    length = np.diff(np.append(at, n))
    parts = -(-length // PIECE)
    start = np.repeat(at, parts) + by.spread(parts) * PIECE
    end = np.minimum(start + PIECE, np.repeat(at + length, parts))
    row = np.searchsorted(offsets, start, "right") - 1
    keys = np.zeros(0, U)
    if len(start):
        digest = np.maximum(by.Prefix(data).hashes(start, end) >> U(16), U(1))
        keys = np.sort(digest | (row.astype(U) << U(48)))
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
    return keys & U((1 << 48) - 1), np.searchsorted(keys >> U(48), np.arange(len(offsets), dtype=U))


def _cells(keys: np.ndarray, sizes: np.ndarray, seed: int) -> np.ndarray:
    """(HASHES, keys): the cell of each key in each third of its sketch, which has ``sizes`` cells."""
    third = (sizes // HASHES).astype(U)
    return np.stack([by.mixed(keys * U(2 * seed + 1) + U(0xA24BAED4963EE407 * (k + 1) & 0xFFFFFFFFFFFFFFFF)) % third + third * U(k) for k in range(HASHES)]).astype(np.int64)


def _check(keys: np.ndarray) -> np.ndarray:
    return by.mixed(keys ^ U(0x6A09E667F3BCC909)) & U(0xFFFFFFFF)


class Sketches:
    """Sketches one after another in three flat arrays; sketch i has ``sizes[i]`` cells."""

    def __init__(self, sizes: np.ndarray, seed: int = 0):
        self.sizes, self.seed = sizes, seed
        self.base = np.concatenate([[0], np.cumsum(sizes)])
        self.count = np.zeros(self.base[-1], np.int64)
        self.keys = np.zeros(self.base[-1], U)
        self.checks = np.zeros(self.base[-1], U)

    def add(self, which: np.ndarray, keys: np.ndarray, sign: np.ndarray | int) -> None:
        """Sums wrap modulo 2**64, so that adding and taking away need no order."""
        sign = np.broadcast_to(np.asarray(sign, np.int64), keys.shape)
        k, c = keys * sign.astype(U), _check(keys) * sign.astype(U)
        for cell in _cells(keys, self.sizes[which], self.seed):
            at = self.base[which] + cell
            np.add.at(self.count, at, sign)
            np.add.at(self.keys, at, k)
            np.add.at(self.checks, at, c)

    def minus(self, other: Sketches) -> Sketches:
        out = Sketches(self.sizes, self.seed)
        out.count, out.keys, out.checks = self.count - other.count, self.keys - other.keys, self.checks - other.checks
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(sketch, key, sign) of what is recovered, and whether each sketch came out empty."""
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        sketch_of = np.repeat(np.arange(len(self.sizes)), self.sizes)
        look = np.flatnonzero(np.abs(self.count) == 1)
        while len(look):
            sign = self.count[look]
            key = self.keys[look] * sign.astype(U)
            pure = (self.checks[look] * sign.astype(U) == _check(key)) & (key > 0) & (key < U(1 << 48))
            which, key, sign = sketch_of[look][pure], key[pure], sign[pure]
            if not len(key):
                break
            # A key may be alone in several of its cells.
            order = np.lexsort((key, which))
            new = np.concatenate([[True], (np.diff(which[order]) != 0) | (key[order][1:] != key[order][:-1])])
            which, key, sign = which[order][new], key[order][new], sign[order][new]
            self.add(which, key, -sign)
            found.append((which, key, sign))
            cells = np.unique((self.base[which] + _cells(key, self.sizes[which], self.seed)).ravel())
            look = cells[np.abs(self.count[cells]) == 1]
        bad = np.bincount(sketch_of[(self.count != 0) | (self.keys != 0) | (self.checks != 0)], minlength=len(self.sizes)) > 0
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, np.int64), ~bad
        return *(np.concatenate(x) for x in zip(*found, strict=True)), ~bad


def sketched(keys: np.ndarray, at: np.ndarray, sizes: np.ndarray, seed: int = 0) -> Sketches:
    out = Sketches(sizes, seed)
    out.add(np.repeat(np.arange(len(at) - 1), np.diff(at)), keys, 1)
    return out


def _subset(keys: np.ndarray, at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = (at[1:] - at[:-1])[rows]
    return keys[np.repeat(at[rows], n) + by.spread(n)], np.concatenate([[0], np.cumsum(n)])


def differences(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], rows_a: np.ndarray, rows_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For pair i of a's row rows_a[i] and b's row rows_b[i]: digests only in the first, only in the second, and retries.

    The first try is with the fingerprint's size; a stuck pair goes on with a sketch for its likely difference, then twice as large each time.
    """
    only_a, only_b, tries = (np.zeros(len(rows_a), np.int64) for _ in range(3))
    left, sizes = np.arange(len(rows_a)), np.full(len(rows_a), CELLS)
    attempt = 0
    while len(left):
        ka, kb = _subset(*a, rows_a[left]), _subset(*b, rows_b[left])
        which, _, sign, empty = sketched(*ka, sizes, attempt).minus(sketched(*kb, sizes, attempt)).peel()
        plus = np.bincount(which[sign > 0], minlength=len(left))
        less = np.bincount(which[sign < 0], minlength=len(left))
        only_a[left[empty]], only_b[left[empty]], tries[left[empty]] = plus[empty], less[empty], attempt
        likely = (np.diff(ka[1]) + np.diff(kb[1]))[~empty]
        left, sizes = left[~empty], np.maximum(sizes[~empty] * 2, -(-likely * 3 // 2 // HASHES) * HASHES + 9 if attempt == 0 else 0)
        attempt += 1
    return only_a, only_b, tries


def likeness(n_a: np.ndarray, n_b: np.ndarray, only_a: np.ndarray, only_b: np.ndarray) -> np.ndarray:
    common = n_a - only_a
    every = common + only_a + only_b
    return np.where(every > 0, common / np.maximum(every, 1), 1.0)


def shown(s: Sketches, n: np.ndarray) -> list[str]:
    """Hexadecimal of (number of digests, then count, key and check of each cell), one string a sketch; all of CELLS cells."""
    rows = len(s.sizes)
    raw = np.concatenate([n.astype("<u4").reshape(rows, 1).view(np.uint8), s.count.astype("<u2").reshape(rows, CELLS).view(np.uint8), s.keys.astype("<u8").reshape(rows, CELLS).view(np.uint8), s.checks.astype("<u8").reshape(rows, CELLS).view(np.uint8)], axis=1)
    text = raw.tobytes().hex()
    width = 2 * raw.shape[1]
    return [text[i * width : (i + 1) * width] for i in range(rows)]


def _with_next(docs: DataFrame, rows_per_range: int) -> DataFrame:
    """Rows ``range, guest, doc_id, text``, where the first row of each range stands, as a guest, in the range before it too (the first of all in the last)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("d"), F.xxhash64("text").alias("h")))
    n = docs.count()
    n_ranges = max(1, min(4096, n // rows_per_range))
    if n_ranges == 1:
        cuts = []
    else:
        share = min(1.0, 40 * n_ranges / n)
        drawn = sorted({(r.d, 0) for r in docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("d")).where(F.pmod(F.xxhash64("d"), F.lit(1 << 30)) < int(share * (1 << 30))).collect()})
        cuts = sorted({drawn[len(drawn) * i // n_ranges][0] for i in range(1, n_ranges) if drawn})
    bounds = constant(cuts, "bigint")
    rows = rows.withColumn("range", searched(F.col("key.d"), bounds, len(cuts)))
    firsts = sorted((r["range"], tuple(r.k)) for r in rows.groupBy("range").agg(F.min("key").alias("k")).collect())
    if not firsts:
        return rows.select("range", F.lit(False).alias("guest"), "key", "doc_id", "text")
    before = {firsts[i][1]: firsts[i - 1][0] for i in range(len(firsts))}  # the first range's guest host is the last range
    table = docs.sparkSession.createDataFrame([(d, h, r) for (d, h), r in before.items()], "d long, h long, host int")
    guests = rows.join(F.broadcast(table), (F.col("key.d") == F.col("d")) & (F.col("key.h") == F.col("h"))).dropDuplicates(["d", "h"])  # a row for each range
    return rows.select("range", F.lit(False).alias("guest"), "key", "doc_id", "text").unionByName(guests.select(F.col("host").alias("range"), F.lit(True).alias("guest"), "key", "doc_id", "text"))


def fingerprint_edits(docs: DataFrame, rows_per_range: int = 2000) -> DataFrame:
    """Each document against an edited version of itself and against the next document (see the query's contract)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def closed(rows: list[tuple]) -> pa.RecordBatch | None:
            """rows: (doc_id, text), each but the last with its successor behind it."""
            if len(rows) < 2:
                return None
            ids, texts = [r[0] for r in rows[:-1]], [r[1] for r in rows]
            edited = []
            for own, after in zip(texts, texts[1:], strict=False):
                half = len(own) // 2
                edited.append(own[: len(own) - half] + after[:half])
            raw = [t.encode() for t in edited]
            own_keys, edit_keys = (_all_pieces(pa.array(t, pa.large_string())) for t in (texts, edited))
            n, m = np.diff(own_keys[1]), np.diff(edit_keys[1])
            at = np.arange(len(ids))
            near_edited = likeness(n[:-1], m, *differences(own_keys, edit_keys, at, at)[:2])
            near_next = likeness(n[:-1], n[1:], *differences(own_keys, own_keys, at, at + 1)[:2])
            flat = np.full(len(ids), CELLS)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array([len(t) for t in texts[:-1]], pa.int64()),
                    pa.array([hashlib.sha256(t).hexdigest() for t in raw]),
                    pa.array(shown(sketched(*_subset(*own_keys, at), flat), n[:-1])),
                    pa.array(shown(sketched(*edit_keys, flat), m)),
                    pa.array(near_edited),
                    pa.array(near_next),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

        unit, rows, held = None, [], 0
        for b in batches:
            for r, d, t in zip(*(b.column(c).to_pylist() for c in ("range", "doc_id", "text")), strict=True):
                if r != unit:
                    if (out := closed(rows)) is not None:
                        yield out
                    unit, rows, held = r, [], 0
                rows.append((d, t))
                held += len(t)
                if held > 4 << 20 and len(rows) > 1:
                    if (out := closed(rows)) is not None:
                        yield out
                    rows, held = rows[-1:], len(t)
        if (out := closed(rows)) is not None:
            yield out

    rows = _with_next(docs, rows_per_range)
    rows = rows.repartition("range").sortWithinPartitions("range", "guest", "key").select("range", "doc_id", "text")
    return rows.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _all_pieces(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = by.texts(column)
    keys, at = [np.zeros(0, U)], [np.zeros(1, np.int64)]
    for i, j in by.slices(offsets):
        k, a = pieces(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        keys.append(k)
        at.append(a[1:] + at[-1][-1])
    return np.concatenate(keys), np.concatenate(at)
