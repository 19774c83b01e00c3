"""Suffix-array deduplication with a run-length index.

Every byte that a string of ``window`` bytes covers which also starts elsewhere (in any text, the same one included) goes.

1. Anchors: of the k-grams within each window, the one of least hash (the leftmost of equals) is the window's anchor. It depends
   on the window's bytes only, so equal windows have the same anchor at the same place: it is enough to compare the
   surroundings of equal anchors. About one byte in (window - k) / 2 is an anchor. A long text is read in overlapping pieces.
2. Anchors of one occurrence in the corpus fall away. Of the others, equal surroundings (up to window - k bytes before the
   anchor, up to ``window`` from its start) are one context with a count; its bytes are fetched once. A context that occurs
   more than once matches itself in full.
3. Index (``RunIndex``): the contexts of an anchor, in the order of what follows it, are extended to the left byte by byte. Each column of
   bytes is one of the Burrows-Wheeler transform, kept as runs only: where a run starts, where the last-to-first mapping takes it, and, sampled at
   both ends of the run, the common prefix with the neighbour beyond. All contexts are then streamed through the runs: within
   a run the mapping is a shift and common prefixes grow by one, at its ends they are the samples. The greater of both sides is the
   matching statistic of a position; where it spans ``window`` bytes, the bytes are marked.
4. Each occurrence takes its context's marks; a text's marks are merged and its remaining bytes hashed.

An anchor with more than ``HOT`` contexts would make one large task. Its contexts' windows are counted instead, by a 128-bit hash
and a partial aggregate, which gives the same marks, as the repeated windows around one anchor lie side by side.

Texts, contexts and windows are told apart by 128 bits at least (anchor or doc_id, and hashes).

Defined cases: a null text is empty; texts shorter than ``window`` lose nothing; rows are told apart by (doc_id, text), and
rows equal in both count as two texts; a null doc_id is an id like others; extra columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tintwerk.llm import _bytes as by
from tintwerk.llm._work import Intermediates, written

WINDOW, K = 400, 128
BLOCK = 4 << 20  # bytes of contexts indexed at a time
HOT = 4096  # contexts of one anchor that one task indexes
PIECE = 4 << 20  # bytes of a long text whose windows are read at a time
KEY = ["k1", "k2"]
CONTEXT = ["anchor", "c1", "c2"]
U = np.uint64
_PLACE = 28  # bits of a position within a slice


def _sliding_least(v: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours: prefix and suffix minima over blocks of w."""
    n = len(v)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, U)
    padded[:n] = v
    blocks = padded.reshape(-1, w)
    forth = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], forth[w - 1 : n])


def anchors(data: np.ndarray, offsets: np.ndarray, window: int, k: int) -> tuple[np.ndarray, ...]:
    """Of all texts of a slice: anchor hash, row, position in the text, both context hashes, bytes after the anchor's start."""
    none = np.zeros(0, np.int64)
    if len(data) < window:
        return none.view(U), none, none, none.view(U), none.view(U), none
    prefix, second = by.Prefix(data), by.Prefix(data, other=True)
    h = prefix.windows(k)
    low = U((1 << _PLACE) - 1)
    least = _sliding_least((h & ~low) | np.arange(len(h), dtype=U), window - k + 1)
    starts = np.arange(len(least))
    row = np.searchsorted(offsets, starts, "right") - 1
    inside = starts + window <= offsets[row + 1]
    at = (least[inside] & low).astype(np.int64)
    at = at[np.concatenate([[True], at[1:] != at[:-1]])] if len(at) else at
    row = np.searchsorted(offsets, at, "right") - 1
    before = np.minimum(at - offsets[row], window - k)
    after = np.minimum(offsets[row + 1] - at, window)
    side = before.astype(U) * U(0x9E3779B97F4A7C15)
    first, other = (by.mixed(p.hashes(at - before, at + after) ^ side) for p in (prefix, second))
    return h[at], row, at - offsets[row], first, other, after


def _in_pieces(data: np.ndarray, offsets: np.ndarray, window: int, k: int, piece: int) -> Iterator[tuple[np.ndarray, ...]]:
    """``anchors`` of a slice; a text longer than two pieces is read in pieces that overlap by what a window and its contexts reach."""
    if len(offsets) > 2 or len(data) <= 2 * piece:
        yield anchors(data, offsets, window, k)
        return
    for begin in range(0, len(data), piece):
        # Anchors in [begin, begin + piece), with all windows that may have them, and the bytes that their contexts reach.
        low, high = max(0, begin - (window - k)), min(len(data), begin + piece + 2 * window)
        found = anchors(data[low:high], np.array([0, high - low]), window, k)
        place = found[2] + low
        mine = (place >= begin) & (place < (len(data) if high == len(data) else begin + piece))
        yield found[0][mine], found[1][mine], place[mine], *(x[mine] for x in found[3:])
        if high == len(data):
            return


def find_anchors(texts: DataFrame, window: int, k: int, piece: int = PIECE) -> DataFrame:
    """``anchor, c1, c2, k1, k2, place, after`` of each anchor of rows ``k1, k2, text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = by.texts(b.column(2))
            keys = [np.array(b.column(i)) for i in range(2)]
            for i, j in by.slices(offsets):
                for a, row, place, c1, c2, after in _in_pieces(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], window, k, piece):
                    if len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a.view(np.int64), c1.view(np.int64), c2.view(np.int64), keys[0][i:j][row], keys[1][i:j][row], place.astype(np.int32), after.astype(np.int32))], [*CONTEXT, *KEY, "place", "after"])

    return texts.select(*KEY, "text").mapInArrow(run, "anchor long, c1 long, c2 long, k1 long, k2 long, place int, after int")


class RunIndex:
    """Run-compressed transform of anchor groups, built column by column to the left of the anchors.

    ``columns[d]`` has the runs of the bytes d + 1 before the anchor, in the order of what follows them: each run's start, its head
    (-1: texts that begin there, or can't reach a window any more), the place of its first row one byte further left, and the sampled
    common prefixes there: of its first row with the row before, of its last row with the row after.
    """

    def __init__(self, contexts: list[tuple[int, bytes, int]], window: int, k: int):
        m, self.reach = len(contexts), window - k
        names = {g: i for i, g in enumerate(dict.fromkeys(c[0] for c in contexts))}
        group = np.array([names[c[0]] for c in contexts], np.int64)
        left = np.full((self.reach, m), -1, np.int16)
        behind = np.full((m, window), -1, np.int16)
        sizes = np.empty(m, np.int64)
        for i, (_, raw, before) in enumerate(contexts):
            x = np.frombuffer(raw, np.uint8)
            left[:before, i] = x[:before][::-1]
            behind[i, : len(x) - before] = x[before:]
            sizes[i] = len(x) - before
        self.order = np.array(sorted(range(m), key=lambda i: (group[i], contexts[i][1][contexts[i][2] :])), np.int64)
        a, b = self.order[:-1], self.order[1:]
        differs = behind[a] != behind[b]
        common = np.where(differs.any(1), differs.argmax(1), window)
        common = np.minimum(common, np.minimum(sizes[a], sizes[b])) * (group[a] == group[b])
        self.common = np.concatenate([[0], common])  # of each row of the first order with the one before
        self.columns: list[tuple[np.ndarray, ...]] = []
        self._build(group, left, window)

    def _build(self, group: np.ndarray, left: np.ndarray, window: int) -> None:
        order, common = self.order, self.common
        for d in range(1, self.reach + 1):
            matched = np.maximum(common, np.append(common[1:], 0))
            # A row whose match can't reach a window's length any more goes no further.
            head = np.where((matched + self.reach - d + 1 >= window) & (left[d - 1, order] >= 0), group[order] * 256 + left[d - 1, order], -1)
            new = np.ones(len(head), bool)
            new[1:] = head[1:] != head[:-1]
            start = np.flatnonzero(new)
            size = np.diff(np.append(start, len(head)))
            heads = head[start]
            on = np.flatnonzero(heads >= 0)
            if not len(on):
                break
            by_head = on[np.argsort(heads[on], kind="stable")]
            to = np.full(len(start), -1)
            to[by_head] = np.concatenate([[0], np.cumsum(size[by_head])[:-1]])
            # Two runs that become neighbours have in common what all rows between them have, and the byte itself.
            up, down = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
            p, q = by_head[:-1], by_head[1:]
            same = heads[p] == heads[q]
            if same.any():
                between = np.stack([start[p[same]] + size[p[same]], start[q[same]] + 1], axis=1).ravel()
                least = np.minimum.reduceat(np.append(common, 0), between)[::2] + 1
                up[q[same]], down[p[same]] = least, least
            self.columns.append(tuple(x.astype(np.int32) for x in (start, size, heads, to, up, down)))
            rows = np.flatnonzero(head >= 0)
            run = np.repeat(np.arange(len(start)), size)[rows]
            place = to[run] + rows - start[run]
            order, common = self._moved(order, rows, place), self._moved(np.where(new, np.repeat(up, size), common + 1), rows, place)

    @staticmethod
    def _moved(x: np.ndarray, rows: np.ndarray, place: np.ndarray) -> np.ndarray:
        out = np.empty(len(rows), x.dtype)
        out[place] = x[rows]
        return out

    @property
    def runs(self) -> int:
        return sum(len(c[0]) for c in self.columns)

    def matching_statistics(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(bytes before the anchor, contexts still in the stream, the longest match of each from there on with another one), column by column.

        The stream reads the runs only: a context is its place, and the common prefixes above and below it.
        """
        context, place = self.order, np.arange(len(self.order))
        above, below = self.common, np.append(self.common[1:], 0)
        yield 0, context, np.maximum(above, below)
        for d, (start, size, heads, to, up, down) in enumerate(self.columns, 1):
            run = np.searchsorted(start, place, "right") - 1
            on = heads[run] >= 0
            run, place, context, above, below = run[on], place[on], context[on], above[on], below[on]
            above = np.where(place == start[run], up[run], above + 1)
            below = np.where(place == start[run] + size[run] - 1, down[run], below + 1)
            place = to[run] + place - start[run]
            yield d, context, np.maximum(above, below)


def marked(contexts: list[tuple[int, bytes, int]], window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For contexts (group, bytes, bytes before the anchor), how many bytes before and after each anchor's start are repeated in
    another context of its group; both 0 where no window is."""
    left, right = np.zeros(len(contexts), np.int64), np.zeros(len(contexts), np.int64)
    for d, context, longest in RunIndex(contexts, window, k).matching_statistics():
        ok = longest >= window
        left[context[ok]] = d
        np.maximum.at(right, context[ok], longest[ok] - d)
    return left, right


def _cut(candidates: DataFrame) -> DataFrame:
    """``anchor, c1, c2, raw, before``: the bytes of the contexts that each text lends."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, of in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                raw = text.encode()
                ids = [pa.array([c[n] for c in of], pa.int64()) for n in CONTEXT]
                yield pa.RecordBatch.from_arrays([*ids, pa.array([raw[c["place"] - c["before"] : c["place"] + c["after"]] for c in of], pa.binary()), pa.array([c["before"] for c in of], pa.int32())], [*CONTEXT, "raw", "before"])

    return candidates.where("lent IS NOT NULL").select("text", "lent").mapInArrow(cut, "anchor long, c1 long, c2 long, raw binary, before int")


_MARKS = "anchor long, c1 long, c2 long, left int, right int"


def index_contexts(pieces: DataFrame, window: int, k: int, block: int = BLOCK) -> DataFrame:
    """``anchor, c1, c2, left, right`` of each context (anchor, c1, c2, raw, before) with a repeated window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def closed(rows: list[tuple]) -> pa.RecordBatch:
            left, right = marked([(r[0], r[3], r[4]) for r in rows], window, k)
            some = np.flatnonzero(right)
            return pa.RecordBatch.from_arrays([*(pa.array([rows[i][n] for i in some], pa.int64()) for n in range(3)), pa.array(left[some].astype(np.int32)), pa.array(right[some].astype(np.int32))], [*CONTEXT, "left", "right"])

        held, size = [], 0
        every = (row for b in batches for row in zip(*(b.column(c).to_pylist() for c in (*CONTEXT, "raw", "before")), strict=True))
        for _, group in groupby(every, key=itemgetter(0)):
            own = list(group)
            if len(own) < 2:
                continue
            more = sum(len(r[3]) for r in own)
            if held and size + more > block:
                yield closed(held)
                held, size = [], 0
            held, size = held + own, size + more
        if held:
            yield closed(held)

    return pieces.repartition("anchor").sortWithinPartitions(*CONTEXT).mapInArrow(run, _MARKS)


def count_windows(pieces: DataFrame, window: int, k: int) -> DataFrame:
    """The same as ``index_contexts``, for anchors of very many contexts: windows are counted by hash, so no anchor meets in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = by.texts(b.column("raw"))
            before = np.array(b.column("before"), np.int64)
            for i, j in by.slices(offsets, 1 << 18):
                own, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                first, second = by.Prefix(own), by.Prefix(own, other=True)
                # Window starts, as bytes before the anchor: it lies in the context and holds the anchor.
                left = before[i:j]
                n = left - np.maximum(0, window - (np.diff(at) - left)) + 1
                row = np.repeat(np.arange(j - i), n)
                d = left[row] - by.spread(n)
                start = at[row] + left[row] - d
                hashes = [by.mixed(p.hashes(start, start + window) + d.astype(U)).view(np.int64) for p in (first, second)]
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, j - i).take(pa.array(row)) for c in CONTEXT), pa.array(d.astype(np.int16)), *(pa.array(h) for h in hashes)], [*CONTEXT, "d", "w1", "w2"])

    windows = written(pieces.select(*CONTEXT, "raw", "before").mapInArrow(run, "anchor long, c1 long, c2 long, d short, w1 long, w2 long"), "windows")
    again = windows.groupBy("anchor", "w1", "w2").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    found = windows.join(written(again, "repeated-windows"), ["anchor", "w1", "w2"]).groupBy(*CONTEXT)
    return found.agg(F.max("d").cast("int").alias("left"), (F.lit(window) - F.min("d")).cast("int").alias("right"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, k: int = K, hot: int = HOT) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans`` of each row; spans: the removed [start, end) in bytes."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({"k1": F.coalesce("doc_id", F.lit(-(1 << 63))), "k2": F.xxhash64("text")})
    with Intermediates(docs.sparkSession) as made:
        found = written(find_anchors(rows.where(F.octet_length("text") >= window), window, k), "anchors")
        often = found.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
        # Tables of their own, here and for the marks: a join straight on an aggregate can't have its hot keys split.
        shared = written(found.join(written(often, "often"), "anchor"), "shared")
        contexts = shared.groupBy(*CONTEXT).agg(F.count("*").alias("n"), F.min(F.struct(*KEY, "place")).alias("owner"), F.min("after").alias("after"))
        contexts = written(contexts.withColumn("before", F.least(F.col("owner.place"), F.lit(window - k))), "contexts")
        several = contexts.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1")
        several = written(several.select("anchor", (F.col("kinds") > hot).alias("hot")), "several")
        # A text lends its bytes to as many contexts as it has anchors: the list is bounded by the text.
        lent = contexts.join(several, "anchor").groupBy("owner.k1", "owner.k2").agg(F.collect_list(F.struct(*CONTEXT, F.col("owner.place").alias("place"), "before", "after", "hot")).alias("all"))
        part = lambda hot: F.when(F.exists("all", lambda c: c["hot"] == hot), F.filter("all", lambda c: c["hot"] == hot))
        lent = lent.select(*KEY, part(False).alias("lent"), part(True).alias("hot"))
        keys = shared.select(*KEY).distinct()
        candidates = written(rows.select(*KEY, "text").join(keys.join(lent, KEY, "left"), KEY), "candidates")
        own = contexts.where("n > 1").select(*CONTEXT, F.col("before").alias("left"), F.col("after").alias("right"))
        indexed = index_contexts(_cut(candidates.select("text", "lent")), window, k)
        counted = count_windows(_cut(candidates.select("text", F.col("hot").alias("lent"))), window, k)
        marks = own.unionByName(indexed).unionByName(counted).groupBy(*CONTEXT).agg(F.max("left").alias("left"), F.max("right").alias("right"))
        marks = written(marks, "marks")
        made.keep_only(shared, candidates, marks)
    spans = shared.join(marks, CONTEXT).select(*KEY, (F.col("place") - F.col("left")).alias("start"), (F.col("place") + F.col("right")).alias("end"))
    spans = spans.groupBy(*KEY).agg(F.collect_set(F.struct("start", "end")).alias("marks"))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k1, k2, text, of in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                raw, merged = text.encode(), []
                for start, end in sorted((m["start"], m["end"]) for m in of):
                    if merged and start <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], end)
                    else:
                        merged.append([start, end])
                kept, at = hashlib.sha256(), 0
                for start, end in merged:
                    kept.update(raw[at:start])
                    at = end
                kept.update(raw[at:])
                out.append((k1, k2, sum(e - s for s, e in merged), merged, kept.hexdigest()))
            columns = zip(*out, strict=True) if out else ((),) * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int32())), pa.string()), strict=True)], [*KEY, "n_removed", "spans", "kept"])

    cleaned = candidates.select(*KEY, "text").join(spans, KEY).mapInArrow(clean, "k1 long, k2 long, n_removed long, spans array<array<int>>, kept string").dropDuplicates(KEY)
    base = rows.select("doc_id", *KEY, F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole"))
    return base.join(cleaned, KEY, "left").select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.when(F.col("spans").isNull(), 0).otherwise(F.size("spans")).cast("long").alias("n_spans"),
        F.coalesce("kept", "whole").alias("kept_sha256"),
        F.coalesce("spans", F.array().cast("array<array<int>>")).alias("spans"),
    )
