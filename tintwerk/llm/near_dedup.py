"""Near-duplicates by an LSH forest over MinHash signatures, confirmed on whole shingle sets.

1. Each text becomes its set of distinct 5-word shingles. Rows of equal sets form a class, found by a partial aggregate
   on a 128-bit set digest; the row with the smallest doc_id stands for the class from here on.
2. Each class has ``TREES`` signatures of ``DEEP`` hashes. The classes are sorted by each of them (one range-partitioned sort of
   narrow rows). Neighbours in an order are candidates if their longest common prefix is at least ``DEPTH`` hashes;
   a run of such neighbours is a region. Two sets of similarity s share a region of some order with a chance of
   1 - (1 - s**DEPTH)**TREES: all but 7e-7 at 0.85.
3. The depth adapts to the region: one of more than ``LEAF`` texts or ``UNIT_BYTES`` is cut where its neighbours' common prefixes are
   shortest, deeper and deeper, into leaves of consecutive neighbours; a leaf begins with the last text of the leaf before.
4. Regions that overlap form areas (connected components, linear in the classes). A small area is one unit of work, so that each text
   moves once; of a larger one, the leaves of the first ``FIRST`` orders are linked, which joins most of any group of copies in linear work.
   Then every region of it that still holds several components is compared whole: in blocks, each pair of blocks one unit,
   without those that hold one component only. So no pair of a region stays uncompared, at any size, and every unit is bounded.
5. Within a unit, members of different components are compared, signatures first (``likely``), then whole sets.

Defined cases: null and empty texts and texts without words have an empty set, are their own component and link with
nothing; fewer than 5 words give one shingle; a null doc_id never stands for a class with other ids, and a class of null
ids only has no component; repeated rows fall in one class; where one doc_id has several texts, each row has its own text's
component, and classes of one smallest doc_id count as one; extra columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tintwerk.llm import _bytes as by
from tintwerk.llm._work import Intermediates, written
from tintwerk.llm.components import connected_components

TREES, DEPTH, DEEP = 24, 5, 8
LEAF = 64
UNIT_BYTES = 16 << 20
BLOCK = 256
FIRST = 3
U = np.uint64
_rng = np.random.default_rng(11)
_MUL = _rng.integers(1, 1 << 63, TREES * DEEP, dtype=np.uint64) | U(1)
_ADD = _rng.integers(1, 1 << 63, TREES * DEEP, dtype=np.uint64)
_JOIN = _rng.integers(1, 1 << 63, DEEP + 1, dtype=np.uint64) | U(1)


def minhashes(keys: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(rows, TREES * DEEP) 16-bit hashes of the least hashes of each row's keys; rows without keys must not be asked for."""
    out = np.empty((len(at) - 1, TREES * DEEP), np.uint16)
    x = np.empty(len(keys), U)
    for k in range(TREES * DEEP):
        np.multiply(keys, _MUL[k], out=x)
        x += _ADD[k]
        out[:, k] = by.mixed(np.minimum.reduceat(x, at[:-1])) >> U(48)
    return out


def signatures(docs: DataFrame) -> DataFrame:
    """``doc_id, size, n_shingles, hi, lo, signs``: bytes, set size, set digest and the signatures of all orders in one string of bytes (empty for an empty set)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = by.texts(b.column(1))
            for i, j in by.slices(offsets):
                keys, at = by.shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                n = np.diff(at)
                sums = np.zeros((2, len(keys) + 1), U)
                np.cumsum(by.mixed(keys + U(1)), out=sums[0, 1:])
                np.cumsum(by.mixed(keys ^ U(0x5DEECE66D1234567)), out=sums[1, 1:])
                digest = by.mixed(sums[:, at[1:]] - sums[:, at[:-1]] + n.astype(U))
                full = n > 0
                # Big-endian, so that bytes sort as the hashes do.
                raw = minhashes(keys, np.append(at[:-1][full], at[-1])).astype(">u2").tobytes() if full.any() else b""
                ends = np.concatenate([[0], np.cumsum(full * (2 * TREES * DEEP))]).astype(np.int32)
                signs = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(ends), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), pa.array(np.diff(offsets[i : j + 1])), pa.array(n.astype(np.int64)), pa.array(digest[0].view(np.int64)), pa.array(digest[1].view(np.int64)), signs],
                    ["doc_id", "size", "n_shingles", "hi", "lo", "signs"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(sign, "doc_id long, size long, n_shingles long, hi long, lo long, signs binary")


def regions_of(tree: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Hashes of (tree, the first DEPTH hashes); ``signs``: (..., DEEP)."""
    return by.mixed(tree.astype(U) * _JOIN[DEEP] + (signs[..., :DEPTH].astype(U) * _JOIN[:DEPTH]).sum(-1))


def leaves(prefix: np.ndarray, size: np.ndarray, leaf: int, most: int) -> list[tuple[int, int]]:
    """Ranges of neighbours of at most ``leaf`` rows and ``most`` bytes (one row at least), cut where the common prefixes are shortest.

    ``prefix[i]``: hashes that row i has in common with the one before it.
    """
    until = np.concatenate([[0], np.cumsum(size)])
    out: list[tuple[int, int]] = []
    todo = [(0, len(size))]
    while todo:
        low, high = todo.pop()
        if high - low == 1 or high - low <= leaf and until[high] - until[low] <= most:
            # Neighbours that fit together stay together.
            if out and high - out[-1][0] <= leaf and until[high] - until[out[-1][0]] <= most:
                out[-1] = out[-1][0], high
            else:
                out.append((low, high))
            continue
        inner = prefix[low + 1 : high]
        cuts = np.flatnonzero(inner == inner.min()) + low + 1
        edges = [low, *cuts.tolist(), high]
        todo += reversed(list(zip(edges, edges[1:], strict=False)))
    return out


def sorted_orders(reps: DataFrame, leaf: int = LEAF, most: int = UNIT_BYTES) -> DataFrame:
    """Rows ``doc_id, size, tree, region, unit, crowded, again`` of ``reps`` (doc_id, size, signs): where a class stands among its neighbours.

    ``unit`` is the leaf, ``crowded`` says that its region was cut into leaves, ``again`` that the row links a leaf to the one
    before. A region that lies over an edge of a batch is taken in parts: each part that is no crowd has the region as its unit, so they
    meet there. Classes without a neighbour fall away, but for those at the edges.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.num_rows
            if not rows:
                continue
            ids, size, tree = (np.array(b.column(k)) for k in ("doc_id", "size", "tree"))
            signs = by.texts(b.column("sign"))[0].view(">u2").reshape(rows, DEEP)
            same = signs[1:] == signs[:-1]
            prefix = np.zeros(rows, np.int64)
            prefix[1:] = np.where(same.all(1), DEEP, same.argmin(1)) * (tree[1:] == tree[:-1])
            region = regions_of(tree, signs)
            leaf_of = by.mixed(region ^ by.mixed(ids.astype(U) + _JOIN[:1]))
            starts = np.flatnonzero(prefix < DEPTH)
            ends = np.append(starts[1:], rows)
            unit, crowded, kept = region.copy(), np.zeros(rows, bool), np.zeros(rows, bool)
            more: list[tuple[int, int]] = []
            for low, high in zip(starts.tolist(), ends.tolist(), strict=True):
                if high - low == 1 and 0 < low < rows - 1:
                    continue
                kept[low:high] = True
                if high - low <= leaf and size[low:high].sum() <= most:
                    continue
                crowded[low:high] = True
                before = None
                for i, j in leaves(prefix[low:high], size[low:high], leaf, most):
                    unit[low + i : low + j] = own = leaf_of[low + i]
                    if before is not None:
                        more.append((before, own))
                    before = low + j - 1
            at = np.concatenate([np.flatnonzero(kept), np.array([m[0] for m in more], np.int64)])
            units = np.concatenate([unit[kept], np.array([m[1] for m in more], U)])
            if len(at):
                again = np.arange(len(at)) >= kept.sum()
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[at], size[at], tree[at], region[at].view(np.int64), units.view(np.int64), crowded[at], again)], ["doc_id", "size", "tree", "region", "unit", "crowded", "again"])

    placed = reps.select("doc_id", "size", "signs", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    placed = placed.select("doc_id", "size", "tree", F.substring("signs", F.col("tree") * (2 * DEEP) + 1, F.lit(2 * DEEP)).alias("sign"))
    order = ["tree", "sign", "doc_id"]
    return placed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, "doc_id long, size long, tree int, region long, unit long, crowded boolean, again boolean")


def likely(least: int) -> int:
    """Equal hashes of two signatures below which sets of ``least`` hundredths aren't found: six standard deviations under the mean (a chance of 1e-9)."""
    n, s = TREES * DEEP, least / 100
    return max(0, ceil(n * s - 6 * sqrt(n * s * (1 - s))))


def joined(ids: np.ndarray, keys: np.ndarray, at: np.ndarray, least: int, of: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """For each set the smallest id in its component (by position: ids ascend), over all pairs that share a region; sets of equal ``of`` are joined already.

    ``signs``: (sets, TREES, DEEP). Whether two sets are compared depends on them alone, not on the unit in which they meet.
    """
    n = np.diff(at)
    _, first, known = np.unique(of, return_index=True, return_inverse=True)
    label = first[known]
    regions = regions_of(np.arange(TREES), signs)
    signs = signs.reshape(len(ids), -1)
    done = np.zeros((len(ids), len(ids)), bool)
    waiting = list(range(len(ids)))
    while True:
        values, counts = np.unique(label, return_counts=True)
        largest = values[counts.argmax()]
        # The largest component's members need no turn: all the others meet them.
        turn = next((k for k, p in enumerate(waiting) if label[p] != largest), None)
        if len(values) == 1 or turn is None:
            return ids[label]
        p = waiting.pop(turn)
        others = np.flatnonzero((label != label[p]) & ~done[p])
        done[p, others] = done[others, p] = True
        others = others[np.minimum(n[others], n[p]) * 100 >= np.maximum(n[others], n[p]) * least]
        others = others[(regions[others] == regions[p]).any(1)]
        others = others[(signs[others] == signs[p]).sum(1) >= likely(least)]
        if not len(others):
            continue
        own, m = keys[at[p] : at[p + 1]], n[others]
        theirs = keys[np.repeat(at[others] - (np.cumsum(m) - m), m) + np.arange(m.sum())]
        hit = own[np.minimum(np.searchsorted(own, theirs), len(own) - 1)] == theirs
        both = np.add.reduceat(hit.astype(np.int64), np.cumsum(m) - m)
        for q in others[both * 100 >= (m + n[p] - both) * least]:
            a, b = sorted((label[p], label[q]))
            if a != b:
                label[label == b] = a


def _linked(rows: DataFrame, least: int) -> DataFrame:
    """``rows``: unit, doc_id, of (its known component), text, signs. ``node, component`` of each doc_id within its unit."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def closed(ids: list, known: list, texts: list, signs: list) -> pa.RecordBatch:
            data, offsets = by.texts(pa.array(texts, pa.large_string()))
            keys, at = [], [np.zeros(1, np.int64)]
            for i, j in by.slices(offsets):
                k, a = by.shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                keys.append(k)
                at.append(a[1:] + at[-1][-1])
            own, at = np.array(ids, np.int64), np.concatenate(at)
            full = np.diff(at) > 0  # one doc_id may also stand for an empty text
            own, at = own[full], np.append(at[:-1][full], at[-1])
            found = joined(own, np.concatenate(keys), at, least, np.array(known, np.int64)[full], np.frombuffer(b"".join(signs), ">u2").reshape(-1, TREES, DEEP)[full])
            return pa.RecordBatch.from_arrays([pa.array(own), pa.array(found)], ["node", "component"])

        unit, ids, known, texts, signs = None, [], [], [], []
        for b in batches:
            for u, d, o, t, s in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                if u != unit and ids:
                    yield closed(ids, known, texts, signs)
                    ids, known, texts, signs = [], [], [], []
                unit = u
                if not ids or ids[-1] != d or texts[-1] != t:
                    for held, x in ((ids, d), (known, o), (texts, t), (signs, s)):
                        held.append(x)
        if ids:
            yield closed(ids, known, texts, signs)

    # A plan that doesn't change with the size: texts and units are always merged, never one of them broadcast.
    return rows.select("unit", "doc_id", "of", "text", "signs").repartition("unit").sortWithinPartitions("unit", "doc_id").mapInArrow(link, "node long, component long")


def near_duplicates(docs: DataFrame, least: int = 85, leaf: int = LEAF, block: int = BLOCK, most: int = UNIT_BYTES) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of each row; ``least``: hundredths of intersection over union.

    ``leaf``, ``block`` and ``most`` (bytes) bound the units of work; the result doesn't depend on them.
    """
    with Intermediates(docs.sparkSession) as made:
        signed, classes = _classes(docs, least, leaf, block, most)
        made.keep_only(signed, classes)
    out = signed.drop("signs", "size").join(classes, ["hi", "lo"], "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("of"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _classes(docs: DataFrame, least: int, leaf: int, block: int, most: int) -> tuple[DataFrame, DataFrame]:
    """(the signatures of each row; ``hi, lo, of``: each class and its component), both written."""
    signed = written(signatures(docs), "signatures")
    full = signed.where("n_shingles > 0")
    classes = full.groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"))
    reps = full.where(F.col("doc_id").isNotNull()).groupBy("hi", "lo").agg(F.min(F.struct("doc_id", "size", "signs")).alias("r"))
    reps = written(reps.select("r.*"), "classes")
    runs = written(sorted_orders(reps, leaf, most), "orders")
    regions = runs.where("NOT again").groupBy("region").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.max("crowded").alias("crowd")).where("first < last")
    # Tables of their own, here and for the classes: a join straight on an aggregate can't have its hot keys split.
    runs = written(runs.drop("crowded").join(written(regions.drop("last"), "regions"), "region"), "runs")
    areas = written(connected_components(runs.select(F.col("doc_id").alias("a"), F.col("first").alias("b"))), "areas")
    weighed = areas.join(reps.select(F.col("doc_id").alias("node"), "size"), "node").groupBy("component").agg(F.count("*").alias("members"), F.sum("size").alias("bytes"))
    fits = (F.col("members") <= leaf) & (F.col("bytes") <= most)
    areas = written(areas.join(written(weighed, "weighed"), "component").select(F.col("node").alias("doc_id"), "component", fits.alias("fits")), "areas")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isNotNull())
    signs = reps.select("doc_id", "signs")
    link = lambda units: _linked(text.join(units.join(signs, "doc_id").hint("merge"), "doc_id"), least)
    alone = F.col("doc_id").alias("of")
    units = areas.where("fits").select("doc_id", F.col("component").alias("unit"), alone)
    wide = written(runs.join(areas.where("NOT fits"), "doc_id", "left_semi"), "wide")
    if wide.isEmpty():
        found = link(units)
    else:
        units = units.unionByName(wide.where(F.col("tree") < FIRST).select("doc_id", "unit", alone).distinct())
        links = written(link(units).where("node <> component"), "links")
        units = _still_apart(wide, written(_components(links), "found"), block, most)
        found = _components(links.unionByName(link(units).where("node <> component")))
    joined_reps = found.where("node <> component").distinct()
    classes = classes.join(joined_reps, classes.rep == joined_reps.node, "left").select("hi", "lo", F.coalesce("component", "rep").alias("of"))
    return signed, written(classes, "class-components")


def _components(links: DataFrame) -> DataFrame:
    return connected_components(links.select(F.col("node").alias("a"), F.col("component").alias("b")))


def _still_apart(wide: DataFrame, found: DataFrame, block: int, most: int) -> DataFrame:
    """``doc_id, of, unit``: units in which any two of a region that lie in different components meet.

    A region's largest component and the others are cut into blocks apart: a block of the others meets every block, one
    of the largest component needn't meet its like. A small region of the first orders was compared whole before.
    """
    rows = wide.where(f"NOT again AND (crowd OR tree >= {FIRST})").select("region", "doc_id", "size").distinct()
    rows = written(rows.join(found, rows.doc_id == found.node, "left").select("doc_id", "region", "size", F.coalesce("component", "doc_id").alias("of")), "members")
    parts = written(rows.groupBy("region", "of").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")), "parts")
    whole = parts.groupBy("region").agg(F.max(F.struct("n", "bytes", "of")).alias("top"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).where("n > top.n")
    blocks = lambda n, size: F.greatest(F.lit(1), F.ceil(n / F.lit(block)), F.ceil(size * 2 / F.lit(most)))
    cut = whole.select("region", F.col("top.of").alias("largest"), blocks(F.col("n") - F.col("top.n"), F.col("bytes") - F.col("top.bytes")).alias("others"), blocks(F.col("top.n"), F.col("top.bytes")).alias("tops"))
    rows = rows.join(written(cut, "cut"), "region").withColumn("other", F.col("of") != F.col("largest"))
    place = F.xxhash64("region", "doc_id")
    rows = rows.withColumn("b", F.when(F.col("other"), F.pmod(place, F.col("others"))).otherwise(F.col("others") + F.pmod(place, F.col("tops"))))
    last = F.col("others") - 1 + F.when(F.col("other"), F.col("tops")).otherwise(0)
    rows = rows.select("doc_id", "of", "region", "b", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("c")).where("b <> c")
    return rows.select("doc_id", "of", F.xxhash64("region", F.least("b", "c"), F.greatest("b", "c")).alias("unit"))


def deduplicated(docs: DataFrame, least: int = 80) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the document of the smallest doc_id stays, as one row.

    Rows with a null doc_id can't be told apart by it and all stay.
    """
    dropped = written(near_duplicates(docs, least).where("NOT kept AND doc_id IS NOT NULL").select("doc_id").distinct(), "dropped")
    kept = docs.join(dropped.hint("merge"), "doc_id", "left_anti").select(docs.columns)
    repeated = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    if repeated.isEmpty():
        return kept
    once = kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.join(repeated, "doc_id", "left_anti").select(docs.columns).unionByName(once.select(docs.columns))
