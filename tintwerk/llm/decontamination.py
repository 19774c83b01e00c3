"""Benchmark decontamination by pigeonhole edit matching.

Texts are normalised (Unicode lower case, white space runs as one blank). A test item of n characters may differ from a passage in
``budget(n)`` edits; cut into one piece more than that, it leaves at least one piece untouched, so a passage within the
budget has an exact piece hit. An item of fewer than ``LEAST`` characters would match by chance within other words, so its budget is 0
and it counts only between the edges of words: exact copies of short items are found, too. An Aho-Corasick automaton over the pieces of a block of items finds the hits in one pass
over each whole text; each hit fixes where the item can lie, and overlapping places are merged and verified by Myers'
bit-parallel edit distance, with the item as one big integer.

The items are the stated query set: they are read in blocks of ``BLOCK_CHARS`` characters, each block is shipped with the
task closure, and the documents are scanned once for each block, without a shuffle.

Defined cases: a null or empty text has no hit; an item that is null, empty or white space is not looked for; equal items each have their own hits; repeated documents each have theirs; extra
columns are ignored; an empty table of documents or items gives no hit.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARE = 0.06  # edits for each character
LEAST = 40
BLOCK_CHARS = 4 << 20


def budget(n: int, share: float = SHARE) -> int:
    return int(n * share) if n >= LEAST else 0


def normalised(text: str) -> str:
    return " ".join(text.lower().split())


def pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """(offset, piece) of edits + 1 pieces of near-equal lengths."""
    cuts = [len(item) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Pattern:
    """Myers' bit-parallel matching of one item."""

    def __init__(self, item: str):
        self.n = len(item)
        self.masks: dict[str, int] = {}
        for i, c in enumerate(item):
            self.masks[c] = self.masks.get(c, 0) | 1 << i
        self.full, self.top = (1 << self.n) - 1, 1 << self.n - 1

    def best(self, text: str) -> tuple[int, int]:
        """The least edit distance of the item to any substring of ``text``, and the first end where it is reached."""
        full, top, masks = self.full, self.top, self.masks
        plus, minus, score = full, 0, self.n
        least, end = score, 0
        for i, c in enumerate(text, 1):
            eq = masks.get(c, 0)
            x = eq | minus
            diagonal = (((eq & plus) + plus) ^ plus) | x
            up = minus | ~(diagonal | plus) & full
            down = plus & diagonal
            if up & top:
                score += 1
            elif down & top:
                score -= 1
            up = up << 1 & full
            down = down << 1 & full
            plus = down | ~(diagonal | up) & full
            minus = up & diagonal
            if score < least:
                least, end = score, i
        return least, end


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    block, held = [], 0
    for r in items.select("item_id", "text").where("text IS NOT NULL").toLocalIterator():
        text = normalised(r.text)
        if not text:
            continue
        block.append((r.item_id, text))
        held += len(text)
        if held >= BLOCK_CHARS:
            yield block
            block, held = [], 0
    if block:
        yield block


class Searcher:
    def __init__(self, block: list[tuple[int, str]], share: float):
        import ahocorasick

        self.items = block
        self.edits = [budget(len(t), share) for _, t in block]
        self.patterns = [Pattern(t) for _, t in block]
        self.automaton = ahocorasick.Automaton()
        ends: dict[str, list[tuple[int, int]]] = {}
        for k, (_, text) in enumerate(block):
            for at, piece in pieces(text, self.edits[k]):
                ends.setdefault(piece, []).append((k, at + len(piece)))
        for piece, places in ends.items():
            self.automaton.add_word(piece, places)
        self.automaton.make_automaton()

    def hits(self, raw: str) -> Iterator[tuple[int, int, int]]:
        """(item, distance, end in the normalised text) of the best place of each item within its budget."""
        text = normalised(raw)
        places: dict[int, list[tuple[int, int]]] = {}
        for end, found in self.automaton.iter(text):
            for k, upto in found:
                start = end + 1 - upto
                e = self.edits[k]
                n = len(self.items[k][1])
                if n < LEAST and (text[start - 1 : start].isalnum() and start > 0 or text[start + n : start + n + 1].isalnum()):
                    continue
                places.setdefault(k, []).append((start - e, start + n + e))
        for k, spans in places.items():
            spans.sort()
            best = None
            at = 0
            while at < len(spans):
                low, high = spans[at]
                at += 1
                while at < len(spans) and spans[at][0] <= high:
                    high = max(high, spans[at][1])
                    at += 1
                low = max(low, 0)
                distance, end = self.patterns[k].best(text[low:high])
                if distance <= self.edits[k] and (best is None or distance < best[0]):
                    best = distance, low + end
                    if not distance:
                        break
            if best:
                yield k, *best


def matches(docs: DataFrame, items: DataFrame, share: float = SHARE) -> DataFrame:
    """``doc_id, item_id, distance, allowed, end`` of every document that holds an item within its budget, at its best place."""
    out = None
    schema = "doc_id long, item_id long, distance int, allowed int, end long"
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    for block in _blocks(items):

        def search(batches: Iterator[pa.RecordBatch], block: list = block) -> Iterator[pa.RecordBatch]:
            s = Searcher(block, share)
            for b in batches:
                rows = []
                for d, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    if text:
                        rows += [(d, s.items[k][0], distance, s.edits[k], end) for k, distance, end in s.hits(text)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["doc_id", "item_id", "distance", "allowed", "end"])

        found = narrow.mapInArrow(search, schema)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def cleaned(docs: DataFrame, items: DataFrame, share: float = SHARE) -> DataFrame:
    """The rows of ``docs`` that hold no item: a filter in one pass for each block of items, without a shuffle."""
    names = docs.columns
    for block in _blocks(items):

        def keep(batches: Iterator[pa.RecordBatch], block: list = block) -> Iterator[pa.RecordBatch]:
            s = Searcher(block, share)
            for b in batches:
                clean = [not text or next(s.hits(text), None) is None for text in b.column(names.index("text")).to_pylist()]
                if any(clean):
                    yield b.filter(pa.array(clean))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
