"""Pages and words: text, offsets, segments and rectangles as column expressions, windows and vectorised Arrow passes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tintwerk import enums
from tintwerk.functions.tables import met
from tintwerk.schemas import WORD


def _counted(n: np.ndarray) -> np.ndarray:
    """0..c-1 for each count c, one after another."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n)


def _list_of(counts: np.ndarray, fields: dict[str, pa.Array | np.ndarray], mask: pa.Array | None = None) -> pa.Array:
    values = pa.StructArray.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in fields.values()], list(fields))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values, mask=mask)


def _whole(x: pa.Array | pa.ChunkedArray) -> pa.Array:
    return x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x


SLICE_BYTES = 1 << 20


def _in_slices(run: Callable[[pa.Array], pa.Array], kind: str, size: Callable[[pa.Array], pa.Array]) -> Callable[[Column], Column]:
    """``run`` over slices of an Arrow batch of some ``SLICE_BYTES``: places take many times a text's bytes, and a batch's rows have no bound in bytes."""

    def over(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            part = np.cumsum(np.asarray(pc.fill_null(size(b), 0)).astype(np.int64)) // SLICE_BYTES
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(b)] if len(b) else []
            for a, z in zip(cuts, cuts[1:]):
                yield run(b.slice(a, z - a))

    return F.arrow_udf(over, kind)


def page_words(text: Column, char_width: float = 6.0, line_height: float = 14.0) -> Column:
    """``array<word>`` of plain text with synthetic geometry: a line for each line, fixed character widths, from (50, 50).

    One vectorised pass over the Arrow batch: places are running sums over a page, which column expressions could only build by copying.
    """

    def run(text: pa.Array) -> pa.Array:
        text = pc.fill_null(text, "")
        lines = pc.split_pattern(text, "\n")
        per_page = np.asarray(pc.list_value_length(lines))
        parts = pc.split_pattern_regex(_whole(pc.list_flatten(lines)), r"[\t\n\x0b\f\r ]+")
        per_line = np.asarray(pc.list_value_length(parts))
        word = _whole(pc.list_flatten(parts))
        size = np.asarray(pc.utf8_length(word))
        some = np.flatnonzero(size > 0)
        word, size, line = word.take(pa.array(some)), size[some].astype(np.int64), np.repeat(np.arange(len(per_line)), per_line)[some]
        at = np.cumsum(size + 1) - size - 1
        first = np.ones(len(line), bool)
        first[1:] = line[1:] != line[:-1]
        x0 = 50.0 + char_width * (at - np.maximum.accumulate(np.where(first, at, 0)))
        number = _counted(per_page)[line]
        y0 = 50.0 + line_height * number
        counts = np.bincount(np.repeat(np.arange(len(per_page)), per_page)[line], minlength=len(per_page))
        return _list_of(counts, {"text": word, "line": number.astype(np.int32), "x0": x0, "y0": y0, "x1": x0 + char_width * size, "y1": y0 + 10.0})

    return _in_slices(run, f"array<{WORD}>", pc.binary_length)(text)


def page_text(words: Column) -> Column:
    """Words joined by a blank within a line, by a line break between lines; linear in the words."""
    before = lambda i: F.get(words, i - 1)["line"]
    mark = lambda w, i: F.when(i == 0, "").when(before(i).eqNullSafe(w["line"]), " ").otherwise("\n")
    return F.coalesce(F.array_join(F.transform(words, lambda w, i: F.concat(mark(w, i), w["text"])), ""), F.lit(""))


def word_spans(words: Column) -> Column:
    """``array<struct<word, s, e>>``: where each word lies in the page's text; one vectorised pass over the Arrow batch."""

    def run(words: pa.Array) -> pa.Array:
        counts = np.asarray(pc.fill_null(pc.list_value_length(words), 0)).astype(np.int64)
        texts = pc.list_flatten(words)
        size = np.asarray(pc.utf8_length(_whole(pc.struct_field(texts, "text")))).astype(np.int64)
        at = np.cumsum(size + 1) - size - 1
        ends = np.cumsum(counts)
        s = at - np.repeat(np.append(at, 0)[np.minimum(ends - counts, len(at))], counts)
        return _list_of(counts, {"word": _counted(counts).astype(np.int32), "s": s.astype(np.int32), "e": (s + size).astype(np.int32)}, pc.is_null(words) if words.null_count else None)

    return _in_slices(run, "array<struct<word:int,s:int,e:int>>", lambda w: pc.multiply(pc.list_value_length(w), 8))(words)


def segments_at(spans: Column, s: Column, e: Column) -> Column:
    """Segments of the words that [s, e) touches; a word that it covers has no character range."""
    touched = F.filter(spans, lambda w: (w["e"] > s) & (w["s"] < e))

    def segment(w: Column) -> Column:
        a, b, whole = F.greatest(s, w["s"]) - w["s"], F.least(e, w["e"]) - w["s"], (s <= w["s"]) & (e >= w["e"])
        return F.struct(w["word"].alias("word"), F.when(~whole, a).alias("c0"), F.when(~whole, b).alias("c1"))

    return F.transform(touched, segment)


def exploded(pages: DataFrame) -> DataFrame:
    """A row for each word: its number, text, line, normal form, offsets and box; offsets by a running sum over the page."""
    words = pages.select("case_id", "doc_id", "page_no", F.posexplode("words").alias("word_no", "w"))
    order = Window.partitionBy("case_id", "doc_id", "page_no").orderBy("word_no")
    start = F.coalesce(F.sum(F.length("w.text") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    return words.select("case_id", "doc_id", "page_no", "word_no", F.col("w.line").alias("line_no"), F.col("w.text").alias("text"), start.alias("start"), (start + F.length("w.text")).alias("end"), F.struct("w.x0", "w.y0", "w.x1", "w.y1").alias("bbox"))


def trimmed_span(text: Column) -> Column:
    """``struct<c0, c1>``: a text without punctuation at its edges; all of it if there is nothing else."""
    front = F.length(text) - F.length(F.ltrim(text, F.lit(enums.HIT_EDGE)))
    back = F.length(F.rtrim(text, F.lit(enums.HIT_EDGE)))
    blank = front == F.length(text)
    return F.struct(F.when(blank, 0).otherwise(front).alias("c0"), F.when(blank, F.length(text)).otherwise(back).alias("c1"))


def char_weight(c: Column) -> Column:
    """Relative width of a character."""
    in_set = lambda chars: F.instr(F.lit(chars), c) > 0
    return F.when(in_set(enums.NARROW), 0.45).when(in_set(enums.WIDE), 1.35).when(F.rlike(c, F.lit(r"[\p{Lu}\p{Nd}]")), 1.1).otherwise(1.0)


def part_range(text: Column, x0: Column, x1: Column, c0: Column, c1: Column) -> Column:
    """``struct<x0, x1>`` of a word's characters [c0, c1), a little wider at cut edges."""
    total = lambda t: F.aggregate(F.filter(F.split(t, ""), lambda c: c != ""), F.lit(0.0), lambda a, c: a + char_weight(c))
    unit = (x1 - x0) / F.greatest(total(text), F.lit(1e-9))
    left = x0 + unit * total(F.substring(text, F.lit(1), c0)) - F.when(c0 > 0, unit * 0.45).otherwise(0.0)
    right = x0 + unit * total(F.substring(text, F.lit(1), c1)) + F.when(c1 < F.length(text), unit * 0.45).otherwise(0.0)
    return F.struct(F.greatest(x0, left).alias("x0"), F.least(x1, right).alias("x1"))


def line_rects(words: DataFrame, hits: DataFrame, width: float = 595.0, height: float = 842.0) -> DataFrame:
    """A padded rectangle for each (hit, line) of whole words: ``hits`` has (doc_id, page_no, hit, word_no), ``words`` the boxes."""
    usual = words.groupBy("doc_id", "page_no", "line_no").agg(F.median(F.col("bbox.y1") - F.col("bbox.y0")).alias("usual"))
    box = met(hits, words, ["doc_id", "page_no", "word_no"]).groupBy("doc_id", "page_no", "hit", "line_no").agg(F.min("bbox.x0").alias("x0"), F.min("bbox.y0").alias("y0"), F.max("bbox.x1").alias("x1"), F.max("bbox.y1").alias("y1"))
    box = met(box, usual, ["doc_id", "page_no", "line_no"]).withColumn("more", F.greatest(F.lit(0.0), F.col("usual") - (F.col("y1") - F.col("y0"))) / 2)
    box = box.withColumn("y0", F.col("y0") - F.col("more")).withColumn("y1", F.col("y1") + F.col("more"))
    box = box.withColumn("h", F.greatest(F.col("y1") - F.col("y0"), F.col("usual")))
    dy, dx = F.greatest(F.lit(1.0), F.col("h") * 0.12), F.greatest(F.lit(1.2), F.col("h") * 0.08)
    zero = F.lit(0.0)
    return box.select("doc_id", "page_no", "hit", "line_no", F.greatest(zero, F.col("x0") - dx).alias("x0"), F.greatest(zero, F.col("y0") - dy).alias("y0"), F.least(F.lit(width), F.col("x1") + dx).alias("x1"), F.least(F.lit(height), F.col("y1") + dy).alias("y1"))


def words_in_rect(words: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """Words whose centre lies in a rectangle."""
    x, y = (F.col("bbox.x0") + F.col("bbox.x1")) / 2, (F.col("bbox.y0") + F.col("bbox.y1")) / 2
    return words.where(x.between(x0, x1) & y.between(y0, y1))


def word_at(words: DataFrame, x: float, y: float) -> DataFrame:
    """The first word of each page whose box, one point wider, holds a point."""
    near = F.lit(x).between(F.col("bbox.x0") - 1, F.col("bbox.x1") + 1) & F.lit(y).between(F.col("bbox.y0") - 1, F.col("bbox.y1") + 1)
    return words.where(near).groupBy("doc_id", "page_no").agg(F.min_by(F.struct("word_no", "text"), "word_no").alias("w")).select("doc_id", "page_no", "w.word_no", "w.text")


def native_words(raw: DataFrame) -> DataFrame:
    """Words of a text layer (page_key, pos, text, x0, y0, x1, y1, block, line): trimmed, drawn-twice ones once, lines numbered as first seen."""
    page = Window.partitionBy("page_key")
    kept = raw.withColumn("text", F.trim("text")).where("text <> ''")
    same = Window.partitionBy("page_key", "text", F.bround("x0"), F.bround("y0")).orderBy("pos")
    kept = kept.withColumn("nth", F.row_number().over(same)).where("nth = 1").drop("nth")
    kept = kept.withColumn("first", F.min("pos").over(Window.partitionBy("page_key", "block", "line")))
    return kept.withColumn("line_no", F.dense_rank().over(page.orderBy("first")) - 1).drop("first")


def needs_recognition(text: Column, coverage: Column, mode: str = "auto") -> Column:
    """Whether a page's text layer is not good enough: little text, mostly an image, or many broken characters."""
    if mode != "auto":
        return F.lit(mode == "immer")
    bare = F.trim(text)
    broken = F.length(F.regexp_replace(bare, r"[^\x{FFFD}\x00-\x08\x0B\x0C\x0E-\x1F]", ""))
    return (F.length(bare) < 30) | (coverage > 0.5) | (broken > 0.05 * F.length(bare))
