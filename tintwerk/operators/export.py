"""Redacted output: page text with labels instead of hits, leak checks, neutral names, pixel rectangles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tintwerk.functions.spans import BIG
from tintwerk.functions.tables import met, numbered
from tintwerk.functions.text import collapsed, norm


def active(hits: DataFrame) -> DataFrame:
    """Hits that are switched on and have a place."""
    return hits.where("enabled AND size(rects) > 0")


def on_page(hits: DataFrame, page_no: int) -> DataFrame:
    return hits.where(F.col("page_no") == page_no)


# Widths of the printable ASCII characters in Helvetica, in thousandths of its size, from the blank on.
HELVETICA = [
    278, 278, 355, 556, 556, 889, 667, 191, 333, 333, 389, 584, 278, 333, 278, 278, 556, 556, 556, 556, 556, 556, 556, 556,
    556, 556, 278, 278, 584, 584, 584, 556, 1015, 667, 667, 722, 722, 667, 611, 778, 722, 278, 500, 667, 556, 833, 722, 778,
    667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 278, 278, 278, 469, 556, 333, 556, 556, 500, 556, 556, 278, 556,
    556, 222, 222, 500, 222, 833, 556, 556, 556, 556, 333, 500, 278, 556, 500, 722, 500, 500, 500, 334, 260, 334, 584,
]
LIKE = dict(zip("äöüÄÖÜß", "aouAOUg", strict=True))  # as wide as (ß nearly)


def text_width(text: Column) -> Column:
    """Width of a text in Helvetica of size 1; characters beyond ASCII and the umlauts are taken as wide as a digit."""
    plain = F.translate(text, "".join(LIKE), "".join(LIKE.values()))
    widths = F.array(*[F.lit(w) for w in HELVETICA])
    width = lambda c: F.when(F.ascii(c).between(32, 126), F.element_at(widths, F.greatest(F.lit(1), F.least(F.lit(95), F.ascii(c) - 31)))).otherwise(556)
    return F.aggregate(F.filter(F.split(plain, ""), lambda c: c != ""), F.lit(0), lambda a, c: a + width(c)) / 1000.0


def fitted_label(label: Column, short: Column, width: Column, height: Column) -> Column:
    """``struct<text, size>``: the label, or its short form where the label would be smaller than 4.5 points; as large as the box allows, 12 at most."""
    base = F.greatest(F.least(height * 0.72, F.lit(12.0)), F.lit(1.0))

    def size(text: Column) -> Column:
        full = text_width(text) * base
        return F.when(full > width - 2, base * F.greatest(width - 2, F.lit(1.0)) / full).otherwise(base)

    # A label without a shorter form stays at its full size where it can't be made to fit.
    return F.when(size(label) >= 4.5, F.struct(label.alias("text"), size(label).alias("size"))).when(short != label, F.struct(short.alias("text"), size(short).alias("size"))).otherwise(F.struct(label.alias("text"), base.alias("size")))


def redacted_text(text: Column, marks: Column) -> Column:
    """``text`` with ``[label]`` in the place of each mark (``array<struct<s, e, label>>``, disjoint, ascending)."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, m: Column) -> Column:
        return F.struct(m["e"].alias("at"), F.concat(a["out"], F.substring(text, a["at"] + 1, m["s"] - a["at"]), F.lit("["), m["label"], F.lit("]")).alias("out"))

    return F.aggregate(marks, start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.lit(BIG))))


def redact_pages(pages: DataFrame, hits: DataFrame) -> DataFrame:
    """``doc_id, page_no, redacted, redactions`` of pages (doc_id, page_no, text) under hits (doc_id, page_no, s, e, label, enabled)."""
    hits = active(hits) if "rects" in hits.columns else hits.where("enabled")
    marks = hits.groupBy("doc_id", "page_no").agg(F.array_sort(F.collect_list(F.struct("s", "e", "label"))).alias("marks"))
    out = met(pages.select("doc_id", "page_no", "text"), marks, ["doc_id", "page_no"], "left")
    none = F.array().cast("array<struct<s:int,e:int,label:string>>")
    out = out.withColumn("marks", F.coalesce("marks", none))
    return out.select("doc_id", "page_no", redacted_text(F.col("text"), F.col("marks")).alias("redacted"), F.size("marks").alias("redactions"))


def leaks(hits: DataFrame, redacted: DataFrame) -> DataFrame:
    """Hits whose text still stands on their redacted page: at least four normal characters, not just the label."""
    needle = norm(collapsed(F.col("text")))
    joined = met(hits.where("enabled"), redacted.select("doc_id", "page_no", norm(collapsed(F.col("redacted"))).alias("shown")), ["doc_id", "page_no"])
    return joined.where((F.length(needle) >= 4) & F.contains("shown", needle) & (needle != norm(F.col("label")))).select("doc_id", "page_no", "text", "label")


def neutral_stem(stem: Column, parts: Column) -> Column:
    """``stem`` with each part (``array<struct<part, label>>``) replaced by its label, the longest first, one after another, whatever its case."""
    order = F.array_sort(parts, lambda a, b: F.length(b["part"]) - F.length(a["part"]))
    quoted = lambda p: F.concat(F.lit(r"(?iu)\Q"), p, F.lit(r"\E"))
    shown = lambda label: F.regexp_replace(label, r"([\\$])", r"\\$1")
    out = F.aggregate(order, stem, lambda s, p: F.call_function("regexp_replace", s, quoted(p["part"]), shown(p["label"])))
    out = F.regexp_replace(out, r'[<>:"/\\|?*]', "_")
    return F.when(out == "", "Dokument").otherwise(out)


def name_parts(hits: DataFrame) -> DataFrame:
    """``doc_id, parts``: what a file name must not hold and its label; of equal parts the first hit's."""
    each = hits.where("enabled AND category <> 'manuell'").select("doc_id", "seq", "label", F.posexplode(F.split("text", r"[\s,;]+")).alias("i", "part"))
    each = each.withColumn("part", F.btrim("part", F.lit(".,;:()[]\"'"))).where(F.when(F.rlike("part", F.lit(r"^\d+$")), F.length("part") >= 4).otherwise(F.length("part") >= 3))
    first = each.groupBy("doc_id", "part").agg(F.min(F.struct("seq", "i", "label")).alias("x"))
    label = F.replace(F.replace(F.col("x.label"), F.lit(" "), F.lit("-")), F.lit("/"), F.lit("-"))
    return first.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("x.seq").alias("seq"), F.col("x.i").alias("i"), "part", label.alias("label")))).alias("parts"))


def output_path(folder: Column, stem: Column, suffix: str = "_geschwärzt") -> Column:
    return F.concat(folder, F.lit("/"), stem, F.lit(suffix + ".pdf"))


def unique_targets(targets: DataFrame, order: str = "doc_id") -> DataFrame:
    """``target`` of each row; if any two are equal, every one gets its number. The numbers come from ranges of ``order``, not from one sort."""
    n, distinct = targets.agg(F.count("*"), F.count_distinct("target")).first()
    if n == distinct:
        return targets
    stem = F.regexp_replace("target", r"(\.pdf)$", F.lit(""))
    return numbered(targets, order, "_n").withColumn("target", F.concat(stem, F.lit("_"), F.col("_n").cast("string"), F.lit(".pdf"))).drop("_n")


def pixel_rect(x0: Column, y0: Column, x1: Column, y1: Column, dpi: int, width: Column, height: Column) -> Column:
    """A rectangle in points as whole pixels that cover it, cut at the image's edges."""
    scale = dpi / 72.0
    low = lambda v: F.greatest(F.lit(0), F.floor(v * scale))
    high = lambda v, most: F.least(most, F.ceil(v * scale))
    return F.struct(low(x0).alias("x0"), low(y0).alias("y0"), high(x1, width).alias("x1"), high(y1, height).alias("y1"))


def export_summary(hits: DataFrame, redacted: DataFrame, leaked: DataFrame) -> DataFrame:
    """``doc_id, pages, redactions, warnings``."""
    pages = redacted.groupBy("doc_id").agg(F.count("*").alias("pages"), F.sum("redactions").alias("redactions"))
    return pages.join(leaked.groupBy("doc_id").agg(F.count("*").alias("warnings")), "doc_id", "left").fillna(0, ["warnings"])


def guard_overwrite(source: str, target: str) -> str:
    from pathlib import PurePosixPath

    if PurePosixPath(source) == PurePosixPath(target):
        raise ValueError("the original must not be overwritten")
    return target
