"""Plausibility of recognised text and regions, line bands, orientation, and mapping of coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Fixed patterns.
PLAUSIBLE = r'^[(\"„]?(?:[A-Za-zÄÖÜäöüß][a-zäöüß]{2,}(?:-[A-Za-zÄÖÜäöüß][a-zäöüß]+)?|[A-ZÄÖÜ]{3,}|\d{2,}(?:[./\-]\d+)*)[.,;:!?)\"“]?$'

GOOD = r"^[A-Za-zÄÖÜäöüß][a-zäöüß]{2,}[.,;:!?)]?$"


def text_quality(words: DataFrame) -> DataFrame:
    """How many words of each page look like words: a measure of how well it was read."""
    return words.groupBy("page_key").agg(F.count_if(F.rlike("text", F.lit(GOOD))).alias("quality"))


def plausible_word(text: Column) -> Column:
    """Whether a word looks like print, not like misread handwriting: its shape, a vowel from 4 letters, three different ones from 5."""
    core = F.btrim(text, F.lit(".,;:!?()\"„“"))
    letters = F.rlike(core, F.lit(r"^\p{L}+$"))
    different = F.size(F.array_distinct(F.filter(F.split(F.lower(core), ""), lambda c: c != "")))
    dull = letters & ((F.length(core) >= 4) & ~F.rlike(core, F.lit("[aeiouyäöüAEIOUYÄÖÜ]")) | (F.length(core) >= 5) & (different < 3))
    return F.rlike(text, F.lit(PLAUSIBLE)) & ~dull


def plausible_geometry(text: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Whether a word's box is as wide as its characters need."""
    h = F.greatest(y1 - y0, F.lit(1.0))
    return ((x1 - x0) / F.greatest(F.length(text), F.lit(1))).between(0.15 * h, 1.3 * h)


def upper_median(values: Column) -> Column:
    """The middle value of an array, the upper one of two."""
    ordered = F.array_sort(values)
    return F.element_at(ordered, F.floor(F.size(ordered) / 2).cast("int") + 1)


def plausible_regions(words: DataFrame, reference: float | None) -> DataFrame:
    """``region, plausible`` of words (region, text, x0, y0, x1, y1): half of them look like print, in letters not much larger than ``reference``."""
    good = plausible_word(F.col("text")) & plausible_geometry(F.col("text"), F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    rows = words.groupBy("region").agg(F.count("*").alias("n"), F.count_if(good).alias("good"), F.collect_list(F.col("y1") - F.col("y0")).alias("heights"))
    ok = F.col("good") >= 0.5 * F.col("n")
    if reference:
        ok = ok & (upper_median(F.col("heights")) <= 1.6 * reference)
    return rows.select("region", ok.alias("plausible"))


def usual_height(words: DataFrame) -> DataFrame:
    """Upper median height of each page's plausible words, from three on."""
    good = words.where(plausible_word(F.col("text")) & plausible_geometry(F.col("text"), F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")))
    rows = good.groupBy("page_key").agg(F.collect_list(F.col("y1") - F.col("y0")).alias("h"))
    return rows.select("page_key", F.when(F.size("h") >= 3, upper_median(F.col("h"))).alias("height"))


def bands(profile: DataFrame, least: int, gap: int) -> DataFrame:
    """Runs [start, end) of each profile (key, pos, value) at ``least`` or above, bridged over gaps of up to ``gap``: gaps and islands."""
    order = Window.partitionBy("key").orderBy("pos")
    rows = profile.where(F.col("value") >= least)
    rows = rows.withColumn("new", F.coalesce((F.col("pos") - F.lag("pos").over(order) > gap + 1).cast("int"), F.lit(1)))
    rows = rows.withColumn("band", F.sum("new").over(order))
    return rows.groupBy("key", "band").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end")).drop("band")


def unread_region(dpi: int, width: Column, height: Column, bw: Column, bh: Column, count: Column, touches: Column, step: int = 4) -> Column:
    """Whether an ink blob (``bw`` x ``bh`` pixels, ``count`` cells of ``step`` pixels inked) may be handwriting or a stamp."""
    cells = F.greatest((bw / step) * (bh / step), F.lit(1))
    density, area = count / cells, bw * bh / (width * height)
    speck = (bw < dpi * 0.12) | (bh < dpi * 0.06) | (count * step * step < (dpi / 18) ** 2)
    line = (bh < dpi * 0.05) & (bw > 6 * bh) | (bw < dpi * 0.05) & (bh > 6 * bw)
    picture = (density > 0.8) | (area > 0.2) | (area > 0.04) & (density > 0.55) | (density < 0.03)
    border = touches & ((bw > 0.5 * width) | (bh > 0.5 * height))
    return ~(speck | line | picture | border)


def orientation(base_quality: Column, base_count: Column, q90: Column, q180: Column, q270: Column) -> Column:
    """0, 90, 180 or 270: a turn that reads at least twice as well as the page as it is (and ten words)."""
    best = F.greatest(q90, q180, q270)
    turn = F.when(q90 == best, 90).when(q180 == best, 180).otherwise(270)
    return F.when((base_quality >= 3) & (base_quality >= 0.45 * base_count), 0).when((best > base_quality) & (best >= F.greatest(F.lit(10), 2 * base_quality)), turn).otherwise(0)


def image_coverage(images: DataFrame) -> DataFrame:
    """Share of each page (width, height) that its largest image covers; boxes are cut at the page."""
    w = F.greatest(F.lit(0.0), F.least("x1", "width") - F.greatest("x0", F.lit(0.0)))
    h = F.greatest(F.lit(0.0), F.least("y1", "height") - F.greatest("y0", F.lit(0.0)))
    return images.groupBy("page_key").agg((F.max(w * h) / F.greatest(F.max(F.col("width") * F.col("height")), F.lit(1.0))).alias("coverage"))


def rotated_box(x0: Column, y0: Column, x1: Column, y1: Column, degrees: float, width: Column, height: Column) -> Column:
    """The upright box, in an image, of a box found after the image was turned by ``degrees`` about its centre."""
    cos, sin = F.cos(F.radians(F.lit(-degrees))), F.sin(F.radians(F.lit(-degrees)))
    corners = [(x - width / 2, y - height / 2) for x in (x0, x1) for y in (y0, y1)]
    xs = [width / 2 + cos * dx + sin * dy for dx, dy in corners]
    ys = [height / 2 - sin * dx + cos * dy for dx, dy in corners]
    return F.struct(F.least(*xs).alias("x0"), F.least(*ys).alias("y0"), F.greatest(*xs).alias("x1"), F.greatest(*ys).alias("y1"))
