"""Grey and colour images of pages as rows ``page_key, width, height, pixels`` (row by row, 8 bits): skew, background, lines, unread ink.

NumPy inside Arrow batches, an image at a time; decisions about what was found are column expressions (``recognition``). Rendering
pages and reading characters need libraries from outside; ``reread`` takes the reader as a function.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tintwerk.operators.recognition import unread_region

CELL = 4  # pixels of a cell's side where ink is looked for
DARK = 150  # a darker cell is ink
Reader = Callable[[np.ndarray], list[tuple[str, float, float, float, float, int]]]


def image_of(row: dict) -> np.ndarray:
    return np.frombuffer(row["pixels"], np.uint8).reshape(row["height"], row["width"])


def _each(images: DataFrame, columns: list[str], schema: str, work: Callable[[dict], Iterator[tuple]]) -> DataFrame:
    """The rows that ``work`` makes of each image."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                rows = list(work(b.slice(i, 1).to_pylist()[0]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return images.select(*columns).mapInArrow(run, schema)


def shrunk(a: np.ndarray, by: int) -> np.ndarray:
    """Means of cells of ``by`` x ``by`` pixels; what is left at the edges goes, unless there is nothing else."""
    h, w = max(1, a.shape[0] // by), max(1, a.shape[1] // by)
    return a[: h * by, : w * by].reshape(h, min(by, a.shape[0]), w, min(by, a.shape[1])).mean((1, 3))


def skew_of(a: np.ndarray, most: float = 6.0) -> float:
    """Degrees, counter-clockwise, by which to turn an image so that its lines lie level: the turn whose rows of ink vary most.

    Only the ink's places are turned, not the image; first in steps of half a degree, then of a tenth around the best.
    """
    ink = shrunk(a, -(-max(a.shape) // 1000)) < 160
    if ink.mean() < 0.002:
        return 0.0
    y, x = np.nonzero(ink)
    h, w = ink.shape
    y, x = y - h / 2, x - w / 2

    def spread(angle: float) -> float:
        t = np.radians(angle)
        rows = np.floor(y * np.cos(t) - x * np.sin(t) + h / 2).astype(np.int64)
        return float(np.bincount(rows[(rows >= 0) & (rows < h)], minlength=h).var())

    best = 0.0
    for step, around in ((0.5, most), (0.1, 0.5)):
        turns = best + np.arange(-around, around + 1e-6, step)
        best = max([best, *turns.tolist()], key=lambda t: (round(spread(t), 6), -abs(t)))
    return round(best, 2)


def _widest(a: np.ndarray, reach: int) -> np.ndarray:
    """The largest value within ``reach`` on either side, along both axes."""
    for axis in (0, 1):
        edge = [(reach, reach) if k == axis else (0, 0) for k in (0, 1)]
        a = np.lib.stride_tricks.sliding_window_view(np.pad(a, edge, mode="edge"), 2 * reach + 1, axis=axis).max(-1)
    return a


def _blurred(a: np.ndarray, sigma: float) -> np.ndarray:
    reach = int(3 * sigma)
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    for axis in (0, 1):
        edge = [(reach, reach) if k == axis else (0, 0) for k in (0, 1)]
        a = np.lib.stride_tricks.sliding_window_view(np.pad(a, edge, mode="edge"), 2 * reach + 1, axis=axis) @ (weights / weights.sum())
    return a


def _stretched(a: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    for axis, n in enumerate(shape):
        at = (np.arange(n) + 0.5) * a.shape[axis] / n - 0.5
        low = np.clip(np.floor(at).astype(int), 0, a.shape[axis] - 1)
        high, part = np.minimum(low + 1, a.shape[axis] - 1), np.clip(at - low, 0, 1)
        part = part[:, None] if axis == 0 else part[None, :]
        a = np.take(a, low, axis) * (1 - part) + np.take(a, high, axis) * part
    return a


def cleared(a: np.ndarray) -> np.ndarray:
    """An image with its background made white, if it isn't even and light, and with faint writing made dark."""
    ground = _blurred(_widest(shrunk(a, 8), 4), 6.0)
    low, high = np.percentile(ground, [5, 95])
    out = a.astype(np.float32)
    if not (high - low < 25 and low > 215):
        out = np.floor(np.clip(out / np.maximum(_stretched(ground, a.shape), 1.0) * 255.0, 0, 255))
    dark = out[out < 170]
    if len(dark) >= 100 and (least := float(np.percentile(dark, 5))) > 50:
        out = np.clip((out - least) * (255.0 / (255.0 - least)), 0, 255)
    return out.astype(np.uint8)


def without_lines(ink: np.ndarray, least: int) -> np.ndarray:
    """Ink without straight runs of ``least`` cells or more, along the columns first, then along the rows of what is left."""
    out = ink.copy()
    for turned in (out, out.T):
        flat = np.pad(turned, ((0, 0), (1, 1))).ravel().astype(np.int8)
        edge = np.diff(flat, prepend=0)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        long = end - start >= least
        gone = np.zeros(len(flat) + 1, np.int32)
        np.add.at(gone, start[long], 1)
        np.add.at(gone, end[long], -1)
        turned[(np.cumsum(gone[:-1]) > 0).reshape(turned.shape[0], -1)[:, 1:-1]] = False
    return out


def runs(filled: np.ndarray, gap: int = 0) -> list[tuple[int, int]]:
    """Ranges [start, end) of a profile above 0, bridged over gaps of up to ``gap``."""
    at = np.flatnonzero(filled)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > gap + 1)
    return list(zip(at[np.append(0, cut + 1)].tolist(), (at[np.append(cut, len(at) - 1)] + 1).tolist(), strict=True))


def _bare(row: dict, pad: int) -> np.ndarray:
    """Cells of ink that no word covers."""
    ink = shrunk(image_of(row), CELL) < DARK
    for w in row["words"] or []:
        x0, y0, x1, y1 = (int(w[k] / CELL) for k in ("x0", "y0", "x1", "y1"))
        ink[max(0, y0 - pad) : y1 + pad + 1, max(0, x0 - pad) : x1 + pad + 1] = False
    return ink


BOX = "page_key long, nth int, x0 int, y0 int, x1 int, y1 int"


def skews(images: DataFrame) -> DataFrame:
    """``page_key, angle``."""
    return _each(images, ["page_key", "width", "height", "pixels"], "page_key long, angle double", lambda r: iter([(r["page_key"], skew_of(image_of(r)))]))


def clear_backgrounds(images: DataFrame) -> DataFrame:
    """``page_key, width, height, pixels`` with white backgrounds."""
    return _each(images, ["page_key", "width", "height", "pixels"], "page_key long, width int, height int, pixels binary", lambda r: iter([(r["page_key"], r["width"], r["height"], cleared(image_of(r)).tobytes())]))


def unread_regions(images: DataFrame, dpi: int = 300, most: int = 60) -> DataFrame:
    """``page_key, nth, x0, y0, x1, y1`` (pixels) of ink that belongs to no word of ``words`` (array of boxes in pixels): handwriting, stamps.

    As in the display that it is for, at most ``most`` of a page, from the top.
    """

    def blobs(r: dict) -> Iterator[tuple]:
        rest = without_lines(_bare(r, max(2, dpi // 120)), max(3, int(dpi * 0.6 / CELL)))
        if rest.sum() < 20:
            return
        grown = _widest(rest, max(1, int(dpi / 25 / CELL)))
        edge, n = int(dpi * 0.06 / CELL), 0
        for top, bottom in runs(grown.any(1)):
            for left, right in runs(grown[top:bottom].any(0)):
                y, x = np.nonzero(rest[top:bottom, left:right])
                if not len(y):
                    continue
                y0, y1, x0, x1 = top + int(y.min()), top + int(y.max()) + 1, left + int(x.min()), left + int(x.max()) + 1
                touches = x0 <= edge or y0 <= edge or x1 >= rest.shape[1] - edge or y1 >= rest.shape[0] - edge
                yield r["page_key"], n, x0 * CELL, y0 * CELL, x1 * CELL, y1 * CELL, len(y), touches, r["width"], r["height"]
                n += 1

    found = _each(images, ["page_key", "width", "height", "pixels", "words"], BOX + ", ink int, touches boolean, width int, height int", blobs)
    found = found.where(unread_region(dpi, F.col("width"), F.col("height"), F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.col("ink"), F.col("touches"), CELL))
    nth = F.row_number().over(Window.partitionBy("page_key").orderBy("nth")) - 1
    found, m, zero = found.withColumn("nth", nth).where(F.col("nth") < most), dpi // 30, F.lit(0)
    return found.select("page_key", "nth", F.greatest(zero, F.col("x0") - m).alias("x0"), F.greatest(zero, F.col("y0") - m).alias("y0"), F.least("width", F.col("x1") + m).alias("x1"), F.least("height", F.col("y1") + m).alias("y1"))


def missed_regions(row: dict, dpi: int, most: int = 40) -> list[tuple[int, int, int, int]]:
    """Boxes in pixels of what looks like a line of text and belongs to no word, from the top; at most ``most`` of a page."""
    rest, least = _bare(row, max(2, dpi // 150)), max(2, dpi // 100)
    out: list[tuple[int, int, int, int]] = []
    if rest.sum() < 15:
        return out
    for top, bottom in runs(rest.any(1), 1):
        if not least <= bottom - top <= int(dpi / 2.5 / CELL):
            continue
        for left, right in runs(rest[top:bottom].any(0), int(dpi / 20 / CELL)):
            if right - left >= 2 * least and rest[top:bottom, left:right].sum() >= 12:
                m = dpi // 15
                out.append((max(0, left * CELL - m), max(0, top * CELL - m), min(row["width"], right * CELL + m), min(row["height"], bottom * CELL + m)))
    return out[:most]


def reread(images: DataFrame, reader: Reader, dpi: int = 300) -> DataFrame:
    """``page_key, region, text, x0, y0, x1, y1, line``: words that ``reader`` finds in regions that no word of ``words`` covers.

    A region is read with a white margin; its lines get numbers behind those of the page's words.
    """

    def work(r: dict) -> Iterator[tuple]:
        a, m = image_of(r), dpi // 15
        line = 1 + max((w["line"] for w in r["words"] or []), default=-1)
        for n, (x0, y0, x1, y1) in enumerate(missed_regions(r, dpi)):
            of: dict[int, int] = {}
            for text, wx0, wy0, wx1, wy1, own in reader(np.pad(a[y0:y1, x0:x1], m, constant_values=255)):
                of.setdefault(own, line + len(of))
                yield r["page_key"], n, text, wx0 + x0 - m, wy0 + y0 - m, wx1 + x0 - m, wy1 + y0 - m, of[own]
            line += len(of)

    return _each(images, ["page_key", "width", "height", "pixels", "words"], "page_key long, region int, text string, x0 double, y0 double, x1 double, y1 double, line int", work)


def coloured(images: DataFrame) -> DataFrame:
    """``page_key, colour`` of images with three bytes a pixel: whether over one in a hundred of some 4 000 pixels, evenly taken, is colourful."""

    def work(r: dict) -> Iterator[tuple]:
        p = np.frombuffer(r["pixels"], np.uint8).reshape(-1, 3)
        p = p[:: max(1, len(p) // 4000)].astype(int)
        yield r["page_key"], bool(len(p)) and bool((p.max(1) - p.min(1) > 40).mean() > 0.01)

    return _each(images, ["page_key", "pixels"], "page_key long, colour boolean", work)
