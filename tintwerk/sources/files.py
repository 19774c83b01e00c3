"""Files: which are read, their text, and what is known already. Formats that need native libraries are adapters."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Callable, Iterator
from io import BytesIO
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tintwerk.functions.tables import numbered

# Extensions by kind.
PDF, IMAGES, OFFICE = ["pdf"], "png jpg jpeg tif tiff bmp gif webp".split(), "docx doc odt rtf".split()
SUPPORTED = [*PDF, *IMAGES, *OFFICE]


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def supported(files: DataFrame) -> DataFrame:
    return files.where(extension(F.col("path")).isin(SUPPORTED))


def folder(spark: SparkSession, path: str) -> DataFrame:
    """The supported files of one folder (not of those in it), with their contents, by path."""
    return supported(spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(path)).orderBy("path")


def resolved(path: Column) -> Column:
    """A path without scheme, empty and ``.`` parts, and with ``..`` taken back."""
    parts = F.filter(F.split(F.regexp_replace(path, r"^file:/*", "/"), "/"), lambda p: ~p.isin("", "."))
    back = lambda a: F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda a, p: F.when(p == "..", back(a)).otherwise(F.array_append(a, p)))
    return F.concat(F.when(F.rlike(path, F.lit("^(file:|/)")), "/").otherwise(""), F.array_join(kept, "/"))


def new_files(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files that aren't loaded yet, each path once, whatever way it is written."""
    place = resolved(F.col("path")).alias("_place")
    files = files.select("*", place).dropDuplicates(["_place"])
    return files.join(known.select(place).distinct(), "_place", "left_anti").drop("_place")


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(content: bytes) -> str:
    """Paragraphs, table rows and headers of a docx, a line each."""
    lines: list[str] = []

    def say(node: ElementTree.Element) -> str:
        parts = (t.text or "" if t.tag == _W + "t" else "\t" if t.tag == _W + "tab" else "\n" if t.tag == _W + "br" else "" for t in node.iter())
        return "".join(parts)

    def walk(node: ElementTree.Element) -> None:
        for child in node:
            if child.tag == _W + "p":
                lines.append(say(child))
            elif child.tag == _W + "tr":
                lines.append(" | ".join(" ".join(say(p) for p in cell.iter(_W + "p")) for cell in child.iter(_W + "tc")))
            else:
                walk(child)

    with zipfile.ZipFile(BytesIO(content)) as z:
        names = z.namelist()
        for name in [*sorted(n for n in names if re.fullmatch(r"word/header\d*\.xml", n)), "word/document.xml", *sorted(n for n in names if re.fullmatch(r"word/footer\d*\.xml", n))]:
            walk(ElementTree.fromstring(z.read(name)))
    return "\n".join(lines)


def plain_text(content: bytes) -> str:
    return content.decode("utf-8", "replace")


# Kind of file to a function from its bytes to its text; PDF and images need a reader from outside.
ADAPTERS: dict[str, Callable[[bytes], str]] = {"docx": docx_text, "txt": plain_text}


def load_texts(files: DataFrame, adapters: dict[str, Callable[[bytes], str]] = ADAPTERS) -> DataFrame:
    """``path, text, error`` of files (path, content). A file that can't be read has an error and doesn't stop the others."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                kind = path.rsplit(".", 1)[-1].lower()
                try:
                    if kind not in adapters:
                        raise ValueError(f"no reader for .{kind}")
                    rows.append((path, adapters[kind](content), None))
                except Exception as e:  # whatever a broken file makes its reader raise belongs to its row
                    rows.append((path, None, f"{type(e).__name__}: {e}"[:200]))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.string())] * 3, ["path", "text", "error"])

    return files.select("path", "content").mapInArrow(read, "path string, text string, error string")


def load_pages(files: DataFrame, adapters: dict[str, Callable[[bytes], str]] = ADAPTERS) -> tuple[DataFrame, DataFrame]:
    """(pages of all files that can be read, ``path, note`` of those that can't): a form feed parts pages; a document without any text is an error.

    A document's number is its place among the paths; pages are numbered from 0.
    """
    from tintwerk import schemas
    from tintwerk.operators.words import page_words

    texts = load_texts(files.dropDuplicates(["path"]), adapters)
    blank = ~F.rlike(F.coalesce("text", F.lit("")), F.lit(r"\S"))
    note = F.when(F.col("error").isNotNull(), F.col("error")).when(blank, F.lit("no pages"))
    told = texts.withColumn("note", note)
    order = numbered(told.where("note IS NULL").select("path"), "path", "doc_seq")
    rows = told.where("note IS NULL").join(order, "path").select(F.xxhash64("path").alias("doc_id"), "doc_seq", F.posexplode(F.split("text", "\f")).alias("page_no", "t"))
    pages = rows.select(
        F.lit("all").alias("case_id"), "doc_id", F.col("doc_seq").cast("int").alias("doc_seq"), "page_no", F.lit(595.0).alias("width"), F.lit(842.0).alias("height"),
        F.lit("text").alias("source"), page_words(F.col("t")).alias("words"), F.array().cast(f"array<{schemas.RECT}>").alias("unread"),
    )
    return pages, told.where("note IS NOT NULL").select("path", "note")
