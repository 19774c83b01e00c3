"""Changes after the analysis: a term looked for on all pages, rectangles drawn by hand, hits taken out; no detection runs again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tintwerk import enums, schemas
from tintwerk.functions import tokens as tk
from tintwerk.functions.tables import met
from tintwerk.operators.groups import assign_groups
from tintwerk.operators.words import words_in_rect
from tintwerk.plans.analysis import PAGE, find_phrases, phrase, resolve_pages

_FIELDS = ["segments", "text", "label", "category", "priority", "rects", "enabled", "question"]


def merge_hits(pages: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new hits; overlaps are resolved again on the pages that have new ones, the others stay as they are."""
    touched = new.select("case_id", "doc_id", "page_no").distinct()
    before = old.select(*PAGE, F.lit(0).alias("stage"), F.col("seq").alias("nth"), *_FIELDS)
    both = met(before, touched, ["case_id", "doc_id", "page_no"], "left_semi").select(*PAGE, "stage", "nth", *_FIELDS).unionByName(new.select(*PAGE, F.lit(1).alias("stage"), "nth", *_FIELDS))
    own = met(pages, touched, ["case_id", "doc_id", "page_no"], "left_semi")
    rest = met(old, touched, ["case_id", "doc_id", "page_no"], "left_anti").select(*PAGE, "seq", *_FIELDS)
    return assign_groups(resolve_pages(own, both).select(*PAGE, "seq", *_FIELDS).unionByName(rest))


def apply_user_term(pages: DataFrame, hits: DataFrame, term: str, label: str, fuzzy: bool = True, category: str = "benutzer") -> tuple[DataFrame, DataFrame]:
    """(all hits with the term's, which win over all but manual ones; the term's hits alone)."""
    words = term.split()
    asked = phrase(tk.tokenize(" ".join(words)), label, category, enums.USER_TERM, fuzzy and len(tk.norm(" ".join(words))) >= 5, len(words) == 1)
    phrases = pages.select("case_id").distinct().withColumn("phrases", F.from_json(F.lit(_json([asked] if asked["tokens"] else [])), f"array<{schemas.PHRASE}>"))
    new = find_phrases(pages, phrases, 1)
    return merge_hits(pages, hits, new), new


def _json(value: list) -> str:
    import json

    return json.dumps(value)


def drawn_hit(page: dict, rect: tuple[float, float, float, float], label: str, spark) -> DataFrame:
    """A hit without words in a rectangle drawn by hand."""
    row = (page["case_id"], page["doc_id"], page["doc_seq"], page["page_no"], 0, [], "(manueller Bereich)", label, "manuell", enums.MANUAL, [rect], True, "")
    return spark.createDataFrame([row], schemas.HITS).withColumnRenamed("seq", "nth")


def term_in_rect(words: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """``doc_id, page_no, term``: the words in a rectangle, in order, to look for elsewhere."""
    inside = words_in_rect(words, x0, y0, x1, y1).groupBy("doc_id", "page_no").agg(F.array_sort(F.collect_list(F.struct("word_no", "text"))).alias("w"))
    return inside.select("doc_id", "page_no", F.array_join(F.transform("w", lambda x: x["text"]), " ").alias("term"))


def without_manual(hits: DataFrame, doc_id: int, page_no: int, seq: int) -> DataFrame:
    return hits.where(~((F.col("doc_id") == doc_id) & (F.col("page_no") == page_no) & (F.col("seq") == seq) & (F.col("priority") == enums.MANUAL)))
