"""Roll-ups for review: hits by label, open questions, document and page lists, unread regions, vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tintwerk import enums
from tintwerk.functions.tables import met


def label_summary(hits: DataFrame, doc_id: int) -> DataFrame:
    """Labels of one document: hits there and in all documents, whether all, some or none are on, and the order for display."""
    here = F.col("doc_id") == doc_id
    rows = hits.groupBy("label").agg(
        F.count_if(here).alias("here"),
        F.count("*").alias("total"),
        F.count_if(here & F.col("enabled")).alias("on"),
        F.min_by("category", F.when(here, F.struct("page_no", "y0", "seq"))).alias("category"),
    )
    state = F.when(F.col("on") == F.col("here"), "all").when(F.col("on") == 0, "none").otherwise("some")
    rank = F.when(F.startswith("label", F.lit(enums.CLIENT)), 0).when(F.startswith("label", F.lit(enums.OPPONENT)), 1).when(F.col("category") == "name", 2).otherwise(3)
    return rows.where("here > 0").select("label", "here", "total", state.alias("state"), rank.alias("rank"))


def open_questions(hits: DataFrame) -> DataFrame:
    """Groups with a question: their first hit's text, label and state, and in how many places and documents they stand."""
    asked = hits.where("question <> '' AND grp <> ''")
    first = F.min_by(F.struct("text", "label", "question", "enabled"), F.struct("doc_id", "seq"))
    return asked.groupBy("grp").agg(first.alias("f"), F.count("*").alias("places"), F.count_distinct("doc_id").alias("docs")).select("grp", "f.text", "f.label", "f.question", "places", "docs", "f.enabled")


def document_list(documents: DataFrame, hits: DataFrame) -> DataFrame:
    """Each document's pages, hits that are on, and state: exported, analysed or new."""
    on = hits.where("enabled").groupBy("doc_id").agg(F.count("*").alias("on"))
    state = F.when(F.col("exported_to").isNotNull(), "exported").when(F.col("analyzed"), "analyzed").otherwise("new")
    return met(documents, on, "doc_id", "left").select("doc_id", "pages", F.coalesce("on", F.lit(0)).alias("on"), state.alias("state"))


def page_info(words: DataFrame, hits: DataFrame) -> DataFrame:
    counts = words.groupBy("doc_id", "page_no").agg(F.count("*").alias("words"))
    return met(counts, hits.where("enabled").groupBy("doc_id", "page_no").agg(F.count("*").alias("on")), ["doc_id", "page_no"], "left").fillna(0, ["on"])


def load_summary(pages: DataFrame) -> DataFrame:
    return pages.agg(F.count_distinct("doc_id").alias("docs"), F.count("*").alias("pages"), F.count_if(F.col("source") == "ocr").alias("recognised"), F.coalesce(F.sum("unread"), F.lit(0)).alias("unread"))


def unread_pages(pages: DataFrame, most: int = 8) -> DataFrame:
    """For each document, all unread regions and the first pages that hold some."""
    some = pages.where("unread > 0")
    return some.groupBy("doc_id").agg(F.sum("unread").alias("total"), F.array_join(F.slice(F.array_sort(F.collect_set("page_no")), 1, most), ",").alias("pages"))


def next_unread(pages: DataFrame, current: int) -> DataFrame:
    """The next page of each document with an unread region, going round from the page after ``current``."""
    n = F.max("page_no").over(_by_doc()) + 1
    ahead = pages.withColumn("n", n).where("unread > 0").withColumn("ahead", F.pmod(F.col("page_no") - current - 1, F.col("n")))
    return ahead.groupBy("doc_id").agg(F.min_by("page_no", "ahead").alias("next_page"))


def _by_doc():
    from pyspark.sql.window import Window

    return Window.partitionBy("doc_id")


def vocabulary(hits: DataFrame) -> DataFrame:
    """All labels in use and the usual ones."""
    usual = [enums.CLIENT, enums.OPPONENT, enums.CLIENT_ADDRESS, enums.OPPONENT_ADDRESS, *enums.CATEGORY_LABELS.values()]
    fixed = hits.sparkSession.range(1).select(F.explode(F.array(*[F.lit(u) for u in usual])).alias("label"))
    return hits.select("label").unionByName(fixed).distinct()


def source_name(priority: Column) -> Column:
    names = F.create_map(*[F.lit(x) for p in enums.SOURCE_NAMES.items() for x in p])
    return F.coalesce(F.try_element_at(names, priority.cast("int")), F.lit("?"))


def source_summary(hits: DataFrame) -> DataFrame:
    return hits.groupBy(source_name(F.col("priority")).alias("source")).agg(F.count("*").alias("n"))


def pending(documents: DataFrame) -> DataFrame:
    return documents.where("NOT analyzed")
