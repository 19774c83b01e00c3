"""Pages that arrive over time: rules on a stream, and whole analyses batch by batch with the persons known so far."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tintwerk import enums
from tintwerk.operators.patterns import detect_patterns


def stream_pattern_hits(pages: DataFrame, enabled: list[str] = enums.CATEGORIES) -> DataFrame:
    """A row for each rule hit of a stream of pages (doc_id, page_no, text). Stateless: the rules read one page at a time."""
    rows = detect_patterns(pages.select("doc_id", "page_no", "text"), enabled)
    rows = rows.select("doc_id", "page_no", "text", F.explode_outer("found").alias("h")).where("h IS NOT NULL")
    return rows.select("doc_id", "page_no", F.col("h.s").alias("start"), F.substring(F.col("text"), F.col("h.s") + 1, F.col("h.e") - F.col("h.s")).alias("value"), "h.label", "h.category")


def each_batch(analyze: Callable[[DataFrame, DataFrame | None], tuple[DataFrame, DataFrame]], hits_path: str, persons_path: str) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch``: analyses a batch with the persons of the batch before and writes hits and persons by batch number.

    A batch that is repeated overwrites its own folders only, so each page's hits stand once.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        # Labels that are out already must stay.
        known = spark.read.parquet(f"{persons_path}/batch={number - 1}").withColumn("fixed", F.lit(True)) if number else None
        hits, persons = analyze(batch, known)
        hits.write.mode("overwrite").parquet(f"{hits_path}/batch={number}")
        persons.write.mode("overwrite").parquet(f"{persons_path}/batch={number}")

    return run
