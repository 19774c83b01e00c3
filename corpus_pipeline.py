"""The corpus pipeline: documents to shards, each stage one operator over all that the stage before it kept.

Defined cases, for every stage: null and empty texts are texts without words, scored and kept or not like others; repeated rows of a doc_id are
separate rows, but for the near-copies stage, which keeps one; rows with a null doc_id are never dropped as copies; columns other than doc_id and
text may be null, may have any names and travel with their rows; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tintwerk.llm import decontamination, mixing, near_dedup, quality, queries, sharding
from tintwerk.llm._work import discard, table, written

NEAR = 80  # hundredths of intersection over union
N_SHARDS = 24


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from the labelled rows that aren't held out.

    An empty or null text has a score of its own (all counts 0); without labels every document scores the same.
    """
    labels = table(spark, sf_dir, "labels").where(~quality.held_out(F.col("doc_id")))
    return quality.accepted(docs, quality.train(docs, labels))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one of the smallest doc_id, as one row.

    Texts without words link with nothing and stay, as do rows with a null doc_id.
    """
    return near_dedup.deduplicated(docs, NEAR)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item within its edit budget go. A null or empty text holds none; null and empty items aren't looked for."""
    return decontamination.cleaned(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of domains below their target weight stand more than once; every document stays at least once.

    A text without words has no tokens and the labelled rows' shares as its domains; its copies change no domain's tokens.
    """
    domains = queries.mixing_domains(docs, table(spark, sf_dir, "labels"))
    return mixing.resampled(docs, domains, queries.MIXTURE, total=float("inf"), floor=1.0)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole records, each with its shard and slot. A null text has size 8; a column named like one of the result's gets ``carried_`` before it."""
    return sharding.shard_documents(docs, N_SHARDS, carry=[c for c in docs.columns if c != "doc_id"])


STAGES = [
    ("quality", keep_quality),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("sharding", shard),
]

# Classifier, MinHash, edit distance and descent aren't expressible in SQL: tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(before)  # but for the documents themselves, which weren't written here
    return STAGES[-1][1](spark, docs, sf_dir)
