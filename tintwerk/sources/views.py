"""Input relations over the star-schema tables: plain documents, and letters with known personal data.

The letters are one page for each customer, made by one SQL text that any engine can run: salutation and name, address,
phone, e-mail, an IBAN with computed check digits, birth date, insurance number, and dates and file numbers that are none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tintwerk import schemas
from tintwerk.operators.words import page_words

FIRST = ["Robin", "Erika", "Jens", "Gül", "Anna", "Hans", "Petra", "Uwe", "Jürgen", "Sonja", "Karl", "Änne"]
LAST = ["Kinzel", "Mustermann", "Beispiel", "Yilmaz", "Schmidt", "Müller", "Schulze", "Weber", "Großmann", "Krüger", "Vogt"]
TOWN = ["Limburg", "Wetzlar", "Hadamar", "Köln", "Diez"]


def _pick(values: list[str], index: str) -> str:
    cases = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {index} {cases} END"


LETTERS_SQL = f"""
SELECT c_custkey AS doc_id, f || ' ' || l AS person, bban,
  CASE WHEN c_custkey % 2 = 0 THEN 'Herr ' ELSE 'Frau ' END || f || ' ' || l || chr(10)
  || 'Musterweg ' || CAST(c_custkey % 90 + 1 AS STRING) || ', ' || CAST(35500 + c_custkey % 90 AS STRING) || ' ' || town || chr(10)
  || 'Tel. 06433/' || CAST(100000 + c_custkey AS STRING) || CASE WHEN c_custkey % 3 = 0 THEN ', Mobil: 0171 ' || CAST(2000000 + c_custkey AS STRING) ELSE '' END || chr(10)
  || 'E-Mail: post' || CAST(c_custkey AS STRING) || '@web.de' || chr(10)
  || 'IBAN: DE' || lpad(CAST(98 - ((CAST(bban AS BIGINT) % 97) * 27 + 131400) % 97 AS STRING), 2, '0') || bban || chr(10)
  || CASE WHEN c_custkey % 4 = 0 THEN 'Konto-Nr.: ' || CAST(10000000 + c_custkey AS STRING) ELSE 'Az. 012345/2024' END || chr(10)
  || CASE WHEN c_custkey % 2 = 0 THEN 'geb. ' ELSE 'geboren am ' END || lpad(CAST(c_custkey % 28 + 1 AS STRING), 2, '0') || '.' || lpad(CAST(c_custkey % 12 + 1 AS STRING), 2, '0') || '.' || CAST(1950 + c_custkey % 50 AS STRING)
  || CASE WHEN c_custkey % 5 = 0 THEN ' in ' || town ELSE '' END || chr(10)
  || CASE WHEN c_custkey % 3 = 0 THEN 'SV-Nr.: 12' || lpad(CAST(c_custkey % 28 + 1 AS STRING), 2, '0') || '0380M015' WHEN c_custkey % 3 = 1 THEN 'Versichertennummer: A' || CAST(123000000 + c_custkey AS STRING) ELSE 'geborene ' || l END || chr(10)
  || 'Schreiben vom 12.03.2024. ' || l || ' widersprach ' || CASE WHEN c_custkey % 7 = 0 THEN l || 's Antrag.' ELSE 'am 1. Mai 2023.' END AS text
FROM (SELECT c_custkey, {_pick(FIRST, f"c_custkey % {len(FIRST)}")} AS f, {_pick(LAST, f"c_custkey % {len(LAST)}")} AS l, {_pick(TOWN, f"c_custkey % {len(TOWN)}")} AS town,
        '51150018' || lpad(CAST(c_custkey AS STRING), 10, '0') AS bban FROM customer) AS base
"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(table: DataFrame) -> DataFrame:
    """A table of a few splits, dealt over all cores, as the work on its rows is heavy; one of many splits stays as it is."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


def letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(LETTERS_SQL.replace("FROM customer)", "FROM {customer})"), customer=spread(read(spark, sf_dir, "customer")))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))


def pages_of(texts: DataFrame, case_id=None) -> DataFrame:
    """One page for each row ``doc_id, text``."""
    return texts.select(
        (F.lit("all") if case_id is None else case_id).cast("string").alias("case_id"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("doc_id").cast("int").alias("doc_seq"),
        F.lit(0).alias("page_no"),
        F.lit(595.0).alias("width"),
        F.lit(842.0).alias("height"),
        F.lit("text").alias("source"),
        page_words(F.col("text")).alias("words"),
        F.array().cast(f"array<{schemas.RECT}>").alias("unread"),
    )
