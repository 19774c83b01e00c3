"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tintwerk.llm import chat_format, decontamination, fingerprints, licenses, mixing, near_dedup, quality, repeats, sharding, warc
from tintwerk.llm._work import table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_report(table(spark, sf_dir, "pages"))


def op2_run_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"), 400).drop("spans")


def op3_bloom_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))


def op4_edit_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), 85)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_documents(table(spark, sf_dir, "documents"), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


MIXTURE = {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}


def mixing_domains(docs: DataFrame, labels: DataFrame) -> mixing.Domains:
    """Learnt from the labelled documents; a document's language is its domain."""
    return mixing.train(docs, labels, "lang")


def op7_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    domains = mixing_domains(docs, table(spark, sf_dir, "labels"))
    rates, report = mixing.mix(docs, domains, MIXTURE)
    place = F.array_position("posterior", F.array_max("posterior")).cast("int")
    of_domain = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), place)
    target, reached = ([report[n][i] for n in domains.names] for i in range(2))
    return rates.select("doc_id", "n_tokens", of_domain(domains.names).alias("domain"), F.array_max("posterior").alias("membership"), "rate", of_domain(target).alias("domain_target"), of_domain(reached).alias("domain_reached"))


def op8_additive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train(docs, labels.where(~quality.held_out(F.col("doc_id"))))
    return quality.score(docs, model).select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.sql("SELECT * FROM VALUES (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)")
    return chat_format.summarize(chat_format.format_conversations(turns.unionByName(own)))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_sentences", F.array_join("identifiers", ",").alias("identifiers"), F.array_join("licenses", ",").alias("licenses"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_run_index": op2_run_index,
    "op3_bloom_fingerprints": op3_bloom_fingerprints,
    "op4_edit_matching": op4_edit_matching,
    "op5_minhash_forest": op5_minhash_forest,
    "op6_sharding": op6_sharding,
    "op7_soft_mixing": op7_soft_mixing,
    "op8_additive_quality": op8_additive_quality,
    "op9_chat_format": op9_chat_format,
    "op10_licenses": op10_licenses,
}

ORACLES: dict[str, str] = {
    "op1_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS d FROM pages),
             f AS (SELECT d, min(page_id) AS first FROM p WHERE octet_length(encode(html)) >= 100 GROUP BY d HAVING count(*) > 1)
        SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, p.d AS payload_digest,
               CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN first IS NULL OR first = page_id THEN NULL ELSE first END AS refers_to
        FROM p LEFT JOIN f ON p.d = f.d""",
    "op5_minhash_forest": r"""
        WITH RECURSIVE t AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
             sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(generate_series(1, greatest(1, len(w) - 4)), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM t),
             each AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
             links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM each a JOIN each b ON a.x = b.x AND a.doc_id <> b.doc_id
                       GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
             reach AS (SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
        SELECT doc_id, any_value(len(s))::BIGINT AS n_shingles, min(b) AS component_id, doc_id = min(b) AS kept FROM sets JOIN reach ON a = doc_id GROUP BY doc_id""",
    "op9_chat_format": r"""
        WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
             e AS (SELECT *, length(regexp_replace(replace(text, '\', '\\'),
                          '(<s>|</s>|\[INST\]|\[/INST\]|<<SYS:|>>|<</SYS>>|<\|next\|>)', '\1ee', 'g')) AS n_text,
                          length(replace(role, '\', '\\')) AS n_role,
                          lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS prev FROM t)
        SELECT conv_id, count(*)::BIGINT AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(n_text + CASE WHEN prev = role THEN 8 WHEN role = 'user' THEN 18 WHEN role = 'assistant' THEN 5
                                 ELSE 16 + n_role END)::BIGINT AS formatted_chars
        FROM e GROUP BY conv_id""",
}
