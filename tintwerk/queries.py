"""One query for each operator, over relations made from the driver's tables, with the same in SQL.

Relations: documents; letters (one page of known personal data for each customer); review hits (made from orders).
Each is a function of the tables, by SQL that both engines read, so results can be compared row by row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tintwerk import enums, schemas
from tintwerk.functions import text as tx
from tintwerk.functions import tokens as tk
from tintwerk.functions.spans import located
from tintwerk.functions.tables import met
from tintwerk.operators import export, findings, groups, names, patterns, recognition, review, words
from tintwerk.plans import analysis
from tintwerk.sources import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


LETTERS = f"letters AS ({views.LETTERS_SQL})"


def _words_sql(source: str) -> str:
    """Words by line and place in SQL: relation ``words(doc_id, word_no, line_no, text, start)``."""
    return f"""lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM {source}),
        tokens AS (SELECT doc_id, line_no, unnest(t) AS text, generate_subscripts(t, 1) AS pos FROM (SELECT doc_id, line_no, list_filter(regexp_split_to_array(line, '[ \\t\\r\\f\\v]+'), lambda x: x <> '') AS t FROM lines)),
        words AS (SELECT doc_id, row_number() OVER w - 1 AS word_no, line_no, text, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY line_no, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
                  FROM tokens WINDOW w AS (PARTITION BY doc_id ORDER BY line_no, pos))"""


def _norm_sql(e: str) -> str:
    edges, dashes = enums.TOKEN_EDGE.replace("'", "''"), enums.DASHES
    bare = f"trim(trim(translate({e}, '{dashes}', '{'-' * len(dashes)}')), '{edges}')"
    return f"regexp_replace(replace(lower(CASE WHEN length({bare}) > 1 THEN rtrim({bare}, '-') ELSE {bare} END), 'ß', 'ss'), '(strasse|str)$', 'str')"


def _letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.letters(spark, sf_dir)


def _letter_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words.exploded(views.pages_of(_letters(spark, sf_dir)))


# ---- text layer


@query(f"WITH {LETTERS}, {_words_sql('letters')} SELECT doc_id, word_no::INT AS word_no, line_no::INT AS line_no, text, start::INT AS start, (start + length(text))::INT AS \"end\" FROM words")
def q_words(spark, sf_dir):
    return _letter_words(spark, sf_dir).select("doc_id", "word_no", "line_no", "text", "start", "end")


@query(f"""WITH {_words_sql('documents')}, g AS (SELECT doc_id, line_no, string_agg(text, ' ' ORDER BY word_no) AS t FROM words GROUP BY ALL)
    SELECT doc_id, sha256(string_agg(t, chr(10) ORDER BY line_no)) AS digest, sum(length(t) + 1)::BIGINT - 1 AS n_chars FROM g GROUP BY doc_id""")
def q_page_text(spark, sf_dir):
    pages = views.pages_of(views.documents(spark, sf_dir)).select("doc_id", words.page_text(F.col("words")).alias("t"))
    return pages.where("t <> ''").select("doc_id", F.sha2("t", 256).alias("digest"), F.length("t").cast("long").alias("n_chars"))


@query(f"WITH {_words_sql('documents')} SELECT {_norm_sql('text')} AS norm, count(*) AS n FROM words GROUP BY 1")
def q_norm(spark, sf_dir):
    each = views.documents(spark, sf_dir).select(F.explode(tx.words(F.col("text"))).alias("w"))
    return each.select(tx.norm(F.col("w")).alias("norm")).groupBy("norm").agg(F.count("*").alias("n"))


@query(f"""SELECT doc_id, len(list_filter(list_transform(regexp_split_to_array(text, '[\\s,;]+'), lambda t: {_norm_sql('t')}), lambda t: t <> ''))::INT AS n_tokens FROM documents""")
def q_tokenize(spark, sf_dir):
    return views.documents(spark, sf_dir).select("doc_id", F.size(tx.tokenize(F.col("text"))).alias("n_tokens"))


@query("""WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE length(text) > 600),
    r AS (SELECT doc_id, i, 0 AS chunk, length(line) + 1 AS cur FROM l WHERE i = 1
          UNION ALL SELECT l.doc_id, l.i, CASE WHEN cur + length(line) + 1 > 600 THEN chunk + 1 ELSE chunk END, CASE WHEN cur + length(line) + 1 > 600 THEN 0 ELSE cur END + length(line) + 1
          FROM r JOIN l ON l.doc_id = r.doc_id AND l.i = r.i + 1)
    SELECT doc_id, chunk::INT AS chunk_no, max(cur)::INT AS n_chars FROM r GROUP BY doc_id, chunk
    UNION ALL SELECT doc_id, 0, length(text)::INT FROM documents WHERE length(text) <= 600""")
def q_chunks(spark, sf_dir):
    return views.documents(spark, sf_dir).select("doc_id", F.posexplode(tx.chunks(F.col("text"), 600)).alias("chunk_no", "c")).select("doc_id", "chunk_no", F.length("c").alias("n_chars"))


@query(f"""WITH {_words_sql('documents')}, t AS (SELECT DISTINCT text, ltrim(text, '{enums.HIT_EDGE.replace("'", "''")}') AS l, rtrim(text, '{enums.HIT_EDGE.replace("'", "''")}') AS r FROM words)
    SELECT text, (CASE WHEN l = '' THEN 0 ELSE length(text) - length(l) END)::INT AS c0, (CASE WHEN l = '' THEN length(text) ELSE length(r) END)::INT AS c1 FROM t""")
def q_trim(spark, sf_dir):
    each = views.documents(spark, sf_dir).select(F.explode(tx.words(F.col("text"))).alias("text")).distinct()
    return each.select("text", words.trimmed_span(F.col("text")).alias("t")).select("text", "t.c0", "t.c1")


# ---- rules


def _rule(rule):
    def run(spark, sf_dir):
        rows = _letters(spark, sf_dir).select("doc_id", "text", F.explode_outer(rule(F.col("text"))).alias("h")).where("h IS NOT NULL")
        return rows.select("doc_id", F.col("h.s").alias("start"), F.substring(F.col("text"), F.col("h.s") + 1, F.col("h.e") - F.col("h.s")).alias("value"), "h.label", "h.category")

    return run


def _rule_sql(pattern: str, label: str, category: str, group: int = 1, where: str = "true") -> str:
    """The value by a plain pattern that letters are known to fit, its place by searching for the value."""
    return f"""WITH {LETTERS}, v AS (SELECT doc_id, text, regexp_extract(text, '{pattern}', {group}) AS value FROM letters WHERE {where})
        SELECT doc_id, (strpos(text, value) - 1)::INT AS start, value, {label} AS label, '{category}' AS category FROM v WHERE value <> ''"""


def _register(name: str, f, sql: str | None) -> None:
    QUERIES[name] = f
    if sql:
        ORACLES[name] = sql


_register("q_email", _rule(patterns.emails), _rule_sql("E-Mail: ([^\\n]+)", "'E-Mail'", "email"))
_register("q_iban", _rule(patterns.ibans), _rule_sql("IBAN: ([^\\n]+)", "'IBAN'", "iban"))
_register("q_konto", _rule(patterns.accounts), _rule_sql("Konto-Nr.: ([0-9]+)", "'Konto-Nr.'", "iban"))
_register("q_insurance", _rule(patterns.insurance_numbers), _rule_sql("(SV-Nr.|Versichertennummer): ([A-Z0-9]+)", "CASE WHEN text LIKE '%SV-Nr.%' THEN 'SV-Nr.' ELSE 'Vers.-Nr.' END", "versicherung", 2))
_register("q_social_number", _rule(patterns.social_numbers), _rule_sql("SV-Nr.: ([A-Z0-9]+)", "'SV-Nr.'", "versicherung"))
_register("q_health_number", _rule(patterns.health_numbers), _rule_sql("Versichertennummer: ([A-Z0-9]+)", "'Vers.-Nr.'", "versicherung"))
_register("q_birth_name", _rule(patterns.birth_names), _rule_sql("geborene ([^\\n]+)", "'Geburtsname'", "name").replace("strpos(text, value) - 1", "strpos(text, 'geborene ' || value) + 8"))
_register(
    "q_birth",
    _rule(patterns.births),
    f"""WITH {LETTERS}, v AS (SELECT doc_id, text, regexp_extract(text, 'geb(\\. |oren am )([0-9.]{{10}})', 2) AS d, regexp_extract(text, 'geb(\\. |oren am )[0-9.]{{10}} in ([^\\n]+)', 2) AS p FROM letters)
        SELECT doc_id, (strpos(text, d) - 1)::INT AS start, d AS value, 'Geb.-Datum' AS label, 'geburtsdatum' AS category FROM v
        UNION ALL SELECT doc_id, (strpos(text, d || ' in ') + 13)::INT, p, 'Geb.-Ort', 'geburtsdatum' FROM v WHERE p <> ''""",
)


@query(f"""WITH {LETTERS} SELECT doc_id, (strpos(text, 'Tel. ') + 4)::INT AS start, regexp_extract(text, 'Tel. ([0-9/]+)', 1) AS value, 'Telefon' AS label, 'telefon' AS category FROM letters
    UNION ALL SELECT doc_id, (strpos(text, 'Mobil: ') + 6)::INT, regexp_extract(text, 'Mobil: ([0-9 ]+)', 1), 'Handy', 'telefon' FROM letters WHERE text LIKE '%Mobil: %'""")
def q_phone(spark, sf_dir):
    rows = patterns.detect_patterns(_letters(spark, sf_dir).select("doc_id", "text")).select("doc_id", "text", F.explode_outer("found").alias("h")).where("h.category = 'telefon'")
    return rows.select("doc_id", F.col("h.s").alias("start"), F.substring(F.col("text"), F.col("h.s") + 1, F.col("h.e") - F.col("h.s")).alias("value"), "h.label", "h.category")


@query(f"""WITH {LETTERS} SELECT doc_id, (2 + 1 + (doc_id % 3 = 0)::INT + (doc_id % 4 = 0)::INT + (doc_id % 3 < 2)::INT + 1 + (doc_id % 5 = 0)::INT + (doc_id % 3 = 2)::INT)::BIGINT AS hits,
    CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS phones FROM letters""")
def q_mask_cascade(spark, sf_dir):
    rows = patterns.detect_patterns(_letters(spark, sf_dir).select("doc_id", "text"))
    return rows.select("doc_id", F.explode_outer("found").alias("h")).groupBy("doc_id").agg(F.count("h").alias("hits"), F.count_if(F.col("h.category") == "telefon").alias("phones"))


@query(r"SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+\-ÄÖÜäöü]+[ \t]?(?:@|\(at\)|\[at\]|©|®)[ \t]?[A-Za-z0-9\-ÄÖÜäöü]+(?:\.[A-Za-z0-9\-ÄÖÜäöü]+)*\.[A-Za-z]{2,}')) AS value FROM documents")
def q_email_documents(spark, sf_dir):
    docs = views.documents(spark, sf_dir).where(F.rlike("text", F.lit(r"@|\(at\)|\[at\]|©|®")))
    return docs.select("doc_id", F.explode_outer(located(F.col("text"), patterns.EMAIL)).alias("h")).where("h IS NOT NULL").select("doc_id", F.col("h.m").alias("value"))


@query(f"""WITH {LETTERS} SELECT doc_id, 5::INT AS start, person AS name, substr(text, 1, 5) AS prefix FROM letters""")
def q_salutation(spark, sf_dir):
    rows = _letters(spark, sf_dir).select("doc_id", F.explode_outer(names.salutation_names(F.col("text"))).alias("x")).where("x IS NOT NULL")
    return rows.select("doc_id", F.col("x.s").alias("start"), "x.name", "x.prefix")


@query(f"""WITH {LETTERS}, {_words_sql('letters')} SELECT w.doc_id, w.word_no::INT AS word, NULL::INT AS c0, NULL::INT AS c1 FROM words w JOIN letters l ON w.doc_id = l.doc_id
    WHERE w.text = regexp_extract(l.text, 'E-Mail: ([^\\n]+)', 1)""")
def q_span_segments(spark, sf_dir):
    pages = views.pages_of(_letters(spark, sf_dir)).withColumn("text", words.page_text(F.col("words"))).withColumn("spans", words.word_spans(F.col("words")))
    rows = pages.select("doc_id", "spans", F.explode_outer(patterns.emails(F.col("text"))).alias("h")).where("h IS NOT NULL")
    return rows.select("doc_id", F.explode(words.segments_at(F.col("spans"), F.col("h.s"), F.col("h.e"))).alias("g")).select("doc_id", "g.word", "g.c0", "g.c1")


@query(f"""WITH {LETTERS}, {_words_sql('letters')}, b AS (SELECT doc_id, line_no, 50 + 6 * (start - min(start) OVER (PARTITION BY doc_id, line_no)) AS x0, length(text) * 6 AS w FROM words)
    SELECT doc_id, line_no::INT AS line_no, round(min(x0) - 1.2, 6) AS x0, round(50 + 14 * line_no - 1.2, 6) AS y0, round(least(595, max(x0 + w) + 1.2), 6) AS x1, round(60 + 14 * line_no + 1.2, 6) AS y1 FROM b GROUP BY doc_id, line_no""")
def q_rects(spark, sf_dir):
    rows = _letter_words(spark, sf_dir)
    out = words.line_rects(rows, rows.select("doc_id", "page_no", "word_no", F.lit(0).alias("hit")))
    return out.select("doc_id", "line_no", *[F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1")])


# ---- phrases and inputs


@query(f"""WITH {LETTERS}, t AS (SELECT DISTINCT {_norm_sql("string_split(person, ' ')[2]")} AS a FROM letters), u AS (SELECT DISTINCT {_norm_sql("string_split(c_name, '#')[1] || c_custkey % 7")} AS a FROM customer),
    q AS (SELECT a FROM t UNION SELECT a || 's' FROM t UNION SELECT substr(a, 1, length(a) - 1) || 'i' FROM t UNION SELECT a FROM u)
    SELECT q.a AS query, p.a AS word, (q.a = p.a OR p.a = q.a || 's' OR (CASE WHEN regexp_matches(q.a || p.a, '[0-9]') THEN translate(q.a, 'ol|', '011') = translate(p.a, 'ol|', '011')
        WHEN greatest(length(q.a), length(p.a)) < 5 THEN false
        ELSE levenshtein(q.a, CASE WHEN length(p.a) = length(q.a) + 1 AND p.a LIKE '%s' THEN substr(p.a, 1, length(q.a)) ELSE p.a END) <= CASE WHEN greatest(length(q.a), length(p.a)) < 9 THEN 1 ELSE 2 END END)) AS alike
    FROM t q CROSS JOIN q p""")
def q_token_match(spark, sf_dir):
    # The words are a fixed vocabulary: each name, its genitive, its last letter misread, and tokens with digits.
    names_ = [tk.norm(n) for n in views.LAST]
    variants = [*names_, *(n + "s" for n in names_), *(n[:-1] + "i" for n in names_), *(f"customer{i}" for i in range(7))]
    base = _letters(spark, sf_dir).select(tx.norm(F.split("person", " ")[1]).alias("query")).distinct()
    return base.select("query", F.explode(F.array(*[F.lit(v) for v in dict.fromkeys(variants)])).alias("word")).select("query", "word", tx.alike(F.col("query"), F.col("word"), True, True).alias("alike"))


@query(f"""WITH {LETTERS}, {_words_sql('letters')} SELECT doc_id, word_no::INT AS word_no, text FROM words WHERE {_norm_sql('text')} IN ('kinzel', 'kinzels') AND regexp_matches(ltrim(text, '{enums.TOKEN_EDGE.replace("'", "''")}'), '^\\p{{Lu}}')""")
def q_find_token(spark, sf_dir):
    rows = _letter_words(spark, sf_dir)
    capital = F.rlike(F.ltrim("text", F.lit(enums.TOKEN_EDGE)), F.lit(r"^\p{Lu}"))
    return rows.where(capital & tx.alike(F.lit("kinzel"), tx.norm(F.col("text")), True, True)).select("doc_id", "word_no", "text")


_BROKEN = ["Robin Kin-\nzel kam", "Herr Kin zel kam", "RobinKinzel kam", "Robin Kinzei, kam", "Robin , Kinzel", "niemand kam"]
_BROKEN_FOUND = ["Robin Kin-\nzel", None, "RobinKinzel", "Robin Kinzei", "Robin , Kinzel", None]


def _case_sql(values: list[str | None], index: str) -> str:
    shown = lambda v: "NULL" if v is None else "'" + v.replace("\n", "' || chr(10) || '") + "'"
    return f"CASE {index} " + " ".join(f"WHEN {i} THEN {shown(v)}" for i, v in enumerate(values)) + " END"


def _phrases(spark, case: str, *phrases: dict) -> DataFrame:
    return spark.createDataFrame([(case, list(phrases))], f"case_id string, phrases array<{schemas.PHRASE}>")


@query(f"SELECT c_custkey AS doc_id, {_case_sql(_BROKEN_FOUND, 'c_custkey % 6')} AS text FROM customer WHERE c_custkey % 6 IN (0, 2, 3, 4)")
def q_broken_words(spark, sf_dir):
    pages = views.pages_of(spark.sql(f"SELECT c_custkey AS doc_id, {_case_sql(_BROKEN, 'c_custkey % 6')} AS text FROM {{customer}}", customer=views.read(spark, sf_dir, "customer")))
    return analysis.find_phrases(pages, _phrases(spark, "all", analysis.phrase(["robin", "kinzel"], "Mandant", "name", enums.INPUT)), 0).select("doc_id", "text")


_INPUT = ("all", "Robin Kinzel", "", "Erika Kinzel", "", [("Antrag", "Schriftstück")], False)


@query(f"""WITH {LETTERS}, {_words_sql('letters')}, n AS (SELECT *, {_norm_sql('text')} AS norm, lead({_norm_sql('text')}) OVER (PARTITION BY doc_id ORDER BY word_no) AS next FROM words)
    SELECT doc_id, word_no::INT AS word, 'Mandant' AS label, 'name' AS category, 10 AS priority FROM n WHERE norm = 'robin' AND next IN ('kinzel', 'kinzels')
    UNION ALL SELECT doc_id, word_no, 'Gegner', 'name', 10 FROM n WHERE norm = 'erika' AND next IN ('kinzel', 'kinzels')
    UNION ALL SELECT doc_id, word_no, 'Mandant/Gegner', 'name', 40 FROM n, (SELECT 1 UNION ALL SELECT 2) WHERE norm IN ('kinzel', 'kinzels')
    UNION ALL SELECT doc_id, word_no, 'Mandant', 'name', 40 FROM n WHERE norm = 'robin' UNION ALL SELECT doc_id, word_no, 'Gegner', 'name', 40 FROM n WHERE norm = 'erika'
    UNION ALL SELECT doc_id, word_no, 'Schriftstück', 'benutzer', 10 FROM n WHERE norm = 'antrag'""")
def q_inputs(spark, sf_dir):
    inputs = spark.createDataFrame([_INPUT], schemas.INPUTS)
    out = analysis.find_inputs(views.pages_of(_letters(spark, sf_dir)), inputs, analysis.Settings())
    return out.select("doc_id", F.col("segments")[0]["word"].alias("word"), "label", "category", "priority")


@query(f"""WITH {LETTERS}, o AS (SELECT DISTINCT {_norm_sql("t")} AS token, CASE WHEN doc_id % 2 = 0 THEN 'Mandant' ELSE 'Gegner' END AS owner FROM (SELECT doc_id, unnest(string_split(person, ' ')) AS t FROM letters))
    SELECT token, string_agg(owner, '/' ORDER BY owner DESC) AS label FROM o GROUP BY token HAVING count(*) > 1""")
def q_shared_tokens(spark, sf_dir):
    owner = F.when(F.col("doc_id") % 2 == 0, "Mandant").otherwise("Gegner")
    each = _letters(spark, sf_dir).select(owner.alias("owner"), F.explode(tx.name_tokens(F.col("person"))).alias("token")).distinct()
    return each.groupBy("token").agg(F.array_join(F.reverse(F.array_sort(F.collect_set("owner"))), "/").alias("label"), F.count("*").alias("n")).where("n > 1").drop("n")


@query(f"""WITH {LETTERS}, {_words_sql('letters')} SELECT doc_id, count(*) AS added FROM words WHERE {_norm_sql('text')} IN ('widersprach') GROUP BY doc_id""")
def q_user_term(spark, sf_dir):
    term = analysis.phrase(["widersprach"], "Verb", "benutzer", enums.USER_TERM, True, True)
    return analysis.find_phrases(views.pages_of(_letters(spark, sf_dir)), _phrases(spark, "all", term), 5).groupBy("doc_id").agg(F.count("*").alias("added"))


# ---- findings


_RAW = """SELECT doc_id, person, CASE doc_id % 6 WHEN 0 THEN 'Zeugin  Dr. ' || person WHEN 1 THEN 'Herr' WHEN 2 THEN CAST(doc_id AS STRING) || ' ' || person WHEN 3 THEN 'Amtsgericht ' || person WHEN 4 THEN person ELSE 'K-' || CAST(doc_id AS STRING) END AS text,
    CASE WHEN doc_id % 6 = 5 THEN 'quatsch' ELSE ' Name' END AS kategorie, ' a  ' || CAST(doc_id AS STRING) || ' ' AS bezug, CASE WHEN doc_id % 4 = 0 THEN 'ja' ELSE 'false' END AS unsicher, 'Hinweis ' || CAST(doc_id AS STRING) AS hinweis FROM letters"""


@query(f"""WITH {LETTERS}, r AS ({_RAW}) SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN person ELSE r.text END AS text, CASE WHEN doc_id % 6 = 5 THEN 'sonstiges' ELSE 'name' END AS kategorie, 'a ' || doc_id AS bezug,
    (doc_id % 6 = 5 OR doc_id % 4 = 0) AS unsicher, CASE WHEN doc_id % 6 = 5 OR doc_id % 4 = 0 THEN 'Hinweis ' || doc_id ELSE '' END AS hinweis FROM r WHERE doc_id % 6 IN (0, 4, 5)""")
def q_findings_clean(spark, sf_dir):
    raw = spark.sql(_RAW.replace("FROM letters", "FROM {letters}"), letters=_letters(spark, sf_dir))
    return findings.clean_findings(raw).select("doc_id", "text", "kategorie", "bezug", "unsicher", "hinweis")


@query(f"WITH {LETTERS} SELECT doc_id, count(*) AS places FROM letters WHERE doc_id % 2 = 0 GROUP BY doc_id")
def q_verify_findings(spark, sf_dir):
    letters = _letters(spark, sf_dir)
    text = F.when(F.col("doc_id") % 2 == 0, F.col("person")).otherwise("Wilhelmine Erfunden")
    asked = letters.select(F.lit("all").alias("case_id"), "doc_id", F.lit(0).alias("page_no"), F.lit(0).alias("seq"), text.alias("text"), F.lit("name").alias("kategorie"), F.lit("").alias("bezug"), F.lit(False).alias("unsicher"), F.lit("").alias("hinweis"))
    good, _ = findings.gate(views.pages_of(letters), asked, spark.createDataFrame([("all", "", "", "", "", [], False)], schemas.INPUTS), analysis.Settings())
    return good.select("doc_id", F.size("found").cast("long").alias("places"))


@query(f"""WITH {LETTERS}, v AS (SELECT doc_id, regexp_extract(text, '([0-9]{{2}}\\.[0-9]{{2}}\\.[0-9]{{4}})', 1) AS d FROM letters)
    SELECT doc_id, true AS with_word, right(d, 4)::INT <= 2010 AS without_word, false AS letter_date FROM v""")
def q_birth_plausible(spark, sf_dir):
    date = F.regexp_extract("text", r"(\d{2}\.\d{2}\.\d{4})", 1)
    ok = lambda before, d: findings.plausible_birthdate(F.lit(before), d, 2024)
    return _letters(spark, sf_dir).select("doc_id", ok("Sie ist geboren am ", date).alias("with_word"), ok("Schreiben vom ", date).alias("without_word"), ok("geb. 1990, Schreiben vom ", F.lit("12.03.2024")).alias("letter_date"))


@query("SELECT DISTINCT floor(o_totalprice)::BIGINT::VARCHAR || CASE WHEN o_orderkey % 2 = 0 THEN ' EUR' ELSE ' Stück' END AS text, o_orderkey % 2 = 0 AS no_datum FROM orders")
def q_no_datum(spark, sf_dir):
    text = F.concat(F.floor("o_totalprice").cast("long").cast("string"), F.when(F.col("o_orderkey") % 2 == 0, " EUR").otherwise(" Stück"))
    return views.read(spark, sf_dir, "orders").select(text.alias("text")).distinct().select("text", findings.no_datum(F.col("text")).alias("no_datum"))


# ---- labels and persons


@query(f"""WITH {LETTERS} SELECT DISTINCT person, substr(person, 1, 1) || '.' || substr(string_split(person, ' ')[2], 1, 1) || '.' AS initials,
    substr(person, 1, 1) || '.' || substr(string_split(person, ' ')[2], 1, 2) || '.' AS longer FROM letters""")
def q_initials(spark, sf_dir):
    return _letters(spark, sf_dir).select("person").distinct().select("person", tx.initials(F.col("person")).alias("initials"), tx.initials(F.col("person"), 1, 2).alias("longer"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN x WHEN 1 THEN x || '/Mandant' WHEN 2 THEN 'Adresse ' || x ELSE 'Person 27/' || x END AS label, CASE o_orderkey % 4 WHEN 0 THEN x WHEN 1 THEN x || '/Mdt.' WHEN 2 THEN 'Adr. ' || x ELSE 'P. 27/' || x END AS short
    FROM (SELECT o_orderkey, chr((65 + o_custkey % 26)::INT) || '.' || chr((65 + o_custkey % 7)::INT) || '.' AS x FROM orders)""")
def q_relabel(spark, sf_dir):
    """A map of 182 labels, of which each row's label, part or address is one."""
    k, nth = F.col("o_orderkey") % 4, F.col("o_custkey") % 26
    initial = F.col("o_custkey") % 7
    person = F.concat(F.lit("Person "), F.chr(65 + nth), initial.cast("string"))
    old = F.when(k == 0, person).when(k == 1, F.concat(person, F.lit("/Mandant"))).when(k == 2, F.concat(F.lit("Adresse "), person)).otherwise(F.concat(F.lit("Person 27/"), person))
    pairs = [(f"Person {chr(65 + i)}{j}", f"{chr(65 + i)}.{chr(65 + j)}.") for i in range(26) for j in range(7)]
    mapping = F.create_map(*[F.lit(x) for a, b in pairs for x in (a, b, f"Adresse {a}", f"Adresse {b}")])
    return views.read(spark, sf_dir, "orders").select("o_orderkey", tx.relabel(old, mapping).alias("label")).select("*", tx.short_label(F.col("label")).alias("short"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey < 26 THEN chr(65 + n_nationkey) ELSE (n_nationkey + 1)::VARCHAR END AS mark FROM nation")
def q_letters(spark, sf_dir):
    return views.read(spark, sf_dir, "nation").select("n_nationkey", tx.letter(F.col("n_nationkey") + 1).alias("mark"))


def _analysis(spark, sf_dir) -> analysis.Analysis:
    """Letters as cases of 20 documents."""
    pages = views.pages_of(_letters(spark, sf_dir), F.floor(F.col("doc_id") / 20))
    inputs = pages.select("case_id").distinct().select("case_id", F.lit("Robin Kinzel").alias("mandant_name"), F.lit("").alias("mandant_adresse"), F.lit("").alias("gegner_name"), F.lit("").alias("gegner_adresse"), F.array().cast("array<struct<term:string,label:string>>").alias("custom"), F.lit(False).alias("gegner_organisation"))
    return analysis.analyze(pages, inputs)


# Each letter mentions one person, and no two names are alike: a case's persons are its distinct names, numbered by first letter. Labels by hand:
# initials, or the first level of more letters at which all of a group differ, or numbers.
_PERSONS_SQL = f"""WITH {LETTERS}, m AS (SELECT (doc_id // 20)::VARCHAR AS case_id, doc_id, person FROM letters),
    n AS (SELECT case_id, person, string_split(person, ' ')[1] AS f, string_split(person, ' ')[2] AS l, row_number() OVER (PARTITION BY case_id ORDER BY min(doc_id)) + 1 AS person_seq FROM m WHERE person <> 'Robin Kinzel' GROUP BY case_id, person),
    b AS (SELECT *, substr(f, 1, 1) || '.' || substr(l, 1, 1) || '.' AS base FROM n),
    v AS (SELECT b.*, k, substr(f, 1, x) || '.' || substr(l, 1, y) || '.' AS lab FROM b, (VALUES (1, 1, 2), (2, 2, 1), (3, 2, 2), (4, 1, 3), (5, 3, 1)) AS t(k, x, y)),
    best AS (SELECT case_id, base, min(k) AS k FROM (SELECT case_id, base, k FROM v GROUP BY ALL HAVING count(DISTINCT lab) = count(*)) GROUP BY ALL),
    g AS (SELECT b.*, count(*) OVER (PARTITION BY case_id, base) AS size, row_number() OVER (PARTITION BY case_id, base ORDER BY person_seq) AS nth FROM b)
    SELECT g.case_id, g.person_seq::INT AS person_seq, CASE WHEN size = 1 THEN g.base WHEN best.k IS NOT NULL THEN v.lab WHEN nth = 1 THEN g.base ELSE g.base || ' (' || nth || ')' END AS label, 'person' AS kind, g.person AS names
    FROM g LEFT JOIN best ON best.case_id = g.case_id AND best.base = g.base LEFT JOIN v ON v.case_id = g.case_id AND v.person = g.person AND v.k = best.k
    UNION ALL SELECT DISTINCT case_id, 0, 'Mandant', 'mandant', 'Robin Kinzel' FROM m UNION ALL SELECT DISTINCT case_id, 1, 'Gegner', 'gegner', '' FROM m"""


@query(_PERSONS_SQL)
def q_persons(spark, sf_dir):
    return _analysis(spark, sf_dir).persons.select("case_id", "person_seq", "label", "kind", F.array_join("names", ";").alias("names"))


# What each line of a letter must give. A name's label: all owners of its last token within the case. The client's name wins whole; its parts are looked for
# before salutations (so Robin loses the first name, and another Kinzel takes over the part's priority), and these before names found elsewhere.
_ANALYSIS_SQL = f"""WITH p AS ({_PERSONS_SQL}), {LETTERS},
    t AS (SELECT case_id, unnest(string_split(names, ' ')) AS token, person_seq, label FROM p WHERE names <> ''),
    o AS (SELECT case_id, token, string_agg(label, '/' ORDER BY person_seq) AS lab FROM t GROUP BY ALL),
    d AS (SELECT (doc_id // 20)::VARCHAR AS case_id, doc_id, text, person, string_split(person, ' ')[1] AS f, string_split(person, ' ')[2] AS l FROM letters),
    a AS (SELECT d.*, x.lab AS of_l, y.lab AS of_f FROM d JOIN o x ON x.case_id = d.case_id AND x.token = l JOIN o y ON y.case_id = d.case_id AND y.token = f),
    h AS (
        SELECT case_id, doc_id, 1 AS nth, CASE WHEN f = 'Robin' AND l <> 'Kinzel' THEN f ELSE person END AS text, CASE WHEN person = 'Robin Kinzel' THEN 'Mandant' WHEN f = 'Robin' THEN of_f ELSE of_l END AS label, 'name' AS category,
            CASE WHEN person = 'Robin Kinzel' THEN 10 WHEN f = 'Robin' OR l = 'Kinzel' THEN 40 ELSE 45 END AS priority FROM a
        UNION ALL SELECT case_id, doc_id, 2, l, of_l, 'name', 45 FROM a WHERE f = 'Robin' AND l <> 'Kinzel'
        UNION ALL SELECT case_id, doc_id, 3, regexp_extract(text, 'Tel. ([0-9/]+)', 1), 'Telefon', 'telefon', 20 FROM a
        UNION ALL SELECT case_id, doc_id, 4, regexp_extract(text, 'Mobil: ([0-9 ]+)', 1), 'Handy', 'telefon', 20 FROM a WHERE text LIKE '%Mobil: %'
        UNION ALL SELECT case_id, doc_id, 5, regexp_extract(text, 'E-Mail: ([^\\n]+)', 1), 'E-Mail', 'email', 20 FROM a
        UNION ALL SELECT case_id, doc_id, 6, regexp_extract(text, 'IBAN: ([^\\n]+)', 1), 'IBAN', 'iban', 20 FROM a
        UNION ALL SELECT case_id, doc_id, 7, regexp_extract(text, 'Konto-Nr.: ([0-9]+)', 1), 'Konto-Nr.', 'iban', 20 FROM a WHERE text LIKE '%Konto-Nr.%'
        UNION ALL SELECT case_id, doc_id, 8, regexp_extract(text, 'geb(\\. |oren am )([0-9.]{{10}})', 2), 'Geb.-Datum', 'geburtsdatum', 20 FROM a
        UNION ALL SELECT case_id, doc_id, 9, regexp_extract(text, '[0-9]{{4}} in ([^\\n]+)', 1), 'Geb.-Ort', 'geburtsdatum', 20 FROM a WHERE doc_id % 5 = 0
        UNION ALL SELECT case_id, doc_id, 10, regexp_extract(text, '(SV-Nr.|Versichertennummer): ([A-Z0-9]+)', 2), CASE WHEN doc_id % 3 = 0 THEN 'SV-Nr.' ELSE 'Vers.-Nr.' END, 'versicherung', 20 FROM a WHERE doc_id % 3 < 2
        UNION ALL SELECT case_id, doc_id, 11, l, 'Geburtsname', 'name', 20 FROM a WHERE doc_id % 3 = 2
        UNION ALL SELECT case_id, doc_id, 12, l, of_l, 'name', CASE WHEN l = 'Kinzel' THEN 40 ELSE 50 END FROM a
        UNION ALL SELECT case_id, doc_id, 13, l || 's', of_l, 'name', CASE WHEN l = 'Kinzel' THEN 40 ELSE 50 END FROM a WHERE doc_id % 7 = 0)
    SELECT case_id, doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY nth) - 1)::INT AS seq, text, label, category, priority::INT AS priority, CASE WHEN category = 'name' THEN 'name|' || label ELSE category || '|' || lower(text) END AS grp FROM h"""


@query(_ANALYSIS_SQL)
def q_analysis(spark, sf_dir):
    return _analysis(spark, sf_dir).hits.select("case_id", "doc_id", "seq", "text", "label", "category", "priority", "grp")


# ---- hits: groups, decisions, review

HITS_SQL = """SELECT o_custkey AS doc_id, o_orderkey AS seq, CAST(o_orderkey % 3 AS INT) AS page_no, CAST(o_orderkey % 700 AS DOUBLE) AS y0,
    CASE o_orderkey % 6 WHEN 0 THEN 'Mandant' WHEN 1 THEN 'Gegner' WHEN 2 THEN 'E.M.' WHEN 3 THEN 'Telefon' WHEN 4 THEN 'E-Mail' ELSE 'Adresse Mandant' END AS label,
    CASE o_orderkey % 6 WHEN 3 THEN 'telefon' WHEN 4 THEN 'email' WHEN 5 THEN 'adresse' ELSE 'name' END AS category,
    CASE o_orderkey % 6 WHEN 3 THEN '06433/' ELSE 'Wert ' END || CAST(o_orderkey % 20 AS STRING) AS text,
    CAST(CASE o_orderkey % 4 WHEN 0 THEN 10 WHEN 1 THEN 20 WHEN 2 THEN 45 ELSE 99 END AS INT) AS priority,
    o_orderkey % 4 <> 0 AS enabled, CASE WHEN o_orderkey % 35 = 0 THEN 'Frage ' || CAST(o_orderkey AS STRING) ELSE '' END AS question FROM orders"""
HITS = f"hits AS ({HITS_SQL})"
GROUPED = f"{HITS}, keyed AS (SELECT *, CASE WHEN category = 'name' THEN 'name|' || label ELSE category || '|' || lower(text) END AS grp FROM hits)"


def _hits(spark, sf_dir) -> DataFrame:
    rows = spark.sql(HITS_SQL.replace("FROM orders", "FROM {orders}"), orders=views.read(spark, sf_dir, "orders"))
    segments = F.array(F.struct(F.lit(0).alias("word"), F.lit(None).cast("int").alias("c0"), F.lit(None).cast("int").alias("c1")))
    return rows.withColumns({"case_id": F.lit("all"), "doc_seq": F.col("doc_id").cast("int"), "segments": segments})


@query(f"""WITH {GROUPED}, f AS (SELECT grp, arg_min(question, (doc_id, page_no, seq)) AS q FROM keyed WHERE question <> '' GROUP BY grp)
    SELECT doc_id, seq, k.grp, CASE WHEN question = '' THEN coalesce(q, '') ELSE question END AS question FROM keyed k LEFT JOIN f ON k.grp = f.grp""")
def q_groups(spark, sf_dir):
    return groups.assign_groups(_hits(spark, sf_dir)).select("doc_id", "seq", "grp", "question")


@query(f"""WITH {GROUPED} SELECT doc_id, seq, CASE WHEN seq % 50 = 0 THEN true WHEN grp = 'name|E.M.' THEN false ELSE enabled END AS enabled FROM keyed""")
def q_decisions(spark, sf_dir):
    hits = groups.assign_groups(_hits(spark, sf_dir))
    schema = "case_id string, grp string, doc_id long, page_no int, seq long, enabled boolean, at int"
    by_group = spark.createDataFrame([("all", "name|E.M.", None, None, None, True, 1), ("all", "name|E.M.", None, None, None, False, 2)], schema)
    single = hits.where("seq % 50 = 0").select("case_id", F.lit(None).cast("string").alias("grp"), "doc_id", "page_no", "seq", F.lit(True).alias("enabled"), F.lit(3).alias("at"))
    return groups.apply_decisions(hits, by_group.unionByName(single)).select("doc_id", "seq", "enabled")


@query(f"WITH {GROUPED} SELECT doc_id, seq FROM keyed WHERE grp = 'telefon|06433/3'")
def q_group_members(spark, sf_dir):
    return groups.members(groups.assign_groups(_hits(spark, sf_dir)), "telefon|06433/3").select("doc_id", "seq")


@query(f"WITH {HITS} SELECT label, count(*) AS n FROM (SELECT replace(label, 'E.M.', 'Zeugin') AS label FROM hits) GROUP BY label")
def q_rename(spark, sf_dir):
    return groups.rename_label(_hits(spark, sf_dir), "E.M.", "Zeugin").groupBy("label").agg(F.count("*").alias("n"))


@query(f"""WITH {HITS}, s AS (SELECT label, count(*) FILTER (doc_id = 1) AS here, count(*) AS total, count(*) FILTER (doc_id = 1 AND enabled) AS on_, any_value(category) AS category FROM hits GROUP BY label)
    SELECT label, here, total, CASE WHEN on_ = here THEN 'all' WHEN on_ = 0 THEN 'none' ELSE 'some' END AS state, (CASE WHEN label LIKE 'Mandant%' THEN 0 WHEN label LIKE 'Gegner%' THEN 1 WHEN category = 'name' THEN 2 ELSE 3 END)::INT AS rank FROM s WHERE here > 0""")
def q_label_summary(spark, sf_dir):
    return review.label_summary(_hits(spark, sf_dir), 1)


@query(f"""WITH {GROUPED} SELECT grp, arg_min(text, (doc_id, seq)) AS text, arg_min(label, (doc_id, seq)) AS label, arg_min(question, (doc_id, seq)) AS question, count(*) AS places, count(DISTINCT doc_id) AS docs, arg_min(enabled, (doc_id, seq)) AS enabled
    FROM keyed WHERE question <> '' GROUP BY grp""")
def q_questions(spark, sf_dir):
    hits = _hits(spark, sf_dir).withColumn("grp", groups.group_key(F.col("category"), F.col("label"), F.col("text"), F.col("segments")))
    return review.open_questions(hits)


@query(f"""WITH {HITS} SELECT c_custkey AS doc_id, (c_custkey % 9 + 1)::INT AS pages, coalesce(n, 0) AS "on", CASE WHEN c_custkey % 5 = 0 THEN 'exported' WHEN c_custkey % 2 = 0 THEN 'analyzed' ELSE 'new' END AS state
    FROM customer LEFT JOIN (SELECT doc_id, count(*) AS n FROM hits WHERE enabled GROUP BY doc_id) ON doc_id = c_custkey""")
def q_doc_list(spark, sf_dir):
    docs = views.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), (F.col("c_custkey") % 9 + 1).cast("int").alias("pages"), F.when(F.col("c_custkey") % 5 == 0, "x.pdf").alias("exported_to"), (F.col("c_custkey") % 2 == 0).alias("analyzed"))
    return review.document_list(docs, _hits(spark, sf_dir))


@query("SELECT c_custkey AS doc_id FROM customer WHERE c_custkey % 2 <> 0")
def q_pending(spark, sf_dir):
    return review.pending(views.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), (F.col("c_custkey") % 2 == 0).alias("analyzed"))).select("doc_id")


@query(f"""WITH {LETTERS}, {_words_sql('letters')}, {HITS}, h AS (SELECT doc_id, count(*) AS n FROM hits WHERE enabled AND page_no = 0 GROUP BY doc_id)
    SELECT w.doc_id, 0 AS page_no, count(*) AS words, coalesce(any_value(n), 0) AS "on" FROM words w LEFT JOIN h ON h.doc_id = w.doc_id GROUP BY w.doc_id""")
def q_page_info(spark, sf_dir):
    return review.page_info(_letter_words(spark, sf_dir), _hits(spark, sf_dir))


def _unread(spark, sf_dir) -> DataFrame:
    rows = views.read(spark, sf_dir, "lineitem")
    return rows.select((F.col("l_orderkey") % 97).alias("doc_id"), (F.col("l_orderkey") / 97).cast("int").alias("p"), F.col("l_quantity")).groupBy("doc_id", F.col("p").alias("page_no")).agg(F.count_if(F.col("l_quantity") > 40).cast("int").alias("unread"), F.when(F.col("page_no") % 3 == 0, "ocr").otherwise("text").alias("source"))


UNREAD = "pages AS (SELECT l_orderkey % 97 AS doc_id, (l_orderkey // 97)::INT AS page_no, count(*) FILTER (l_quantity > 40)::INT AS unread, CASE WHEN (l_orderkey // 97) % 3 = 0 THEN 'ocr' ELSE 'text' END AS source FROM lineitem GROUP BY ALL)"


@query(f"WITH {UNREAD} SELECT count(DISTINCT doc_id) AS docs, count(*) AS pages, count(*) FILTER (source = 'ocr') AS recognised, sum(unread)::BIGINT AS unread FROM pages")
def q_load_summary(spark, sf_dir):
    return review.load_summary(_unread(spark, sf_dir))


@query(f"WITH {UNREAD} SELECT doc_id, sum(unread)::BIGINT AS total, array_to_string(list_sort(list(page_no))[1:8], ',') AS pages FROM pages WHERE unread > 0 GROUP BY doc_id")
def q_unread(spark, sf_dir):
    return review.unread_pages(_unread(spark, sf_dir))


@query(f"WITH {UNREAD}, n AS (SELECT *, max(page_no) OVER (PARTITION BY doc_id) + 1 AS n FROM pages) SELECT doc_id, arg_min(page_no, ((page_no - 6) % n + n) % n) AS next_page FROM n WHERE unread > 0 GROUP BY doc_id")
def q_next_unread(spark, sf_dir):
    return review.next_unread(_unread(spark, sf_dir), 5)


@query(f"WITH {HITS} SELECT DISTINCT label FROM hits UNION SELECT unnest(['{(chr(39) + ', ' + chr(39)).join(['Mandant', 'Gegner', 'Adresse Mandant', 'Adresse Gegner', *enums.CATEGORY_LABELS.values()])}'])")
def q_vocabulary(spark, sf_dir):
    return review.vocabulary(_hits(spark, sf_dir))


@query(f"WITH {HITS} SELECT CASE priority WHEN 10 THEN 'Eingabe' WHEN 20 THEN 'Regel' WHEN 45 THEN 'Regel (Anrede)' ELSE '?' END AS source, count(*) AS n FROM hits GROUP BY 1")
def q_sources(spark, sf_dir):
    return review.source_summary(_hits(spark, sf_dir))


# ---- export


def _letter_marks(spark, sf_dir) -> DataFrame:
    letters = _letters(spark, sf_dir).select("doc_id", F.lit(0).alias("page_no"), "text")
    rows = patterns.detect_patterns(letters, ["email", "iban"]).select("doc_id", "page_no", "text", F.explode_outer("found").alias("h")).where("h IS NOT NULL")
    return rows.select("doc_id", "page_no", F.col("h.s").alias("s"), F.col("h.e").alias("e"), "h.label", F.lit(True).alias("enabled"), F.substring(F.col("text"), F.col("h.s") + 1, F.col("h.e") - F.col("h.s")).alias("text"))


@query(f"""WITH {LETTERS} SELECT doc_id, 0 AS page_no, regexp_replace(regexp_replace(regexp_replace(text, 'E-Mail: [^\\n]+', 'E-Mail: [E-Mail]'), 'IBAN: [^\\n]+', 'IBAN: [IBAN]'), 'Konto-Nr.: [0-9]+', 'Konto-Nr.: [Konto-Nr.]') AS redacted,
    (2 + (doc_id % 4 = 0)::INT)::INT AS redactions FROM letters""")
def q_redact_text(spark, sf_dir):
    return export.redact_pages(_letters(spark, sf_dir).select("doc_id", F.lit(0).alias("page_no"), "text"), _letter_marks(spark, sf_dir))


@query(f"WITH {LETTERS} SELECT doc_id, 0 AS page_no, string_split(person, ' ')[2] AS text, 'Name' AS label FROM letters")
def q_leaks(spark, sf_dir):
    letters = _letters(spark, sf_dir).select("doc_id", F.lit(0).alias("page_no"), "text", "person")
    own = letters.select("doc_id", "page_no", F.lit(0).alias("s"), (5 + F.length("person")).alias("e"), F.lit("Name").alias("label"), F.lit(True).alias("enabled"), F.element_at(F.split("person", " "), 2).alias("text"))
    hits = own.unionByName(_letter_marks(spark, sf_dir))
    return export.leaks(hits, export.redact_pages(letters, hits))


@query(f"""WITH {LETTERS} SELECT doc_id, 'Mandant_' || 'Mandant' || '_Klage 2024' || doc_id AS stem, '/out/Mandant_Mandant_Klage 2024' || doc_id || '_geschwärzt.pdf' AS target FROM letters""")
def q_neutral_names(spark, sf_dir):
    letters = _letters(spark, sf_dir)
    parts = export.name_parts(letters.select("doc_id", F.lit(0).alias("seq"), F.col("person").alias("text"), F.lit("Mandant").alias("label"), F.lit("name").alias("category"), F.lit(True).alias("enabled")))
    name = F.split("person", " ")
    stems = letters.select("doc_id", F.concat(F.lower(name[1]), F.lit("_"), name[0], F.lit("_Klage 2024"), F.col("doc_id").cast("string")).alias("stem"))
    stems = met(stems, parts, "doc_id")
    return stems.select("doc_id", export.neutral_stem(F.col("stem"), F.transform("parts", lambda p: F.struct(p["part"].alias("part"), p["label"].alias("label")))).alias("stem")).select("*", export.output_path(F.lit("/out"), F.col("stem")).alias("target"))


@query("SELECT c_custkey AS doc_id, 'Akte' || c_custkey % 100 || '_' || row_number() OVER (ORDER BY c_custkey) || '.pdf' AS target FROM customer")
def q_unique_targets(spark, sf_dir):
    rows = views.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.concat(F.lit("Akte"), (F.col("c_custkey") % 100).cast("string"), F.lit(".pdf")).alias("target"))
    return export.unique_targets(rows)


@query("SELECT o_orderkey, floor((o_orderkey % 500) * 300 / 72.0)::BIGINT AS x0, least(2480, ceil((o_orderkey % 500 + 33.3) * 300 / 72.0)::BIGINT) AS x1 FROM orders")
def q_pixel_rects(spark, sf_dir):
    x = F.col("o_orderkey") % 500
    rect = export.pixel_rect(x.cast("double"), F.lit(0.0), x + F.lit(33.3), F.lit(9.0), 300, F.lit(2480), F.lit(3508))
    return views.read(spark, sf_dir, "orders").select("o_orderkey", rect.alias("r")).select("o_orderkey", F.col("r.x0").cast("long").alias("x0"), F.col("r.x1").cast("long").alias("x1"))


@query(f"WITH {HITS} SELECT doc_id, seq FROM hits WHERE page_no = 1 AND enabled AND y0 >= 10")
def q_hits_on_page(spark, sf_dir):
    rect = F.struct(F.lit(50.0).alias("x0"), F.col("y0"), F.lit(90.0).alias("x1"), (F.col("y0") + 9).alias("y1"))
    hits = _hits(spark, sf_dir).withColumn("rects", F.when(F.col("y0") >= 10, F.array(rect)).otherwise(F.array().cast(f"array<{schemas.RECT}>")))
    return export.active(export.on_page(hits, 1)).select("doc_id", "seq")


_WIDTHS = "[" + ", ".join(map(str, export.HELVETICA)) + "]"


@query(f"""WITH {LETTERS}, p AS (SELECT DISTINCT person, length(person) + 9.0 AS w FROM letters), f AS (SELECT person, w, substr(person, 1, 1) || '.' AS short,
        list_sum(list_transform(string_split(translate(person, 'äöüÄÖÜß', 'aouAOUg'), ''), lambda c: ({_WIDTHS})[ord(c) - 31])) / 1000.0 AS tw, list_sum(list_transform(string_split(translate(substr(person, 1, 1) || '.', 'äöüÄÖÜß', 'aouAOUg'), ''), lambda c: ({_WIDTHS})[ord(c) - 31])) / 1000.0 AS sw FROM p),
    s AS (SELECT *, CASE WHEN tw * 7.2 > w - 2 THEN 7.2 * (w - 2) / (tw * 7.2) ELSE 7.2 END AS long_size, CASE WHEN sw * 7.2 > w - 2 THEN 7.2 * (w - 2) / (sw * 7.2) ELSE 7.2 END AS short_size FROM f)
    SELECT person, CASE WHEN long_size >= 4.5 THEN person ELSE short END AS text, round(CASE WHEN long_size >= 4.5 THEN long_size ELSE short_size END, 6)::DOUBLE AS size FROM s""")
def q_label_fit(spark, sf_dir):
    rows = _letters(spark, sf_dir).select("person").distinct()
    fit = export.fitted_label(F.col("person"), F.concat(F.substring("person", 1, 1), F.lit(".")), F.length("person") + 9.0, F.lit(10.0))
    return rows.select("person", fit.alias("f")).select("person", "f.text", F.round("f.size", 6).alias("size"))


@query("SELECT o_orderkey, '/akten/' || CASE o_orderkey % 3 WHEN 0 THEN '' ELSE 'neu/' END || o_orderkey || '.pdf' AS path FROM orders")
def q_resolved_paths(spark, sf_dir):
    from tintwerk.sources.files import resolved

    key = F.col("o_orderkey").cast("string")
    path = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("file:///akten/alt/../"), key)).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("/akten//neu/./"), key)).otherwise(F.concat(F.lit("/akten/neu/x/../"), key))
    return views.read(spark, sf_dir, "orders").select("o_orderkey", resolved(F.concat(path, F.lit(".pdf"))).alias("path"))


# ---- recognition


@query(f"""WITH {_words_sql('documents')}, c AS (SELECT DISTINCT text, trim(text, '.,;:!?()"„“') AS core FROM words)
    SELECT text, regexp_matches(text, '{recognition.PLAUSIBLE}') AND NOT (regexp_matches(core, '^\\p{{L}}+$') AND (length(core) >= 4 AND NOT regexp_matches(core, '[aeiouyäöüAEIOUYÄÖÜ]') OR length(core) >= 5 AND len(list_distinct(string_split(lower(core), ''))) < 3)) AS plausible FROM c""")
def q_word_quality(spark, sf_dir):
    each = views.documents(spark, sf_dir).select(F.explode(tx.words(F.col("text"))).alias("text")).distinct()
    return each.select("text", recognition.plausible_word(F.col("text")).alias("plausible"))


@query(f"WITH {_words_sql('documents')} SELECT doc_id AS page_key, count(*) FILTER (regexp_matches(text, '{recognition.GOOD}')) AS quality FROM words GROUP BY doc_id")
def q_text_quality(spark, sf_dir):
    return recognition.text_quality(views.documents(spark, sf_dir).select(F.col("doc_id").alias("page_key"), F.explode(tx.words(F.col("text"))).alias("text")))


_REGION = "SELECT l_orderkey AS region, CASE WHEN l_linenumber % 3 = 0 THEN 'Xyq#' ELSE 'Rechnung' END AS text, CAST(0 AS DOUBLE) AS x0, CAST(0 AS DOUBLE) AS y0, CAST(CASE WHEN l_linenumber % 3 = 0 THEN 24 ELSE 48 END AS DOUBLE) AS x1, l_quantity AS y1 FROM lineitem"


@query(f"""WITH r AS ({_REGION}), g AS (SELECT region, count(*) AS n, count(*) FILTER (text = 'Rechnung' AND 6.0 BETWEEN 0.15 * greatest(y1, 1.0) AND 1.3 * greatest(y1, 1.0)) AS good, list_sort(list(y1)) AS h FROM r GROUP BY region)
    SELECT region, good >= 0.5 * n AND h[len(h) // 2 + 1] <= 1.6 * 20 AS plausible FROM g""")
def q_region_filter(spark, sf_dir):
    return recognition.plausible_regions(spark.sql(_REGION.replace("FROM lineitem", "FROM {lineitem}"), lineitem=views.read(spark, sf_dir, "lineitem")), 20.0)


@query("""WITH p AS (SELECT l_orderkey % 50 AS key, (l_orderkey // 50)::BIGINT AS pos, sum(l_quantity) AS value FROM lineitem GROUP BY ALL), f AS (SELECT key, pos FROM p WHERE value >= 120),
    g AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY key ORDER BY pos) <= 3 THEN 0 ELSE 1 END AS new FROM f), b AS (SELECT *, sum(new) OVER (PARTITION BY key ORDER BY pos) AS band FROM g)
    SELECT key, min(pos) AS start, max(pos) + 1 AS "end" FROM b GROUP BY key, band""")
def q_bands(spark, sf_dir):
    rows = views.read(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 50).alias("key"), F.floor(F.col("l_orderkey") / 50).alias("pos")).agg(F.sum("l_quantity").alias("value"))
    return recognition.bands(rows, 120, 2)


@query("SELECT o_orderkey, (CASE WHEN b >= 3 AND b >= 0.45 * 40 THEN 0 WHEN greatest(q1, q2, q3) > b AND greatest(q1, q2, q3) >= greatest(10, 2 * b) THEN CASE WHEN q1 >= greatest(q2, q3) THEN 90 WHEN q2 >= q3 THEN 180 ELSE 270 END ELSE 0 END)::INT AS turn FROM (SELECT o_orderkey, o_orderkey % 23 AS b, o_orderkey % 31 AS q1, o_orderkey % 37 AS q2, o_orderkey % 41 AS q3 FROM orders)")
def q_orientation(spark, sf_dir):
    k = F.col("o_orderkey")
    return views.read(spark, sf_dir, "orders").select("o_orderkey", recognition.orientation(k % 23, F.lit(40), k % 31, k % 37, k % 41).alias("turn"))


@query("SELECT l_orderkey % 300 AS page_key, round(max(greatest(0, least(100, l_quantity + 30) - l_quantity) * greatest(0, least(50, l_quantity * 2) - l_quantity)) / 5000, 6) AS coverage FROM lineitem GROUP BY 1")
def q_image_coverage(spark, sf_dir):
    q = F.col("l_quantity")
    rows = views.read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 300).alias("page_key"), q.alias("x0"), q.alias("y0"), (q + 30).alias("x1"), (q * 2).alias("y1"), F.lit(100.0).alias("width"), F.lit(50.0).alias("height"))
    return recognition.image_coverage(rows).select("page_key", F.round("coverage", 6).alias("coverage"))


@query("SELECT doc_id, length(trim(text, ' ')) < 30 OR doc_id % 10 = 0 AS needed FROM documents")
def q_needs_recognition(spark, sf_dir):
    return views.documents(spark, sf_dir).select("doc_id", words.needs_recognition(F.col("text"), F.when(F.col("doc_id") % 10 == 0, 0.6).otherwise(0.1)).alias("needed"))


_RAW_WORDS = "SELECT l_orderkey % 200 AS page_key, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS pos, CASE WHEN l_linenumber = 7 THEN ' ' ELSE ' ' || l_returnflag || CAST(l_linenumber AS STRING) END AS text, l_quantity / 4 AS x0, l_tax * 100 AS y0, l_quantity / 4 + 9 AS x1, l_tax * 100 + 9 AS y1, l_suppkey % 3 AS block, l_linenumber AS line FROM lineitem"


@query(f"""WITH r AS ({_RAW_WORDS}), k AS (SELECT *, trim(text) AS t FROM r WHERE trim(text) <> ''), d AS (SELECT *, row_number() OVER (PARTITION BY page_key, t, round_even(x0, 0), round_even(y0, 0) ORDER BY pos) AS nth FROM k),
    f AS (SELECT *, min(pos) OVER (PARTITION BY page_key, block, line) AS first FROM d WHERE nth = 1) SELECT page_key, t AS text, count(*) AS n, max(line_no)::INT AS line_no FROM (SELECT *, dense_rank() OVER (PARTITION BY page_key ORDER BY first) - 1 AS line_no FROM f) GROUP BY page_key, t""")
def q_native_words(spark, sf_dir):
    raw = spark.sql(_RAW_WORDS.replace("FROM lineitem", "FROM {lineitem}"), lineitem=views.read(spark, sf_dir, "lineitem"))
    return words.native_words(raw).groupBy("page_key", "text").agg(F.count("*").alias("n"), F.max("line_no").alias("line_no"))


# ---- overlaps


@query(f"""WITH {LETTERS} SELECT doc_id, person AS text, 'Mandant' AS label, 10 AS priority FROM letters""")
def q_absorb(spark, sf_dir):
    pages = views.pages_of(_letters(spark, sf_dir).select("doc_id", F.col("person").alias("text")))
    hit = lambda stage, first, last, text, priority: pages.select(
        *analysis.PAGE, F.lit(stage).alias("stage"), F.lit(0).alias("nth"), F.transform(F.sequence(F.lit(first), F.lit(last)), lambda i: F.struct(i.alias("word"), F.lit(None).cast("int").alias("c0"), F.lit(None).cast("int").alias("c1"))).alias("segments"),
        text.alias("text"), F.lit("Mandant").alias("label"), F.lit("name").alias("category"), F.lit(priority).alias("priority"), F.array().cast(f"array<{schemas.RECT}>").alias("rects"), F.lit(True).alias("enabled"), F.lit("").alias("question"))
    whole = words.page_text(F.col("words"))
    hits = hit(0, 0, 1, whole, 40).unionByName(hit(1, 1, 1, F.element_at(F.split(whole, " "), 2), 10))
    return analysis.resolve_pages(pages, hits).select("doc_id", "text", "label", "priority")


@query(f"""WITH {LETTERS}, {_words_sql('letters')} SELECT doc_id, word_no::INT AS word, 0 AS c0, 4 AS c1, 'A' AS label, substr(text, 1, 4) AS text FROM words WHERE length(text) >= 6
    UNION ALL SELECT doc_id, word_no, 4, length(text), 'B', substr(text, 5) FROM words WHERE length(text) >= 6 AND trim(substr(text, 5), ' .,;:') <> ''""")
def q_overlap(spark, sf_dir):
    pages = views.pages_of(_letters(spark, sf_dir))
    own = words.exploded(pages).where(F.length("text") >= 6).withColumn("doc_seq", F.col("doc_id").cast("int"))
    hit = lambda stage, c0, c1, label, priority: own.select(
        *analysis.PAGE, F.lit(stage).alias("stage"), F.col("word_no").alias("nth"), F.array(F.struct(F.col("word_no").alias("word"), c0.cast("int").alias("c0"), c1.cast("int").alias("c1"))).alias("segments"),
        (F.substring("text", 1, 4) if label == "A" else F.col("text")).alias("text"), F.lit(label).alias("label"), F.lit("x").alias("category"), F.lit(priority).alias("priority"), F.array().cast(f"array<{schemas.RECT}>").alias("rects"), F.lit(True).alias("enabled"), F.lit("").alias("question"))
    hits = hit(0, F.lit(2), F.lit(None), "B", 20).unionByName(hit(1, F.lit(None), F.lit(4), "A", 10))
    out = analysis.resolve_pages(pages, hits).select("doc_id", "label", "text", F.explode("segments").alias("g")).withColumn("word_no", F.col("g.word"))
    out = met(out, own.select("doc_id", "word_no", F.length("text").alias("n")), ["doc_id", "word_no"])
    return out.select("doc_id", "g.word", F.coalesce("g.c0", F.lit(0)).alias("c0"), F.coalesce("g.c1", "n").alias("c1"), "label", "text")


# ---- more of the text, geometry and finding layers


@query(f"""WITH {LETTERS} SELECT DISTINCT person, list_transform(string_split(person, ' '), lambda t: {_norm_sql('t')})[1] AS first, list_transform(string_split(person, ' '), lambda t: {_norm_sql('t')})[2] AS last, 2 AS n, 'Herr ' || person AS titled FROM letters""")
def q_name_tokens(spark, sf_dir):
    rows = _letters(spark, sf_dir).select("person", F.concat(F.lit("Herr "), "person").alias("titled")).distinct()
    rows = rows.withColumn("t", tx.name_tokens(F.concat(F.lit("Frau Dr. "), "person")))
    return rows.select("person", F.col("t")[0].alias("first"), F.col("t")[1].alias("last"), F.size("t").alias("n"), "titled")


@query(f"""WITH {LETTERS} SELECT DISTINCT person, replace(person, ' ', ' von ') AS turned FROM letters""")
def q_name_words(spark, sf_dir):
    name = F.split("person", " ")
    listed = F.concat(F.lit("Frau Dr. "), name[1], F.lit(", "), name[0], F.lit(" von"))
    return _letters(spark, sf_dir).select("person", F.array_join(F.transform(tx.name_words(listed), lambda w: w["w"]), " ").alias("turned")).distinct()


@query("""SELECT c_custkey AS doc_id, (c_custkey % 5 + 1)::INT AS n_values, (2 * (c_custkey % 5 + 1) + (c_custkey % 3 = 0)::INT)::INT AS n_parts FROM customer""")
def q_split_values(spark, sf_dir):
    """One to five addresses, each with its number, parted in several ways; every third row has a part more in its last."""
    each = F.transform(F.sequence(F.lit(0), (F.col("c_custkey") % 5).cast("int")), lambda i: F.concat(F.lit(" Weg "), i.cast("string"), F.lit(", 1234"), i.cast("string"), F.lit(" Ort, x")))
    text = F.concat(F.lit(" ;"), F.when(F.col("c_custkey") % 2 == 0, F.array_join(each, ";")).otherwise(F.array_join(each, " \n;\n")), F.when(F.col("c_custkey") % 3 == 0, ", Hof").otherwise(" ;"))
    return views.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.size(tx.split_values(text)).alias("n_values"), F.size(tx.address_parts(text)).alias("n_parts"))


# Java's \b and \w know all letters; in this engine they are written out.
_ORGANISATION_SQL = "(^|[^\\p{L}\\p{N}_])(?i:" + enums.ORGANISATION.removeprefix(r"\b(").removesuffix(r")\b").replace(r"\w", "[\\p{L}\\p{N}_]") + ")([^\\p{L}\\p{N}_]|$)"
_NAMES_SQL = f"""names AS (SELECT DISTINCT text AS name FROM words UNION SELECT person FROM letters UNION SELECT person || ' GmbH' FROM letters UNION SELECT 'Praxis ' || person FROM letters UNION SELECT string_split(person, ' ')[2] || 'versicherung' FROM letters
    UNION SELECT 'Amtsgericht ' || string_split(person, ' ')[1] FROM letters UNION SELECT 'Rechtsanwältin ' || person FROM letters UNION SELECT 'RAin ' || person FROM letters)"""


def _names(spark, sf_dir) -> DataFrame:
    """The words of all documents, and names with and without what marks organisations and professionals."""
    person, part = F.col("person"), F.split("person", " ")
    made = F.array(person, F.concat(person, F.lit(" GmbH")), F.concat(F.lit("Praxis "), person), F.concat(part[1], F.lit("versicherung")), F.concat(F.lit("Amtsgericht "), part[0]), F.concat(F.lit("Rechtsanwältin "), person), F.concat(F.lit("RAin "), person))
    return views.documents(spark, sf_dir).select(F.explode(tx.words(F.col("text"))).alias("name")).unionByName(_letters(spark, sf_dir).select(F.explode(made).alias("name"))).distinct()


@query(f"WITH {LETTERS}, {_words_sql('documents')}, {_NAMES_SQL} SELECT name, regexp_matches(name, '{_ORGANISATION_SQL}') AS organisation FROM names")
def q_organisation(spark, sf_dir):
    return _names(spark, sf_dir).select("name", tx.is_organisation(F.col("name")).alias("organisation"))


@query(f"""WITH {LETTERS}, v AS (SELECT doc_id, bban, lpad(((98 - ((bban::BIGINT % 97) * 27 + 131400) % 97 + doc_id % 3) % 100)::VARCHAR, 2, '0') AS c FROM letters)
    SELECT doc_id, 'DE' || c || bban AS iban, ((bban::HUGEINT % 97) * 27 + 131400 + c::INT) % 97 = 1 AS valid FROM v""")
def q_iban_valid(spark, sf_dir):
    check = (98 - ((F.col("bban").cast("long") % 97) * 27 + 131400) % 97 + F.col("doc_id") % 3) % 100
    rows = _letters(spark, sf_dir).select("doc_id", F.concat(F.lit("DE"), F.lpad(check.cast("string"), 2, "0"), "bban").alias("iban"))
    return rows.select("doc_id", "iban", patterns.iban_valid(F.col("iban")).alias("valid"))


@query(f"WITH {LETTERS}, {_words_sql('documents')}, {_NAMES_SQL} SELECT name, regexp_matches(lower(name), 'rechtsanw|notar|richter|sachverständig|gutachter|(^|[^\\p{{L}}\\p{{N}}_])ra(in)?([^\\p{{L}}\\p{{N}}_]|$)') AS professional FROM names")
def q_professional(spark, sf_dir):
    return _names(spark, sf_dir).select("name", names.professional(F.col("name")).alias("professional"))


@query(f"""WITH {LETTERS}, {_words_sql('letters')}, b AS (SELECT doc_id, word_no, text, 50 + 6 * (start - min(start) OVER (PARTITION BY doc_id, line_no)) AS x0, 50 + 14 * line_no AS y0 FROM words)
    SELECT doc_id, string_agg(text, ' ' ORDER BY word_no) AS term FROM b WHERE x0 + 3 * length(text) BETWEEN 60 AND 140 AND y0 + 5 BETWEEN 50 AND 80 GROUP BY doc_id""")
def q_words_in_rect(spark, sf_dir):
    from tintwerk.plans.edits import term_in_rect

    return term_in_rect(_letter_words(spark, sf_dir), 60, 50, 140, 80).select("doc_id", "term")


@query(f"""WITH {LETTERS} SELECT doc_id, 1 AS word_no, string_split(person, ' ')[1] AS text FROM letters WHERE length(string_split(person, ' ')[1]) * 6 + 81 >= 100""")
def q_word_at(spark, sf_dir):
    return words.word_at(_letter_words(spark, sf_dir), 100.0, 55.0).select("doc_id", "word_no", "text")


@query(f"""WITH {_words_sql('documents')}, t AS (SELECT DISTINCT text FROM words WHERE length(text) >= 3),
    c AS (SELECT text, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS i FROM t),
    w AS (SELECT text, i, CASE WHEN strpos(',.;:!|''`´il1Ijtf()[]/\\-', c) > 0 THEN 0.45 WHEN strpos('mwMWÄÖÜ@%&QGOD', c) > 0 THEN 1.35 WHEN regexp_matches(c, '[\\p{{Lu}}\\p{{Nd}}]') THEN 1.1 ELSE 1.0 END AS w FROM c),
    s AS (SELECT text, sum(w)::DOUBLE AS total, sum(w) FILTER (i <= 1)::DOUBLE AS a, sum(w) FILTER (i <= length(text) - 1)::DOUBLE AS b FROM w GROUP BY text)
    SELECT text, round(greatest(0, 60 * a / total - 0.45 * 60 / total), 6) AS x0, round(least(60, 60 * b / total + 0.45 * 60 / total), 6) AS x1 FROM s""")
def q_partial_range(spark, sf_dir):
    each = views.documents(spark, sf_dir).select(F.explode(tx.words(F.col("text"))).alias("text")).where(F.length("text") >= 3).distinct()
    out = each.select("text", words.part_range(F.col("text"), F.lit(0.0), F.lit(60.0), F.lit(1), F.length("text") - 1).alias("r"))
    return out.select("text", F.round("r.x0", 6).alias("x0"), F.round("r.x1", 6).alias("x1"))


@query("""SELECT o_orderkey, round(least(a, b, c, d), 4) AS x0, round(greatest(a, b, c, d), 4) AS x1 FROM (SELECT o_orderkey,
    50 + cos(radians(-30)) * (x - 50) + sin(radians(-30)) * (0 - 40) AS a, 50 + cos(radians(-30)) * (x - 50) + sin(radians(-30)) * (20 - 40) AS b,
    50 + cos(radians(-30)) * (x + 10 - 50) + sin(radians(-30)) * (0 - 40) AS c, 50 + cos(radians(-30)) * (x + 10 - 50) + sin(radians(-30)) * (20 - 40) AS d FROM (SELECT o_orderkey, (o_orderkey % 90)::DOUBLE AS x FROM orders))""")
def q_rotated_box(spark, sf_dir):
    x = (F.col("o_orderkey") % 90).cast("double")
    box = recognition.rotated_box(x, F.lit(0.0), x + 10, F.lit(20.0), 30.0, F.lit(100.0), F.lit(80.0))
    return views.read(spark, sf_dir, "orders").select("o_orderkey", box.alias("b")).select("o_orderkey", F.round("b.x0", 4).alias("x0"), F.round("b.x1", 4).alias("x1"))


@query("""SELECT o_orderkey, NOT (bw < 36 OR bh < 18 OR n * 16 < pow(300 / 18.0, 2) OR (bh < 15 AND bw > 6 * bh) OR (bw < 15 AND bh > 6 * bw) OR d > 0.8 OR bw * bh / (2480 * 3508.0) > 0.2 OR (bw * bh / (2480 * 3508.0) > 0.04 AND d > 0.55) OR d < 0.03) AS unread
    FROM (SELECT *, n / greatest((bw / 4) * (bh / 4), 1) AS d FROM (SELECT o_orderkey, (o_orderkey % 900)::DOUBLE AS bw, (o_orderkey % 700)::DOUBLE AS bh, (o_orderkey % 5000)::DOUBLE AS n FROM orders))""")
def q_unread_filter(spark, sf_dir):
    k = F.col("o_orderkey")
    ok = recognition.unread_region(300, F.lit(2480), F.lit(3508), (k % 900).cast("double"), (k % 700).cast("double"), (k % 5000).cast("double"), F.lit(False))
    return views.read(spark, sf_dir, "orders").select("o_orderkey", ok.alias("unread"))


@query("SELECT DISTINCT o_custkey::VARCHAR || '.pdf' AS path FROM orders WHERE o_custkey % 3 <> 0")
def q_new_files(spark, sf_dir):
    from tintwerk.sources.files import new_files, supported

    orders = views.read(spark, sf_dir, "orders")
    rows = orders.select(F.concat(F.col("o_custkey").cast("string"), F.lit(".pdf")).alias("path")).unionByName(orders.limit(1).select(F.lit("x.exe").alias("path")))
    return new_files(supported(rows), orders.where("o_custkey % 3 = 0").select(F.concat(F.col("o_custkey").cast("string"), F.lit(".pdf")).alias("path")))


@query(f"""WITH {LETTERS} SELECT doc_id, 1::BIGINT AS pages, (2 + (doc_id % 4 = 0)::INT)::BIGINT AS redactions, 0::BIGINT AS warnings FROM letters""")
def q_export_summary(spark, sf_dir):
    marks = _letter_marks(spark, sf_dir)
    redacted = export.redact_pages(_letters(spark, sf_dir).select("doc_id", F.lit(0).alias("page_no"), "text"), marks)
    return export.export_summary(marks, redacted, export.leaks(marks, redacted))


@query("""SELECT DISTINCT 'all' AS case_id, (o_custkey % 50)::BIGINT AS doc_id, o_orderstatus AS text, min(o_orderkey) AS seq FROM orders GROUP BY ALL""")
def q_finding_dedupe(spark, sf_dir):
    rows = views.read(spark, sf_dir, "orders").select(F.lit("all").alias("case_id"), (F.col("o_custkey") % 50).alias("doc_id"), F.lit(0).alias("page_no"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("text"), F.lit("name").alias("kategorie"), F.lit("").alias("bezug"), F.lit(False).alias("unsicher"), F.lit("").alias("hinweis"))
    return findings.deduplicated(rows).select("case_id", "doc_id", "text", "seq")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'E.M./R.M.' ELSE 'E.M.' END AS label FROM orders""")
def q_mark_shared(spark, sf_dir):
    k = F.col("o_orderkey") % 3
    hits = views.read(spark, sf_dir, "orders").select("o_orderkey", F.lit("all").alias("case_id"), F.when(k == 0, "Frau Müllers").when(k == 1, "Frau Müller").otherwise("Erika").alias("text"), F.lit("E.M.").alias("label"), F.lit("name").alias("category"), F.when(k == 1, enums.INPUT).otherwise(enums.SALUTATION).alias("priority"))
    shared = spark.createDataFrame([("all", "müller", "E.M./R.M.")], "case_id string, token string, shared string")
    return analysis.mark_shared(hits, shared).select("o_orderkey", "label")


@query("""SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 4 = 3 OR (c_custkey % 4 = 1 AND c_custkey % 7 = 0) THEN -1 ELSE c_custkey % 7 END::INT AS found FROM customer""")
def q_parse_replies(spark, sf_dir):
    """None to six findings, whole behind thoughts or within a sentence, cut off in the next one, or no findings at all."""
    k, n = F.col("c_custkey") % 4, (F.col("c_custkey") % 7).cast("int")
    items = F.array_join(F.transform(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda i: F.concat(F.lit('{"text": "T'), i.cast("string"), F.lit('", "kategorie": "name"}'))), ", ")
    head, whole = F.concat(F.lit('{"funde": ['), items), F.concat(F.lit('{"funde": ['), items, F.lit("]}"))
    reply = F.when(k == 0, F.concat(F.lit("<think>x</think>"), whole)).when(k == 1, F.concat(head, F.lit(', {"text": "Mus'))).when(k == 2, F.concat(F.lit("Hier: "), whole, F.lit(" fertig"))).otherwise("nichts")
    return views.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.coalesce(F.size(findings.parse_reply(reply)), F.lit(-1)).alias("found"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and letters to redacted text: rules, redaction and leak check in one plan."""
    docs = views.documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).alias("page_no"), F.coalesce("text", F.lit("")).alias("text"))
    letters = _letters(spark, sf_dir).select((-1 - F.col("doc_id")).alias("doc_id"), F.lit(0).alias("page_no"), "text")
    pages = docs.unionByName(letters)
    rows = patterns.detect_patterns(pages)
    marks = F.array_sort(F.transform("found", lambda h: F.struct(h["s"].alias("s"), h["e"].alias("e"), h["label"].alias("label"))))
    return rows.withColumn("marks", marks).select("doc_id", F.size("marks").alias("redactions"), export.redacted_text(F.col("text"), F.col("marks")).alias("redacted"))


_register("q_flagship", flagship, None)
