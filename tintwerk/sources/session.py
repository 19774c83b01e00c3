"""Sessions: a case's inputs, persons and hits as one JSON text, and back on pages that may have changed since."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tintwerk import enums, schemas
from tintwerk.functions import tokens as tk
from tintwerk.functions.tables import kept, met
from tintwerk.functions.page import Page, as_rows, as_segments

FORMAT = 1
_HIT = "page:int,segments:array<array<int>>,text:string,label:string,category:string,priority:int,rects:array<array<double>>,enabled:boolean,question:string"
_DOC = f"path:string,analyzed:boolean,pages:int,hits:array<struct<{_HIT}>>,unread:map<string,array<array<double>>>"
_PERSON = "label:string,kind:string,names:array<string>,fixed:boolean"
_INPUTS = "mandant_name:string,mandant_adresse:string,gegner_name:string,gegner_adresse:string,custom:array<array<string>>,gegner_organisation:boolean"
SESSION = f"format int, programm string, hinweis string, inputs struct<{_INPUTS}>, persons array<struct<{_PERSON}>>, docs array<struct<{_DOC}>>"


def to_session(documents: DataFrame, hits: DataFrame, inputs: DataFrame, persons: DataFrame) -> DataFrame:
    """``case_id, value``: the session text of each case. ``documents``: case_id, doc_id, path, analyzed, pages, unread (a map)."""
    segments = F.transform("segments", lambda s: F.array(s["word"], s["c0"], s["c1"]))
    rects = F.transform("rects", lambda r: F.array(r["x0"], r["y0"], r["x1"], r["y1"]))
    hit = F.struct(F.col("page_no").alias("page"), segments.alias("segments"), "text", "label", "category", "priority", rects.alias("rects"), "enabled", "question")
    by_doc = hits.groupBy("case_id", "doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "seq", hit.alias("hit")))), lambda x: x["hit"]).alias("hits"))
    none = F.array().cast(f"array<struct<{_HIT}>>")
    docs = documents.join(by_doc, ["case_id", "doc_id"], "left").groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", F.struct("path", "analyzed", "pages", F.coalesce("hits", none).alias("hits")).alias("d"), F.to_json("unread").alias("u")))), lambda x: F.struct(x["d"], F.from_json(x["u"], "map<string,array<array<double>>>").alias("unread"))).alias("docs"))
    docs = docs.withColumn("docs", F.transform("docs", lambda x: F.struct(x["d"]["path"].alias("path"), x["d"]["analyzed"].alias("analyzed"), x["d"]["pages"].alias("pages"), x["d"]["hits"].alias("hits"), x["unread"].alias("unread"))))
    people = persons.where("size(names) > 0").groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("person_seq", F.struct("label", "kind", "names", "fixed").alias("p")))), lambda x: x["p"]).alias("persons"))
    own = inputs.select("case_id", F.struct("mandant_name", "mandant_adresse", "gegner_name", "gegner_adresse", F.transform("custom", lambda c: F.array(c["term"], c["label"])).alias("custom"), "gegner_organisation").alias("inputs"))
    rows = docs.join(people, "case_id", "left").join(own, "case_id", "left")
    value = F.to_json(F.struct(F.lit(FORMAT).alias("format"), F.lit("tintwerk").alias("programm"), F.lit("Enthält Mandantendaten – vertraulich behandeln.").alias("hinweis"), "inputs", F.coalesce("persons", F.array().cast(f"array<struct<{_PERSON}>>")).alias("persons"), "docs"), {"ignoreNullFields": "false"})
    return rows.select("case_id", value.alias("value"))


def read_sessions(texts: DataFrame) -> DataFrame:
    """``case_id`` and the parts of each session text (case_id, value); a text of another format is an error."""
    parsed = texts.select("case_id", F.from_json("value", SESSION).alias("s")).select("case_id", "s.*")
    ok = F.when(F.coalesce(F.col("format"), F.lit(0)) == FORMAT, F.col("format")).otherwise(F.raise_error(F.lit("not a session of a known format")).cast("int"))
    return parsed.withColumn("format", ok)


def session_inputs(sessions: DataFrame) -> DataFrame:
    pairs = F.transform(F.filter(F.coalesce("inputs.custom", F.array().cast("array<array<string>>")), lambda c: F.size(c) == 2), lambda c: F.struct(c[0].alias("term"), c[1].alias("label")))
    text = [F.coalesce(f"inputs.{c}", F.lit("")).alias(c) for c in ("mandant_name", "mandant_adresse", "gegner_name", "gegner_adresse")]
    return sessions.select("case_id", *text, pairs.alias("custom"), F.coalesce("inputs.gegner_organisation", F.lit(False)).alias("gegner_organisation"))


def session_paths(sessions: DataFrame) -> DataFrame:
    return sessions.select("case_id", F.posexplode("docs").alias("doc_seq", "d")).select("case_id", "doc_seq", "d.path")


def session_persons(sessions: DataFrame) -> DataFrame:
    """Known persons, as ``analyze`` takes them."""
    return sessions.select("case_id", F.posexplode("persons").alias("person_seq", "p")).select("case_id", "person_seq", "p.label", F.coalesce("p.kind", F.lit("person")).alias("kind"), "p.names", F.coalesce("p.fixed", F.lit(False)).alias("fixed"))


def reanchor(sessions: DataFrame, pages: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits on the pages as they are now, ``case_id, path, ok, dropped``). A hit whose words have moved is looked for by its text; one that isn't found is dropped."""
    entries = sessions.select("case_id", F.explode("docs").alias("d")).select("case_id", "d.path", F.posexplode("d.hits").alias("nth", "h"))
    entries = entries.join(documents.select("case_id", "path", "doc_id"), ["case_id", "path"])
    asked = entries.groupBy("case_id", "path", "doc_id", F.col("h.page").alias("page_no")).agg(F.array_sort(F.collect_list(F.struct("nth", F.to_json("h").alias("h")))).alias("asked"))
    rows = met(asked, pages.select("case_id", "doc_id", "doc_seq", "page_no", "words"), ["case_id", "doc_id", "page_no"], "left")
    ddl = f"case_id string, path string, doc_id long, doc_seq int, page_no int, seq int, {schemas.HIT}, ok boolean"
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                page = None if r["words"] is None else Page(r["words"])
                scan = None
                for x in r["asked"]:
                    h = json.loads(x["h"])
                    text, ok = h.get("text") or "", page is not None
                    segments = [tuple(s + [None] * (3 - len(s))) for s in h.get("segments") or []]
                    if ok and segments:
                        valid = all(0 <= s[0] < len(page.texts) for s in segments)
                        if not valid or page.segment_text(segments).split() != text.split():
                            scan = scan or tk.PageScanner(page.texts, page.lines)
                            places = scan.find(tk.tokenize(text), False)
                            ok = bool(places)
                            segments = page.trimmed([(i, None, None) for i in range(*places[0])]) if ok else []
                    rects = [] if segments else [dict(zip(("x0", "y0", "x1", "y1"), q, strict=True)) for q in h.get("rects") or []]
                    ok = ok and bool(segments or rects)
                    out.append({k: r[k] for k in ("case_id", "path", "doc_id", "doc_seq", "page_no")} | {"seq": x["nth"], "segments": as_rows(segments), "text": text, "label": h.get("label") or enums.CATEGORY_LABELS["sonstiges"], "category": h.get("category") or "benutzer", "priority": h.get("priority") or 0, "rects": rects, "enabled": h.get("enabled") is not False, "question": h.get("question") or "", "ok": ok})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)

    done = kept(rows.mapInArrow(run, ddl))
    counts = done.groupBy("case_id", "path").agg(F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("dropped"))
    return done.where("ok").drop("ok", "path"), counts


@dataclass
class StoredSettings:
    """Settings as they are stored: unknown keys are ignored, new categories are on."""

    fuzzy_matching: bool = True
    ki_exclude_professionals: bool = False
    export_suffix: str = "_geschwärzt"
    export_neutral_filename: bool = True
    export_dpi: int = 300
    export_mode: str = "bild"
    ocr_mode: str = "auto"
    categories: dict[str, bool] = field(default_factory=lambda: dict.fromkeys(enums.CATEGORIES, True))

    @classmethod
    def loads(cls, text: str) -> StoredSettings:
        try:
            data = json.loads(text)
        except ValueError:
            return cls()
        out = cls(**{k: v for k, v in data.items() if k in cls.__dataclass_fields__})
        out.categories = dict.fromkeys(enums.CATEGORIES, True) | out.categories
        return out

    def dumps(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False, indent=2)

    def category_on(self, key: str) -> bool:
        return bool(self.categories.get(key, True))


def write_sessions(sessions: DataFrame, path: str) -> None:
    """One text file's lines: a session each."""
    sessions.select("value").write.mode("errorifexists").text(path)


def load_sessions(spark: SparkSession, path: str) -> DataFrame:
    return read_sessions(spark.read.text(path).select(F.xxhash64("value").cast("string").alias("case_id"), "value"))
