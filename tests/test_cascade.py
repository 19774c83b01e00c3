"""The whole rule cascade and redaction against a plain version in Python, over the tables and over made-up lines that hold every rule's data."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tintwerk import enums
from tintwerk import queries as q
from tintwerk.operators import export, patterns


def compiled(pattern):
    flags = re.match(r"\(\?([a-zA-Z]+)\)", pattern)
    bare = pattern[flags.end() :] if flags else pattern
    return re.compile(bare, re.I if flags and "i" in flags[1] else 0)


def mod97(compact):
    turned = compact[4:] + compact[:4]
    return re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,}", compact) is not None and int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def iban_ends(text, m):
    compact = re.sub(r"\s", "", m[0])
    country, n = compact[:2], enums.IBAN_LENGTHS.get(compact[:2])
    if n:
        mended = country + compact[2:n].translate(str.maketrans("OIl", "011"))
        named = re.search(r"iban[^\n]{0,8}$", text[max(0, m.start() - 14) : m.start()], re.I)
        ok = len(compact) >= n and (mod97(mended) or (mended[2:].isdigit() if country == "DE" else named))
        size = n if ok else 0
    else:
        size = max((k for k in range(15, min(34, len(compact)) + 1) if mod97(compact[:k])), default=0)
    at = m.start()
    while size:
        size -= not text[at].isspace()
        at += 1
    return at if at > m.start() else None


def insurance(text, m):
    value, kept, at = m[1], [], 0
    words = list(re.finditer(r"[^ \t]+", value))
    for i, w in enumerate(words):
        digit = re.search(r"\d", w[0])
        lone = len(w[0]) == 1 and w[0].isalpha() and i + 1 < len(words) and re.search(r"\d", words[i + 1][0])
        if not (digit or lone):
            break
        kept.append(w)
    if not kept or kept[0].start():
        return None
    taken = value[: kept[-1].end()].rstrip(" ./-")
    if len(re.findall(r"\d", taken)) < 4:
        return None
    at = m.start(1)
    return at, at + len(taken), "SV-Nr." if re.search("renten|rv|sv|sozialvers", text[m.start() : at].lower()) else "Vers.-Nr."


def phone(text, m):
    line = text[max(0, m.start() - 40) : m.start()].split("\n")[-1]
    fax, mobile, landline = (compiled(p).search(line) for p in (patterns.FAX, patterns.MOBILE, patterns.LANDLINE))
    n = len(re.findall(r"\d", m[0]))
    if not 6 <= n <= 16 or not (fax or mobile or landline) and (compiled(patterns.NOT_PHONE).search(line) or n < 7):
        return None
    return "Fax" if fax else "Handy" if mobile or compiled(patterns.MOBILE_PREFIX).match(m[0]) else "Telefon"


def plain_hits(text):
    out = []

    def rule(pattern, take):
        nonlocal text
        before, found = text, []
        for m in compiled(pattern).finditer(before):
            found += [h for h in take(before, m) or [] if h]
        for s, e, _ in found:
            text = text[:s] + re.sub(r"[^\n]", "\0", text[s:e]) + text[e:]
        out.extend(found)

    rule(patterns.EMAIL, lambda t, m: [(*m.span(), "E-Mail")])
    rule(patterns.IBAN, lambda t, m: [(m.start(), e, "IBAN")] if (e := iban_ends(t, m)) else None)
    rule(patterns.ACCOUNT, lambda t, m: [(*m.span(1), "Konto-Nr.")])
    rule(patterns.INSURANCE, lambda t, m: [insurance(t, m)])
    rule(patterns.SOCIAL, lambda t, m: [(*m.span(), "SV-Nr.")])
    rule(patterns.HEALTH, lambda t, m: [(*m.span(), "Vers.-Nr.")])
    rule(patterns.BIRTH, lambda t, m: [(*m.span(3), "Geb.-Datum"), m[1] and (*m.span(1), "Geb.-Ort"), m[5] and (*m.span(5), "Geb.-Ort")])
    rule(patterns.BIRTH_NAME, lambda t, m: [(*m.span(1), "Geburtsname")])
    rule(patterns.PHONE, lambda t, m: [(*m.span(), label)] if (label := phone(t, m)) else None)
    return out


def plain_redacted(text):
    hits, out, at = sorted(plain_hits(text)), "", 0
    for s, e, label in hits:
        out, at = out + text[at:s] + f"[{label}]", e
    return len(hits), out + text[at:]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_flagship_equals_plain_cascade(spark, sf):
    where = f"/root/testdata/{sf}"
    texts = {r.doc_id: r.text or "" for r in q.views.documents(spark, where).collect()}
    texts |= {-1 - r.doc_id: r.text for r in q.views.letters(spark, where).collect()}
    got = {r.doc_id: (r.redactions, r.redacted) for r in q.flagship(spark, where).collect()}
    assert got.keys() == texts.keys()
    wrong = [(d, got[d], plain_redacted(t)) for d, t in texts.items() if got[d] != plain_redacted(t)]
    assert not wrong, wrong[:2]
    documents = [d for d in texts if d >= 0 and got[d][0]]
    assert sf == "sf0.001" or len(documents) > 5


PIECES = [
    "IBAN: DE89 3704 0044 0532 0130 00 COBADEFF", "DE12 3456 7890 1234 5678 90", "IBAN AT61 1904 3002 3457 3201", "FR14 2004 1010 0505 0001 3M02 606", "XX00 1234 5678 9012 345", "iban GB82WEST12345698765432",
    "Kto.-Nr. 123 456 78", "Kontonummer: 4711", "Konto 12345678", "Versicherten-Nr.: A 123456789 und mehr", "SV-Nr. 12 010180 M 015", "Rentenversicherungsnummer lautet 65 170839 J 003", "Police 12/34-56.", "12 010180 M 015", "A123456789",
    "geb. 01.02.1970 in Köln", "geboren am 1. Mai 1965", "* 3.4.66", "Geburtsdatum: 1970-01-02", "geboren in Bad Ems am 05.06.1980", "geb. Müller-Lüdenscheidt", "geborene Schmidt", "Tel. 06431/123456", "Fax: 0611 - 98 76 54", "Mobil 0171 1234567", "+49 (0) 6431 5555",
    "Az. 12345/2024", "Rechnung 0123456789", "0171/1234567", "mail(at)web.de", "a.b-c@x.y.de", "Seite 0123456", "030 1234", "Tel 030 1234", "\n", "😀", "é", "und", "12.03.2024", "Fon\n0301234567",
]


def test_lines_of_every_kind(spark):
    r = random.Random(5)
    texts = PIECES + [r.choice([" ", ", ", "\n", " "]).join(r.choice(PIECES) for _ in range(r.randrange(2, 9))) for _ in range(400)]
    rows = patterns.detect_patterns(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(4))
    marks = F.array_sort(F.transform("found", lambda h: F.struct(h["s"].alias("s"), h["e"].alias("e"), h["label"].alias("label"))))
    got = {x.doc_id: (x.n, x.out) for x in rows.withColumn("m", marks).select("doc_id", F.size("m").alias("n"), export.redacted_text(F.col("text"), F.col("m")).alias("out")).collect()}
    wrong = [(t, got[i], plain_redacted(t)) for i, t in enumerate(texts) if got[i] != plain_redacted(t)]
    assert not wrong, wrong[:3]
    assert {label for t in texts for _, _, label in plain_hits(t)} == {"E-Mail", "IBAN", "Konto-Nr.", "SV-Nr.", "Vers.-Nr.", "Geb.-Datum", "Geb.-Ort", "Geburtsname", "Telefon", "Handy", "Fax"}
