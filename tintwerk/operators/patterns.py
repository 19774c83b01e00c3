"""Rules for data of fixed form: e-mail, IBAN and account, insurance numbers, birth date, place and name, phone numbers.

The rules run in a fixed order over one text; what a rule has taken is masked for the next ones, so the digits of an IBAN are
never a phone number. Everything is column expressions over the page's text: no shuffle, no Python.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tintwerk import enums
from tintwerk.functions.spans import hit, located, masked
from tintwerk.functions.text import digit_count

# Fixed patterns of the rules: results depend on them, so each must match as it stands; only flags are Java's.
EMAIL = r"[A-Za-z0-9._%+\-ÄÖÜäöü]+[ \t]?(?:@|\(at\)|\[at\]|©|®)[ \t]?[A-Za-z0-9\-ÄÖÜäöü]+(?:\.[A-Za-z0-9\-ÄÖÜäöü]+)*\.[A-Za-z]{2,}"
IBAN = r"(?U)\b[A-Z]{2}[ \t]?\d{2}(?:[ \t]?[A-Z0-9]){10,30}"
ACCOUNT = r"(?U)(?i:Konto(?:nummer|[ \t]?-?[ \t]?Nr\.?)|Kto\.?(?:[ \t]?-?[ \t]?Nr\.?)?)[ \t]*[:.]?[ \t]*(\d(?:[ \t]?\d){4,14})\b"
SOCIAL = r"(?U)\b\d{2}[ \t]?\d{2}[ \t]?\d{2}[ \t]?\d{2}[ \t]?[A-Z][ \t]?\d{2}[ \t]?\d\b"
HEALTH = r"(?U)\b[A-Z][ \t]?\d{9}\b"
INSURANCE = (
    r"(?U)(?i:Versicherten[ \t]?-?[ \t]?(?:nummer|nr\.?)|Krankenversicherten[ \t]?-?[ \t]?(?:nummer|nr\.?)"
    r"|Versicherungs(?:schein)?[ \t]?-?[ \t]?(?:nummer|nr\.?)|Vers\.?[ \t]?-?[ \t]?Nr\.?"
    r"|Renten(?:versicherungs)?[ \t]?-?[ \t]?(?:nummer|nr\.?|zeichen)|RV[ \t]?-?[ \t]?Nr\.?"
    r"|SV[ \t]?-?[ \t]?Nr\.?|Sozialversicherungs[ \t]?-?[ \t]?(?:nummer|nr\.?)"
    r"|Mitglieds[ \t]?-?[ \t]?(?:nummer|nr\.?)|Police(?:n)?[ \t]?-?[ \t]?(?:nummer|nr\.?))"
    r"[ \t]*(?::|\.|lautet)?[ \t]*([A-Z0-9][A-Z0-9 \t./\-]{3,30})"
)
MONTH = (
    r"(?:Januar|Jänner|Februar|März|Maerz|April|Mai|Juni|Juli|August|September|Oktober"
    r"|November|Dezember|Jan|Feb|Mär|Mrz|Apr|Jun|Jul|Aug|Sept?|Okt|Nov|Dez)"
)
DATE = (
    r"(?:\d{1,2}[ \t]?\.[ \t]?\d{1,2}[ \t]?\.[ \t]?(?:\d{4}|\d{2})(?!\d)"
    r"|\d{1,2}\.?[ \t]+" + MONTH + r"\.?[ \t]+\d{4}"
    r"|\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4})"
)
PLACE = r"[A-ZÄÖÜ][\w\-]+(?:[ \t]+(?:am|an[ \t]der|bei|im|in[ \t]der)[ \t]+[A-ZÄÖÜ][\w\-]+)?"
BIRTH = (
    r"(?U)(?:(?i:\bgeb(?:oren)?\b\.?|\bGeburtsdatum\b|\bGeb\.?[ \t]?-?[ \t]?Datum\b|\bGeb\.?[ \t]?dat\.?)|(?<![\w*])\*)"
    r"[ \t]*:?[ \t\n]*(?:(?:am|den)[ \t]+)?"
    r"(?:in[ \t]+(" + PLACE + r")([ \t]+(?:am[ \t]+)?))?"
    r"(" + DATE + r")"
    r"(?:([ \t]+in[ \t]+)(" + PLACE + r"))?"
)
BIRTH_NAME = r"(?U)(?i:\bgeb\.|\bgeborene[r]?\b)[ \t]+([A-ZÄÖÜ][a-zäöüß]+(?:-[A-ZÄÖÜ][a-zäöüß]+)?)\b"
PHONE = (
    r"(?U)(?<![\w/.,\-+])"
    r"(?:(?:\+|00)[ \t]?\d{2,3}(?:[ \t]?\(0\))?[ \t\-/]*\(?\d{2,5}\)?|\(?0\d{2,5}\)?)"
    r"(?:[ \t]*[/\-–][ \t]*|[ \t]+)?"
    r"\d{2,}(?:[ \t\-–]?\d+){0,5}"
    r"(?![\w])"
)
NOT_PHONE = (
    r"(?iUd)(az\.?|aktenzeichen|geschäftszeichen|gz\.?|zeichen|rechnung|kunden|vertrag|steuer|ust|"
    r"konto|kto|blz|iban|bic|vers|police|mitglied|schaden|bestell|auftrag|art\.?-?nr|"
    r"artikel|seite|blatt|bl\.|anlage|urteil|beschluss|ag\b|lg\b|olg\b)[^\n]{0,12}$"
)
FAX = r"(?iUd)fax[^\n]{0,15}$"
MOBILE = r"(?iUd)(mobil|handy|cell|funk)[^\n]{0,15}$"
LANDLINE = r"(?iUd)(tel|fon|ruf|☎|phone|erreichbar|durchwahl)[^\n]{0,15}$"
MOBILE_PREFIX = r"(?U)^(?:\+|00)?[ \t]?(?:49)?[ \t]?(?:\(0\))?[ \t]?0?1[567]\d"


def iban_valid(compact: Column) -> Column:
    """Check digits of an IBAN in capitals without blanks, as a fold modulo 97 (the number itself exceeds any decimal)."""

    def step(a: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (a * 100 + code - 55) % 97).otherwise((a * 10 + code - 48) % 97)

    turned = F.concat(F.substring(compact, 5, 100), F.substring(compact, 1, 4))
    rest = F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step)
    return F.rlike(compact, F.lit(r"^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,}$")) & (rest == 1)


def _before(text: Column, s: Column, n: int) -> Column:
    """Up to ``n`` characters before ``s``."""
    return F.substring(text, F.greatest(s - n, F.lit(0)) + 1, F.least(s, F.lit(n)))


def emails(text: Column) -> Column:
    return F.transform(located(text, EMAIL), lambda x: hit(x["s"], x["e"], enums.CATEGORY_LABELS["email"], "email"))


def ibans(text: Column) -> Column:
    lengths = F.create_map(*[F.lit(x) for p in enums.IBAN_LENGTHS.items() for x in p])

    def accepted(x: Column) -> Column:
        compact = F.regexp_replace(x["m"], r"\s", "")
        country = F.substring(compact, 1, 2)
        n = F.try_element_at(lengths, country)
        mended = F.concat(country, F.translate(F.substring(compact, F.lit(3), n - 2), "OIl", "011"))
        digits = F.rlike(F.substring(mended, 3, 100), F.lit(r"^\d+$"))
        named = F.rlike(_before(text, x["s"], 14), F.lit(r"(?iUd)iban[^\n]{0,8}$"))
        known = F.when((F.length(compact) >= n) & (iban_valid(mended) | F.when(country == "DE", digits).otherwise(named)), n)
        unknown = F.array_max(F.filter(F.sequence(F.lit(15), F.least(F.lit(34), F.length(compact))), lambda k: iban_valid(F.substring(compact, F.lit(1), k))))
        return F.when(n.isNotNull(), known).when(F.length(compact) >= 15, unknown)

    # The hit ends with the last accepted character; what the match holds behind it (a BIC, say) stays free.
    taken = lambda x: F.length(F.call_function("regexp_extract", x["m"], F.concat(F.lit(r"^(?:\s*\S){"), accepted(x).cast("string"), F.lit("}")), F.lit(0)))
    found = F.filter(located(text, IBAN), lambda x: accepted(x).isNotNull())
    return F.transform(found, lambda x: hit(x["s"], x["s"] + taken(x), enums.CATEGORY_LABELS["iban"], "iban"))


def _tail(text: Column, pattern: str, label: str, category: str) -> Column:
    """Hits on a pattern's group 1, which ends with the match; or on the whole match if it has no group."""
    groups = int("(" in pattern.replace("(?", "").replace(r"\(", ""))
    return F.transform(located(text, pattern, groups), lambda x: hit(x["e"] - F.length(x["g1"]) if groups else x["s"], x["e"], label, category))


def accounts(text: Column) -> Column:
    return _tail(text, ACCOUNT, enums.CATEGORY_LABELS["konto"], "iban")


def insurance_numbers(text: Column) -> Column:
    """The value behind a keyword: its leading tokens that hold digits, or are one letter before such a token."""

    def kept(x: Column) -> Column:
        digit = r"[^ \t]*\d[^ \t]*"
        token = rf"(?:{digit}|\p{{L}}(?=[ \t]+{digit}))(?=[ \t]|$)"
        return F.rtrim(F.regexp_extract(x["g1"], rf"^({token}(?:[ \t]+{token})*)", 1), F.lit(" ./-"))

    found = F.filter(located(text, INSURANCE, 1), lambda x: digit_count(kept(x)) >= 4)

    def made(x: Column) -> Column:
        s = x["e"] - F.length(x["g1"])
        keyword = F.lower(F.substring(x["m"], F.lit(1), F.length(x["m"]) - F.length(x["g1"])))
        label = F.when(F.rlike(keyword, F.lit("renten|rv|sv|sozialvers")), enums.CATEGORY_LABELS["sv"]).otherwise(enums.CATEGORY_LABELS["versicherung"])
        return hit(s, s + F.length(kept(x)), label, "versicherung")

    return F.transform(found, made)


def social_numbers(text: Column) -> Column:
    return _tail(text, SOCIAL, enums.CATEGORY_LABELS["sv"], "versicherung")


def health_numbers(text: Column) -> Column:
    return _tail(text, HEALTH, enums.CATEGORY_LABELS["versicherung"], "versicherung")


def births(text: Column) -> Column:
    date, place = enums.CATEGORY_LABELS["geburtsdatum"], enums.CATEGORY_LABELS["geburtsort"]

    def made(x: Column) -> Column:
        end = x["e"] - F.length(x["g4"]) - F.length(x["g5"])
        start = end - F.length(x["g3"])
        first_end = start - F.length(x["g2"])
        parts = F.array(
            hit(start, end, date, "geburtsdatum"),
            F.when(x["g1"] != "", hit(first_end - F.length(x["g1"]), first_end, place, "geburtsdatum")),
            F.when(x["g5"] != "", hit(x["e"] - F.length(x["g5"]), x["e"], place, "geburtsdatum")),
        )
        return F.filter(parts, lambda p: p.isNotNull())

    return F.flatten(F.transform(located(text, BIRTH, 5), made))


def birth_names(text: Column) -> Column:
    return F.transform(located(text, BIRTH_NAME, 1), lambda x: hit(x["e"] - F.length(x["g1"]), x["e"], enums.CATEGORY_LABELS["geburtsname"], "name"))


def phones(text: Column) -> Column:
    def line(x: Column) -> Column:
        return F.substring_index(_before(text, x["s"], 40), "\n", -1)

    def called(x: Column) -> Column:
        return F.rlike(line(x), F.lit(LANDLINE)) | F.rlike(line(x), F.lit(FAX)) | F.rlike(line(x), F.lit(MOBILE))

    def plausible(x: Column) -> Column:
        n = digit_count(x["m"])
        return n.between(6, 16) & (called(x) | (~F.rlike(line(x), F.lit(NOT_PHONE)) & (n >= 7)))

    def label(x: Column) -> Column:
        names = enums.CATEGORY_LABELS
        return F.when(F.rlike(line(x), F.lit(FAX)), names["fax"]).when(F.rlike(line(x), F.lit(MOBILE)) | F.rlike(x["m"], F.lit(MOBILE_PREFIX)), names["handy"]).otherwise(names["telefon"])

    return F.transform(F.filter(located(text, PHONE), plausible), lambda x: hit(x["s"], x["e"], label(x), "telefon"))


# The order is part of the result: each rule sees the text without what the rules before it took.
RULES: list[tuple[str, Callable[[Column], Column]]] = [
    ("email", emails),
    ("iban", ibans),
    ("iban", accounts),
    ("versicherung", insurance_numbers),
    ("versicherung", social_numbers),
    ("versicherung", health_numbers),
    ("geburtsdatum", births),
    ("name", birth_names),
    ("telefon", phones),
]

# No match without one of these: such pages skip the whole cascade.
_ANY = r"\d|@|\(at\)|\[at\]|©|®|(?i:geb)"


def detect_patterns(pages: DataFrame, enabled: Iterable[str] = enums.CATEGORIES) -> DataFrame:
    """``pages`` with ``found``, an ``array<struct<s, e, label, category>>`` over its column ``text``, in rule order.

    Rules of categories that are switched off aren't part of the plan.
    """
    enabled = set(enabled)
    out, found, current = pages, [], F.when(F.rlike("text", F.lit(_ANY)), F.col("text")).otherwise("")
    out = out.withColumn("_t0", current)
    rules = [rule for category, rule in RULES if category in enabled]
    for i, rule in enumerate(rules):
        out = out.withColumn(f"_h{i}", rule(F.col(f"_t{i}")))
        found.append(F.col(f"_h{i}"))
        out = out.withColumn(f"_t{i + 1}", masked(F.col(f"_t{i}"), F.col(f"_h{i}")))
    none = F.array().cast("array<struct<s:int,e:int,label:string,category:string>>")
    return out.select(*pages.columns, (F.concat(*found) if found else none).alias("found"))
