"""Text and token functions as column expressions: tokens, names, labels, chunks.

Java's ``(?U)`` gives Unicode meaning to word characters; offsets are code points. The only difference to
``tintwerk.functions.tokens`` is compatibility normalisation: Spark has no function for it, so ``norm`` expects NFKC text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tintwerk import enums

_SPACES = " \t\n\r\x0b\x0c "


def _set(chars: str) -> str:
    return "[" + "".join("\\" + c if c in r"\[]^-&|" else c for c in chars) + "]"


def strip(c: Column, chars: str) -> Column:
    return F.btrim(c, F.lit(chars))


def folded(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def norm(c: Column) -> Column:
    """Normal form of a token: one kind of dash, no punctuation at the edges, no trailing hyphen, folded case, ``str`` for street endings."""
    bare = strip(strip(F.translate(c, enums.DASHES, "-" * len(enums.DASHES)), _SPACES), enums.TOKEN_EDGE)
    bare = F.when(F.length(bare) > 1, F.rtrim(bare, F.lit("-"))).otherwise(bare)
    return F.regexp_replace(folded(bare), "(strasse|str)$", "str")


def tokenize(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"[\s,;]+"), norm), lambda t: t != "")


def words(c: Column) -> Column:
    """Pieces between white space."""
    return F.filter(F.split(c, r"\s+"), lambda t: t != "")


def collapsed(c: Column) -> Column:
    return F.array_join(words(c), " ")


def split_values(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"[;\n]+"), lambda v: strip(v, _SPACES)), lambda v: v != "")


def address_parts(c: Column) -> Column:
    parts = F.flatten(F.transform(split_values(c), lambda v: F.split(v, ",")))
    return F.filter(F.transform(parts, lambda p: strip(p, _SPACES)), lambda p: F.length(p) >= 3)


def has_digit(c: Column) -> Column:
    return F.rlike(c, F.lit(r"\d"))


def digit_count(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"\D", ""))


def alike(query: Column, word: Column, fuzzy: bool = True, possessive: bool = False) -> Column:
    """Tolerant equality of two normalised tokens: equal; with a genitive s; with digits, equal but for confused characters; else
    within one edit from 5 characters, two from 9. Cheap tests come first; the distance stops at its bound."""
    equal = query == word
    genitive = (word == F.concat(query, F.lit("s"))) | (word == F.concat(query, F.lit("'s"))) | (word == F.concat(query, F.lit("’s")))
    some = (query != "") & (word != "")
    if possessive:
        equal = equal | genitive
    if not fuzzy:
        return some & equal
    size = F.greatest(F.length(query), F.length(word))
    most = F.when(size < 9, 1).otherwise(2)
    bare = F.when((F.length(word) == F.length(query) + 1) & F.endswith(word, F.lit("s")), F.substring(word, F.lit(1), F.length(word) - 1)).otherwise(word) if possessive else word
    plain = lambda c: F.translate(c, enums.CONFUSED, enums.DIGITS)
    near = F.when(F.abs(F.length(query) - F.length(bare)) > 2, F.lit(False)).otherwise(F.levenshtein(query, bare, 2).between(0, most))
    return some & (equal | F.when(has_digit(query) | has_digit(word), plain(query) == plain(word)).when(size < 5, F.lit(False)).otherwise(near))


def _in(c: Column, values: list[str]) -> Column:
    return F.array_contains(F.array(*[F.lit(v) for v in values]), c)


def name_tokens(c: Column) -> Column:
    found = F.transform(words(F.replace(c, F.lit(","), F.lit(" "))), norm)
    return F.filter(found, lambda t: (F.length(t) > 1) & ~_in(t, enums.NAME_STOP))


def is_organisation(c: Column) -> Column:
    return F.rlike(c, F.lit("(?iU)" + enums.ORGANISATION))


def name_words(c: Column) -> Column:
    """``array<struct<w, particle>>`` of a name without titles and roles; one comma means "last, first"."""
    one = collapsed(F.coalesce(c, F.lit("")))
    last, first = (strip(F.split(one, ",")[i], _SPACES) for i in (0, 1))
    turned = F.when((F.length(one) - F.length(F.replace(one, F.lit(","))) == 1) & (last != "") & (first != ""), F.concat(first, F.lit(" "), last)).otherwise(one)
    bare = F.transform(words(F.replace(turned, F.lit(","), F.lit(" "))), lambda w: strip(w, ".,;:()[]\"'„“”‚‘’"))
    kept = F.filter(bare, lambda w: F.rlike(w, F.lit(r"^\p{L}")) & (_in(norm(w), enums.PARTICLES) | ~_in(norm(w), enums.NAME_STOP)))
    marked = F.transform(kept, lambda w: F.struct(w.alias("w"), _in(norm(w), enums.PARTICLES).alias("particle")))
    # A particle at the end belongs to no name.
    ends = F.array_max(F.transform(marked, lambda x, i: F.when(~x["particle"], i + 1).otherwise(0)))
    return F.when(F.coalesce(ends, F.lit(0)) > 0, F.slice(marked, F.lit(1), F.coalesce(ends, F.lit(0)))).otherwise(F.array().cast("array<struct<w:string,particle:boolean>>"))


def initials(c: Column, first_n: int = 1, last_n: int = 1) -> Column:
    """``R.K.`` of ``Robin Kinzel``: particles in lower case, parts of double names with a hyphen."""
    marked = name_words(c)
    main = lambda ws: F.filter(F.transform(ws, lambda x, i: F.when(~x["particle"], i)), lambda i: i.isNotNull())

    def part(word: Column, n: Column) -> Column:
        pieces = F.filter(F.split(word, "-"), lambda p: F.rlike(p, F.lit(r"^\p{L}")))
        letters = F.transform(pieces, lambda p: F.regexp_replace(p, r"[^\p{L}]", ""))
        return F.array_join(F.transform(letters, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, F.lit(2), n - 1)), F.lit("."))), "-")

    size = lambda i: F.greatest(F.when(i == F.array_min(main(marked)), first_n).otherwise(1), F.when(i == F.array_max(main(marked)), last_n).otherwise(1))
    shown = F.transform(marked, lambda x, i: F.when(x["particle"], F.concat(F.lower(F.substring(x["w"], 1, 1)), F.lit("."))).otherwise(part(x["w"], size(i))))
    return F.when(F.size(main(marked)) == 0, "").otherwise(F.array_join(shown, ""))


def letter(nth: Column) -> Column:
    """Provisional label of the nth person: A to Z, then 27, 28 and so on."""
    return F.when(nth <= 26, F.chr(64 + nth)).otherwise(nth.cast("string"))


def _short(label: Column) -> Column:
    known = F.create_map(*[F.lit(x) for p in enums.SHORT_LABELS.items() for x in p])
    pattern = F.lit("(?U)" + enums.INITIALS_LABEL)
    rest = F.substring(label, 9, 1 << 20)
    acronym = F.array_join(F.transform(words(label), lambda w: F.upper(F.substring(w, 1, 1))), "")
    return (
        F.when(F.try_element_at(known, label).isNotNull(), F.try_element_at(known, label))
        .when(F.rlike(label, pattern), label)
        .when(F.startswith(label, F.lit("Adresse Person ")), F.concat(F.lit("Adr. "), F.substring_index(label, " ", -1)))
        .when(F.startswith(label, F.lit("Person ")), F.concat(F.lit("P. "), F.substring_index(label, " ", -1)))
        .when(F.startswith(label, F.lit("Adresse ")) & F.rlike(rest, pattern), F.concat(F.lit("Adr. "), rest))
        .when(F.size(words(label)) > 1, acronym)
        .when(F.length(label) > 5, F.concat(F.substring(label, 1, 4), F.lit(".")))
        .otherwise(label)
    )


def short_label(label: Column) -> Column:
    """Label for narrow places; a composite ``A/B`` part by part, unless its whole has a form of its own."""
    composite = F.contains(label, F.lit("/")) & ~F.rlike(label, F.lit("(?U)" + enums.INITIALS_LABEL)) & ~F.startswith(label, F.lit("Person ")) & ~F.startswith(label, F.lit("Adresse Person "))
    return F.when(composite, F.array_join(F.transform(F.split(label, "/"), _short), "/")).otherwise(_short(label))


def relabel(label: Column, mapping: Column) -> Column:
    """``label`` by a map of old to new labels; parts of a composite one by one."""
    parts = F.transform(F.split(label, "/"), lambda p: F.coalesce(F.try_element_at(mapping, p), p))
    return F.coalesce(F.try_element_at(mapping, label), F.array_join(parts, "/"))


def chunks(text: Column, limit: int = 6000) -> Column:
    """Pieces of whole lines of at most ``limit`` characters (a longer line has a piece of its own)."""
    none = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"))

    def step(a: Column, line: Column) -> Column:
        full = (F.length(a["cur"]) + F.length(line) + 1 > limit) & (a["cur"] != "")
        return F.struct(F.when(full, F.array_append(a["out"], a["cur"])).otherwise(a["out"]).alias("out"), F.concat(F.when(full, "").otherwise(a["cur"]), line, F.lit("\n")).alias("cur"))

    last = lambda a: F.when(F.rlike(a["cur"], F.lit(r"\S")), F.array_append(a["out"], a["cur"])).otherwise(a["out"])
    return F.when(F.length(text) <= limit, F.array(text)).otherwise(F.aggregate(F.split(text, "\n", -1), none, step, last))
