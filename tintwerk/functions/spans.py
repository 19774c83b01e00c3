"""Where a pattern matches, as code point offsets, in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BIG = 1 << 30


# Two noncharacters, which stand in no text (and are replaced if they do): around a match, and before each of its groups.
_AROUND, _GROUP = "\uFDD0", "\uFDD1"


def located(text: Column, pattern: str, groups: int = 0) -> Column:
    """``array<struct<s, e, m, g1, ...>>`` of the matches of ``pattern``: code point offsets, text and groups ("" if not part).

    The pattern must not match the empty string. It runs once over the text: each match is put between marks, together with its groups,
    so that a split gives gaps and matches in turn, and the offsets are running sums over both.
    """
    marks = _AROUND + _GROUP
    clean = F.when(F.contains(text, F.lit(_AROUND)) | F.contains(text, F.lit(_GROUP)), F.translate(text, marks, "\uFFFD" * 2)).otherwise(text)
    shown = _AROUND + "$0" + "".join(f"{_GROUP}${i}" for i in range(1, groups + 1)) + _AROUND
    pieces = F.transform(F.split(F.regexp_replace(clean, pattern, shown), _AROUND, -1), lambda p: F.split(p, _GROUP, -1))
    names = ["m", *(f"g{i}" for i in range(1, groups + 1))]
    fields = ", ".join(f"{n}: string" for n in names)
    empty = F.struct(F.lit(0).alias("at"), F.lit(False).alias("match"), F.array().cast(f"array<struct<s: int, e: int, {fields}>>").alias("out"))

    def step(a: Column, p: Column) -> Column:
        end = a["at"] + F.length(p[0])
        found = F.struct(a["at"].alias("s"), end.alias("e"), *[p[i].alias(n) for i, n in enumerate(names)])
        return F.struct(end.alias("at"), (~a["match"]).alias("match"), F.when(a["match"], F.array_append(a["out"], found)).otherwise(a["out"]).alias("out"))

    return F.aggregate(pieces, empty, step, lambda a: a["out"])


def hit(s: Column, e: Column, label: Column | str, category: str) -> Column:
    return F.struct(s.cast("int").alias("s"), e.cast("int").alias("e"), (F.lit(label) if isinstance(label, str) else label).alias("label"), F.lit(category).alias("category"))


def masked(text: Column, hits: Column) -> Column:
    """``text`` with NUL for every character of the hits but line breaks: later rules can't match there."""

    def cover(t: Column, h: Column) -> Column:
        inner = F.regexp_replace(F.substring(t, h["s"] + 1, h["e"] - h["s"]), r"[^\n]", "\x00")
        return F.concat(F.substring(t, F.lit(1), h["s"]), inner, F.substring(t, h["e"] + 1, F.lit(BIG)))

    return F.aggregate(hits, text, cover)
