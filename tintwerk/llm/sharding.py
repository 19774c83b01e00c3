"""Sharding by sampled splitters, with DataFrame functions only.

Records are ordered by (hash of text, doc_id), so equal texts lie side by side and any group of copies can be cut.
A sample of keys, drawn with a chance in proportion to size, gives quantile splitters; the splitters cut the
order into many fine ranges, and a range that holds more than twice its share is cut again by splitters drawn
from it alone. Each range is one window; exact prefix sums over the ranges (a bounded table) turn positions within a
range into positions within the whole order, and the shard follows from the position: every shard gets the same
number of bytes, up to one record.

Bounded on the driver: ``MOST_RANGES`` splitters and range totals, whatever the input's size.

Defined cases: a null text has size 8 and sorts first; a null doc_id sorts first among equal texts; repeated rows
are separate records; an empty table gives no row; columns named in ``carry`` travel with their record, under another name
where the result has one of that name (``carried_names``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tintwerk.llm._work import constant, searched, written

SAMPLES_PER_RANGE = 24
MOST_RANGES = 4096
RANGE_BYTES = 256 << 20


def sized(docs: DataFrame, carry: list[str] = ()) -> DataFrame:
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    key = F.struct(F.coalesce(F.xxhash64("text"), F.lit(0)).alias("h"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("d"))
    return docs.select(
        F.col("doc_id").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(8)).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        key.alias("key"),
        F.struct(*[docs[c].alias(f"c{i}") for i, c in enumerate(carry)]).alias("carried") if carry else F.lit(None).cast("int").alias("carried"),
    )


def _literal(keys: list) -> Column:
    return constant([{"h": k[0], "d": k[1]} for k in keys], "struct<h:bigint,d:bigint>")


def _sampled(rows: DataFrame, share: Column, salt: int) -> DataFrame:
    """Rows kept with probability ``share``: the draw is a hash of the record's key, so that a repeated task draws the same."""
    draw = F.pmod(F.xxhash64(F.col("key"), F.col("text_crc32"), F.lit(salt)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rows.where(draw < share)


def _quantiles(keys: list, n: int) -> list:
    """Up to ``n`` - 1 splitters: every len/n-th of the sorted keys, each once."""
    keys = sorted(keys)
    return sorted({keys[len(keys) * i // n] for i in range(1, n) if keys})


def splitters(rows: DataFrame, n_ranges: int, total: int, largest: int) -> list:
    """Splitters of ``n_ranges`` ranges of near-equal bytes, from two rounds of size-weighted samples."""
    if n_ranges < 2 or not total:
        return []

    def drawn(of: DataFrame, per_byte: Column, salt: int) -> list:
        # A record that weighs more than one draw stands in the sample as often as it weighs.
        picked = _sampled(of, F.col("size") * per_byte, salt).select("key.h", "key.d", F.greatest(F.lit(1), F.floor(F.col("size") * per_byte)).cast("int").alias("n"))
        return [(r.h, r.d) for r in picked.collect() for _ in range(r.n)]

    first = _quantiles(drawn(rows, F.lit(n_ranges * SAMPLES_PER_RANGE / total), 1), n_ranges)
    totals = {r.r: r.b for r in rows.groupBy(searched(F.col("key"), _literal(first), len(first)).alias("r")).agg(F.sum("size").alias("b")).collect()}
    share = max(total / n_ranges, largest)
    overfull = {r: min(64, -(-b * 2 // int(share))) for r, b in totals.items() if b > 2 * share}
    if not overfull:
        return first
    placed = rows.withColumn("r", searched(F.col("key"), _literal(first), len(first))).where(F.col("r").isin(list(overfull)))
    per_byte = F.element_at(F.create_map(*[F.lit(x) for r, k in overfull.items() for x in (r, k * SAMPLES_PER_RANGE / totals[r])]), F.col("r"))
    more: dict = {}
    for r in _sampled(placed, F.col("size") * per_byte, 2).select("r", "key.h", "key.d", F.greatest(F.lit(1), F.floor(F.col("size") * per_byte)).cast("int").alias("n")).collect():
        more.setdefault(r.r, []).extend([(r.h, r.d)] * r.n)
    return sorted({*first, *(k for r, keys in more.items() for k in _quantiles(keys, overfull[r]))})


def carried_names(carry: list[str]) -> list[str]:
    """Names of the carried columns in the result: one that a column of the result has gets ``carried_`` before it, as often as needed."""
    taken, out = {"doc_id", "size", "text_crc32", "shard", "slot"}, []
    for c in carry:
        name = c
        while name.lower() in taken or name != c and name in carry:
            name = "carried_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def shard_documents(docs: DataFrame, n_shards: int = 24, carry: list[str] = (), ranges_per_shard: int = 16) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` of each row, and the columns in ``carry``."""
    names = carried_names(carry)
    rows = written(sized(docs, carry), "sized")
    whole = rows.agg(F.sum("size").alias("b"), F.max("size").alias("m")).first()
    total = int(whole.b or 0)
    n_ranges = min(MOST_RANGES, max(n_shards * ranges_per_shard, total // RANGE_BYTES))
    cuts = splitters(rows, n_ranges, total, int(whole.m or 0))
    order = Window.partitionBy("range").orderBy("key.h", "key.d", "size", "text_crc32")
    placed = rows.withColumn("range", searched(F.col("key"), _literal(cuts), len(cuts)))
    totals = {r.range: (r.b, r.n) for r in placed.groupBy("range").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()}
    before, b = {}, 0
    for r in sorted(totals):
        before[r] = b
        b += totals[r][0]
    if not totals:
        before = {0: 0}
    starts = F.element_at(constant([before.get(r, 0) for r in range(max(before) + 1)], "bigint"), F.col("range") + 1)
    inside = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # The middle of a record decides, so that a record over a boundary goes where most of it lies.
    middle = starts + F.col("inside") - F.col("size") / 2
    placed = placed.withColumn("inside", inside).withColumn("shard", F.least(F.lit(n_shards - 1), F.floor(middle * n_shards / F.lit(max(total, 1)))).cast("int"))
    placed = placed.withColumn("nth", F.row_number().over(order))
    found = {(r.range, r.shard): (r.n, r.first) for r in placed.groupBy("range", "shard").agg(F.count("*").alias("n"), F.min("nth").alias("first")).collect()}
    base, seen = [], {}
    for r, s in sorted(found):
        n, first = found[r, s]
        base.append((r, s, seen.get(s, 0) - first))
        seen[s] = seen.get(s, 0) + n
    offsets = docs.sparkSession.createDataFrame(base, "range int, shard int, base long")
    placed = placed.join(F.broadcast(offsets), ["range", "shard"])  # at most a row for each range and each shard
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("nth")).cast("long").alias("slot"), *[F.col("carried")[f"c{i}"].alias(n) for i, n in enumerate(names)])
