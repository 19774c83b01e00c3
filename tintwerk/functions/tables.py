"""Tables that several steps of one plan read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def kept(table: DataFrame) -> DataFrame:
    """``table``, computed once: written to the folder of ``spark.checkpoint.dir``, which outlives executors, or cached where that is unset (tests)."""
    if where := table.sparkSession.conf.get("spark.checkpoint.dir", None):
        context = table.sparkSession.sparkContext
        if context.getCheckpointDir() is None:  # set for the session only
            context.setCheckpointDir(where)
        return table.checkpoint()
    return table.persist()


BROADCAST_BYTES = 8 << 20


def small(side: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``side`` for a broadcast if its rows, as JSON, are measured to be within ``most`` bytes; else for a join by shuffle and sort (see ``met``)."""
    side = kept(side)
    size = side.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    return F.broadcast(side) if size <= most else side.hint("merge")


def met(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` by shuffle and sort, at any size.

    A plan's estimate knows nothing of how many rows an explode or an Arrow pass makes, so by itself it would collect large tables on the driver for a broadcast.
    """
    return left.join(right.hint("merge"), on, how)


def dealt(table: DataFrame, *keys: str) -> DataFrame:
    """``table`` by ``keys`` over all cores: rows that are few bytes but much work, which adaptive execution would put in one task."""
    spark = table.sparkSession
    return table.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)


def numbered(table: DataFrame, order: str, name: str) -> DataFrame:
    """``table`` with its rows' numbers from 1 by ``order``: by ranges and a count for each range, not by one sort in one task."""
    parts = table.repartitionByRange(F.col(order)).sortWithinPartitions(order)
    parts = kept(parts.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id() % (1 << 33)))
    before, base = 0, {}
    for r in parts.groupBy("_p").agg(F.count("*").alias("n")).orderBy("_p").collect():  # one row for each partition
        base[r["_p"]] = before
        before += r["n"]
    offset = F.element_at(F.create_map(*[F.lit(x) for kv in (base or {0: 0}).items() for x in kv]), F.col("_p"))
    return parts.withColumn(name, (offset + F.col("_i") + 1).cast("long")).drop("_p", "_i")
