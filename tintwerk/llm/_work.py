"""Shared intermediate tables and small helpers of the operators."""

from __future__ import annotations

import json
import tempfile
import threading
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a new local one where it is unset and all run on this machine (tests)."""
    if where := spark.conf.get("spark.checkpoint.dir", None):
        return where.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if context.applicationId not in _own:
        _own[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="tintwerk-")
    return _own[context.applicationId]


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


class _Open(threading.local):
    """The ``with`` blocks that are open in this thread."""

    def __init__(self) -> None:
        self.blocks: list[Intermediates] = []


_open = _Open()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    for i in _open.blocks:
        i.paths.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that were ``written`` and that nothing reads any more."""
    for t in tables:
        if path := getattr(t, "written_to", None):
            _delete(t.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


class Intermediates:
    """The tables written within a ``with`` block; those that the result doesn't read go as soon as the others stand."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Intermediates:
        _open.blocks.append(self)
        return self

    def __exit__(self, *_: object) -> None:
        _open.blocks.remove(self)

    def keep_only(self, *tables: DataFrame) -> None:
        kept = {t.written_to for t in tables}
        for path in self.paths:
            if path not in kept:
                _delete(self.spark, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def constant(values: list, kind: str) -> Column:
    """A literal array of long lists of plain values, read from one JSON text: an expression for each value would take the driver seconds."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def searched(key: Column, bounds: Column, n: int) -> Column:
    """How many of the ``n`` ascending ``bounds`` are <= ``key``: a binary search in one expression."""
    steps, step = [], 1
    while step <= n:
        steps.append(step)
        step *= 2
    if not steps:
        return F.lit(0)
    return F.aggregate(
        F.array(*[F.lit(s) for s in reversed(steps)]),
        F.lit(0),
        lambda at, s: F.when((at + s <= n) & (F.element_at(bounds, F.least(at + s, F.lit(n))) <= key), at + s).otherwise(at),
    )
