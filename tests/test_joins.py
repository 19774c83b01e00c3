"""Tables made of pages meet by shuffle: their size estimates are far too small for the driver to trust."""

import pytest

from pyspark.sql import functions as F

import __spark_entry__ as entry
from tintwerk import schemas
from tintwerk.plans import analysis


def broadcasts(spark, tmp_path, name):
    path = str(tmp_path)
    spark.range(50).selectExpr("id AS c_custkey", "'c' AS c_name").write.mode("overwrite").parquet(f"{path}/customer.parquet")
    return entry.queries()[name](spark, path)._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


@pytest.mark.parametrize("name, most", [("q_overlap", 0), ("q_rects", 0), ("q_verify_findings", 1)])  # the one are the inputs, whose size is measured
def test_no_table_of_unknown_size_is_broadcast(spark, tmp_path, name, most):
    assert broadcasts(spark, tmp_path, name) == most


def test_cases_are_dealt_over_all_cores(spark):
    rows = [(f"c{i}", 2, "Person A", "person", ["Erika Beispiel"], ["erika", "beispiel"], False) for i in range(40)]
    persons = spark.createDataFrame(rows, schemas.PERSONS)
    assert analysis.shared_labels(persons.unionByName(persons.withColumn("label", F.lit("Person B")))).rdd.getNumPartitions() > 1  # adaptive execution made it one
