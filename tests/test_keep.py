"""What is kept: tables of many rows are not broadcast, however small their files are."""

import pytest
from pyspark.sql import functions as F

from quiremill.operators import keep
from quiremill.plans import supplier_queries


def _broadcasts(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


@pytest.fixture
def broadcasting(spark):
    key, before = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set(key, "10m")
    yield spark
    spark.conf.set(key, before)


@pytest.mark.parametrize("rows, broadcast", [(keep.MANY, 1), (keep.MANY + 1, 0)])
def test_kept_rows_are_broadcast_by_their_number(broadcasting, rows, broadcast):
    table = keep.kept(broadcasting.range(rows).select("id", F.lit("x" * 2000).alias("text")))
    other = keep.written(broadcasting.range(10).select("id"), "other")
    joined = other.join(table.where("id % 2 = 0").groupBy("id").agg(F.max("text").alias("text")), "id", "left")
    assert _broadcasts(joined) == broadcast
    assert joined.where("text is not null").count() == 5


def test_tables_of_suppliers_are_not_broadcast(broadcasting):
    plan = supplier_queries.packages(broadcasting, "/root/testdata/sf0.001")
    assert _broadcasts(plan) == 0
