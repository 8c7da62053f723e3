"""Work that grows with the rows and not with their square."""

from pyspark.sql import functions as F

from quiremill.operators.joins import overlapping_below


def test_cells_below_are_found_in_one_pass(spark):
    """A frame that ends at the last row is gone through anew for each row: the time grew with the square of a table's rows."""
    n = 60_000
    cells = spark.range(n).select(F.lit(0).alias("t"), F.col("id").alias("nid"), F.col("id").alias("row"), F.lit(0).alias("col"), F.lit(1).alias("row_span"), F.lit(1).alias("col_span"), F.when(F.col("id") % 2 == 0, 10).otherwise(12).alias("height"))
    found = overlapping_below(cells, ["t"])
    assert "unboundedfollowing" not in found._jdf.queryExecution().toString().lower()
    assert found.agg(F.count("*"), F.min(F.col("detail") - F.col("header")), F.max(F.col("detail") - F.col("header"))).first() == (n // 2, 1, 1)
