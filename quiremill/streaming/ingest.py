"""Packages as they arrive: the same relations over a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quiremill.sources import package


def arriving(spark: SparkSession, path: str, glob: str = "*.hwpx") -> DataFrame:
    """``entries`` of packages as they are put into a folder. Stateless: each package is whole in one file."""
    return package.entries(package.files(spark, path, glob, streaming=True))


def keep_entries(spark: SparkSession, path: str, table: str, checkpoint: str, glob: str = "*.hwpx", once: bool = True) -> StreamingQuery:
    """Append arriving entries to a Parquet table, exactly once; ``once`` stops when all files there are read."""
    writer = arriving(spark, path, glob).writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
