"""Tables that many joins use, written once.

Joining a table with its own derivatives repeats its whole plan in each; after a few steps planning alone would take minutes.
So what is used often goes to a table in the folder that driver and executors share, which also survives lost executors.
``cleared`` removes these tables when the results that need them have been used.

Spark takes the size of Parquet files for that of rows. Elements of XML are up to a hundred times the size of theirs, so that it would send them through the driver to
broadcast them. What is kept and has many rows is therefore joined by merging.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; only a local session without one gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="quiremill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Folders written within the scopes that are open.
_scopes: list[list[str]] = []


@contextlib.contextmanager
def cleared(spark: SparkSession) -> Iterator[None]:
    """Removes at its end what was written for results within it; these must have been used (saved, counted) by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def dropped(*tables: DataFrame) -> None:
    """Removes written tables that no result needs any more: all that was made of them has been written itself."""
    for t in tables:
        _delete(t.sparkSession, t._quiremill_path)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: cuts the lineage and survives lost executors."""
    path, schema = f"{shared_folder(df.sparkSession)}/quiremill/{name}-{uuid.uuid4().hex}", df.schema
    for scope in _scopes:
        scope.append(path)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(schema).parquet(path)
    out._quiremill_path = path
    return out


#: Rows beyond which a kept table, and what is projected, filtered or grouped from it alone, is not broadcast.
MANY = 20_000


def kept(df: DataFrame) -> DataFrame:
    """``df`` as a written table; what is one already stays as it is."""
    if getattr(df, "_quiremill_kept", False):
        return df
    table = written(df, "kept")
    # counted from the files' footers; the hint goes with the table up to the next join
    out = table.hint("merge") if table.count() > MANY else table
    out._quiremill_kept, out._quiremill_path = True, table._quiremill_path
    return out


def as_kept(df: DataFrame, table: DataFrame) -> DataFrame:
    """``df``, a mere projection of ``table``, which need not be written if that is."""
    df._quiremill_kept = getattr(table, "_quiremill_kept", False)
    return df
