"""Exact duplicates by skew-safe combining, in DataFrame operations only.

Texts are equal when identical after deleting white space ``[\\x20\\x09-\\x0D]``. Rows are combined
in three stages, each grouping by the digest *and* the whole normalised text:

1. locally: rows carry the number of their input partition, modulo ``salts``, as salt; all rows of a task have one salt,
   so the map side of the first aggregation leaves one row per text and task, and that alone is shuffled;
2. by (digest, text, salt): the tasks' rows of one text meet in as many tasks as there are salts;
3. by (digest, text): the salts' winners, at most ``salts`` rows a text.

The winner (most code points, then smallest id) travels as one DECIMAL, which a hash aggregation can
update in place. Winners are written to the shared folder without their texts. Stage 3 has compared these in full, so a
digest and length that it left one row for stands for one text, and documents look their group up by the two alone, a join
whose hot side adaptive execution can split. Should a digest and length stand for several texts, the documents that have
them are combined and looked up with their whole texts instead.

Defined results: null text is empty text; equal rows are copies of each other; a null id comes after
all ids, and where it wins ``keep_id`` is null; an empty table gives an empty result; other columns
are ignored by ``groups`` and kept by ``deduplicated``, which keeps one row of each group, however often its winner is repeated.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiremill.llm._common import staged

#: The white space that does not count: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = " \t\n\x0b\x0c\r"
Digest = Callable[[Column], Column]
_STEP, _LAST = Decimal(2**64), Decimal(2**63 - 1)


def _whole(value: Decimal) -> Column:
    return F.lit(str(value)).cast("decimal(20,0)")


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), SPACE, "")


def sha256(norm: Column) -> Column:
    return F.sha2(norm, 256)


KEY = ["text_sha256", "norm_length"]


def _rows(docs: DataFrame, id_col: str, text_col: str, digest: Digest) -> DataFrame:
    """doc_id, norm, points, digest and length of every row; ``row`` has all its columns."""
    text = normalised(docs[text_col])
    own = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs[id_col].cast("long").alias("doc_id"), text.alias("norm"), F.length(F.coalesce(docs[text_col].cast("string"), F.lit(""))).alias("points"))
    return own.withColumns({"text_sha256": digest(F.col("norm")), "norm_length": F.length("norm")})


def _winners(rows: DataFrame, salts: int) -> DataFrame:
    """text_sha256, norm_length, norm, keep_id, group_size: one row per distinct normalised text."""
    worth = F.col("points").cast("decimal(10,0)") * _whole(_STEP) + (_whole(_LAST) - F.coalesce(F.col("doc_id"), F.lit(2**63 - 1)).cast("decimal(20,0)"))
    local = rows.select(*KEY, "norm", worth.alias("worth"), (F.spark_partition_id() % salts).alias("salt"))
    salted = local.groupBy(*KEY, "norm", "salt").agg(F.max("worth").alias("worth"), F.count("*").alias("n"))
    whole = salted.groupBy(*KEY, "norm").agg(F.max("worth").alias("worth"), F.sum("n").alias("group_size"))
    keep = (_whole(_LAST) - F.col("worth") % _whole(_STEP)).cast("long")
    return whole.select(*KEY, "norm", F.nullif(keep, F.lit(2**63 - 1)).alias("keep_id"), "group_size")


def _looked_up(rows: DataFrame, salts: int) -> DataFrame:
    """``rows`` without norm, with the keep_id and group_size of their groups."""
    best = staged(_winners(rows, salts).drop("norm"), "exact-winners")
    several = staged(best.groupBy(KEY).agg(F.count("*").alias("n")).where("n > 1").select(KEY), "exact-several")
    if several.isEmpty():
        return rows.drop("norm").join(best, KEY)
    compared = rows.join(several, KEY, "left_semi")
    return rows.drop("norm").join(several, KEY, "left_anti").join(best, KEY).unionByName(compared.join(_winners(compared, salts), [*KEY, "norm"]).drop("norm"))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 32, digest: Digest = sha256) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    found = _looked_up(_rows(docs, id_col, text_col, digest).drop("row"), salts)
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 32, digest: Digest = sha256) -> DataFrame:
    """One row of ``docs`` for each group, all columns as they were."""
    kept = _looked_up(_rows(docs, id_col, text_col, digest), salts).where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    # only repeated ids can leave several rows of a group, a check that reads the ids alone
    if docs.groupBy(docs[id_col].cast("long").alias("id")).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return kept.select("row.*")
    once = F.col("group_size") == 1
    # combined first within each task: the longest text, then the least
    text = F.coalesce(F.col("row")[text_col].cast("string"), F.lit(""))
    repeats = kept.where(~once).groupBy(*KEY, normalised(F.col("row")[text_col]).alias("norm")).agg(F.min_by("row", F.struct(-F.length(text), text)).alias("row"))
    return kept.where(once).select("row.*").union(repeats.select("row.*"))


#: The same groups as DuckDB SQL.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), g AS (
  SELECT doc_id, sha256(norm) AS text_sha256,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
