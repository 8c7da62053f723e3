"""Documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before has kept, and returns
all columns of ``docs`` (the last: the packed pieces). Between stages rows are written to the shared
folder, so a lost executor costs no earlier stage.

1. ``language_id`` drops documents in none of the languages learned from labelled rows.
2. ``exact_dedup`` keeps one of the documents that are equal but for white space.
3. ``near_dedup`` keeps one of the documents linked at a similarity of 0.8 on runs of five words.
4. ``pii`` replaces personal data in the texts by its kind.
5. ``packing`` cuts the texts' ids into pieces and places them in sequences of 2048.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiremill.llm import exact_dedup, langid, near_dedup, packing, pii
from quiremill.llm._common import read, staged


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    return langid.accepted(docs, langid.fit(docs.where(~held_out)))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicated(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.deduplicated(docs, words=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs)


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("near_dedup", near), ("pii", personal_data), ("packing", pack)]

#: SQL cannot express the models of stages 1, 4 and 5.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
