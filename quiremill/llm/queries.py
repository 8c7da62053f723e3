"""The queries ``op<N>_<name>`` over the provided tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quiremill.llm import ann, bitpack, bpe, divergence, exact_dedup, langid, near_dedup, packing, pieces, pii, suffix_dedup, toxicity, whitening
from quiremill.llm._common import read


def op1_hash_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    return ann.nearest(rows, rows.where("vec_id % 50 = 0"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(read(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predicted(read(spark, sf_dir, "documents"))


def op4_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(read(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classified(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.linked(read(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found(read(spark, sf_dir, "documents"))


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated(read(spark, sf_dir, "documents"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitpack.round_trip(read(spark, sf_dir, "documents"))


def op11_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(read(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.components(read(spark, sf_dir, "embeddings"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audited(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_hash_prefix_forest,
        op2_packing,
        op3_language_id,
        op4_bpe_encoding,
        op5_exact_dedup,
        op6_toxicity,
        op7_near_dedup,
        op8_pii,
        op9_repeated_passages,
        op10_token_files,
        op11_pieces,
        op12_whitening,
        op13_source_divergence,
    )
}

ORACLE_SQL: dict[str, str] = {"op5_exact_dedup": exact_dedup.ORACLE, "op13_source_divergence": divergence.ORACLE}
