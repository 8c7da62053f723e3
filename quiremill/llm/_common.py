"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from quiremill.operators.keep import dropped
from quiremill.operators.keep import written as staged

__all__ = ["SLICE", "default_pieces", "default_vocabulary", "dropped", "read", "sliced", "staged"]

#: Rows that Python workers turn into lists at a time; bounds a worker's memory, not the result.
SLICE = 256


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def sliced(batches, size: int = SLICE):
    """The rows of Arrow batches, ``size`` at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def default_vocabulary() -> str:
    """Where the public word-level BPE vocabulary is installed."""
    import public_tokenizers

    return os.fspath(public_tokenizers.path("word_bpe_49k.json"))


def default_pieces() -> str:
    """Where the public SentencePiece model is installed."""
    import public_tokenizers

    return os.fspath(public_tokenizers.path("piece_bpe_32k.model"))
