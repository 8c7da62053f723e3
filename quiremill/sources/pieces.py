"""Long values go to Python in pieces, so that no worker holds a section or a document whole."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a value that make a piece; Arrow batches end at ``spark.sql.execution.arrow.maxBytesPerBatch``.
PIECE = 1 << 20


def in_pieces(rows: DataFrame, value: str, names: Sequence[str]) -> DataFrame:
    """(names, n_bytes, piece_no from 0, piece): a binary column or the UTF-8 of a text. A row's pieces follow one another in its
    partition; an empty value is one empty piece, and no value one piece that is null."""
    kind = rows.schema[value].dataType.typeName()
    whole = rows.select(*names, (F.encode(value, "UTF-8") if kind == "string" else F.col(value)).alias("__whole"))
    n = F.coalesce(F.octet_length("__whole"), F.lit(0))
    numbered = whole.select(*names, "__whole", n.alias("n_bytes"), F.explode(F.sequence(F.lit(0), F.floor(F.greatest(n - 1, F.lit(0)) / PIECE).cast("int"))).alias("piece_no"))
    return numbered.select(*names, "n_bytes", "piece_no", F.expr(f"substring(__whole, piece_no * {PIECE} + 1, {PIECE})").alias("piece"))


def is_last(n_bytes: int, piece_no: int) -> bool:
    return (piece_no + 1) * PIECE >= n_bytes


def of_batches(batches):
    """(batch, row, n_bytes, piece_no, piece as a memoryview or None) of ``in_pieces``, whose last three columns these are."""
    for b in batches:
        n_bytes, numbers, pieces = (b.column(b.num_columns - k) for k in (3, 2, 1))
        for k in range(b.num_rows):
            piece = pieces[k].as_buffer()
            yield b, k, n_bytes[k].as_py(), numbers[k].as_py(), None if piece is None else memoryview(piece)
