"""Embedding whitening by Chan's merging of moments.

Each partition computes its count, exact sums, local mean and centred scatter; two such parts merge pairwise in a tree
(``treeReduce``), the scatter by Chan's formula: the sum of both, and the outer product of the means' difference weighed by
na * nb / (na + nb). Nothing is ever subtracted after squaring, so a large common offset costs no digits. The driver holds one
dims x dims matrix, of which ``eigh`` gives the components; a second pass takes the same moments of the whitened vectors and
verifies that their covariance is the identity. Rows are then whitened where they stand: there is no shuffle of vectors.

Vectors are scaled to whole numbers, x = floor(64 * c) + 1000000, so that counts and sums are exact integers.

Defined results: vectors that are null, empty, or hold null, NaN or infinite entries take no part, nor do those whose length is
not the commonest of the table (the smaller of equals); x beyond the range of long is taken as its end; all other rows are fitted and
returned, repeated rows, ids and null ids too; a component whose eigenvalue is 0 within rounding cannot be scaled: its
``whitened`` is null, and it takes no part in ``identity_error`` (which is null if no component does); ``explained`` is 0 where all
vectors are equal; a deviation beyond the range of long is null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, OFFSET = 64, 1_000_000
#: Rows handled together; bounds a worker's memory by ROWS x dims.
ROWS = 1024
_LONG = 1 << 63


@dataclass
class Moments:
    """Count, exact sums, mean and centred scatter of vectors."""

    n: int = 0
    total: list[int] = field(default_factory=list)
    mean: np.ndarray | None = None
    scatter: np.ndarray | None = None

    @staticmethod
    def of(rows: np.ndarray, exact: bool = True) -> Moments:
        if not len(rows):
            return Moments()
        if not exact:
            total = []
        elif np.abs(rows.astype(np.float64)).max() < 2.0**62 / len(rows):
            total = rows.sum(axis=0).tolist()
        else:
            total = [sum(c) for c in rows.T.tolist()]
        rows = rows.astype(np.float64)
        near = rows[0].copy()  # the mean of differences keeps the digits that a common offset would take
        mean = near + (rows - near).mean(axis=0)
        rows -= mean
        # einsum, as BLAS would spread each task over all cores
        return Moments(len(rows), total, mean, np.einsum("ni,nj->ij", rows, rows))

    def merged(self, other: Moments) -> Moments:
        if not self.n or not other.n:
            return self if self.n else other
        n, apart = self.n + other.n, other.mean - self.mean
        return Moments(
            n,
            [a + b for a, b in zip(self.total, other.total, strict=True)],
            self.mean + apart * (other.n / n),
            self.scatter + other.scatter + np.outer(apart, apart) * (self.n * other.n / n),
        )


@dataclass
class Whitener:
    """A fit: exact count and sums, eigenvalues falling, components as columns, and the error found by ``verified``."""

    n: int
    total: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    live: np.ndarray
    identity_error: float | None = None

    def deviations(self, rows: np.ndarray) -> np.ndarray:
        """n * x - S, exact to the last step: integers wrap, and the difference is right wherever it fits a long."""
        sums = np.array([(s + _LONG) % (2 * _LONG) - _LONG for s in self.total], np.int64)
        with np.errstate(over="ignore"):
            out = np.int64(self.n) * rows - sums
        rough = self.n * (rows.astype(np.float64) - np.array([s / self.n for s in self.total]))
        if np.abs(rough).max(initial=0) < 2.0**62:
            return out
        return np.array([[self.n * x - s for x, s in zip(r, self.total, strict=True)] for r in rows.tolist()], object).reshape(rows.shape)

    def squares(self, deviations: np.ndarray) -> list[int | None]:
        """Their sums of squares, exact; None beyond a long."""
        if deviations.dtype == np.int64:
            with np.errstate(over="ignore"):
                out = (deviations * deviations).sum(axis=1).tolist()
            unsure = np.flatnonzero((deviations.astype(np.float64) ** 2).sum(axis=1) > 2.0**62).tolist()  # near the end of the range or beyond it
        else:
            out, unsure = [None] * len(deviations), range(len(deviations))
        for k in unsure:
            whole = sum(v * v for v in deviations[k].tolist())
            out[k] = whole if whole < _LONG else None
        return out

    def project(self, deviations: np.ndarray) -> np.ndarray:
        """[row, component] whitened; NaN for components that cannot be scaled."""
        scale = np.where(self.live, np.sqrt(np.where(self.live, self.values, 1.0)), np.nan)
        return np.einsum("nd,dk->nk", deviations.astype(np.float64) / self.n, self.vectors) / scale


def _matrices(batches, dims: int):
    """(ids, long matrix) of the rows of Arrow batches (id, vector of doubles) that take part."""
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            b = batch.slice(at, ROWS)
            b = b.filter(pc.equal(pc.fill_null(pc.list_value_length(b.column(1)), -1), dims))
            values = b.column(1).flatten()
            x = np.asarray(values.fill_null(float("nan")).to_numpy(zero_copy_only=False), np.float64).reshape(-1, dims)
            fine = np.isfinite(x).all(axis=1)
            if not fine.all():
                b, x = b.filter(pa.array(fine)), x[fine]
            if not len(x):
                continue
            with np.errstate(over="ignore"):
                x = np.floor(x * SCALE)
            top = 2.0**63 - 2.0**11  # the last double below the end of long, less the offset
            yield b.column(0), np.where(np.abs(x) < top, np.clip(x, -top, top).astype(np.int64), np.where(x > 0, _LONG - 1 - OFFSET, -_LONG)) + OFFSET


def _vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return df.select(df[id_col].alias("id"), df[vector_col].cast("array<double>").alias("v"))


def commonest_length(df: DataFrame, vector_col: str = "embedding") -> int | None:
    """The length most vectors have, the smaller of equals; None if there is none."""
    sizes = df.select(F.size(vector_col).alias("dims")).where("dims > 0").groupBy("dims").count()
    found = sizes.orderBy(F.desc("count"), "dims").first()
    return found and found["dims"]


def _reduced(vectors: DataFrame, dims: int, of) -> Moments:
    """``of(matrix)`` of all rows, merged in each partition and then pairwise in a tree."""

    def part(batches):
        import pickle

        import pyarrow as pa

        whole = Moments()
        for _, x in _matrices(batches, dims):
            whole = whole.merged(of(x))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(whole)], pa.binary())], ["part"])

    def both(a: bytes, b: bytes) -> bytes:
        import pickle

        return pickle.dumps(pickle.loads(a).merged(pickle.loads(b)))

    import pickle

    parts = vectors.mapInArrow(part, "part binary").rdd.map(lambda r: bytes(r[0]))
    return pickle.loads(parts.treeReduce(both)) if parts.getNumPartitions() else Moments()


def fit(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = 32) -> tuple[Whitener | None, int]:
    """The whitener of the table's vectors, verified by a second pass, and their length; None where no vector takes part."""
    dims = commonest_length(df, vector_col)
    if dims is None:
        return None, 0
    vectors = _vectors(df, id_col, vector_col)
    moments = _reduced(vectors, dims, Moments.of)
    if not moments.n:
        return None, dims
    covariance = moments.scatter / moments.n
    values, axes = np.linalg.eigh((covariance + covariance.T) / 2)
    values, axes = values[::-1][:most], axes[:, ::-1][:, :most]
    top = max(float(values[0]), 0.0)
    live = values > top * dims * np.finfo(float).eps * 4
    whitener = Whitener(moments.n, moments.total, float(np.trace(covariance)), values, np.ascontiguousarray(axes), live)
    if live.any():
        own = _reduced(vectors, dims, lambda x: Moments.of(whitener.project(whitener.deviations(x))[:, whitener.live], exact=False))
        whitener.identity_error = float(np.abs(own.scatter / own.n - np.eye(int(live.sum()))).max())
    return whitener, dims


def whitened(df: DataFrame, whitener: Whitener, dims: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, deviation, whitened array<double>) of every row that takes part; null stands for components that cannot be scaled."""
    shipped = df.sparkSession.sparkContext.broadcast(whitener)  # dims x components

    def run(batches):
        import pyarrow as pa

        w = shipped.value
        for ids, x in _matrices(batches, dims):
            apart = w.deviations(x)
            y = w.project(apart)
            lists = pa.ListArray.from_arrays(np.arange(0, y.size + 1, y.shape[1], dtype=np.int32), pa.array(y.ravel(), pa.float64(), from_pandas=True))
            yield pa.RecordBatch.from_arrays([ids, pa.array(w.squares(apart), pa.int64()), lists], ["id", "deviation", "whitened"])

    kind = df.schema[id_col].dataType.simpleString()
    return _vectors(df, id_col, vector_col).mapInArrow(run, f"id {kind}, deviation long, whitened array<double>").withColumnRenamed("id", id_col)


def components(df: DataFrame) -> DataFrame:
    """A row for each vector that takes part and each of the first 32 components."""
    whitener, dims = fit(df)
    if whitener is None:
        return df.sparkSession.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    share = [float(v / whitener.trace) if whitener.trace > 0 else 0.0 for v in np.maximum(whitener.values, 0.0)]
    return (
        whitened(df, whitener, dims)
        .select(F.col("vec_id").cast("long"), "deviation", F.posexplode("whitened").alias("at", "whitened"))
        .select("vec_id", (F.col("at") + 1).alias("component"), F.lit(whitener.n).cast("long").alias("n"), "deviation", "whitened", F.element_at(F.array(*map(F.lit, share)), F.col("at") + 1).alias("explained"), F.lit(whitener.identity_error).cast("double").alias("identity_error"))
    )
