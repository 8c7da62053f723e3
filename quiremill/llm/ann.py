"""Approximate nearest neighbours by a hash-prefix forest.

Each tree gives a vector a string of ``BITS`` bits: a bit tells on which side of the median the vector's projection on some
random direction lies. A tree is the sorted array of its strings; the vectors that share a prefix with a query stand together
in it. A query descends every tree to its longest prefix, and then all trees ascend together, one bit at a time, until they
hold ``enough`` matches between them (a match in several trees counts each time). What was found is scored by exact cosine in
double precision.

``enough`` is not given but learned, in each shard: some of its own vectors are searched by brute force, and the least number
is taken at which the forest finds ``recall`` of their neighbours. So vectors that lie in clusters are found among few
candidates, while vectors without any structure, for which no hash prefix does so, still keep the recall.

Equal vectors are one point that carries its ``k`` + 1 smallest ids: no further one can be among the nearest, as ties go to
the smaller id, so a vector that a third of all rows hold is one point. Points are dealt evenly by a hash over shards whose
number depends on the data alone; each shard is a forest in one task's memory, and queries stream past it, each visiting every
shard. Queries are dealt by a hash over blocks of bounded expected size, and each block meets each shard in a task of its own that builds
the shard's forest again, so no task has all queries of a shard however many there are. Nothing is sent to the driver but two counts.

Defined results: vectors that are null, empty, zero, or hold null, NaN or infinite components take no part, nor do rows with
null id; vectors of different lengths are not compared; a row is never its own neighbour; rows with one id are the same row,
as near as the nearest of them, and as a query the least of their vectors; ties go to the smaller id; fewer candidates than
``k`` give fewer rows; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Length of a tree's strings, and random directions that the trees choose theirs from.
BITS, DIRECTIONS = 32, 1024


class Forest:
    """Trees over the rows of a matrix of unit vectors."""

    def __init__(self, rows: np.ndarray, trees: int = 128, k: int = 5, recall: float = 0.95, seed: int = 17):
        n, dims = rows.shape
        self.rows = rows
        rng = np.random.default_rng(seed)
        self.directions = rng.standard_normal((dims, DIRECTIONS)).astype(np.float32)
        self.chosen = [rng.choice(DIRECTIONS, BITS, replace=False) for _ in range(trees)]
        sides = self._projected(rows)
        self.cuts = np.concatenate([np.median(sides[:, a : a + 64], axis=0) for a in range(0, DIRECTIONS, 64)])
        above = sides >= self.cuts
        del sides
        strings = [self._string(above, t) for t in range(trees)]
        self.order = [np.argsort(s, kind="stable").astype(np.int32) for s in strings]
        self.strings = [s[o] for s, o in zip(strings, self.order, strict=True)]
        self.enough = self._learned(k, recall, rng)

    def _projected(self, rows: np.ndarray) -> np.ndarray:
        # as everywhere here no BLAS call, which would spread each task over all cores
        return np.einsum("ij,jk->ik", rows.astype(np.float32), self.directions)

    def _string(self, above: np.ndarray, tree: int) -> np.ndarray:
        out = np.zeros(len(above), np.int64)
        for j in self.chosen[tree]:
            out = out << 1 | above[:, j]
        return out

    def _learned(self, k: int, recall: float, rng) -> int:
        n = len(self.rows)
        some = rng.choice(n, min(n, 64), replace=False)
        near = np.einsum("ij,kj->ik", self.rows[some], self.rows)
        near[np.arange(len(some)), some] = -2
        true = np.argpartition(-near, min(k, n - 1) - 1, axis=1)[:, : min(k, n - 1)] if n > 1 else np.empty((len(some), 0), int)
        enough = 64
        while enough < len(self.strings) * n:
            hit = sum(np.isin(t, found).sum() for t, found in zip(true, self.candidates(self.rows[some], enough), strict=True))
            if hit >= recall * true.size:
                break
            enough = enough * 3 // 2
        return enough

    def ranges(self, queries: np.ndarray, enough: int) -> tuple[np.ndarray, np.ndarray]:
        """[query, tree]: begin and end of the matches of each query when all trees have ascended from the longest prefix until there are ``enough``."""
        above = self._projected(queries) >= self.cuts
        strings = [self._string(above, t) for t in range(len(self.strings))]

        def matches(up: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            low = np.stack([np.searchsorted(own, s >> up << up) for own, s in zip(self.strings, strings, strict=True)], axis=1)
            high = np.stack([np.searchsorted(own, (s >> up) + 1 << up) for own, s in zip(self.strings, strings, strict=True)], axis=1)
            return low, high

        # the matches only grow on the way up: the level where they are enough is found by halving
        least, most = np.zeros(len(queries), np.int64), np.full(len(queries), BITS)
        while (least < most).any():
            middle = (least + most) // 2
            low, high = matches(middle)
            ok = (high - low).sum(axis=1) >= enough
            most, least = np.where(ok, middle, most), np.where(ok, least, np.minimum(middle + 1, most))
        return matches(most)

    def candidates(self, queries: np.ndarray, enough: int | None = None):
        """For each query the distinct rows found, in order of their number."""
        low, high = self.ranges(queries, enough or self.enough)
        seen = np.zeros(len(self.rows), bool)
        for a, z in zip(low.tolist(), high.tolist(), strict=True):
            seen[:] = False
            for order, x, y in zip(self.order, a, z, strict=True):
                seen[order[x:y]] = True
            yield np.flatnonzero(seen)


def _usable(vector: str) -> Column:
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))) & F.exists(vector, lambda x: x != 0)


def _by_length(vectors):
    """{length: (rows, matrix)} of an Arrow column of lists."""
    at = vectors.offsets.to_numpy()
    lengths, flat = np.diff(at), vectors.values.to_numpy(zero_copy_only=False)
    out = {}
    for n in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == n)
        out[n] = (rows, flat[at[rows][:, None] + np.arange(n)])
    return out


def _norms(matrix: np.ndarray) -> np.ndarray:
    return np.sqrt((matrix * matrix).sum(axis=1))


class Shard:
    """The points of one shard that have one length, and their forest."""

    def __init__(self, ids: list[list[int]], matrix: np.ndarray, k: int, trees: int, recall: float):
        self.ids, self.matrix, self.k = ids, matrix, k
        self.norms = _norms(matrix)
        self.unit = matrix / self.norms[:, None]
        self.forest = Forest(self.unit, trees, k, recall)

    def nearest(self, query_ids: list[int], queries: np.ndarray):
        """(query id, ids, scores) of each query."""
        sizes = _norms(queries)
        unit = queries / sizes[:, None]
        for q, some in enumerate(self.forest.candidates(unit)):
            found = self._best(query_ids[q], queries[q], unit[q], sizes[q], some)
            if len(found) < self.k and len(some) < len(self.ids):  # what was found were a few ids' vectors, or its own
                found = self._best(query_ids[q], queries[q], unit[q], sizes[q], np.arange(len(self.ids)))
            yield query_ids[q], list(found), list(found.values())

    def _best(self, own: int, query: np.ndarray, unit: np.ndarray, size: float, some: np.ndarray) -> dict[int, float]:
        rough = np.einsum("ij,j->i", self.unit[some], unit)
        take = self.k + 1
        while True:
            few = some if take >= len(some) else some[rough >= np.partition(rough, len(some) - take)[len(some) - take] - 1e-9]
            exact = np.einsum("ij,j->i", self.matrix[few], query) / (self.norms[few] * size)
            found: dict[int, float] = {}
            for score, i in sorted(((-s, i) for s, r in zip(exact.tolist(), few.tolist(), strict=True) for i in self.ids[r])):
                if i != own and i not in found and len(found) < self.k:
                    found[i] = -score
            if len(found) == self.k or take >= len(some):
                return found
            take *= 4


def nearest(rows: DataFrame, queries: DataFrame, k: int = 5, trees: int = 128, recall: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = 8192, most_shards: int = 64, shard_bytes: int = 32 << 20, block_queries: int = 65536) -> DataFrame:
    """query_id, rank, vec_id, score of each query's ``k`` nearest rows found. ``queries`` has the columns of ``rows``.

    There is a shard for each ``shard_rows`` rows up to ``most_shards`` shards; beyond that they grow to ``shard_bytes`` of vectors.
    There is a block for each ``block_queries`` queries, and a task for each shard and block: that many queries take far longer to answer than
    a forest takes to build, so building it for each block costs little.
    """
    pick = lambda df: df.select(df[id_col].cast("long").alias("vec_id"), df[vector_col].cast("array<double>").alias("vector")).where(F.col("vec_id").isNotNull() & _usable("vector"))
    total, size = pick(rows).agg(F.count("*"), F.coalesce(F.sum(8 * F.size("vector")), F.lit(0))).first()
    shards = max(1, -(-size // shard_bytes), min(most_shards, -(-total // shard_rows)))
    blocks = max(1, -(-pick(queries).select("vec_id").count() // block_queries))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # limited within each task before the shuffle
    order = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    few = pick(rows).distinct().withColumn("n", order).where(F.col("n") <= k + 1)
    points = few.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.pmod(F.xxhash64("vector"), F.lit(shards)).cast("int").alias("shard"), every(blocks).alias("block"), F.lit(False).alias("asks"), "ids", "vector")
    asked = pick(queries).groupBy("vec_id").agg(F.min("vector").alias("vector")).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    asked = asked.select(every(shards).alias("shard"), "block", F.lit(True).alias("asks"), F.array("vec_id").alias("ids"), "vector")
    # the task is the row's own number: neither a sample of the input nor a clash of hashes decides it
    task = (F.col("shard").cast("long") * blocks + F.col("block")).cast("int").alias("task")
    dealt = points.unionByName(asked).select(task, "asks", "ids", "vector").repartitionById(shards * blocks, "task").sortWithinPartitions("task", "asks", "ids")

    def run(batches):
        import pyarrow as pa

        at, held, built = None, [], {}
        for b in batches:
            number, asks = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False)
            change = np.flatnonzero((number[1:] != number[:-1]) | (asks[1:] != asks[:-1])) + 1
            out: tuple[list, list, list] = ([], [], [])
            for a, z in zip([0, *change.tolist()], [*change.tolist(), len(number)], strict=True):
                if z == a:
                    continue
                part = b.slice(a, z - a)
                if number[a] != at:
                    at, held, built = number[a], [], {}
                if not asks[a]:
                    held.append(part)
                    continue
                if held:
                    table = pa.Table.from_batches(held).combine_chunks()
                    ids = table["ids"].to_pylist()
                    column = table["vector"].combine_chunks()
                    for length, (some, matrix) in _by_length(column.chunk(0) if isinstance(column, pa.ChunkedArray) else column).items():
                        built[length] = Shard([ids[r] for r in some.tolist()], matrix, k, trees, recall)
                    held = []
                ids = part.column(2).to_pylist()
                for length, (some, matrix) in _by_length(part.column(3)).items():
                    if length in built:
                        for query, near, scores in built[length].nearest([ids[r][0] for r in some.tolist()], matrix):
                            out[0].extend([query] * len(near)), out[1].extend(near), out[2].extend(scores)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["query_id", "vec_id", "score"])

    merged = dealt.mapInArrow(run, "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return merged.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
