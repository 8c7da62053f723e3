"""Packing by cutting-stock column generation.

A document (its ids and the end id) is cut into whole sequences of ``capacity`` ids and a rest, and a
rest longer than half a sequence into a half and what remains; so no piece is hard to find company for.
Lengths are counted in classes of ``unit`` ids, rounded up. On the histogram of classes a linear
program over patterns (how often each class comes in a sequence) is solved on the driver: a revised
simplex method whose columns are priced by a knapsack dynamic program, until the proven gap to the
optimum is below ``gap``. Patterns are rounded down, and the few pieces left (less than one pattern's
content for each pattern) are filled in greedily. The plan's size depends on the number of classes
alone, not on the data; the histogram has at most ``capacity / unit`` rows.

Pieces are then ranked within their class, and a rank falls into one pattern's copies. Ranks come
from row numbers within (class, salt) and counts of the salts before, so no class meets in one task.
Offsets are running sums within a sequence.

Defined results: null and empty texts are their end id alone; a null id is a document like any other;
pieces of equal length are ranked by id; an empty table has no sequences; other columns are ignored.
"""

from __future__ import annotations

import struct
import warnings
import zlib
from itertools import pairwise

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quiremill.llm._common import default_vocabulary, sliced, staged
from quiremill.llm.bitpack import library_encoder


def best_patterns(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, list[np.ndarray]]:
    """The value of the most valuable multiset of sizes within the capacity, by dynamic programming over capacities, and for each size the most valuable one that holds it, best first. ``sizes`` ascend."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    upto = np.searchsorted(sizes, np.arange(capacity + 1), side="right").tolist()
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if n := upto[c]:
            got = best[c - sizes[:n]] + worth[:n]
            k = int(got.argmax())
            if got[k] > best[c] + 1e-12:
                best[c], pick[c] = got[k], k
    with_each = worth + best[capacity - sizes]
    out = []
    for j in np.argsort(-with_each, kind="stable").tolist():
        if with_each[j] <= 1 + 1e-9:
            break
        counts, c = np.zeros(len(sizes)), capacity - int(sizes[j])
        counts[j] = 1
        while c > 0:
            if pick[c] < 0:
                c -= 1
            else:
                counts[pick[c]] += 1
                c -= int(sizes[pick[c]])
        out.append(counts)
    return float(best[capacity]), out


def inverted(a: np.ndarray) -> np.ndarray:
    """The inverse, by Gauss-Jordan steps. Like all here without BLAS, whose threads can stall a process that shares its cores with a JVM."""
    k = len(a)
    both = np.hstack([a, np.eye(k)])
    for c in range(k):
        top = c + int(np.abs(both[c:, c]).argmax())
        both[[c, top]] = both[[top, c]]
        both[c] /= both[c, c]
        factor = both[:, c].copy()
        factor[c] = 0
        both -= factor[:, None] * both[c]
    return both[:, k:]


def solve(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 1e-3, rounds: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Patterns [pattern, class] and how often each is used (fractions) so that all demand is met with few sequences.

    Each round prices patterns once and takes in all that still improve the plan. The plan is within ``gap`` of the
    optimum when the best price is within ``gap`` of 1; ``rounds`` bounds the work where that takes long, and a warning says so.
    """
    fits = capacity // sizes
    patterns = np.diag(fits.astype(float))
    inverse = np.diag(1.0 / fits)
    used = demand / fits
    for step in range(rounds):
        value, columns = best_patterns(sizes, np.maximum(inverse.sum(axis=0), 0), capacity)
        if value <= 1 + gap:
            break
        for column in columns:
            direction = np.einsum("ij,j->i", inverse, column)
            if direction.sum() <= 1 + gap / 2:  # the price by now
                continue
            up = direction > 1e-9
            ratio = np.full(len(sizes), np.inf)
            ratio[up] = np.maximum(used[up], 0) / direction[up]
            out = int(ratio.argmin())
            used -= ratio[out] * direction
            used[out] = ratio[out]
            patterns[:, out] = column
            row = inverse[out] / direction[out]
            inverse -= np.outer(direction, row)
            inverse[out] = row
        if step % 40 == 39:  # rounding errors go
            inverse = inverted(patterns)
            used = np.einsum("ij,j->i", inverse, demand)
    else:
        warnings.warn(f"the packing plan is not proven to be within {gap} of the optimum after {rounds} rounds", stacklevel=2)
    return patterns.T, np.maximum(used, 0)


def plan(histogram: dict[int, int], capacity: int, **options) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """[(classes, copies of each, times used)]: whole sequences that hold exactly the pieces of the histogram (class size -> pieces)."""
    sizes = np.array(sorted(histogram))
    left = np.array([histogram[s] for s in sizes.tolist()], np.int64)
    out = []
    if not len(sizes):
        return out
    patterns, used = solve(sizes, left.astype(float), capacity, **options)
    for p, x in zip(patterns, used, strict=True):
        counts = np.rint(p).astype(np.int64)
        has = counts > 0
        times = min(int(np.floor(x + 1e-6)), *(left[has] // counts[has]).tolist()) if has.any() else 0
        if times > 0:
            out.append((sizes[has], counts[has], times))
            left -= counts * times
    while left.any():
        room, counts = capacity, np.zeros(len(sizes), np.int64)
        for j in range(len(sizes) - 1, -1, -1):
            if left[j] and sizes[j] <= room:
                counts[j] = min(left[j], room // sizes[j])
                room -= counts[j] * sizes[j]
        has = counts > 0
        times = max(1, int((left[has] // counts[has]).min()))
        out.append((sizes[has], counts[has], times))
        left -= counts * times
    return out


def pieces(docs: DataFrame, capacity: int, vocabulary: str | None = None, end_id: int = 1) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of every piece."""
    tokenizer = vocabulary or default_vocabulary()

    def run(batches):
        import pyarrow as pa

        encode, end = library_encoder(tokenizer), struct.pack("<I", end_id)
        for b in sliced(batches):
            doc, start, length, crc, whole = [], [], [], [], []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = encode(text) + end
                n = len(ids) // 4
                half = n - n % capacity + capacity // 2
                cuts = [*range(0, n, capacity), *([half] if half < n else []), n]
                for a, z in pairwise(cuts):
                    doc.append(doc_id), start.append(a), length.append(z - a), whole.append(n)
                    crc.append(zlib.crc32(ids[4 * a : 4 * z]))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (doc, start, length, crc, whole)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def packed(docs: DataFrame, capacity: int = 2048, unit: int = 8, vocabulary: str | None = None, end_id: int = 1, salts: int = 256) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    if capacity % unit:
        raise ValueError("the capacity must be a multiple of the unit")
    spark = docs.sparkSession
    cut = staged(pieces(docs, capacity, vocabulary, end_id).withColumn("size", F.ceil(F.col("length") / unit).cast("int")), "packing-pieces")
    histogram = {r["size"]: r["n"] for r in cut.groupBy("size").agg(F.count("*").alias("n")).collect()}  # at most capacity / unit rows

    rows, taken, sequence = [], dict.fromkeys(histogram, 0), 0
    for classes, copies, times in plan(histogram, capacity // unit):
        for c, a in zip(classes.tolist(), copies.tolist(), strict=True):
            rows.append((c, taken[c], taken[c] + a * times, a, sequence))
            taken[c] += a * times
        sequence += times
    places = spark.createDataFrame(rows, "size int, low long, high long, copies long, first long")

    salts *= 1 + sum(histogram.values()) // (salts << 18)
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)).cast("int"))
    own = salted.withColumn("row", F.row_number().over(Window.partitionBy("size", "salt").orderBy("doc_id", "start")) - 1)
    counts = salted.groupBy("size", "salt").agg(F.count("*").alias("n"))
    before = counts.select("size", "salt", (F.sum("n").over(Window.partitionBy("size").orderBy("salt")) - F.col("n")).alias("before"))
    ranked = own.join(before, ["size", "salt"]).withColumn("rank", F.col("row") + F.col("before"))
    placed = ranked.join(F.broadcast(places), (ranked["size"] == places["size"]) & (ranked["rank"] >= places["low"]) & (ranked["rank"] < places["high"]))
    chosen = placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first") + F.floor((F.col("rank") - F.col("low")) / F.col("copies"))).cast("long").alias("sequence_id"), "rank")
    order = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "rank")
    return chosen.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", (F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")).alias("offset"))
