"""Operators over ordered rows: numbering, packing, breaks, islands.

A document is never too large for one task, and no row looks outside its document, so all windows and
folds are partitioned by document (and section); a job over many documents needs one shuffle by that key,
which the operators after it share.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

Keys = Sequence[str]


def numbered(df: DataFrame, by: Keys, order: Sequence[str | Column], name: str = "nid") -> DataFrame:
    """Rows numbered from 0 within ``by``."""
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).cast("long"))


def offsets(df: DataFrame, by: Keys, order: str, size: str, name: str = "offset") -> DataFrame:
    """The sum of the sizes of the rows before; with it a section's local numbers become the document's."""
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(size).over(before), F.lit(0)).cast("long"))


def units(nodes: DataFrame, by: Keys, most: Column, nid: str = "nid", table: str = "table_idx", row: str = "row") -> DataFrame:
    """What packing must not divide: a body node; a table of fewer than ``most`` cells; else a row of it.

    (by, unit_at, size, oversize, nids): a table stands where its first cell does; ``oversize`` is the number of a divided table.
    """
    cell = F.col(table) >= 0
    whole = Window.partitionBy(*by, table)
    marked = nodes.withColumns({
        "__most": most,
        "__cells": F.when(cell, F.count("*").over(whole)),
        "__first": F.when(cell, F.min(nid).over(whole)).otherwise(F.col(nid)),
    })
    marked = marked.withColumn("__over", F.when(cell & (F.col("__cells") >= F.col("__most")), F.col(table)))
    part = F.when(F.col("__over").isNotNull(), F.col(row)).otherwise(F.lit(-1))
    grouped = marked.groupBy(*by, F.col("__first"), F.col("__over").alias("oversize"), part.alias("__row")).agg(F.count("*").alias("size"), F.min(nid).alias("__low"), F.sort_array(F.collect_list(nid)).alias("nids"), F.first("__most").alias("most"))
    order = Window.partitionBy(*by).orderBy("__first", "__low")
    return grouped.withColumn("unit_at", F.row_number().over(order).cast("long") - 1).drop("__first", "__row", "__low")


def greedy_chunks(units_df: DataFrame, by: Keys) -> DataFrame:
    """``units`` with ``chunk_no``: a chunk takes units in order while they fit; a divided table's rows share no chunk with others.

    A fold within each section: the state is the chunk's number, its fill and the divided table it belongs to.
    """
    def step(state, size, over, most):
        number, fill, last = state
        if number < 0 or over != last or fill + size > most:
            return (number + 1, size, over), number + 1
        return (number, fill + size, over), number

    return folded(units_df, by, "unit_at", ["size", "oversize", "most"], step, (-1, 0, None), "chunk_no").select(*by, "unit_at", "size", "nids", "chunk_no")


def folded(df: DataFrame, by: Keys, order: str, values: Sequence[str], step, start, name: str) -> DataFrame:
    """``df`` with a long column made by a fold over each group's rows in order: ``step(state, *values)`` gives (state, value).

    Rows stream through in sorted Arrow batches, and of a group only the state is held, so a group may have any length.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.LongType())])
    rows = df.repartition(*by).sortWithinPartitions(*by, order)
    keys, given = [df.columns.index(k) for k in by], [df.columns.index(v) for v in values]

    def run(batches):
        import pyarrow as pa

        at, state = None, start
        for b in batches:
            out = []
            for row in zip(*(b.column(k).to_pylist() for k in (*keys, *given)), strict=True):
                if row[: len(keys)] != at:
                    at, state = row[: len(keys)], start
                state, value = step(state, *row[len(keys) :])
                out.append(value)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int64())], [*b.schema.names, name])

    return rows.mapInArrow(run, schema)


def page_numbers(children: DataFrame, by: Keys, order: str, drop: int = 1000, top: int = 1000, used: int = 2000, first: str = "first_pos", last: str = "last_bottom", forced: str | None = None) -> DataFrame:
    """``page_no`` from 0 within ``by``: a new page before a child that stands more than ``drop`` above the last known
    position, or near the top when the last known bottom was beyond ``used``, or that asks for it. Positions may be null."""
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    prev_first, prev_bottom = F.last(first, True).over(before), F.last(last, True).over(before)
    breaks = (F.col(first) < prev_first - drop) | ((F.col(first) <= top) & (prev_bottom > used))
    if forced:
        breaks = F.coalesce(breaks, F.lit(False)) | F.coalesce(F.col(forced), F.lit(False))
    rows = Window.partitionBy(*by).orderBy(order)
    flagged = children.withColumn("__break", F.coalesce(breaks, F.lit(False)) & (F.row_number().over(rows) > 1))
    return flagged.withColumn("page_no", F.sum(F.col("__break").cast("long")).over(rows)).drop("__break")


def row_chunks(rows: DataFrame, by: Keys, order: str, pos: str = "first_pos", forced: str | None = None, drop: int = 1000) -> DataFrame:
    """``chunk_no`` of a table's rows: split before a row that asks for it or lies ``drop`` above the row before.

    A split forgets the position before it, and a row without a position keeps it, so this is a fold.
    """
    ask = F.coalesce(F.col(forced), F.lit(False)) if forced else F.lit(False)
    wanted = rows.select(*by, F.col(order), F.col(pos).cast("double").alias("__pos"), ask.alias("__ask"))

    def step(state, place, asked):
        number, before, first = state
        if not first and (asked or (place is not None and before is not None and place < before - drop)):
            return (number + 1, place, False), number + 1
        return (number, before if place is None else place, False), number

    return folded(wanted, by, order, ["__pos", "__ask"], step, (0, None, True), "chunk_no").select(*by, order, "chunk_no")


def gaps(children: DataFrame, by: Keys, order: str, first: str = "first_pos", last: str = "last_bottom", name: str = "gap") -> DataFrame:
    """The space between a child and the next one, if there is any."""
    gap = F.lead(first).over(Window.partitionBy(*by).orderBy(order)) - F.col(last)
    return children.withColumn(name, F.when(gap > 0, gap))


def text_ranges(segments: DataFrame, by: Keys, order: str, textpos: str, length: Column) -> DataFrame:
    """[start, end) of the text that each line holds: up to where the next begins, the last to the text's end."""
    end = F.coalesce(F.lead(textpos).over(Window.partitionBy(*by).orderBy(order)), length)
    return segments.withColumns({"start": F.greatest(F.col(textpos), F.lit(0)), "end": F.greatest(end, F.lit(0))})


def runs_of_equal(df: DataFrame, by: Keys, order: str, value: str, name: str = "run_no") -> DataFrame:
    """Neighbouring rows of equal value share a number (from 0)."""
    w = Window.partitionBy(*by).orderBy(order)
    change = (F.row_number().over(w) > 1) & ~F.col(value).eqNullSafe(F.lag(value).over(w))
    return df.withColumn("__c", change.cast("long")).withColumn(name, F.sum("__c").over(w)).drop("__c")


def beside_deleted(paragraphs: DataFrame, by: Keys, order: str, empty: str, deleted: str) -> DataFrame:
    """Empty paragraphs that go with a deleted one: the whole run of empty ones on either side of it.

    Deleted paragraphs count as empty here, so runs join across them.
    """
    w = Window.partitionBy(*by).orderBy(order)
    hollow = F.col(empty) | F.col(deleted)
    runs = paragraphs.withColumn("__h", hollow).withColumn("__start", ((F.row_number().over(w) == 1) | (F.col("__h") != F.lag("__h").over(w))).cast("long")).withColumn("__run", F.sum("__start").over(w))
    touched = F.max(F.col(deleted).cast("int")).over(Window.partitionBy(*by, "__run"))
    return runs.withColumn("removed", F.col("__h") & (touched == 1)).drop("__h", "__start", "__run")


def allocated(new: DataFrame, used: DataFrame, by: Keys, used_id: str, order: Sequence[str], name: str, first: int = 1) -> DataFrame:
    """Fresh numbers for new rows: beyond the greatest number in use, which may be text (what is no number does not count)."""
    top = used.groupBy(*by).agg(F.max(F.col(used_id).cast("string").try_cast("long")).alias("__top"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return new.join(top, list(by), "left").withColumn(name, (F.coalesce(F.col("__top"), F.lit(first - 1)) + rank).cast("long")).drop("__top")
