"""Grouped summaries: majority values, table summaries, extents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiremill.functions.text import collapse, is_blank
from quiremill.functions.units import UNITS_PER_MM

Keys = Sequence[str]


def majority(df: DataFrame, by: Keys, value: str, order: str, name: str | None = None) -> DataFrame:
    """The commonest non-null value of each group; of equally common ones the first seen. Two aggregations, no window."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__n"), F.min(order).alias("__first"))
    return counts.groupBy(*by).agg(F.min_by(value, F.struct(-F.col("__n"), F.col("__first"))).alias(name or value))


def alternating(sequence: Column) -> Column:
    """Whether an array has six values or more, just two distinct, and its first ten go a, b, a, b, …"""
    a = F.get(sequence, F.lit(0))
    b = F.get(F.filter(sequence, lambda v: ~v.eqNullSafe(a)), F.lit(0))
    head = F.slice(sequence, 1, 10)
    fits = F.forall(F.arrays_zip(head.alias("v"), F.sequence(F.lit(0), F.size(head) - 1).alias("i")), lambda z: z["v"].eqNullSafe(F.when(z["i"] % 2 == 0, a).otherwise(b)))
    return F.when(F.size(sequence) >= 6, (F.size(F.array_distinct(sequence)) == 2) & fits).otherwise(F.lit(False))


#: What follows the text of a header cell over several columns (a fixed value).
SPAN_LABEL = "({}열병합)"


def table_summaries(cells: DataFrame, by: Keys, header_rows: int = 3, span_label: str = SPAN_LABEL) -> DataFrame:
    """One row per table from its cells (row_no: physical row from 0, cell_no within it, texts, col_span, width, border_id).

    Header texts come from the first ``header_rows`` rows; the measures from the rows after them (of tables without such, from
    all rows but the first, or the only one): least positive width in mm, share of cells without text, alternating borders.
    """
    last = F.max("row_no").over(Window.partitionBy(*by))
    from_row = F.when(last >= header_rows, F.lit(header_rows)).when(last >= 1, F.lit(1)).otherwise(F.lit(0))
    label = F.array_join("texts", " ")
    label = F.when(F.col("col_span") > 1, F.concat(label, F.lit(span_label.split("{}")[0]), F.col("col_span").cast("string"), F.lit(span_label.split("{}")[1]))).otherwise(label)
    at = F.struct("row_no", "cell_no")
    marked = cells.withColumns({"__data": F.col("row_no") >= from_row, "__empty": F.size("texts") == 0, "__label": label})
    ordered = lambda value, keep: F.transform(F.sort_array(F.collect_list(F.when(keep, F.struct(at.alias("at"), F.col(value).alias("v"))))), lambda s: s["v"])
    data = F.col("__data")
    grouped = marked.groupBy(*by).agg(
        (F.max("row_no") + 1).cast("long").alias("n_rows"),
        F.count("*").alias("n_cells"),
        ordered("__label", (F.col("row_no") < header_rows) & ~F.col("__empty")).alias("header_texts"),
        F.min(F.when(data & (F.col("width") > 0), F.col("width"))).alias("__width"),
        F.avg(F.when(data, F.col("__empty").cast("double"))).alias("__ratio"),
        ordered("border_id", data).alias("__borders"),
    )
    return grouped.select(
        *by, "n_rows", "n_cells", "header_texts",
        F.coalesce(F.bround(F.col("__width") / F.lit(UNITS_PER_MM), 1), F.lit(0.0)).alias("min_width_mm"),
        F.coalesce("__ratio", F.lit(0.0)).alias("empty_ratio"), alternating(F.col("__borders")).alias("border_alternating"),
    )


def first_cell_text(cells: DataFrame, by: Keys, nid: str = "nid", text: str = "text") -> DataFrame:
    """The first non-blank text of each table, white space collapsed."""
    return cells.where(~is_blank(F.col(text))).groupBy(*by).agg(F.min_by(text, nid).alias("__t")).select(*by, collapse(F.col("__t")).alias("first_text"))


def extents(segments: DataFrame, by: Keys, seg_no: str = "seg_no", pos: str = "vertpos", size: str = "vertsize") -> DataFrame:
    """First position, last position, last size, last bottom of a paragraph's lines, and the greatest bottom of all."""
    return segments.groupBy(*by).agg(
        F.min_by(pos, seg_no).alias("first_pos"), F.max_by(pos, seg_no).alias("last_pos"), F.max_by(size, seg_no).alias("last_size"),
        F.max_by(F.col(pos) + F.col(size), seg_no).alias("last_bottom"), F.max(F.col(pos) + F.col(size)).alias("max_bottom"),
    )


def bounding_boxes(segments: DataFrame, by: Keys) -> DataFrame:
    """Least left and top, greatest right and bottom of a paragraph's lines."""
    return segments.groupBy(*by).agg(F.min("left").alias("left"), F.min("top").alias("top"), F.max(F.col("left") + F.col("width")).alias("right"), F.max(F.col("top") + F.col("height")).alias("bottom"))


def border_uniformity(cells: DataFrame, by: Keys, kind: str = "border_type", width: str = "border_width") -> DataFrame:
    """Whether no cell has a border, and whether widths or kinds differ (then borders must be drawn apart)."""
    return cells.groupBy(*by).agg(F.bool_and(F.col(kind).isNull() | (F.col(kind) == "NONE")).alias("borderless"), ((F.count_distinct(width) > 1) | (F.count_distinct(kind) > 1)).alias("separate"))


def style_usage(nodes: DataFrame, by: Keys, top: int = 6) -> DataFrame:
    """Distinct references, missing ones, and the commonest style summaries of each document."""
    refs = nodes.groupBy(*by).agg(*(F.count_distinct(f"style_refs.{k}").alias(f"n_{k}") for k in ("style_id", "para_id", "char_id")), *(F.count_if(F.element_at("style_missing", F.lit(k)).isNotNull()).alias(f"missing_{k}") for k in ("style", "para", "char")))
    counts = nodes.where(F.coalesce("style_summary", F.lit("")) != "").groupBy(*by, "style_summary").agg(F.count("*").alias("n"), F.min("nid").alias("first"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "first"))).where(F.col("rank") <= top)
    tops = ranked.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "style_summary", "n"))), lambda s: F.struct(s["style_summary"].alias("style_summary"), s["n"].alias("n"))).alias("top_summaries"))
    return refs.join(tops, list(by), "left")


def span_cover(cells: DataFrame, by: Keys, row: str = "row", col: str = "col", row_span: str = "row_span", col_span: str = "col_span", nid: str = "nid") -> DataFrame:
    """The grid of each table: (by, row, col, kind, nid), kind ``origin``, ``covered`` or ``gap``.

    The last cell at an address counts; cells at negative addresses do not; rows without an origin are left out.
    """
    sane = cells.where((F.col(row) >= 0) & (F.col(col) >= 0))
    last = sane.groupBy(*by, F.col(row).alias("r"), F.col(col).alias("c")).agg(F.max(nid).alias("nid"))
    span = lambda at, n: F.sequence(F.col(at), F.col(at) + F.greatest(F.lit(1), F.col(n)) - 1)
    covered = sane.select(*by, F.explode(span(row, row_span)).alias("r"), col, col_span).select(*by, "r", F.explode(span(col, col_span)).alias("c")).distinct()
    width = covered.groupBy(*by).agg(F.max("c").alias("__max"))
    rows = last.select(*by, "r").distinct()
    grid = rows.join(width, list(by)).select(*by, "r", F.explode(F.sequence(F.lit(0), F.col("__max"))).alias("c"))
    keys = [*by, "r", "c"]
    marked = grid.join(covered.withColumn("__cov", F.lit(True)), keys, "left").join(last, keys, "left")
    kind = F.when(F.col("nid").isNotNull(), "origin").when(F.col("__cov"), "covered").otherwise("gap")
    return marked.select(*by, F.col("r").alias("row"), F.col("c").alias("col"), kind.alias("kind"), "nid")
