"""The node table: one row for each table cell and each paragraph of a section's XML.

A run belongs to the cell it is in, if no other run or table lies between, else to the paragraph under the root. Only tables
directly in a run of such a paragraph have cells here. A paragraph's cells come before the paragraph itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiremill.functions import text as X
from quiremill.functions import units as U
from quiremill.operators import aggregate as A
from quiremill.operators import joins as J
from quiremill.operators import sequence as S
from quiremill.operators.keep import kept
from quiremill.operators.styles import dimension
from quiremill.sources.xml import attribute

SECTION = ["doc_id", "section_no"]
#: A blank cell no higher or no wider than this (mm) is a spacer.
SPACER_HEIGHT, SPACER_WIDTH = 3, 8


def _attribute_like(part: str) -> Column:
    return F.get(F.filter("attrs", lambda a: F.contains(F.lower(a["key"]), F.lit(part))), F.lit(0))["value"]


def _int(key: str) -> Column:
    return attribute(key).try_cast("long")


def tables(elems: DataFrame) -> DataFrame:
    """(section, tbl_pos, table_idx): tables in runs of top paragraphs, numbered from 0 in order."""
    run = elems.where("tag = 'run' and depth = 2").select(*SECTION, F.col("pos").alias("parent_pos"))
    top = elems.where("tag = 'p' and depth = 1").select(*SECTION, F.col("pos").alias("top_pos"))
    own = elems.where("tag = 'tbl' and depth = 3").select(*SECTION, "pos", "parent_pos", "top_pos").join(run, [*SECTION, "parent_pos"], "left_semi").join(top, [*SECTION, "top_pos"], "left_semi")
    return S.numbered(own, SECTION, ["pos"], "table_idx").select(*SECTION, F.col("pos").alias("tbl_pos"), "table_idx", "top_pos")


def outer_tables(elems: DataFrame) -> DataFrame:
    """(section, tbl_pos, outer_idx): tables in no other table, wherever they are, numbered from 0."""
    own = elems.where("tag = 'tbl' and outer_tbl_pos = pos")
    return S.numbered(own, SECTION, ["pos"], "outer_idx").select(*SECTION, F.col("pos").alias("tbl_pos"), "outer_idx")


def _cells(elems: DataFrame) -> DataFrame:
    """(section, tc_pos, tbl_pos, row_no, cell_no, border_id, row, col, …) of the direct cells of all tables."""
    kids = elems.where(F.col("tag").isin("cellAddr", "cellSz", "cellSpan")).groupBy(*SECTION, F.col("parent_pos").alias("tc_pos")).agg(
        *(F.max_by(_int(k), F.when(F.col("tag") == t, F.col("pos"))).alias(n) for t, k, n in (("cellAddr", "rowAddr", "row"), ("cellAddr", "colAddr", "col"), ("cellSz", "width", "cell_width"), ("cellSz", "height", "cell_height"), ("cellSpan", "colSpan", "cell_col_span"), ("cellSpan", "rowSpan", "cell_row_span")))
    )
    rows = elems.where("tag = 'tr'").select(*SECTION, F.col("pos").alias("tr_pos"), F.col("parent_pos").alias("tbl_pos"))
    rows = S.numbered(rows, [*SECTION, "tbl_pos"], ["tr_pos"], "row_no")
    own = elems.where("tag = 'tc'").select(*SECTION, F.col("pos").alias("tc_pos"), F.col("parent_pos").alias("tr_pos"), F.coalesce(attribute("borderFillIDRef"), F.lit("")).alias("border_id"))
    out = S.numbered(own.join(rows, [*SECTION, "tr_pos"]), [*SECTION, "tr_pos"], ["tc_pos"], "cell_no").join(kids, [*SECTION, "tc_pos"], "left")
    return out.fillna({"row": -1, "col": -1, "cell_width": 0, "cell_height": 0, "cell_col_span": 1, "cell_row_span": 1})


def _owned_runs(elems: DataFrame) -> DataFrame:
    """Runs with their owner's place: a cell, or a paragraph under the root."""
    run = F.col("tag") == "run"
    in_cell = F.col("tc_pos").isNotNull() & (F.col("tbl_pos") < F.col("tc_pos")) & (F.col("run_above").isNull() | (F.col("run_above") < F.col("tc_pos")))
    in_body = F.col("tbl_pos").isNull() & F.col("run_above").isNull()
    owner = F.when(in_cell, F.col("tc_pos")).when(in_body, F.col("top_pos"))
    return elems.where(run).select(*SECTION, F.col("pos").alias("run_pos"), "p_pos", owner.alias("owner"), _attribute_like("charpridref").alias("char_id")).where(F.col("owner").isNotNull())


def nodes(elems: DataFrame, header: DataFrame | None = None) -> DataFrame:
    """The node table of elements (with ``section_no``); with ``header`` elements also their styles."""
    elems = kept(elems)
    runs = kept(_owned_runs(elems))
    t = elems.where("tag = 't'").select(*SECTION, F.col("parent_pos").alias("run_pos"), F.col("pos").alias("t_pos"), F.coalesce("text", F.lit("")).alias("t_text"))
    pieces = runs.join(t, [*SECTION, "run_pos"], "left")
    ordered = lambda at, value: F.transform(F.sort_array(F.collect_list(F.when(F.col(at).isNotNull(), F.struct(at, value)))), lambda s: s[value])
    owners = pieces.groupBy(*SECTION, "owner").agg(F.array_join(ordered("t_pos", "t_text"), "").alias("raw_text"), F.array_sort(F.collect_list("t_pos")).alias("t_pos"), F.array_sort(F.collect_set("run_pos")).alias("run_pos_all"), F.min_by("p_pos", F.coalesce("t_pos", F.col("run_pos"))).alias("p_pos"))
    char = A.majority(runs, [*SECTION, "owner"], "char_id", "run_pos")
    first_p = runs.groupBy(*SECTION, "owner").agg(F.min_by("p_pos", "run_pos").alias("style_p"))
    refs = elems.where("tag = 'p'").select(*SECTION, F.col("pos").alias("style_p"), _attribute_like("parapridref").alias("para_id"), _attribute_like("styleidref").alias("style_id"))
    owners = owners.join(char, [*SECTION, "owner"], "left").join(first_p.join(refs, [*SECTION, "style_p"], "left"), [*SECTION, "owner"], "left")

    cells = _cells(elems).join(tables(elems), [*SECTION, "tbl_pos"]).withColumn("owner", F.col("tc_pos"))
    cells = cells.join(owners, [*SECTION, "owner"], "left").withColumn("type", F.lit("table_cell"))
    top = elems.where("tag = 'p' and depth = 1").select(*SECTION, F.col("pos").alias("owner"), F.col("pos").alias("top_pos"))
    body = top.join(owners, [*SECTION, "owner"]).withColumn("type", F.lit("body_text"))
    both = cells.unionByName(body, allowMissingColumns=True)
    both = both.withColumns({"raw_text": F.coalesce("raw_text", F.lit("")), "table_idx": F.coalesce("table_idx", F.lit(-1)), "row": F.coalesce("row", F.lit(-1)), "col": F.coalesce("col", F.lit(-1)), "cell_width": F.coalesce("cell_width", F.lit(0)), "cell_height": F.coalesce("cell_height", F.lit(0)), "cell_col_span": F.coalesce("cell_col_span", F.lit(1)), "cell_row_span": F.coalesce("cell_row_span", F.lit(1)), "is_body": F.col("type") == "body_text"})
    both = both.withColumns({"text": X.strip(F.col("raw_text")), "width_mm": U.to_mm(F.col("cell_width")), "height_mm": U.to_mm(F.col("cell_height"))})
    both = both.withColumn("depth", F.when(F.col("is_body"), X.depth(F.col("raw_text"))).otherwise(F.lit(0)))
    spacer = F.col("height_mm").between(1, SPACER_HEIGHT) | F.col("width_mm").between(1, SPACER_WIDTH)
    both = both.withColumn("skip_fill", (F.col("text") == "") & F.when(F.col("is_body"), F.col("depth") == 0).otherwise(spacer))
    both = S.numbered(both, SECTION, ["top_pos", "is_body", "owner"], "nid")
    if header is not None:
        header = kept(header)
        both = J.cascade(both, ["doc_id"], *(kept(dimension(header, k)) for k in ("style", "charPr", "paraPr")))
        both = both.withColumn("style_summary", X.style_summary(F.col("style_name"), F.col("char"), F.col("para")))
    else:
        both = both.withColumns({"style_name": F.lit(None).cast("string"), "style_summary": F.lit(""), "style_missing": F.lit(None).cast("map<string,string>")})
    return both.withColumn("style_refs", F.struct("style_id", "para_id", "char_id"))


def with_global_ids(node_table: DataFrame) -> DataFrame:
    """``gid``: the node's number within its document, sections in order."""
    sizes = S.offsets(node_table.groupBy(*SECTION).agg(F.count("*").alias("n")), ["doc_id"], "section_no", "n")
    return node_table.join(sizes.select(*SECTION, "offset"), SECTION).withColumn("gid", F.col("nid") + F.col("offset")).drop("offset")


def for_model(node_table: DataFrame) -> DataFrame:
    """Nodes worth showing to a model: all but blank ones that are to be skipped. Filter before any Python stage: pushdown stops there."""
    return node_table.where(~(F.col("skip_fill") & X.is_blank(F.col("text")) & X.is_blank(F.col("raw_text"))))


def heading_candidates(node_table: DataFrame, by: Sequence[str], order: Sequence[str], most: int = 20, longest: int = 30) -> DataFrame:
    """Body texts that look like headings, with their ``rank``, the first ``most`` of each group."""
    body = (F.col("type") == "body_text") & ~X.is_blank(F.col("text"))
    like = F.contains("style_summary", F.lit("Heading")) | ((F.length("text") <= longest) & X.starts_with_digit(F.col("text")))
    return node_table.where(body & like).withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= most)


def summaries(elems: DataFrame, header_rows: int = 3) -> DataFrame:
    """One row per outer table: declared rows and columns, header texts, measures of its data rows. A cell's texts include those of tables inside it."""
    outer = outer_tables(elems)
    declared = elems.where("tag = 'tbl'").select(*SECTION, F.col("pos").alias("tbl_pos"), _int("rowCnt").alias("row_count"), _int("colCnt").alias("col_count"))
    cells = _cells(elems).join(outer, [*SECTION, "tbl_pos"])
    # a text belongs to the last cell of its outer table that begins before it
    words = F.when((F.col("tag") == "t") & ~X.is_blank(F.col("text")), X.strip(F.col("text")))
    cell = F.when((F.col("tag") == "tc") & (F.col("tbl_pos") == F.col("outer_tbl_pos")), F.struct(F.col("pos").alias("tc_pos"), F.col("end_pos").alias("tc_end")))
    inside = elems.where(F.col("outer_tbl_pos").isNotNull() & F.col("tag").isin("t", "tc")).select(*SECTION, "outer_tbl_pos", "pos", words.alias("w"), cell.alias("cell"))
    so_far = Window.partitionBy(*SECTION, "outer_tbl_pos").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = inside.withColumn("cell", F.last("cell", True).over(so_far)).where(F.col("w").isNotNull() & (F.col("pos") <= F.col("cell.tc_end")))
    texts = held.groupBy(*SECTION, F.col("cell.tc_pos").alias("tc_pos")).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "w"))), lambda s: s["w"]).alias("texts"))
    rows = cells.join(texts, [*SECTION, "tc_pos"], "left").withColumns({"texts": F.coalesce("texts", F.expr("cast(array() as array<string>)")), "col_span": F.col("cell_col_span"), "width": F.col("cell_width")})
    out = A.table_summaries(rows, [*SECTION, "tbl_pos", "outer_idx"], header_rows)
    return out.join(declared, [*SECTION, "tbl_pos"]).withColumns({"row_count": F.coalesce("row_count", F.lit(0)), "col_count": F.coalesce("col_count", F.lit(0))})


def relevant_summaries(all_summaries: DataFrame, chunk_nodes: DataFrame, chunk: Sequence[str] = (*SECTION, "chunk_no")) -> DataFrame:
    """Summaries of the tables that a chunk has cells of, for each chunk."""
    used = chunk_nodes.where("table_idx >= 0").select(*chunk, F.col("table_idx").alias("outer_idx")).distinct()
    return used.join(all_summaries, [*SECTION, "outer_idx"])


def summary_text(most_headers: int = 15) -> Column:
    """A table summary as a line of text."""
    share = F.concat(F.bround(F.col("empty_ratio") * 100).cast("int").cast("string"), F.lit("%"))
    return F.concat(F.format_string("[table %d] %dx%d, headers: ", "outer_idx", "row_count", "col_count"), F.array_join(F.slice("header_texts", 1, most_headers), " | "), F.lit(", least width "), F.format_string("%.1f", "min_width_mm"), F.lit(" mm, empty "), share, F.when(F.col("border_alternating"), F.lit(", alternating")).otherwise(F.lit("")))


def display() -> Column:
    """A node as a line of text: its number, place and text."""
    place = F.when(F.col("table_idx") >= 0, F.format_string("T%d R%d C%d", "table_idx", "row", "col")).otherwise(F.format_string("body depth=%d", "depth"))
    return F.concat(F.format_string("[%3d] ", "nid"), F.format_string("(%-20s) ", place), F.col("text"))


def chunks(node_table: DataFrame, most: int) -> DataFrame:
    """(section, nid, chunk_no): greedy packing of nodes and whole tables."""
    packed = S.greedy_chunks(S.units(node_table.select(*SECTION, "nid", "table_idx", "row"), SECTION, F.lit(most)), SECTION)
    return packed.select(*SECTION, F.explode("nids").alias("nid"), "chunk_no")


def planned_chunks(node_table: DataFrame, plan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks, errors) of a plan (section, chunk_id, node_ids): no chunk for a section whose plan has an error."""
    listed = plan.select(*SECTION, "chunk_id", F.explode_outer("node_ids").alias("id"))
    errors = J.plan_errors(node_table.select(*SECTION, F.col("nid").alias("id")), listed.where(F.col("id").isNotNull()), SECTION)
    none = listed.where(F.col("id").isNull()).groupBy(*SECTION).agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("chunk_id")), lambda c: c.cast("string")), ",").alias("ids"))
    errors = errors.unionByName(none.withColumn("kind", F.lit("no node_ids")))
    sound = listed.join(errors.select(*SECTION).distinct(), SECTION, "left_anti")
    return sound.select(*SECTION, F.col("id").alias("nid"), F.col("chunk_id").alias("chunk_no")), errors


def merged_chunks(chunk_nodes: DataFrame) -> DataFrame:
    """``chunk_no`` made equal where chunks (section, nid, chunk_no, table_idx) share a table."""
    from quiremill.operators.components import merge_shared

    return chunk_nodes.join(merge_shared(chunk_nodes, SECTION), [*SECTION, "chunk_no"]).drop("chunk_no").withColumnRenamed("merged_no", "chunk_no")
