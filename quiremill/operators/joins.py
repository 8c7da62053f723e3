"""Keyed lookups, pairings and set differences between node tables and their dimensions.

Dimensions (styles, summaries, a plan) belong to a document, so all joins carry the document's key; Spark
broadcasts what its statistics show to be small and shuffles by the key otherwise. No hint is given here.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiremill.functions.text import normalize_label

Keys = Sequence[str]


def merged_maps(*maps: Column) -> Column:
    """Maps joined, later ones first in rank; null maps are empty. Does not depend on the session's policy for equal keys."""
    empty = F.create_map().cast("map<string,string>")
    out = F.coalesce(maps[0], empty)
    return reduce(lambda a, b: F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b), (F.coalesce(m, empty) for m in maps[1:]), out)


def cascade(nodes: DataFrame, by: Keys, styles: DataFrame, chars: DataFrame, paras: DataFrame) -> DataFrame:
    """Nodes (style_id, para_id, char_id) with the attributes that apply: those of the style's character and paragraph
    entries, overridden by the node's own. Dimensions are (by, id, attrs map). Adds style_name, char, para, missing."""
    pick = lambda df, key, name: df.select(*by, F.col("id").alias(key), F.col("attrs").alias(name))
    out = nodes.join(pick(styles, "style_id", "__s"), [*by, "style_id"], "left")
    at = lambda k: F.element_at("__s", F.lit(k))
    out = out.withColumns({"style_name": F.coalesce(F.nullif(at("name"), F.lit("")), at("engName")), "__sc": F.coalesce(at("char_id"), at("charPrIDRef")), "__sp": F.coalesce(at("para_id"), at("paraPrIDRef"))})
    out = out.join(pick(chars, "__sc", "__c1"), [*by, "__sc"], "left").join(pick(paras, "__sp", "__p1"), [*by, "__sp"], "left")
    out = out.join(pick(chars, "char_id", "__c2"), [*by, "char_id"], "left").join(pick(paras, "para_id", "__p2"), [*by, "para_id"], "left")
    gone = lambda ref, hit, name: F.when((F.coalesce(ref, F.lit("")) != "") & hit.isNull(), F.struct(F.lit(name).alias("key"), ref.alias("value")))
    missing = F.map_from_entries(F.array_compact(F.array(gone(F.col("style_id"), F.col("__s"), "style"), gone(F.col("para_id"), F.col("__p2"), "para"), gone(F.col("char_id"), F.col("__c2"), "char"))))
    out = out.withColumns({"char": merged_maps(F.col("__c1"), F.col("__c2")), "para": merged_maps(F.col("__p1"), F.col("__p2")), "style_missing": missing})
    return out.drop("__s", "__sc", "__sp", "__c1", "__c2", "__p1", "__p2")


def missing_references(rows: DataFrame, dimension: DataFrame, on: Keys) -> DataFrame:
    return rows.join(dimension.select(*on).distinct(), list(on), "left_anti")


def coalesced_lookup(rows: DataFrame, by: Keys, key: str, dimension: DataFrame, dim_key: str, group: str, groups: Sequence[str], value: str, name: str) -> DataFrame:
    """The value under (group, key) for the first of ``groups`` that has one, such as a font by script."""
    for k, g in enumerate(groups):
        side = dimension.where(F.col(group) == g).select(*by, F.col(dim_key).alias(key), F.col(value).alias(f"__v{k}"))
        rows = rows.join(side, [*by, key], "left")
    return rows.withColumn(name, F.coalesce(*(F.nullif(f"__v{k}", F.lit("")) for k in range(len(groups))))).drop(*(f"__v{k}" for k in range(len(groups))))


def overlapping_below(cells: DataFrame, by: Keys, most_header: float = 10, least_detail: float = 12, nid: str = "nid", row: str = "row", col: str = "col", row_span: str = "row_span", col_span: str = "col_span", height: str = "height") -> DataFrame:
    """(by, header, detail): a low cell and the nearest cell below it (least row, then column) whose columns overlap, if that one is high.

    Cells overlap where they share a column, so each column is looked along by itself, in one pass from every low cell to the next
    cell at or below its end. Only the nearest candidate is tested for height.
    """
    one = F.greatest(F.lit(1), F.col(row_span))
    columns = F.explode(F.sequence(F.col(col), F.col(col) + F.greatest(F.lit(1), F.col(col_span)) - 1)).alias("__column")
    low = (F.col(height) > 0) & (F.col(height) <= most_header)
    found = F.struct(F.col(row).alias("row"), F.col(col).alias("col"), F.col(nid).alias("detail"), F.col(height).alias("height"))
    heads = cells.where(low).select(*by, columns, (F.col(row) + one).alias("__at"), F.lit(-1).alias("__col"), F.col(nid).alias("header"), F.lit(None).cast(cells.select(found.alias("f")).schema["f"].dataType).alias("f"))
    all_cells = cells.select(*by, columns, F.col(row).alias("__at"), F.col(col).alias("__col"), F.lit(None).cast(cells.schema[nid].dataType).alias("header"), found.alias("f"))
    # a low cell stands before the cells in the row where it ends; in falling order, so that a frame grows by a row at a time
    ahead = Window.partitionBy(*by, "__column").orderBy(F.desc("__at"), F.col("header").isNull().desc(), F.desc("__col"), F.desc("f.detail")).rowsBetween(Window.unboundedPreceding, -1)
    below = heads.unionByName(all_cells).withColumn("__next", F.last("f", True).over(ahead)).where(F.col("header").isNotNull() & F.col("__next").isNotNull())
    nearest = below.groupBy(*by, "header").agg(F.min("__next").alias("n"))
    return nearest.where(F.col("n.height") >= least_detail).select(*by, "header", F.col("n.detail").alias("detail"))


def with_roles(analysis: DataFrame, pairs: DataFrame, by: Keys, widths: DataFrame | None = None) -> DataFrame:
    """Analysis rows (by, id, role, detail_node, header_node, max_chars) with what the pairs say where nothing was said.

    ``keys`` (array of the names that were given, even as null) keeps a given null; without it null counts as not given.
    """
    given = (lambda k: F.array_contains("keys", k)) if "keys" in analysis.columns else (lambda k: F.col(k).isNotNull())
    heads = pairs.select(*by, F.col("header").alias("id"), F.col("detail").alias("__d"))
    tails = pairs.groupBy(*by, F.col("detail").alias("id")).agg(F.min("header").alias("__h"))
    out = analysis.join(heads, [*by, "id"], "left").join(tails, [*by, "id"], "left")
    if widths is not None:
        out = out.join(widths.select(*by, F.col("nid").alias("id"), F.col("max_chars").alias("__w")), [*by, "id"], "left")
    else:
        out = out.withColumn("__w", F.lit(None).cast("int"))
    role = F.when(F.col("__d").isNotNull(), F.lit("summary_header")).when(F.col("__h").isNotNull(), F.lit("detail_body"))
    fill = {"role": role, "detail_node": F.col("__d"), "header_node": F.col("__h"), "max_chars": F.when(F.col("__d").isNotNull(), F.col("__w"))}
    return out.withColumns({k: F.when(given(k), F.col(k)).otherwise(v) for k, v in fill.items()}).drop("__d", "__h", "__w")


def label_values(cells: DataFrame, by: Keys, within: Keys, order: str, nid: str = "nid", text: str = "text") -> DataFrame:
    """(by, label, label_nid, value_nid): each label and the cell after it in its row; of equal labels the last."""
    w = Window.partitionBy(*by, *within).orderBy(order)
    rows = cells.select(*by, *within, order, F.col(nid).alias("label_nid"), normalize_label(F.coalesce(F.col(text), F.lit(""))).alias("label"), F.lead(nid).over(w).alias("value_nid"))
    last = F.struct(*within, order)
    return rows.where(F.col("value_nid").isNotNull() & (F.col("label") != "")).groupBy(*by, "label").agg(F.max_by("label_nid", last).alias("label_nid"), F.max_by("value_nid", last).alias("value_nid"))


def resolved_edits(edits: DataFrame, labels: DataFrame, page_ids: DataFrame | None, by: Keys) -> DataFrame:
    """Edits (by, seq, id, label, new_text) with the node each is for: that of its label, else its id (which must stand on the
    page, if the page has ids), moved from a label's cell to the value's. Edits without a text or target are left out."""
    named = labels.select(*by, F.col("label").alias("__key"), F.col("value_nid").alias("__by_label"))
    moved = labels.groupBy(*by, F.col("label_nid").alias("id")).agg(F.max("value_nid").alias("__moved"))
    out = edits.where(F.col("new_text").isNotNull()).withColumn("__key", normalize_label(F.col("label"))).join(named, [*by, "__key"], "left").join(moved, [*by, "id"], "left")
    own = F.col("id")
    if page_ids is not None:
        out = out.join(page_ids.select(*by, "id").distinct().withColumn("__on", F.lit(True)), [*by, "id"], "left").join(page_ids.select(*by).distinct().withColumn("__any", F.lit(True)), list(by), "left")
        own = F.when(F.col("__on") | F.col("__any").isNull(), F.col("id"))
    out = out.withColumn("target", F.coalesce(F.col("__by_label"), F.when(own.isNotNull(), F.coalesce(F.col("__moved"), own))))
    return out.where(F.col("target").isNotNull()).select(*by, "seq", "target", "new_text")


def plan_errors(nodes: DataFrame, plan: DataFrame, by: Keys, top: int = 20) -> DataFrame:
    """(by, kind, n, ids): ids planned twice, unknown, or missing, with the ``top`` smallest; no rows for a sound plan."""
    ids = nodes.select(*by, "id").distinct()
    planned = plan.groupBy(*by, "id").agg(F.count("*").alias("times"))
    found = planned.where("times > 1").select(*by, F.lit("duplicate").alias("kind"), "id")
    found = found.unionByName(planned.join(ids, [*by, "id"], "left_anti").select(*by, F.lit("unknown").alias("kind"), "id"))
    found = found.unionByName(ids.join(planned, [*by, "id"], "left_anti").select(*by, F.lit("missing").alias("kind"), "id"))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy(*by, "kind").orderBy("id"))).where(F.col("rank") <= top)
    few = ranked.groupBy(*by, "kind").agg(F.array_join(F.transform(F.sort_array(F.collect_list("id")), lambda x: x.cast("string")), ",").alias("ids"))
    return found.groupBy(*by, "kind").agg(F.count("*").alias("n")).join(few, [*by, "kind"])


def orphan_groups(cells: DataFrame, present: DataFrame, by: Keys, group: str, key: str) -> DataFrame:
    """Groups (tables) of which no member is present."""
    marked = cells.join(present.select(*by, key).distinct().withColumn("__there", F.lit(True)), [*by, key], "left")
    return marked.groupBy(*by, group).agg(F.bool_or(F.col("__there").isNotNull()).alias("__any"), F.count("*").alias("n_cells")).where(~F.col("__any")).drop("__any")


def fillable(fills: DataFrame, analysis: DataFrame, by: Keys) -> DataFrame:
    """Fills whose analysis lets them be written: action write, replace or none, category fill, placeholder or checkbox, not
    skipped. Of several fills for a node the last (by seq) counts; fills without an analysis are left out."""
    last = fills.where(F.col("id").isNotNull() & F.col("new_text").isNotNull()).groupBy(*by, "id").agg(F.max_by("new_text", "seq").alias("new_text"))
    act = F.lower(F.trim(F.coalesce("action", F.lit(""))))
    ok = analysis.where(act.isin("", "write", "replace") & F.col("category").isin("fill", "placeholder", "checkbox") & ~F.coalesce("skip_fill", F.lit(False)))
    return last.join(ok.select(*by, "id", "category").dropDuplicates([*by, "id"]), [*by, "id"])


def upserted(existing: DataFrame, new: DataFrame, by: Keys, keys: Sequence[str]) -> DataFrame:
    """Existing rows and those new ones of which none of the ``keys`` is in use; of new rows that clash the first (by seq) stays."""
    fresh = new
    for k in keys:  # an OR of conditions would forbid a hash join; one anti-join for each does not
        fresh = fresh.join(existing.select(*by, k).distinct(), [*by, k], "left_anti")
        fresh = fresh.withColumn("__r", F.row_number().over(Window.partitionBy(*by, k).orderBy("seq"))).where("__r = 1").drop("__r")
    return existing.select(*by, *keys).unionByName(fresh.select(*by, *keys))


def zipped(left: DataFrame, right: DataFrame, by: Keys, left_order: str, right_order: str) -> DataFrame:
    """Rows paired by position, as far as the shorter side goes."""
    rank = lambda df, o: df.withColumn("__pos", F.row_number().over(Window.partitionBy(*by).orderBy(o)))
    return rank(left, left_order).join(rank(right, right_order), [*by, "__pos"]).drop("__pos")


def deletions(marked: DataFrame, unillustrated: DataFrame, pictures: DataFrame, table_cells: DataFrame, by: Keys) -> DataFrame:
    """Ids to delete: those marked, those that go without a picture and have none, and all cells of tables any of whose cells goes."""
    bare = unillustrated.join(pictures.select(*by, "id").distinct(), [*by, "id"], "left_anti")
    ids = marked.select(*by, "id").unionByName(bare.select(*by, "id")).distinct()
    tables = table_cells.join(ids, [*by, "id"], "left_semi").select(*by, "table_idx").distinct()
    return ids.unionByName(table_cells.join(tables, [*by, "table_idx"], "left_semi").select(*by, "id")).distinct()
