"""Style dimensions of a package's header, and CSS made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiremill.functions import units as U
from quiremill.operators.joins import coalesced_lookup
from quiremill.sources.xml import attribute

_EMPTY = "cast(map() as map<string,string>)"


def _attrs(column: str = "attrs") -> Column:
    """Attributes as a map of local names; the last of equal names counts."""
    local = F.transform(column, lambda a: F.struct(F.element_at(F.split(a["key"], ":"), -1).alias("k"), a["value"].alias("v")))
    names = F.array_distinct(F.transform(local, lambda a: a["k"]))
    return F.map_from_arrays(names, F.transform(names, lambda k: F.element_at(F.filter(local, lambda a: a["k"] == k), -1)["v"]))


def _id(column: str = "attrs") -> Column:
    """The attribute ``id``, else the first whose name holds "id"."""
    other = F.get(F.filter(column, lambda a: F.contains(F.lower(a["key"]), F.lit("id"))), F.lit(0))["value"]
    return F.coalesce(attribute("id", column), other)


def _children(header: DataFrame, parents: tuple[str, ...], pairs: dict[str, Column]) -> DataFrame:
    """(doc_id, pos of the parent, extra map): key-value pairs made of the children of some elements."""
    kids = header.select("doc_id", F.col("parent_pos").alias("pos"), F.col("pos").alias("__at"), "tag", "attrs")
    made = F.lit(None).cast("array<struct<key:string,value:string>>")
    for tag, value in reversed(pairs.items()):
        made = F.when(F.col("tag") == tag, value).otherwise(made)
    rows = kids.select("doc_id", "pos", "__at", made.alias("kv")).where(F.col("kv").isNotNull())
    flat = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("__at", "kv"))), lambda s: s["kv"]))
    merged = rows.groupBy("doc_id", "pos").agg(flat.alias("kv"))
    names = F.array_distinct(F.transform("kv", lambda e: e["key"]))
    return merged.select("doc_id", "pos", F.map_from_arrays(names, F.transform(names, lambda k: F.element_at(F.filter("kv", lambda e: e["key"] == k), -1)["value"])).alias("extra"))


def _kv(**values: Column) -> Column:
    return F.array(*(F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in values.items()))


def dimension(header: DataFrame, tag: str) -> DataFrame:
    """(doc_id, id, attrs) of ``charPr``, ``paraPr`` or ``style`` elements; of equal ids the last counts."""
    true = F.lit("true")
    pairs = {
        "charPr": {"bold": _kv(bold=true), "italic": _kv(italic=true), "underline": _kv(underline=true), "strike": _kv(strike=true), "fontRef": F.transform("attrs", lambda a: F.struct(F.concat(F.lit("fontRef_"), a["key"]).alias("key"), a["value"].alias("value")))},
        "paraPr": {"align": _kv(align_horizontal=attribute("horizontal"), align_vertical=attribute("vertical")), "lineSpacing": _kv(lineSpacing_type=attribute("type"), lineSpacing_value=attribute("value")), "heading": _kv(heading_level=attribute("level")), "border": _kv(borderFillIDRef=attribute("borderFillIDRef"))},
        "style": {},
    }[tag]
    own = header.where(F.col("tag") == tag).select("doc_id", "pos", _id().alias("id"), _attrs().alias("attrs")).where(F.col("id").isNotNull())
    if pairs:
        own = own.join(_children(header, (tag,), pairs), ["doc_id", "pos"], "left").withColumn("attrs", F.map_concat(F.map_filter("attrs", lambda k, _: ~F.coalesce(F.map_contains_key("extra", k), F.lit(False))), F.coalesce("extra", F.expr(_EMPTY))))
    else:
        ref = lambda k: F.element_at("attrs", F.lit(k))
        alias = F.map_filter(F.create_map(F.lit("para_id"), ref("paraPrIDRef"), F.lit("char_id"), ref("charPrIDRef")), lambda _, v: v.isNotNull())
        own = own.withColumn("attrs", F.map_concat("attrs", alias))
    return own.groupBy("doc_id", "id").agg(F.max_by("attrs", "pos").alias("attrs"))


def char_warnings(header: DataFrame) -> DataFrame:
    """(doc_id, id, kind, value): character styles with negative spacing, or condensed other than by zero."""
    own = header.where("tag = 'charPr'").select("doc_id", _id().alias("id"), attribute("spacing").alias("spacing"), attribute("condense").alias("condense"))
    low = own.where(F.col("spacing").try_cast("int") < 0).select("doc_id", "id", F.lit("spacing").alias("kind"), F.col("spacing").alias("value"))
    tight = own.where(F.col("condense").isNotNull() & ~(F.col("condense").try_cast("int").eqNullSafe(F.lit(0)))).select("doc_id", "id", F.lit("condense").alias("kind"), F.col("condense").alias("value"))
    return low.unionByName(tight)


def centre_paragraph(header: DataFrame) -> DataFrame:
    """(doc_id, id): the first paragraph entry that is centred."""
    return header.where("tag = 'align'").where(attribute("horizontal") == "CENTER").select("doc_id", F.col("parent_pos").alias("pos")).join(header.where("tag = 'paraPr'").select("doc_id", "pos", _id().alias("id")), ["doc_id", "pos"]).groupBy("doc_id").agg(F.min_by("id", "pos").alias("id"))


def border_fills(header: DataFrame) -> DataFrame:
    """(doc_id, id, left, right, top, bottom: struct<type, width, color>, fill)."""
    own = header.where("tag = 'borderFill'").select("doc_id", "pos", "end_pos", attribute("id").alias("id"))
    inner = header.where(F.col("tag").isin("leftBorder", "rightBorder", "topBorder", "bottomBorder", "winBrush")).select("doc_id", F.col("pos").alias("at"), "tag", attribute("type").alias("type"), U.px(U.mm_to_px(attribute("width"))).alias("width"), U.color(attribute("color"), swap=True).alias("color"), U.visible_fill(attribute("faceColor")).alias("face"))
    parts = own.join(inner, "doc_id").where((F.col("at") > F.col("pos")) & (F.col("at") <= F.col("end_pos")))
    edge = lambda t: F.min_by(F.struct("type", "width", "color"), F.when(F.col("tag") == t, F.col("at")))
    sides = {s: F.max(F.when(F.col("tag") == f"{s}Border", F.struct("type", "width", "color"))).alias(s) for s in ("left", "right", "top", "bottom")}
    del edge
    grouped = parts.groupBy("doc_id", "pos", "id").agg(*sides.values(), F.max(F.when(F.col("tag") == "winBrush", F.col("face"))).alias("fill"))
    return own.select("doc_id", "pos", "id").join(grouped, ["doc_id", "pos", "id"], "left").drop("pos")


def border_css(prefix: str = "") -> Column:
    """Entries of the four edges and the fill, from the columns of ``border_fills``."""
    at = lambda k: F.col(f"{prefix}{k}")
    sides = [F.struct(F.lit(f"border-{s}").alias("key"), U.edge(at(s)["type"], at(s)["width"], at(s)["color"]).alias("value")) for s in ("left", "right", "top", "bottom")]
    return F.array(*sides, F.struct(F.lit("background-color").alias("key"), at("fill").alias("value")))


def fonts(header: DataFrame) -> DataFrame:
    """(doc_id, lang, id, face)."""
    faces = header.where("tag = 'fontface'").select("doc_id", F.col("pos").alias("parent_pos"), attribute("lang").alias("lang"))
    return header.where("tag = 'font'").select("doc_id", "parent_pos", attribute("id").alias("id"), attribute("face").alias("face")).join(faces, ["doc_id", "parent_pos"]).select("doc_id", "lang", "id", "face")


def _child(header: DataFrame, tag: str, **columns: Column) -> DataFrame:
    """The first child of this tag of every element: (doc_id, pos of the parent, columns)."""
    rows = header.where(F.col("tag") == tag).select("doc_id", F.col("parent_pos").alias("pos"), F.col("pos").alias("__at"), *(c.alias(k) for k, c in columns.items()))
    return rows.groupBy("doc_id", "pos").agg(*(F.min_by(k, "__at").alias(k) for k in columns))


def char_css(header: DataFrame) -> DataFrame:
    """(doc_id, id, css): entries of the character styles in their fixed order."""
    own = header.where("tag = 'charPr'").select("doc_id", "pos", attribute("id").alias("id"), attribute("height").alias("height"), attribute("textColor").alias("color"), attribute("shadeColor").alias("shade"))
    there = F.lit(True)
    out = own.join(_child(header, "fontRef", hangul=attribute("hangul")), ["doc_id", "pos"], "left")
    out = coalesced_lookup(out, ["doc_id"], "hangul", fonts(header), "id", "lang", ["HANGUL", "LATIN"], "face", "face")
    for tag, extra in (("bold", {}), ("italic", {}), ("underline", {"under_color": attribute("color"), "under_shape": attribute("shape")}), ("strikeout", {})):
        out = out.join(_child(header, tag, **{f"has_{tag}": there, **extra}), ["doc_id", "pos"], "left")
    shape = F.when(F.col("under_shape") == "DASHED", "dashed").when(F.col("under_shape") == "DOTTED", "dotted").otherwise("solid")
    line = F.when(F.col("has_strikeout"), "line-through").when(F.col("has_underline"), "underline")
    entries = F.array(
        *(F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in {
            "font-size": U.points(F.col("height")), "color": U.color(F.col("color"), swap=True), "font-family": U.css_quote(F.col("face")), "background-color": U.visible_fill(F.col("shade")),
            "font-weight": F.when(F.col("has_bold"), "700"), "font-style": F.when(F.col("has_italic"), "italic"), "text-decoration-line": line,
            "text-decoration-color": F.when(F.col("has_underline"), U.color(F.col("under_color"), swap=True)), "text-decoration-style": F.when(F.col("has_underline"), shape),
        }.items())
    )
    return out.select("doc_id", F.col("id"), "pos", F.filter(entries, lambda e: e["value"].isNotNull()).alias("css")).groupBy("doc_id", "id").agg(F.max_by("css", "pos").alias("css"))


def para_css(header: DataFrame, borders: DataFrame | None = None) -> DataFrame:
    """(doc_id, id, css): entries of the paragraph styles in their fixed order."""
    own = header.where("tag = 'paraPr'").select("doc_id", "pos", attribute("id").alias("id"))
    out = own.join(_child(header, "align", has_align=F.lit(True), horizontal=attribute("horizontal")), ["doc_id", "pos"], "left")
    out = out.join(_child(header, "lineSpacing", space_type=attribute("type"), space=attribute("value")), ["doc_id", "pos"], "left")
    offsets = {f"off_{s.lower()}": U.px(U.units_to_px(attribute(f"offset{s}"))) for s in ("Top", "Right", "Bottom", "Left")}
    out = out.join(_child(header, "border", fill_id=attribute("borderFillIDRef"), **offsets), ["doc_id", "pos"], "left")
    fills = (border_fills(header) if borders is None else borders).select("doc_id", F.col("id").alias("fill_id"), border_css().alias("border"))
    out = out.join(fills, ["doc_id", "fill_id"], "left")
    align = F.when(F.col("has_align"), F.when(F.col("horizontal") == "CENTER", "center").when(F.col("horizontal") == "RIGHT", "right").otherwise("left"))
    height = F.when((F.col("space_type") == "PERCENT") & F.rlike("space", F.lit("^[0-9]+$")), F.concat(F.col("space").try_cast("long").cast("string"), F.lit("%"))).when(F.col("space_type") == "FIXED", U.px(U.units_to_px(F.col("space"))))
    sides = [F.col(k) for k in offsets]
    padding = F.when(F.coalesce(*sides).isNotNull(), F.concat_ws(" ", *(F.coalesce(c, F.lit("0")) for c in sides)))
    entry = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    entries = F.concat(F.array(entry("text-align", align), entry("line-height", height)), F.coalesce("border", F.expr("cast(array() as array<struct<key:string,value:string>>)")), F.array(entry("padding", padding)))
    return out.select("doc_id", "id", "pos", F.filter(entries, lambda e: e["value"].isNotNull()).alias("css")).groupBy("doc_id", "id").agg(F.max_by("css", "pos").alias("css"))


def style_refs(header: DataFrame) -> DataFrame:
    """(doc_id, style_id, para_ref, char_ref): what paragraph styles refer to."""
    rows = header.where("tag = 'style'").select("doc_id", "pos", attribute("id").alias("style_id"), attribute("type").alias("type"), attribute("paraPrIDRef").alias("para_ref"), attribute("charPrIDRef").alias("char_ref"))
    last = rows.groupBy("doc_id", "style_id").agg(F.max_by(F.struct("type", "para_ref", "char_ref"), "pos").alias("s"))
    return last.where("s.type = 'PARA'").select("doc_id", "style_id", "s.para_ref", "s.char_ref")


def merged_css(base: Column, over: Column) -> Column:
    """Entries of two styles: keys stand where they come first, with the later value."""
    none = F.expr("cast(array() as array<struct<key:string,value:string>>)")
    base, over = F.coalesce(base, none), F.coalesce(over, none)
    kept = F.transform(base, lambda e: F.coalesce(F.get(F.filter(over, lambda o: o["key"] == e["key"]), F.lit(0)), e))
    return F.concat(kept, F.filter(over, lambda o: ~F.exists(base, lambda e: e["key"] == o["key"])))


def page_styles(elems: DataFrame) -> DataFrame:
    """(doc_id, section_no, width, height, padding): size and margins (top right bottom left, px) of a section's first page entry."""
    pages = elems.where("tag = 'pagePr'").groupBy("doc_id", "section_no").agg(F.min_by(F.struct("pos", attribute("width").alias("w"), attribute("height").alias("h")), "pos").alias("p"))
    margin = elems.where("tag = 'margin'").select("doc_id", "section_no", F.col("parent_pos").alias("at"), *(attribute(s).alias(s) for s in ("top", "right", "bottom", "left")))
    out = pages.select("doc_id", "section_no", F.col("p.pos").alias("at"), "p.w", "p.h").join(margin, ["doc_id", "section_no", "at"], "left")
    size = lambda c: U.px(U.units_to_px(F.col(c)))
    return out.select("doc_id", "section_no", size("w").alias("width"), size("h").alias("height"), F.concat_ws(" ", *(F.coalesce(size(s), F.lit("0")) for s in ("top", "right", "bottom", "left"))).alias("padding"))
