"""The operators on the provided tables, each with the same result as DuckDB SQL.

The tables hold no packages, so every query says which operator it runs and makes the operator's columns from the
table's own by plain arithmetic on keys, the same way in both languages. Numbers are BIGINT or DOUBLE on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiremill.functions import text as X
from quiremill.functions import units as U
from quiremill.operators import aggregate as A
from quiremill.operators import joins as J
from quiremill.operators import sequence as S
from quiremill.operators.components import merge_shared

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _long(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


_STRIP = r"regexp_replace({}, '^[\s\p{{Z}}\x0b\x1c-\x1f\x85]+|[\s\p{{Z}}\x0b\x1c-\x1f\x85]+$', '', 'g')"
_LINES = """
lines AS (
  SELECT doc_id, source, CAST(pos AS BIGINT) AS pos,
         CASE WHEN pos % 11 IN (4, 5) THEN repeat(' ', CAST(pos % 3 AS INT)) ELSE repeat(' ', CAST(pos % 7 AS INT)) || p END AS raw
  FROM (SELECT doc_id, source, unnest(l) AS p, unnest(range(len(l))) AS pos FROM (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents))
)"""
_NODES = "WITH RECURSIVE" + _LINES + f""", nodes AS (
  SELECT doc_id, source, pos AS nid, raw, {_STRIP.format('raw')} AS text, CAST((length(raw) - length(ltrim(raw))) // 2 AS BIGINT) AS depth FROM lines
)"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of documents; by their place some are blank and the others indented."""
    lines = _read(spark, sf_dir, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("pos", "p"))
    raw = F.when((F.col("pos") % 11).isin(4, 5), F.repeat(F.lit(" "), F.col("pos") % 3)).otherwise(F.concat(F.repeat(F.lit(" "), F.col("pos") % 7), F.col("p")))
    return lines.select("doc_id", "source", F.col("pos").cast("long").alias("pos"), raw.alias("raw"))


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("doc_id", "source", F.col("pos").alias("nid"), "raw", X.strip(F.col("raw")).alias("text"), X.depth(F.col("raw")).cast("long").alias("depth"))


@_query(_NODES + " SELECT doc_id, nid, text, depth, (text = '' AND depth = 0) AS skip_fill FROM nodes")
def q_paragraph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Node table of paragraphs: number, text, depth, whether there is nothing to fill."""
    return _nodes(spark, sf_dir).select("doc_id", "nid", "text", "depth", ((F.col("text") == "") & (F.col("depth") == 0)).alias("skip_fill"))


@_query(_NODES + """, c AS (SELECT source, doc_id, count(*) AS n_nodes FROM nodes GROUP BY ALL)
SELECT source, doc_id, n_nodes, CAST(coalesce(sum(n_nodes) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_gid FROM c""")
def q_global_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section offsets: a source stands for a document, a document for a section."""
    counts = _nodes(spark, sf_dir).groupBy("source", "doc_id").agg(F.count("*").alias("n_nodes"))
    return S.offsets(counts, ["source"], "doc_id", "n_nodes", "first_gid")


@_query(_NODES + """, marked AS (
  SELECT doc_id, nid, CASE WHEN (nid // 5) % 3 = 1 THEN nid // 5 ELSE -1 END AS table_idx, (nid % 5) // 2 AS "row", CASE WHEN doc_id % 2 = 0 THEN 4 ELSE 7 END AS most FROM nodes
), sized AS (SELECT *, CASE WHEN table_idx >= 0 THEN count(*) OVER (PARTITION BY doc_id, table_idx) END AS cells,
                    CASE WHEN table_idx >= 0 THEN min(nid) OVER (PARTITION BY doc_id, table_idx) ELSE nid END AS place FROM marked),
u AS (SELECT doc_id, most, place, CASE WHEN cells >= most THEN table_idx END AS over_, CASE WHEN cells >= most THEN "row" ELSE -1 END AS r, count(*) AS size, min(nid) AS low, max(nid) AS high FROM sized GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY place, low) AS k FROM u),
fold AS (
  SELECT doc_id, k, CAST(0 AS BIGINT) AS chunk_no, size AS fill, over_, low, high FROM n WHERE k = 1
  UNION ALL
  SELECT n.doc_id, n.k, CASE WHEN f.over_ IS DISTINCT FROM n.over_ OR f.fill + n.size > n.most THEN f.chunk_no + 1 ELSE f.chunk_no END,
         CASE WHEN f.over_ IS DISTINCT FROM n.over_ OR f.fill + n.size > n.most THEN n.size ELSE f.fill + n.size END, n.over_, n.low, n.high
  FROM fold f JOIN n ON n.doc_id = f.doc_id AND n.k = f.k + 1
)
SELECT doc_id, chunk_no, CAST(sum(s) AS BIGINT) AS n_nodes, min(low) AS first_nid, max(high) AS last_nid FROM (SELECT f.*, n.size AS s FROM fold f JOIN n USING (doc_id, k)) GROUP BY ALL""")
def q_chunk_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy packing of nodes and whole tables into chunks; every third run of five paragraphs stands for a table."""
    nid = F.col("nid")
    fifth = F.floor(nid / 5)
    nodes = _nodes(spark, sf_dir).select("doc_id", "nid", F.when(fifth % 3 == 1, fifth).otherwise(F.lit(-1)).cast("long").alias("table_idx"), F.floor((nid % 5) / 2).cast("long").alias("row"))
    most = F.when(F.col("doc_id") % 2 == 0, 4).otherwise(7)
    packed = S.greedy_chunks(S.units(nodes, ["doc_id"], most), ["doc_id"])
    out = packed.groupBy("doc_id", "chunk_no").agg(F.sum("size").alias("n_nodes"), F.min(F.array_min("nids")).alias("first_nid"), F.max(F.array_max("nids")).alias("last_nid"))
    return _long(out, "n_nodes")


@_query("""WITH ids AS (SELECT DISTINCT source, doc_id AS id FROM documents),
plan AS (SELECT source, doc_id AS id FROM documents JOIN labels USING (doc_id) UNION ALL SELECT source, doc_id + 20 FROM documents JOIN labels USING (doc_id) WHERE doc_id % 3 = 0),
planned AS (SELECT source, id, count(*) AS times FROM plan GROUP BY ALL),
found AS (SELECT source, 'duplicate' AS kind, id FROM planned WHERE times > 1
  UNION ALL SELECT p.source, 'unknown', p.id FROM planned p ANTI JOIN ids USING (source, id)
  UNION ALL SELECT i.source, 'missing', i.id FROM ids i ANTI JOIN planned USING (source, id)),
r AS (SELECT *, row_number() OVER (PARTITION BY source, kind ORDER BY id) AS k, count(*) OVER (PARTITION BY source, kind) AS n FROM found)
SELECT source, kind, n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids FROM r WHERE k <= 20 GROUP BY ALL""")
def q_plan_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of a chunk plan; labelled documents and some shifted by 20 stand for the planned ids of a source."""
    docs = _read(spark, sf_dir, "documents").select("source", "doc_id")
    own = docs.join(_read(spark, sf_dir, "labels").select("doc_id"), "doc_id")
    plan = own.select("source", F.col("doc_id").alias("id")).unionByName(own.where("doc_id % 3 = 0").select("source", (F.col("doc_id") + 20).alias("id")))
    return J.plan_errors(docs.select("source", F.col("doc_id").alias("id")), plan, ["source"])


_PLAIN = r"regexp_replace(html, '<br\s*/?>', chr(10), 'gi')"


@_query(rf"""SELECT page_id, {_STRIP.format(r"regexp_replace(replace(CASE WHEN contains(b, '<') AND contains(b, '>') THEN regexp_replace(b, '<[^>]+>', '', 'g') ELSE b END, chr(160), ' '), '[\s\p{Z}\x0b\x1c-\x1f\x85]+', ' ', 'g')")} AS plain FROM (SELECT page_id, {_PLAIN} AS b FROM pages)""")
def q_html_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markup out of a proposed text, but for references."""
    return _read(spark, sf_dir, "pages").select("page_id", X.collapse(X.strip_markup(F.col("html"))).alias("plain"))


_ITEMS = r"items AS (SELECT page_id, CAST(item_no AS BIGINT) AS item_no, item FROM (SELECT page_id, unnest(l) AS item, unnest(range(len(l))) AS item_no FROM (SELECT page_id, regexp_extract_all(html, '(?s)<li[^>]*>(.*?)</li>', 1) AS l FROM pages)))"


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _read(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?s)<li[^>]*>(.*?)</li>"), F.lit(1))).alias("item_no", "item"))
    return _long(items, "item_no")


@_query(f"WITH {_ITEMS} SELECT * FROM items")
def q_html_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of a page by pattern; list items stand for cells."""
    return _items(spark, sf_dir)


@_query(rf"""WITH {_ITEMS}, l AS (SELECT page_id, item_no, {_STRIP.format(r"regexp_replace(item, '[\s\p{Z}\x0b\x1c-\x1f\x85]+', ' ', 'g')")} AS label, lead(item_no) OVER (PARTITION BY page_id, item_no // 4 ORDER BY item_no) AS value_nid FROM items)
SELECT page_id, label, max(item_no) AS label_nid, max(value_nid) AS value_nid FROM l WHERE value_nid IS NOT NULL AND label <> '' GROUP BY ALL""")
def q_label_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label and value cells; items stand for cells, four a row."""
    cells = _items(spark, sf_dir).select("page_id", F.floor(F.col("item_no") / 4).alias("row"), F.col("item_no").alias("col"), F.col("item_no").alias("nid"), F.col("item").alias("text"))
    return J.label_values(cells, ["page_id"], ["row"], "col")


_DECODED = "replace(replace(replace(replace({}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"


@_query(f"""WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS id, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS text, unnest(range(len(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>')))) AS k FROM pages)
SELECT page_id, {_DECODED.format('id')} AS id, string_agg({_DECODED.format('text')}, '' ORDER BY k) AS text, bool_or(text <> '') AS has_data FROM a GROUP BY page_id, {_DECODED.format('id')}""")
def q_link_text_by_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text by the nearest element that carries an id; link targets stand for ids."""
    from quiremill.sources.html import owned_text

    return owned_text(_read(spark, sf_dir, "pages").select("page_id", "html"), ["page_id"], attribute="href").select("page_id", "id", "text", "has_data")


@_query(_NODES + """, h AS (SELECT doc_id, nid, depth, CASE WHEN nid % 13 = 0 THEN CAST(nid + 1 AS VARCHAR) || '. ' || substr(text, 1, 20) ELSE text END AS text FROM nodes),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY nid) AS rank FROM h WHERE text <> '' AND length(text) <= 30 AND regexp_matches(text, '^[0-9]'))
SELECT doc_id, nid, text, rank FROM r WHERE rank <= 20""")
def q_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heading candidates, the first 20 of a document; some paragraphs get a number."""
    from quiremill.operators.nodes import heading_candidates

    nid = F.col("nid")
    numbered = F.when(nid % 13 == 0, F.concat((nid + 1).cast("string"), F.lit(". "), F.substring("text", 1, 20))).otherwise(F.col("text"))
    nodes = _nodes(spark, sf_dir).select("doc_id", "nid", numbered.alias("text"), F.lit("").alias("style_summary"), F.lit("body_text").alias("type"))
    return _long(heading_candidates(nodes, ["doc_id"], ["nid"]), "rank").select("doc_id", "nid", "text", "rank")


_SAFE = "regexp_replace(regexp_replace({}, '[^0-9A-Za-z._-]+', '_', 'g'), '^_+|_+$', '', 'g')"


@_query(f"""WITH n AS (SELECT 'page' AS kind, page_id AS id, {_SAFE.format("regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)$', 1)")} AS s FROM pages UNION ALL SELECT 'part', p_partkey, {_SAFE.format("p_name || ' (' || p_type || ')'")} FROM part)
SELECT kind, id, CASE WHEN b LIKE '%.zip' THEN b ELSE b || '.zip' END AS name FROM (SELECT kind, id, CASE WHEN s = '' THEN 'document' ELSE s END AS b FROM n)""")
def q_safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Storage names from URLs and titles."""
    pages = _read(spark, sf_dir, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), X.name_from_url(F.col("url"), "document", ".zip").alias("name"))
    title = F.concat("p_name", F.lit(" ("), "p_type", F.lit(")"))
    return pages.unionByName(_read(spark, sf_dir, "part").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"), X.safe_name(title, "document", ".zip").alias("name")))


_MARKED = "CASE nid % 5 WHEN 0 THEN text || ' [IMAGE: chart ' || nid || ' | fig | 4:3]  end' WHEN 1 THEN '[IMAGE]' || text WHEN 2 THEN text || '[IMAGE:only]' ELSE text END"


@_query(_NODES + rf""", m AS (SELECT doc_id, nid, {_MARKED} AS t FROM nodes), x AS (SELECT *, regexp_extract_all(t, '\[IMAGE(?::([^\]]+))?\]', 1) AS b FROM m)
SELECT doc_id, nid, {_STRIP.format(r"regexp_replace(regexp_replace(t, '\[IMAGE(?::([^\]]+))?\]', '', 'g'), '[\s\p{Z}\x0b\x1c-\x1f\x85]{2,}', ' ', 'g')")} AS cleaned, CAST(len(b) AS BIGINT) AS n_markers,
 coalesce(trim(string_split(b[1], '|')[1]), '') AS prompt, coalesce(trim(string_split(b[1], '|')[2]), '') AS caption, coalesce(trim(string_split(b[1], '|')[3]), '') AS ratio FROM x""")
def q_marker_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Picture requests inside texts; put in by the paragraph's number."""
    nid, text = F.col("nid"), F.col("text")
    marked = F.when(nid % 5 == 0, F.concat(text, F.lit(" [IMAGE: chart "), nid.cast("string"), F.lit(" | fig | 4:3]  end"))).when(nid % 5 == 1, F.concat(F.lit("[IMAGE]"), text)).when(nid % 5 == 2, F.concat(text, F.lit("[IMAGE:only]"))).otherwise(text)
    found = _nodes(spark, sf_dir).select("doc_id", "nid", marked.alias("t")).withColumn("m", X.markers(F.col("t")))
    first = lambda k: F.coalesce(F.get("m", F.lit(0))[k], F.lit("")).alias(k)
    return found.select("doc_id", "nid", X.without_markers(F.col("t")).alias("cleaned"), F.size("m").cast("long").alias("n_markers"), first("prompt"), first("caption"), first("ratio"))


_ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate, l_extendedprice"
_CELLS = f"""k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) - 1 AS k FROM lineitem)"""


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items in a total order within their order; an order stands for a table."""
    return S.numbered(_read(spark, sf_dir, "lineitem"), ["l_orderkey"], _ORDER.split(", "), "k")


@_query(f"""WITH {_CELLS}, c AS (SELECT l_orderkey, k // 2 AS row_no, k % 2 AS cell_no, k % 4 = 3 AS empty, CAST(l_quantity * 100 AS BIGINT) - 1000 AS width, l_returnflag AS border,
  l_linestatus || k || CASE WHEN k % 3 = 1 THEN '(2열병합)' ELSE '' END AS label, max(k // 2) OVER (PARTITION BY l_orderkey) AS last FROM k),
d AS (SELECT *, row_no >= CASE WHEN last >= 3 THEN 3 WHEN last >= 1 THEN 1 ELSE 0 END AS data FROM c)
SELECT l_orderkey, max(row_no) + 1 AS n_rows, count(*) AS n_cells, coalesce(string_agg(label, '|' ORDER BY row_no, cell_no) FILTER (row_no < 3 AND NOT empty), '') AS header_texts,
 coalesce(round_even(min(width) FILTER (data AND width > 0) / 283.465, 1), 0.0) AS min_width_mm, round(coalesce(avg(CAST(empty AS INT)) FILTER (data), 0.0), 6) AS empty_ratio,
 count(*) FILTER (data) >= 6 AND count(DISTINCT border) FILTER (data) = 2 AND coalesce(list_slice(list(border ORDER BY row_no, cell_no) FILTER (data), 1, 10) = list_transform(range(least(10, count(*) FILTER (data))), lambda i: CASE WHEN i % 2 = 0 THEN (list(border ORDER BY row_no, cell_no) FILTER (data))[1] ELSE (list(border ORDER BY row_no, cell_no) FILTER (data))[2] END), false) AS border_alternating
FROM d GROUP BY l_orderkey""")
def q_table_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table summaries; line items stand for cells, two a row."""
    k = F.col("k")
    label = F.concat("l_linestatus", k.cast("string"))
    cells = _cells(spark, sf_dir).select("l_orderkey", F.floor(k / 2).alias("row_no"), (k % 2).alias("cell_no"), F.when(k % 4 == 3, F.array().cast("array<string>")).otherwise(F.array(label)).alias("texts"), F.when(k % 3 == 1, 2).otherwise(1).alias("col_span"), (F.col("l_quantity") * 100).cast("long").alias("w"), F.col("l_returnflag").alias("border_id"))
    out = A.table_summaries(cells.withColumn("width", F.col("w") - 1000).drop("w"), ["l_orderkey"])
    return out.withColumns({"header_texts": F.array_join("header_texts", "|"), "empty_ratio": F.round("empty_ratio", 6)})


@_query(f"""WITH k AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, {_ORDER}) - 1 AS k FROM lineitem),
v AS (SELECT l_suppkey, k, CASE WHEN l_suppkey % 3 = 0 THEN CAST(k % 2 AS VARCHAR) WHEN l_suppkey % 3 = 1 THEN CASE WHEN k < 10 THEN CAST(k % 2 AS VARCHAR) ELSE '0' END ELSE l_linestatus END AS v FROM k),
g AS (SELECT l_suppkey, list(v ORDER BY k) AS l FROM v GROUP BY ALL)
SELECT l_suppkey, CAST(len(l) AS BIGINT) AS n, len(l) >= 6 AND len(list_distinct(l)) = 2 AND l[1] <> l[2] AND list_slice(l, 1, 10) = list_transform(range(least(10, len(l))), lambda i: l[i % 2 + 1]) AS alternating FROM g""")
def q_alternating(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alternating borders; a supplier's line items stand for a table's cells."""
    rows = S.numbered(_read(spark, sf_dir, "lineitem"), ["l_suppkey"], ["l_orderkey", *_ORDER.split(", ")], "k")
    k, own = F.col("k"), F.col("l_suppkey") % 3
    value = F.when(own == 0, (k % 2).cast("string")).when(own == 1, F.when(k < 10, (k % 2).cast("string")).otherwise(F.lit("0"))).otherwise(F.col("l_linestatus"))
    grouped = rows.select("l_suppkey", "k", value.alias("v")).groupBy("l_suppkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "v"))), lambda s: s["v"]).alias("l"))
    return grouped.select("l_suppkey", F.size("l").cast("long").alias("n"), A.alternating(F.col("l")).alias("alternating"))


@_query("""WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS first FROM events GROUP BY ALL)
SELECT user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first) AS r FROM c) WHERE r = 1""")
def q_style_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commonest character style of a node's runs, the first seen of equal ones; events stand for runs."""
    return A.majority(_read(spark, sf_dir, "events"), ["user_id"], "event_type", "event_id")


@_query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p_brand AS style_name, CASE WHEN s_acctbal > 0 THEN 'size ' || (s_suppkey % 7) ELSE 'size ' || p_size END AS height, n_name AS align,
 CASE WHEN l_suppkey % 5 = 0 THEN 'char' ELSE '' END AS missing
FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey""")
def q_style_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Style, character and paragraph attributes of nodes; parts stand for styles, suppliers for character entries, nations for paragraph entries."""
    part, supplier, nation = (_read(spark, sf_dir, t) for t in ("part", "supplier", "nation"))
    one = F.lit(1)
    entry = lambda *kv: F.map_filter(F.create_map(*[x for k, v in kv for x in (F.lit(k), v.cast("string"))]), lambda _, v: v.isNotNull())
    styles = part.select(one.alias("doc"), F.concat(F.lit("p"), "p_partkey").alias("id"), entry(("name", F.col("p_brand")), ("char_id", F.concat(F.lit("p"), "p_partkey"))).alias("attrs"))
    chars = part.select(one.alias("doc"), F.concat(F.lit("p"), "p_partkey").alias("id"), entry(("height", F.concat(F.lit("size "), "p_size"))).alias("attrs"))
    known = supplier.where("s_suppkey % 5 <> 0 or s_acctbal > 0")
    chars = chars.unionByName(known.select(one.alias("doc"), F.when(F.col("s_suppkey") % 5 == 0, F.concat(F.lit("x"), "s_suppkey")).otherwise(F.concat(F.lit("s"), "s_suppkey")).alias("id"), entry(("height", F.when(F.col("s_acctbal") > 0, F.concat(F.lit("size "), F.col("s_suppkey") % 7)))).alias("attrs")))
    paras = nation.select(one.alias("doc"), F.col("n_nationkey").cast("string").alias("id"), entry(("align_horizontal", F.col("n_name"))).alias("attrs"))
    lines = _read(spark, sf_dir, "lineitem").join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    nodes = lines.select(one.alias("doc"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("s_acctbal"), F.concat(F.lit("p"), "l_partkey").alias("style_id"), F.col("s_nationkey").cast("string").alias("para_id"), F.concat(F.lit("s"), "l_suppkey").alias("char_id"))
    out = J.cascade(nodes, ["doc"], styles, chars, paras)
    height = F.when((F.col("l_suppkey") % 5 == 0) & (F.col("s_acctbal") > 0), F.concat(F.lit("size "), F.col("l_suppkey") % 7)).otherwise(F.element_at("char", F.lit("height")))
    return out.select("l_orderkey", F.col("l_linenumber"), "l_partkey", "l_suppkey", "style_name", height.alias("height"), F.element_at("para", F.lit("align_horizontal")).alias("align"), F.array_join(F.map_keys("style_missing"), ",").alias("missing"))


@_query("SELECT source, doc_id FROM documents ANTI JOIN labels USING (doc_id)")
def q_missing_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References without an entry; labels stand for style entries."""
    return J.missing_references(_read(spark, sf_dir, "documents").select("source", "doc_id"), _read(spark, sf_dir, "labels"), ["doc_id"])


_GRID = "g AS (SELECT user_id AS t, event_id AS nid, event_id % 17 AS \"row\", event_id % 7 AS col, 1 + event_id % 3 AS row_span, 1 + event_id % 2 AS col_span, event_id % 31 AS height FROM events)"


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return _read(spark, sf_dir, "events").select(F.col("user_id").alias("t"), e.alias("nid"), (e % 17).alias("row"), (e % 7).alias("col"), (1 + e % 3).alias("row_span"), (1 + e % 2).alias("col_span"), (e % 31).alias("height"))


@_query(f"""WITH {_GRID}, p AS (SELECT a.t, a.nid AS header, b.nid AS detail, b.height AS h, row_number() OVER (PARTITION BY a.t, a.nid ORDER BY b."row", b.col, b.nid) AS r FROM g a JOIN g b ON a.t = b.t
 AND b."row" >= a."row" + a.row_span AND a.col <= b.col + b.col_span - 1 AND b.col <= a.col + a.col_span - 1 WHERE a.height > 0 AND a.height <= 10)
SELECT t, header, detail FROM p WHERE r = 1 AND h >= 12""")
def q_overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Low header cells and the high cells under them; events stand for cells."""
    return J.overlapping_below(_grid(spark, sf_dir), ["t"])


@_query("""WITH f AS (SELECT source, doc_id AS id, 'short ' || n_chars AS new_text, 0 AS seq FROM documents UNION ALL SELECT source, doc_id, 'again ' || doc_id, 1 FROM documents WHERE doc_id % 4 = 0),
a AS (SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN 'write' WHEN 1 THEN ' Replace ' WHEN 2 THEN 'keep' END AS action, CASE doc_id % 3 WHEN 0 THEN 'fill' WHEN 1 THEN 'placeholder' ELSE 'instruction' END AS category, quality = 0 AS skip FROM labels)
SELECT f.source, f.id, max_by(f.new_text, f.seq) AS new_text, any_value(a.category) AS category FROM f JOIN a USING (id) WHERE lower(trim(coalesce(a.action, ''))) IN ('', 'write', 'replace') AND a.category IN ('fill', 'placeholder', 'checkbox') AND NOT a.skip GROUP BY f.source, f.id""")
def q_fill_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fills that the analysis lets through; documents stand for nodes, labels for the analysis."""
    docs = _read(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("id"), "n_chars")
    fills = docs.select("source", "id", F.concat(F.lit("short "), "n_chars").alias("new_text"), F.lit(0).alias("seq")).unionByName(docs.where("id % 4 = 0").select("source", "id", F.concat(F.lit("again "), "id").alias("new_text"), F.lit(1).alias("seq")))
    i = F.col("doc_id")
    action = F.when(i % 4 == 0, "write").when(i % 4 == 1, " Replace ").when(i % 4 == 2, "keep")
    category = F.when(i % 3 == 0, "fill").when(i % 3 == 1, "placeholder").otherwise("instruction")
    analysis = _read(spark, sf_dir, "labels").select(i.alias("id"), action.alias("action"), category.alias("category"), (F.col("quality") == 0).alias("skip_fill")).join(docs.select("id", "source"), "id")
    return J.fillable(fills, analysis, ["source"])


@_query("""WITH c AS (SELECT o_custkey AS c, o_orderkey AS g, l_orderkey IS NOT NULL AS there FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 40) ON l_orderkey = o_orderkey)
SELECT c, g // 4 AS g, count(*) AS n_cells FROM c GROUP BY ALL HAVING NOT bool_or(there)""")
def q_orphan_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables with no cell left in the edited page; orders stand for cells, large line items for ids that are there."""
    orders = _read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("k"), F.floor(F.col("o_orderkey") / 4).alias("g"))
    there = _read(spark, sf_dir, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("k")).distinct().join(orders, "k", "inner").select("c", "k")
    return J.orphan_groups(orders, there, ["c"], "g", "k")


_POS = "e AS (SELECT user_id, event_id, CASE WHEN event_id % 5 <> 0 THEN event_id * 37 % 9000 END AS first_pos, CASE WHEN event_id % 7 <> 0 THEN event_id * 37 % 9000 + 500 END AS last_bottom, event_id % 41 = 0 AS forced FROM events)"


def _positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    at = e * 37 % 9000
    return _read(spark, sf_dir, "events").select("user_id", "event_id", F.when(e % 5 != 0, at).alias("first_pos"), F.when(e % 7 != 0, at + 500).alias("last_bottom"), (e % 41 == 0).alias("forced"))


@_query(f"""WITH {_POS}, p AS (SELECT *, last_value(first_pos IGNORE NULLS) OVER w AS pf, last_value(last_bottom IGNORE NULLS) OVER w AS pb, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT user_id, event_id, CAST(sum(CASE WHEN r > 1 AND (coalesce(first_pos < pf - 1000, false) OR coalesce(first_pos <= 1000 AND pb > 2000, false) OR forced) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS page_no FROM p""")
def q_pages_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pagination by position; events stand for a section's children."""
    return S.page_numbers(_positions(spark, sf_dir), ["user_id"], "event_id", forced="forced").select("user_id", "event_id", "page_no")


@_query(f"""WITH RECURSIVE {_CELLS}, rows_ AS (SELECT l_orderkey, k, CASE WHEN k % 3 <> 2 THEN l_extendedprice / 10 END AS pos, k % 6 = 5 AS ask FROM k),
f AS (SELECT l_orderkey, k, CAST(0 AS BIGINT) AS chunk_no, pos AS prev FROM rows_ WHERE k = 0
 UNION ALL SELECT r.l_orderkey, r.k, CASE WHEN r.ask OR coalesce(r.pos < f.prev - 1000, false) THEN f.chunk_no + 1 ELSE f.chunk_no END, CASE WHEN r.ask OR coalesce(r.pos < f.prev - 1000, false) THEN r.pos ELSE coalesce(r.pos, f.prev) END
 FROM f JOIN rows_ r ON r.l_orderkey = f.l_orderkey AND r.k = f.k + 1)
SELECT l_orderkey, k, chunk_no FROM f""")
def q_row_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table's rows split where they fall back; line items stand for rows."""
    k = F.col("k")
    rows = _cells(spark, sf_dir).select("l_orderkey", "k", F.when(k % 3 != 2, F.col("l_extendedprice") / 10).alias("first_pos"), (k % 6 == 5).alias("ask"))
    return S.row_chunks(rows, ["l_orderkey"], "k", forced="ask")


@_query(f"""WITH {_POS}, n AS (SELECT user_id, event_id, lead(first_pos) OVER (PARTITION BY user_id ORDER BY event_id) - last_bottom AS gap, greatest(event_id % 100, 0) AS "start", greatest(coalesce(lead(event_id % 100) OVER (PARTITION BY user_id ORDER BY event_id), 100), 0) AS "end" FROM e)
SELECT user_id, event_id, CASE WHEN gap > 0 THEN gap END AS gap, "start", "end" FROM n""")
def q_gap_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps to the next paragraph and text ranges of lines."""
    gapped = S.gaps(_positions(spark, sf_dir), ["user_id"], "event_id").withColumn("tp", F.col("event_id") % 100)
    return _long(S.text_ranges(gapped, ["user_id"], "event_id", "tp", F.lit(100)), "end").select("user_id", "event_id", "gap", "start", "end")


@_query(_NODES + """, p AS (SELECT doc_id, nid, text = '' AS empty, nid % 10 = 3 AS deleted FROM nodes), s AS (SELECT *, (empty OR deleted) AS h, CASE WHEN (empty OR deleted) IS DISTINCT FROM lag(empty OR deleted) OVER (PARTITION BY doc_id ORDER BY nid) THEN 1 ELSE 0 END AS st FROM p),
r AS (SELECT *, sum(st) OVER (PARTITION BY doc_id ORDER BY nid) AS run FROM s)
SELECT doc_id, nid FROM (SELECT *, bool_or(deleted) OVER (PARTITION BY doc_id, run) AS t FROM r) WHERE h AND t""")
def q_empty_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empty paragraphs that go with a deleted one."""
    marked = _nodes(spark, sf_dir).select("doc_id", "nid", (F.col("text") == "").alias("empty"), (F.col("nid") % 10 == 3).alias("deleted"))
    return S.beside_deleted(marked, ["doc_id"], "nid", "empty", "deleted").where("removed").select("doc_id", "nid")


@_query(f"""WITH {_GRID}, o AS (SELECT t, "row" AS r, col AS c, max(nid) AS nid FROM g GROUP BY ALL), v AS (SELECT DISTINCT t, r, unnest(range(col, col + col_span)) AS c FROM (SELECT t, col, col_span, unnest(range("row", "row" + row_span)) AS r FROM g)),
x AS (SELECT t, max(c) AS m FROM v GROUP BY t), cells AS (SELECT t, r, unnest(range(0, m + 1)) AS c FROM (SELECT DISTINCT t, r FROM o) JOIN x USING (t))
SELECT cells.t, cells.r AS "row", cells.c AS col, CASE WHEN o.nid IS NOT NULL THEN 'origin' WHEN v.t IS NOT NULL THEN 'covered' ELSE 'gap' END AS kind, o.nid FROM cells LEFT JOIN v USING (t, r, c) LEFT JOIN o USING (t, r, c)""")
def q_span_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid of a table with merged cells; events stand for cells."""
    return A.span_cover(_grid(spark, sf_dir), ["t"])


@_query("""WITH top AS (SELECT o_custkey, max(o_orderkey) AS m FROM orders WHERE o_orderkey % 2 = 0 GROUP BY ALL)
SELECT o.o_custkey, o.o_orderkey, coalesce(m, 0) + row_number() OVER (PARTITION BY o.o_custkey ORDER BY o.o_orderkey) AS new_id FROM orders o LEFT JOIN top USING (o_custkey) WHERE o.o_orderkey % 2 = 1""")
def q_id_alloc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fresh ids beyond those in use; even orders stand for ids in use, odd ones for new paragraphs."""
    orders = _read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    return S.allocated(orders.where("o_orderkey % 2 = 1"), orders.where("o_orderkey % 2 = 0"), ["o_custkey"], "o_orderkey", ["o_orderkey"], "new_id")


@_query("""WITH old AS (SELECT p_brand AS b, 'i' || p_partkey AS id, 'f' || (p_partkey // 2) AS href FROM part WHERE p_partkey % 4 = 0),
new AS (SELECT p_brand AS b, 'i' || (p_partkey // 3) AS id, 'f' || p_partkey AS href, p_partkey AS seq FROM part WHERE p_partkey % 4 <> 0),
a AS (SELECT *, row_number() OVER (PARTITION BY b, id ORDER BY seq) AS r FROM new ANTI JOIN old USING (b, id)),
c AS (SELECT *, row_number() OVER (PARTITION BY b, href ORDER BY seq) AS q FROM (SELECT * FROM a WHERE r = 1) ANTI JOIN old USING (b, href))
SELECT b, id, href FROM old UNION ALL SELECT b, id, href FROM c WHERE q = 1""")
def q_manifest_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest rows added where neither id nor path is in use; parts stand for manifest rows, brands for packages."""
    part, k = _read(spark, sf_dir, "part"), F.col("p_partkey")
    name = lambda p, c: F.concat(F.lit(p), c.cast("long").cast("string"))
    old = part.where(k % 4 == 0).select(F.col("p_brand").alias("b"), name("i", k).alias("id"), name("f", F.floor(k / 2)).alias("href"))
    new = part.where(k % 4 != 0).select(F.col("p_brand").alias("b"), name("i", F.floor(k / 3)).alias("id"), name("f", k).alias("href"), k.alias("seq"))
    return J.upserted(old, new, ["b"], ["id", "href"])


@_query("""WITH RECURSIVE m AS (SELECT DISTINCT o_custkey AS c, l_linenumber AS chunk_no, l_suppkey % 5 + 10 * (o_custkey % 3) AS t FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_suppkey % 5 < 3 OR l_linenumber > 3),
e AS (SELECT DISTINCT a.c, a.chunk_no AS x, b.chunk_no AS y FROM m a JOIN m b ON a.c = b.c AND a.t = b.t),
reach AS (SELECT c, x, x AS y FROM e UNION SELECT r.c, r.x, e.y FROM reach r JOIN e ON e.c = r.c AND e.x = r.y)
SELECT c, CAST(x AS BIGINT) AS chunk_no, CAST(min(y) AS BIGINT) AS merged_no FROM reach GROUP BY ALL""")
def q_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks merged that share a table; a customer's line numbers stand for chunks, suppliers for tables."""
    lines = _read(spark, sf_dir, "lineitem").join(_read(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    members = lines.where("l_suppkey % 5 < 3 or l_linenumber > 3").select(F.col("o_custkey").alias("c"), F.col("l_linenumber").alias("chunk_no"), (F.col("l_suppkey") % 5 + 10 * (F.col("o_custkey") % 3)).alias("table_idx"))
    return merge_shared(members, ["c"])


_HEX = "'#' || upper(printf('%06x', p_partkey * 7919 % 16777216))"


@_query(f"""SELECT p_partkey, round(p_retailprice / 7200 * 96, 6) AS px, round(CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_size / 10.0 / 25.4 * 96 END, 6) AS mm_px,
 '#' || substr(h, 6, 2) || substr(h, 4, 2) || substr(h, 2, 2) AS rgb FROM (SELECT *, {_HEX} AS h FROM part)""")
def q_color_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths and colours; prices stand for document units, sizes for tenths of a millimetre, keys for colours."""
    k = F.col("p_partkey")
    hex6 = F.lpad(F.hex(k * 7919 % 16777216), 6, "0")
    mm = F.when(k % 9 == 0, F.lit("unset")).otherwise(F.concat((F.col("p_size") / 10.0).cast("string"), F.lit(" mm")))
    return _read(spark, sf_dir, "part").select("p_partkey", F.round(U.units_to_px(F.col("p_retailprice")), 6).alias("px"), F.round(U.mm_to_px(mm), 6).alias("mm_px"), U.color(F.concat(F.lit("#FF"), hex6), swap=True).alias("rgb"))


@_query("""SELECT p_partkey, CAST(CASE WHEN w <= 0 THEN 30 ELSE greatest(10, least(40, round_even(w / 3.5, 0))) END AS BIGINT) AS max_chars, CAST(CASE WHEN u > 0 THEN round_even(u / 283.465, 0) ELSE 0 END AS BIGINT) AS mm
FROM (SELECT p_partkey, p_size * 3 - 20 AS w, p_partkey * 31 % 20000 - 500 AS u FROM part)""")
def q_clamp_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters that fit a cell and rounding to millimetres."""
    part = _read(spark, sf_dir, "part")
    return _long(part.select("p_partkey", U.max_chars(F.col("p_size") * 3 - 20).alias("max_chars"), U.to_mm(F.col("p_partkey") * 31 % 20000 - 500).alias("mm")), "max_chars", "mm")


@_query(f"""WITH {_CELLS}, s AS (SELECT l_orderkey, k AS seg_no, CAST(l_extendedprice AS BIGINT) AS vertpos, CAST(l_quantity AS BIGINT) AS vertsize FROM k)
SELECT l_orderkey, min_by(vertpos, seg_no) AS first_pos, max_by(vertpos, seg_no) AS last_pos, max_by(vertsize, seg_no) AS last_size, max_by(vertpos + vertsize, seg_no) AS last_bottom, max(vertpos + vertsize) AS max_bottom FROM s GROUP BY ALL""")
def q_bottom_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extents of paragraphs from their lines; line items stand for lines."""
    segments = _cells(spark, sf_dir).select("l_orderkey", F.col("k").alias("seg_no"), F.bround("l_extendedprice").cast("long").alias("vertpos"), F.bround("l_quantity").cast("long").alias("vertsize"))
    return A.extents(segments, ["l_orderkey"])


@_query("""WITH n AS (SELECT source AS s, doc_id AS id, doc_id // 40 AS t FROM documents), marked AS (SELECT s, id FROM n WHERE id % 29 = 0), bare AS (SELECT s, id FROM n SEMI JOIN (SELECT doc_id AS id FROM labels WHERE toxic = 1) USING (id)),
pics AS (SELECT s, id FROM n WHERE id % 2 = 0), ids AS (SELECT s, id FROM marked UNION SELECT s, id FROM bare ANTI JOIN pics USING (s, id)),
tabs AS (SELECT DISTINCT s, t FROM n SEMI JOIN ids USING (s, id) WHERE t % 2 = 0)
SELECT s, id FROM ids UNION SELECT s, id FROM n SEMI JOIN tabs USING (s, t)""")
def q_dedup_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids to delete: marked ones, those without their picture, and whole tables of either."""
    nodes = _read(spark, sf_dir, "documents").select(F.col("source").alias("s"), F.col("doc_id").alias("id"), F.floor(F.col("doc_id") / 40).alias("table_idx"))
    bare = nodes.join(_read(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("id")), "id", "left_semi")
    return J.deletions(nodes.where("id % 29 = 0"), bare, nodes.where("id % 2 = 0"), nodes.where("table_idx % 2 = 0"), ["s"])


@_query("""WITH e AS (SELECT *, row_number() OVER w AS k, lag(event_type) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT event_id, CAST(sum(CASE WHEN k > 1 AND event_type <> before THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS run_no FROM e""")
def q_style_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of equal style; a user's events stand for a paragraph's texts, their types for styles."""
    return S.runs_of_equal(_read(spark, sf_dir, "events"), ["user_id"], "event_id", "event_type").select("event_id", F.col("run_no").cast("long").alias("run_no"))


_SEGMENTS = "SELECT l_orderkey, CAST(l_partkey % 100 AS BIGINT) AS l, CAST(l_suppkey % 50 AS BIGINT) AS t, CAST(l_quantity AS BIGINT) AS w, CAST(l_linenumber AS BIGINT) AS h FROM lineitem"


@_query(f'SELECT l_orderkey, min(l) AS "left", min(t) AS top, max(l + w) AS "right", max(t + h) AS bottom FROM ({_SEGMENTS}) GROUP BY l_orderkey')
def q_bounding_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extents of paragraphs; an order's items stand for lines."""
    i = _read(spark, sf_dir, "lineitem")
    lines = i.select("l_orderkey", (F.col("l_partkey") % 100).alias("left"), (F.col("l_suppkey") % 50).alias("top"), F.col("l_quantity").cast("long").alias("width"), F.col("l_linenumber").cast("long").alias("height"))
    return A.bounding_boxes(lines, ["l_orderkey"])


@_query("""SELECT l_orderkey, bool_and(l_returnflag = 'N') AS borderless, count(DISTINCT l_linestatus) > 1 OR count(DISTINCT CASE WHEN l_returnflag = 'N' THEN 'NONE' ELSE l_returnflag END) > 1 AS separate FROM lineitem GROUP BY l_orderkey""")
def q_border_uniformity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a table's edges are alike; items stand for cells, their flags for kinds of edges."""
    kind = F.when(F.col("l_returnflag") == "N", "NONE").otherwise(F.col("l_returnflag"))
    return A.border_uniformity(_read(spark, sf_dir, "lineitem").withColumns({"border_type": kind, "border_width": F.col("l_linestatus")}), ["l_orderkey"])


@_query("""SELECT p_partkey, CAST(p_size AS DOUBLE) AS top, CAST(CASE WHEN p_partkey % 4 >= 2 THEN p_size + 2 ELSE p_size END AS DOUBLE) AS bottom,
       CASE WHEN p_retailprice > 1000 THEN greatest(0.5, 1000 / p_retailprice) END AS scale, NOT (p_partkey % 3 = 0 AND ((p_size * 3 BETWEEN 1 AND 79) OR (p_size BETWEEN 1 AND 24))) AS room FROM part""")
def q_box_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Padding shorthand of one to four lengths, the factor that fits a table to its page, whether a node has room for a picture."""
    from quiremill.operators.annotate import large_enough

    size = F.col("p_size")
    lengths = F.transform(F.sequence(F.lit(0), (F.col("p_partkey") % 4).cast("int")), lambda k: F.concat((size + k).cast("string"), F.lit("px")))
    pad = U.padding_top_bottom(F.array_join(lengths, " "))
    scale = U.table_scale(F.lit(1000.0), F.col("p_retailprice"))
    return _read(spark, sf_dir, "part").select("p_partkey", pad["top"].alias("top"), pad["bottom"].alias("bottom"), scale.alias("scale"), large_enough(size * 3, size, F.col("p_partkey") % 3 == 0).alias("room"))


@_query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'border-left:' || p_size || 'px; ' ELSE '' END || 'padding:' || p_brand || CASE WHEN p_size % 3 = 0 THEN '; background-color:' || p_type ELSE '' END AS box FROM part""")
def q_box_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries of a style that belong to its box, as text; those without a value go."""
    entry = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    size = F.col("p_size")
    style = F.array(entry("color", F.lit("red")), entry("border-left", F.when(size % 2 == 0, F.concat(size.cast("string"), F.lit("px")))), entry("padding", F.col("p_brand")), entry("font-size", F.col("p_name")), entry("background-color", F.when(size % 3 == 0, F.col("p_type")).otherwise("")))
    return _read(spark, sf_dir, "part").select("p_partkey", U.css(U.box_entries(style)).alias("box"))
