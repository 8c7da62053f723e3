"""How the sources of a language differ in the words they use: relations alone.

Terms (what a regular expression splits each text into) are exploded from every text and counted by (language, source, term) together with the number of documents that hold
them; a language keeps the terms of ``least_docs`` of its documents or more. Each source of the language is crossed with the kept terms, so that terms it
never uses count as 0, and every (source, term) has an exact smoothed share p of ``UNIT``. Pairs of sources meet in a self-join
on language and term, and the absolute differences of their shares are summed; each source's own terms are ranked by how far
their share lies above the language's.

Counting pre-aggregates in each task, so a source, language or word that a third of all rows hold is one row a task. The
crossing is a join on the language; the kept terms are salted over ``SALT`` parts for it, and the sources of a language stand in one row a part.
All later keys hold the term. Nothing is broadcast by hand or collected.

Defined results: null text, language and source are ''; empty texts have no terms, but their (language, source) is a group all
the same; each row is a document, repeated ones too; a language without kept terms has pairs of value 0 and no ``term`` rows; a
language of one source has no ``pair`` rows; ties go to the smaller item by its UTF-8 bytes; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiremill.llm._common import staged

#: What stands between terms: a term is a run of ASCII letters and characters beyond ASCII.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
UNIT, ADDED, SALT = 1_000_000_000, 5, 32


def terms(docs: DataFrame) -> DataFrame:
    """(lang, source, terms) of every document; an empty string among the terms stands for an end of the text that is none."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # splitting between terms takes a ninth of the time that extracting all matches takes, which copies the text at each match
    return docs.select(*_group(), F.split(F.translate(text, _UPPER, _LOWER), BETWEEN).alias("terms"))


def _group() -> list[Column]:
    return [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]


def _share(n: str, total: str, kept: str) -> Column:
    """1 + floor(UNIT * (n + ADDED) / (total + ADDED * kept)) in whole numbers of 38 digits."""
    return F.expr(f"1 + ({UNIT}BD * cast({n} + {ADDED} as decimal(20, 0))) div cast({total} + {ADDED} * {kept} as decimal(20, 0))")


def shares(docs: DataFrame, least_docs: int = 30) -> tuple[DataFrame, DataFrame]:
    """(lang, source) of every group, and (lang, source, term, n, p, q) of every group and kept term; q is the language's own share."""
    groups, of_docs = docs.select(*_group()).distinct(), terms(docs)
    held = of_docs.select("lang", F.explode(F.array_distinct("terms")).alias("term")).where("term != ''").groupBy("lang", "term").agg(F.count("*").alias("docs"))
    known = staged(held.where(F.col("docs") >= least_docs).select("lang", "term"), "divergence-terms")
    used = of_docs.select("lang", "source", F.explode("terms").alias("term")).where("term != ''").groupBy("lang", "source", "term").agg(F.count("*").alias("n"))
    found = staged(used.join(known, ["lang", "term"]).select("lang", "source", "term", "n"), "divergence-counts")
    kept = found.groupBy("lang", "term").agg(F.sum("n").alias("whole"))
    sums = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("whole").alias("lang_total"))
    totals = found.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sources = (
        groups.join(totals, ["lang", "source"], "left").groupBy("lang").agg(F.collect_list(F.struct("source", F.coalesce("total", F.lit(0)).alias("total"))).alias("sources"))
        .join(sums, "lang").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    )
    crossed = kept.withColumn("part", F.pmod(F.hash("term"), F.lit(SALT))).join(sources, ["lang", "part"]).select("lang", "term", "whole", "kept", "lang_total", F.explode("sources").alias("of"))
    dense = crossed.select("lang", "of.source", "term", "whole", "kept", "lang_total", "of.total").join(found, ["lang", "source", "term"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return groups, staged(dense.select("lang", "source", "term", "n", _share("n", "total", "kept").alias("p"), _share("whole", "lang_total", "kept").alias("q")), "divergence-shares")


def pairs(groups: DataFrame, dense: DataFrame) -> DataFrame:
    """(lang, source, item, value): the summed differences of every two sources of a language, both ways."""
    one, two = dense.select("lang", "term", "source", "p"), dense.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("other"))
    apart = one.join(two, ["lang", "term"]).where("source < item").groupBy("lang", "source", "item").agg(F.sum(F.abs(F.col("p") - F.col("other"))).alias("value"))
    both = apart.select("lang", F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("of"), "value").select("lang", "of.*", "value")
    every = groups.join(groups.withColumnRenamed("source", "item"), "lang").where("source != item")
    return every.join(both, ["lang", "source", "item"], "left").withColumn("value", F.coalesce("value", F.lit(0)).cast("long"))


def audited(docs: DataFrame, least_docs: int = 30, most_terms: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank): other sources by distance, and the terms a source uses above its language."""
    groups, dense = shares(docs, least_docs)
    own = dense.where("n > 0 and p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    of_terms = own.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most_terms)
    of_pairs = pairs(groups, dense).select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(order))
    return of_pairs.unionByName(of_terms)


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS text FROM documents),
t AS (SELECT k, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT k) >= 30),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY ALL),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
gs AS (SELECT lang, source, coalesce((SELECT sum(n) FROM c WHERE c.lang = g.lang AND c.source = g.source), 0) AS total FROM g),
p AS (SELECT gs.lang, gs.source, kept.term, coalesce(c.n, 0) AS n,
             1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (gs.total + 5 * v.v) AS p
      FROM gs JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = gs.lang AND c.source = gs.source AND c.term = kept.term),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (w + 5)) // (sum(w) OVER (PARTITION BY lang) + 5 * count(*) OVER (PARTITION BY lang)) AS q
      FROM (SELECT lang, term, sum(n) AS w FROM c GROUP BY ALL)),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce((SELECT sum(abs(x.p - y.p)) FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term
                WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS value
         FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
term AS (SELECT p.lang, p.source, p.term AS item, p.p - q.q AS value FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q)
SELECT lang, source, 'pair' AS part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM pair
UNION ALL
SELECT * FROM (SELECT lang, source, 'term', item, value::BIGINT, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM term) WHERE rank <= 50
"""
