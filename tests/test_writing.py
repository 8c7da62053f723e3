"""XML written from sorted fragments, against a plain recursive writer."""

import random
from xml.sax.saxutils import escape, quoteattr

import pytest
from pyspark.sql import functions as F

from quiremill.operators import render
from quiremill.plans import office
from quiremill.sources import package as pk
from quiremill.sources import xml
from tests import plain_html
from tests.packages import PAGE, frame, p, package, run, section, t, tbl, tc


def plain(rows):
    """XML of parsed rows, by recursion."""
    kids = {}
    for r in rows:
        kids.setdefault(r["parent_pos"], []).append(r)

    def one(r):
        name = f"{r['prefix']}:{r['tag']}" if r["prefix"] else r["tag"]
        start = name + "".join(f" {a['key']}={quoteattr(a['value'])}" for a in r["attrs"])
        inner = escape(r["text"] or "") + "".join(map(one, kids.get(r["pos"], [])))
        return (f"<{start}>{inner}</{name}>" if inner or kids.get(r["pos"]) else f"<{start}/>") + escape(r["tail"] or "")

    return xml.DECLARATION + one(rows[0]).removesuffix(escape(rows[0]["tail"] or ""))



@pytest.mark.parametrize("part", [50_000, 1, 7])
def test_written_is_what_a_plain_writer_makes(spark, monkeypatch, part):
    monkeypatch.setattr(xml, "FRAGMENT", part)
    monkeypatch.setattr(xml, "FLUSH", 1 << 20 if part > 7 else 10)
    r, rows = random.Random(part), []
    for k in range(12):
        kids = []
        for _ in range(r.randint(0, 30) if k else 0):
            tag, size = r.choice("pqr"), r.randint(0, 4)
            kids.append(f'<x:{tag} i="{r.randint(0, 9)}">' + r.choice(("", "t&amp;")) + "".join(f"<y><z>{r.choice(('', 'v'))}</z>w</y>" for _ in range(size)) + f"</x:{tag}>" + r.choice(("", "tail")))
        rows.append((f"d{k}", f"e{k % 3}", (f'<x:root xmlns:x="u" a="1">{r.choice(("", "text"))}' + "".join(kids) + "</x:root>").encode()))
    entries = spark.createDataFrame(rows, "doc_id string, entry string, body binary")
    out = {(x.doc_id, x.entry): bytes(x.body).decode() for x in xml.written(xml.elements(entries)).collect()}
    assert out == {(d, e): plain(xml.parse(b)) for d, e, b in rows}


def test_a_section_is_written_in_many_fragments(spark):
    n = 120_000
    kids = spark.range(n).select(F.lit("d").alias("doc_id"), F.lit("e").alias("entry"), (F.col("id") + 1).cast("int").alias("pos"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") - F.col("id") % 3 + 1).cast("int").alias("parent_pos"), F.lit("p").alias("tag"), F.lit("").alias("prefix"), F.array(F.struct(F.lit("i").alias("key"), F.col("id").cast("string").alias("value"))).alias("attrs"), F.lit("x").alias("text"), F.lit(None).cast("string").alias("tail"), (F.col("id") - F.col("id") % 3 + 1).cast("int").alias("top_pos"))
    root = spark.createDataFrame([("d", "e", 0, None, "r", "", [], "", None, None)], "doc_id string, entry string, pos int, parent_pos int, tag string, prefix string, attrs array<struct<key:string,value:string>>, text string, tail string, top_pos int")
    elems = kids.unionByName(root)
    pieces = xml.fragments(elems).groupBy("part").count().collect()
    assert sorted(x.part for x in pieces) == [-1, 0, 1, 2, xml._LAST]
    want = "".join(f'<p i="{k}">x<p i="{k + 1}">x</p><p i="{k + 2}">x</p></p>' for k in range(0, n, 3))
    assert bytes(xml.written(elems).first().body).decode() == f"{xml.DECLARATION}<r>{want}</r>"


def test_new_elements_need_their_place(spark):
    bad = spark.createDataFrame([("d", "e", 0, None, None), ("d", "e", 1, 0, None)], "doc_id string, entry string, pos int, parent_pos int, top_pos int")
    bad = bad.selectExpr("*", "'p' as tag", "'' as prefix", "cast(array() as array<struct<key:string,value:string>>) as attrs", "'' as text", "'' as tail")
    with pytest.raises(Exception, match="without its root's child"):
        xml.written(bad).collect()


def random_section(r):
    """Paragraphs of runs, some laid out in lines, and tables in tables in tables; some of it where nothing is written."""

    def text():
        return t(r.choice(("a", "  b ", 'x &lt; y "q"', "", " ", "line\nbreak", "é 漢字", "long text of words here")))

    def lines():
        k = r.randint(0, 3)
        return [(r.randint(0, 12), 2000 * i, r.choice((900, 1000))) for i in range(k)] if r.random() < 0.3 else [(5 * i, 1500 * i, 1000) for i in range(k)]

    def paragraph(depth):
        runs = [run(*(text() for _ in range(r.randint(0, 3))), char=r.choice(("1", "9", "7", "77"))) for _ in range(r.randint(0, 3))]
        if depth and r.random() < 0.5:
            runs.insert(r.randint(0, len(runs)), run(table(depth - 1)))
        return p(*runs, lines=lines(), para=r.choice(("1", "2", "0")), style=r.choice(("1", "0")))

    def table(depth):
        rows = ["".join(tc(i, k, "".join(paragraph(depth) for _ in range(r.randint(0, 2))), w=r.choice((0, 2835, 5669)), border=r.choice(("1", "2")), cs=r.choice((1, 1, 2))) for k in range(r.randint(1, 2))) for i in range(r.randint(1, 3))]
        return tbl(*rows, attrs=r.choice(('borderFillIDRef="1"', 'borderFillIDRef="2" cellSpacing="20"', "")))

    # a table over three pages, and one too high for its page
    split = tbl(*(tc(k, 0, p(run(t(f"row {k}")), lines=[(0, v, 1000)])) for k, v in enumerate((1000, 60000, 500, 70000, 300))))
    high = tbl(tc(0, 0, p(run(t("top")), lines=[(0, 0, 1000)]), p(run(t("end")), lines=[(0, 90000, 1000)])))
    some = [paragraph(2) if r.random() < 0.8 else table(2) for _ in range(6)]
    return section(p(run(PAGE), run(t("first ")), lines=[(0, 0, 1000)]), *some, split, p(run(t("between"))), high, "<hp:ctrl><hp:p><hp:run><hp:t>hidden</hp:t></hp:run></hp:p></hp:ctrl>")


@pytest.mark.parametrize("lines", [False, True])
def test_pages_are_what_a_plain_writer_makes(spark, lines):
    r = random.Random(11)
    pkg = office.Package(pk.entries(frame(spark, package(*(random_section(r) for _ in range(8))))))
    nodes = pkg.nodes(styles=False)
    got = {(x.section_no, x.page_no): x.html for x in render.pages(pkg.elems, pkg.header, nodes, lines).collect()}
    want = plain_html.pages(pkg.elems, pkg.header, nodes, lines)
    assert got == want and any("scaleY" in x for x in want.values()) and max(x.count("<table") for x in want.values()) > 3
    assert any('class="line"' in x for x in want.values()) == lines and len(want) > 8 * 3
