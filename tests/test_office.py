"""Packages, nodes, styles, tables, chunks, changes and pages, with results worked out by hand."""

import json
import re

import pytest
from pyspark.sql import functions as F

from quiremill.operators import annotate, mutate, nodes as nd, render, styles
from quiremill.plans import office
from quiremill.sources import html, package as pk, xml
from tests.packages import HEADER, PAGE, frame, p, package, run, section, t, tbl, tc, unzipped

GRID = tbl(tc(0, 0, p(run(t("Name")))) + tc(0, 1, p(run(t("")))), tc(1, 0, p(run(t("Dept")))) + tc(1, 1, p(run(t("x")))))


def opened(spark, *sections, more=()):
    return office.Package(pk.entries(frame(spark, package(*sections, more=more))))


def node_rows(pkg, styled=True):
    return sorted(pkg.nodes(styled).collect(), key=lambda r: (r.section_no, r.nid))


def test_sections_are_in_the_order_of_their_numbers(spark):
    pkg = opened(spark, *(section(p(run(t(f"s{k}")))) for k in range(11)))
    assert [r.entry for r in pkg.sections.orderBy("section_no").collect()] == [f"Contents/section{k}.xml" for k in range(11)]
    assert [(r.text, r.gid) for r in node_rows(pkg)] == [(f"s{k}", k) for k in range(11)]


def test_sections_outside_the_contents_folder_count_only_without_one(spark):
    rows = [("a", 0, "x/section1.xml", 8, b""), ("a", 1, "y/Section0.XML", 8, b""), ("b", 0, "CONTENTS/section1.xml", 8, b""), ("b", 1, "z/section0.xml", 8, b"")]
    found = pk.sections(spark.createDataFrame(rows, pk.ENTRIES)).select("doc_id", "section_no", "entry").collect()
    assert sorted(map(tuple, found)) == [("a", 0, "y/Section0.XML"), ("a", 1, "x/section1.xml"), ("b", 0, "CONTENTS/section1.xml")]


def test_node_numbers_types_and_depth(spark):
    rows = node_rows(opened(spark, section(p(run(t("  1. Overview"))), p(run(GRID)), "<hp:p id='1'/>")))
    assert [(r.nid, r.type, r.text, r.table_idx, r.row, r.col) for r in rows] == [
        (0, "body_text", "1. Overview", -1, -1, -1), (1, "table_cell", "Name", 0, 0, 0), (2, "table_cell", "", 0, 0, 1), (3, "table_cell", "Dept", 0, 1, 0), (4, "table_cell", "x", 0, 1, 1), (5, "body_text", "", -1, -1, -1),
    ]
    assert rows[0].depth == 1 and rows[0].raw_text == "  1. Overview" and not rows[0].skip_fill
    assert rows[5].depth == 0 and rows[5].skip_fill and not rows[2].skip_fill


def test_spacers_by_height_and_width(spark):
    cells = [tc(0, k, p(run(t(" "))), w=w, h=h) for k, (w, h) in enumerate([(0, 850), (0, 993), (2409, 0), (2410, 0)])]
    rows = node_rows(opened(spark, section(p(run(tbl("".join(cells)))))))
    assert [r.skip_fill for r in rows[:4]] == [True, False, True, False]


def test_styles_cascade_and_majority(spark):
    body = p(run(t("a"), char="9"), run(t("b"), char="7"), run(t("c"), char="7"), run(t("d"), char="9"))
    row = node_rows(opened(spark, section(body)))[0]
    assert row.style_refs.char_id == "9" and row.style_name == "Body" and row.char["height"] == "950"
    assert row.style_summary == "S:style=Body,size=950,bold,color=#000000,align=LEFT" and row.style_missing == {}
    other = node_rows(opened(spark, section(p(run(t("a"), char="77"), para="88", style="99"))))[0]
    assert other.style_missing == {"style": "99", "para": "88", "char": "77"} and other.style_summary == ""


def test_header_checks_and_css(spark):
    pkg = opened(spark, section(p()))
    assert [(r.id, r.kind, r.value) for r in styles.char_warnings(pkg.header).collect()] == [("9", "spacing", "-5")]
    assert styles.centre_paragraph(pkg.header).first().id == "2"
    css = {r.id: {e.key: e.value for e in r.css} for r in styles.char_css(pkg.header).collect()}
    assert css["1"] == {"font-size": "10pt", "color": "#332211", "font-family": "'Batang'"}
    assert css["9"] == {"font-size": "9.5pt", "color": "#000000", "font-weight": "700", "text-decoration-line": "underline", "text-decoration-color": "#FF0000", "text-decoration-style": "dashed"}
    para = {r.id: {e.key: e.value for e in r.css} for r in styles.para_css(pkg.header).collect()}
    assert para == {"1": {"text-align": "left", "line-height": "160%"}, "2": {"text-align": "center"}}
    fill = {r.id: r for r in styles.border_fills(pkg.header).collect()}["1"]
    assert (fill.left.type, fill.left.width, fill.left.color, fill.fill) == ("SOLID", "0.45px", "#FF0000", "#0000FF")


def test_table_summary(spark):
    rows = [tc(k, 0, p(run(t(f"h{k}"))), cs=2 if k == 1 else 1) for k in range(3)]
    rows.append("".join(tc(3, k, p(run(t(x))), w=w, border=b) for k, (x, w, b) in enumerate([("a", 0, "1"), (" ", 2835, "2"), ("b", 5669, "1")])))
    s = nd.summaries(opened(spark, section(p(run(tbl(*rows, attrs='rowCnt="4" colCnt="3"'))))).elems).withColumn("line", nd.summary_text()).first()
    assert s.header_texts == ["h0", "h1(2열병합)", "h2"] and s.min_width_mm == 10.0 and abs(s.empty_ratio - 1 / 3) < 1e-9 and not s.border_alternating
    assert (s.row_count, s.col_count, s.outer_idx) == (4, 3, 0) and s.line.startswith("[table 0] 4x3")


def chunk_lists(spark, nodes, most):
    df = spark.createDataFrame([("d", 0, n, ti, r) for n, ti, r in nodes], "doc_id string, section_no int, nid long, table_idx long, row long")
    found = nd.chunks(df, most).collect()
    out = {}
    for r in sorted(found, key=lambda r: r.nid):
        out.setdefault(r.chunk_no, []).append(r.nid)
    return [out[k] for k in sorted(out)]


def test_greedy_chunks_keep_tables_whole_or_split_them_by_rows(spark):
    assert chunk_lists(spark, [(0, -1, -1), (1, -1, -1), (2, 0, 0), (3, 0, 0), (4, 0, 1), (5, -1, -1), (6, -1, -1)], 4) == [[0, 1], [2, 3, 4, 5], [6]]
    assert chunk_lists(spark, [(0, 0, 0), (1, 0, 0), (2, 0, 1), (3, 0, 1), (4, 0, 2)], 4) == [[0, 1, 2, 3], [4]]
    assert chunk_lists(spark, [(0, -1, -1), (1, 0, 0), (2, 0, 0), (3, 1, 0), (4, 1, 0), (5, -1, -1)], 2) == [[0], [1, 2], [3, 4], [5]]


@pytest.mark.parametrize(("plan", "kinds"), [([[0, 1], [2]], set()), ([[0, 1, 1], [2]], {"duplicate"}), ([[0, 1, 7], [2]], {"unknown"}), ([[0, 1]], {"missing"}), ([[0, 1], [], [2]], {"no node_ids"})])
def test_plans(spark, plan, kinds):
    nodes = spark.createDataFrame([("d", 0, n, -1) for n in range(3)], "doc_id string, section_no int, nid long, table_idx long")
    rows = spark.createDataFrame([("d", 0, k, ids) for k, ids in enumerate(plan)], "doc_id string, section_no int, chunk_id int, node_ids array<long>")
    good, errors = nd.planned_chunks(nodes, rows)
    assert {r.kind for r in errors.collect()} == kinds and bool(good.count()) == (not kinds)


def test_chunks_that_share_a_table_are_one(spark):
    rows = [("d", 0, 0, 0), ("d", 0, 1, 1), ("d", 0, 2, 0), ("d", 0, 2, 1), ("d", 0, 3, -1)]
    df = spark.createDataFrame([(*r[:2], k, r[2], r[3]) for k, r in enumerate(rows)], "doc_id string, section_no int, nid long, chunk_no long, table_idx long")
    assert sorted((r.nid, r.chunk_no) for r in nd.merged_chunks(df).collect()) == [(0, 0), (1, 0), (2, 0), (3, 0), (4, 3)]


def test_header_and_detail_cells(spark):
    def pairs(rows):
        from quiremill.operators.joins import overlapping_below

        return [tuple(r) for r in overlapping_below(spark.createDataFrame(rows, "t int, nid int, row int, col int, row_span int, col_span int, height int"), ["t"]).collect()]

    assert pairs([(0, 1, 0, 0, 1, 2, 8), (0, 2, 1, 1, 1, 1, 20)]) == [(0, 1, 2)]
    assert pairs([(0, 1, 0, 0, 1, 2, 8), (0, 2, 1, 1, 1, 1, 11), (0, 3, 2, 1, 1, 1, 20)]) == []


def test_fills_deletions_and_round_trip(spark):
    text = section(p(run(t("  old"), t("more")), lines=[(0, 0, 1000)]), p(), p(run(t("drop me"))), p(run(t(" "))), p(run()), p(run(t("[  ] yes"))), p(run(GRID)))
    pkg = opened(spark, text)
    table = pkg.nodes()
    fills = spark.createDataFrame([("doc0", 0, 0, "new"), ("doc0", 0, 3, "fresh"), ("doc0", 0, 4, "ok")], "doc_id string, section_no int, nid long, new_text string")
    out = mutate.filled(pkg.elems, table, fills)
    out = mutate.deleted_paragraphs(out, mutate.node_paragraphs(table, spark.createDataFrame([("doc0", 0, 1)], "doc_id string, section_no int, nid long")))
    out = mutate.deleted_tables(out, spark.createDataFrame([("doc0", 0, 0)], "doc_id string, section_no int, table_idx long"))
    body = unzipped(bytes(pkg.repacked(out).first().content))["Contents/section0.xml"].decode()
    assert body.startswith(xml.DECLARATION)
    assert re.findall(r"<hp:t>(.*?)</hp:t>", body) == ["  new", "fresh", "[✓] yes"]
    assert "linesegarray" not in body and "tbl" not in body and "drop me" not in body
    assert body.count("<hp:p ") == 4  # the two empty ones beside the deleted paragraph are gone


def test_untouched_packages_come_back_the_same(spark):
    content = package(section(p(run(t("a &amp; b <hp:tab/>tail")), lines=[(0, 0, 900)]), p(run(GRID))), more=[("BinData/a.png", b"1"), ("BinData/design.png", b"2"), ("META-INF/signatures.xml", b"3")])
    pkg = office.Package(pk.entries(frame(spark, content)))
    back, old = unzipped(bytes(pkg.repacked(pkg.elems).first().content)), unzipped(content)
    assert list(back) == [n for n in old if n not in ("BinData/design.png", "META-INF/signatures.xml")]
    section_text = old["Contents/section0.xml"].decode().split("?>", 1)[1]
    assert back["Contents/section0.xml"].decode() == xml.DECLARATION + re.sub(r"<([\w:]+)([^<>]*)></\1>", r"<\1\2/>", section_text)
    assert back["Contents/header.xml"] == old["Contents/header.xml"]


@pytest.mark.parametrize(("text", "compat", "edits"), [
    ('<td data-id="1">a<br>b</td>tail', True, {1: "a\nbtail"}), ('<td data-id="1">a<br>b</td>tail', False, {1: "a\nb"}), ('<p data-id="2"></p>', False, {2: None}), ('<p data-id="3">&nbsp;</p>', False, {3: ""}),
    ('<p data-id="4">&amp;lt;</p>', False, {4: "<"}), ('<p data-id="x">a</p><p data-id=" 5 ">a  b<br/><br/>c</p>', False, {5: "a b\nc"}),
])
def test_edited_html(spark, text, compat, edits):
    df = spark.createDataFrame([("d", text)], "doc_id string, html string")
    assert {r.id: r.new_text for r in html.edits(df, ["doc_id"], compat=compat).collect()} == edits


def test_html_pages(spark):
    text = '<body><div class="a page" title=\'q"\'>x<br>&amp;<!-- no --><div>in</div><img src="i"/></div>y<div class="pager">z</div><div class="page">2</div>'
    df = spark.createDataFrame([("d", text), ("e", "none")], "doc_id string, html string")
    found = {(r.doc_id, r.page_no): r.page for r in html.pages(df, ["doc_id"]).collect()}
    assert found == {("d", 1): '<div class="a page" title="q&quot;">x<br>&amp;<div>in</div><img src="i" /></div>', ("d", 2): '<div class="page">2</div>'}
    assert {r.doc_id: bool(r.page) for r in html.first_page(df, ["doc_id"]).collect()} == {"d": True, "e": False}
    assert html.page(df.where("doc_id = 'd'"), ["doc_id"], 2).first().page == '<div class="page">2</div>'
    with pytest.raises(Exception, match="beyond the last page"):
        html.page(df, ["doc_id"], 2).collect()


def test_pages_break_where_positions_fall_back(spark):
    from quiremill.operators.sequence import page_numbers

    rows = [(0, 1500), (2000, 3000), (500, 1800), (None, None), (1400, 2500), (900, 1200)]
    df = spark.createDataFrame([(1, k, a, b) for k, (a, b) in enumerate(rows)], "d int, k int, first_pos long, last_bottom long")
    assert [r.page_no for r in page_numbers(df, ["d"], "k").orderBy("k").collect()] == [0, 0, 1, 1, 1, 2]


def test_rendered_html_and_merge_of_edits(spark):
    two = section(p(run(PAGE), run(t("first ")), lines=[(0, 0, 1000)]), p(run(GRID)), p(run(t("second &lt;"), char="9"), lines=[(0, 40000, 1000)]), p(run(t("next page")), lines=[(0, 0, 1000)]))
    pkg_rows = pk.entries(frame(spark, package(two)))
    doc = office.to_html(pkg_rows).first().html
    pages = re.findall(r'<div class="page".*?(?=<div class="page"|</body>)', doc, re.S)
    assert len(pages) == 2 and "width:793.71px" in pages[0]
    assert 'data-id="0"' in pages[0] and "first&nbsp;" in pages[0] and '<td data-id="1"' in pages[0] and "second &lt;" in pages[0] and "font-weight:700" in pages[0]
    assert "next page" in pages[1]
    assert '<div class="line"' in office.to_html(pkg_rows, lines=True).first().html
    edited = doc.replace("first&nbsp;", "1st").replace("Dept", "Team")
    saved = office.save_from_html(pkg_rows, spark.createDataFrame([("doc0", edited)], "doc_id string, html string"))
    body = unzipped(bytes(saved.first().content))["Contents/section0.xml"].decode()
    assert re.findall(r"<hp:t>(.*?)</hp:t>", body)[:5] == ["1st", "Name", "Team", "x", "second &lt;"]
    gone = re.sub(r"<table.*?</table>", "", edited, flags=re.S)
    saved = office.save_from_html(pkg_rows, spark.createDataFrame([("doc0", gone)], "doc_id string, html string"))
    assert "tbl" not in unzipped(bytes(saved.first().content))["Contents/section0.xml"].decode()
    with pytest.raises(Exception, match="no ids"):
        office.save_from_html(pkg_rows, spark.createDataFrame([("doc0", "<p>x</p>")], "doc_id string, html string")).collect()


def test_direct_tables_split_over_pages(spark):
    rows = [tc(k, 0, p(run(t(f"r{k}")), lines=[(0, pos, 500)])) for k, pos in enumerate([0, 5000, 100, 6000])]
    pkg = opened(spark, section(p(run(t("before")), lines=[(0, 0, 500)]), tbl(*rows), p(run(t("after")), lines=[(0, 7000, 500)])))
    pages = [r.html for r in render.pages(pkg.elems, pkg.header).orderBy("page_no").collect()]
    assert [re.findall(r"before|r\d|after", x) for x in pages] == [["before"], ["r0", "r1"], ["r2", "r3"], ["after"]]


def test_generate(spark):
    content = package(section(p(run(t("Title [  ]"))), p(run(t("(write here)"))), p(run(GRID)), p(run(t("picture place"))), p(run(t("no picture")))))
    rows = pk.entries(frame(spark, content))
    notes = {"tables_to_remove": [], "nodes": [{"id": 0, "category": "checkbox", "action": "write"}, {"id": 1, "category": "instruction", "delete": True}, {"id": 3, "category": "fill", "skip_fill": True}, {"id": 5, "category": "fill"}, {"id": 7, "category": "placeholder"}, {"id": 8, "category": "x", "delete_if_no_image": True}, {"id": 2, "category": "fill", "skip_fill": "false"}]}
    fills = {"fills": [{"id": 0, "new_text": "done"}, {"id": 3, "new_text": "no"}, {"id": 5, "new_text": "  Q1  "}, {"id": 7, "new_text": "see [IMAGE: plan | fig 1 | 4:3]"}, {"id": 2, "new_text": "Ann"}]}
    answers = lambda x: annotate.Recorded(spark.createDataFrame([("doc0", 0, 0, json.dumps(x))], "doc_id string, section_no int, chunk_no long, answer string"))
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (100).to_bytes(4, "big") + (50).to_bytes(4, "big")
    pictures = spark.createDataFrame([("doc0", 0, 7, 0, bytearray(png))], "doc_id string, section_no int, nid long, seq long, body binary")
    out = unzipped(bytes(office.generate(rows, answers(notes), answers(fills), "topic", pictures=pictures).first().content))
    body = out["Contents/section0.xml"].decode()
    texts = re.findall(r"<hp:t>(.*?)</hp:t>", body)
    assert texts[0] == "Title [✓]" and "(write here)" not in body and "no picture" not in body and "Ann" in texts and "no" not in texts
    assert 'binaryItemIDRef="image1"' in body and 'width="2400"' in body and 'height="1800"' in body and "fig 1" in texts and body.index("see") < body.index("hp:pic")
    assert out["BinData/image1.png"] == png and b'href="BinData/image1.png"' in out["Contents/content.hpf"] and b'full-path="BinData/image1.png"' in out["META-INF/manifest.xml"]
    assert 'paraPrIDRef="2"' in body and 'id="8"' in body


def test_edit_page(spark):
    rows = pk.entries(frame(spark, package(section(p(run(tbl(tc(0, 0, p(run(t("Dept")))) + tc(0, 1, p(run(t("x")))), tc(1, 0, p(run(t("Dept")))) + tc(1, 1, p(run(t("y"))))))), p(run(t("end")))))))
    answer = json.dumps({"edits": [{"label": " Dept ", "new_text": "<b>A</b>"}, {"id": 2, "new_text": "moved"}, {"id": 5, "new_text": "b<br>c"}, {"id": 99, "new_text": "off"}, {"id": 5}]})
    pages, edits = office.edit_page(rows, 1, spark.createDataFrame([("doc0", answer)], "doc_id string, answer string"))
    assert pages.first().page.startswith('<div class="page"')
    assert sorted((r.seq, r.target, r.new_text) for r in edits.collect()) == [(0, 3, "A"), (1, 3, "moved"), (2, 5, "b\nc")]


def test_files_stream_and_settings(spark, tmp_path):
    from quiremill.streaming import ingest

    made = pk.write(frame(spark, package(section(p(run(t("a")))))).withColumnRenamed("path", "doc_id"), str(tmp_path / "in"), F.concat("doc_id", F.lit(".hwpx")))
    assert made.count() == 1
    assert pk.read(spark, str(tmp_path / "in")).count() == 5
    ingest.keep_entries(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5
    o = office.Options.from_environment({"QUIREMILL_PICTURES": "No", "QUIREMILL_MOST_NODES": "7", "QUIREMILL_CALLS": "many"})
    assert (o.pictures, o.most_nodes, o.calls) == (False, 7, 4)


def test_nodes_as_html(spark):
    rows = render.nodes_html(opened(spark, section(p(run(t("a&lt;b"))), p(run(tbl(tc(0, 0, p(run(t("w"))), cs=2), tc(1, 1, p(run(t("v"))))))))).nodes())
    text = rows.first().html
    assert text.startswith('<p data-id="0" data-depth="0"') and "a&lt;b</p>" in text
    assert re.findall(r'<td data-id="(\d*)"', text) == ["1", "", "2"] and 'colspan="2"' in text and 'data-size="100x20mm"' in text
    assert HEADER.startswith("<?xml")
