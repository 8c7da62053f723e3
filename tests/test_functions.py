import html

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quiremill.functions import text as X
from quiremill.functions import units as U
from quiremill.sources.html import _page_texts, _Trace


def one(spark, column, **values):
    kinds = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double' if isinstance(v, float) else 'bigint'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], kinds).select(column.alias("x")).first().x


@pytest.mark.parametrize("raw", ["  a \t", " x　", "\x1cy\x85", "", "a b"])
def test_strip_is_pythons(spark, raw):
    assert one(spark, X.strip(F.col("a")), a=raw) == raw.strip()


def test_markers(spark):
    text = "a [IMAGE: p | c | 4:3]  b [IMAGE]"
    assert one(spark, X.without_markers(F.col("a")), a=text) == "a b"
    assert [tuple(m) for m in one(spark, X.markers(F.col("a")), a=text)] == [("p", "c", "4:3"), ("", "", "")]


@pytest.mark.parametrize(("old", "new", "want"), [("[  ] a [  ]", "yes", "[✓] a [✓]"), ("[  ]", "[x]", "[x]"), ("plain", "yes", "yes")])
def test_checkbox(spark, old, new, want):
    assert one(spark, X.checkbox(F.col("a"), F.col("b")), a=old, b=new) == want


def test_patch_and_edit_texts(spark):
    assert one(spark, X.normalize_patch(F.col("a")), a=" <p>a<BR/>b &amp; c</p> ") == "a\nb & c"
    assert one(spark, X.normalize_patch(F.col("a")), a="1 < 2") == "1 < 2"
    assert one(spark, X.normalize_edit(F.col("a")), a="a \t b\n\n\nc&lt;") == "a b\nc<"
    assert one(spark, X.escape_html(F.col("a"), quotes=True), a="<'\"&>") == html.escape("<'\"&>")


def test_names(spark):
    assert one(spark, X.safe_name(F.col("a"), "file", ".hwpx"), a=" 보고서 v1 ") == "v1.hwpx"
    assert one(spark, X.safe_name(F.col("a"), "file", ".hwpx"), a="??") == "file.hwpx"
    assert one(spark, X.name_from_url(F.col("a"), "file", ".hwpx"), a="https://h/x/a%20b.HWPX?q=1") == "a_20b.HWPX"


@pytest.mark.parametrize("value", [0.125, 2.675, 1.005, 1234.565, 0.0, 99.995, 793.7066666, -1.255, 1023.995, 1024.005, 81234.125])
def test_px_rounds_as_printf(spark, value):
    assert one(spark, U.px(F.col("a")), a=value) == f"{value:.2f}px"


def test_units_and_colours(spark):
    assert one(spark, U.units_to_px(F.col("a")), a="4294967295") is None and one(spark, U.units_to_px(F.col("a")), a="x") is None
    assert one(spark, U.px(U.units_to_px(F.col("a"))), a="7200") == "96.00px"
    assert one(spark, U.px(U.mm_to_px(F.col("a"))), a="25.4 mm") == "96.00px"
    assert one(spark, U.color(F.col("a"), swap=True), a="#FF112233") == "#332211"
    assert one(spark, U.visible_fill(F.col("a")), a="#FFFFFFFF") is None
    assert [one(spark, U.points(F.col("a")), a=h) for h in ("1000", "1050", "x")] == ["10pt", "10.5pt", None]
    assert tuple(one(spark, U.padding_top_bottom(F.col("a")), a="1px 2px 3px 4px")) == (1.0, 3.0)
    assert one(spark, U.edge(F.col("a"), F.lit(None), F.lit("#111")), a="DASHED") == "1px dashed #111"
    assert [one(spark, U.max_chars(F.col("a")), a=w) for w in (0, 10, 70, 500)] == [30, 10, 20, 40]
    assert [one(spark, U.to_mm(F.col("a")), a=u) for u in (-5, 850, 993)] == [0, 3, 4]
    assert one(spark, U.table_scale(F.col("a"), F.col("b")), a=10.0, b=100.0) == 0.5


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["<div class='page'>", "</div>", "<p>", "</p>", "x", "<br>", "&amp;", "<div>"]), max_size=20))
def test_pages_are_whole(parts):
    p = _Trace(False)
    p.feed("".join(parts))
    p.close()
    assert all(x.startswith('<div class="page">') and x.endswith(("</div>", "</p>")) for x in _page_texts(p.trace))
