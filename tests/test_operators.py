"""Operators that no query over the provided tables shows by itself."""

import pytest
from pyspark.sql import functions as F

from quiremill.operators import aggregate as A
from quiremill.operators import joins as J
from quiremill.operators import sequence as S
from quiremill.operators.annotate import large_enough
from quiremill.operators.mutate import picture_geometry
from quiremill.plans import office
from quiremill.sources import package as pk
from tests.packages import frame, p, package, run, section, t


def test_packages_without_sections_are_an_error(spark):
    rows = spark.createDataFrame([("a", 0, "Contents/x.xml", 8, b"")], pk.ENTRIES)
    assert pk.sections(rows).count() == 0
    with pytest.raises(Exception, match="no section in a"):
        pk.sections(rows, required=True).collect()


def test_pictures_of_a_package(spark):
    names = ["BinData/B.PNG", "BinData/a.jpg", "BinData/note.txt", "x/c.png", "BinData/image7.gif"]
    rows = spark.createDataFrame([("a", k, n, 8, b"") for k, n in enumerate(names)] + [("b", 0, "x", 8, b"")], pk.ENTRIES)
    assert [r.entry for r in pk.pictures(rows).orderBy("picture_no").collect()] == ["BinData/a.jpg", "BinData/B.PNG", "BinData/image7.gif"]
    assert {r.doc_id: r.n for r in pk.picture_counts(rows).collect()} == {"a": 3, "b": 0}
    assert {r.doc_id: r.next_no for r in pk.next_picture_no(rows).collect()} == {"a": 8, "b": 1}


def test_picture_formats_and_sizes(spark):
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08\x00\x20\x00\x40\x01"
    bodies = {"jpeg": jpeg + b"\0" * 20, "gif": b"GIF89a", "webp": b"RIFF0000WEBP", "bmp": b"BM00", None: b"??"}
    df = spark.createDataFrame([(k, bytearray(b)) for k, b in bodies.items()], "k string, body binary").select("k", pk.picture_format(F.col("body")).alias("f"), pk.picture_size(F.col("body")).alias("s"))
    found = {r.k: r for r in df.collect()}
    assert all(r.f == k for k, r in found.items()) and tuple(found["jpeg"].s) == (64, 32) and found["gif"].s is None


def test_only_pictures_go_to_python(spark):
    """Of a PNG its head, of other files nothing: a section's body is not to pass a worker for its size in pixels."""
    png = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + (7).to_bytes(4, "big") + (9).to_bytes(4, "big")
    short, jpeg = png[:20], b"\xff\xd8\xff\xc0\x00\x0b\x08\x00\x20\x00\x40\x01" + b"\0" * 9
    bodies = [png + b"x" * 5_000, short, jpeg, b"<xml>" + b"y" * 5_000, b"", None]
    seen = spark.sparkContext.accumulator(0)
    own = F.pandas_udf

    def counting(kind):
        def made(f):
            def size(s):
                seen.add(sum(len(b) for b in s if b is not None))
                return f(s)

            size.__annotations__ = f.__annotations__
            return own(size, kind, 200)

        return made

    F.pandas_udf = counting
    try:
        df = spark.createDataFrame([(k, b) for k, b in enumerate(bodies)], "k int, body binary").select("k", pk.picture_size(F.col("body")).alias("s"))
    finally:
        F.pandas_udf = own
    assert [r.s and tuple(r.s) for r in df.orderBy("k").collect()] == [(7, 9), None, (64, 32), None, None, None]
    assert seen.value == 24 + len(short) + len(jpeg)


def test_picture_geometry(spark):
    df = spark.createDataFrame([(100, "4:3"), (None, "4:3"), (None, "16:9"), (160, "x")], "w int, r string")
    assert [tuple(r.g) for r in df.select(picture_geometry(F.col("w"), F.col("r")).alias("g")).collect()] == [(2400, 1800, 7500, 5625), (52000, 39000, 162500, 121875), (60000, 33750, 187500, 105468), (3840, 2160, 12000, 6750)]


def test_room_for_pictures(spark):
    df = spark.createDataFrame([(79, 100, True), (80, 25, True), (100, 24, True), (0, 0, True), (5, 5, False)], "w int, h int, c boolean")
    assert [r.x for r in df.select(large_enough(F.col("w"), F.col("h"), F.col("c")).alias("x")).collect()] == [False, True, False, True, True]


def test_extents_boxes_and_borders(spark):
    seg = spark.createDataFrame([(1, 0, 0, 10, 5, 5, 20, 9), (1, 1, 50, 10, 0, 7, 30, 9)], "p int, seg_no int, vertpos int, vertsize int, left int, top int, width int, height int")
    assert tuple(A.extents(seg, ["p"]).first()) == (1, 0, 50, 10, 60, 60)
    assert tuple(A.bounding_boxes(seg, ["p"]).first()) == (1, 0, 5, 30, 16)
    cells = spark.createDataFrame([(1, "NONE", "1px"), (1, None, "1px"), (2, "SOLID", "1px"), (2, "SOLID", "2px")], "t int, border_type string, border_width string")
    assert {r.t: (r.borderless, r.separate) for r in A.border_uniformity(cells, ["t"]).collect()} == {1: (True, False), 2: (False, True)}


def test_runs_and_zip(spark):
    df = spark.createDataFrame([(1, k, v) for k, v in enumerate(["a", "a", None, None, "a"])], "d int, k int, v string")
    assert [r.run_no for r in S.runs_of_equal(df, ["d"], "k", "v").orderBy("k").collect()] == [0, 0, 1, 1, 2]
    left = spark.createDataFrame([(1, 3, "x"), (1, 1, "y"), (1, 2, "z")], "d int, o int, a string")
    right = spark.createDataFrame([(1, 9, "p"), (1, 8, "q")], "d int, s int, b string")
    assert sorted((r.a, r.b) for r in J.zipped(left, right, ["d"], "o", "s").collect()) == [("y", "q"), ("z", "p")]


def test_style_usage(spark):
    pkg = office.Package(pk.entries(frame(spark, package(section(p(run(t("a"))), p(run(t("b"))), p(run(t("c"), char="77")))))))
    r = A.style_usage(pkg.nodes(), ["doc_id"]).first()
    assert (r.n_style_id, r.n_char_id, r.missing_char, r.missing_style) == (1, 2, 1, 0) and [s.n for s in r.top_summaries] == [3]


def test_roles_leave_what_was_said(spark):
    notes = spark.createDataFrame([(1, 1, None, None, None, None), (1, 2, "own", None, None, 5)], "d int, id int, role string, detail_node int, header_node int, max_chars int")
    pairs = spark.createDataFrame([(1, 1, 2)], "d int, header int, detail int")
    got = {r.id: (r.role, r.detail_node, r.header_node) for r in J.with_roles(notes, pairs, ["d"]).collect()}
    assert got == {1: ("summary_header", 2, None), 2: ("own", None, 1)}


def test_convert_folder_and_settings(spark, tmp_path):
    pk.write(frame(spark, package(section(p(run(t("hello")))))).withColumnRenamed("path", "doc_id"), str(tmp_path / "in"), F.concat("doc_id", F.lit(".hwpx"))).collect()
    made = office.convert(spark, str(tmp_path / "in"), str(tmp_path / "out")).collect()
    assert [r.path.rsplit("/", 1)[1] for r in made] == ["doc0.html"] and "hello" in (tmp_path / "out/doc0.html").read_text()
    assert office.settings_file("# c\nA=1\nB = 'x'\nbad\n", {"A": "2"}) == {"A": "2", "B": "x"}


def test_written_tables_are_cleared(spark):
    import os

    from quiremill.operators import keep

    folder = os.path.join(keep.shared_folder(spark), "quiremill")
    with keep.cleared(spark):
        one = keep.written(spark.range(3), "probe")
        assert one.count() == 3 and any(f.startswith("probe-") for f in os.listdir(folder))
    assert not any(f.startswith("probe-") for f in os.listdir(folder))
