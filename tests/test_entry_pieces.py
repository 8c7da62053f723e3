"""Entries in pieces give what whole ones give, and no row holds a section."""

from pyspark.sql import functions as F

from quiremill.plans import office
from quiremill.plans import package_queries as q
from quiremill.sources import package as P
from quiremill.sources import pieces
from tests.packages import frame, p, package, run, section, t, unzipped


def test_packages_in_pieces(spark):
    """Opened, listed and written back in pieces: a section of several, one without a child, and the other entries."""
    long = section(*(p(run(t(f"é{k} " * 100))) for k in range(6_000)))
    content = package(long, section(p(run(t("b")))), section())
    rows = P.entries(frame(spark, content), pieces=True)
    sizes = rows.where("entry = 'Contents/section0.xml'").agg(F.count("*"), F.max(F.octet_length("body")), F.sum(F.octet_length("body")), F.max("n_bytes")).first()
    assert sizes[0] > 2 and sizes[1] == pieces.PIECE and sizes[2] == sizes[3] == len(unzipped(content)["Contents/section0.xml"])
    whole, some = office.Package(P.entries(frame(spark, content))), office.Package(rows)
    assert "body" not in some.sections.columns
    order = ["section_no", "pos"]
    assert some.elems.orderBy(order).select(*whole.elems.columns).collect() == whole.elems.orderBy(order).collect()
    assert unzipped(bytes(some.repacked(some.elems).first().content)) == unzipped(bytes(whole.repacked(whole.elems).first().content))
    new = spark.createDataFrame([("BinData/none", b"x"), ("Contents/header.xml", b"<h/>")], "entry string, body binary").withColumn("doc_id", F.lit(rows.first().doc_id))
    back = unzipped(bytes(office.with_new_pictures(rows, new).first().content))
    assert back == unzipped(content) | {"Contents/header.xml": b"<h/>"}


def test_sections_of_nations_are_made_in_pieces(spark):
    """A section is made of blocks of rows, none of which grows with the table."""
    most = q._sections(spark, "/root/testdata/sf0.01").where("entry_pos = 2").agg(F.max(F.length("x")), F.sum(F.length("x"))).first()
    assert most[0] < 1_500 * q._BLOCK and most[1] > most[0] * 5
