"""Values that go to Python in pieces: the same rows as from whole ones, and no worker holds more than pieces."""

import hashlib
import zipfile
from io import BytesIO

from pyspark.sql import functions as F

from quiremill.sources import html as H
from quiremill.sources import package as pk
from quiremill.sources import pieces, xml

SECTION = "<s:sec xmlns:s='urn:s'>" + "".join(f"<s:p id='{k}'>é{k}<s:t>&amp;{k}</s:t>tail{k}<s:e/></s:p>behind" for k in range(12_000)) + "</s:sec>"


def test_elements_are_done_before_their_text_ends():
    """A parser that holds every element of a section fails here."""
    reader, most = xml._Reader(), 0
    body, seen = SECTION.encode(), []
    for at in range(0, len(body), 1000):
        reader.parser.Parse(memoryview(body)[at : at + 1000], False)
        seen += reader.take()
        most = max(most, len(reader.open) + sum(r["last"] is not None for r in reader.open))
    reader.parser.Parse(b"", True)
    seen += reader.take()
    assert most < 10
    assert sorted(seen, key=lambda r: r["pos"]) == xml.parse(body) and len(seen) == 36_001
    p = xml.parse(body)[4]
    assert (p["tag"], p["pos"], p["end_pos"], p["text"], p["tail"], p["child_no"]) == ("p", 4, 6, "é1", "behind", 1)


def test_a_body_of_many_pieces(spark):
    """Inflated, parsed and packed in pieces: more than one here, and entries of the same place do not mix."""
    body = SECTION.encode()
    assert len(body) < pieces.PIECE
    body = body.replace(b"</s:sec>", b"<s:q>" + b"x\xc3\xa9" * 500_000 + b"</s:q></s:sec>")
    noise = b"".join(hashlib.sha256(str(k).encode()).digest() for k in range(80_000))
    rows = [("d", 1, "a.xml", 8, body), ("d", 0, "n.bin", 0, noise), ("d", None, "new", None, b"1" * 1_500_000), ("e", 0, "none", 8, b""), ("d", 2, "exact", 8, b"z" * pieces.PIECE)]
    packed = pk.packed(spark.createDataFrame(rows, "doc_id string, entry_pos int, entry string, compress_type int, body binary")).collect()
    found = {r.doc_id: bytes(r.content) for r in packed}
    with zipfile.ZipFile(BytesIO(found["d"])) as z:
        assert [(i.filename, i.compress_type, z.read(i)) for i in z.infolist()] == [("n.bin", 0, noise), ("a.xml", 8, body), ("exact", 8, b"z" * pieces.PIECE), ("new", 8, b"1" * 1_500_000)]
    plain = BytesIO()
    with zipfile.ZipFile(plain, "w") as z:
        z.writestr(zipfile.ZipInfo("none"), b"", compress_type=8)
    assert found["e"] == plain.getvalue()
    entries = pk.entries(spark.createDataFrame(packed).withColumnRenamed("doc_id", "path"))
    assert {(r.doc_id, r.entry): bytes(r.body) for r in entries.collect()} == {(d, e): b for d, _, e, _, b in rows}
    elems = xml.elements(entries.where("entry = 'a.xml'"), ("entry_pos",))
    want = xml.parse(body)
    got = elems.select("entry_pos", "pos", "end_pos", "tag", "text", "tail", F.size("attrs").alias("n")).orderBy("pos").collect()
    assert [tuple(r) for r in got] == [(1, w["pos"], w["end_pos"], w["tag"], w["text"], w["tail"], len(w["attrs"])) for w in want]


def test_pages_and_texts_of_many_pieces(spark):
    """HTML cut between pieces within tags, references and characters gives what a parser gives that is fed once."""
    unit = '<p data-id="{k}" title="a&lt;é">é &amp;amp; &eacute; &#233; {k}<br>b</p><!-- c --><style>a<b</style>'
    doc = "<body>" + "".join('<div class="page">' + "".join(unit.replace("{k}", str(k)) for k in range(n * 9_000, (n + 1) * 9_000)) + "</div>" for n in range(3)) + '<div class="page">never closed'
    assert len(doc.encode()) > 2 * pieces.PIECE
    p, q = H._Trace(False), H._Owned("data-id", False)
    for x in (p, q):
        x.feed(doc)
        x.close()
    docs = spark.createDataFrame([("d", doc), ("none", None), ("empty", ""), ("small", '<div class="page"><i data-id="7">x</i></div>')], "doc_id string, html string")
    pages = H.pages(docs, ["doc_id"]).orderBy("doc_id", "page_no").collect()
    assert [r.page for r in pages if r.doc_id == "d"] == H._page_texts(p.trace)
    assert [(r.doc_id, r.page_no) for r in pages] == [("d", 1), ("d", 2), ("d", 3), ("small", 1)]
    want = {}
    for i, text in q.pieces:
        want[i] = want.get(i, "") + (text or "")
    got = {(r.doc_id, r.id): r.text for r in H.owned_text(docs, ["doc_id"]).collect()}
    assert got == {("d", i): t for i, t in want.items()} | {("small", "7"): "x"}
