"""Packages (ZIP files of XML and blobs): read as entries, written back in their order.

``entries`` has a row for each file in a package; bodies stay binary. With ``pieces`` it has a row for each piece of a file (columns ``n_bytes`` and
``piece_no`` besides), so that no row holds a section; what takes entries takes both. ``read`` goes through the data source of packages, which
inflates only what is asked for; ``entries`` unzips packages that are already rows, such as those of the binaryFile source. Writing gathers one package's entries in one task.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quiremill.operators.keep import written
from quiremill.sources.datasource import NAME, registered
from quiremill.sources.pieces import PIECE, in_pieces

ENTRIES = "doc_id string, entry_pos int, entry string, compress_type int, body binary"
PIECES = f"{ENTRIES}, n_bytes long, piece_no int"
#: Parts of a path that mark signatures and encryption, dropped on writing (fixed values).
UNSAFE = ("sign", "encrypt", "certification", "xmlsig")
#: Extensions of pictures (fixed values).
PICTURES = ("png", "jpg", "jpeg", "gif", "bmp", "webp", "svg")


def files(spark: SparkSession, path: str, glob: str = "*.hwpx", streaming: bool = False) -> DataFrame:
    """Packages below a path as (path, content)."""
    reader = spark.readStream.schema("path string, modificationTime timestamp, length long, content binary") if streaming else spark.read
    return reader.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)


def _inflated(z: zipfile.ZipFile, info: zipfile.ZipInfo):
    """One entry's bytes as an Arrow array of one value, inflated piece by piece into the room it takes."""
    import pyarrow as pa

    room = pa.allocate_buffer(info.file_size)
    to, at = memoryview(room).cast("B"), 0
    with z.open(info) as f:
        while piece := f.read(PIECE):
            to[at : at + len(piece)] = piece
            at += len(piece)
    return pa.Array.from_buffers(pa.binary(), 1, [None, pa.py_buffer(struct.pack("<ii", 0, at)), room])


def entries(packages: DataFrame, pieces: bool = False) -> DataFrame:
    """``entries`` of packages (path, content), whole or in ``pieces``; ``doc_id`` is the path. What is no ZIP file raises an error."""
    if pieces:
        return packages.select("path", "content").mapInArrow(_unzipped, PIECES)

    def unzip(batches) -> Iterator:
        import pyarrow as pa

        schema = pa.schema([("doc_id", pa.string()), ("entry_pos", pa.int32()), ("entry", pa.string()), ("compress_type", pa.int32()), ("body", pa.binary())])
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for k, i in enumerate(z.infolist()):
                        if not i.is_dir():
                            body = _inflated(z, i)
                            yield pa.RecordBatch.from_arrays([*(pa.array([v], t) for v, t in zip((path, k, i.filename, i.compress_type), schema.types, strict=False)), body], schema=schema)
                            del body
                            pa.default_memory_pool().release_unused()

    return packages.select("path", "content").mapInArrow(unzip, ENTRIES)


def _unzipped(batches) -> Iterator:
    import pyarrow as pa

    kinds = (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.int64(), pa.int32())
    names = [f.split()[0] for f in PIECES.split(", ")]
    for b in batches:
        for path, content in zip(b.column(0), b.column(1), strict=True):
            with zipfile.ZipFile(pa.BufferReader(content.as_buffer())) as z:
                for k, i in enumerate(z.infolist()):
                    if i.is_dir():
                        continue
                    with z.open(i) as f:
                        piece, no = f.read(PIECE), 0
                        while piece or not no:
                            row = (path.as_py(), k, i.filename, i.compress_type, piece, i.file_size, no)
                            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names)
                            piece, no = f.read(PIECE), no + 1


def is_pieced(all_entries: DataFrame) -> bool:
    return "piece_no" in all_entries.columns


def listed(all_entries: DataFrame) -> DataFrame:
    """A row for each entry: of entries in pieces without the body."""
    return all_entries.where("piece_no = 0").drop("body", "n_bytes", "piece_no") if is_pieced(all_entries) else all_entries


def whole(all_entries: DataFrame) -> DataFrame:
    """Entries with their whole bodies; of entries in pieces only a choice of small ones should come here."""
    if not is_pieced(all_entries):
        return all_entries
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("piece_no", "body"))), lambda x: x["body"])
    body = F.aggregate(ordered, F.expr("cast('' as binary)"), lambda a, x: F.concat(a, x))
    return all_entries.groupBy("doc_id", "entry_pos", "entry", "compress_type").agg(body.alias("body"))


def pieced(all_entries: DataFrame) -> DataFrame:
    """Entries in pieces; those of whole ones get a number ``row`` of their own, which parts entries of one place and name."""
    if is_pieced(all_entries):
        return all_entries.withColumn("row", F.lit(0).cast("long"))
    names = ["doc_id", "entry_pos", "entry", "compress_type", "row"]
    return in_pieces(all_entries.withColumn("row", F.monotonically_increasing_id()), "body", names).withColumnsRenamed({"piece": "body"}).withColumn("n_bytes", F.col("n_bytes").cast("long"))


def read(spark: SparkSession, path: str, glob: str = "*.hwpx", only: Column | None = None) -> DataFrame:
    """``entries`` of the packages below a path. ``only`` is a condition on ``entry`` and ``doc_id``, which goes down to
    the source: nothing else is read of a package but its directory."""
    found = registered(spark).read.format(NAME).option("glob", glob).load(path)
    return found if only is None else found.where(only)


def _folder() -> Column:
    return F.element_at(F.split("entry", "/"), 1)


def contents_folder(all_entries: DataFrame) -> DataFrame:
    """(doc_id, folder): the folder ``Contents``, or the first that differs in case alone."""
    top = all_entries.where(F.contains("entry", F.lit("/"))).select("doc_id", _folder().alias("folder")).where(F.lower("folder") == "contents").distinct()
    return top.groupBy("doc_id").agg(F.min_by("folder", F.struct((F.col("folder") != "Contents").cast("int"), "folder")).alias("folder"))


def sections(all_entries: DataFrame, required: bool = False) -> DataFrame:
    """Section entries with ``section_no``: those of the contents folder, else of the whole package; by number, then name. Of entries in pieces without their bodies.

    ``required`` makes a package without any an error.
    """
    all_entries = listed(all_entries)
    base = F.element_at(F.split("entry", "/"), -1)
    found = all_entries.where(F.rlike(base, F.lit(r"(?i)^section.*\.xml"))).join(contents_folder(all_entries), "doc_id", "left")
    inside = F.coalesce(_folder() == F.col("folder"), F.lit(False))
    from pyspark.sql import Window

    doc = Window.partitionBy("doc_id")
    kept = found.withColumn("__in", inside).withColumn("__any", F.max(F.col("__in").cast("int")).over(doc)).where(F.col("__in") | (F.col("__any") == 0))
    number = F.regexp_extract(base, r"(?i)section([0-9]+)\.xml", 1).try_cast("int")
    order = Window.partitionBy("doc_id").orderBy(number.asc_nulls_last(), "entry")
    out = kept.withColumn("section_no", F.row_number().over(order) - 1).drop("__in", "__any", "folder")
    if not required:
        return out
    found = all_entries.select("doc_id").distinct().join(out, "doc_id", "left")
    return found.where(F.assert_true(F.col("entry").isNotNull(), F.concat(F.lit("no section in "), "doc_id")).isNull())


def header(all_entries: DataFrame) -> DataFrame:
    return all_entries.where(F.lower("entry") == "contents/header.xml")


def pictures(all_entries: DataFrame) -> DataFrame:
    """Picture entries (doc_id, entry, picture_no from 1) in the order of their lower-case names."""
    from pyspark.sql import Window

    name = F.lower(F.element_at(F.split("entry", "/"), -1))
    own = whole(all_entries.where((F.lower(_folder()) == "bindata") & F.element_at(F.split(name, r"\."), -1).isin(*PICTURES)))
    return own.withColumn("picture_no", F.row_number().over(Window.partitionBy("doc_id").orderBy(name, "entry")))


def picture_counts(all_entries: DataFrame) -> DataFrame:
    return all_entries.select("doc_id").distinct().join(pictures(all_entries).groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def next_picture_no(all_entries: DataFrame) -> DataFrame:
    """(doc_id, next_no): one more than the greatest n of ``image{n}`` among the pictures."""
    n = F.regexp_extract(F.lower("entry"), r"image([0-9]+)\.", 1).try_cast("int")
    return all_entries.groupBy("doc_id").agg((F.coalesce(F.max(F.when(F.lower(_folder()) == "bindata", n)), F.lit(0)) + 1).alias("next_no"))


def is_unsafe(entry: Column) -> Column:
    return F.rlike(F.lower(entry), F.lit("|".join(UNSAFE)))


def picture_format(body: Column) -> Column:
    """png, jpeg, gif, webp or bmp by the first bytes."""
    head = F.hex(F.substring(body, 1, 12))
    return (
        F.when(F.startswith(head, F.lit("89504E470D0A1A0A")), "png").when(F.startswith(head, F.lit("FFD8")), "jpeg").when(F.startswith(head, F.lit("47494638")), "gif")
        .when(F.startswith(head, F.lit("52494646")) & F.endswith(head, F.lit("57454250")), "webp").when(F.startswith(head, F.lit("424D")), "bmp")
    )


#: JPEG markers: those that begin a frame (its size follows), and those without a length (fixed values of the format).
_FRAMES = frozenset(range(0xC0, 0xD0)) - {0xC4, 0xC8, 0xCC}
_BARE = frozenset((0x01, *range(0xD0, 0xDA)))
_MARKER = re.compile(rb"\xff+([^\x00\xff])")


def _jpeg_size(b: bytes) -> tuple[int, int] | None:
    """(width, height) of the first frame: from marker to marker, each segment's length a jump."""
    found = _MARKER.search(b)
    while found:
        kind, at = found[1][0], found.end()
        if kind in _FRAMES and len(b) >= at + 7:
            height, width = struct.unpack_from(">HH", b, at + 3)
            return width, height
        jump = 0 if kind in _BARE else struct.unpack_from(">H", b, at)[0] if len(b) >= at + 2 else 0
        if kind not in _BARE and jump < 2:
            return None
        found = _MARKER.search(b, at + jump)
    return None


def picture_size(body: Column) -> Column:
    """struct<width, height> of PNG and JPEG data (frames of every kind); null for others. Of a PNG only its head goes to Python, of what is no picture nothing."""

    @F.pandas_udf("struct<width:int,height:int>")
    def size(s):  # noqa: ANN001
        import pandas as pd

        def one(b):
            if b is not None and b.startswith(b"\x89PNG\r\n\x1a\n") and len(b) >= 24:
                return struct.unpack_from(">II", b, 16)
            return (_jpeg_size(b) if b is not None and b.startswith(b"\xff\xd8") else None) or (None, None)

        return pd.DataFrame([one(b) for b in s], columns=["width", "height"], dtype="Int32")

    kind = picture_format(body)
    out = size(F.when(kind == "png", F.substring(body, 1, 24)).when(kind == "jpeg", body))
    return F.when(out["width"].isNotNull(), out)


def packed(all_entries: DataFrame) -> DataFrame:
    """(doc_id, content): packages of their entries, whole or in pieces, in order of ``entry_pos`` (new ones: null, last, by name). Signatures and the
    like are left out; an entry without a compression type is deflated. Pieces may have any size and numbers; where ``n_bytes`` is null the entry may have any size too."""
    safe = all_entries.where(~is_unsafe(F.col("entry")))
    pieces = safe if is_pieced(safe) and "row" in safe.columns else pieced(safe)
    # entries of one place and name stand side by side: their pieces are not to mix
    order = ["doc_id", "entry_pos", "entry", "row"]
    rows = pieces.select("doc_id", F.coalesce("entry_pos", F.lit(2**31 - 1)).alias("entry_pos"), "entry", "row", "piece_no", F.coalesce("compress_type", F.lit(zipfile.ZIP_DEFLATED)).alias("compress_type"), "n_bytes", "body")

    def zipped(batches) -> Iterator:
        import pyarrow as pa

        here = out = z = entry = None

        def content():
            z.close()
            return pa.RecordBatch.from_arrays([pa.array([here[0]], pa.string()), pa.array([out.getvalue()], pa.binary())], ["doc_id", "content"])

        for b in batches:
            for *key, _, kind, n_bytes, piece in zip(*(c if k == 7 else c.to_pylist() for k, c in enumerate(b.columns)), strict=True):
                if not piece.is_valid:
                    raise ValueError(f"no bytes of {key[2]} in {key[0]}")
                if key != here:
                    if here:
                        entry.close()
                    if not here or key[0] != here[0]:
                        if here:
                            yield content()
                        out = io.BytesIO()
                        z = zipfile.ZipFile(out, "w")
                    here, info = key, zipfile.ZipInfo(key[2])
                    info.compress_type, info.file_size = kind, n_bytes or 0
                    entry = z.open(info, "w", force_zip64=n_bytes is None)
                entry.write(memoryview(piece.as_buffer()))
        if here:
            entry.close()
            yield content()

    return rows.repartition("doc_id").sortWithinPartitions(*order, "piece_no").mapInArrow(zipped, "doc_id string, content binary")


def write(packages: DataFrame, folder: str, name: Column | None = None) -> DataFrame:
    """Write (doc_id, content) as files of a folder, all or none; returns (doc_id, path). Files of the same names are replaced."""
    named = packages.select("doc_id", (name if name is not None else F.element_at(F.split("doc_id", "/"), -1)).alias("name"), F.col("content").cast("binary").alias("content"))
    named = written(named, "files")  # made once: it is read to write the files, and again for their names
    registered(packages.sparkSession)
    named.select("name", "content").write.format(NAME).mode("overwrite").save(folder)
    return named.select("doc_id", F.concat(F.lit(folder.rstrip("/") + "/"), "name").alias("path"))
