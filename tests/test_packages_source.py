"""The data source of packages: what is read, what is written, and what failed jobs leave."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import GreaterThan

from quiremill.operators import components
from quiremill.sources import datasource as ds
from quiremill.sources import package as pk
from tests.packages import p, package, run, section, t


class Counting:
    """A file that counts the bytes read of it."""

    def __init__(self, file):
        self.file, self.bytes = file, 0

    def read(self, *n):
        out = self.file.read(*n)
        self.bytes += len(out)
        return out

    def __getattr__(self, name):
        return getattr(self.file, name)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    base = tmp_path_factory.mktemp("packages")
    (base / "deep").mkdir()
    noise = "".join(chr(0x4E00 + k * 7919 % 20000) for k in range(30000))
    for k, place in enumerate((base, base, base / "deep")):
        (place / f"d{k}.hwpx").write_bytes(package(section(p(run(t(noise)))), section(p(run(t(f"text {k}"))))))
    (base / "other.txt").write_text("no package")
    return str(base)


def test_only_what_is_asked_for_is_read(folder):
    path = f"{folder}/d0.hwpx"
    with open(path, "rb") as f:
        whole, header = Counting(f), Counting(f)
        every = list(ds.read_entries(whole, "d0"))
        some = list(ds.read_entries(header, "d0", [ds.EqualTo(("entry",), "Contents/header.xml")]))
    assert [r[2] for r in some] == ["Contents/header.xml"] and some == [r for r in every if r[2] == "Contents/header.xml"]
    assert whole.bytes > os.path.getsize(path) * 0.9 and header.bytes < 4000 < os.path.getsize(path) / 10


def test_filters_reach_the_source(spark, folder):
    every = pk.read(spark, folder)
    plain = pk.entries(pk.files(spark, folder))
    rows = lambda df: sorted((r.doc_id, r.entry_pos, r.entry, r.compress_type, bytes(r.body)) for r in df.collect())
    assert rows(every) == rows(plain) and every.columns == plain.columns
    asked = pk.read(spark, folder, only=F.startswith("entry", F.lit("Contents/section")) & ~F.endswith("entry", F.lit("0.xml")) & F.contains("doc_id", F.lit("deep")) & (F.length("body") > 3))
    assert [r[2] for r in rows(asked)] == ["Contents/section1.xml"]
    text = asked._sc._jvm.PythonSQLUtils.explainString(asked._jdf.queryExecution(), "formatted")
    scan = text[text.index("BatchScan") if "BatchScan" in text else 0 :]
    assert "PushedFilters" in scan and "StringStartsWith" in scan
    assert rows(pk.read(spark, f"{folder}/d1.hwpx", only=F.col("entry").isin("mimetype", "none")))[0][2] == "mimetype"
    assert pk.read(spark, folder, "*.none").count() == 0


def test_filters_one_by_one():
    reader = ds.PackageReader({"path": "x"})
    fine = [ds.EqualTo(("entry",), "a"), ds.In(("doc_id",), ("a", "b")), ds.Not(ds.StringContains(("entry",), "q"))]
    other = [ds.EqualTo(("body",), b""), GreaterThan(("entry_pos",), 1), ds.Not(ds.EqualTo(("body",), b""))]
    assert list(reader.pushFilters(fine + other)) == other and reader.filters == fine
    assert [ds._holds(f, "a") for f in fine] == [True, True, True] and not ds._holds(ds.Not(ds.StringEndsWith(("entry",), "a")), "ba")


def test_files_appear_whole_and_only_when_all_tasks_have_succeeded(spark, tmp_path):
    out = f"file://{tmp_path}/out"
    ds.registered(spark)
    df = spark.range(20).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("name"), F.encode(F.col("id").cast("string"), "UTF-8").alias("content")).repartition(4)
    df.write.format("packages").mode("append").save(out)
    assert {f: (tmp_path / "out" / f).read_bytes() for f in os.listdir(tmp_path / "out")} == {f"f{k}": str(k).encode() for k in range(20)}
    broken = df.withColumn("content", F.when(F.col("name") == "f7", F.raise_error(F.lit("broken"))).otherwise(F.lit(b"new")))
    for bad, why in ((broken, "broken"), (df.withColumn("name", F.lit("one")), "same file name"), (df.withColumn("name", F.lit("a/b")), "no file name"), (df.drop("name"), "name and content")):
        with pytest.raises(Exception, match=why):
            bad.write.format("packages").mode("overwrite").save(out)
    with pytest.raises(Exception, match="there already"):
        df.limit(1).write.format("packages").mode("append").save(out)
    assert {f: (tmp_path / "out" / f).read_bytes() for f in os.listdir(tmp_path / "out")} == {f"f{k}": str(k).encode() for k in range(20)}
    df.where("name = 'f3'").withColumn("content", F.lit(b"new")).write.format("packages").mode("overwrite").save(out)
    assert (tmp_path / "out/f3").read_bytes() == b"new" and len(os.listdir(tmp_path / "out")) == 20


def test_an_attempt_that_ran_twice_leaves_one_file(tmp_path):
    import pyarrow as pa

    writer = ds.PackageWriter({"path": str(tmp_path)}, True)
    batch = pa.RecordBatch.from_arrays([pa.array(["a", "b"]), pa.array([b"1", None], pa.binary())], ["name", "content"])
    writer.write(iter([batch]))  # this attempt's answer is lost
    writer.commit([writer.write(iter([batch])), None])
    assert {f: (tmp_path / f).read_bytes() for f in os.listdir(tmp_path)} == {"a": b"1", "b": b""}
    writer.write(iter([batch]))
    writer.abort([None])
    assert sorted(os.listdir(tmp_path)) == ["a", "b"]


def test_many_chunks_that_share_tables(spark):
    n = 100_000
    # chunk k holds tables k // 2 and (k + 1) // 2 below half, so these are one; the rest are alone; another section stays apart
    df = spark.range(n).select(F.lit("d").alias("doc"), F.col("id").alias("chunk_no"), F.explode(F.when(F.col("id") < n // 2, F.array(F.floor(F.col("id") / 2), F.floor((F.col("id") + 1) / 2))).otherwise(F.array(F.col("id")))).alias("table_idx"))
    df = df.unionByName(spark.createDataFrame([("e", 5, 1), ("e", 3, 1), ("e", 9, -1), ("e", 8, None), ("e", 7, -1), (None, 1, 4)], "doc string, chunk_no long, table_idx long"))
    got = {(r.doc, r.chunk_no): r.merged_no for r in components.merge_shared(df, ["doc"]).collect()}
    assert got == {("d", k): 0 if k < n // 2 else k for k in range(n)} | {("e", 5): 3, ("e", 3): 3, ("e", 9): 9, ("e", 8): 8, ("e", 7): 7, (None, 1): 1}
