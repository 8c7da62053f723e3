import pytest

from quiremill.plans import package_queries as q
from quiremill.plans import supplier_queries
from tests.oracle import duck, same

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


QUERIES, ORACLE_SQL = q.QUERIES | supplier_queries.QUERIES, q.ORACLE_SQL | supplier_queries.ORACLE_SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_as_sql(spark, con, name):
    same(QUERIES[name](spark, SF), ORACLE_SQL[name], con)


def test_pictures_exchanged_and_exported(spark, tmp_path):
    from pyspark.sql import functions as F

    from quiremill.plans import office
    from quiremill.sources import package as P

    entries = P.entries(q.packages(spark, SF)).where("doc_id in ('nation0', 'nation1')")
    made = office.picture_slots(entries, entries.select("doc_id").distinct().select("doc_id", F.lit(0).alias("seq"), F.lit("a plan").alias("prompt"))).select("doc_id", "entry", F.lit(b"new").alias("body"))
    back = P.entries(office.with_new_pictures(entries, made).withColumnRenamed("doc_id", "path"))
    assert {(r.doc_id, r.entry, bytes(r.body) == b"new") for r in P.pictures(back).collect()} == {(f"nation{n}", e, e.endswith("JPG")) for n in (0, 1) for e in ("BinData/B.JPG", "BinData/image3.png")}
    files = sorted(r.path for r in office.exported_pictures(entries, str(tmp_path / "out")).collect())
    assert [f.rsplit("/", 1)[1] for f in files] == ["nation0-B.JPG", "nation0-image3.png", "nation1-B.JPG", "nation1-image3.png"]


def test_plans_of_a_model_reach_the_job(spark):
    import json

    from quiremill.operators import annotate
    from quiremill.plans import office
    from quiremill.sources import package as P

    entries = P.entries(q.packages(spark, SF)).where("doc_id = 'nation0'")

    def planner(prompt):
        ids = [int(line[1:4]) for line in prompt.splitlines() if line[:1] == "[" and line[4:6] == "] "]
        return json.dumps({"chunks": [{"chunk_id": 0, "node_ids": ids}]})

    table = office.Package(entries).nodes()
    asked = annotate.Called(planner, 2)
    from quiremill.operators.nodes import for_model, summaries

    plan = office.planned(table, summaries(office.Package(entries).elems), asked)
    chunk_of = office.chunked(table, plan, 3)
    assert chunk_of.select("section_no", "chunk_no").distinct().count() == 2  # whole sections, not three nodes each
    assert chunk_of.count() == for_model(table).count()
