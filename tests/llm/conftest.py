import pytest


@pytest.fixture(scope="module")
def spark(spark):
    """The session with settings as on a cluster: several partitions, adaptive plans, compiled stages."""
    as_there = {"spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.codegen.wholeStage": "true"}
    before = {k: spark.conf.get(k, None) for k in as_there}
    for k, v in as_there.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)
