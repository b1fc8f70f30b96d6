import pytest
from pyspark.sql import functions as F
from quillstone.sources import schemas


@pytest.mark.parametrize("name", sorted(schemas.SCHEMAS))
def test_empty_tables_break_no_rule(spark, name):
    assert schemas.check_table(schemas.empty(spark, name), name).count() == 0


def test_broken_rules(spark):
    rows = schemas.empty(spark, "embedding_generations").unionByName(spark.createDataFrame([("a", "c1", "active", 1), ("b", "c1", "active", -1), ("c", "c3", "odd", 0)], "id string, collection_name string, status string, indexed_chunks long"), allowMissingColumns=True)
    got = {(r["rule"], r["key"]) for r in schemas.check_table(rows, "embedding_generations").collect()}
    assert got == {("status value", "c"), ("indexed_chunks negative", "b"), ("unique collection_name", "c1"), ("one active", "2")}


def test_paths(spark, tmp_path):
    df = schemas.empty(spark, "papers").unionByName(spark.createDataFrame([("1", "arxiv", "x")], "id string, source string, external_id string"), allowMissingColumns=True)
    df.write.parquet(str(tmp_path / "p"))
    back = schemas.read(spark, str(tmp_path / "p"), "papers")
    assert back.columns == df.columns and back.filter(F.col("title").isNull()).count() == 1
