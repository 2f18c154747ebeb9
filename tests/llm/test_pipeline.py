"""The queries against their SQL, and the stages one after the other."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
import corpus_pipeline
from temblor.llm import registry

D = "/root/testdata/sf0.001"
TABLES = ("documents", "pages", "labels", "conversations", "embeddings")


def test_every_operator_has_a_query():
    names = [n.split("_")[0] for n in registry.QUERIES]
    assert sorted(names) == sorted(f"op{k}" for k in range(1, 14))
    assert set(registry.QUERIES) | {"pipeline"} <= set(driver.queries())


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for table in TABLES:
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{D}/{table}.parquet'")
    result = driver.queries()[name](spark, D)
    cursor = duck.execute(driver.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(result.columns)
    assert sorted(map(str, map(tuple, result.select(*columns).collect()))) == sorted(map(str, cursor.fetchall()))


@pytest.mark.parametrize("name, table", [("op3_html_text", "pages"), ("op4_language_id", "documents"), ("op5_near_vectors", "embeddings"),
                                         ("op6_shards", "documents"), ("op10_mixing", "documents")])
def test_query_returns_every_row(spark, name, table):
    assert driver.queries()[name](spark, D).count() == spark.read.parquet(f"{D}/{table}.parquet").count()


def test_stages(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    bad = spark.createDataFrame([(-5, "12 - 34", "en", "s", 7), (-6, docs.filter("doc_id = 7").first()["text"], "en", "s", 1)], docs.schema)
    long = " ".join(f"{w} the river and the house of words" for w in map(str, range(60_000)))  # more than two million bytes
    odd = spark.createDataFrame([(-7, None, None, None, None), (-8, "", "en", "s", 0), (-9, long, None, "s", len(long)), (-7, None, "en", "s", 0)], docs.schema)
    # Columns that the operators themselves use for other things.
    docs = docs.unionByName(bad).unionByName(odd).withColumns({"id": F.lit(1), "key": F.lit("k"), "_found": F.lit(2), "posterior": F.lit(0.5)})
    assert [k for k, _ in corpus_pipeline.STAGES] == ["language ID", "near-duplicate removal", "mixing to target weights", "packing"]
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        docs = stage(spark, docs, D)
        assert docs.columns == columns
        ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert not ids & {-5, -7, -8} and (k == 0 or 7 not in ids) and (k == 2 or -9 in ids)
    packed = corpus_pipeline.STAGES[3][1](spark, docs, D)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == ids
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.read.parquet(f"{D}/documents.parquet").limit(0), D).collect() == []
