"""Given tables of one file and one row group, dealt out over tasks."""

import pytest
from pyspark.sql import functions as F

from suite import registry


@pytest.fixture
def one_file(spark, tmp_path):
    rows = spark.range(50_001).select(
        F.when(F.col("id") % 5000 == 7, F.lit(None)).otherwise(F.floor(F.col("id") / 2)).alias("c_custkey"), F.concat(F.lit("Customer#"), "id").alias("c_name"),
        (F.col("id") % 25).cast("int").alias("c_nationkey"), F.lit(1.5).alias("c_acctbal"), F.lit("BUILDING").alias("c_mktsegment"),
    )
    rows.coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    return str(tmp_path)


def test_long_tables_are_dealt_out(spark, one_file):
    given = spark.read.parquet(f"{one_file}/customer.parquet")
    customer = registry.Tables(spark, one_file)("customer")
    sizes = [r["count"] for r in customer.groupBy(F.spark_partition_id().alias("part")).count().collect()]
    assert len(sizes) == 3 and max(sizes) < 25_000
    assert customer.exceptAll(given).isEmpty() and given.exceptAll(customer).isEmpty()


def test_texts_are_made_by_more_than_one_task(spark, one_file):
    letters = registry.Tables(spark, one_file)("fx_letters")
    files = {r.f.rsplit("/", 1)[1] for r in letters.select(F.input_file_name().alias("f")).distinct().collect()}
    assert len(files) > 1


def test_short_tables_stay_as_they_are(spark, one_file):
    few = spark.range(100)
    assert registry.dealt(few, "id") is few and registry.parts_of(few, least=3) == 3


def test_a_long_stretch_has_more_files(spark, one_file, tmp_path, monkeypatch):
    from suite import streams

    monkeypatch.setattr(streams, "parts_of", lambda df: 12)
    monkeypatch.setattr(streams, "folder", lambda t, name: f"{tmp_path}/{name}")
    streams.stretches(registry.Tables(spark, one_file), spark.range(1000), F.col("id"), [500])
    held = spark.read.parquet(f"{tmp_path}/in")
    assert held.count() == 1000 and len(held.inputFiles()) == 12


def test_vectors_are_dealt_out(spark, tmp_path):
    vectors = spark.range(1200).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.col("id") + 1.0).alias("embedding"), F.lit(0).alias("label"))
    vectors.coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    t = registry.Tables(spark, str(tmp_path))
    assert t("embeddings").select(F.spark_partition_id()).distinct().count() == 3
