"""The number of pieces of a workload table."""

from pyspark.sql import functions as F

from workload import fixtures


def test_pieces_grow_with_the_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fixtures, "SPREAD_ROWS", 1_000, raising=False)
    spark.range(30_500, numPartitions=1).select(F.col("id").alias("o_orderkey")).write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(500, numPartitions=1).select(F.col("id").alias("l_orderkey")).write.parquet(f"{tmp_path}/lineitem.parquet")
    made = fixtures.Fixtures(spark, str(tmp_path))
    assert made.spread("orders").rdd.getNumPartitions() == 31
    assert made.spread("orders").agg(F.count("*"), F.sum("o_orderkey")).first() == (30_500, 30_500 * 30_499 // 2)
    assert made.spread("lineitem").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
