"""Which tables a join may send to the driver, how much one task takes on."""

import contextlib
import io

from pyspark.sql import functions as F

from resolvescope.session import configure


def test_keys_that_files_hold_small_are_not_broadcast(spark, tmp_path):
    path = str(tmp_path / "orders")
    spark.range(1_500_000, numPartitions=1).select(F.col("id").alias("k"), (F.col("id") * 7).alias("c")).write.parquet(path)
    orders = configure(spark).read.parquet(path)  # some MB of files, 36 MB of rows
    said = io.StringIO()
    with contextlib.redirect_stdout(said):
        spark.range(3_000_000).join(orders, F.col("id") == F.col("k")).explain()
    assert "BroadcastExchange" not in said.getvalue()
    few = str(tmp_path / "few")
    spark.range(100).select(F.col("id").alias("k")).write.parquet(few)
    with contextlib.redirect_stdout(said):
        spark.range(3_000_000).join(spark.read.parquet(few), F.col("id") == F.col("k")).explain()
    assert "BroadcastExchange" in said.getvalue()


def test_a_table_of_few_keys_is_broadcast_whatever_the_partitions(spark):
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "100")
    try:
        configure(spark)
        few = spark.range(3000).select((F.col("id") % 5).alias("k")).groupBy("k").agg(F.max("k").alias("v"))
        joined = spark.range(200_000).select((F.col("id") % 5).alias("k")).repartition(4).join(few, "k")
        assert joined.count() == 200_000
        joined.collect()
        said = io.StringIO()
        with contextlib.redirect_stdout(said):
            joined.explain()
        assert "BroadcastHashJoin" in said.getvalue().split("Initial Plan")[0]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
        configure(spark)


def test_what_a_task_takes_on_follows_bytes_not_the_sessions_partitions(spark):
    configure(spark)
    sizes = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64KB"}
    kept = {k: spark.conf.get(k) for k in sizes}
    for k, v in sizes.items():
        spark.conf.set(k, v)
    try:
        counted = spark.range(300_000).groupBy(F.xxhash64("id").alias("k")).count()
        assert counted.rdd.getNumPartitions() > 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == "16MB"


def test_methods_that_the_jvm_would_interpret_are_not_run(spark):
    assert int(configure(spark).conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000
