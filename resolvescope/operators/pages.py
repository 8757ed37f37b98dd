"""Pages of a large ordered report, read without the pages before them.

A report is written once in ranges of its order, with a table of how many rows of a group each range holds
and how many stand before it. A page is then a place in one range (or two, at a border). Ranges lie in order in
the file of a piece of the order, with their number, so a page opens one file and the parts of it that hold its range.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from resolvescope.session import materialise

RANGE_ROWS = 100_000
"""Rows of a range, about."""
PIECE_ROWS = 250_000
"""Rows of a piece, about. What the driver samples to deal pieces, and the files written, follow their number."""


def _total_order(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> list[Column]:
    """The order with all columns after it, so that a page does not depend on how equal rows happen to lie."""
    return [*order, *[F.col(c).asc_nulls_last() for c in sorted(df.columns) if c not in by]]


def write_pages(df: DataFrame, order: Sequence[Column], path: str, by: Sequence[str] = (), range_rows: int = RANGE_ROWS,
                cut: Callable[[DataFrame], DataFrame] = materialise) -> None:
    """Write a report for ``read_page``, in one order per group of the ``by`` columns.

    Ranges are dealt by group and order together, so a group of a third of all rows is many ranges and
    small groups share one. Equal rows stay as many as they are. However small the ranges, only the number of
    pieces is one of samples, tasks and files.
    """
    rows = cut(df)
    n = rows.count()
    pieces = max(1, min(math.ceil(n / range_rows), max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(n / PIECE_ROWS))))
    keys = [*[F.col(c) for c in by], *_total_order(rows, by, order)]
    dealt = rows.repartitionByRange(pieces, *keys).withColumn("range_piece", F.spark_partition_id()).sortWithinPartitions("range_piece", *keys)
    place = F.monotonically_increasing_id()  # grows by one from row to row of a piece, and from piece to piece
    in_piece = place - F.call_function("shiftleft", F.col("range_piece").cast("bigint"), F.lit(33))
    dealt = dealt.withColumn("range_no", place - in_piece % range_rows)
    dealt.write.mode("errorifexists").partitionBy("range_piece").parquet(f"{path}/rows")
    rows.limit(0).write.parquet(f"{path}/columns")  # an empty report has no range to take them from
    counts = rows.sparkSession.read.schema(dealt.schema).parquet(f"{path}/rows").groupBy(*by, "range_piece", "range_no").agg(F.count(F.lit(1)).alias("n_rows"))
    # A row per group and range; the running count of a group goes over its ranges only.
    earlier = Window.partitionBy(*by).orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    counts.withColumn("n_before", F.coalesce(F.sum("n_rows").over(earlier), F.lit(0))).write.parquet(f"{path}/index")


def read_page(spark: SparkSession, path: str, order: Sequence[Column], page: int = 1, size: int = 25, group: Mapping[str, object] | None = None) -> DataFrame:
    """One page of a written report, with its rows' ``rank`` from 1, in ``order`` (as given to ``write_pages``)."""
    group = group or {}
    low, high = (page - 1) * size, page * size
    index = _of_group(spark.read.parquet(f"{path}/index"), group).where((F.col("n_before") < high) & (F.col("n_before") + F.col("n_rows") > low))
    found = {r["range_no"]: (r["range_piece"], r["n_before"]) for r in index.collect()}  # the ranges that the page lies in
    schema = spark.read.parquet(f"{path}/columns").schema
    if not found:
        return spark.createDataFrame([], schema).withColumn("rank", F.lit(0).cast("bigint"))
    pieces = sorted({piece for piece, _ in found.values()})
    rows = spark.read.schema(StructType([*schema, StructField("range_no", LongType())])).parquet(*[f"{path}/rows/range_piece={n}" for n in pieces])
    rows = _of_group(rows.where(F.col("range_no").isin(*found)), group)
    before = F.element_at(F.create_map(*[F.lit(x).cast("bigint") for number, (_, n) in found.items() for x in (number, n)]), F.col("range_no"))
    inside = Window.partitionBy("range_no").orderBy(*_total_order(rows.drop("range_no"), list(group), order))
    ranked = rows.withColumn("rank", F.row_number().over(inside) + before)
    return ranked.where((F.col("rank") > low) & (F.col("rank") <= high)).drop("range_no")


def _of_group(df: DataFrame, group: Mapping[str, object]) -> DataFrame:
    for name, value in group.items():
        df = df.where(F.col(name).eqNullSafe(F.lit(value)))
    return df
