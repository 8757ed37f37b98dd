"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from resolvescope.session import shared_folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """The text of a row; null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once per row.

    Bound as a lambda variable, it cannot be inlined into a lambda that runs once per element.
    """
    return F.transform(F.array(value), body).getItem(0)


def split_words(text: Column, separators: str) -> Column:
    """Array of the maximal runs outside ``separators`` (a character class)."""
    return F.array_remove(F.split(text, f"{separators}+"), "")


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """A long that names a row by its id and text, whether or not the id is null or repeated."""
    return F.xxhash64(doc_id, text)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted column names, each with underscores added until ``df`` has no such column."""
    taken = {name.lower() for name in df.columns}
    found = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


class Scratch:
    """Tables of one run in the cluster's shared folder; dropped at the latest when the session ends."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
        self._paths: dict[int, str] = {}
        path, fs = self._at(self.root)
        fs.deleteOnExit(path)

    def _at(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def folder(self, name: str) -> str:
        return f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"

    def cut(self, df: DataFrame) -> DataFrame:
        """Write a frame and go on from the files: short lineage, and a lost executor costs a re-read."""
        path = self.folder("table")
        df.write.parquet(path)
        again = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(again)] = path
        return again

    def drop(self, df: DataFrame) -> None:
        """Remove a table of ``cut`` that nothing reads any more."""
        path, fs = self._at(self._paths.pop(id(df)))
        fs.delete(path, True)


ARROW_SETTINGS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "256", "spark.sql.execution.arrow.maxBytesPerBatch": "8388608"}


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, in rows and bytes, so that long texts fit a Python worker."""
    for key, value in ARROW_SETTINGS.items():
        spark.conf.set(key, value)


def lists_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of an Arrow list column without nulls; offsets start at 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = column.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]]
    return values, offsets - offsets[0]


def arrow_columns(batch: pa.RecordBatch, names: list[str], **more: pa.Array) -> pa.RecordBatch:
    """The named columns of a batch and further ones."""
    return pa.RecordBatch.from_arrays([batch.column(n) for n in names] + list(more.values()), names=names + list(more))


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge; root is the smallest node of its component.

    Alternating large-star and small-star rounds over (a, b) edges with a > b. Every round leaves at
    most as many edges as before, each pass only needs the minimum per node, and each round is written
    to the shared folder. Stops when the set of edges no longer changes.
    """
    spark = edges.sparkSession
    current = scratch.cut(edges.select(F.col("a").alias("a"), F.col("b").alias("b")).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(current)
    while state[0]:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = scratch.cut(large)
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        lowest = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(lowest, "a").select(F.col("b").alias("v"), "m").unionByName(lowest.select(F.col("a").alias("v"), "m"))
        following = scratch.cut(small.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct())
        scratch.drop(large)
        scratch.drop(current)
        current, before = following, state
        state = _state(current)
        if state == before:
            break
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()) if state[0] else spark.createDataFrame([], "node long, root long")


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]
