"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from resolvescope.llm.common import Scratch, arrow_columns, ascii_lower, components, free_names, let, lists_of, row_key, small_batches, split_words, text_of

SPACE = r"[\x20\x09-\x0D]"
AT_ONCE = 1 << 17
"""Hashes whose bits are spread out at a time (64 bytes each)."""


def shingle_hashes(text: Column, size: int = 3) -> Column:
    """XXH64 (seed 42) of every run of ``size`` words, repeats included; of the whole sequence if it is shorter."""

    def hashes(words: Column) -> Column:
        def shingle(i: Column) -> Column:
            return F.xxhash64(F.concat_ws(" ", *[F.get(words, i + k) for k in range(size)]))

        return (
            F.when(F.size(words) >= size, F.transform(F.sequence(F.lit(0), F.size(words) - size), shingle))
            .when(F.size(words) > 0, F.array(F.xxhash64(F.array_join(words, " "))))
            .otherwise(F.array().cast("array<long>"))
        )

    return let(split_words(ascii_lower(text), SPACE), hashes)


def majority_bits(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per list the 64-bit value whose bits are set in over half of its hashes; 0 for an empty list."""
    rows = len(offsets) - 1
    sizes = np.diff(offsets)
    counts = np.zeros((rows, 64), dtype=np.int64)
    row_of = np.repeat(np.arange(rows), sizes)
    for start in range(0, len(hashes), AT_ONCE):
        part = np.ascontiguousarray(hashes[start:start + AT_ONCE]).astype("<i8", copy=False)
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        rows_here = row_of[start:start + AT_ONCE]
        firsts = np.flatnonzero(np.r_[True, rows_here[1:] != rows_here[:-1]])
        counts[rows_here[firsts]] += np.add.reduceat(bits, firsts, axis=0, dtype=np.int32)
    ones = counts * 2 > sizes[:, None]
    return np.packbits(ones.astype(np.uint8), axis=1, bitorder="little").view("<i8").reshape(rows)


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text", size: int = 3) -> DataFrame:
    """The ``keep`` columns and ``fp``, the fingerprint as a signed long. No shuffle."""
    small_batches(docs.sparkSession)
    hashed = docs.select(*keep, shingle_hashes(text_of(text), size).alias("_hashes"))

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield arrow_columns(batch, keep, fp=pa.array(majority_bits(*lists_of(batch.column("_hashes")))))

    return hashed.mapInArrow(bits, hashed.drop("_hashes").schema.add(StructField("fp", LongType())))


def linked_fingerprints(scratch: Scratch, distinct: DataFrame) -> DataFrame:
    """(a, b) links, a > b, that connect all of ``distinct`` (column fp) within 2 differing bits.

    Every fingerprint emits its 65 variants of at most one differing bit; two within 2 bits share one.
    A variant has at most 65 fingerprints around it, whatever the data, so its group is bounded: each
    is linked to the smallest of the group, and links are made distinct and verified. As all pairs
    within 2 bits share a group, the links have the same components as those pairs.
    """
    flips = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i))
    variants = distinct.select("fp", F.explode(F.transform(F.concat(F.array(F.lit(0).cast("long")), flips), lambda m: F.col("fp").bitwiseXOR(m))).alias("variant"))
    grouped = variants.withColumn("low", F.min("fp").over(Window.partitionBy("variant")))
    links = grouped.where("fp > low").select(F.col("fp").alias("a"), F.col("low").alias("b")).distinct()
    return links.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)


def grouped_fingerprints(scratch: Scratch, marked: DataFrame, order: Column) -> DataFrame:
    """(fp, first): for each fingerprint of ``marked`` the smallest ``order`` among the rows reachable over its links."""
    by_print = scratch.cut(marked.groupBy("fp").agg(F.min(order).alias("least")))
    roots = components(scratch, linked_fingerprints(scratch, by_print.select("fp")))
    grouped = by_print.join(roots, by_print.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = grouped.groupBy("root").agg(F.min("least").alias("first"))
    return scratch.cut(grouped.join(smallest, "root").select("fp", "first"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) of every row; component_id is the smallest doc_id reachable over links
    of at most 2 differing bits.

    Equal fingerprints are merged before links are sought, so a group of copies costs one fingerprint.
    Null and empty texts have fingerprint 0 and are linked like any other. A row with a null doc_id
    takes part; its component is the smallest id that is not null, null if there is none. Repeated rows
    stay repeated. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    marked = scratch.cut(fingerprints(own, ["doc_id"], "text", size))
    named = grouped_fingerprints(scratch, marked, F.col("doc_id"))
    return marked.join(named, "fp").select("doc_id", "fp", F.col("first").alias("component_id"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 3, keep_nameless: bool = True) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: that of the smallest id.

    Rows are told apart by id and text, so a repeated id loses only the rows whose own text is a copy, and
    of rows that repeat both one stays. Rows with a null doc_id stay, as no id can name their group;
    without ``keep_nameless`` they are treated like others, and stay only where a group has no id at all.
    Further columns, whatever their names, are kept as they are; an empty table stays empty.
    """
    scratch = Scratch(docs.sparkSession)
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), row_key(doc_id, text).alias("key"))
    marked = scratch.cut(fingerprints(own, ["doc_id", "key"], "text", size))
    order = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "key")
    named = grouped_fingerprints(scratch, marked, order)
    touched = marked if not keep_nameless else marked.where("doc_id is not null")

    key, loser, again = free_names(docs, "key", "loser", "again")
    other = (F.col("key") != F.col("first.key")) | ~F.col("doc_id").eqNullSafe(F.col("first.doc_id"))
    losers = touched.join(named, "fp").where(other).select(F.col("key").alias(loser), F.col("doc_id").alias(again)).distinct()
    keyed = docs.withColumn(key, row_key(doc_id, text))
    same = lambda right: (F.col(key) == F.col(loser)) & keyed[doc_id].eqNullSafe(right[again])
    losers = scratch.cut(losers)
    left = keyed.join(losers.hint("shuffle_hash"), same(losers), "left_anti")
    repeated = scratch.cut(touched.groupBy(F.col("key").alias(loser), F.col("doc_id").alias(again)).count().where("count > 1").drop("count"))
    if not repeated.isEmpty():
        once = left.join(repeated, same(repeated), "left_anti")
        left = once.unionByName(left.join(repeated, same(repeated), "left_semi").dropDuplicates([key, doc_id]))
    return left.drop(key)
