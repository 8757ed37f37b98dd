"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from resolvescope.llm.common import let, lists_of, small_batches, split_words, text_of

BITS = 20
"""Features are hashed to 2^BITS coordinates."""

SAMPLE = 24_000
"""Most labelled rows that training reads, about; with fewer, all are read."""

PER_SHARD = 4_000
"""Rows of one shard, about, which a task learns from at a time; the shards' weights are averaged."""

PASSES = 5

AT_ONCE = 128
"""Rows of a shard whose features are made at a time."""

MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)
"""Odd 64-bit multipliers that set the kinds of features apart."""


@dataclass(frozen=True)
class Weights:
    """Coordinates with a weight other than zero, their weights and the intercept."""

    at: np.ndarray
    value: np.ndarray
    intercept: float

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BITS, dtype=np.float64)
        out[self.at] = self.value
        return out


STEMS = (4, 5)
"""Lengths of a word's beginnings that count as further words, so that inflected forms share a weight."""


def stem(letters: int):
    return lambda word: F.xxhash64(F.substring(word, 1, letters), F.lit(letters))


def word_hashes(text: Column) -> Column:
    """Lists of equal length: hashes of a text's words, and of the words' beginnings."""
    words = split_words(F.lower(text), r"[^\p{L}\p{N}]")
    return let(words, lambda w: F.struct(
        F.transform(w, lambda x: F.xxhash64(x)).alias("words"),
        *[F.transform(w, stem(n)).alias(f"stems{n}") for n in STEMS],
    ))


def coordinates(column: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
    """(coordinate, row) of all words, their stems, pairs of neighbours and pairs that skip one word."""
    words, offsets = lists_of(column.field(0))
    stems = [lists_of(column.field(i))[0].view(np.uint64) for i in range(1, 1 + len(STEMS))]
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    h = words.view(np.uint64)
    found, rows = [x * MIX[0] for x in (h, *stems)], [row] * (1 + len(stems))
    for gap, first, second in ((1, MIX[1], MIX[2]), (2, MIX[3], MIX[1])):
        if len(row) > gap:
            same = row[gap:] == row[:-gap]
            pair = (h[:-gap][same] * first) ^ (h[gap:][same] * second)
            found.append((pair ^ (pair >> np.uint64(29))) * MIX[0])
            rows.append(row[gap:][same])
    return (np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate(rows)


class Ftrl:
    """FTRL-proximal with a learning rate per coordinate and L1 sparsity; the last slot is the intercept."""

    def __init__(self, l1: float, alpha: float = 1.0, beta: float = 1.0, l2: float = 0.01, toxic_weight: float = 2.0):
        self.toxic_weight = toxic_weight
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = np.zeros((1 << BITS) + 1)
        self.n = np.zeros((1 << BITS) + 1)

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, label: float) -> None:
        w = self.weights(at)
        gradient = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -30, 30))) - label
        gradient *= self.toxic_weight if label else 1.0
        n = self.n[at]
        grown = n + gradient * gradient
        self.z[at] += gradient - (np.sqrt(grown) - np.sqrt(n)) / self.alpha * w
        self.n[at] = grown


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: crc32 of the id as text is divisible by 5. Null ids are not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Weights:
    """Learn from at most about ``sample`` labelled rows that are not held out.

    The sample is a fixed range of id hashes, so it does not depend on row order or partitions. Its ids
    are a bounded table; documents stream past it. Each of SHARDS tasks runs FTRL over its own rows in
    id order; the mean of the shards' weights is the model. The L1 strength is a five-hundredth of a shard's
    rows, at least 2 and at most 8: a coordinate needs evidence in proportion to the rows to get a weight. Labels that are null or other than 0 and 1,
    null ids and ids without a document teach nothing; without labels every weight is 0.
    """
    spark = docs.sparkSession
    small_batches(spark)
    usable = (
        labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_label")).where("_id is not null and _label in (0, 1)")
        .groupBy("_id").agg(F.max("_label").alias("_label")).where(~held_out(F.col("_id"))).withColumn("_order", F.xxhash64("_id"))
    )
    known = usable.count()
    if known > sample:
        usable = usable.where(F.pmod("_order", F.lit(1 << 32)) < int(sample / known * (1 << 32)))
    own = docs.select(F.col(doc_id).alias("_doc"), text_of(text).alias("_text"))
    rows = own.join(F.broadcast(usable), F.col("_doc") == F.col("_id")).select("_order", "_label", word_hashes(F.col("_text")).alias("_words"))
    shards = max(1, round(min(known, sample) / PER_SHARD))
    rows = rows.withColumn("_shard", F.pmod(F.shiftright("_order", 32), F.lit(shards)))

    def learn(shard: pa.Table) -> pa.Table:
        order = np.argsort(shard.column("_order").to_numpy())
        examples = []
        for start in range(0, len(order), AT_ONCE):
            batch = shard.take(pa.array(order[start:start + AT_ONCE])).combine_chunks().to_batches()[0]
            at, row = coordinates(batch.column("_words"))
            truth = batch.column("_label").to_numpy()
            both = np.unique(row << BITS | at)
            ends = np.searchsorted(both >> BITS, np.arange(len(truth) + 1))
            own = (both & ((1 << BITS) - 1)).astype(np.int32)
            examples += [(np.append(own[ends[i]:ends[i + 1]], np.int32(1 << BITS)), float(y)) for i, y in enumerate(truth)]
        model = Ftrl(l1=min(8.0, max(2.0, len(examples) / 500)))
        for _ in range(PASSES):
            for features, y in examples:
                model.learn(features, y)
        w = model.weights(slice(None))
        used = np.flatnonzero(w)
        # The row count of the shard stands at -1: shards weigh in by their rows.
        return pa.table({"at": np.append(used, -1), "value": np.append(w[used] * len(examples), len(examples))})

    learned = rows.groupBy("_shard").applyInArrow(learn, "at long, value double")
    sums = learned.groupBy("at").agg(F.sum("value").alias("value")).collect()  # at most 2^BITS + 2 rows
    total = {r["at"]: r["value"] for r in sums}
    seen = max(total.pop(-1, 0.0), 1.0)
    intercept = total.pop(1 << BITS, 0.0) / seen
    at = np.array(sorted(total), dtype=np.int64)
    return Weights(at, np.array([total[i] / seen for i in at]), intercept)


def score(docs: DataFrame, weights: Weights, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` in 0..1, from the whole text alone. No shuffle; null and empty texts get the
    score of the intercept. Only hashes go to Python; the rows themselves stay where they are."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(weights)

    @F.arrow_udf(DoubleType())
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = shared.value.dense()
        for words in batches:
            at, row = coordinates(words)
            telling = table[at] != 0
            both = np.unique(row[telling] << BITS | at[telling])
            total = np.bincount(both >> BITS, weights=table[both & ((1 << BITS) - 1)], minlength=len(words)) + shared.value.intercept
            yield pa.array(1.0 / (1.0 + np.exp(-np.clip(total, -30, 30))))

    return docs.withColumn("score", scored(word_hashes(text_of(text))))


def toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``.

    A null or empty text has the score of the intercept alone. A null doc_id is scored like any other row and
    is never held out. Repeated rows stay; an empty table gives no rows; without usable labels every score
    is 0.5. Columns other than id and text are neither read nor returned, whatever their names.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    scored = score(own, train(own, labels.withColumnRenamed(doc_id, "doc_id")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Rows of ``docs`` that score below ``threshold``, with their own columns."""
    names = docs.columns
    weights = train(docs, labels, doc_id, text)
    return score(docs.select(F.struct(*names).alias("_row"), text_of(text).alias("_text")), weights, "_text").where(F.col("score") < threshold).select("_row.*")
