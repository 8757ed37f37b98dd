"""Benchmark decontamination by spaced-seed hashing.

A mask keeps some token positions of a span and ignores the others, so a seed still matches when an
ignored token was replaced. Test and training seeds are joined on their hashes; around each hit the
two token sequences are compared along the hit's diagonal, and an overlap counts when it is long
enough and few tokens in it differ.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resolvescope.llm.common import Scratch, free_names, let, lists_of, small_batches, split_words, text_of

MASKS = ("11101011", "1100100011", "1111111")
"""Positions that a seed keeps (1) and ignores (0). Every stretch of 13 to 25 tokens of which at least
80 % are equal, the first and last among them, holds a seed of one of these; the tests go through all."""

LEAST_ITEM = 5
"""Items of fewer tokens are no evidence of a leak and overlap with nothing; the README says how many that are."""

OVERLAP = 13
"""Tokens that an overlap covers at least; an item with fewer is matched whole."""

IDENTITY = 0.8

MARGIN = 32
"""Tokens kept on both sides of a hit for the comparison. A further hit extends them."""

BLOOM_BITS = 1 << 26
"""Bits of each of the two tables of test seeds that tasks look up: a fixed 8 MB, however many items."""

SALTS = 8

FACTOR = np.uint64(0x9E3779B97F4A7C15)


def token_hashes(text: Column) -> Column:
    """Hashes of the runs of letters and digits, lower-cased."""
    return let(split_words(F.lower(text), r"[^\p{L}\p{N}]"), lambda w: F.transform(w, lambda x: F.xxhash64(x)))


def seed_hashes(tokens: np.ndarray, mask: str, kind: int) -> np.ndarray:
    """The seed at every start where the mask's whole span fits."""
    n = max(len(tokens) - len(mask) + 1, 0)
    h = np.full(n, kind + 1, dtype=np.uint64)
    for i, kept in enumerate(mask):
        if kept == "1":
            h = (h ^ tokens[i:i + n]) * FACTOR
            h ^= h >> np.uint64(31)
    return h


def short_masks(n: int) -> list[str]:
    """Masks over a whole item of ``n`` tokens, one of which keeps none of any n // 5 replaced tokens.

    The item is cut into two blocks more than tokens may be replaced; each mask keeps two of them.
    """
    blocks = np.array_split(np.arange(n), n // 5 + 2)
    return ["".join("1" if i in kept else "0" for i in range(n)) for kept in (set(map(int, np.r_[a, b])) for a, b in combinations(blocks, 2))]


def masks_for(shortest: list[int]) -> list[tuple[str, int]]:
    """Masks with the length of the items that they are for; 0 stands for those of at least OVERLAP tokens."""
    return [*((m, 0) for m in MASKS), *((m, n) for n in sorted(set(shortest)) for m in short_masks(n))]


def _slots(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (h & np.uint64(BLOOM_BITS - 1)).astype(np.int64), (h >> np.uint64(38)).astype(np.int64) & (BLOOM_BITS - 1)


def find_overlaps(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, start, n_tokens, n_equal): the longest overlap of each pair that has one.

    An overlap is a stretch of one diagonal of at least OVERLAP tokens (all of a shorter item) of which
    at least IDENTITY are equal, a shorter item's end tokens like its others; ``start`` is its first token
    in the document. Passages keep hitting as
    long as they run on, so however long they are, the kept windows cover them.

    Documents are read once, without a shuffle: a task looks every seed up in two fixed-size bit tables
    of test seeds and passes on only windows around possible hits. The join on seed hashes is salted,
    so a passage that a third of the documents share is dealt over many tasks; only distinct diagonals
    of a window reach the comparison. Null or empty texts and items overlap with nothing; rows with a
    null doc_id are reported under null; repeated rows give one result; extra columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark)
    items = scratch.cut(
        benchmark.where(F.col(item_id).isNotNull()).select(F.col(item_id).cast("long").alias("item_id"), token_hashes(text_of(item_text)).alias("tokens"))
        .where(F.size("tokens") >= LEAST_ITEM).distinct()
    )
    # At most one length per token count below OVERLAP.
    short = [r[0] for r in items.select(F.size("tokens")).distinct().where(F.size("tokens") < OVERLAP).collect()]
    masks = masks_for(short)

    def item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, ends = lists_of(batch.column("tokens"))
            ids = batch.column("item_id").to_numpy()
            out: list[list[np.ndarray]] = [[], [], []]
            for r in range(batch.num_rows):
                tokens = values[ends[r]:ends[r + 1]].view(np.uint64)
                for kind, (mask, length) in enumerate(masks):
                    if length != (len(tokens) if len(tokens) < OVERLAP else 0):
                        continue
                    h = seed_hashes(tokens, mask, kind)
                    out[0].append(h.view(np.int64))
                    out[1].append(np.full(len(h), ids[r]))
                    out[2].append(np.arange(len(h)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c or [np.zeros(0)]).astype(np.int64)) for c in out], names=["seed", "item_id", "at"])

    seeds = scratch.cut(items.mapInArrow(item_seeds, "seed long, item_id long, at long").distinct())
    shared = spark.sparkContext.broadcast(_bit_tables(seeds))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = shared.value
        for batch in batches:
            values, ends = lists_of(batch.column("tokens"))
            found: list[tuple] = []
            for kind, (mask, _) in enumerate(masks):
                h = seed_hashes(values.view(np.uint64), mask, kind)
                one, two = _slots(h)
                at = np.flatnonzero(first[one >> 3] >> (one & 7).astype(np.uint8) & 1)
                at = at[(second[two[at] >> 3] >> (two[at] & 7).astype(np.uint8) & 1) == 1]
                row = np.searchsorted(ends, at, side="right") - 1
                at, row = (x[at + len(mask) <= ends[row + 1]] for x in (at, row))  # not over the end of a text
                found += zip(row.tolist(), at.tolist(), h[at].view(np.int64).tolist())
            found.sort()
            ids = batch.column("doc_id")
            out: list[list] = [[], [], [], [], []]
            i = 0
            while i < len(found):
                row, low = found[i][0], found[i][1]
                j = i
                while j < len(found) and found[j][0] == row and found[j][1] <= found[max(j - 1, i)][1] + MARGIN:
                    j += 1
                start, end = max(low - MARGIN, ends[row]), min(found[j - 1][1] + 2 * MARGIN, ends[row + 1])
                out[0].append(ids[row].as_py())
                out[1].append(int(start - ends[row]))
                out[2].append(values[start:end])
                out[3].append([f[2] for f in found[i:j]])
                out[4].append([int(f[1] - start) for f in found[i:j]])
                i = j
            types = [pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 3]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(out, types)], names=["doc_id", "start", "tokens", "seeds", "places"])

    schema = "doc_id long, start long, tokens array<long>, seeds array<long>, places array<long>"
    hashed = docs.select(F.col(doc_id).cast("long").alias("doc_id"), token_hashes(text_of(text)).alias("tokens"))
    kept = scratch.cut(hashed.mapInArrow(windows, schema).withColumn("window", F.xxhash64("doc_id", "start", "tokens")))
    hits = kept.select("window", F.explode(F.arrays_zip("seeds", "places")).alias("hit")).select("window", F.col("hit.seeds").alias("seed"), F.col("hit.places").alias("place"), F.pmod("window", F.lit(SALTS)).alias("salt"))
    salted = seeds.withColumn("salt", F.explode(F.array(*[F.lit(s).cast("long") for s in range(SALTS)])))
    diagonals = hits.join(salted, ["seed", "salt"]).select("window", "item_id", (F.col("place") - F.col("at")).alias("diagonal")).distinct()
    compared = diagonals.join(kept.select("window", "doc_id", "start", "tokens").dropDuplicates(["window"]), "window").join(items.withColumnRenamed("tokens", "item"), "item_id")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, ends = lists_of(batch.column("tokens"))
            item, item_ends = lists_of(batch.column("item"))
            diagonal, start = batch.column("diagonal").to_numpy(), batch.column("start").to_numpy()
            rows, out = [], [[], [], []]
            for r in range(batch.num_rows):
                best = longest_overlap(tokens[ends[r]:ends[r + 1]], item[item_ends[r]:item_ends[r + 1]], int(diagonal[r]))
                if best:
                    rows.append(r)
                    for column, value in zip(out, (int(start[r]) + best[0], best[1], best[2])):
                        column.append(value)
            taken = batch.select(["doc_id", "item_id"]).take(pa.array(rows, type=pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, *[pa.array(c, type=pa.int64()) for c in out]], names=["doc_id", "item_id", "start", "n_tokens", "n_equal"])

    found = compared.mapInArrow(verified, "doc_id long, item_id long, start long, n_tokens long, n_equal long")
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_tokens", "n_equal", (-F.col("start")).alias("late"))).alias("best"))
    return best.select("doc_id", "item_id", (-F.col("best.late")).alias("start"), "best.n_tokens", "best.n_equal")


def longest_overlap(tokens: np.ndarray, item: np.ndarray, diagonal: int) -> tuple[int, int, int] | None:
    """(start in tokens, length, equal tokens) of the longest stretch along ``tokens[i + diagonal] ~ item[i]``
    that begins and ends with equal tokens, has at least IDENTITY of them equal and is long enough. An item of
    fewer than OVERLAP tokens is taken whole, whichever of its tokens differ."""
    if len(item) < OVERLAP:
        same = int((tokens[diagonal:diagonal + len(item)] == item).sum()) if 0 <= diagonal <= len(tokens) - len(item) else 0
        return (diagonal, len(item), same) if same and same >= IDENTITY * len(item) else None
    low, high = max(0, -diagonal), min(len(item), len(tokens) - diagonal)
    if high <= low:
        return None
    equal = tokens[low + diagonal:high + diagonal] == item[low:high]
    # A stretch has the identity if its sum of (equal - IDENTITY) is not negative.
    gain = np.r_[0, np.cumsum(np.where(equal, 5 * (1 - IDENTITY), -5 * IDENTITY).round().astype(np.int64))]
    firsts, lasts = np.flatnonzero(equal), np.flatnonzero(equal) + 1
    if not len(firsts):
        return None
    # lowest[k]: the smallest gain at the first k + 1 starts; the longest stretch to an end begins at the first start that is low enough.
    lowest = np.minimum.accumulate(gain[firsts])
    begin = np.searchsorted(-lowest, -gain[lasts])
    length = lasts - firsts[np.minimum(begin, len(firsts) - 1)]
    k = int(np.argmax(length))
    if length[k] < OVERLAP:
        return None
    start = int(lasts[k] - length[k])
    return low + diagonal + start, int(length[k]), int(equal[start:lasts[k]].sum())


def _bit_tables(seeds: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The bits of all seeds in two tables, as bytes; what reaches the driver is bounded by the tables' size."""
    slot = [F.col("seed").bitwiseAND(BLOOM_BITS - 1), F.shiftrightunsigned("seed", 38).bitwiseAND(BLOOM_BITS - 1)]
    places = seeds.select(F.explode(F.array(*[F.struct(F.lit(t).alias("t"), s.alias("s")) for t, s in enumerate(slot)])).alias("p"))
    bytes_ = places.groupBy(F.col("p.t").alias("t"), F.shiftright(F.col("p.s"), 3).alias("byte")).agg(F.bit_or(F.expr("shiftleft(1, cast(p.s & 7 as int))")).alias("bits"))
    tables = np.zeros((2, BLOOM_BITS // 8), dtype=np.uint8)
    for t, byte, bits in bytes_.toLocalIterator():
        tables[t, byte] = bits
    return tables[0], tables[1]


def without_overlaps(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``docs`` whose document overlaps with no item; rows with a null id stay."""
    (overlapping,) = free_names(docs, "overlapping")
    found = Scratch(docs.sparkSession).cut(find_overlaps(docs, benchmark, doc_id, text).where("doc_id is not null").select(F.col("doc_id").alias(overlapping)).distinct())
    return docs.join(found.hint("shuffle_hash"), docs[doc_id] == F.col(overlapping), "left_anti")
