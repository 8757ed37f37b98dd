"""Token counts by byte-pair merging with a heap and a linked list; no token ids are made.

A text is cut at special strings (one token each) and then into pre-tokens. Each pre-token starts as
one symbol per UTF-8 byte; the adjacent pair of lowest rank is popped from a heap and merged until
none is left. Its count is the number of symbols minus the number of merges.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resolvescope.llm.common import small_batches, text_of

# The pre-token pattern of byte-level vocabularies.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"

REMEMBERED = 200_000
"""Pre-tokens whose counts a Python worker keeps; the store is emptied when it is full."""

LONGEST_REMEMBERED = 64


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


def load_merges(path: str) -> tuple[dict[tuple[int, int], tuple[int, int]], list[str]]:
    """Merge table of a byte-level BPE file: (left, right) -> (rank, merged), symbols numbered from the
    256 bytes on; and the special strings that count as one token."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    if model.get("normalizer") or model["model"].get("ignore_merges") or model["pre_tokenizer"].get("add_prefix_space"):
        raise ValueError("only byte-level vocabularies without normaliser and prefix space are counted here")
    numbers = {symbol: byte for byte, symbol in byte_symbols().items()}
    table = {}
    for rank, merge in enumerate(model["model"]["merges"]):
        left, right = merge if isinstance(merge, list) else merge.split(" ")
        merged = numbers.setdefault(left + right, len(numbers))
        table[numbers[left], numbers[right]] = (rank, merged)
    return table, [t["content"] for t in model["added_tokens"]]


def count_merged(symbols: bytes, merges: dict[tuple[int, int], tuple[int, int]]) -> int:
    """Symbols left of one pre-token when no pair can be merged any more."""
    n = len(symbols)
    if n < 2:
        return n
    at = list(symbols)
    following = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        found = merges.get((at[i], at[i + 1]))
        if found:
            heap.append((found[0], i, found[1], i + 1))
    heapq.heapify(heap)
    left = n
    while heap:
        rank, i, merged, j = heapq.heappop(heap)
        # The pair may have been merged into something else meanwhile.
        if at[i] < 0 or following[i] != j or at[j] < 0 or merges.get((at[i], at[j]), (-1,))[0] != rank:
            continue
        at[i], at[j] = merged, -1
        k = following[i] = following[j]
        left -= 1
        if k < n:
            before[k] = i
            found = merges.get((merged, at[k]))
            if found:
                heapq.heappush(heap, (found[0], i, found[1], k))
        h = before[i]
        if h >= 0:
            found = merges.get((at[h], merged))
            if found:
                heapq.heappush(heap, (found[0], h, found[1], i))
    return left


class Counts(dict):
    """Counts of pre-tokens, computed when first asked for."""

    def __init__(self, merges):
        super().__init__()
        self.merges = merges

    def __missing__(self, token: str) -> int:
        count = count_merged(token.encode("utf-8"), self.merges)
        if len(token) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.clear()
            self[token] = count
        return count


def text_counter(merges, specials: list[str]):
    """A function from a text to its number of tokens."""
    pattern = regex.compile(PRE_TOKENS)
    special = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True)))) if specials else None
    counts = Counts(merges)

    def plain(text: str) -> int:
        return sum(map(counts.__getitem__, pattern.findall(text)))

    def count(text: str) -> int:
        if special is None or not special.search(text):
            return plain(text)
        return sum(map(plain, special.split(text))) + len(special.findall(text))

    return count


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 512, text: str = "text") -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_tokens`` and ``over_limit`` (more tokens than ``limit``).

    ``vocabulary`` is the path of a byte-level BPE file on the driver; its merge table (as large as the
    file, not as the data) is broadcast. No shuffle. Null and empty texts count 0. Whole texts are
    counted, however long; rows keep their own columns, of which those of the three names are replaced.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(load_merges(vocabulary))

    @F.pandas_udf("long")
    def n_tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = text_counter(*shared.value)
        for texts in batches:
            yield pd.Series([count(t) for t in texts], dtype="int64")

    out = docs.withColumn("n_bytes", F.octet_length(text_of(text)).cast("long")).withColumn("n_tokens", n_tokens(text_of(text)))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
