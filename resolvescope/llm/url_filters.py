"""URL filters: host and path rules, then a listed-URL test by blocked Bloom filter and exact join."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resolvescope.llm.common import Scratch, ascii_lower

WORDS = 8
"""64-bit words of one block: a key touches one block of 512 bits, one cache line."""

PROBES = 6


def url_host(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return ascii_lower(F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def canonical_url(host: Column, path: Column) -> Column:
    """Host without ``www.`` and path without closing slashes; query and fragment are left out."""
    return F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, "/+$", ""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule (verdict, host, path) that fits, nulls if none does."""
    rule = verdict = F.lit(None).cast("string")
    # A later WHEN wraps an earlier one, so the longest comes last.
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        rule = F.when(fits, F.lit(rule_host + rule_path)).otherwise(rule)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


class BlockedBloom:
    """A Bloom filter of 512-bit blocks, built by a Spark aggregation and probed in numpy.

    Its size follows the number of keys up to ``most_bits``, the proven bound of what is collected and
    broadcast. Beyond that only the share of false positives grows; the exact join removes them.
    """

    def __init__(self, keys: DataFrame, most_bits: int = 1 << 26, bits_per_key: int = 16):
        spark = keys.sparkSession
        n = keys.count()
        blocks = 1
        while blocks * WORDS * 64 < min(n * bits_per_key, most_bits):
            blocks *= 2
        self.blocks = blocks
        first, second = F.xxhash64("key"), F.xxhash64(F.lit(1), "key")
        bits = F.array(*[F.shiftrightunsigned(second, 9 * i).bitwiseAND(511) for i in range(PROBES)])
        words = (
            keys.select(first.bitwiseAND(blocks - 1).alias("block"), F.explode(bits).alias("bit"))
            .select((F.col("block") * WORDS + F.shiftright("bit", 6)).alias("word"), F.expr("shiftleft(1L, cast(bit & 63 as int))").alias("mask"))
            .groupBy("word").agg(F.bit_or("mask").alias("mask"))
        )
        table = np.zeros(blocks * WORDS, dtype=np.int64)
        for word, mask in words.toLocalIterator():  # at most most_bits / 64 rows
            table[word] = mask
        self.table = spark.sparkContext.broadcast(table)

    def may_hold(self, key: Column) -> Column:
        """True for every key of the filter, and for few others."""
        blocks, shared = self.blocks, self.table

        @F.pandas_udf("boolean")
        def probe(first: pd.Series, second: pd.Series) -> pd.Series:
            table = shared.value
            block = (first.to_numpy() & (blocks - 1)) * WORDS
            bits = second.to_numpy().view(np.uint64)
            found = np.ones(len(block), dtype=bool)
            for i in range(PROBES):
                bit = ((bits >> np.uint64(9 * i)) & np.uint64(511)).astype(np.int64)
                found &= (table[block + (bit >> 6)] >> (bit & 63)) & 1 == 1
            return pd.Series(found)

        return probe(F.xxhash64(key), F.xxhash64(F.lit(1), key))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], listed: DataFrame, keep: list[str], url: str = "url") -> DataFrame:
    """One row per page: the ``keep`` columns, ``host``, ``path``, ``rule`` and ``verdict``.

    A rule that fits decides. Of the other pages those whose canonical URL is in ``listed`` (column
    ``canonical``) are blocked: the Bloom filter lets possible hits pass, a hash join on the distinct
    list decides them. Rows that the filter turns away are never shuffled; a URL that many pages share
    only makes a skewed probe side, which adaptive execution splits. ``pages`` and ``listed`` are read once.

    A null url or one without ``://`` has empty host and path, fits no rule and is allowed. Repeated
    rows stay; an empty list allows what no rule blocks; columns not in ``keep`` are dropped.
    """
    parts = pages.select(*keep, url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = parts.withColumn("rule", rule).withColumn("verdict", verdict).withColumn("_canonical", canonical_url(F.col("host"), F.col("path")))
    scratch = Scratch(pages.sparkSession)
    exact = scratch.cut(listed.select(F.col("canonical").alias("key")).where("key <> ''").distinct())
    bloom = BlockedBloom(exact)
    open_rows = F.col("verdict").isNull()
    # Written once, without the pages' other columns: what the filter lets pass and what it turns away are two readings of it.
    probed = scratch.cut(judged.withColumn("_maybe", open_rows & bloom.may_hold(F.col("_canonical"))).withColumn("_canonical", F.when(F.col("_maybe"), F.col("_canonical"))))
    settled = probed.where(~F.col("_maybe")).withColumn("verdict", F.coalesce("verdict", F.lit("allow"))).drop("_canonical", "_maybe")
    hits = (
        probed.where("_maybe").join(exact, F.col("_canonical") == F.col("key"), "left")
        .withColumn("verdict", F.when(F.col("key").isNotNull(), "block").otherwise("allow"))
        .drop("_canonical", "_maybe", "key")
    )
    return settled.unionByName(hits)
