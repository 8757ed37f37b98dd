"""IP-in-prefix containment without range joins.

An address lies in a prefix exactly when masking it to the prefix length gives the prefix's network.
The prefix table is expanded by that rule, over the lengths that occur in it, to find which prefixes
cover which; addresses are looked up in the disjoint segments that follow from it
(``resolvescope.operators.segments``), one row each. There is no range condition and no nested loop.

Covering prefixes nest: all prefixes that cover an address are the longest one and its
ancestors. Reports use that. They look up the longest match once per address and take
everything else from a per-prefix table built over ancestors, so the expensive side never
carries more than one row per address.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from resolvescope.functions.net import key_names, masked
from resolvescope.operators.segments import with_longest_prefix

IP_KEY = ["family", "ip_hi", "ip_lo"]
NET_KEY = ["family", "masklen", "net_hi", "net_lo"]


def mask_lengths(prefixes: DataFrame) -> DataFrame:
    """One row, one struct (v4, v6): the lengths that occur, at most 33 and 129 of them."""
    seen = lambda family: F.array_sort(F.collect_set(F.when(F.col("family") == family, F.col("masklen").cast("int"))))
    return prefixes.agg(F.struct(seen(4).alias("v4"), seen(6).alias("v6")).alias("lens"))


def expand_networks(ips: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Each address row repeated once per mask length of its family, with the network key.

    The lengths come in as a scalar subquery, so there is no join and nothing on the driver.
    """
    lens = ips.withColumn("_lens", mask_lengths(prefixes).scalar())
    own = F.when(F.col("family") == 4, F.col("_lens.v4")).when(F.col("family") == 6, F.col("_lens.v6"))
    expanded = lens.withColumn("masklen", F.explode(own)).drop("_lens")
    net_hi, net_lo = masked(F.col("family"), F.col("ip_hi"), F.col("ip_lo"), F.col("masklen"))
    return expanded.withColumns({"net_hi": net_hi, "net_lo": net_lo})


def _prefix_side(prefixes: DataFrame, keep: list[str]) -> DataFrame:
    return prefixes.where(F.col("masklen").isNotNull()).select(*NET_KEY[:1], F.col("masklen").cast("int"), *NET_KEY[2:], *keep)


def _named_segments(prefixes: DataFrame):
    """Names the segments of ``prefixes``: their longest covering prefix, by hash joins over mask lengths."""

    def named(starts: DataFrame) -> DataFrame:
        texts = _prefix_side(prefixes, ["prefix"]).groupBy(*NET_KEY).agg(F.min("prefix").alias("prefix"))
        covering = expand_networks(starts, prefixes).join(texts, NET_KEY)
        longest = covering.groupBy(*IP_KEY).agg(F.max(F.struct("masklen", "prefix")).alias("longest"))
        return starts.join(longest, IP_KEY, "left").select(*IP_KEY, "longest.*")

    return named


def with_match(df: DataFrame, prefixes: DataFrame, out: str, ip_col: str = "ip") -> DataFrame:
    """``df`` with a struct (masklen, prefix) of the longest prefix that covers an address column; null without one."""
    return with_longest_prefix(df, prefixes, _named_segments(prefixes), key_names(ip_col), out)


def _network_of(match: str, names: list[str]) -> list[Column]:
    """NET_KEY columns of an address's longest match."""
    family, hi, lo = (F.col(n) for n in names)
    length = F.col(f"{match}.masklen")
    net_hi, net_lo = masked(family, hi, lo, length)
    return [family.alias("family"), length.alias("masklen"), net_hi.alias("net_hi"), net_lo.alias("net_lo")]


def prefix_join(ips: DataFrame, prefixes: DataFrame, how: str = "inner") -> DataFrame:
    """All (address, covering prefix) pairs, or the semi / anti form on the address rows.

    ``ips`` needs family, ip_hi, ip_lo; ``prefixes`` needs prefix, family, masklen, net_hi,
    net_lo. Columns of the prefix side other than its key are carried along. An address is looked up
    once; its longest prefix brings the others, which are the ancestors of that one.
    """
    if how not in ("inner", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type {how!r}")
    matched = with_match(ips, prefixes, "_match")
    if how != "inner":
        covered = F.col("_match").isNotNull()
        return matched.where(covered if how == "left_semi" else ~covered).drop("_match")
    carried = [c for c in prefixes.columns if c not in NET_KEY and c not in ips.columns]
    side = _prefix_side(prefixes, carried)
    own = matched.where(F.col("_match").isNotNull()).withColumn("_longest", F.struct(*_network_of("_match", IP_KEY))).drop("_match")
    return own.join(_network_ancestors(prefixes), "_longest").drop("_longest").join(side, NET_KEY)


def _network_ancestors(prefixes: DataFrame) -> DataFrame:
    """(_longest, masklen, net_hi, net_lo): every distinct network with all networks that cover it, itself included."""
    networks = _prefix_side(prefixes, []).distinct()
    below = networks.select(F.struct(*NET_KEY).alias("_longest"), "family", F.col("net_hi").alias("ip_hi"), F.col("net_lo").alias("ip_lo"))
    above = expand_networks(below, prefixes).where(F.col("masklen") <= F.col("_longest.masklen"))
    return above.join(networks, NET_KEY, "left_semi").select("_longest", *NET_KEY[1:])


def longest_match(ips: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(family, ip_hi, ip_lo, masklen, net_hi, net_lo): the most specific covering prefix of
    each distinct address, as its key."""
    keys = ips.select(*IP_KEY).where(F.col("family").isNotNull()).distinct()
    found = with_match(keys, prefixes, "_match").where(F.col("_match").isNotNull())
    return found.select(*IP_KEY, *_network_of("_match", IP_KEY)[1:])


def with_prefix_match(
    df: DataFrame, prefixes: DataFrame, ip_col: str = "ip", flag: str = "matched", out: str = "match_prefix"
) -> DataFrame:
    """Add a containment flag and the most specific covering prefix for one address column."""
    found = with_match(df, prefixes, "_match", ip_col)
    return found.withColumn(out, F.col("_match.prefix")).withColumn(flag, F.col("_match").isNotNull()).drop("_match")


def with_cover_flag(df: DataFrame, prefixes: DataFrame, flag: str = "covered") -> DataFrame:
    """Add whether any prefix covers the row's address; row multiplicity is kept."""
    return with_match(df, prefixes, "_match").withColumn(flag, F.col("_match").isNotNull()).drop("_match")


def ancestor_pairs(prefixes: DataFrame) -> DataFrame:
    """(prefix, ancestor): each prefix with every prefix that covers it, itself included."""
    below = prefixes.select(
        "prefix",
        "family",
        F.col("net_hi").alias("ip_hi"),
        F.col("net_lo").alias("ip_lo"),
        F.col("masklen").alias("own_len"),
    )
    above = _prefix_side(prefixes, ["prefix"]).withColumnRenamed("prefix", "ancestor")
    return (
        expand_networks(below, prefixes)
        .where(F.col("masklen") <= F.col("own_len"))
        .join(above, NET_KEY)
        .select("prefix", "ancestor", F.col("masklen").alias("ancestor_len"))
    )


def covering_prefixes(ips: DataFrame, prefixes: DataFrame, k: int = 10) -> DataFrame:
    """The k most specific covering prefixes per address, ranked from 1.

    An address has at most one covering prefix per length, so each ranked group is at most 129 rows.
    """
    order = Window.partitionBy(*IP_KEY).orderBy(F.col("masklen").desc(), F.col("prefix"))
    return (
        prefix_join(ips.dropDuplicates(IP_KEY), prefixes)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
    )
