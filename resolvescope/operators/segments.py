"""Longest covering prefix of an address, by disjoint segments and an as-of lookup.

The networks of a prefix table and the addresses after them cut the address space into segments, each
with one longest covering prefix. An address belongs to the last segment that does not begin after it.
Only the prefix table is expanded over mask lengths, to name its segments; the addresses are not.

Segments are dealt into pieces at up to SPLITS of their beginnings. A row finds its piece by a binary
search in these, meets the piece's sorted segments by equality, and finds its own by another search.
Rows are never sorted or multiplied, and a crowded network only makes a hot piece, which a join on
equality can be split at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPLITS = 4096
MASK = "masklen"


def _bits(value: int) -> Column:
    return F.lit(value).cast("bigint")


def _position(family: Column, hi: Column, lo: Column) -> Column:
    """An address as text of fixed length that sorts like the address, IPv4 first: a comparison is one of bytes."""
    digits = lambda half: F.lpad(F.hex(half), 16, "0")
    return F.concat(family.cast("string"), digits(hi), digits(lo))


def _tail(length: Column) -> Column:
    """The lowest 64 - length bits, for lengths of 0 to 64."""
    return F.when(length >= 64, _bits(0)).otherwise(F.call_function("shiftrightunsigned", _bits(-1), length.cast("int")))


def _plus_one(value: Column) -> Column:
    return F.when(value == _bits((1 << 63) - 1), _bits(-(1 << 63))).otherwise(value + 1)


def segment_starts(prefixes: DataFrame) -> DataFrame:
    """(family, ip_hi, ip_lo): the first address of every network, and the one after its last."""
    known = prefixes.where(F.col(MASK).isNotNull()).select("family", F.col(MASK).cast("int").alias("length"), "net_hi", "net_lo")
    v4, length = F.col("family") == 4, F.col("length")
    last_hi = F.when(v4, F.col("net_hi")).otherwise(F.col("net_hi").bitwiseOR(_tail(F.least(length, F.lit(64)))))
    last_lo = F.col("net_lo").bitwiseOR(_tail(F.when(v4, length + 32).otherwise(F.greatest(length - 64, F.lit(0)))))
    ends = known.select("family", "net_hi", "net_lo", last_hi.alias("last_hi"), last_lo.alias("last_lo"))
    final = F.when(v4, F.col("last_lo") == 0xFFFFFFFF).otherwise((F.col("last_hi") == -1) & (F.col("last_lo") == -1))
    after_hi = F.when(~v4 & (F.col("last_lo") == -1), _plus_one(F.col("last_hi"))).otherwise(F.col("last_hi"))
    after = F.when(~final, F.struct(after_hi.alias("hi"), _plus_one(F.col("last_lo")).alias("lo")))
    begin = F.struct(F.col("net_hi").alias("hi"), F.col("net_lo").alias("lo"))
    both = ends.select("family", F.explode(F.array(begin, after)).alias("at")).where(F.col("at").isNotNull())
    return both.select("family", F.col("at.hi").alias("ip_hi"), F.col("at.lo").alias("ip_lo")).distinct()


def _splits(starts: DataFrame) -> list[str]:
    """Positions of up to SPLITS beginnings, spread evenly by hash; where they lie only shapes the pieces."""
    at = starts.select(_position(F.col("family"), F.col("ip_hi"), F.col("ip_lo")).alias("at"))
    return sorted(r[0] for r in at.orderBy(F.xxhash64("at"), "at").limit(SPLITS).collect())


def _not_after(position: Column, steps: Column, element) -> Column:
    """How many elements of a sorted sequence do not come after a position. ``element(i)`` is null beyond its end."""
    return F.aggregate(steps, F.lit(0), lambda i, step: F.when(element(i + step - 1) <= position, i + step).otherwise(i))


def _piece(position: Column, splits: list[str]) -> Column:
    if not splits:
        return F.lit(0)
    listed = F.split(F.lit(" ".join(splits)), " ")  # one literal to plan with; folded into an array before it runs
    steps = [1 << e for e in range(len(splits).bit_length() - 1, -1, -1)]
    return _not_after(position, F.array(*[F.lit(s) for s in steps]), lambda i: F.get(listed, i))


def with_longest_prefix(df: DataFrame, prefixes: DataFrame, segments, names: list[str], out: str) -> DataFrame:
    """``df`` with a struct (masklen, prefix) of the longest covering prefix of the address in columns
    ``names`` (family, hi, lo); null without one. Row multiplicity is kept.

    ``segments(starts)`` names the segments: (family, ip_hi, ip_lo, masklen, prefix).
    """
    starts = segment_starts(prefixes)
    splits = _splits(starts)
    keyed = segments(starts).select(_position(F.col("family"), F.col("ip_hi"), F.col("ip_lo")).alias("at"), MASK, "prefix")
    pieces = keyed.withColumn("_piece", _piece(F.col("at"), splits)).groupBy("_piece").agg(F.sort_array(F.collect_list(F.struct("at", MASK, "prefix"))).alias("_segments"))
    position = _position(*[F.col(n) for n in names])
    rows = df.withColumn("_at", F.when(F.col(names[0]).isNotNull(), position))
    rows = rows.withColumn("_piece", F.when(F.col("_at").isNotNull(), _piece(F.col("_at"), splits)).otherwise(-1 - F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 16)).cast("int")))
    met = rows.join(pieces, "_piece", "left")
    size = F.size("_segments")
    steps = F.transform(F.sequence(F.floor(F.log2(size)).cast("int"), F.lit(0)), lambda e: F.call_function("shiftleft", F.lit(1), e))
    count = _not_after(F.col("_at"), steps, lambda i: F.get(F.col("_segments"), i)["at"])
    found = met.withColumn("_found", F.when(F.col("_at").isNotNull() & (size > 0), F.get(F.col("_segments"), count - 1)))
    same_family = F.substring("_found.at", 1, 1) == F.substring("_at", 1, 1)
    hit = F.when(same_family & F.col(f"_found.{MASK}").isNotNull(), F.struct(F.col(f"_found.{MASK}").alias(MASK), F.col("_found.prefix").alias("prefix")))
    return found.withColumn(out, hit).select(*df.columns, out)
