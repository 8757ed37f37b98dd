"""Address and prefix keys as columns.

An address is (family, ip_hi, ip_lo): IPv4 keeps ip_hi = 0 and the unsigned 32-bit value in
ip_lo, IPv6 keeps the high and low 64 bits. A prefix adds masklen and stores its network in
net_hi, net_lo. Text of both families is read and written by column expressions, so nothing leaves
the engine.
"""

from __future__ import annotations

import ipaddress
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITESPACE = " \t\n\r\x0b\x0c"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
V4_PATTERN = rf"^{OCTET}(?:\.{OCTET}){{3}}$"
V4_PREFIX_PATTERN = rf"^{OCTET}(?:\.{OCTET}){{3}}(?:/(?:[0-9]|[12][0-9]|3[0-2]))?$"

# Special-purpose address blocks that are not globally reachable, and the
# blocks inside them that are (IANA special-purpose address registries).
NOT_GLOBAL = (
    "0.0.0.0/8",
    "10.0.0.0/8",
    "100.64.0.0/10",
    "127.0.0.0/8",
    "169.254.0.0/16",
    "172.16.0.0/12",
    "192.0.0.0/24",
    "192.0.2.0/24",
    "192.168.0.0/16",
    "198.18.0.0/15",
    "198.51.100.0/24",
    "203.0.113.0/24",
    "240.0.0.0/4",
    "::/128",
    "::1/128",
    "64:ff9b:1::/48",
    "100::/64",
    "2001::/23",
    "2001:db8::/32",
    "2002::/16",
    "fc00::/7",
    "fe80::/10",
)
GLOBAL_EXCEPTIONS = (
    "192.0.0.9/32",
    "192.0.0.10/32",
    "2001:1::1/128",
    "2001:1::2/128",
    "2001:3::/32",
    "2001:4:112::/48",
    "2001:20::/28",
    "2001:30::/28",
)


def strip(col: Column) -> Column:
    """Trim every kind of surrounding whitespace, not only blanks."""
    return F.btrim(col.cast("string"), F.lit(WHITESPACE))


def _shl(value: Column, bits: Column) -> Column:
    return F.call_function("shiftleft", value, bits.cast("int"))


def _shr(value: Column, bits: Column) -> Column:
    return F.call_function("shiftright", value, bits.cast("int"))


def is_v4_text(col: Column) -> Column:
    return col.rlike(V4_PATTERN)


def _from_octets(octets: Column) -> Column:
    value = F.lit(0).cast("bigint")
    for i in range(4):
        value = value + F.get(octets, F.lit(i)).cast("bigint") * (1 << (8 * (3 - i)))
    return value


def v4_number(col: Column) -> Column:
    """Dotted IPv4 text to its unsigned value; anything else is null."""
    return F.when(is_v4_text(col), _from_octets(F.split(col, r"\.")))


def v4_text(number: Column) -> Column:
    """Unsigned IPv4 value to dotted text."""
    number = number.cast("bigint")
    octets = [F.shiftright(number, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)]
    return F.concat_ws(".", *octets)


def masked(family: Column, hi: Column, lo: Column, masklen: Column) -> tuple[Column, Column]:
    """Network (hi, lo) of an address at a mask length, with 64-bit shift guards."""
    v4 = family == 4
    tail4 = 32 - masklen
    tail6 = 64 - masklen
    tail6_low = 128 - masklen
    net_hi = (
        F.when(v4 | (masklen <= 0), F.lit(0).cast("bigint"))
        .when(masklen >= 64, hi)
        .otherwise(_shl(_shr(hi, tail6), tail6))
    )
    net_lo = (
        F.when(v4, _shl(_shr(lo, tail4), tail4))
        .when(masklen <= 64, F.lit(0).cast("bigint"))
        .otherwise(_shl(_shr(lo, tail6_low), tail6_low))
    )
    return net_hi, net_lo


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= (1 << 63) else value


def _halves(number: int) -> tuple[int, int]:
    return _signed(number >> 64), _signed(number & 0xFFFFFFFFFFFFFFFF)


# ---- IPv6 text, in the engine -------------------------------------------------------------------

HEXTET = "[0-9a-f]{1,4}"
V6_PATTERN = f"^(?:{HEXTET}:){{7}}{HEXTET}$"
V6_SHORT_PATTERN = f"^(?:{HEXTET}(?::{HEXTET}){{0,6}})?::(?:{HEXTET}(?::{HEXTET}){{0,6}})?$"
LONGEST_V6 = 45
"""Characters of an address at most: six hextets and an IPv4 tail."""


def _hextets(value: Column, shifts: tuple[int, ...]) -> list[Column]:
    return [F.lower(F.hex(F.shiftrightunsigned(value, s).bitwiseAND(0xFFFF))) for s in shifts]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once. As a lambda variable it is never written out into the
    places that use it, so expressions over many steps stay as long as they look."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _joined(parts: list[Column]) -> list[Column]:
    return [x for part in parts for x in (part, F.lit(":"))][:-1]


def v6_halves(text: Column) -> Column:
    """Struct (hi, lo) of the 64-bit halves of IPv6 text; null for anything that is not an address.

    An IPv4 tail becomes two hextets and ``::`` as many zeros as are missing, so that eight are left.
    """

    def without_tail(low: Column) -> Column:
        tail = F.regexp_extract(low, rf":({OCTET}(?:\.{OCTET}){{3}})$", 1)

        def replaced(tail: Column) -> Column:
            pair = _let(v4_number(tail), lambda n: F.concat(*_joined([F.lower(F.hex(F.shiftright(n, 16))), F.lower(F.hex(n.bitwiseAND(0xFFFF)))])))
            return F.when(tail != "", F.concat(F.substring(low, F.lit(1), F.length(low) - F.length(tail)), pair))

        return F.when(low.contains("."), _let(tail, replaced)).otherwise(low)

    def hextets(full: Column) -> Column:
        gap = F.instr(full, "::")
        sides = lambda at: F.struct(
            F.array_remove(F.split(F.substring(full, F.lit(1), at - 1), ":"), "").alias("left"), F.array_remove(F.split(F.substring(full, at + 2, F.length(full)), ":"), "").alias("right"))
        filled = lambda s: F.when(F.size(s["left"]) + F.size(s["right"]) < 8, F.concat(s["left"], F.array_repeat(F.lit("0"), 8 - F.size(s["left"]) - F.size(s["right"])), s["right"]))
        return F.when(full.rlike(V6_PATTERN), F.split(full, ":")).when(full.rlike(V6_SHORT_PATTERN), _let(_let(gap, sides), filled))

    def halves(eight: Column) -> Column:
        half = lambda start: F.conv(F.array_join(F.transform(F.slice(eight, start, 4), lambda h: F.lpad(h, 4, "0")), ""), 16, -10).cast("bigint")
        return F.when(eight.isNotNull(), F.struct(half(1).alias("hi"), half(5).alias("lo")))

    low = F.when(text.contains(":") & (F.length(text) <= LONGEST_V6), F.translate(text, "ABCDEF", "abcdef"))
    return _let(_let(_let(low, without_tail), hextets), halves)


def v6_text(hi: Column, lo: Column) -> Column:
    """Canonical text of an IPv6 address: hextets without leading zeros, the longest run of two or more
    zeros (the first of equal ones) as ``::``, an IPv4-mapped address with its IPv4 text."""

    def shortened(text: Column) -> Column:
        short = text
        for zeros in range(2, 9):  # the longest is asked for first
            run = ":" + "0:" * zeros
            at = F.instr(text, run)
            short = F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), F.lit("::"), F.substring(text, at + len(run), F.length(text)))).otherwise(short)
        return F.regexp_replace(F.regexp_replace(short, "^:(?!:)", ""), "(?<!:):$", "")

    shifts = (48, 32, 16, 0)
    mapped = (hi == 0) & (F.shiftrightunsigned(lo, 32) == 0xFFFF)
    long = F.concat(F.lit(":"), *_joined(_hextets(hi, shifts) + _hextets(lo, shifts)), F.lit(":"))
    return F.when(mapped, F.concat(F.lit("::ffff:"), v4_text(lo.bitwiseAND(0xFFFFFFFF)))).when(hi.isNotNull(), _let(long, shortened))


def mask_length(text: Column, family: Column) -> Column:
    """Length that stands after the slash of a prefix: digits, or for IPv4 also a netmask or host mask; null if it is none."""
    digits = F.when(text.rlike("^[0-9]+$"), F.regexp_replace(text, "^0+(?=[0-9])", ""))
    most = F.when(family == 4, 32).otherwise(128)
    number = F.when(F.length(digits) <= 3, digits.cast("int"))
    mask = v4_number(text)
    rest = F.lit(0xFFFFFFFF) - mask
    dotted = F.when(rest.bitwiseAND(rest + 1) == 0, 32 - F.bit_count(rest)).when(mask.bitwiseAND(mask + 1) == 0, 32 - F.bit_count(mask))
    return F.when(number <= most, number).when((family == 4) & mask.isNotNull(), dotted)


def with_ip_key(df: DataFrame, col: str = "ip", out: str = "ip", v6: bool = True) -> DataFrame:
    """Canonical address text in ``out`` plus family and (ip_hi, ip_lo) columns.

    Text that is not an address gives null in all four. Key columns are named ``family, ip_hi,
    ip_lo`` for ``out="ip"`` and ``<out>_family, <out>_hi, <out>_lo`` otherwise. Pass
    ``v6=False`` for feeds that carry IPv4 only; other text then gives nulls without being looked at.
    """
    names = key_names(out)
    # The split text is a column of its own so that it is computed once per row, and "is it an
    # address" stays one pattern match when a later filter is pushed below this projection.
    text, octets = F.col("_text"), F.col("_octets")
    split = df.withColumn("_text", strip(F.col(col))).withColumn("_octets", F.when(is_v4_text(text), F.split(text, r"\.")))
    v4 = octets.isNotNull()
    fields = {
        "ip": F.when(v4, text),
        "family": F.when(v4, F.lit(4).cast("tinyint")),
        "hi": F.when(v4, F.lit(0).cast("bigint")),
        "lo": F.when(v4, _from_octets(octets)),
    }
    if v6:
        split = split.withColumn("_v6", v6_halves(text))
        hi, lo = F.col("_v6.hi"), F.col("_v6.lo")
        other = {"ip": v6_text(hi, lo), "family": F.when(F.col("_v6").isNotNull(), F.lit(6).cast("tinyint")), "hi": hi, "lo": lo}
        fields = {n: c.otherwise(other[n]) for n, c in fields.items()}
    columns = dict(zip([out, *names], fields.values()))
    return split.withColumns(columns).drop("_text", "_octets", "_v6")


def key_names(out: str = "ip") -> list[str]:
    """Names of the key columns belonging to an address column."""
    return ["family", "ip_hi", "ip_lo"] if out == "ip" else [f"{out}_family", f"{out}_hi", f"{out}_lo"]


def with_prefix_key(df: DataFrame, col: str = "prefix", out: str = "prefix", v6: bool = True) -> DataFrame:
    """Canonical prefix text in ``out`` (host bits cleared, bare address = host route) with
    ``family, masklen, net_hi, net_lo``; text that is not a prefix gives nulls."""
    text, parts, length, network = (F.col(n) for n in ("_text", "_parts", "_length", "_network"))
    # One column per parsing step: each is computed once per row, however many fields use it.
    split = df.withColumn("_text", strip(F.col(col)))
    split = split.withColumn("_parts", F.when(text.rlike(V4_PREFIX_PATTERN), F.split(text, "[./]")))
    split = split.withColumn("_length", F.when(parts.isNotNull(), F.coalesce(F.get(parts, F.lit(4)).cast("int"), F.lit(32))))
    split = split.withColumn("_network", _shl(_shr(_from_octets(parts), 32 - length), 32 - length))
    v4 = parts.isNotNull()
    fields = {
        "prefix": F.when(v4, F.concat(v4_text(network), F.lit("/"), length.cast("string"))),
        "family": F.when(v4, F.lit(4).cast("tinyint")),
        "masklen": F.when(v4, length),
        "hi": F.when(v4, F.lit(0).cast("bigint")),
        "lo": F.when(v4, network),
    }
    if v6:
        split = split.withColumn("_other", other_prefix(F.when(parts.isNull() & (text != ""), text)))
        fields = {n: c.otherwise(F.col(f"_other.{n}")) for n, c in fields.items()}
    lead = "" if out == "prefix" else f"{out}_"
    columns = dict(zip([out, f"{lead}family", f"{lead}masklen", f"{lead}net_hi", f"{lead}net_lo"], fields.values()))
    return split.withColumns(columns).drop("_text", "_parts", "_length", "_network", "_other")


def other_prefix(text: Column) -> Column:
    """Struct (prefix, family, masklen, hi, lo) of prefix text that is not plain IPv4: IPv6, IPv4 with a
    mask or a padded length. Null for anything that is not a prefix; a zone is left out, as a network has none."""
    no = F.lit(0).cast("bigint")

    def address(split: Column) -> Column:
        v4 = v4_number(split["address"])
        v6 = v6_halves(F.regexp_replace(split["address"], "(?<=.)%[^%]+$", ""))
        return _let(F.struct(v4.alias("v4"), v6.alias("v6"), split["mask"].alias("mask")), measured)

    def measured(a: Column) -> Column:
        family = F.when(a["v4"].isNotNull(), 4).when(a["v6"].isNotNull(), 6)
        bare = F.when(family == 4, 32).otherwise(128)
        length = F.when(a["mask"].isNull(), bare).otherwise(mask_length(a["mask"], family))
        low = F.coalesce(a["v4"], a["v6"]["lo"])
        return _let(F.struct(family.alias("family"), length.alias("length"), F.coalesce(a["v6"]["hi"], no).alias("hi"), low.alias("lo")), network)

    def network(k: Column) -> Column:
        hi, lo = masked(k["family"], k["hi"], k["lo"], k["length"])
        known = k["family"].isNotNull() & k["length"].isNotNull()
        return _let(F.when(known, F.struct(k["family"].alias("family"), k["length"].alias("length"), hi.alias("hi"), lo.alias("lo"))), shown)

    def shown(n: Column) -> Column:
        text = F.when(n["family"] == 4, v4_text(n["lo"])).otherwise(v6_text(n["hi"], n["lo"]))
        return F.when(n.isNotNull(), F.struct(
            F.concat(text, F.lit("/"), n["length"].cast("string")).alias("prefix"), n["family"].cast("tinyint").alias("family"), n["length"].cast("int").alias("masklen"), n["hi"].alias("hi"), n["lo"].alias("lo")))

    slash = F.instr(text, "/")
    parts = F.struct(F.when(slash > 0, F.substring(text, F.lit(1), slash - 1)).otherwise(text).alias("address"), F.when(slash > 0, F.substring(text, slash + 1, F.length(text))).alias("mask"))
    return _let(parts, address)


def canonical_prefix(df: DataFrame, col: str, v6: bool = True) -> DataFrame:
    """Replace prefix text by its canonical form, without keeping the key columns."""
    kept = df.columns if col in df.columns else [*df.columns, col]
    return with_prefix_key(df, col, out="_canon", v6=v6).withColumn(col, F.col("_canon")).select(*kept)


def prefix_ranges(prefixes: DataFrame) -> DataFrame:
    """Distinct IPv4 prefixes as inclusive [start, end] integer ranges."""
    size = _shl(F.lit(1).cast("bigint"), 32 - F.col("masklen"))
    return (
        prefixes.where(F.col("family") == 4)
        .select("prefix", F.col("net_lo").alias("start"), (F.col("net_lo") + size - 1).alias("end"))
        .distinct()
    )


def to_slash24(col: Column) -> Column:
    """IPv4 text to the text of its /24."""
    return F.regexp_replace(col, r"\.\d+$", ".0/24")


def masklen_text(prefix: Column) -> Column:
    """Mask length of canonical prefix text."""
    return F.substring_index(prefix, "/", -1).cast("int")


def family_of(text: Column) -> Column:
    """4 or 6 for canonical address or prefix text."""
    return F.when(text.contains(":"), 6).otherwise(4).cast("tinyint")


def _inside(block: str, family: Column, hi: Column, lo: Column) -> Column:
    network = ipaddress.ip_network(block)
    net_hi, net_lo = _halves(int(network.network_address))
    got_hi, got_lo = masked(family, hi, lo, F.lit(network.prefixlen))
    return (family == network.version) & (got_hi == net_hi) & (got_lo == net_lo)


def is_global(family: Column, hi: Column, lo: Column) -> Column:
    """True for globally reachable addresses; IPv4-mapped IPv6 follows its IPv4 value."""
    mapped = (family == 6) & (hi == 0) & (_shr(lo, F.lit(32)) == 0xFFFF)
    fam = F.when(mapped, F.lit(4)).otherwise(family)
    low = F.when(mapped, lo.bitwiseAND(0xFFFFFFFF)).otherwise(lo)
    blocked = F.lit(False)
    for block in NOT_GLOBAL:
        blocked = blocked | _inside(block, fam, hi, low)
    allowed = F.lit(False)
    for block in GLOBAL_EXCEPTIONS:
        allowed = allowed | _inside(block, fam, hi, low)
    return F.when(family.isNull(), F.lit(None).cast("boolean")).otherwise(~blocked | allowed)


def address_order() -> list[Column]:
    """Sort key that orders addresses as unsigned numbers, IPv4 first."""
    flip = F.lit(-(1 << 63)).cast("bigint")
    return [F.col("family"), F.col("ip_hi").bitwiseXOR(flip), F.col("ip_lo").bitwiseXOR(flip)]
