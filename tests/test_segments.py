"""Segments and the as-of lookup, against the standard library and plain loops."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from resolvescope.functions import net
from resolvescope.operators import containment as c
from resolvescope.operators import segments

EDGES = ["0.0.0.0", "255.255.255.255", "127.255.255.255", "128.0.0.0", "::", "ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff", "7fff:ffff:ffff:ffff:ffff:ffff:ffff:ffff", "8000::", "0:0:0:7fff:ffff:ffff:ffff:ffff",
         "0:0:0:1::", "1::7fff:ffff:ffff:ffff", "1::8000:0:0:0", "1:0:0:0:ffff:ffff:ffff:ffff"]


def signed(v):
    return v - (1 << 64) if v >= 1 << 63 else v


def address_frame(spark, ips, extra="n int"):
    rows = [(ip, a.version, signed(int(a) >> 64), signed(int(a) & (1 << 64) - 1), i) for i, ip in enumerate(ips) for a in [ipaddress.ip_address(ip)]]
    return spark.createDataFrame(rows, f"ip string, family int, ip_hi long, ip_lo long, {extra}")


def prefix_frame(spark, prefixes):
    rows = [(str(n), n.version, n.prefixlen, signed(int(n[0]) >> 64), signed(int(n[0]) & (1 << 64) - 1)) for n in map(ipaddress.ip_network, prefixes)]
    return spark.createDataFrame(rows, "prefix string, family int, masklen int, net_hi long, net_lo long")


def random_prefix(draw, ip):
    a = ipaddress.ip_address(ip)
    return str(ipaddress.ip_network(f"{ip}/{draw.choice([0, 1, 2, draw.randrange(a.max_prefixlen + 1), a.max_prefixlen, a.max_prefixlen - 1])}", strict=False))


def random_ip(draw):
    kind = draw.randrange(5)
    if kind == 0:
        return draw.choice(EDGES)
    if kind < 3:
        return str(ipaddress.IPv4Address(draw.choice([draw.getrandbits(32), 10 << 24 | draw.getrandbits(10)])))
    return str(ipaddress.IPv6Address(draw.choice([draw.getrandbits(128), 0x20010DB8 << 96 | draw.getrandbits(12), draw.getrandbits(64) << 64])))


@pytest.mark.parametrize("pieces", [4096, 3])
def test_joins_equal_loops(spark, monkeypatch, pieces):
    monkeypatch.setattr(segments, "SPLITS", pieces)
    draw = random.Random(pieces)
    ips = [random_ip(draw) for _ in range(400)] + EDGES
    prefixes = sorted({random_prefix(draw, random_ip(draw)) for _ in range(120)})
    a, b = address_frame(spark, ips), prefix_frame(spark, prefixes)
    networks = [ipaddress.ip_network(p) for p in prefixes]
    covering = [[n for n in networks if n.version == x.version and x in n] for x in map(ipaddress.ip_address, ips)]
    got = c.prefix_join(a, b).select("n", "prefix", "masklen").collect()
    assert sorted((r.n, r.prefix, r.masklen) for r in got) == sorted((i, str(n), n.prefixlen) for i, found in enumerate(covering) for n in found)
    longest = {i: str(max(found, key=lambda n: n.prefixlen)) for i, found in enumerate(covering) if found}
    rows = c.with_prefix_match(a, b).collect()
    assert {r.n: r.match_prefix for r in rows if r.matched} == longest and len(rows) == len(ips)
    assert {r.n for r in c.prefix_join(a, b, "left_anti").collect()} == set(range(len(ips))) - longest.keys()


def test_segments_are_disjoint_and_nested_prefixes_end_where_they_should(spark):
    b = prefix_frame(spark, ["10.0.0.0/8", "10.0.0.0/16", "10.0.128.0/17", "11.0.0.0/8", "255.0.0.0/8"])
    starts = segments.segment_starts(b).where("family = 4")
    named = c._named_segments(b)(starts).orderBy("ip_lo").collect()
    assert [(str(ipaddress.IPv4Address(r.ip_lo)), r.prefix) for r in named] == [
        ("10.0.0.0", "10.0.0.0/16"), ("10.0.128.0", "10.0.128.0/17"), ("10.1.0.0", "10.0.0.0/8"), ("11.0.0.0", "11.0.0.0/8"), ("12.0.0.0", None), ("255.0.0.0", "255.0.0.0/8")]


def test_a_crowded_network_and_rows_without_address(spark):
    """A third of all addresses in one /8: every row is there once, and the lookup neither sorts nor multiplies rows."""
    n = 30_000
    inside = spark.range(n).select((F.lit(10 << 24) + F.col("id") * 7).alias("ip_lo"))
    spread = spark.range(2 * n).select(((F.col("id") * 2654435761) % (1 << 32)).alias("ip_lo"))
    ips = inside.unionByName(spread).select(F.lit(4).alias("family"), F.lit(0).cast("long").alias("ip_hi"), "ip_lo")
    none = spark.range(100).select(F.lit(None).cast("int").alias("family"), F.lit(None).cast("long").alias("ip_hi"), F.lit(None).cast("long").alias("ip_lo"))
    b = prefix_frame(spark, ["10.0.0.0/8", "10.0.1.0/24", "0.0.0.0/1"] + [f"{k}.0.0.0/8" for k in range(100, 140)])
    found = c.with_match(ips.unionByName(none), b, "m")
    want = F.when(F.col("family").isNull(), None).when(F.shiftright("ip_lo", 8) == (10 << 16 | 1), "10.0.1.0/24").when(F.shiftright("ip_lo", 24) == 10, "10.0.0.0/8").when(
        F.shiftright("ip_lo", 24).between(100, 139), F.concat(F.shiftright("ip_lo", 24).cast("string"), F.lit(".0.0.0/8"))).when(F.col("ip_lo") < 1 << 31, "0.0.0.0/1")
    assert found.count() == 3 * n + 100
    assert found.where(~F.col("m.prefix").eqNullSafe(want)).count() == 0
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Python" not in plan and plan.count("Range (0, 30000") == 1


def test_empty_tables(spark):
    a, b = address_frame(spark, ["1.2.3.4", "::1"]), prefix_frame(spark, ["10.0.0.0/8"])
    assert [r.m for r in c.with_match(a, b.limit(0), "m").collect()] == [None, None]
    assert c.prefix_join(a, b.limit(0)).count() == 0 and c.prefix_join(a, b.limit(0), "left_anti").count() == 2
    assert c.with_match(a.limit(0), b, "m").count() == 0


def test_keys_from_text_reach_the_lookup(spark):
    a = net.with_ip_key(spark.createDataFrame([("10.1.2.3",), ("2001:db8::1",), ("bad",)], "ip string"))
    b = net.with_prefix_key(spark.createDataFrame([("10.0.0.0/8",), ("2001:db8::/32",)], "prefix string"))
    assert {(r.ip, r.match_prefix) for r in c.with_prefix_match(a, b).collect()} == {("10.1.2.3", "10.0.0.0/8"), ("2001:db8::1", "2001:db8::/32"), (None, None)}
