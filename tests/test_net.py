import ipaddress
import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from resolvescope.functions import net
from resolvescope.operators import containment as c
from resolvescope.session import materialise

TEXTS = [
    " 1.2.3.4\t", "01.2.3.4", "256.1.1.1", "1.2.3", "2001:DB8:0:0:0::1", "2001:db8:0:0:1:0:0:0", "::", "::ffff:1.2.3.4",
    "fe80::1%eth0", "", None, "x", "255.255.255.255", "0.0.0.0", "ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff",
]
PREFIXES = [
    "10.0.0.5/8", "1.2.3.4", "0.0.0.0/0", "1.2.3.4/33", "10.1.2.3/255.255.0.0", "2001:db8::5/32", "2001:db8:1:2:3::/65", "::/0",
    "2001:db8::1", "ffff::/127", "", None, "bad", " 192.168.1.77/30 ",
]


def python_ip(text):
    try:
        ip = ipaddress.ip_address((text or "").strip())
    except ValueError:
        return None
    return None if getattr(ip, "scope_id", None) else ip


def signed(v):
    return v - (1 << 64) if v >= 1 << 63 else v


def test_ip_keys_match_the_standard_library(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    for row in net.with_ip_key(df, "t").collect():
        want = python_ip(TEXTS[row.i])
        if want is None:
            assert row.ip is None and row.family is None and row.ip_lo is None
        else:
            assert (row.ip, row.family) == (str(want), want.version)
            assert (row.ip_hi, row.ip_lo) == (signed(int(want) >> 64), signed(int(want) & (1 << 64) - 1))


def test_v4_only_key_has_no_python_stage(spark):
    df = spark.createDataFrame([("1.2.3.4",)], "ip string")
    assert "Python" not in net.with_ip_key(df, v6=False)._jdf.queryExecution().executedPlan().toString()


def v6_spellings(draw):
    """An address in one of its many spellings, often with zeros, sometimes broken."""
    groups = [draw.choice([0, 0, 0, draw.getrandbits(16), 0xFFFF, draw.getrandbits(4)]) for _ in range(8)]
    if draw.random() < 0.15:
        groups[:6] = [0, 0, 0, 0, 0, draw.choice([0, 0xFFFF, 0xFFFF])]
    shown = [draw.choice([f"{g:x}", f"{g:04x}", f"{g:X}"]) for g in groups]
    if draw.random() < 0.2:
        shown[6:] = [".".join(str(b) for b in (groups[6] >> 8, groups[6] & 255, groups[7] >> 8, groups[7] & 255))]
    text = ":".join(shown)
    if draw.random() < 0.4:
        start = draw.randrange(len(shown))
        end = draw.randrange(start, len(shown) + 1)
        text = ":".join(shown[:start]) + "::" + ":".join(shown[end:])
    if draw.random() < 0.2:
        at = draw.randrange(len(text) + 1)
        text = text[:at] + draw.choice([":", "::", "g", "0", "00000", "%", "%eth0", ".", "1.2.3.4", " ", "/"]) + text[at + draw.randrange(2):]
    return text


def test_random_addresses_and_prefixes_equal_the_standard_library(spark):
    draw = random.Random(11)
    ips = sorted({v6_spellings(draw) for _ in range(100_000)} | {f"::ffff:{draw.getrandbits(8)}.{draw.getrandbits(8)}.0.{draw.getrandbits(9)}" for _ in range(5_000)})
    lengths = ["", "/64", "/0", "/128", "/129", "/064", "/", "/255.255.0.0", "/0.0.0.255", "/255.0.255.0", "/32", "/08", "/33", "/a", "/1/2", "/+4", "/0000000000000000000000000000012"]
    v4 = lambda: f"{draw.getrandbits(8)}.{draw.randrange(300)}.{draw.getrandbits(8)}.{draw.getrandbits(8)}"
    prefixes = sorted({(v6_spellings(draw) if draw.random() < 0.7 else v4()) + draw.choice([*lengths, f"/{draw.randrange(130)}"]) for _ in range(30_000)})

    def address(text):
        ip = python_ip(text)
        return (None,) * 4 if ip is None or ip.version == 4 else (str(ip), 6, signed(int(ip) >> 64), signed(int(ip) & (1 << 64) - 1))

    def network(text):
        try:
            n = ipaddress.ip_network(text.strip(), strict=False)
        except ValueError:
            return (None,) * 5
        n = ipaddress.ip_network(f"{str(n[0]).partition('%')[0]}/{n.prefixlen}")  # the library leaves some networks their zone
        return str(n), n.version, n.prefixlen, signed(int(n[0]) >> 64), signed(int(n[0]) & (1 << 64) - 1)

    keyed = net.with_ip_key(spark.createDataFrame([(t,) for t in ips], "t string").repartition(4), "t")
    got = {r.t: (r.ip, r.family, r.ip_hi, r.ip_lo) for r in keyed.collect()}
    assert [(t, got[t], address(t)) for t in ips if got[t] != address(t)][:5] == [] and len(got) == len(ips)
    keyed = net.with_prefix_key(spark.createDataFrame([(t,) for t in prefixes], "t string").repartition(4), "t")
    got = {r.t: (r.prefix, r.family, r.masklen, r.net_hi, r.net_lo) for r in keyed.collect()}
    assert [(t, got[t], network(t)) for t in prefixes if got[t] != network(t)][:5] == [] and len(got) == len(prefixes)


def test_address_text_never_leaves_the_engine(spark):
    df = spark.createDataFrame([("2001:db8::1", "2001:db8::/32")], "ip string, prefix string")
    for keyed in (net.with_ip_key(df), net.with_prefix_key(df)):
        assert "Python" not in keyed._jdf.queryExecution().executedPlan().toString()


def test_prefix_keys_match_the_standard_library(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(PREFIXES)], "i int, prefix string")
    for row in net.with_prefix_key(df).collect():
        try:
            want = ipaddress.ip_network((PREFIXES[row.i] or "").strip(), strict=False)
        except ValueError:
            assert row.prefix is None and row.masklen is None
            continue
        number = int(want.network_address)
        assert (row.prefix, row.family, row.masklen) == (str(want), want.version, want.prefixlen)
        assert (row.net_hi, row.net_lo) == (signed(number >> 64), signed(number & (1 << 64) - 1))


def test_global_addresses(spark):
    texts = ["8.8.8.8", "10.1.1.1", "100.64.0.1", "192.0.0.9", "192.0.0.8", "224.0.0.1", "240.0.0.1", "2606:4700::1", "2001:db8::1",
             "fe80::1", "2001:4:112::1", "2001:1::1", "2001:1::3", "::ffff:8.8.8.8", "::ffff:10.0.0.1", "64:ff9b:1::1", "2002::1"]
    df = net.with_ip_key(spark.createDataFrame([(t,) for t in texts], "t string"), "t")
    got = {r.t: r.g for r in df.select("t", net.is_global(F.col("family"), F.col("ip_hi"), F.col("ip_lo")).alias("g")).collect()}
    assert got == {t: ipaddress.ip_address(t).is_global for t in texts}


def frames(spark, ips, prefixes):
    a = net.with_ip_key(spark.createDataFrame([(i,) for i in ips], "ip string"))
    b = net.with_prefix_key(spark.createDataFrame([(p,) for p in prefixes], "prefix string"))
    return materialise(a), materialise(b)  # as stored tables are: keys, not texts to be parsed again


def brute(ips, prefixes):
    nets = [ipaddress.ip_network(p) for p in prefixes]
    return {(i, str(n)) for i in ips for n in nets if ipaddress.ip_address(i).version == n.version and ipaddress.ip_address(i) in n}


addresses = st.one_of(
    st.integers(0, 2**32 - 1).map(lambda n: str(ipaddress.IPv4Address(n))),
    st.integers(0, 255).map(lambda n: f"10.0.0.{n}"),
    st.integers(0, 2**128 - 1).map(lambda n: str(ipaddress.IPv6Address(n))),
    st.integers(0, 2**70).map(lambda n: str(ipaddress.IPv6Address((0x20010DB8 << 96) + n))),
)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(data=st.data())
def test_containment_equals_brute_force(spark, data):
    ips = data.draw(st.lists(addresses, min_size=5, max_size=25, unique=True))
    lens = data.draw(st.lists(st.integers(0, 128), min_size=8, max_size=12))
    prefixes = sorted({str(ipaddress.ip_network(f"{i}/{n if ':' in i else n % 33}", strict=False)) for i, n in zip(ips, lens)} | {"0.0.0.0/0", "10.0.0.0/30"})
    a, b = frames(spark, ips, prefixes)
    want = brute(ips, prefixes)
    assert {(r.ip, r.prefix) for r in c.prefix_join(a, b).select("ip", "prefix").collect()} == want
    covered = {i for i, _ in want}
    assert {r.ip for r in c.prefix_join(a, b, "left_semi").collect()} == covered
    assert {r.ip for r in c.prefix_join(a, b, "left_anti").collect()} == set(ips) - covered
    best = {i: max((p for j, p in want if j == i), key=lambda p: int(p.split("/")[1])) for i in covered}
    got = c.with_prefix_match(a, b).where("matched").select("ip", "match_prefix").collect()
    assert {r.ip: r.match_prefix for r in got} == best


def test_containment_plan_has_no_nested_loop(spark, fx):
    plan = c.prefix_join(fx.resolver, fx.anycast)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_hot_address_is_kept_with_all_its_rows(spark):
    a, b = frames(spark, ["10.0.0.1"] * 500 + ["11.0.0.1"], ["10.0.0.0/8", "10.0.0.0/24"])
    rows = c.with_prefix_match(a, b).groupBy("ip", "match_prefix").count().collect()
    assert {(r.ip, r.match_prefix, r["count"]) for r in rows} == {("10.0.0.1", "10.0.0.0/24", 500), ("11.0.0.1", None, 1)}


def test_ancestors_include_the_prefix_itself(spark):
    _, b = frames(spark, ["1.1.1.1"], ["10.0.0.0/8", "10.1.0.0/16", "10.1.1.0/24", "11.0.0.0/8"])
    got = {(r.prefix, r.ancestor) for r in c.ancestor_pairs(b).collect()}
    assert ("10.1.1.0/24", "10.0.0.0/8") in got and ("10.1.1.0/24", "10.1.1.0/24") in got and len(got) == 7
