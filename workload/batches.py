"""Landed batches derived from the star-schema tables, in the untidy text form of real feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resolvescope.functions.net import v4_text
from workload.fixtures import Fixtures, aip, iso, mask, prefix_key, prefix_text, rip

NOW = "2030-01-01 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


def landed_resolvers(t: Fixtures) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    n = rip(c + 300)
    proto = F.when(k % 3 == 0, "udp, TCP").when(k % 3 == 1, "h2").otherwise("dot,,udp")
    return t.spread("orders").select(
        F.when(k % 37 == 0, "bad").otherwise(F.concat(F.lit(" "), v4_text(n))).alias("resolver_ip"),
        F.when(k % 3 == 0, "Yes").when(k % 3 == 1, "no").otherwise("").alias("public"),
        F.when(k % 11 != 0, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).alias("seen"),
        F.when(k % 13 == 0, "true").otherwise("no").alias("verified"),
        F.when(k % 5 == 0, "x").otherwise((F.lit(64496) + k % 50).cast("string")).alias("as_number"),
        F.concat(v4_text(n), F.lit("/20")).alias("bgp"),
        F.when(k % 9 == 0, "***").otherwise(F.lower(iso(k % 25))).alias("cc"),
        F.when(k % 4 == 0, F.concat(F.lit("c"), (k % 3).cast("string"))).alias("city"),
        proto.alias("protocol"),
        F.when(k % 8 == 0, "70000").when(k % 2 == 0, "53").otherwise("853").alias("port"),
        F.concat(F.lit("Org "), (k % 4).cast("string")).alias("org"),
        F.concat(F.lit("D"), (k % 9).cast("string"), F.lit(".example.org")).alias("domain"),
        F.when(k % 6 == 0, " ").otherwise(F.lower("o_orderpriority")).alias("feed"),
    )


RESOLVER_MAPPING = (
    "ip:resolver_ip,is_public:public,last_update_ts:seen,verified:verified,asn:as_number,prefix:bgp,country:cc,"
    "city:city,protocol:protocol,port:port,org:org,domain:domain,source:feed"
)
RESOLVER_MODULES = "asn,prefix,location,protocol,org,domain"


def landed_forwarders(t: Fixtures) -> DataFrame:
    p, s, k = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_orderkey") * 10 + F.col("l_linenumber")
    ip = F.lit(33554432).cast("bigint") + ((p + 500) * 7927) % 16777216
    up = (
        F.when(k % 4 == 0, rip(s * 3)).when(k % 4 == 1, F.lit(33554432).cast("bigint") + (s * 7927) % 16777216)
        .when(k % 4 == 2, F.lit(33554432).cast("bigint") + ((p + 500) * 7927) % 16777216)
    )
    return t.spread("lineitem").select(
        v4_text(ip).alias("ip"),
        (F.col("l_quantity") > 25).cast("string").alias("is_public"),
        F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("last_update_ts"),
        F.when(k % 3 == 0, "Transparent Forwarder").when(k % 3 == 1, "forwarder").alias("type"),
        (F.lit(64496) + k % 50).cast("string").alias("asn"),
        F.when(F.col("l_returnflag") == "R", "udp").when(F.col("l_returnflag") == "A", "UDP, tcp").alias("protocol"),
        F.when(k % 9 != 0, iso(k % 25)).alias("country"),
        F.when(up.isNotNull(), v4_text(up)).alias("upstream_ip"),
        F.lower("l_linestatus").alias("source"),
    )


FORWARDER_MAPPING = ",".join(f"{c}:{c}" for c in "ip is_public last_update_ts type asn protocol country upstream_ip source".split())
FORWARDER_MODULES = "asn,location,protocol,upstream"


def landed_qmin(t: Fixtures) -> DataFrame:
    k = F.col("o_orderkey")
    return t.spread("orders").select(
        F.when(k % 41 == 0, "bad").otherwise(v4_text(rip(F.col("o_custkey") + 200))).alias("resolver_ip"),
        F.when(k % 4 == 0, "0").when(k % 4 == 1, "1.0").when(k % 4 == 2, "2").otherwise("Yes").alias("qmin"),
        F.when(k % 3 != 0, F.concat((k % 20).cast("string"), F.lit(".0"))).alias("max_minimise_count"),
        (k % 5).cast("string").alias("minimize_one_lab"),
        F.concat(F.date_format(F.date_add("o_orderdate", (k % 3 - 1).cast("int")), "yyyy-MM-dd"), F.lit("T00:00:00Z")).alias("last_update_ts"),
        F.lit("probe").alias("source"),
    )


QMIN_MAPPING = ",".join(f"{c}:{c}" for c in "resolver_ip qmin max_minimise_count minimize_one_lab last_update_ts source".split())


def anycast_batch(t: Fixtures) -> DataFrame:
    k = F.col("s_suppkey")
    length = F.when(k % 3 == 0, 24).otherwise(F.lit(12) + k % 9).cast("int")
    net = mask(aip(k), length)
    return t.raw("supplier").groupBy(net.alias("net"), length.alias("len")).agg(F.bool_or(F.col("s_acctbal") > 3000).alias("partial")).select(
        *prefix_key(F.col("net"), F.col("len")), prefix_text(F.col("net"), F.col("len")).alias("backing_prefix"), "partial"
    )


def backend_batch(t: Fixtures, kind: str) -> DataFrame:
    """Next census: counts and stamps shifted by amounts that depend on the row, and other keys."""
    current = t.anycast_country_backend if kind == "country" else t.anycast_asn_backend
    step = (F.col("net_lo") / 65536).cast("bigint")
    count = f"{kind}_count"
    key = F.when(step % 4 == 0, "ZZZ").otherwise(F.col("country")) if kind == "country" else F.when(step % 4 == 0, F.col("asn") + 1000).otherwise(F.col("asn"))
    rows = current.join(t.anycast.select("prefix", "net_lo"), "prefix").select(
        "prefix", key.alias(kind), (F.col(count) + step % 3 - 1).alias(count),
        F.date_add(F.lit("2020-09-01").cast("date"), (step % 5 - 2).cast("int")).cast("timestamp").alias("last_update_ts"),
    )
    return rows.groupBy("prefix", kind).agg(F.max(count).alias(count), F.max("last_update_ts").alias("last_update_ts")).withColumn("source", F.lit("census-2"))


def spoofing_batch(t: Fixtures) -> DataFrame:
    u, e = F.col("user_id"), F.col("event_id")
    n = F.lit(16777216).cast("bigint") + (u * 104729 + F.when(u % 7 == 0, 65536).otherwise(0)) % 16777216
    net = mask(n, 16)
    newest = F.max_by(F.struct("event_id", "user_id", "event_type", "ts"), F.col("event_id"))
    late = F.date_add("ts", (F.shiftright("net", 16) % 5 - 2).cast("int")).cast("timestamp")
    return (
        t.raw("events").withColumn("net", net).groupBy("net").agg(newest.alias("x")).select("net", "x.*")
        .select(
            F.concat(v4_text(F.col("net") + 77), F.lit("/16")).alias("prefix"), (e % 3 == 0).alias("nat"),
            F.when(F.col("event_type") == "click", "received").otherwise("blocked").alias("privatespoof"),
            F.lit(None).cast("string").alias("routedspoof"),
            F.when(e % 5 != 0, F.lit(64496) + u % 41).alias("asn"), F.when(e % 6 != 0, iso(u % 25)).alias("country"),
            late.alias("last_update_ts"),
        )
    )


def dnssec_batch(t: Fixtures) -> DataFrame:
    n = F.col("s_nationkey")
    return t.raw("supplier").groupBy("s_nationkey").agg(
        F.count(F.lit(1)).alias("validating"), F.count_if(F.col("s_acctbal") > 0).alias("partial_validating")
    ).select(
        iso(n).alias("country"), "validating", F.when(n % 6 != 0, F.col("validating") * 1.5).alias("validating_pc"),
        "partial_validating", (F.col("partial_validating") * 0.5).alias("partial_validating_pc"),
        F.date_add(F.lit("2020-08-01").cast("date"), (n % 3 - 1).cast("int")).cast("timestamp").alias("last_observation_ts"),
    )


def ptr_batch(t: Fixtures) -> DataFrame:
    k = F.col("o_orderkey")
    return t.spread("orders").select(
        v4_text(rip(F.col("o_custkey") + 200)).alias("resolver_ip"),
        F.when(k % 9 == 0, " ").otherwise(F.concat(F.lit("PTR-"), (k % 30).cast("string"), F.lit(".Example.com."))).alias("domain"),
    )


def svcb_batch(t: Fixtures) -> DataFrame:
    k = F.col("o_orderkey")
    return t.spread("orders").select(
        v4_text(rip(F.col("o_custkey") + 200)).alias("resolver_ip"),
        F.concat(F.lit("svc-"), (k % 12).cast("string"), F.lit(".example.com")).alias("domain"),
        F.when(k % 3 == 0, F.array(F.lit("h2"), F.lit("h3"))).when(k % 3 == 1, F.array(F.lit("dot"), F.lit(" "))).alias("alpn"),
        F.when(k % 4 != 0, F.lit(443) + k % 2).cast("bigint").alias("port"),
        F.lit(None).cast("array<string>").alias("ipv4hint"),
        F.when(k % 5 == 0, F.array(F.concat(F.lit("2001:DB8:0:1::"), F.lower(F.hex(k % 50 + 1))), F.lit("oops"))).alias("ipv6hint"),
        F.when(k % 7 == 0, F.concat(F.lit("/d"), (k % 3).cast("string"))).alias("dohpath"),
    )


def mapped(df, mapping, modules, kind):
    """A landed frame with the target columns of a kind."""
    from resolvescope.sources.mapping import FileKind

    return FileKind(kind).selection(mapping, modules, df.columns).of(df)
