"""Containment joins and address keys."""

from pyspark.sql import functions as F

from resolvescope.functions import net
from resolvescope.operators import containment as c
from workload.oracle_fixtures import ALLOW, inside, stamp, v4
from workload.registry import query

R, A, S = "fx_resolver r", "fx_anycast a", "fx_spoofing s"


@query("j01_prefix_join", f"SELECT r.ip, a.prefix, a.masklen FROM {R} JOIN {A} ON {inside('r','a')}")
def _(t):
    return c.prefix_join(t.resolver, t.anycast).select("ip", "prefix", "masklen")


@query("j01_prefix_join_v6", """SELECT r.ip, a.prefix FROM fx_resolver_v6 r JOIN fx_anycast_v6 a
  ON r.ip_hi BETWEEN a.net_hi AND a.net_hi + (1::BIGINT << (64-a.masklen)) - 1""")
def _(t):
    return c.prefix_join(t.resolver_v6, t.anycast_v6).select("ip", "prefix")


@query("j02_prefix_semi", f"SELECT r.ip, r.resolver_id FROM {R} WHERE EXISTS (SELECT 1 FROM {S} WHERE {inside('r','s')} AND {ALLOW})")
def _(t):
    from resolvescope.plans.scope_reports import spoofable_prefixes

    return c.prefix_join(t.resolver, spoofable_prefixes(t), "left_semi").select("ip", "resolver_id")


@query("j02_prefix_anti", f"SELECT r.ip, r.resolver_id FROM {R} WHERE NOT EXISTS (SELECT 1 FROM {S} WHERE {inside('r','s')})")
def _(t):
    return c.prefix_join(t.resolver, t.spoofing, "left_anti").select("ip", "resolver_id")


@query("j03_prefix_match", f"""
  SELECT row_id, queried_ip AS ip, m.prefix AS match_prefix, m.prefix IS NOT NULL AS matched FROM fx_scan LEFT JOIN
   (SELECT DISTINCT ON (ip_lo) ip_lo, prefix FROM (SELECT DISTINCT queried_ip_lo AS ip_lo, 4 AS family FROM fx_scan) r
    JOIN {A} ON {inside('r','a')} ORDER BY ip_lo, masklen DESC) m ON m.ip_lo=queried_ip_lo""")
def _(t):
    return c.with_prefix_match(t.scan, t.anycast, "queried_ip").select("row_id", F.col("queried_ip").alias("ip"), "match_prefix", "matched")


@query("j04_covering_prefixes", f"""
  SELECT ip, prefix, rank FROM (SELECT r.ip, a.prefix, row_number() OVER (PARTITION BY r.ip ORDER BY masklen DESC, prefix) AS rank
    FROM {R} JOIN {A} ON {inside('r','a')}) WHERE rank<=10""")
def _(t):
    return c.covering_prefixes(t.resolver, t.anycast, 10).select("ip", "prefix", "rank")


@query("c01_ip_key", f"""
  SELECT k, CASE WHEN k%7=0 THEN NULL ELSE {v4('n')} END AS ip, CASE WHEN k%7<>0 THEN n END AS ip_lo, CASE WHEN k%7<>0 THEN 4 END AS family
  FROM (SELECT l_orderkey*10+l_linenumber AS k, 16777216+(l_partkey*7919+l_suppkey*31)%33554432 AS n FROM lineitem)""")
def _(t):
    n = F.lit(16777216).cast("bigint") + (F.col("l_partkey") * 7919 + F.col("l_suppkey") * 31) % 33554432
    k = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    text = F.when(k % 7 == 0, F.concat(net.v4_text(n), F.lit(".999"))).otherwise(F.concat(F.lit(" "), net.v4_text(n), F.lit("\t")))
    return net.with_ip_key(t.raw("lineitem").select(k.alias("k"), text.alias("ip")), v6=False).select("k", "ip", "ip_lo", "family")


@query("c01_ip_key_v6", "SELECT ip, ip_hi, ip_lo, family FROM fx_resolver_v6")
def _(t):
    hi = F.lpad(F.hex("ip_hi"), 16, "0")
    lo = F.lpad(F.hex("ip_lo"), 16, "0")
    parts = [F.substring(x, i, 4) for x in (hi, lo) for i in (1, 5, 9, 13)]
    long_form = t.resolver_v6.select(F.concat_ws(":", *parts).alias("text"))
    return net.with_ip_key(long_form, "text").select("ip", "ip_hi", "ip_lo", "family")


@query("c02_prefix_key", f"""
  SELECT k, {v4('((n >> 12) << 12)')} || '/20' AS prefix, 20 AS masklen, (n >> 12) << 12 AS net_lo
  FROM (SELECT o_orderkey AS k, 16777216+(o_custkey*104729+o_orderkey)%33554432 AS n FROM orders)""")
def _(t):
    n = F.lit(16777216).cast("bigint") + (F.col("o_custkey") * 104729 + F.col("o_orderkey")) % 33554432
    rows = t.raw("orders").select(F.col("o_orderkey").alias("k"), F.concat(net.v4_text(n), F.lit("/20")).alias("prefix"))
    return net.with_prefix_key(rows, v6=False).select("k", "prefix", "masklen", "net_lo")


@query("c03_prefix_ranges", """SELECT DISTINCT prefix, net_lo AS start, net_lo + (1::BIGINT << (32-masklen)::INTEGER) - 1 AS "end" FROM fx_anycast""")
def _(t):
    return net.prefix_ranges(t.anycast)


@query("c21_is_global", """
  SELECT k, NOT (n BETWEEN 167772160 AND 184549375 OR n BETWEEN 1681915904 AND 1686110207 OR n BETWEEN 2886729728 AND 2887778303
     OR n BETWEEN 3232235520 AND 3232301055 OR n < 16777216 OR n BETWEEN 2130706432 AND 2147483647 OR n BETWEEN 2851995648 AND 2852061183
     OR (n BETWEEN 3221225472 AND 3221225727 AND n NOT IN (3221225481, 3221225482)) OR n BETWEEN 3221225984 AND 3221226239
     OR n BETWEEN 3323068416 AND 3323199487 OR n BETWEEN 3325256704 AND 3325256959 OR n BETWEEN 3405803776 AND 3405804031
     OR n >= 4026531840) AS is_global
  FROM (SELECT l_orderkey*10+l_linenumber AS k, (l_partkey*104729*7919 + l_suppkey*65537)%4294967296 AS n FROM lineitem)""")
def _(t):
    n = (F.col("l_partkey") * 104729 * 7919 + F.col("l_suppkey") * 65537) % 4294967296
    rows = t.raw("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), n.alias("n"))
    return rows.select("k", net.is_global(F.lit(4), F.lit(0).cast("bigint"), F.col("n")).alias("is_global"))


@query("c22_slash24", f"SELECT row_id, {v4('((queried_ip_lo >> 8) << 8)')} || '/24' AS prefix FROM fx_scan")
def _(t):
    return t.scan.select("row_id", net.to_slash24(F.col("queried_ip")).alias("prefix"))


@query("c28_masklen_family", "SELECT prefix, masklen, 4 AS family FROM fx_anycast")
def _(t):
    p = F.col("prefix")
    return t.anycast.select("prefix", net.masklen_text(p).alias("masklen"), net.family_of(p).cast("int").alias("family"))
