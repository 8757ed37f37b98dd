"""Scan classification."""

import uuid

from pyspark.sql import functions as F

from resolvescope.functions.clean import array_to_text
from resolvescope.plans import scan as p
from resolvescope.operators.rows import keep_if_in, keep_if_not_in
from resolvescope.session import shared_folder
from resolvescope.sources.versions import open_catalog
from workload.oracle_fixtures import inside, mask, stamp, v4
from workload.registry import query

AC = ["fx_census"]
HC = "(AB_icmp>3 OR AB_tcp>3) AND (GCD_icmp>1 OR GCD_tcp>1)"


def hit(name: str) -> str:
    return f"""(SELECT DISTINCT ON (ip_lo) ip_lo, prefix FROM (SELECT DISTINCT {name}_lo AS ip_lo, 4 AS family FROM fx_scan) r
      JOIN st_hc a ON {inside('r','a')} ORDER BY ip_lo, masklen DESC)"""


EXTRA = {
    "st_hc": f"SELECT DISTINCT prefix, net_lo, masklen, family FROM fx_census WHERE {HC}",
    "st_marked": f"""SELECT s.* REPLACE (coalesce(timestamp_request, (SELECT min(timestamp_request) FROM fx_scan)) AS timestamp_request),
        q.prefix AS qp, r.prefix AS rp, q.prefix IS NOT NULL AS qa, r.prefix IS NOT NULL AS ra
      FROM fx_scan s LEFT JOIN {hit('queried_ip')} q ON q.ip_lo=queried_ip_lo LEFT JOIN {hit('replying_ip')} r ON r.ip_lo=replying_ip_lo""",
    "st_pub": "SELECT DISTINCT queried_ip AS ip FROM st_marked WHERE resolver_type='Resolver' OR (resolver_type='Forwarder' AND qa)",
    "st_fwd": "SELECT DISTINCT queried_ip AS ip FROM st_marked WHERE resolver_type='Forwarder'",
    "st_plain": "SELECT DISTINCT queried_ip AS ip FROM st_marked WHERE resolver_type='Forwarder' AND NOT ra",
    "st_c1": """SELECT * FROM st_marked WHERE resolver_type='Forwarder' AND replying_ip NOT IN (SELECT ip FROM st_pub) AND backend_resolver NOT IN (SELECT ip FROM st_pub)""",
    "st_c2": """SELECT * FROM st_marked WHERE (resolver_type='Transparent Forwarder' AND replying_ip IN (SELECT ip FROM st_plain) AND backend_resolver NOT IN (SELECT ip FROM st_pub))
        OR (replying_ip NOT IN (SELECT ip FROM st_fwd) AND replying_ip NOT IN (SELECT ip FROM st_pub) AND backend_resolver NOT IN (SELECT ip FROM st_pub) AND backend_resolver NOT IN (SELECT ip FROM st_fwd))""",
    "st_c3": """SELECT * FROM st_marked WHERE resolver_type='Transparent Forwarder' AND replying_ip NOT IN (SELECT ip FROM st_fwd) AND replying_ip NOT IN (SELECT ip FROM st_pub) AND ra""",
}


def rollup(rows: str, col: str, target: str | None = None) -> str:
    extra, keys = (f", {target} AS resolver", "1,2") if target else ("", "1")
    return f"""SELECT {col} AS ipv4 {extra}, max({col}_asn) AS asn, max({col}_prefix) AS bgp_prefix, max({col}_org) AS org, max({col}_country) AS country,
      max(timestamp_request) AS last_update_ts, coalesce(string_agg(DISTINCT protocol, ',' ORDER BY protocol),'') AS supported_protocols FROM ({rows}) GROUP BY {keys}"""


PUB = "SELECT * FROM st_marked WHERE resolver_type='Resolver' OR (resolver_type='Forwarder' AND qa)"
EXTRA["st_resolvers"] = f"""SELECT *, true AS is_public FROM ({rollup(PUB,'queried_ip')}) UNION ALL SELECT *, false FROM ({rollup('SELECT * FROM st_c1','backend_resolver')})
  UNION ALL SELECT *, false FROM ({rollup('SELECT * FROM st_c2','backend_resolver')}) UNION ALL SELECT *, false FROM ({rollup('SELECT * FROM st_c3','replying_ip')})"""
PF = "SELECT * FROM st_marked WHERE resolver_type='Forwarder' AND replying_ip NOT IN (SELECT ip FROM st_pub)"
CF = "SELECT * FROM st_marked WHERE resolver_type='Transparent Forwarder' AND replying_ip NOT IN (SELECT ipv4 FROM st_resolvers)"
TF = "SELECT * FROM st_marked WHERE resolver_type='Transparent Forwarder'"
EXTRA["st_rec"] = f"""SELECT *, true AS is_public, 'recursive' AS type FROM ({rollup(PF,'queried_ip','backend_resolver')})
  UNION ALL SELECT *, false, 'recursive' FROM ({rollup(CF,'replying_ip','backend_resolver')})"""
EXTRA["st_tf"] = f"SELECT *, true AS is_public, 'transparent' AS type FROM ({rollup(TF,'queried_ip','replying_ip')})"


def shown(name: str) -> str:
    return f"SELECT * REPLACE ({stamp('last_update_ts')} AS last_update_ts) FROM ({name})"


def feeds(t):
    return p.classify_scan(t.scan, t.census)


def flat(df):
    return df.withColumn("supported_protocols", array_to_text(F.col("supported_protocols")))


@query("p01_fill_scan_ts", f"SELECT row_id, {stamp('timestamp_request')} AS timestamp_request FROM st_marked", EXTRA)
def _(t):
    return p.fill_scan_ts(t.scan).select("row_id", "timestamp_request")


@query("p02_high_confidence", f"SELECT prefix, ASN FROM fx_census WHERE {HC}")
def _(t):
    return p.high_confidence(t.census).select("prefix", "ASN")


@query("p03_mark_anycast", "SELECT row_id, CASE WHEN qa THEN true END AS q, CASE WHEN ra THEN true END AS r, qp, rp FROM st_marked", EXTRA)
def _(t):
    m = p.mark_anycast(t.scan, p.census_prefixes(t.census))
    return m.select("row_id", F.col("queried_ip_anycast_supported").alias("q"), F.col("replying_ip_anycast_supported").alias("r"),
                    F.col("queried_ip_anycast_prefix").alias("qp"), F.col("replying_ip_anycast_prefix").alias("rp"))


@query("p04_public_resolvers", shown(rollup(PUB, "queried_ip")), EXTRA)
def _(t):
    return flat(feeds(t).public_resolvers())


@query("p05_closed_from_forwarders", shown(rollup("SELECT * FROM st_c1", "backend_resolver")), EXTRA)
def _(t):
    return flat(feeds(t).closed_from_forwarders())


@query("p06_closed_from_transparent_backend", shown(rollup("SELECT * FROM st_c2", "backend_resolver")), EXTRA)
def _(t):
    return flat(feeds(t).closed_from_transparent_backend())


@query("p07_closed_from_transparent_reply", shown(rollup("SELECT * FROM st_c3", "replying_ip")), EXTRA)
def _(t):
    return flat(feeds(t).closed_from_transparent_reply())


ORACLE_P08 = f"""SELECT ipv4 AS ip, asn, bgp_prefix AS prefix, org, CASE WHEN org IS NOT NULL THEN 'Org' END AS org_short, country, is_public,
  supported_protocols AS protocol, 53 AS port, supported_protocols, {stamp('last_update_ts')} AS last_update_ts, 'scan' AS source FROM st_resolvers"""


@query("p08_resolver_feed", ORACLE_P08, EXTRA)
def _(t):
    return feeds(t).resolver_feed("scan")


@query("p09_recursive_forwarders", shown("SELECT * FROM st_rec"), EXTRA)
def _(t):
    return flat(feeds(t).recursive_forwarders())


@query("p10_transparent_forwarders", shown("SELECT * FROM st_tf"), EXTRA)
def _(t):
    return flat(feeds(t).transparent_forwarders())


@query("p11_forwarder_feed", f"""SELECT ipv4 AS ip, resolver AS upstream_ip, type, is_public, supported_protocols AS protocol, asn, bgp_prefix AS prefix, org,
  regexp_extract(org, '^([A-Za-z0-9]+(?:-[A-Za-z0-9]+)*)', 1) AS org_short, country, {stamp('last_update_ts')} AS last_update_ts, 'scan' AS source
  FROM (SELECT * FROM st_rec UNION ALL SELECT * FROM st_tf)""", EXTRA)
def _(t):
    return feeds(t).forwarder_feed("scan")


MISSING = """SELECT ipv4, type FROM (SELECT ipv4, type FROM st_rec UNION ALL SELECT ipv4, type FROM st_tf)
  WHERE ipv4 NOT IN (SELECT ipv4 FROM st_resolvers) AND ipv4 NOT IN (SELECT ipv4 FROM st_rec)"""


@query("p12_missing_targets", f'SELECT type, count(*) AS "rows", count(DISTINCT ipv4) AS unique_resolvers FROM ({MISSING}) GROUP BY 1', EXTRA)
def _(t):
    return feeds(t).missing_targets()


@query("p12_missing_target_sample", f'SELECT ipv4, type, count(*) AS "rows" FROM ({MISSING}) GROUP BY 1,2 ORDER BY 3 DESC,1,2 LIMIT 10', EXTRA)
def _(t):
    return feeds(t).missing_target_sample()


for _name in ("country", "asn"):

    @query(f"p1{3 if _name == 'country' else 4}_anycast_{_name}_evidence", f"""SELECT rp AS prefix, queried_ip_{_name} AS {_name},
      count(DISTINCT coalesce(backend_resolver,'-')) AS {_name}_count FROM st_marked WHERE resolver_type='Transparent Forwarder' AND ra AND queried_ip_{_name} IS NOT NULL GROUP BY 1,2""", EXTRA)
    def _(t, name=_name):
        return getattr(feeds(t), f"anycast_{name}_evidence")()


@query("p15_spoofing_evidence", f"""SELECT {v4('((queried_ip_lo>>8)<<8)')}||'/24' AS prefix, {stamp('max(timestamp_request)')} AS last_update_ts,
   'unknown' AS privatespoof, 'received' AS routedspoof FROM st_marked WHERE resolver_type='Transparent Forwarder' AND ra GROUP BY 1""", EXTRA)
def _(t):
    return feeds(t).spoofing_evidence().select("prefix", "last_update_ts", "privatespoof", "routedspoof")


@query("p16_refresh_scan_resolvers", """SELECT ip, bool_or(is_public) AS is_public FROM
   (SELECT ip, is_public FROM fx_resolver UNION ALL SELECT ipv4, n.is_public FROM (SELECT DISTINCT ON (ipv4) ipv4, is_public, last_update_ts FROM st_resolvers
      ORDER BY ipv4, last_update_ts DESC, is_public) n LEFT JOIN fx_resolver r ON r.ip=n.ipv4 WHERE r.ip IS NULL OR n.last_update_ts>r.last_update_ts) GROUP BY 1""", EXTRA)
def _(t):
    from workload.q_merges import Tables
    from workload.batches import now

    return p.refresh_scan(Tables(t), t.scan, t.census, "scan", now=now())["resolver"].table("resolver").select("ip", "is_public")


@query("p16_refresh_scan_spoofing", f"""SELECT prefix FROM fx_spoofing UNION SELECT {v4('((queried_ip_lo>>8)<<8)')}||'/24' FROM st_marked WHERE resolver_type='Transparent Forwarder' AND ra""", EXTRA)
def _(t):
    from workload.q_merges import Tables
    from workload.batches import now

    return p.refresh_scan(Tables(t), t.scan, t.census, "scan", now=now())["spoofing"].table("spoofing").select("prefix")


@query("p16_snapshots_resolver_feed", ORACLE_P08, EXTRA)
def _(t):
    """The scan as two snapshots, one added to the kept state of the other."""
    root = f"{shared_folder(t.spark)}/scan-{uuid.uuid4().hex}"
    scan = p.fill_scan_ts(t.scan)
    for half in (0, 1):
        p.add_snapshot(t.spark, root, scan.where(F.col("row_id") % 2 == half), t.census)
    tables = open_catalog(t.spark, root)
    frames = [t.spark.read.parquet(tables.path(name)) for name in p.STATE_TABLES]
    return p.classify_state(p.ScanState(*frames)).resolver_feed("scan")


@query("j10_missing_target_rows", MISSING, EXTRA)
def _(t):
    return feeds(t).missing_target_rows()


@query("j11_keep_if_in", "SELECT row_id FROM fx_scan WHERE backend_resolver IN (SELECT ip FROM fx_resolver)")
def _(t):
    return keep_if_in(t.scan, "backend_resolver", t.resolver.select("ip")).select("row_id")


@query("j11_keep_if_not_in", "SELECT row_id FROM fx_scan WHERE backend_resolver IS NOT NULL AND backend_resolver NOT IN (SELECT ip FROM fx_resolver)")
def _(t):
    return keep_if_not_in(t.scan, "backend_resolver", t.resolver.select("ip")).select("row_id")


@query("a08_rollup_ip", shown(rollup("SELECT * FROM fx_scan", "queried_ip")))
def _(t):
    return flat(p.rollup_ip(p._as_feed(t.scan, "queried_ip"), ["ipv4"]))
