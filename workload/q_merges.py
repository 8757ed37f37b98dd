"""Merge policies over derived batches."""

from pyspark.sql import functions as F

from resolvescope.functions.countries import iso_table
from resolvescope.operators.rows import new_keys
from resolvescope.plans import imports as m
from resolvescope.plans import kept
from workload import batches as b
from workload.oracle_fixtures import iso, mask, ptext, rip, aip, stamp, v4
from workload.registry import query

NOW = f"TIMESTAMP '{b.NOW}'"


class Tables:
    """Current tables for the merges; relations the fixtures lack start empty."""

    def __init__(self, t):
        from resolvescope.catalog import Catalog

        self._t, self._empty = t, Catalog(t.spark, "/nonexistent")

    def __getattr__(self, name):
        return getattr(self._t, name) if hasattr(type(self._t), name) else getattr(self._empty, name)


EXTRA = {
    "st_stage": f"""
      SELECT {v4('n')} AS ip, n AS ip_lo, k%3=0 AS is_public, CASE WHEN k%6=0 THEN 'list' ELSE lower(o_orderpriority) END AS source,
        CASE WHEN k%11<>0 THEN o_orderdate END AS last_update_ts, k%13=0 AS verified, CASE WHEN k%5<>0 THEN 64496+k%50 END AS asn,
        {v4('((n>>12)<<12)')}||'/20' AS prefix, CASE WHEN k%9<>0 THEN {iso('k%25')} END AS country,
        CASE WHEN k%4=0 THEN 'c'||(k%3)::VARCHAR END AS city,
        CASE k%3 WHEN 0 THEN 'udp, TCP' WHEN 1 THEN 'h2' ELSE 'dot,,udp' END AS protocol,
        CASE WHEN k%8=0 THEN NULL WHEN k%2=0 THEN 53 ELSE 853 END AS port, 'Org '||(k%4)::VARCHAR AS org,
        'D'||(k%9)::VARCHAR||'.example.org' AS domain, k
      FROM (SELECT *, o_orderkey AS k, {rip('(o_custkey+300)')} AS n FROM orders) WHERE k%37<>0""",
    "st_unique": """SELECT * FROM st_stage QUALIFY row_number() OVER (PARTITION BY ip_lo ORDER BY last_update_ts DESC NULLS LAST, source,
        asn NULLS LAST, city NULLS LAST, country NULLS LAST, domain, is_public, org, port NULLS LAST, prefix, protocol, verified)=1""",
    "st_fresh": """SELECT u.*, (SELECT max(id) FROM fx_resolver_identity)+row_number() OVER (ORDER BY ip_lo) AS resolver_id FROM st_unique u
        WHERE ip_lo NOT IN (SELECT ip_lo FROM fx_resolver)""",
    "st_all": "SELECT u.*, r.resolver_id FROM st_unique u JOIN fx_resolver r USING (ip_lo) UNION ALL SELECT * FROM st_fresh",
}


def imported(t, **kw):
    return m.import_resolvers(
        Tables(t), b.landed_resolvers(t), b.RESOLVER_MAPPING, b.RESOLVER_MODULES, "list", iso=iso_table(t.spark), now=b.now(), v6=False, **kw
    )


def resolver_sql(force: bool) -> str:
    when = "true" if force else "coalesce(u.last_update_ts>r.last_update_ts,false)"
    public = "u.is_public" if force else "r.is_public OR u.is_public"
    return f"""
      SELECT r.ip, r.resolver_id, CASE WHEN u.ip IS NOT NULL AND {when} THEN {public} ELSE r.is_public END AS is_public,
        {stamp(f"CASE WHEN u.ip IS NOT NULL AND {when} THEN coalesce(u.last_update_ts,{NOW}) ELSE r.last_update_ts END")} AS last_update_ts,
        CASE WHEN u.ip IS NOT NULL AND {when} THEN u.source ELSE r.source END AS source
      FROM fx_resolver r LEFT JOIN st_unique u ON u.ip=r.ip
      UNION ALL SELECT ip, resolver_id, is_public, {stamp(f'coalesce(last_update_ts,{NOW})')}, source FROM st_fresh"""


for _force in (False, True):

    @query("m01_merge_resolver" + ("_forced" if _force else ""), resolver_sql(_force), EXTRA)
    def _(t, force=_force):
        return imported(t, force=force).table("resolver").drop("family", "ip_hi", "ip_lo")


@query("m01_report_resolver", """
  SELECT (SELECT count(*) FROM st_stage) AS candidates, (SELECT count(*) FROM st_fresh) AS inserted, n AS updated,
    (SELECT count(*) FROM st_stage)-(SELECT count(*) FROM st_unique)+e-n AS skipped,
    (SELECT count(*) FROM st_stage)-(SELECT count(*) FROM st_unique) AS duplicate, e AS existing, (SELECT count(*) FROM st_fresh) AS growth
  FROM (SELECT count(*) AS e, count(*) FILTER (WHERE u.last_update_ts>r.last_update_ts) AS n FROM fx_resolver r JOIN st_unique u USING (ip))""", EXTRA)
def _(t):
    return imported(t).result("resolver").report


@query("m02_merge_resolver_identity", f"""
  SELECT id, CASE WHEN v AND NOT verified THEN true ELSE verified END AS verified, {stamp('CASE WHEN ts>last_update_ts THEN ts ELSE last_update_ts END')} AS last_update_ts,
    CASE WHEN v AND total_measurements=0 AND (ts>last_update_ts OR NOT verified) THEN 1 ELSE total_measurements END AS total_measurements,
    CASE WHEN v AND seen_measurements=0 AND (ts>last_update_ts OR NOT verified) THEN 1 ELSE seen_measurements END AS seen_measurements
  FROM fx_resolver_identity LEFT JOIN (SELECT resolver_id AS id, max(last_update_ts) AS ts, bool_or(verified) AS v FROM st_all GROUP BY 1) USING (id)
  UNION ALL SELECT resolver_id, verified, {stamp(f'coalesce(last_update_ts,{NOW})')}, verified::INT, verified::INT FROM st_fresh""", EXTRA)
def _(t):
    return imported(t).table("resolver_identity")


@query("m03_merge_verification", "SELECT DISTINCT resolver_id, source AS verifying_source FROM st_all WHERE verified", EXTRA)
def _(t):
    return imported(t).table("resolver_verification")


def attribute_sql(table: str, columns: list[str]) -> str:
    differs = " OR ".join(f"t.{c} IS DISTINCT FROM s.{c}" for c in columns)
    picked = ", ".join(f"CASE WHEN s.resolver_id IS NULL THEN t.{c} ELSE s.{c} END AS {c}" for c in columns)
    rest = ", ".join(f"{c} NULLS LAST" for c in columns)
    return f"""
      SELECT coalesce(t.resolver_id, s.resolver_id) AS resolver_id, {picked},
        {stamp(f"CASE WHEN s.resolver_id IS NULL THEN t.last_update_ts WHEN t.resolver_id IS NULL OR ({differs}) OR s.last_update_ts>t.last_update_ts THEN coalesce(s.last_update_ts,{NOW}) ELSE t.last_update_ts END")} AS last_update_ts
      FROM {table} t FULL JOIN (SELECT * FROM st_all WHERE {columns[0]} IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY resolver_id ORDER BY last_update_ts DESC NULLS LAST, {rest})=1) s ON s.resolver_id=t.resolver_id"""


for _name in ("asn", "prefix", "org", "domain"):

    @query(f"m04_merge_attribute_{_name}", attribute_sql(f"fx_resolver_{_name}", [_name]), EXTRA)
    def _(t, name=_name):
        return imported(t).table(f"resolver_{name}")


@query("m05_merge_location", attribute_sql("fx_resolver_location", ["country", "city"]).replace("country NULLS LAST, city NULLS LAST", "city NULLS LAST, country NULLS LAST"), EXTRA)
def _(t):
    return imported(t).table("resolver_location")


_LOCATED = attribute_sql("fx_resolver_location", ["country", "city"]).replace("country NULLS LAST, city NULLS LAST", "city NULLS LAST, country NULLS LAST")


@query("q20_kept_country_counts", f"""SELECT country AS target, count(*) AS resolver_count, count(*) FILTER (is_public) AS public_resolver_count, count(*) FILTER (NOT is_public) AS closed_resolver_count,
   count(DISTINCT resolver_id) AS identity_count, count(DISTINCT source) AS source_count, count(*) FILTER (qmin = 'yes') AS qmin_yes_count, count(*) FILTER (qmin = 'no') AS qmin_no_count,
   count(*) FILTER (qmin = 'unstable') AS qmin_unstable_count
   FROM ({_LOCATED}) l JOIN ({resolver_sql(False)}) r USING (resolver_id) LEFT JOIN (SELECT resolver_id, qmin FROM fx_qmin_resolver) q USING (resolver_id) WHERE country IS NOT NULL GROUP BY 1""", EXTRA)
def _(t):
    """The report of the tables before an import, carried over it by the rows that it changes."""
    tables, result, report = Tables(t), imported(t), kept.COUNTRY_COUNTS
    state = kept.full_state(report, tables)
    return kept.read_report(report, kept.apply_delta(state, kept.signed_delta(report, tables, result)).table)


SERVICE_STAGE = """SELECT resolver_id, CASE p WHEN 'udp' THEN 'doudp' WHEN 'tcp' THEN 'dotcp' WHEN 'h2' THEN 'doh' ELSE p END AS protocol, port, max(last_update_ts) AS ts
  FROM (SELECT resolver_id, lower(trim(unnest(string_split(protocol, ',')))) AS p, port, last_update_ts FROM st_all) WHERE p<>'' AND port IS NOT NULL GROUP BY 1,2,3"""


@query("m06_merge_service", f"""
  SELECT resolver_id, protocol, port, {stamp(f'CASE WHEN t.last_update_ts IS NULL THEN coalesce(s.ts,{NOW}) WHEN s.ts>t.last_update_ts THEN s.ts ELSE t.last_update_ts END')} AS last_update_ts
  FROM fx_resolver_service t FULL JOIN ({SERVICE_STAGE}) s USING (resolver_id, protocol, port)""", EXTRA)
def _(t):
    return imported(t).table("resolver_service")


@query("m22_import_resolvers_report", f"""
  SELECT 'input' AS module, NULL::BIGINT AS candidates, NULL::BIGINT AS inserted, (SELECT count(*) FROM orders) AS rows,
   (SELECT count(*) FROM orders WHERE o_orderkey%37=0) AS invalid_ip
  UNION ALL SELECT 'resolver', (SELECT count(*) FROM st_stage), (SELECT count(*) FROM st_fresh), NULL, NULL
  UNION ALL SELECT 'asn', (SELECT count(DISTINCT resolver_id) FROM st_all WHERE asn IS NOT NULL),
    (SELECT count(DISTINCT resolver_id) FROM st_all WHERE asn IS NOT NULL AND resolver_id NOT IN (SELECT resolver_id FROM fx_resolver_asn)), NULL, NULL
  UNION ALL SELECT 'protocol', (SELECT count(*) FROM ({SERVICE_STAGE})), (SELECT count(*) FROM ({SERVICE_STAGE}) ANTI JOIN fx_resolver_service USING (resolver_id, protocol, port)), NULL, NULL""", EXTRA)
def _(t):
    report = imported(t).report("input", "resolver", "asn", "protocol")
    return report.select("module", "candidates", "inserted", "rows", "invalid_ip")


@query("m21_add_resolvers", f"""
  SELECT r.ip, r.resolver_id, r.is_public, {stamp('CASE WHEN u.last_update_ts>r.last_update_ts THEN u.last_update_ts ELSE r.last_update_ts END')} AS last_update_ts, r.source
  FROM fx_resolver r LEFT JOIN st_unique u ON u.ip=r.ip
  UNION ALL SELECT ip, resolver_id, is_public, {stamp(f'coalesce(last_update_ts,{NOW})')}, source FROM st_fresh""", EXTRA)
def _(t):
    mapped = b.mapped(b.landed_resolvers(t), b.RESOLVER_MAPPING, ["resolver"], "resolver")
    stage = m.resolver_rows(mapped, "list", iso=iso_table(t.spark), now=b.now(), v6=False)
    return m.add_resolvers(Tables(t), stage, True, b.now()).table("resolver").drop("family", "ip_hi", "ip_lo")


@query("m25_assign_ids", "SELECT ip, resolver_id FROM st_all", EXTRA)
def _(t):
    mapped = b.mapped(b.landed_resolvers(t), b.RESOLVER_MAPPING, ["resolver"], "resolver")
    stage = m.resolver_rows(mapped, "list", iso=iso_table(t.spark), now=b.now(), v6=False)
    return m.number_rows(m.unique_rows(stage), t.resolver, t.resolver_identity, "resolver_id").select("ip", "resolver_id")


@query("j09_new_keys", "SELECT DISTINCT ip FROM st_stage WHERE ip NOT IN (SELECT ip FROM fx_resolver)", EXTRA)
def _(t):
    batch = b.landed_resolvers(t).select(F.trim("resolver_ip").alias("ip")).where(F.col("ip") != "bad").distinct()
    return new_keys(batch, t.resolver, ["ip"])


# ---- forwarders ----------------------------------------------------------------------------------

FIP = "(33554432+((l_partkey+500)*7927)%16777216)"
EXTRA_F = {
    "st_fstage": f"""
      SELECT {v4(FIP)} AS ip, {FIP} AS ip_lo, l_quantity>25 AS is_public, l_shipdate AS last_update_ts,
        CASE WHEN k%3=0 THEN 'transparent' ELSE 'recursive' END AS type, 64496+k%50 AS asn,
        CASE l_returnflag WHEN 'R' THEN 'udp' WHEN 'A' THEN 'UDP, tcp' END AS protocol, CASE WHEN k%9<>0 THEN {iso('k%25')} END AS country,
        CASE k%4 WHEN 0 THEN {rip('(l_suppkey*3)')} WHEN 1 THEN 33554432+(l_suppkey*7927)%16777216 WHEN 2 THEN {FIP} END AS up, lower(l_linestatus) AS source
      FROM (SELECT *, l_orderkey*10+l_linenumber AS k FROM lineitem)""",
    "st_funique": f"""SELECT * FROM st_fstage QUALIFY row_number() OVER (PARTITION BY ip_lo ORDER BY last_update_ts DESC, source,
        asn, country NULLS LAST, is_public, protocol NULLS LAST, type, {v4('up')} NULLS LAST)=1""",
    "st_ffresh": """SELECT u.*, (SELECT max(p_partkey) FROM part)+row_number() OVER (ORDER BY ip_lo) AS forwarder_id FROM st_funique u
        WHERE ip_lo NOT IN (SELECT ip_lo FROM fx_forwarder)""",
    "st_fall": "SELECT u.*, f.forwarder_id FROM st_funique u JOIN fx_forwarder f USING (ip_lo) UNION ALL SELECT * FROM st_ffresh",
    "st_fups": "SELECT forwarder_id, s.up, max(s.last_update_ts) AS ts FROM st_fstage s JOIN st_fall a USING (ip_lo) WHERE s.up IS NOT NULL GROUP BY 1,2",
    "st_fid": "SELECT p_partkey AS id, TIMESTAMP '2020-05-01' AS last_update_ts, 0 AS total_measurements, 0 AS seen_measurements FROM part",
}


class ForwarderTables(Tables):
    @property
    def forwarder_identity(self):
        return self._t.raw("part").select(
            F.col("p_partkey").alias("id"), F.lit("2020-05-01").cast("timestamp").alias("last_update_ts"),
            F.lit(0).alias("total_measurements"), F.lit(0).alias("seen_measurements"),
        )


def imported_f(t, force=False):
    return m.import_forwarders(
        ForwarderTables(t), b.landed_forwarders(t), b.FORWARDER_MAPPING, b.FORWARDER_MODULES, "scan", force=force, now=b.now(), v6=False
    )


@query("m08_merge_forwarder", f"""
  SELECT f.ip, f.forwarder_id, CASE WHEN u.ip IS NULL THEN f.is_public ELSE u.is_public END AS is_public, coalesce(u.type,f.type) AS type, coalesce(u.source,f.source) AS source,
    f.transparent_count + CASE WHEN u.type='transparent' AND u.last_update_ts>f.last_update_ts THEN 1 ELSE 0 END AS transparent_count,
    f.recursive_count + CASE WHEN u.type='recursive' AND u.last_update_ts>f.last_update_ts THEN 1 ELSE 0 END AS recursive_count,
    {stamp("CASE WHEN u.type='recursive' AND u.last_update_ts>f.last_update_ts THEN u.last_update_ts ELSE f.last_observed_as_recursive END")} AS last_observed_as_recursive,
    {stamp("CASE WHEN u.type='transparent' AND u.last_update_ts>f.last_update_ts THEN u.last_update_ts ELSE f.last_observed_as_transparent END")} AS last_observed_as_transparent,
    {stamp("CASE WHEN u.last_update_ts>f.last_update_ts THEN u.last_update_ts ELSE f.last_update_ts END")} AS last_update_ts
  FROM fx_forwarder f LEFT JOIN st_funique u ON u.ip_lo=f.ip_lo
  UNION ALL SELECT ip, forwarder_id, is_public, type, source, (type='transparent')::INT, (type='recursive')::INT,
    {stamp("CASE WHEN type='recursive' THEN last_update_ts END")}, {stamp("CASE WHEN type='transparent' THEN last_update_ts END")}, {stamp('last_update_ts')} FROM st_ffresh""", EXTRA_F)
def _(t):
    return imported_f(t).table("forwarder").drop("family", "ip_hi", "ip_lo")


@query("m07_merge_forwarder_protocol", f"""
  SELECT forwarder_id, protocol, {stamp('CASE WHEN t.last_update_ts IS NULL OR s.ts>t.last_update_ts THEN s.ts ELSE t.last_update_ts END')} AS last_update_ts
  FROM fx_forwarder_protocol t FULL JOIN (SELECT forwarder_id, p AS protocol, max(last_update_ts) AS ts FROM
   (SELECT forwarder_id, lower(trim(unnest(string_split(protocol, ',')))) AS p, last_update_ts FROM st_fall) GROUP BY 1,2) s USING (forwarder_id, protocol)""", EXTRA_F)
def _(t):
    return imported_f(t).table("forwarder_protocol")


@query("m09_merge_upstream_resolver", f"""
  SELECT forwarder_id, upstream_resolver_id, {stamp('CASE WHEN t.last_update_ts IS NULL OR s.ts>t.last_update_ts THEN s.ts ELSE t.last_update_ts END')} AS last_update_ts
  FROM fx_forwarder_resolver_upstream t FULL JOIN (SELECT forwarder_id, resolver_id AS upstream_resolver_id, max(ts) AS ts FROM st_fups JOIN fx_resolver ON ip_lo=up GROUP BY 1,2) s
  USING (forwarder_id, upstream_resolver_id)""", EXTRA_F)
def _(t):
    return imported_f(t).table("forwarder_resolver_upstream")


@query("m09_merge_upstream_forwarder", f"""
  SELECT forwarder_id, upstream_forwarder_id, {stamp('CASE WHEN t.last_update_ts IS NULL OR s.ts>t.last_update_ts THEN s.ts ELSE t.last_update_ts END')} AS last_update_ts
  FROM fx_forwarder_forwarder_upstream t FULL JOIN (
    SELECT st_fups.forwarder_id, coalesce(f.forwarder_id, a.forwarder_id) AS upstream_forwarder_id, max(ts) AS ts FROM st_fups LEFT JOIN fx_resolver r ON r.ip_lo=st_fups.up
    LEFT JOIN fx_forwarder f ON f.ip_lo=st_fups.up LEFT JOIN st_fall a ON a.ip_lo=st_fups.up
    WHERE r.ip IS NULL AND coalesce(f.forwarder_id, a.forwarder_id)<>st_fups.forwarder_id GROUP BY 1,2) s USING (forwarder_id, upstream_forwarder_id)""", EXTRA_F)
def _(t):
    return imported_f(t).table("forwarder_forwarder_upstream")


@query("m23_import_forwarders_report", """
  SELECT (SELECT count(*) FROM st_fstage) AS candidates, (SELECT count(*) FROM st_ffresh) AS inserted, count(*) AS updated,
    (SELECT count(*) FROM st_fstage)-(SELECT count(*) FROM st_funique) AS skipped, (SELECT count(*) FROM st_fstage)-(SELECT count(*) FROM st_funique) AS duplicate,
    count(*) FILTER (WHERE f.type<>u.type OR u.last_update_ts>f.last_update_ts) AS changed_existing, (SELECT count(*) FROM st_ffresh) AS growth
  FROM fx_forwarder f JOIN st_funique u USING (ip_lo)""", EXTRA_F)
def _(t):
    return imported_f(t).result("forwarder").report


@query("j13_classify_upstreams", f"""
  SELECT st_fups.forwarder_id, {v4('st_fups.up')} AS upstream_ip, r.resolver_id AS upstream_resolver_id,
    CASE WHEN r.ip IS NULL AND coalesce(f.forwarder_id, a.forwarder_id)<>st_fups.forwarder_id THEN coalesce(f.forwarder_id, a.forwarder_id) END AS upstream_forwarder_id
  FROM st_fups LEFT JOIN fx_resolver r ON r.ip_lo=st_fups.up LEFT JOIN fx_forwarder f ON f.ip_lo=st_fups.up LEFT JOIN st_fall a ON a.ip_lo=st_fups.up""", EXTRA_F)
def _(t):
    tables = ForwarderTables(t)
    stage = m.forwarder_rows(b.mapped(b.landed_forwarders(t), b.FORWARDER_MAPPING, ["upstream"], "forwarder"), "scan", now=b.now(), v6=False)
    numbered = m.number_rows(m.unique_rows(stage), t.forwarder, tables.forwarder_identity, "forwarder_id")
    return m.classify_upstreams(stage, numbered, t.resolver, t.forwarder).select("forwarder_id", "upstream_ip", "upstream_resolver_id", "upstream_forwarder_id")


# ---- anycast, spoofing, DNSSEC, minimisation ----------------------------------------------------------

BLEN = "(CASE WHEN s_suppkey%3=0 THEN 24 ELSE 12+s_suppkey%9 END)"


@query("m10_merge_anycast", f"""
  SELECT coalesce(t.prefix,s.prefix) AS prefix, coalesce(s.prefix,t.backing_prefix) AS backing_prefix, CASE WHEN s.prefix IS NULL THEN t.partial ELSE s.partial END AS partial,
    {stamp(f'CASE WHEN s.prefix IS NULL THEN t.last_update_ts ELSE {NOW} END')} AS last_update_ts, CASE WHEN s.prefix IS NULL THEN t.source ELSE 'next' END AS source
  FROM fx_anycast t FULL JOIN (SELECT {ptext(mask(aip('s_suppkey'), BLEN), BLEN)} AS prefix, bool_or(s_acctbal>3000) AS partial FROM supplier GROUP BY 1) s ON s.prefix=t.prefix""")
def _(t):
    return m.merge_anycast(t.anycast, m.with_metadata(b.anycast_batch(t), "next", b.now())).table.drop("family", "masklen", "net_hi", "net_lo")


@query("m11_merge_anycast_asn", f"""
  SELECT prefix, asn, {stamp(f"CASE WHEN s.prefix IS NULL THEN TIMESTAMP '2020-01-01' ELSE {NOW} END")} AS last_update_ts, CASE WHEN s.prefix IS NULL THEN 'old' ELSE 'next' END AS source
  FROM fx_anycast_asn t FULL JOIN (SELECT DISTINCT prefix, CASE WHEN asn%2=0 THEN asn ELSE asn+500 END AS asn FROM fx_anycast_asn) s USING (prefix, asn)""".replace("s.prefix IS NULL", "m IS NULL").replace(
    "SELECT DISTINCT prefix, CASE", "SELECT DISTINCT 1 AS m, prefix, CASE"))
def _(t):
    current = t.anycast_asn.withColumns({"last_update_ts": F.lit("2020-01-01").cast("timestamp"), "source": F.lit("old")})
    batch = t.anycast_asn.select("prefix", F.when(F.col("asn") % 2 == 0, F.col("asn")).otherwise(F.col("asn") + 500).alias("asn")).distinct()
    return m.merge_anycast_asn(current, m.with_metadata(batch, "next", b.now())).table


for _kind in ("country", "asn"):
    _n = f"{_kind}_count"
    _key = "CASE WHEN st%4=0 THEN 'ZZZ' ELSE country END" if _kind == "country" else "CASE WHEN st%4=0 THEN asn+1000 ELSE asn END"
    _when = f"(t.{_n} IS NULL OR (s.ts>t.last_update_ts AND s.n>t.{_n}))"

    @query(f"m12_merge_{_kind}_backend", f"""
      SELECT prefix, {_kind}, CASE WHEN {_when} THEN s.n ELSE t.{_n} END AS {_n}, {stamp(f'CASE WHEN {_when} THEN s.ts ELSE t.last_update_ts END')} AS last_update_ts,
        CASE WHEN {_when} THEN 'census-2' ELSE t.source END AS source
      FROM fx_anycast_{_kind}_backend t FULL JOIN (SELECT prefix, {_key} AS {_kind}, max({_n}+st%3-1) AS n, max(TIMESTAMP '2020-09-01' + to_days((st%5-2)::INT)) AS ts
        FROM (SELECT b.*, net_lo//65536 AS st FROM fx_anycast_{_kind}_backend b JOIN fx_anycast USING (prefix)) GROUP BY 1,2) s USING (prefix, {_kind})""")
    def _(t, kind=_kind):
        current = t.anycast_country_backend if kind == "country" else t.anycast_asn_backend
        return m.merge_backend(current, b.backend_batch(t, kind), kind).table


SPOOF_STAGE = f"""
  SELECT {ptext('net','16')} AS prefix, event_id%3=0 AS nat, CASE event_type WHEN 'click' THEN 'received' ELSE 'blocked' END AS privatespoof,
    CASE WHEN event_id%5<>0 THEN 64496+user_id%41 END AS asn, CASE WHEN event_id%6<>0 THEN {iso('user_id%25')} END AS country,
    date_trunc('day', ts) + to_days(((net>>16)%5-2)::INT) AS ts
  FROM (SELECT *, {mask('16777216+(user_id*104729+CASE WHEN user_id%7=0 THEN 65536 ELSE 0 END)%16777216','16')} AS net FROM events)
  QUALIFY row_number() OVER (PARTITION BY net ORDER BY event_id DESC)=1"""
EXTRA_S = {"st_sp": SPOOF_STAGE, "st_el": "SELECT s.* FROM st_sp s LEFT JOIN fx_spoofing t USING (prefix) WHERE t.last_update_ts IS NULL OR s.ts>t.last_update_ts"}


def spoof_merge(t):
    rows = m.spoofing_rows(b.spoofing_batch(t), "sessions", now=b.now(), v6=False)
    return m.merge_spoofing(t.spoofing, t.spoofing_asn, t.spoofing_country, rows)


@query("m13_merge_spoofing", f"""
  SELECT prefix, CASE WHEN w THEN s.nat ELSE t.nat END AS nat, CASE WHEN w THEN s.privatespoof ELSE t.privatespoof END AS privatespoof,
    CASE WHEN w THEN NULL ELSE t.routedspoof END AS routedspoof, {stamp('CASE WHEN w THEN s.ts ELSE t.last_update_ts END')} AS last_update_ts,
    CASE WHEN w THEN 'sessions' ELSE t.source END AS source
  FROM fx_spoofing t FULL JOIN (SELECT *, true AS w FROM st_el) s USING (prefix)""", EXTRA_S)
def _(t):
    return spoof_merge(t).table("spoofing").drop("family", "masklen", "net_hi", "net_lo")


for _kind in ("asn", "country"):

    @query(f"m13_merge_spoofing_{_kind}", f"SELECT prefix, coalesce(s.{_kind}, t.{_kind}) AS {_kind} FROM fx_spoofing_{_kind} t FULL JOIN (SELECT * FROM st_el WHERE {_kind} IS NOT NULL) s USING (prefix)", EXTRA_S)
    def _(t, kind=_kind):
        return spoof_merge(t).table(f"spoofing_{kind}")


@query("m14_merge_dnssec", f"""
  SELECT country, CASE WHEN w THEN v ELSE validating END AS validating, CASE WHEN w THEN v*1.5::DOUBLE ELSE validating_pc END AS validating_pc,
    CASE WHEN w THEN p ELSE partial_validating END AS partial_validating, CASE WHEN w THEN p*0.5::DOUBLE ELSE partial_validating_pc END AS partial_validating_pc,
    {stamp('CASE WHEN w THEN ts ELSE last_update_ts END')} AS last_update_ts, CASE WHEN w THEN 'next' ELSE source END AS source
  FROM (SELECT *, t.country IS NULL OR coalesce(s.ts>t.last_update_ts,false) AS w FROM fx_dnssec_country t FULL JOIN
    (SELECT {iso('s_nationkey')} AS country, count(*) AS v, count(*) FILTER (WHERE s_acctbal>0) AS p, TIMESTAMP '2020-08-01' + to_days((s_nationkey%3-1)::INT) AS ts
     FROM supplier WHERE s_nationkey%6<>0 GROUP BY s_nationkey) s USING (country))""")
def _(t):
    rows = m.dnssec_rows(b.dnssec_batch(t), "country", "next", iso_table(t.spark), b.now())
    return m.merge_dnssec(t.dnssec_country, rows, "country").table


EXTRA_Q = {
    "st_q": f"""SELECT {rip('(o_custkey+200)')} AS ip_lo, CASE o_orderkey%4 WHEN 0 THEN 'no' WHEN 2 THEN 'unstable' ELSE 'yes' END AS qmin,
       CASE WHEN o_orderkey%3<>0 THEN o_orderkey%20 END AS mm, o_orderkey%5 AS ol, date_trunc('day', o_orderdate)+to_days((o_orderkey%3-1)::INT) AS ts
     FROM orders WHERE o_orderkey%41<>0""",
    "st_qr": """SELECT resolver_id, qmin, mm, ol, ts FROM st_q JOIN fx_resolver USING (ip_lo)
     QUALIFY row_number() OVER (PARTITION BY resolver_id ORDER BY ts DESC, mm NULLS LAST, ol, qmin)=1""",
}


@query("m15_merge_qmin", f"""
  SELECT resolver_id, CASE WHEN s.ts IS NULL THEN t.qmin ELSE s.qmin END AS qmin, CASE WHEN s.ts IS NULL THEN max_minimise_count ELSE mm END AS max_minimise_count,
    CASE WHEN s.ts IS NULL THEN minimize_one_lab ELSE ol END AS minimize_one_lab,
    {stamp('CASE WHEN last_update_ts IS NULL OR s.ts>last_update_ts THEN s.ts ELSE last_update_ts END')} AS last_update_ts,
    {stamp("CASE WHEN s.qmin='yes' AND (last_update_ts IS NULL OR (t.qmin IS DISTINCT FROM 'yes' AND s.ts>last_update_ts)) THEN s.ts ELSE first_qmin_observation END")} AS first_qmin_observation,
    {stamp("CASE WHEN s.qmin='yes' AND (last_update_ts IS NULL OR s.ts>last_update_ts) THEN s.ts ELSE last_qmin_observation END")} AS last_qmin_observation,
    CASE WHEN s.ts IS NULL OR (s.ts<=last_update_ts AND t.qmin=s.qmin AND max_minimise_count IS NOT DISTINCT FROM mm AND minimize_one_lab=ol) THEN t.source ELSE 'probe' END AS source
  FROM fx_qmin_resolver t FULL JOIN st_qr s USING (resolver_id)""", EXTRA_Q)
def _(t):
    return m.import_qmin(Tables(t), b.landed_qmin(t), b.QMIN_MAPPING, "probe", now=b.now(), v6=False).table("qmin_resolver")


@query("j12_resolve_ids", "SELECT resolver_id, ip_lo, qmin FROM st_q JOIN fx_resolver USING (ip_lo)", EXTRA_Q)
def _(t):
    rows = m.qmin_rows(b.mapped(b.landed_qmin(t), b.QMIN_MAPPING, ["qmin"], "qmin"), "probe", b.now(), False)
    return m.resolve_ids(rows, t.resolver).select("resolver_id", "ip_lo", "qmin")


@query("j12_missing_resolvers", "SELECT ip_lo, count(*) AS n FROM st_q WHERE ip_lo NOT IN (SELECT ip_lo FROM fx_resolver) GROUP BY 1", EXTRA_Q)
def _(t):
    rows = m.qmin_rows(b.mapped(b.landed_qmin(t), b.QMIN_MAPPING, ["qmin"], "qmin"), "probe", b.now(), False)
    return m.missing_resolvers(rows, t.resolver).groupBy("ip_lo").agg(F.count(F.lit(1)).alias("n"))


@query("m15_report_qmin", """
  SELECT (SELECT count(*) FROM st_q) AS candidates, (SELECT count(*) FROM st_qr) AS matched, (SELECT count(*) FROM st_q WHERE ip_lo NOT IN (SELECT ip_lo FROM fx_resolver)) AS missing_resolver,
   i AS inserted, u AS updated, greatest((SELECT count(*) FROM st_q)-i-u-(SELECT count(*) FROM st_q WHERE ip_lo NOT IN (SELECT ip_lo FROM fx_resolver)),0) AS skipped
  FROM (SELECT count(*) FILTER (WHERE last_update_ts IS NULL) AS i, count(*) FILTER (WHERE s.ts>last_update_ts OR t.qmin<>s.qmin OR
     (last_update_ts IS NOT NULL AND max_minimise_count IS DISTINCT FROM mm) OR minimize_one_lab<>ol) AS u FROM st_qr s LEFT JOIN fx_qmin_resolver t USING (resolver_id))""", EXTRA_Q)
def _(t):
    return m.import_qmin(Tables(t), b.landed_qmin(t), b.QMIN_MAPPING, "probe", now=b.now(), v6=False).result("qmin").report


# ---- lookup metadata -----------------------------------------------------------------------------------

EXTRA_L = {
    "st_ptr": f"SELECT {rip('(o_custkey+200)')} AS ip_lo, 'ptr-'||(o_orderkey%30)::VARCHAR||'.example.com' AS domain FROM orders WHERE o_orderkey%9<>0",
    "st_ptru": "SELECT resolver_id, min(domain) AS domain FROM st_ptr JOIN fx_resolver USING (ip_lo) GROUP BY 1",
    "st_svcb": f"SELECT {rip('(o_custkey+200)')} AS ip_lo, o_orderkey AS k FROM orders",
}


@query("m16_merge_ptr_domain", f"""SELECT resolver_id, coalesce(s.domain, t.domain) AS domain, {stamp(f'CASE WHEN s.domain IS NULL THEN last_update_ts ELSE {NOW} END')} AS last_update_ts
  FROM fx_resolver_domain t FULL JOIN st_ptru s USING (resolver_id)""", EXTRA_L)
def _(t):
    return m.merge_ptr_domain(t.resolver_domain, b.ptr_batch(t), t.resolver, now=b.now(), v6=False).table


@query("m16_report_ptr_domain", """
  SELECT c AS candidates, i AS inserted, u AS updated, greatest(c-i-u,0) AS skipped, f-(i+u) AS duplicate, c-f AS missing_resolver FROM
   (SELECT (SELECT count(*) FROM st_ptr) AS c, (SELECT count(*) FROM st_ptr JOIN fx_resolver USING (ip_lo)) AS f,
     (SELECT count(*) FROM st_ptru WHERE resolver_id NOT IN (SELECT resolver_id FROM fx_resolver_domain)) AS i,
     (SELECT count(*) FROM st_ptru WHERE resolver_id IN (SELECT resolver_id FROM fx_resolver_domain)) AS u)""", EXTRA_L)
def _(t):
    return m.merge_ptr_domain(t.resolver_domain, b.ptr_batch(t), t.resolver, now=b.now(), v6=False).report


@query("m17_merge_svcb_services", f"""
  SELECT resolver_id, protocol, port, {stamp(f'CASE WHEN s.x IS NULL THEN last_update_ts ELSE {NOW} END')} AS last_update_ts
  FROM fx_resolver_service t FULL JOIN (SELECT DISTINCT resolver_id, unnest(CASE k%3 WHEN 0 THEN ['doh','doh3'] WHEN 1 THEN ['dot'] ELSE [] END) AS protocol, 443+k%2 AS port, 1 AS x
    FROM st_svcb JOIN fx_resolver USING (ip_lo) WHERE k%4<>0) s USING (resolver_id, protocol, port)""", EXTRA_L)
def _(t):
    return m.merge_svcb_services(t.resolver_service, b.svcb_batch(t), t.resolver, b.now(), False).table


@query("m18_merge_svcb_dohpath", f"""
  SELECT resolver_id, coalesce(s.dohpath, t.dohpath) AS dohpath, {stamp(f'CASE WHEN s.dohpath IS NULL THEN last_update_ts ELSE {NOW} END')} AS last_update_ts
  FROM fx_resolver_dohpath t FULL JOIN (SELECT resolver_id, min('/d'||(k%3)::VARCHAR) AS dohpath FROM st_svcb JOIN fx_resolver USING (ip_lo) WHERE k%7=0 GROUP BY 1) s USING (resolver_id)""", EXTRA_L)
def _(t):
    return m.merge_svcb_dohpath(t.resolver_dohpath, b.svcb_batch(t), t.resolver, b.now(), False).table


@query("m19_merge_ipv6_hints", f"""
  SELECT ip, resolver_id, is_public, {stamp('last_update_ts')} AS last_update_ts, source FROM fx_resolver UNION ALL
  SELECT '2001:db8:0:1::'||lower(to_hex(k%50+1)), min(resolver_id), true, {stamp(NOW)}, 'hints' FROM st_svcb JOIN fx_resolver USING (ip_lo) WHERE k%5=0 GROUP BY 1""", EXTRA_L)
def _(t):
    return m.merge_ipv6_hints(t.resolver, b.svcb_batch(t), "hints", b.now()).table.drop("family", "ip_hi", "ip_lo")


@query("m20_merge_svcb_reports", f"""
  SELECT 'domain' AS module, c AS candidates, i AS inserted FROM (SELECT (SELECT count(*) FROM st_svcb) AS c,
    (SELECT count(DISTINCT resolver_id) FROM st_svcb JOIN fx_resolver USING (ip_lo) WHERE resolver_id NOT IN (SELECT resolver_id FROM fx_resolver_domain)) AS i)
  UNION ALL SELECT 'ipv6hint', (SELECT count(*) FROM st_svcb WHERE k%5=0), (SELECT count(DISTINCT k%50) FROM st_svcb JOIN fx_resolver USING (ip_lo) WHERE k%5=0)
  UNION ALL SELECT 'dohpath', (SELECT count(*) FROM st_svcb WHERE k%7=0), (SELECT count(DISTINCT resolver_id) FROM st_svcb JOIN fx_resolver USING (ip_lo) WHERE k%7=0
     AND resolver_id NOT IN (SELECT resolver_id FROM fx_resolver_dohpath))""", EXTRA_L)
def _(t):
    return m.merge_svcb(Tables(t), b.svcb_batch(t), "hints", b.now(), False).report("domain", "dohpath", "ipv6hint").select("module", "candidates", "inserted")
