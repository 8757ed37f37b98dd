"""Report queries."""

from pyspark.sql import functions as F

from resolvescope.functions.clean import split_service
from resolvescope.plans import global_reports as g
from resolvescope.plans import resolver_reports as r
from resolvescope.plans import scope_reports as s
from workload.oracle_fixtures import ALLOW, CLOSED, RECEIVED, inside, pc, stamp
from workload.registry import query


class Dual:
    """The fixtures with IPv6 addresses added to the resolver relation."""

    def __init__(self, t):
        self._t = t

    def __getattr__(self, name):
        return self._t.resolver_dual if name == "resolver" else getattr(self._t, name)


# ---- shared DuckDB statements ----------------------------------------------------------------

SERVICES = "string_agg(DISTINCT protocol||':'||port::VARCHAR, ',' ORDER BY protocol||':'||port::VARCHAR)"
RECORDS = f"""
  SELECT r.resolver_id AS id, r.ip, asn, p.prefix AS bgp_prefix, org, domain, country, city, is_public,
    {stamp('r.last_update_ts')} AS last_observation_ts, r.source, supported_protocols
  FROM fx_resolver r LEFT JOIN fx_resolver_asn USING (resolver_id) LEFT JOIN fx_resolver_prefix p USING (resolver_id)
  LEFT JOIN fx_resolver_org USING (resolver_id) LEFT JOIN fx_resolver_domain USING (resolver_id)
  LEFT JOIN fx_resolver_location USING (resolver_id)
  LEFT JOIN (SELECT resolver_id, {SERVICES} AS supported_protocols FROM fx_resolver_service GROUP BY 1) USING (resolver_id)"""
EXTRA = {"st_records": RECORDS}

RA = f"""SELECT r.ip, r.resolver_id, a.prefix, a.partial, a.last_update_ts FROM fx_resolver r JOIN fx_anycast a ON {inside('r','a')}"""
RS = f"""SELECT r.ip, r.resolver_id, s.prefix, s.masklen, s.privatespoof, s.routedspoof, s.last_update_ts FROM fx_resolver r JOIN fx_spoofing s ON {inside('r','s')}"""
EXTRA |= {"st_ra": RA, "st_rs": RS}
ALTERNATIVE = """SELECT resolver_id, coalesce('domain:'||lower(domain), 'id:'||resolver_id::VARCHAR) AS group_key
  FROM (SELECT DISTINCT resolver_id FROM fx_resolver_dual) LEFT JOIN fx_resolver_domain USING (resolver_id)"""
EXTRA |= {"st_alt": ALTERNATIVE}


@query("q01_resolver_records", "SELECT * FROM st_records", EXTRA)
def _(t):
    return r.resolver_records(t)


@query("q01_resolver_records_first", "SELECT st_records.* FROM st_records JOIN fx_resolver USING (ip) ORDER BY ip_lo LIMIT 100", EXTRA)
def _(t):
    return r.resolver_records(t, limit=100)


for _kind, _col in (("ip", "ip"), ("prefix", "bgp_prefix"), ("asn", "asn"), ("country", "country"), ("domain", "lower(domain)")):

    @query(f"q02_records_by_{_kind}" if _kind != "domain" else "q03_records_by_domain",
           f"SELECT {_col} AS target, st_records.* FROM st_records WHERE {_col} IS NOT NULL", EXTRA)
    def _(t, kind=_kind):
        return r.records_by(t, kind)


@query("q02_records_by_country_limited", """
  SELECT target, id, ip FROM (SELECT country AS target, id, st_records.ip, row_number() OVER (PARTITION BY country ORDER BY ip_lo) AS n
  FROM st_records JOIN fx_resolver USING (ip) WHERE country IS NOT NULL) WHERE n<=10""", EXTRA)
def _(t):
    return r.records_by(t, "country", limit=10).select("target", "id", "ip")


@query("q04_records_by_service", f"""
  SELECT target, m.id, ip, asn, bgp_prefix, org, domain, country, city, is_public, last_observation_ts, source, m.supported_protocols
  FROM (SELECT protocol AS target, resolver_id AS id, {SERVICES} AS supported_protocols FROM fx_resolver_service GROUP BY 1,2
    UNION ALL SELECT protocol||':'||port::VARCHAR, resolver_id, {SERVICES} FROM fx_resolver_service GROUP BY 1,2) m
  JOIN st_records ON st_records.id=m.id""", EXTRA)
def _(t):
    names = t.resolver_service.select("protocol").distinct()
    pairs = t.resolver_service.select(F.concat_ws(":", "protocol", "port").alias("protocol")).distinct()
    cleaned = names.union(pairs).select(split_service(F.col("protocol")).alias("s")).select("s.protocol", "s.port")
    return r.records_by_service(t, cleaned)


@query("q05_resolver_core", """
  SELECT q.ip AS resolver_ip, f.resolver_id AS id, f.resolver_id IS NOT NULL AS found
  FROM (SELECT ip FROM fx_resolver UNION SELECT ip FROM fx_forwarder) q LEFT JOIN fx_resolver f ON f.ip=q.ip""")
def _(t):
    return r.resolver_core(t, t.resolver.select("ip").union(t.forwarder.select("ip")))


@query("q06_alternative_members", "SELECT group_key, ip, family FROM st_alt JOIN fx_resolver_dual USING (resolver_id)", EXTRA)
def _(t):
    return r.alternative_members(Dual(t))


@query("q06_alternative_ips", """
  SELECT d.resolver_id, f.ip, f.family FROM (SELECT max(resolver_id) AS resolver_id FROM st_alt GROUP BY group_key) d
  JOIN st_alt a ON a.resolver_id=d.resolver_id JOIN st_alt b ON b.group_key=a.group_key JOIN fx_resolver_dual f ON f.resolver_id=b.resolver_id""", EXTRA)
def _(t):
    # one asked identity per domain group: the answer is then as long as the table
    asked = r.alternative_groups(Dual(t)).groupBy("group_key").agg(F.max("resolver_id").alias("resolver_id")).select("resolver_id")
    return r.alternative_ips(Dual(t), asked)


@query("q06_sibling_ips", """
  SELECT d.ip AS resolver_ip, f.ip, f.family FROM (SELECT group_key, max(ip) AS ip FROM st_alt JOIN fx_resolver_dual USING (resolver_id) GROUP BY 1) d
  JOIN st_alt b ON b.group_key=d.group_key JOIN fx_resolver_dual f ON f.resolver_id=b.resolver_id WHERE f.ip<>d.ip""", EXTRA)
def _(t):
    asked = r.alternative_members(Dual(t)).groupBy("group_key").agg(F.max("ip").alias("ip")).select("ip")
    return r.sibling_ips(Dual(t), asked)


@query("q06_alternative_summary", """
  SELECT ip, group_key, alternative_ip_count, alternative_ip_count-1 AS sibling_ip_count, supports_ipv4, supports_ipv6
  FROM fx_resolver_dual JOIN st_alt USING (resolver_id) JOIN (SELECT group_key, count(*) AS alternative_ip_count, bool_or(family=4) AS supports_ipv4,
    bool_or(family=6) AS supports_ipv6 FROM fx_resolver_dual JOIN st_alt USING (resolver_id) GROUP BY 1) USING (group_key)""", EXTRA)
def _(t):
    return r.alternative_summary(Dual(t))


@query("q07_resolver_facets", f"""
  SELECT resolver_id, domain, dohpath, services FROM (SELECT DISTINCT resolver_id FROM fx_resolver) LEFT JOIN fx_resolver_domain USING (resolver_id)
  LEFT JOIN fx_resolver_dohpath USING (resolver_id)
  LEFT JOIN (SELECT resolver_id, {SERVICES} AS services FROM fx_resolver_service GROUP BY 1) USING (resolver_id)""")
def _(t):
    return r.resolver_facets(t)


@query("q08_resolver_qmin", f"""
  SELECT ip AS resolver_ip, qmin, max_minimise_count, minimize_one_lab, {stamp('first_qmin_observation')} AS first_qmin_observation,
   {stamp('last_qmin_observation')} AS last_qmin_observation, {stamp('q.last_update_ts')} AS last_update_ts, q.source
  FROM fx_resolver r LEFT JOIN fx_qmin_resolver q USING (resolver_id)""")
def _(t):
    return r.resolver_qmin(t)


@query("q08_resolver_dnssec", f"""SELECT r.ip AS resolver_ip, validates AS resolver_dnssec_validates, {stamp('d.last_update_ts')} AS resolver_dnssec_last_update_ts
  FROM fx_resolver r LEFT JOIN fx_dnssec_resolver d ON d.ip=r.ip""")
def _(t):
    return r.resolver_dnssec(t)


@query("q09_resolver_anycast", f"""
  SELECT r.ip, n IS NOT NULL AS anycast_found, coalesce(n,0) AS prefix_count, partial, last_update_ts FROM fx_resolver r LEFT JOIN
  (SELECT ip, count(*) AS n, bool_or(partial) AS partial, {stamp('max(last_update_ts)')} AS last_update_ts FROM st_ra GROUP BY 1) m ON m.ip=r.ip""".replace(
    "partial, last_update_ts FROM fx_resolver", "m.partial, m.last_update_ts FROM fx_resolver"), EXTRA)
def _(t):
    return r.resolver_anycast(t)


@query("q10_anycast_sites_country", f"""
  SELECT ip, b.country, sum(country_count)::BIGINT AS count, max(latitude) AS latitude, max(longitude) AS longitude,
    {stamp('max(b.last_update_ts)')} AS last_update_ts
  FROM st_ra JOIN fx_anycast_country_backend b USING (prefix) LEFT JOIN fx_country_location l ON l.country=b.country GROUP BY 1,2""", EXTRA)
def _(t):
    return r.resolver_anycast_sites(t, "country")


@query("q10_anycast_sites_asn", f"""
  SELECT ip, asn, sum(asn_count)::BIGINT AS count, {stamp('max(b.last_update_ts)')} AS last_update_ts
  FROM st_ra JOIN fx_anycast_asn_backend b USING (prefix) GROUP BY 1,2""", EXTRA)
def _(t):
    return r.resolver_anycast_sites(t, "asn")


SPOOF_AGG = f"""count(*) AS spoofing_prefix_count, count(*) FILTER (WHERE {ALLOW}) AS spoofing_allow_count,
  count(*) FILTER (WHERE {RECEIVED}) AS spoofing_received_count, count(*) FILTER (WHERE NOT {ALLOW} AND {CLOSED}) AS spoofing_blocked_count,
  count(*) FILTER (WHERE NOT ({ALLOW} OR {CLOSED})) AS spoofing_unknown_count"""
EXTRA["st_spoof"] = f"SELECT ip, {SPOOF_AGG}, max(last_update_ts) AS ts FROM st_rs GROUP BY 1"
SPOOF_NAMES = [f"spoofing_{n}_count" for n in ("prefix", "allow", "received", "blocked", "unknown")]


@query("q11_resolver_spoofing", f"""
  SELECT r.ip, {', '.join(f'coalesce({n},0) AS {n}' for n in SPOOF_NAMES)}, {pc('spoofing_allow_count','spoofing_prefix_count')} AS spoofing_allow_pc,
   {stamp('m.ts')} AS spoofing_last_update_ts FROM fx_resolver r LEFT JOIN st_spoof m ON m.ip=r.ip""", EXTRA)
def _(t):
    return r.resolver_spoofing(t)


@query("q11_spoofing_allow_prefixes", f"""SELECT ip, rank, prefix, privatespoof, routedspoof FROM
  (SELECT *, row_number() OVER (PARTITION BY ip ORDER BY masklen DESC, prefix) AS rank FROM st_rs WHERE {ALLOW}) WHERE rank<=10""", EXTRA)
def _(t):
    return r.spoofing_allow_prefixes(t)


for _kind, _table in (("asn", "fx_spoofing_asn"), ("country", "fx_spoofing_country")):

    @query(f"q12_spoofing_by_{_kind}", f"""
      SELECT {_kind} AS target, {SPOOF_AGG.replace(f'count(*) FILTER (WHERE {RECEIVED}) AS spoofing_received_count,', '')},
        {stamp('max(last_update_ts)')} AS spoofing_last_update_ts,
        {pc(f'count(*) FILTER (WHERE {ALLOW})','count(*)')} AS spoofing_allow_pc
      FROM fx_spoofing JOIN {_table} USING (prefix) GROUP BY 1""")
    def _(t, kind=_kind):
        return s.spoofing_by(t, kind)


@query("q13_dnssec_by_country", f"""SELECT country, validating_pc AS dnssec_validating_pc, partial_validating_pc AS dnssec_partial_validating_pc,
  {stamp('last_update_ts')} AS dnssec_last_update_ts FROM fx_dnssec_country""")
def _(t):
    return s.dnssec_by_country(t)


SCOPES = {
    "asn": "SELECT DISTINCT asn AS target, resolver_id FROM fx_resolver_asn",
    "country": "SELECT DISTINCT country AS target, resolver_id FROM fx_resolver_location",
    "prefix": "SELECT DISTINCT prefix AS target, resolver_id FROM fx_resolver_prefix",
    "qmin": "SELECT DISTINCT CASE qmin WHEN 'yes' THEN 'enabled' ELSE 'disabled' END AS target, resolver_id FROM fx_qmin_resolver WHERE qmin IN ('yes','no')",
    "global": "SELECT DISTINCT 'global' AS target, resolver_id FROM fx_resolver",
}


def scope_extra(kind: str) -> dict[str, str]:
    return {**EXTRA, "st_scope": SCOPES[kind]}


for _kind in ("asn", "country", "prefix"):

    @query(f"q14_qmin_by_{_kind}", f"""
      SELECT target, count(q.resolver_id) AS measured_count, count(*) FILTER (WHERE qmin='yes') AS yes_count,
        count(*) FILTER (WHERE qmin='no') AS no_count, count(*) FILTER (WHERE qmin='unstable') AS unstable_count,
        count(*) FILTER (WHERE max_minimise_count>10) AS amplification_risk_count, {stamp('max(last_update_ts)')} AS last_update_ts,
        {pc("count(*) FILTER (WHERE qmin='yes')", 'count(q.resolver_id)')} AS yes_pc, {pc("count(*) FILTER (WHERE qmin='no')", 'count(q.resolver_id)')} AS no_pc,
        {pc('count(*) FILTER (WHERE max_minimise_count>10)', 'count(q.resolver_id)')} AS amplification_risk_pc
      FROM st_scope LEFT JOIN fx_qmin_resolver q USING (resolver_id) GROUP BY 1""", scope_extra(_kind))
    def _(t, kind=_kind):
        return s.qmin_by(t, kind)


for _kind, _value in (("asn", "max_minimise_count"), ("country", "minimize_one_lab"), ("prefix", "max_minimise_count")):

    @query(f"q14_qmin_distribution_by_{_kind}", f"""
      SELECT target, value, count, rank, {pc('count','total')} AS percent FROM (
        SELECT *, sum(count) OVER (PARTITION BY target) AS total, row_number() OVER (PARTITION BY target ORDER BY count DESC, value) AS rank FROM (
          SELECT target, {_value} AS value, count(*) AS count FROM st_scope JOIN fx_qmin_resolver USING (resolver_id) WHERE {_value} IS NOT NULL GROUP BY 1,2)) WHERE rank<=10""",
           scope_extra(_kind))
    def _(t, kind=_kind, value=_value):
        return s.qmin_distribution_by(t, kind, value)


TOTALS = """SELECT target, count(DISTINCT st_scope.resolver_id) AS matched_resolver_count,
  count(DISTINCT st_scope.resolver_id)-count(DISTINCT p.resolver_id) AS unmapped_resolver_count, count(DISTINCT prefix) AS total_prefixes
  FROM st_scope LEFT JOIN fx_resolver_prefix p ON p.resolver_id=st_scope.resolver_id GROUP BY 1"""


def page_sql(low: int, high: int) -> str:
    return f"""SELECT * FROM (SELECT target, prefix, resolver_count, row_number() OVER (PARTITION BY target ORDER BY resolver_count DESC, prefix) AS rank
      FROM (SELECT target, prefix, count(DISTINCT resolver_id) AS resolver_count FROM st_scope JOIN fx_resolver_prefix USING (resolver_id) GROUP BY 1,2))
      WHERE rank>{low} AND rank<={high}"""


for _kind in ("asn", "country", "qmin"):

    @query(f"q15_prefix_totals_{_kind}", TOTALS, scope_extra(_kind))
    def _(t, kind=_kind):
        return s.prefix_totals(t, s.scope(t, kind))

    @query(f"q16_prefixes_by_{_kind}", page_sql(0, 25), scope_extra(_kind))
    def _(t, kind=_kind):
        return s.prefixes_by(t, kind)


@query("q16_prefixes_by_country_second_page", page_sql(10, 20), scope_extra("country"))
def _(t):
    return s.prefixes_by(t, "country", 2, 10)


for _kind in ("global", "asn", "country", "prefix"):
    _risk = {**EXTRA, "st_base": SCOPES[_kind],
             "st_scope": "SELECT DISTINCT target, resolver_id FROM st_base JOIN fx_qmin_resolver USING (resolver_id) WHERE max_minimise_count>10"}

    @query(f"q17_risk_prefixes_{_kind}", page_sql(0, 25), _risk)
    def _(t, kind=_kind):
        return s.risk_prefixes_by(t, kind)


AP = "SELECT asn AS target, prefix FROM fx_anycast_asn UNION SELECT asn, prefix FROM fx_anycast_asn_backend"
EXTRA["st_ap"] = AP


@query("q18_anycast_by_asn", f"SELECT target, count(DISTINCT prefix) AS prefix_count, {stamp('max(last_update_ts)')} AS last_update_ts FROM st_ap JOIN fx_anycast USING (prefix) GROUP BY 1", EXTRA)
def _(t):
    return s.anycast_by_asn(t)


@query("q18_anycast_by_country", f"""SELECT country AS target, count(DISTINCT prefix) AS prefix_count, sum(country_count)::BIGINT AS site_count,
  {stamp('max(b.last_update_ts)')} AS last_update_ts FROM fx_anycast_country_backend b JOIN fx_anycast USING (prefix) GROUP BY 1""")
def _(t):
    return s.anycast_by_country(t)


_CP = "SELECT DISTINCT country AS target, prefix FROM fx_anycast_country_backend"
for _kind in ("asn", "country"):
    _pairs = AP if _kind == "asn" else _CP

    @query(f"q19_anycast_sites_by_{_kind}_asn", f"SELECT target, asn, sum(asn_count)::BIGINT AS count FROM ({_pairs}) JOIN fx_anycast_asn_backend USING (prefix) GROUP BY 1,2", EXTRA)
    def _(t, kind=_kind):
        return s.anycast_sites_by(t, kind, "asn")


@query("q19_anycast_sites_by_asn_country", """
  SELECT target, b.country, sum(country_count)::BIGINT AS count, max(latitude) AS latitude, max(longitude) AS longitude
  FROM st_ap JOIN fx_anycast_country_backend b USING (prefix) LEFT JOIN fx_country_location l ON l.country=b.country GROUP BY 1,2""", EXTRA)
def _(t):
    return s.anycast_sites_by(t, "asn", "country")


@query("q19_anycast_sites_by_country_country", """
  SELECT b.country AS target, b.country, sum(country_count)::BIGINT AS count, max(latitude) AS latitude, max(longitude) AS longitude
  FROM fx_anycast_country_backend b LEFT JOIN fx_country_location l ON l.country=b.country GROUP BY 1,2""")
def _(t):
    return s.anycast_sites_by(t, "country", "country")


EXTRA["st_flag"] = f"SELECT ip, resolver_id, is_public, EXISTS (SELECT 1 FROM fx_anycast a WHERE {inside('fx_resolver','a')}) AS anycast FROM fx_resolver"


def counts_sql(kind: str) -> str:
    owner = {"asn": ("fx_resolver_asn", "fx_forwarder_asn", "fx_spoofing_asn"), "country": ("fx_resolver_location", "fx_forwarder_location", "fx_spoofing_country")}[kind]
    if kind == "asn":
        anycast = """SELECT target, count(DISTINCT prefix) AS anycast_prefix_count, coalesce(sum(c),0)::BIGINT AS anycast_country_instance_count,
          max(coalesce(o,0))::BIGINT AS anycast_asn_instance_count
          FROM st_ap LEFT JOIN (SELECT prefix, sum(country_count) AS c FROM fx_anycast_country_backend GROUP BY 1) USING (prefix)
          LEFT JOIN (SELECT asn AS target, sum(asn_count) AS o FROM fx_anycast_asn_backend GROUP BY 1) USING (target) GROUP BY 1"""
        dnssec, dcols = "", ""
    else:
        anycast = """SELECT country AS target, count(DISTINCT prefix) AS anycast_prefix_count, sum(country_count)::BIGINT AS anycast_country_instance_count,
          coalesce(sum(a),0)::BIGINT AS anycast_asn_instance_count
          FROM fx_anycast_country_backend LEFT JOIN (SELECT prefix, sum(asn_count) AS a FROM fx_anycast_asn_backend GROUP BY 1) USING (prefix) GROUP BY 1"""
        dnssec = "FULL JOIN (SELECT country AS target, validating_pc, partial_validating_pc, last_update_ts AS dts FROM fx_dnssec_country) USING (target)"
        dcols = f", validating_pc AS dnssec_validating_pc, partial_validating_pc AS dnssec_partial_validating_pc, {stamp('dts')} AS dnssec_last_update_ts"
    z = lambda names: ", ".join(f"coalesce({n},0) AS {n}" for n in names.split())
    return f"""
      SELECT target, {z('resolver_count public_resolver_count closed_resolver_count anycast_resolver_count qmin_measured_count qmin_yes_count qmin_no_count qmin_unstable_count forwarder_count recursive_forwarder_count transparent_forwarder_count anycast_prefix_count anycast_country_instance_count anycast_asn_instance_count spoofing_prefix_count spoofing_allow_count spoofing_blocked_count spoofing_unknown_count')},
        {stamp('sts')} AS spoofing_last_update_ts, {pc('anycast_resolver_count','resolver_count')} AS anycast_resolver_pc,
        {pc('qmin_yes_count','qmin_measured_count')} AS qmin_yes_pc, {pc('qmin_no_count','qmin_measured_count')} AS qmin_no_pc,
        {pc('spoofing_allow_count','spoofing_prefix_count')} AS spoofing_allow_pc {dcols}
      FROM (SELECT {kind} AS target, count(*) AS resolver_count, count(*) FILTER (WHERE is_public) AS public_resolver_count,
          count(*) FILTER (WHERE NOT is_public) AS closed_resolver_count, count(*) FILTER (WHERE anycast) AS anycast_resolver_count,
          count(q.resolver_id) AS qmin_measured_count, count(*) FILTER (WHERE qmin='yes') AS qmin_yes_count,
          count(*) FILTER (WHERE qmin='no') AS qmin_no_count, count(*) FILTER (WHERE qmin='unstable') AS qmin_unstable_count
        FROM st_flag JOIN {owner[0]} o USING (resolver_id) LEFT JOIN fx_qmin_resolver q USING (resolver_id) GROUP BY 1)
      FULL JOIN (SELECT {kind} AS target, count(*) AS forwarder_count, count(*) FILTER (WHERE type='recursive') AS recursive_forwarder_count,
          count(*) FILTER (WHERE type='transparent') AS transparent_forwarder_count
        FROM fx_forwarder JOIN {owner[1]} USING (forwarder_id) GROUP BY 1) USING (target)
      FULL JOIN ({anycast}) USING (target)
      FULL JOIN (SELECT {kind} AS target, count(*) AS spoofing_prefix_count, count(*) FILTER (WHERE {ALLOW}) AS spoofing_allow_count,
          count(*) FILTER (WHERE NOT {ALLOW} AND {CLOSED}) AS spoofing_blocked_count, count(*) FILTER (WHERE NOT ({ALLOW} OR {CLOSED})) AS spoofing_unknown_count,
          max(last_update_ts) AS sts FROM fx_spoofing JOIN {owner[2]} USING (prefix) GROUP BY 1) USING (target)
      {dnssec}"""


@query("q20_country_counts", counts_sql("country"), EXTRA)
def _(t):
    return s.country_counts(t)


@query("q21_asn_counts", counts_sql("asn"), EXTRA)
def _(t):
    return s.asn_counts(t)


PREFIX_COUNTS = """SELECT prefix AS target, count(DISTINCT resolver_id) AS resolver_count, count(DISTINCT resolver_id) FILTER (WHERE is_public) AS public_resolver_count,
  count(DISTINCT resolver_id) FILTER (WHERE NOT is_public) AS closed_resolver_count, count(DISTINCT resolver_id) FILTER (WHERE anycast) AS anycast_resolver_count
  FROM st_flag JOIN fx_resolver_prefix USING (resolver_id) GROUP BY 1"""


@query("q22_prefix_counts", PREFIX_COUNTS, EXTRA)
def _(t):
    return s.prefix_counts(t)


EXTRA["st_affected"] = f"SELECT DISTINCT resolver_id FROM st_rs WHERE {ALLOW}"
EXTRA["st_qasn"] = f"SELECT DISTINCT asn FROM fx_spoofing_asn JOIN fx_spoofing USING (prefix) WHERE {ALLOW}"


def entity_sql(key: str, grouped: str) -> str:
    return f"""SELECT {key}, resolver_count, prefix_count, t.total_entities, t.matched_resolver_count FROM
      (SELECT count(*) AS total_entities, coalesce(sum(resolver_count),0)::BIGINT AS matched_resolver_count FROM ({grouped})) t
      LEFT JOIN (SELECT * FROM ({grouped}) ORDER BY resolver_count DESC, {key} LIMIT 25) ON true"""


@query("q23_spoofing_countries", entity_sql("country", """SELECT country, count(DISTINCT resolver_id) AS resolver_count, count(DISTINCT prefix) AS prefix_count
  FROM st_affected JOIN fx_resolver_location USING (resolver_id) LEFT JOIN fx_resolver_prefix USING (resolver_id) GROUP BY 1"""), EXTRA)
def _(t):
    return s.entity_page(s.spoofing_countries(t), "country")


@query("q24_spoofing_asns", entity_sql("asn", """SELECT asn, count(resolver_id) AS resolver_count, count(DISTINCT prefix) AS prefix_count
  FROM st_qasn JOIN fx_resolver_asn USING (asn) LEFT JOIN fx_resolver_prefix USING (resolver_id) GROUP BY 1"""), EXTRA)
def _(t):
    return s.entity_page(s.spoofing_asns(t), "asn")


@query("q25_spoofing_prefixes_country", page_sql(0, 25),
       {**EXTRA, "st_scope": "SELECT DISTINCT country AS target, resolver_id FROM fx_resolver_location JOIN st_affected USING (resolver_id)"})
def _(t):
    return s.spoofing_prefixes_by(t, "country")


@query("q25_spoofing_prefixes_asn", page_sql(0, 25),
       {**EXTRA, "st_scope": "SELECT DISTINCT asn AS target, resolver_id FROM fx_resolver_asn JOIN st_qasn USING (asn)"})
def _(t):
    return s.spoofing_prefixes_by(t, "asn")


@query("q26_global_ip_version", f"""SELECT family, count(*) AS resolver_count, count(*) FILTER (WHERE is_public) AS public_count,
  {stamp('max(last_update_ts)')} AS last_observation_ts, {pc('count(*) FILTER (WHERE is_public)','count(*)')} AS public_percent FROM fx_resolver_dual GROUP BY 1""")
def _(t):
    return g.global_ip_version(Dual(t)).withColumn("family", F.col("family").cast("int"))


@query("q27_global_dual_stack", "SELECT count(*) AS dual_stack_count FROM (SELECT resolver_id FROM fx_resolver_dual GROUP BY 1 HAVING bool_or(family=4) AND bool_or(family=6))")
def _(t):
    return g.global_dual_stack(Dual(t))


@query("q28_global_scope", f"""SELECT (SELECT count(*) FROM fx_resolver) AS resolver_count, (SELECT count(DISTINCT asn) FROM fx_resolver_asn) AS resolver_unique_asn_count,
  (SELECT count(DISTINCT country) FROM fx_resolver_location) AS resolver_unique_country_count, (SELECT {stamp('max(last_update_ts)')} FROM fx_resolver) AS last_observation_ts""")
def _(t):
    return g.global_scope(t)


@query("q29_global_anycast", f"""SELECT count(*) AS resolver_count, count(*) FILTER (WHERE anycast) AS resolver_anycast_count,
  {pc('count(*) FILTER (WHERE anycast)','count(*)')} AS resolver_anycast_pc FROM st_flag""", EXTRA)
def _(t):
    return g.global_anycast(t)


REACH = """SELECT ip, coalesce(s,0)::BIGINT AS anycast_site_count, c AS anycast_country_count, coalesce(n,0) AS anycast_asn_count FROM
  (SELECT ip, sum(country_count) AS s, count(DISTINCT country) AS c FROM st_ra LEFT JOIN fx_anycast_country_backend USING (prefix) GROUP BY 1)
  LEFT JOIN (SELECT ip, count(DISTINCT asn) AS n FROM st_ra LEFT JOIN fx_anycast_asn_backend USING (prefix) GROUP BY 1) USING (ip)"""
EXTRA["st_reach"] = REACH


@query("q29_anycast_reach", REACH, EXTRA)
def _(t):
    return g.anycast_reach(t)


@query("q29_top_anycast", f"SELECT * FROM ({REACH}) ORDER BY anycast_site_count DESC, anycast_country_count DESC, anycast_asn_count DESC, ip LIMIT 5", EXTRA)
def _(t):
    return g.top_anycast(t)


@query("q30_global_qmin", f"""SELECT *, {pc('qmin_enabled_count','qmin_measured_count')} AS qmin_enabled_pc, {pc('qmin_amplification_risk_count','qmin_measured_count')} AS qmin_amplification_risk_pc
  FROM (SELECT count(DISTINCT resolver_id) AS qmin_measured_count, count(DISTINCT resolver_id) FILTER (WHERE qmin='yes') AS qmin_enabled_count,
  count(DISTINCT resolver_id) FILTER (WHERE max_minimise_count>10) AS qmin_amplification_risk_count FROM fx_qmin_resolver)""")
def _(t):
    return g.global_qmin(t)


for _value in ("max_minimise_count", "minimize_one_lab"):

    @query(f"q30_global_{_value}", f"""SELECT value, count, {pc('count','total')} AS percent FROM (SELECT *, sum(count) OVER () AS total FROM
      (SELECT {_value} AS value, count(*) AS count FROM fx_qmin_resolver WHERE {_value} IS NOT NULL GROUP BY 1)) ORDER BY count DESC, value LIMIT 10""")
    def _(t, value=_value):
        return g.global_qmin_distribution(t, value)


@query("q31_global_protocols", f"""SELECT level, protocol, port, count, resolver_count, {pc('count','resolver_count')} AS percent FROM (
   SELECT 'protocol' AS level, protocol, NULL AS port, count(DISTINCT resolver_id) AS count FROM fx_resolver_service GROUP BY protocol
   UNION ALL SELECT 'port', NULL, port, count(DISTINCT resolver_id) FROM fx_resolver_service GROUP BY port
   UNION ALL SELECT 'service', protocol, port, count(DISTINCT resolver_id) FROM fx_resolver_service GROUP BY protocol, port),
   (SELECT count(DISTINCT resolver_id) AS resolver_count FROM fx_resolver)""")
def _(t):
    return g.global_protocols(t)


@query("q32_global_spoofing", f"""SELECT *, {pc('resolver_spoofing_allow_count','resolver_count')} AS resolver_spoofing_allow_pc,
   {pc('resolver_spoofing_blocked_count','resolver_count')} AS resolver_spoofing_blocked_pc,
   {pc('resolver_spoofing_allow_asn_resolver_count','resolver_count')} AS resolver_spoofing_allow_asn_resolver_pc FROM (SELECT
   (SELECT count(*) FROM fx_resolver) AS resolver_count, (SELECT count(DISTINCT ip) FROM st_rs WHERE {ALLOW}) AS resolver_spoofing_allow_count,
   (SELECT count(DISTINCT ip) FROM st_rs WHERE NOT {ALLOW} AND {CLOSED}) AS resolver_spoofing_blocked_count,
   (SELECT count(DISTINCT resolver_id) FROM fx_resolver_asn WHERE asn IN (SELECT asn FROM st_qasn)) AS resolver_spoofing_allow_asn_resolver_count,
   (SELECT count(DISTINCT asn) FROM fx_resolver_asn WHERE asn IN (SELECT asn FROM st_qasn)) AS spoofing_allow_asn_match_count)""", EXTRA)
def _(t):
    return g.global_spoofing(t)


@query("q33_global_countries", """SELECT l.country, count(*) AS count, count(*) FILTER (WHERE is_public) AS public_count, count(*) FILTER (WHERE NOT is_public) AS closed_count,
  max(latitude) AS latitude, max(longitude) AS longitude FROM fx_resolver_location l JOIN fx_resolver USING (resolver_id)
  LEFT JOIN fx_country_location c ON c.country=l.country GROUP BY 1 ORDER BY count DESC, 1 LIMIT 250""")
def _(t):
    return g.global_countries(t)


@query("q34_global_asns", "SELECT asn, count(DISTINCT resolver_id) AS count FROM fx_resolver_asn GROUP BY 1 ORDER BY count DESC, asn LIMIT 10")
def _(t):
    return g.global_asns(t)


@query("q35_global_dnssec", f"SELECT count(DISTINCT country) AS dnssec_country_count, round(avg(validating_pc),2) AS dnssec_validating_avg, {stamp('max(last_update_ts)')} AS last_update_ts FROM fx_dnssec_country")
def _(t):
    return g.global_dnssec(t)


EXTRA["st_relay"] = """SELECT ip, forwarder_id FROM fx_forwarder_resolver_upstream JOIN fx_resolver ON resolver_id=upstream_resolver_id
  UNION SELECT f.ip, u.forwarder_id FROM fx_forwarder_forwarder_upstream u JOIN fx_forwarder f ON f.forwarder_id=u.upstream_forwarder_id"""
EXTRA["st_relays"] = """SELECT ip, count(DISTINCT forwarder_id) AS forwarder_entry_count, count(DISTINCT asn) AS forwarder_asn_count,
  count(DISTINCT country) AS forwarder_country_count,
  count(DISTINCT forwarder_id) FILTER (WHERE forwarder_id IN (SELECT forwarder_id FROM fx_forwarder_protocol WHERE lower(protocol)='tcp')) AS forwarder_tcp_count,
  count(DISTINCT forwarder_id) FILTER (WHERE forwarder_id IN (SELECT forwarder_id FROM fx_forwarder_protocol WHERE lower(protocol)='udp')) AS forwarder_udp_count,
  count(DISTINCT forwarder_id) FILTER (WHERE forwarder_id IN (SELECT forwarder_id FROM fx_forwarder_protocol WHERE lower(protocol)='tcp')
    AND forwarder_id IN (SELECT forwarder_id FROM fx_forwarder_protocol WHERE lower(protocol)='udp')) AS forwarder_tcp_udp_count
  FROM st_relay LEFT JOIN fx_forwarder_asn USING (forwarder_id) LEFT JOIN fx_forwarder_location USING (forwarder_id) GROUP BY 1"""


@query("q36_forwarder_relays", "SELECT * FROM st_relays", EXTRA)
def _(t):
    return r.forwarder_relays(t)


for _kind, _table in (("country", "fx_forwarder_location"), ("asn", "fx_forwarder_asn")):

    @query(f"q36_forwarder_relays_by_{_kind}", f"SELECT ip, {_kind}, count(DISTINCT forwarder_id) AS count FROM st_relay JOIN {_table} USING (forwarder_id) GROUP BY 1,2", EXTRA)
    def _(t, kind=_kind):
        return r.forwarder_relays_by(t, kind)


ALT4 = ALTERNATIVE.replace("fx_resolver_dual", "fx_resolver")
EXTRA["st_alt4"] = f"""SELECT ip, n AS alternative_ip_count, true AS supports_ipv4, false AS supports_ipv6 FROM fx_resolver JOIN ({ALT4}) USING (resolver_id)
  JOIN (SELECT group_key, count(*) AS n FROM fx_resolver JOIN ({ALT4}) USING (resolver_id) GROUP BY 1) USING (group_key)"""
_RELAY = ", ".join(f"coalesce({n},0) AS {n}" for n in r.RELAY_COUNTS)
SUMMARY = f"""
  SELECT x.ip AS resolver_ip, 4 AS family, x.id AS resolver_id, x.asn AS resolver_asn, bgp_prefix AS resolver_prefix, country AS resolver_country, city AS resolver_city,
    org AS resolver_org, domain AS resolver_domain, qmin AS resolver_qmin, max_minimise_count AS resolver_qmin_max_minimise_count,
    minimize_one_lab AS resolver_qmin_minimize_one_lab, dohpath AS resolver_dohpath, validates AS resolver_dnssec_validates, is_public AS resolver_is_public,
    supported_protocols AS resolver_supported_protocols, coalesce(supported_protocols,'') LIKE '%dotcp%' AS resolver_supports_tcp,
    coalesce(supported_protocols,'') LIKE '%doudp%' AS resolver_supports_udp, supports_ipv4 AS resolver_supports_ipv4, supports_ipv6 AS resolver_supports_ipv6,
    alternative_ip_count, alternative_ip_count-1 AS sibling_ip_count, {', '.join(f'coalesce({n},0) AS {n}' for n in SPOOF_NAMES)},
    {pc('spoofing_allow_count','spoofing_prefix_count')} AS spoofing_allow_pc, {stamp('sp.ts')} AS spoofing_last_update_ts, rc.ip IS NOT NULL AS anycast_found,
    coalesce(anycast_site_count,0) AS anycast_site_count, coalesce(anycast_country_count,0) AS anycast_country_count, coalesce(anycast_asn_count,0) AS anycast_asn_count,
    {_RELAY}, last_observation_ts
  FROM st_records x LEFT JOIN fx_qmin_resolver q ON q.resolver_id=x.id LEFT JOIN fx_resolver_dohpath d ON d.resolver_id=x.id
  LEFT JOIN fx_dnssec_resolver dr ON dr.ip=x.ip JOIN st_alt4 al ON al.ip=x.ip LEFT JOIN st_spoof sp ON sp.ip=x.ip
  LEFT JOIN st_reach rc ON rc.ip=x.ip LEFT JOIN st_relays rl ON rl.ip=x.ip"""
EXTRA["st_summary"] = SUMMARY


@query("q37_resolver_summary", "SELECT * FROM st_summary", EXTRA)
def _(t):
    return r.resolver_summary(t.lines_written()).withColumn("family", F.col("family").cast("int"))


@query("q38_domain_summary", """
  SELECT b.*, coalesce(anycast_country_count,0) AS anycast_country_count, resolver_supported_protocols FROM (
   SELECT lower(resolver_domain) AS domain, count(*) AS domain_resolver_count, count(*) FILTER (WHERE resolver_is_public) AS domain_public_count,
    count(DISTINCT resolver_asn) AS resolver_asn, count(DISTINCT resolver_country) AS resolver_country, count(DISTINCT resolver_prefix) AS resolver_prefix,
    count(DISTINCT resolver_org) AS resolver_org, min(resolver_dohpath) AS resolver_dohpath,
    CASE WHEN count(resolver_qmin)>0 THEN 'Measured '||count(resolver_qmin)||'/'||count(*) END AS resolver_qmin,
    CASE WHEN count(DISTINCT resolver_dnssec_validates)=1 THEN bool_or(resolver_dnssec_validates) END AS resolver_dnssec_validates,
    bool_or(resolver_supports_tcp) AS resolver_supports_tcp, bool_or(resolver_supports_udp) AS resolver_supports_udp,
    true AS resolver_supports_ipv4, false AS resolver_supports_ipv6, false AS domain_is_dual_stack,
    count(*) FILTER (WHERE resolver_is_public)>0 AS resolver_is_public,
    sum(spoofing_prefix_count)::BIGINT AS spoofing_prefix_count, sum(spoofing_allow_count)::BIGINT AS spoofing_allow_count, sum(spoofing_received_count)::BIGINT AS spoofing_received_count,
    sum(spoofing_blocked_count)::BIGINT AS spoofing_blocked_count, sum(spoofing_unknown_count)::BIGINT AS spoofing_unknown_count,
    bool_or(anycast_found) AS anycast_found, sum(anycast_site_count)::BIGINT AS anycast_site_count, sum(anycast_asn_count)::BIGINT AS anycast_asn_count,
    max(last_observation_ts) AS last_observation_ts
   FROM st_summary WHERE resolver_domain IS NOT NULL GROUP BY 1) b
  LEFT JOIN (SELECT lower(domain) AS domain, count(DISTINCT country) AS anycast_country_count FROM st_ra JOIN fx_resolver_domain USING (resolver_id)
    JOIN fx_anycast_country_backend USING (prefix) GROUP BY 1) c ON c.domain=b.domain
  LEFT JOIN (SELECT lower(domain) AS domain, string_agg(DISTINCT protocol||':'||port::VARCHAR, ',' ORDER BY protocol||':'||port::VARCHAR) AS resolver_supported_protocols
    FROM fx_resolver_domain JOIN fx_resolver_service USING (resolver_id) GROUP BY 1) v ON v.domain=b.domain""", EXTRA)
def _(t):
    return r.domain_summary(t.lines_written())


@query("q39_target_response_prefix", f"""SELECT bgp_prefix AS target, st_records.*, resolver_count, public_resolver_count, closed_resolver_count, anycast_resolver_count
  FROM st_records JOIN ({PREFIX_COUNTS}) n ON n.target=bgp_prefix""", EXTRA)
def _(t):
    return s.target_response(t, "prefix")


@query("q39_target_response_country", f"SELECT st_records.*, n.* FROM st_records JOIN ({counts_sql('country')}) n ON n.target=country", EXTRA)
def _(t):
    return s.target_response(t, "country")


@query("q40_browse", """SELECT * FROM st_records WHERE is_public AND (contains(ip,'9') OR contains(asn::VARCHAR,'9') OR contains(lower(country),'9') OR contains(lower(org),'9'))""", EXTRA)
def _(t):
    return r.browse(r.resolver_records(t), search="9", is_public=True)


@query("a12_table_counts", """SELECT 'resolver' AS table_name, count(*) AS row_count, count(*)>0 AS loaded FROM fx_resolver UNION ALL
  SELECT 'forwarder', count(*), count(*)>0 FROM fx_forwarder UNION ALL SELECT 'anycast', count(*), count(*)>0 FROM fx_anycast UNION ALL
  SELECT 'spoofing', count(*), count(*)>0 FROM fx_spoofing UNION ALL SELECT 'dnssec_country', count(*), count(*)>0 FROM fx_dnssec_country""")
def _(t):
    return g.table_counts({n: getattr(t, n) for n in ("resolver", "forwarder", "anycast", "spoofing", "dnssec_country")})
