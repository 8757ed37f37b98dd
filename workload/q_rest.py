"""Cleaning expressions, relational helpers, sources, feeds and older loads."""

from pyspark.sql import functions as F

from resolvescope.functions import clean as c
from resolvescope.functions import countries as cc
from resolvescope.operators import rows as w
from resolvescope.plans import contracts, feeds, legacy, imports
from resolvescope.sources import readers, registry
from workload import batches as b
from workload.fixtures import ISO, iso as iso_col
from workload.oracle_fixtures import iso, rip, stamp, v4, pc
from workload.registry import query

NOW = f"TIMESTAMP '{b.NOW}'"


def key():
    return F.col("o_orderkey")


def pick(index, *words):
    """Word of a list by index, as a Spark column."""
    return F.get(F.array(*[F.lit(x) for x in words]), index.cast("int"))


def sql_pick(index: str, *words) -> str:
    return "[" + ",".join("NULL" if x is None else f"'{x}'" for x in words) + f"][({index})+1]"


@query("c04_clean_bool", f"SELECT o_orderkey AS k, {sql_pick('o_orderkey%8', 'true','false','true','false','true','false','true','false')}='true' AS value FROM orders")
def _(t):
    return t.raw("orders").select(key().alias("k"), c.clean_bool(pick(key() % 8, "1", "0", " TRUE", "f", "Yes", "maybe", "y", "")).alias("value"))


@query("c05_clean_ts", f"""SELECT o_orderkey AS k, strftime(CASE o_orderkey%4 WHEN 0 THEN o_orderdate WHEN 1 THEN date_trunc('day', o_orderdate) WHEN 2 THEN o_orderdate - INTERVAL 2 HOUR ELSE {NOW} END, '%Y-%m-%d %H:%M:%S') AS ts FROM orders""")
def _(t):
    text = (F.when(key() % 4 == 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(key() % 4 == 1, F.date_format("o_orderdate", "yyyy-MM-dd"))
            .when(key() % 4 == 2, F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))).otherwise("soon"))
    return t.raw("orders").select(key().alias("k"), c.clean_ts(text, b.now()).alias("ts"))


@query("c06_clean_text", "SELECT p_partkey AS k, CASE WHEN p_partkey%3=0 THEN NULL ELSE p_name END AS value FROM part")
def _(t):
    text = F.when(F.col("p_partkey") % 3 == 0, F.lit(" \t")).otherwise(F.concat(F.lit(" "), F.col("p_name"), F.lit("\n")))
    return t.raw("part").select(F.col("p_partkey").alias("k"), c.clean_text(text).alias("value"))


@query("c07_clean_asn", """SELECT o_orderkey AS k, CASE o_orderkey%4 WHEN 0 THEN o_orderkey WHEN 1 THEN -o_orderkey WHEN 2 THEN NULL ELSE 4294967296+o_orderkey END AS plain,
   CASE o_orderkey%4 WHEN 0 THEN o_orderkey END AS census, CASE o_orderkey%4 WHEN 0 THEN nullif(o_orderkey,0) WHEN 2 THEN o_orderkey END AS asked FROM orders""")
def _(t):
    text = F.when(key() % 4 == 0, key().cast("string")).when(key() % 4 == 1, (-key()).cast("string")).when(key() % 4 == 2, F.concat(F.lit(" as"), key().cast("string"))).otherwise((key() + 4294967296).cast("string"))
    return t.raw("orders").select(key().alias("k"), c.clean_asn(text).alias("plain"), c.census_asn(text).alias("census"), c.query_asn(text).alias("asked"))


@query("c08_explode_asns", "SELECT prefix, CASE WHEN p='-' THEN NULL ELSE p::BIGINT END AS asn FROM (SELECT prefix, unnest(string_split(ASN,'_')) AS p FROM fx_census)")
def _(t):
    return c.explode_asns(t.census.select("prefix", "ASN"), "ASN").select("prefix", "asn")


@query("c09_numbers", """SELECT o_orderkey AS k, CASE WHEN o_orderkey%70000 BETWEEN 1 AND 65535 THEN o_orderkey%70000 END AS port,
   CASE WHEN o_orderkey%5<>0 THEN o_orderkey END AS count, CASE WHEN o_orderkey%7<>0 THEN o_orderkey%100 END AS number FROM orders""")
def _(t):
    count = F.when(key() % 5 == 0, (-key() - 1).cast("string")).otherwise(key().cast("string"))
    number = F.when(key() % 7 == 0, "many").otherwise(F.concat((key() % 100).cast("string"), F.lit(".0")))
    return t.raw("orders").select(key().alias("k"), c.clean_port((key() % 70000).cast("string")).alias("port"), c.clean_count(count).alias("count"), c.clean_int(number).alias("number"))


@query("c10_clean_qmin", f"SELECT o_orderkey AS k, {sql_pick('o_orderkey%6','no','yes','unstable','yes','other',None)} AS value FROM orders")
def _(t):
    return t.raw("orders").select(key().alias("k"), c.clean_qmin(pick(key() % 6, "0", "1.0", " 2", "YES", "Other", "")).alias("value"))


@query("c11_clean_forwarder_type", f"SELECT o_orderkey AS k, {sql_pick('o_orderkey%5','transparent','recursive','recursive','recursive','odd')} AS value FROM orders")
def _(t):
    return t.raw("orders").select(key().alias("k"), c.clean_forwarder_type(pick(key() % 5, "Transparent Forwarder", "forwarder", " Recursive ", "", "Odd")).alias("value"))


@query("c12_clean_country", f"SELECT c_custkey AS k, CASE WHEN c_custkey%5=0 THEN NULL WHEN c_custkey%5=1 THEN 'DEU' WHEN c_custkey%5=2 THEN 'DEU' WHEN c_custkey%5=3 THEN {iso('c_nationkey')} ELSE 'XQ' END AS country FROM customer")
def _(t):
    k = F.col("c_custkey")
    text = F.when(k % 5 == 0, "***").when(k % 5 == 1, "de").when(k % 5 == 2, "Germany").when(k % 5 == 3, F.lower(iso_col(F.col("c_nationkey")))).otherwise("xq")
    return cc.clean_country(t.raw("customer").select(k.alias("k"), text.alias("country")), "country", cc.iso_table(t.spark)).select("k", "country")


@query("c13_country_display_name", "SELECT c_custkey AS k, CASE c_custkey%3 WHEN 0 THEN 'Germany' WHEN 1 THEN 'France' ELSE 'Some Place' END AS country_name FROM customer")
def _(t):
    k = F.col("c_custkey")
    text = F.when(k % 3 == 0, "DEU").when(k % 3 == 1, "fr").otherwise("Some Place (the), Republic of")
    return cc.country_display_name(t.raw("customer").select(k.alias("k"), text.alias("country")), "country", cc.iso_table(t.spark)).select("k", "country_name")


NAMED = {
    "Viet Nam": "VNM", "Korea, Republic of": "KOR", "Iran, Islamic Republic of": "IRN", "Bolivia, Plurinational State of": "BOL", "Taiwan, Province of China": "TWN",
    "Türkiye": "TUR", "Russian Federation": "RUS", "Tanzania, United Republic of": "TZA", "Holy See (Vatican City State)": "VAT", "Czechia": "CZE", "vietnam": "VNM", "gb": "GBR",
}


@query("c12_country_names", f"SELECT c_custkey AS k, {sql_pick(f'c_custkey%{len(NAMED)}', *NAMED.values())} AS country FROM customer")
def _(t):
    text = F.element_at(F.array(*[F.lit(n) for n in NAMED]), (F.col("c_custkey") % len(NAMED) + 1).cast("int"))
    return cc.clean_country(t.raw("customer").select(F.col("c_custkey").alias("k"), text.alias("country")), "country", cc.iso_table(t.spark)).select("k", "country")


SHOWN = {"VNM": "Viet Nam", "KOR": "Korea", "IRN": "Iran", "BO": "Bolivia", "tw": "Taiwan", "VAT": "Holy See", "Korea, Republic of": "Korea", "FK": "Falkland Islands"}


@query("c13_shown_names", f"SELECT c_custkey AS k, {sql_pick(f'c_custkey%{len(SHOWN)}', *SHOWN.values())} AS country_name FROM customer")
def _(t):
    text = F.element_at(F.array(*[F.lit(n) for n in SHOWN]), (F.col("c_custkey") % len(SHOWN) + 1).cast("int"))
    return cc.country_display_name(t.raw("customer").select(F.col("c_custkey").alias("k"), text.alias("country")), "country", cc.iso_table(t.spark)).select("k", "country_name")


@query("c14_clean_protocol", f"SELECT o_orderkey AS k, {sql_pick('o_orderkey%7','doh3','doh','doh','doh1.1','dotcp','doudp','doq')} AS value FROM orders")
def _(t):
    return t.raw("orders").select(key().alias("k"), c.clean_protocol(pick(key() % 7, "h3", "H2", "http/2", "http/1.1", " tcp", "UDP", "DoQ")).alias("value"))


_LIST = "CASE o_orderkey%3 WHEN 0 THEN ['doudp','dotcp'] WHEN 1 THEN ['doh'] ELSE ['dot'] END"


@query("c15_explode_protocols", f"SELECT o_orderkey AS k, unnest({_LIST}) AS protocol FROM orders")
def _(t):
    text = pick(key() % 3, "udp, TCP,", "h2", ",dot,,")
    return c.explode_protocols(t.raw("orders").select(key().alias("k"), text.alias("protocol"))).select("k", "protocol")


@query("j15_lateral_split", f"SELECT o_orderkey AS k, unnest({_LIST}) AS protocol, o_orderpriority FROM orders")
def _(t):
    text = pick(key() % 3, "udp,tcp", "http2", "dot")
    return c.explode_protocols(t.raw("orders").select(key().alias("k"), text.alias("protocol"), "o_orderpriority"))


@query("c16_clean_list", "SELECT o_orderkey AS k, CASE o_orderkey%4 WHEN 0 THEN 'a|b' WHEN 1 THEN 'a|b' WHEN 2 THEN '' ELSE 'x' END AS items FROM orders")
def _(t):
    items = c.clean_list(pick(key() % 4, "a, b", "['a', 'b']", " ", "[\"x\"]"))
    return t.raw("orders").select(key().alias("k"), F.array_join(items, "|").alias("items"))


@query("c17_array_to_text", "SELECT o_orderkey AS k, CASE WHEN o_orderkey%2=0 THEN 'a,b' ELSE 'a,z,b' END AS text FROM orders")
def _(t):
    return t.raw("orders").select(key().alias("k"), c.array_to_text(F.array(F.lit("a"), F.when(key() % 2 == 1, "z"), F.lit("b"))).alias("text"))


@query("c18_clean_domain", "SELECT resolver_id, lower(domain) AS domain, true AS ok, false AS bad FROM fx_resolver_domain")
def _(t):
    d = F.col("domain")
    return t.resolver_domain.select("resolver_id", c.clean_domain(F.concat(F.lit(" "), d, F.lit(". "))).alias("domain"), c.is_fqdn(d).alias("ok"), c.is_fqdn(F.concat(F.lit("-"), d)).alias("bad"))


@query("c19_split_service", "SELECT resolver_id, protocol, port, port IS NOT NULL AS valid FROM fx_resolver_service")
def _(t):
    s = c.split_service(F.concat(F.lit(" "), F.upper("protocol"), F.lit(":"), F.col("port").cast("string")))
    return t.resolver_service.select("resolver_id", s.alias("s")).select("resolver_id", "s.protocol", "s.port", "s.valid")


@query("c20_endpoint_ip", "SELECT ip FROM fx_resolver_dual")
def _(t):
    text = F.when(F.col("family") == 6, F.concat(F.lit("["), F.col("ip"), F.lit("]:53"))).when(F.col("resolver_id") % 2 == 0, F.concat(F.col("ip"), F.lit(":53"))).otherwise(F.col("ip"))
    return t.resolver_dual.select(c.endpoint_ip(text).alias("ip"))


@query("c23_org_short", "SELECT p_partkey AS k, regexp_extract(p_name,'^([A-Za-z0-9]+)',1) AS short, regexp_extract(p_name,'^([A-Za-z0-9]+)',1)||'-x' AS hyphenated FROM part")
def _(t):
    name = F.col("p_name")
    dashed = F.concat(F.regexp_extract(name, "^([A-Za-z0-9]+)", 1), F.lit("-x rest"))
    return t.raw("part").select(F.col("p_partkey").alias("k"), c.org_short(name).alias("short"), c.org_short(dashed, True).alias("hyphenated"))


@query("c24_protocol_tokens", "SELECT resolver_id, bool_or(protocol='dotcp') AS tcp, bool_or(protocol='doudp') AS udp FROM fx_resolver_service GROUP BY 1")
def _(t):
    from resolvescope.plans.resolver_reports import service_text

    text = F.col("supported_protocols")
    return service_text(t.resolver_service, ["resolver_id"]).select("resolver_id", c.supports(text, "dotcp").alias("tcp"), c.supports(text, "doudp").alias("udp"))


@query("c25_percent", f"SELECT l_orderkey*10+l_linenumber AS k, {pc('l_suppkey', 'l_linenumber%3')} AS pc FROM lineitem")
def _(t):
    return t.raw("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), c.pc(F.col("l_suppkey"), F.col("l_linenumber") % 3).alias("pc"))


@query("c26_spoof_state", """SELECT prefix, allow, NOT allow AND closed AS blocked, NOT allow AND NOT closed AS unknown FROM (SELECT prefix,
   lower(coalesce(privatespoof,'')) IN ('received','rewritten') OR lower(coalesce(routedspoof,'')) IN ('received','rewritten') AS allow,
   lower(coalesce(privatespoof,''))='blocked' OR lower(coalesce(routedspoof,''))='blocked' AS closed FROM fx_spoofing)""")
def _(t):
    flags = c.spoof_state(F.col("privatespoof"), F.col("routedspoof"))
    return t.spoofing.select("prefix", *[flags[n].alias(n) for n in ("allow", "blocked", "unknown")])


# ---- aggregations, windows, set operations ------------------------------------------------------------


@query("j06_domain_self_join", """SELECT DISTINCT a.resolver_id, lower(b.domain) AS domain, n FROM fx_resolver_domain a JOIN (SELECT lower(domain) AS domain, count(*) AS n FROM fx_resolver_domain GROUP BY 1) b ON lower(a.domain)=b.domain""")
def _(t):
    from resolvescope.plans.resolver_reports import alternative_groups

    groups = alternative_groups(t).where(F.col("group_key").startswith("domain:"))
    sizes = groups.groupBy("group_key").agg(F.count(F.lit(1)).alias("n"))
    return groups.join(sizes, "group_key").select("resolver_id", F.expr("substring(group_key, 8)").alias("domain"), "n")


@query("j07_semi_join", "SELECT resolver_id, asn FROM fx_resolver_asn WHERE asn IN (SELECT asn FROM fx_spoofing_asn)")
def _(t):
    return w.keep_if_in(t.resolver_asn, "asn", t.spoofing_asn.select("asn")).select("resolver_id", "asn")


@query("j16_with_coordinates", "SELECT resolver_id, country, latitude, longitude FROM fx_resolver_location LEFT JOIN fx_country_location USING (country)")
def _(t):
    from resolvescope.plans.resolver_reports import with_coordinates

    return with_coordinates(t.resolver_location.select("resolver_id", "country"), t.country_location)


@query("a04_distribution", f"""SELECT target, value, count, {pc('count', 'total')} AS percent, rank FROM (SELECT *, sum(count) OVER (PARTITION BY target) AS total, row_number() OVER (PARTITION BY target ORDER BY count DESC, value) AS rank
   FROM (SELECT l_suppkey AS target, l_quantity::BIGINT AS value, count(*) AS count FROM lineitem GROUP BY 1,2)) WHERE rank<=10""")
def _(t):
    return w.distribution(t.raw("lineitem").select(F.col("l_suppkey").alias("target"), F.col("l_quantity").cast("bigint").alias("q")), "q", ["target"])


@query("a09_group_n_unique", "SELECT replying_ip, count(DISTINCT backend_resolver)+max((backend_resolver IS NULL)::INT) AS n FROM fx_scan GROUP BY 1")
def _(t):
    n = F.count_distinct("backend_resolver") + F.max(F.when(F.col("backend_resolver").isNull(), 1).otherwise(0))
    return t.scan.groupBy("replying_ip").agg(n.alias("n"))


@query("w01_latest_by", f"SELECT o_custkey, o_orderkey, {stamp('o_orderdate')} AS ts FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey)=1")
def _(t):
    rows = t.raw("orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").alias("ts"))
    return w.latest_by(rows, ["o_custkey"], w.newest_first("ts", "o_orderkey"))


@query("w06_top_k", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10")
def _(t):
    return t.raw("orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "o_custkey").limit(10)


@query("w07_page", "SELECT p_brand, p_partkey, rank FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part) WHERE rank BETWEEN 6 AND 10")
def _(t):
    return w.page(t.raw("part"), [F.col("p_retailprice").desc(), F.col("p_partkey")], 2, 5, by=["p_brand"]).select("p_brand", "p_partkey", "rank")


@query("w07_page_global", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def _(t):
    return w.page(t.raw("orders").select("o_orderkey", "o_totalprice"), [F.col("o_totalprice").desc(), key()], 3, 25)


@query("w08_dedupe_sessions", "SELECT session, count(*) AS n FROM (SELECT DISTINCT user_id AS session FROM events) GROUP BY 1")
def _(t):
    rows = t.raw("events").select(F.col("user_id").cast("string").alias("session"), F.col("user_id").alias("u"))
    return w.dedupe_sessions(rows).groupBy(F.col("session").cast("bigint").alias("session")).agg(F.count(F.lit(1)).alias("n"))


@query("u01_union_ids", "SELECT asn, prefix FROM fx_anycast_asn UNION SELECT asn, prefix FROM fx_anycast_asn_backend")
def _(t):
    from resolvescope.plans.scope_reports import asn_anycast_prefixes

    return asn_anycast_prefixes(t).withColumnRenamed("target", "asn")


# ---- sources --------------------------------------------------------------------------------------------


@query("s05_flatten_struct", "SELECT o_orderkey AS \"order.key\", o_custkey AS \"order.who.customer\", o_totalprice AS price FROM orders")
def _(t):
    nested = t.raw("orders").select(F.struct(key().alias("key"), F.struct(F.col("o_custkey").alias("customer")).alias("who")).alias("order"), F.col("o_totalprice").alias("price"))
    return readers.flatten_struct(nested)


@query("s06_standardise_scan", f"""SELECT row_id, queried_ip, queried_ip_lo AS queried_ip_uint32, queried_ip_asn, {stamp('timestamp_request')} AS timestamp_request, resolver_type FROM fx_scan""")
def _(t):
    raw = t.scan.select("row_id", "queried_ip", F.concat(F.col("queried_ip_asn").cast("string"), F.lit(".0")).alias("queried_ip_asn"),
                        F.date_format("timestamp_request", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp_request"), "resolver_type")
    return readers.standardise_scan(raw).select("row_id", "queried_ip", "queried_ip_uint32", "queried_ip_asn", "timestamp_request", "resolver_type")


_SESSIONS = f"""SELECT {v4('((16777216+(user_id*104729)%16777216)>>8)<<8')}||'/24' AS prefix, CASE WHEN event_id%3=0 THEN NULL ELSE 64496+user_id%97 END AS asn, 'DE' AS country,
   event_id%2=0 AS nat, CASE WHEN event_type='click' THEN 'blocked' END AS privatespoof, CASE WHEN event_id%5=0 THEN 'received' END AS routedspoof, date_trunc('second', ts) AS ts, event_id FROM events
  UNION ALL SELECT '2001:db8:'||to_hex(user_id%4096+1)||'::/48', 64496+user_id%50, 'DE', NULL, CASE WHEN event_id%4=1 THEN 'unknown' END, NULL, date_trunc('second', ts), event_id FROM events WHERE event_id%2=0"""


def sessions(t):
    u, e = F.col("user_id"), F.col("event_id")
    n = F.lit(16777216).cast("bigint") + (u * 104729) % 16777216
    from workload.fixtures import mask
    from resolvescope.functions.net import v4_text

    return t.raw("events").select(
        e.cast("string").alias("session"), F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")).alias("timestamp"), F.lit("de").alias("country"),
        F.concat(v4_text(mask(n, 24)), F.lit("/24")).alias("client4"), F.when(e % 3 != 0, (F.lit(64496) + u % 97).cast("string")).otherwise("").alias("asn4"),
        (e % 2 == 0).alias("nat4"), F.when(F.col("event_type") == "click", "blocked").alias("privatespoof"), F.when(e % 5 == 0, "received").alias("routedspoof"),
        F.when(e % 2 == 0, F.concat(F.lit("2001:db8:"), F.hex(u % 4096 + 1), F.lit("::/48"))).alias("client6"), (F.lit(64496) + u % 50).cast("string").alias("asn6"),
        F.lit(None).cast("boolean").alias("nat6"), F.when(e % 4 == 1, "unknown").alias("privatespoof6"), F.lit(None).cast("string").alias("routedspoof6"), e.alias("event_id"),
    )


@query("s07_spoofer_sessions", f"SELECT prefix, asn, country, nat, privatespoof, routedspoof, {stamp('ts')} AS last_update_ts FROM ({_SESSIONS})")
def _(t):
    return readers.spoofer_sessions_to_prefix_rows(sessions(t))


@query("p18_spoofing_feed", f"""SELECT prefix, {stamp('max(ts)')} AS last_update_ts FROM ({_SESSIONS}) WHERE privatespoof IS NOT NULL OR routedspoof IS NOT NULL GROUP BY 1""")
def _(t):
    return feeds.spoofing_feed(sessions(t)).select("prefix", "last_update_ts")


@query("s09_latest_snapshot", "SELECT o_orderkey FROM orders WHERE date_trunc('month', o_orderdate)=(SELECT max(date_trunc('month', o_orderdate)) FROM orders)")
def _(t):
    return readers.latest_snapshot(t.raw("orders").select("o_orderkey", F.date_trunc("month", "o_orderdate").alias("snapshot_date"))).select("o_orderkey")


@query("s12_merge_sources", f"SELECT lower(c_mktsegment) AS source, lower(c_mktsegment)<>'machinery' AS old FROM customer GROUP BY c_mktsegment")
def _(t):
    configured = t.raw("customer").select(F.lower("c_mktsegment").alias("source"), F.lit("new").alias("description"), F.lit(True).alias("apikey_required")).distinct()
    return registry.merge_sources(t.data_source, configured, b.now()).table.select("source", (F.col("description") != "new").alias("old"))


@query("s13_upsert_source", "SELECT lower(c_mktsegment) AS source, CASE WHEN c_mktsegment='BUILDING' OR c_mktsegment='MACHINERY' THEN 'fresh' ELSE 'list of '||lower(c_mktsegment) END AS description FROM customer GROUP BY c_mktsegment")
def _(t):
    name = F.lower("c_mktsegment")
    rows = t.raw("customer").select(name.alias("source"), F.when(name.isin("building", "machinery"), "fresh").alias("description")).distinct()
    return registry.upsert_source(t.data_source, rows, b.now()).table.select("source", "description")


@query("s14_touch_sources", f"SELECT source, CASE WHEN source<>'automobile' THEN {stamp(NOW)} END AS last_retrieved_ts FROM fx_data_source")
def _(t):
    used = t.resolver.where(~F.col("source").isin("machinery", "automobile"))
    return registry.check_and_touch_sources(t.data_source, used, b.now()).select("source", "last_retrieved_ts")


@query("s14_missing_sources", "SELECT DISTINCT source FROM fx_resolver WHERE source NOT IN (SELECT source FROM fx_data_source)")
def _(t):
    return registry.missing_sources(t.data_source, t.resolver)


@query("s15_fill_country_locations", f"""SELECT {iso('n_nationkey')} AS country, CASE WHEN n_nationkey%6<>5 THEN n_nationkey*3-30 ELSE n_nationkey END::DOUBLE AS latitude FROM nation
   WHERE n_nationkey%6<>5 OR n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey%50<>1 AND c_custkey%17<>0)""")
def _(t):
    n = F.col("n_nationkey")
    gazetteer = t.raw("nation").select(iso_col(n).alias("country"), n.cast("double").alias("latitude"), n.cast("double").alias("longitude"))
    return registry.fill_country_locations(t.country_location, t.resolver_location, gazetteer).table.select("country", "latitude")


def settled(t):
    """A DNSSEC import that keeps the source registry and the country coordinates in step."""
    from workload.q_merges import Tables

    n = F.col("n_nationkey")
    gazetteer = t.raw("nation").select(iso_col(n).alias("country"), n.cast("double").alias("latitude"), n.cast("double").alias("longitude"))
    return imports.import_dnssec(Tables(t), "automobile", country=b.dnssec_batch(t), iso=cc.iso_table(t.spark), now=b.now(), dimensions=imports.Dimensions(gazetteer))


@query("s14_import_touches_sources", f"SELECT source, CASE WHEN source='automobile' THEN {stamp(NOW)} END AS last_retrieved_ts FROM fx_data_source")
def _(t):
    return settled(t).table("data_source").select("source", "last_retrieved_ts")


@query("s15_import_fills_countries", f"""SELECT {iso('n_nationkey')} AS country, CASE WHEN n_nationkey%6<>5 THEN n_nationkey*3-30 ELSE n_nationkey END::DOUBLE AS latitude,
   CASE WHEN n_nationkey%6<>5 THEN n_nationkey*7-80 ELSE n_nationkey END::DOUBLE AS longitude FROM nation
   WHERE n_nationkey%6<>5 OR n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_nationkey%6<>0)""")
def _(t):
    return settled(t).table("country_location").select("country", "latitude", "longitude")


@query("s16_attach_coordinates", """SELECT resolver_id, CASE WHEN resolver_id%10=0 THEN 1.5 WHEN city='city-1' THEN c.latitude+100 ELSE c.latitude END::DOUBLE AS latitude
   FROM fx_resolver_location l LEFT JOIN fx_country_location c USING (country)""")
def _(t):
    rows = t.resolver_location.select("resolver_id", "country", "city", F.when(F.col("resolver_id") % 10 == 0, 1.5).alias("latitude"), F.lit(None).cast("double").alias("longitude"))
    base = t.country_location.withColumn("city", F.lit(None).cast("string"))
    towns = t.country_location.withColumns({"city": F.lit("city-1"), "latitude": F.col("latitude") + 100})
    return registry.attach_coordinates(rows, base.unionByName(towns)).select("resolver_id", "latitude")


# ---- feeds ----------------------------------------------------------------------------------------------

_SITES = f"SELECT prefix, {iso('(s_nationkey+i*(s_suppkey%3))%25')} AS country FROM (SELECT *, unnest(range(s_suppkey%5+1)) AS i FROM fx_census WHERE s_suppkey%6<>0)"


@query("p17_census_prefixes", "SELECT prefix, min(backing_prefix) AS backing_prefix, bool_or(partial) AS partial FROM fx_census GROUP BY 1")
def _(t):
    return feeds.prepare_census(t.census, v6=False)["anycast"].select("prefix", "backing_prefix", "partial")


@query("p17_census_asns", "SELECT DISTINCT prefix, p::BIGINT AS asn FROM (SELECT prefix, unnest(string_split(ASN,'_')) AS p FROM fx_census) WHERE p<>'-'")
def _(t):
    return feeds.prepare_census(t.census, v6=False)["asn"]


@query("p17_census_countries", f"SELECT prefix, country, count(*) AS country_count FROM ({_SITES}) GROUP BY 1,2")
def _(t):
    return feeds.prepare_census(t.census, cc.iso_table(t.spark), v6=False)["country_backend"]


@query("m24_import_anycast", f"""SELECT 'prefix' AS part, prefix, NULL AS key, 1 AS n FROM (SELECT DISTINCT prefix FROM fx_census) UNION ALL
  SELECT 'asn', prefix, asn::VARCHAR, count(*) FROM (SELECT prefix, unnest(string_split(ASN,'_')) AS asn FROM fx_census) WHERE asn<>'-' GROUP BY 1,2,3 UNION ALL
  SELECT 'country', prefix, country, count(*) FROM ({_SITES}) GROUP BY 1,2,3""")
def _(t):
    from workload.q_merges import Tables

    r = feeds.import_anycast(Tables(EmptyAnycast(t)), t.census, "prefix:prefix,asn:ASN,country:locations", "anycast,asn_backend,location", "census", now=b.now(), v6=False)
    pre = r.table("anycast").select(F.lit("prefix").alias("part"), "prefix", F.lit(None).cast("string").alias("key"), F.lit(1).cast("bigint").alias("n"))
    asn = r.table("anycast_asn_backend").select(F.lit("asn").alias("part"), "prefix", F.col("asn").cast("string").alias("key"), F.col("asn_count").alias("n"))
    return pre.unionByName(asn).unionByName(r.table("anycast_country_backend").select(F.lit("country").alias("part"), "prefix", F.col("country").alias("key"), F.col("country_count").alias("n")))


class EmptyAnycast:
    """The session of the fixtures without any relation."""

    def __init__(self, t):
        self.spark = t.spark


@query("p19_dnssec_latest", """SELECT asn, validating, strftime(d,'%Y-%m-%d %H:%M:%S') AS last_observation_ts FROM (SELECT 64496+o_custkey AS asn, CASE WHEN o_orderkey%5=0 THEN NULL ELSE (o_orderkey%100)::VARCHAR END AS validating, date_trunc('day', o_orderdate) AS d
   FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY date_trunc('day', o_orderdate) DESC, o_orderkey)=1)""")
def _(t):
    metric = F.struct((key() % 7).alias("seen"), F.when(key() % 5 == 0, F.lit("")).otherwise((key() % 100).cast("string")).alias("validating"))
    entry = F.struct(F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.concat(F.lit("AS"), (F.col("o_custkey") + 64496).cast("string")).alias("as"), metric.alias("30_day"), (-key()).alias("o"))
    # one payload per network, as the feed delivers it; entries of one day keep order-key order
    listed = F.sort_array(F.collect_list(F.struct(key().alias("o"), entry.alias("e"))))
    series = t.raw("orders").groupBy("o_custkey").agg(listed.alias("l")).select(
        F.col("o_custkey").cast("string").alias("asked"), F.to_json(F.struct(F.transform("l", lambda x: x["e"]).alias("data"))).alias("payload"))
    return feeds.dnssec_latest(series, "asn").select("asn", "validating", "last_observation_ts")


def as_pages(t):
    p = F.col("page_id")
    link = F.concat(F.lit('<a href="/dnssec/AS'), (F.lit(64496) + p % 50).cast("string"), F.lit("?c=DE\">x</a>"))
    row = F.concat(F.lit('<tr><td><a href="/dnssec/AS'), (F.lit(64500) + p % 60).cast("string"), F.lit('">AS1</a></td><td><b>Net '), (p % 60).cast("string"),
                   F.lit(" &amp; Co</b></td><td>1</td><td>2</td><td>3</td></tr>"))
    return t.raw("pages").select("page_id", F.concat(F.col("html"), link, row).alias("html"))


@query("p20_as_links", """SELECT coalesce(a, b) AS asn, CASE WHEN pb IS NOT NULL AND (pa IS NULL OR pb<=pa) THEN 'Net '||(b-64500)||' & Co' END AS as_name FROM
   (SELECT 64496+page_id%50 AS a, min(page_id) AS pa FROM pages GROUP BY 1) FULL JOIN (SELECT 64500+page_id%60 AS b, min(page_id) AS pb FROM pages GROUP BY 1) ON a=b""")
def _(t):
    return feeds.extract_as_links(as_pages(t))


def lookups(t):
    """One DNS lookup result per order, as the scanner writes them."""
    ip = b.v4_text(b.rip(F.col("o_custkey") + 200))
    k = key().cast("string")
    text = F.concat(
        F.lit('{"name":"'), ip, F.lit('","results":{"PTR":{"status":"'), F.when(key() % 5 == 0, "SERVFAIL").otherwise("NOERROR"),
        F.lit('","data":{"answers":[{"type":"PTR","name":"1.in-addr.arpa","answer":"Host-'), (key() % 40).cast("string"), F.lit('.example.com."}]}},"SVCB":{"status":"NOERROR","data":{"resolver":"'), ip,
        F.lit(':53","answers":[{"type":"SVCB","target":"svc-'), (key() % 12).cast("string"), F.lit('.example.com.","svcparams":{"alpn":["h2","h3"],"port":443,"dohpath":"/d'), (key() % 3).cast("string"), F.lit('"}}]}}}}'),
    )
    return readers.lookup_rows(t.spread("orders").select(F.parse_json(text).alias("row")))


_LIP = v4(rip("(o_custkey+200)"))


@query("p21_ptr_domains", f"SELECT DISTINCT {_LIP} AS resolver_ip, 'Host-'||(o_orderkey%40)::VARCHAR||'.example.com' AS domain FROM orders WHERE o_orderkey%5<>0")
def _(t):
    return feeds.ptr_domains(lookups(t))


@query("p22_svcb_records", f"SELECT {_LIP} AS resolver_ip, 'svc-'||(o_orderkey%12)::VARCHAR||'.example.com' AS domain, 'h2,h3' AS alpn, 443 AS port, '/d'||(o_orderkey%3)::VARCHAR AS dohpath FROM orders")
def _(t):
    return feeds.svcb_records(lookups(t)).select("resolver_ip", "domain", F.array_join("alpn", ",").alias("alpn"), "port", "dohpath")


@query("p23_refresh_lookup_domains", f"""SELECT resolver_id, coalesce(p.domain, t.domain, s.domain) AS domain FROM fx_resolver_domain t
   FULL JOIN (SELECT resolver_id, min('host-'||(o_orderkey%40)::VARCHAR||'.example.com') AS domain FROM orders JOIN fx_resolver ON ip_lo={rip('(o_custkey+200)')} WHERE o_orderkey%5<>0 GROUP BY 1) p USING (resolver_id)
   FULL JOIN (SELECT resolver_id, min('svc-'||(o_orderkey%12)::VARCHAR||'.example.com') AS domain FROM orders JOIN fx_resolver ON ip_lo={rip('(o_custkey+200)')} GROUP BY 1) s USING (resolver_id)""")
def _(t):
    from workload.q_merges import Tables

    return feeds.refresh_lookup_metadata(Tables(t), lookups(t), "hints", b.now(), False)["svcb"].table("resolver_domain").select("resolver_id", "domain")


@query("p24_ptr_domain_targets", """SELECT DISTINCT unnest(['Host-'||(o_orderkey%40)::VARCHAR||'.example.com', '1.in-addr.arpa']) AS domain FROM orders WHERE o_orderkey%5<>0""")
def _(t):
    return feeds.ptr_domain_targets(lookups(t))


@query("p25_measurement_targets", """SELECT ip AS resolver_ip, resolver_id, verified, is_public, r.source, asn, country FROM fx_resolver r JOIN fx_resolver_identity ON id=resolver_id
   LEFT JOIN fx_resolver_asn USING (resolver_id) LEFT JOIN fx_resolver_location USING (resolver_id) WHERE verified AND is_public""")
def _(t):
    return feeds.measurement_targets(t, verified=True, is_public=True)


# ---- older loads, contracts --------------------------------------------------------------------------------


@query("p26_link_identities", """SELECT count(*) AS "rows", count(DISTINCT resolver_identity_id) AS identities, min(resolver_identity_id) AS low, max(resolver_identity_id) AS high FROM
  (SELECT CASE WHEN o_custkey%4=0 THEN o_custkey%40+1 ELSE 40+dense_rank() OVER (ORDER BY o_custkey%4=0, o_custkey%200) END AS resolver_identity_id FROM orders)""")
def _(t):
    k = F.col("o_custkey")
    rows = t.raw("orders").select(
        F.when(k % 4 == 0, F.concat(F.lit("Known-"), (k % 40).cast("string"), F.lit(".example."))).otherwise(F.concat(F.lit("New-"), (k % 200).cast("string"), F.lit(".example"))).alias("domain"),
        F.lit("list").alias("source"))
    ids = t.raw("supplier").select((F.col("s_suppkey") % 40).alias("n")).distinct()
    identities = ids.select((F.col("n") + 1).alias("id"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("operator"), F.lit(None).cast("string").alias("source"))
    domains = ids.select((F.col("n") + 1).alias("resolver_identity_id"), F.concat(F.lit("known-"), F.col("n").cast("string"), F.lit(".example")).alias("domain"), F.lit("old").alias("source"), F.lit(None).cast("timestamp").alias("last_observation_ts"))
    out = legacy.link_identities(rows, identities, domains)["rows"]
    i = F.col("resolver_identity_id")
    return out.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(i).alias("identities"), F.min(i).alias("low"), F.max(i).alias("high"))


_CHAIN = """WITH RECURSIVE raw AS (
   SELECT c_custkey AS k, c_custkey // 60 AS b, CASE WHEN c_custkey % 60 % 3 = 0 THEN NULL ELSE 'd' || (c_custkey // 60) || '-' || (c_custkey % 60 // 4) || '.example' END AS d,
          CASE WHEN c_custkey % 60 % 5 = 0 THEN NULL ELSE 'n' || (c_custkey // 60) || '-' || ((c_custkey % 60 + 2) // 6) END AS own, CASE WHEN c_custkey // 60 % 2 = 0 THEN 'org' ELSE '' END AS op FROM customer
 ), named AS (SELECT k, b, d, op, coalesce(own, d) AS nm FROM raw
 ), known AS (SELECT DISTINCT b, b + 1 AS id FROM raw WHERE b % 3 = 0
 ), direct AS (SELECT n.*, w.id FROM named n LEFT JOIN known w ON n.b = w.b AND n.d = 'd' || w.b || '-7.example'
 ), taken AS (SELECT id, min(nm) || '|' || max(op) AS node FROM direct WHERE id IS NOT NULL AND b % 6 = 0 GROUP BY id
 ), open_rows AS (SELECT k, b, d, CASE WHEN nm IS NOT NULL OR op <> '' THEN coalesce(nm, '') || '|' || op END AS n FROM direct WHERE id IS NULL
 ), links AS (SELECT DISTINCT d AS x, n AS y FROM open_rows WHERE d IS NOT NULL AND n IS NOT NULL
 ), both_ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links
 ), nodes AS (SELECT DISTINCT coalesce(d, n) AS x FROM open_rows WHERE coalesce(d, n) IS NOT NULL UNION SELECT n FROM open_rows WHERE n IS NOT NULL
 ), reached(x, y) AS (SELECT x, x FROM nodes UNION SELECT r.x, e.y FROM reached r JOIN both_ways e ON r.y = e.x
 ), grouped AS (SELECT x, min(y) AS g FROM reached GROUP BY x
 ), tied AS (SELECT g, min(id) AS id FROM grouped JOIN taken ON node = x GROUP BY g
 ), labelled AS (SELECT k, g, t.id FROM open_rows JOIN grouped ON x = coalesce(d, n) LEFT JOIN tied t USING (g))"""


@query("p26_linked_rows", _CHAIN + """ SELECT k, coalesce('known ' || id, 'new ' || min(k) OVER (PARTITION BY g)) AS identity FROM labelled
   UNION ALL SELECT k, 'known ' || id FROM direct WHERE id IS NOT NULL
   UNION ALL SELECT k, NULL FROM open_rows WHERE coalesce(d, n) IS NULL""")
def _(t):
    """Rows that hang together through chains of domains and names, beside known identities with and without a name."""
    k, b_, j = F.col("c_custkey"), F.floor(F.col("c_custkey") / 60), F.col("c_custkey") % 60
    text = lambda x: x.cast("bigint").cast("string")
    part = lambda kind, number: F.concat(F.lit(kind), text(b_), F.lit("-"), text(F.floor(number)))
    domain = F.when(j % 3 != 0, F.concat(part("d", j / 4), F.lit(".Example.")))
    name = F.when(j % 5 != 0, part("n", (j + 2) / 6))
    rows = t.raw("customer").select(
        k, F.when(k % 2 == 0, F.upper(domain)).otherwise(domain).alias("domain"), F.when(k % 7 == 0, F.concat(F.lit(" "), F.upper(name))).otherwise(name).alias("name"),
        F.when(b_ % 2 == 0, F.when(k % 11 == 0, "ORG").otherwise("org")).alias("operator"), F.lit("list").alias("source"))
    known = t.raw("customer").select(b_.alias("b")).where(F.col("b") % 3 == 0).distinct().select("b", (F.col("b") + 1).alias("id"))
    none = F.lit(None).cast("string")
    identities = known.select("id", F.when(F.col("b") % 6 != 0, F.concat(F.lit("known "), text(F.col("id")))).alias("name"), none.alias("operator"), none.alias("source"))
    domains = known.select(F.col("id").alias("resolver_identity_id"), F.concat(F.lit("d"), text(F.col("b")), F.lit("-7.example")).alias("domain"), F.lit("old").alias("source"), F.lit(None).cast("timestamp").alias("last_observation_ts"))
    linked = legacy.link_identities(rows, identities, domains)["rows"].join(known.select(F.col("id").alias("_old")), F.col("resolver_identity_id") == F.col("_old"), "left")
    first = linked.where("_old is null").groupBy(F.col("resolver_identity_id").alias("_id")).agg(F.min("c_custkey").alias("_first"))
    out = linked.join(first, F.col("resolver_identity_id") == F.col("_id"), "left")
    label = F.when(F.col("_old").isNotNull(), F.concat(F.lit("known "), text(F.col("_old")))).when(F.col("resolver_identity_id").isNotNull(), F.concat(F.lit("new "), text(F.col("_first"))))
    return out.select(F.col("c_custkey").alias("k"), label.alias("identity"))


@query("p22_nested_records", "SELECT 'svc-' || o_orderkey || '.example' AS domain, 400 + o_orderkey % 100 AS port, repeat('/q', (o_orderkey % 50 * 20)::INT) AS dohpath FROM orders")
def _(t):
    """Records of either module below 0 to 11 further levels, with long parameters."""
    record = F.concat(F.lit('{"type":"HTTPS","target":"svc-'), key().cast("string"), F.lit('.example","svcparams":{"port":'), (key() % 100 + 400).cast("string"), F.lit(',"dohpath":"'),
                      F.repeat(F.lit("/q"), (key() % 50 * 20).cast("int")), F.lit('"}}'))
    depth = (key() % 12).cast("int")
    nested = F.concat(F.repeat(F.lit('{"more":['), depth), record, F.repeat(F.lit("]}"), depth))
    text = F.concat(F.lit('{"name":"192.0.2.1","results":{"'), F.when(key() % 2 == 0, "SVCB").otherwise("HTTPS"), F.lit('":{"status":"NOERROR","data":'), nested, F.lit("}}}"))
    records = feeds.svcb_records(readers.lookup_rows(t.spread("orders").select(F.parse_json(text).alias("row"))))
    return records.select("domain", "port", F.coalesce("dohpath", F.lit("")).alias("dohpath"))


@query("p27_anycast_sites", "SELECT r.resolver_id, count(DISTINCT s.backend_resolver) AS sites, count(DISTINCT s.backend_resolver) AS last_instance FROM fx_scan s JOIN fx_resolver r ON r.ip=s.replying_ip WHERE s.backend_resolver IS NOT NULL GROUP BY 1")
def _(t):
    from workload.q_merges import Tables

    sites = t.scan.where(F.col("backend_resolver").isNotNull()).select("replying_ip", "backend_resolver", "backend_resolver_asn", "backend_resolver_country").distinct()
    rows = legacy.site_rows(sites, t.resolver, "sites", b.now())
    empty = t.spark.createDataFrame([], "resolver_id bigint, instance_id bigint, ipv4 string, ipv6 string, netmask string, asn bigint, bgp_prefix string, org string, org_short string, country string, city string, latitude double, longitude double, source string, last_observation_ts timestamp")
    table = legacy.anycast_sites(rows, empty).table
    return table.groupBy("resolver_id").agg(F.count(F.lit(1)).alias("sites"), F.max("instance_id").alias("last_instance"))


@query("p27_anycast_site_update", f"""SELECT s_suppkey % 50 AS resolver_id, s_suppkey AS instance_id, {v4(rip("(s_suppkey+300)"))} AS ipv4,
   CASE WHEN s_suppkey % 3 = 0 THEN 'old' ELSE 'new' END AS org, CASE WHEN s_suppkey % 2 = 0 THEN 'Rome' END AS city FROM supplier""")
def _(t):
    n = F.col("s_suppkey")
    none = {c: F.lit(None).cast(k).alias(c) for c, k in (("ipv6", "string"), ("netmask", "string"), ("asn", "bigint"), ("bgp_prefix", "string"), ("org_short", "string"),
                                                         ("country", "string"), ("latitude", "double"), ("longitude", "double"), ("source", "string"))}
    ip = b.v4_text(b.rip(n + 300)).alias("ipv4")
    site = lambda number, org, city, day: t.raw("supplier").select(
        (n % 50).alias("resolver_id"), number.cast("bigint").alias("instance_id"), ip, none["ipv6"], none["netmask"], none["asn"], none["bgp_prefix"], org.alias("org"), none["org_short"],
        none["country"], city.cast("string").alias("city"), none["latitude"], none["longitude"], none["source"], F.lit(day).cast("timestamp").alias("last_observation_ts"))
    current = site(n, F.lit("old"), F.when(n % 2 == 0, "Rome"), "2020-01-01")
    rows = site(F.lit(None), F.when(n % 3 != 0, "new"), F.lit(None), "2020-02-01")
    return legacy.anycast_sites(rows, current).table.select("resolver_id", "instance_id", "ipv4", "org", "city")


@query("p28_merge_wide", f"""SELECT ip, coalesce(s.org, t.org) AS org, {stamp('greatest(s.ts, t.ts)')} AS last_observation_ts FROM
   (SELECT ip, source AS org, last_update_ts AS ts FROM fx_resolver) t FULL JOIN
   (SELECT {_LIP} AS ip, max_by(o_orderpriority, (o_orderdate, o_orderpriority)) FILTER (WHERE o_orderkey%3<>0) AS org, max(o_orderdate) AS ts FROM orders GROUP BY 1) s USING (ip)""")
def _(t):
    current = t.resolver.select("ip", F.col("source").alias("org"), F.col("last_update_ts").alias("last_observation_ts"))
    landed = t.raw("orders").select(F.lit(None).cast("string").alias("ip"), b.v4_text(b.rip(F.col("o_custkey") + 200)).alias("ipv4"),
                                    F.when(key() % 3 != 0, F.col("o_orderpriority")).alias("org"), F.col("o_orderdate").alias("last_observation_ts"))
    return legacy.merge_wide(current, legacy.wide_rows(landed, ["ip", "org", "last_observation_ts"], v6=False)).table


@query("m26_check_contracts", """SELECT 'resolver' AS table_name, 'reference(source -> data_source)' AS rule, 1 AS violations UNION ALL
   SELECT 'forwarder_forwarder_upstream','reference(forwarder_id -> forwarder_identity)', count(DISTINCT forwarder_id) FROM fx_forwarder_forwarder_upstream WHERE forwarder_id NOT IN (SELECT p_partkey FROM part WHERE p_size%2=0) UNION ALL
   SELECT 'forwarder_forwarder_upstream','reference(upstream_forwarder_id -> forwarder_identity)', count(DISTINCT upstream_forwarder_id) FROM fx_forwarder_forwarder_upstream WHERE upstream_forwarder_id NOT IN (SELECT p_partkey FROM part WHERE p_size%2=0)""")
def _(t):
    ids = t.raw("part").where(F.col("p_size") % 2 == 0).select(F.col("p_partkey").alias("id"))
    names = ("data_source", "resolver", "resolver_identity", "resolver_asn", "resolver_service", "forwarder_forwarder_upstream", "anycast", "anycast_asn_backend", "spoofing", "spoofing_asn")
    return contracts.check_contracts({**{n: getattr(t, n) for n in names if n not in ("anycast", "spoofing")},
                                      "anycast": t.anycast.drop("source").withColumn("source", F.lit("building")), "spoofing": t.spoofing.withColumn("source", F.lit("building")), "forwarder_identity": ids})
