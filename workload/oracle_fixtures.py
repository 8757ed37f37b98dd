"""DuckDB text of the fixture relations (the counterparts of ``workload.fixtures``)."""

from __future__ import annotations

import re

from workload.fixtures import ISO


def v4(x: str) -> str:
    return f"concat_ws('.', (({x})>>24)::VARCHAR, ((({x})>>16)&255)::VARCHAR, ((({x})>>8)&255)::VARCHAR, (({x})&255)::VARCHAR)"


def mask(x: str, length: str) -> str:
    return f"((({x}) >> (32-({length}))::INTEGER) << (32-({length}))::INTEGER)"


def rip(k: str) -> str:
    return f"(16777216 + ({k}*7919) % 16777216)"


def aip(k: str) -> str:
    return f"(16777216 + ({k}*167772) % 16777216)"


def pip(k: str) -> str:
    return f"((CASE WHEN ({k}) % 2 = 0 THEN 16777216 ELSE 33554432 END) + (({k})*7927) % 16777216)"


def iso(x: str) -> str:
    names = ", ".join(f"'{c}'" for c in ISO)
    return f"([{names}])[(({x})+1)::INTEGER]"


def stamp(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


def pc(part: str, whole: str) -> str:
    return f"coalesce(round({part}*100.0::DOUBLE/nullif({whole},0),2),0.0)"


LEN = "(12 + s_suppkey % 9)"
LLEN = "(12 + l_suppkey % 9)"
SNET = mask(aip("s_suppkey"), LEN)
LNET = mask(aip("l_suppkey"), LLEN)


def ptext(net: str, length: str) -> str:
    return f"({v4(net)} || '/' || ({length})::VARCHAR)"


ALLOW = (
    "(lower(coalesce(privatespoof,'')) IN ('received','rewritten') OR lower(coalesce(routedspoof,'')) IN ('received','rewritten'))"
)
CLOSED = "(lower(coalesce(privatespoof,'')) = 'blocked' OR lower(coalesce(routedspoof,'')) = 'blocked')"
RECEIVED = "(lower(coalesce(privatespoof,'')) = 'received' OR lower(coalesce(routedspoof,'')) = 'received')"


def inside(ip: str, p: str) -> str:
    return f"({ip}.family = {p}.family AND {ip}.ip_lo BETWEEN {p}.net_lo AND {p}.net_lo + (1::BIGINT << (32-{p}.masklen)::INTEGER) - 1)"


def _scan() -> str:
    part, order, supp = "l_partkey", "l_orderkey", "l_suppkey"
    reply = (
        f"CASE WHEN l_partkey%3=0 THEN {pip(part)} WHEN l_partkey%3=1 THEN "
        f"(CASE WHEN l_orderkey%2=0 THEN {pip(part)} ELSE {pip('l_partkey-1')} END) "
        f"WHEN l_orderkey%4=0 THEN {aip(supp)}+1 WHEN l_orderkey%4=1 THEN {pip('l_partkey+1')} "
        f"WHEN l_orderkey%4=2 THEN {pip('l_partkey-1')} ELSE 50331648+(l_suppkey*104729)%16777216 END"
    )
    backend = (
        f"CASE WHEN l_orderkey%23=0 THEN NULL WHEN l_orderkey%5=0 THEN {pip('l_partkey-l_partkey%3')} ELSE {rip('o_custkey')} END"
    )
    cols = []
    for n, label in (("q", "queried_ip"), ("r", "replying_ip"), ("b", "backend_resolver")):
        cols.append(f"""
          CASE WHEN {n} IS NOT NULL THEN {v4(n)} END AS {label}, {n} AS {label}_lo,
          CASE WHEN {n}%31<>0 THEN 64496+{n}%89 END AS {label}_asn,
          CASE WHEN {n} IS NOT NULL THEN {ptext(mask(n,'16'),'16')} END AS {label}_prefix,
          CASE WHEN {n}%3<>0 THEN 'Org-'||({n}%11)::VARCHAR||' Ltd' END AS {label}_org,
          CASE WHEN {n}%41<>0 THEN {iso(n+'%25')} END AS {label}_country""")
    return f"""
      SELECT row_id, resolver_type, protocol, timestamp_request, {', '.join(cols)} FROM (
        SELECT l_orderkey*10+l_linenumber AS row_id,
          CASE WHEN l_partkey%3=0 THEN 'Resolver' WHEN l_partkey%3=1 THEN 'Forwarder' ELSE 'Transparent Forwarder' END AS resolver_type,
          {pip(part)} AS q, {reply} AS r, {backend} AS b,
          CASE WHEN l_returnflag='R' THEN 'udp' WHEN l_returnflag='A' THEN 'tcp' END AS protocol,
          CASE WHEN l_orderkey%29<>0 THEN l_shipdate END AS timestamp_request
        FROM lineitem JOIN orders ON l_orderkey=o_orderkey)"""


def _attribute(keep: str, cols: str) -> str:
    return f"SELECT c_custkey AS resolver_id, {cols}, TIMESTAMP '2020-06-01' AS last_update_ts FROM customer WHERE c_custkey%50<>1 AND {keep}"


def _fattribute(keep: str, cols: str) -> str:
    return f"SELECT p_partkey AS forwarder_id, {cols}, TIMESTAMP '2020-05-01' AS last_update_ts FROM part WHERE {keep}"


V6HI = "2306139568115548160"

FIXTURES = {
    "fx_resolver": f"""
      SELECT {v4(rip('c_custkey'))} AS ip, 4 AS family, 0::BIGINT AS ip_hi, {rip('c_custkey')} AS ip_lo,
        c_custkey - (CASE WHEN c_custkey%50=1 THEN 1 ELSE 0 END) AS resolver_id, c_acctbal>5000 AS is_public,
        coalesce(ts, TIMESTAMP '2020-01-01') AS last_update_ts, lower(c_mktsegment) AS source
      FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS ts FROM orders GROUP BY 1) ON o_custkey=c_custkey""",
    "fx_resolver_v6": f"""
      SELECT '2001:db8:' || lower(to_hex(g3)) || ':' || lower(to_hex(g4)) || '::' || (CASE WHEN low=0 THEN '' ELSE lower(to_hex(low)) END) AS ip,
        6 AS family, {V6HI} + g3*65536 + g4 AS ip_hi, low AS ip_lo, resolver_id, is_public,
        TIMESTAMP '2021-01-01' AS last_update_ts, source
      FROM (SELECT c_custkey//65536 AS g3, c_custkey%63+1 AS g4, c_custkey%65536 AS low, c_custkey AS resolver_id,
              c_acctbal>0 AS is_public, lower(c_mktsegment) AS source FROM customer)""",
    "fx_resolver_dual": "SELECT * FROM fx_resolver UNION ALL SELECT * FROM fx_resolver_v6",
    "fx_resolver_identity": "SELECT c_custkey AS id, TIMESTAMP '2020-06-01' AS last_update_ts, 0 AS total_measurements, "
    "0 AS seen_measurements, c_custkey%4=0 AS verified FROM customer WHERE c_custkey%50<>1",
    "fx_resolver_asn": _attribute("c_custkey%13<>0", "64496+c_custkey%97 AS asn"),
    "fx_resolver_prefix": _attribute("c_custkey%11<>0", f"{ptext(mask(rip('c_custkey'),'14'),'14')} AS prefix"),
    "fx_resolver_location": _attribute(
        "c_custkey%17<>0", f"{iso('c_nationkey')} AS country, CASE WHEN c_custkey%3=0 THEN 'city-'||(c_custkey%7)::VARCHAR END AS city"
    ),
    "fx_resolver_org": _attribute("c_custkey%19<>0", "c_mktsegment||' Net' AS org"),
    "fx_resolver_domain": _attribute(
        "c_custkey%3=0", "(CASE WHEN c_custkey%2=1 THEN 'R' ELSE 'r' END)||(c_custkey%400)::VARCHAR||'.example.net' AS domain"
    ),
    "fx_resolver_dohpath": _attribute("c_custkey%7=0", "CASE WHEN c_custkey%2=0 THEN '/dns-query{?dns}' ELSE '/q{?dns}' END AS dohpath"),
    "fx_resolver_service": """
      SELECT o_custkey AS resolver_id,
        CASE o_orderpriority[1] WHEN '1' THEN 'doudp' WHEN '2' THEN 'dotcp' WHEN '3' THEN 'dot' WHEN '4' THEN 'doh' ELSE 'doq' END AS protocol,
        CASE o_orderpriority[1] WHEN '1' THEN 53 WHEN '2' THEN 53 WHEN '4' THEN 443 ELSE 853 END AS port,
        max(o_orderdate) AS last_update_ts
      FROM orders WHERE o_custkey%50<>1 GROUP BY 1,2,3""",
    "fx_qmin_resolver": """
      SELECT o_custkey AS resolver_id, CASE o_orderstatus WHEN 'F' THEN 'yes' WHEN 'O' THEN 'no' ELSE 'unstable' END AS qmin,
        CASE WHEN o_orderkey%7<>0 THEN o_orderkey%16 END AS max_minimise_count, o_orderkey%5 AS minimize_one_lab,
        o_orderdate AS last_update_ts, CASE WHEN o_orderstatus='F' THEN o_orderdate END AS first_qmin_observation,
        CASE WHEN o_orderstatus='F' THEN o_orderdate END AS last_qmin_observation, 'qmin-scan' AS source
      FROM orders WHERE o_custkey%50<>1
      QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC)=1""",
    "fx_dnssec_resolver": f"""
      SELECT {v4(rip('c_custkey'))} AS ip, c_custkey%2=0 AS validates, TIMESTAMP '2020-07-01' AS last_update_ts
      FROM customer WHERE c_custkey%5=0""",
    "fx_dnssec_country": f"""
      SELECT {iso('c_nationkey')} AS country, count(*) FILTER (WHERE c_acctbal>0) AS validating,
        round(count(*) FILTER (WHERE c_acctbal>0)*100.0/count(*),2)::DOUBLE AS validating_pc,
        count(*) FILTER (WHERE c_acctbal>5000) AS partial_validating,
        round(count(*) FILTER (WHERE c_acctbal>5000)*100.0/count(*),2)::DOUBLE AS partial_validating_pc,
        TIMESTAMP '2020-08-01' AS last_update_ts, 'dnssec-stats' AS source
      FROM customer GROUP BY c_nationkey""",
    "fx_country_location": f"""
      SELECT {iso('n_nationkey')} AS country, (n_nationkey*3-30)::DOUBLE AS latitude, (n_nationkey*7-80)::DOUBLE AS longitude
      FROM nation WHERE n_nationkey%6<>5""",
    "fx_anycast": f"""
      SELECT {ptext('net','masklen')} AS prefix, 4 AS family, masklen, 0::BIGINT AS net_hi, net AS net_lo,
        {ptext('net','masklen')} AS backing_prefix, partial, TIMESTAMP '2020-09-01' AS last_update_ts, 'census' AS source
      FROM (SELECT {SNET} AS net, {LEN} AS masklen, bool_or(s_acctbal<0) AS partial FROM supplier GROUP BY 1,2)""",
    "fx_anycast_v6": f"""
      SELECT DISTINCT CASE WHEN g4=0 THEN '2001:db8::/' ELSE '2001:db8:0:'||lower(to_hex(g4))||'::/' END || len::VARCHAR AS prefix,
        6 AS family, len AS masklen, {V6HI}+g4 AS net_hi, 0::BIGINT AS net_lo
      FROM (SELECT len, ((s_suppkey%63+1) >> (64-len)) << (64-len) AS g4 FROM
        (SELECT s_suppkey, CASE s_suppkey%3 WHEN 0 THEN 64 WHEN 1 THEN 60 ELSE 56 END AS len FROM supplier))""",
    "fx_anycast_asn": f"SELECT DISTINCT {ptext(SNET, LEN)} AS prefix, 64496+s_suppkey%97 AS asn FROM supplier",
    "fx_anycast_country_backend": f"""
      SELECT {ptext(LNET, LLEN)} AS prefix, {iso('c_nationkey')} AS country, count(DISTINCT l_partkey) AS country_count,
        TIMESTAMP '2020-09-01' AS last_update_ts, 'census' AS source
      FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN customer ON c_custkey=o_custkey GROUP BY 1,2""",
    "fx_anycast_asn_backend": f"""
      SELECT {ptext(LNET, LLEN)} AS prefix, 64496+o_custkey%97 AS asn, count(DISTINCT l_partkey) AS asn_count,
        TIMESTAMP '2020-09-01' AS last_update_ts, 'census' AS source
      FROM lineitem JOIN orders ON l_orderkey=o_orderkey GROUP BY 1,2""",
    "fx_spoofing": f"""
      SELECT {ptext('net','16')} AS prefix, 4 AS family, 16 AS masklen, 0::BIGINT AS net_hi, net AS net_lo, event_id%2=0 AS nat,
        CASE event_type WHEN 'click' THEN 'blocked' WHEN 'view' THEN 'unknown' WHEN 'error' THEN 'Received' WHEN 'purchase' THEN 'rewritten' END AS privatespoof,
        CASE event_id%4 WHEN 0 THEN 'received' WHEN 1 THEN 'blocked' WHEN 2 THEN 'unknown' END AS routedspoof,
        ts AS last_update_ts, 'spoof-sessions' AS source
      FROM (SELECT *, {mask('16777216+(user_id*104729)%16777216','16')} AS net FROM events)
      QUALIFY row_number() OVER (PARTITION BY net ORDER BY ts DESC, event_id DESC)=1""",
    "fx_spoofing_asn": "SELECT prefix, 64496+(net_lo>>16)%97 AS asn FROM fx_spoofing WHERE (net_lo>>16)%5<>0",
    "fx_spoofing_country": f"SELECT prefix, {iso('(net_lo>>16)%25')} AS country FROM fx_spoofing WHERE (net_lo>>16)%7<>0",
    "fx_forwarder": f"""
      SELECT {v4('33554432+(p_partkey*7927)%16777216')} AS ip, 4 AS family, 0::BIGINT AS ip_hi,
        33554432+(p_partkey*7927)%16777216 AS ip_lo, p_partkey AS forwarder_id, p_size%2=0 AS is_public,
        TIMESTAMP '2020-05-01' AS last_update_ts, CASE WHEN p_size%3=0 THEN 'transparent' ELSE 'recursive' END AS type,
        CASE WHEN p_size%3=0 THEN 1 ELSE 0 END AS transparent_count, CASE WHEN p_size%3=0 THEN 0 ELSE 1 END AS recursive_count,
        CASE WHEN p_size%3<>0 THEN TIMESTAMP '2020-05-01' END AS last_observed_as_recursive,
        CASE WHEN p_size%3=0 THEN TIMESTAMP '2020-05-01' END AS last_observed_as_transparent, 'scan' AS source
      FROM part""",
    "fx_forwarder_asn": _fattribute("p_partkey%9<>0", "64496+p_partkey%53 AS asn"),
    "fx_forwarder_location": _fattribute("p_partkey%8<>0", f"{iso('p_size%25')} AS country, NULL::VARCHAR AS city"),
    "fx_forwarder_protocol": """
      SELECT l_partkey AS forwarder_id, CASE WHEN l_returnflag='R' THEN 'udp' ELSE 'TCP' END AS protocol, max(l_shipdate) AS last_update_ts
      FROM lineitem WHERE l_returnflag IN ('R','A') GROUP BY 1,2""",
    "fx_forwarder_resolver_upstream": """
      SELECT l_partkey AS forwarder_id, o_custkey AS upstream_resolver_id, max(l_shipdate) AS last_update_ts
      FROM lineitem JOIN orders ON l_orderkey=o_orderkey WHERE o_custkey%50<>1 GROUP BY 1,2""",
    "fx_forwarder_forwarder_upstream": """
      SELECT l_partkey AS forwarder_id, l_suppkey AS upstream_forwarder_id, max(l_shipdate) AS last_update_ts
      FROM lineitem WHERE l_partkey<>l_suppkey GROUP BY 1,2""",
    "fx_scan": _scan(),
    "fx_census": f"""
      SELECT {ptext(SNET, LEN)} AS prefix, CASE WHEN s_suppkey%4<>0 THEN {ptext(mask(aip('s_suppkey'),'12'),'12')} END AS backing_prefix,
        s_acctbal<0 AS partial,
        CASE WHEN s_suppkey%10=0 THEN '-' WHEN s_suppkey%2=0 THEN (64496+s_suppkey%97)::VARCHAR
          ELSE (64496+s_suppkey%97)::VARCHAR||'_'||(64496+s_suppkey%13)::VARCHAR END AS ASN,
        s_suppkey, s_nationkey, s_suppkey%7 AS AB_icmp, s_suppkey%9 AS AB_tcp, s_suppkey%3 AS GCD_icmp, s_suppkey%4 AS GCD_tcp,
        {SNET} AS net_lo, {LEN} AS masklen, 4 AS family
      FROM supplier""",
    "fx_data_source": """
      SELECT DISTINCT lower(c_mktsegment) AS source, DATE '2020-01-01' AS date_added, 'list of '||lower(c_mktsegment) AS description,
        false AS apikey_required, NULL::TIMESTAMP AS last_retrieved_ts FROM customer WHERE lower(c_mktsegment)<>'machinery'""",
}


def with_fixtures(body: str, extra: dict[str, str] | None = None) -> str:
    """Put the fixture definitions a statement mentions in front of it."""
    known = {**FIXTURES, **(extra or {})}
    ordered: list[str] = []

    def add(text: str) -> None:
        for name in sorted(set(re.findall(r"\b(?:fx|st)_[a-z0-9_]+", text))):
            if name in known and name not in ordered:
                add(known[name])
                if name not in ordered:
                    ordered.append(name)

    add(body)
    if not ordered:
        return body
    return "WITH " + ", ".join(f"{n} AS ({known[n]})" for n in ordered) + " " + body
