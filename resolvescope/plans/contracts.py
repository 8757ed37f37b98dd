"""Checks of the keys, references and ranges the relations promise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = {
    "data_source": ["source"], "country_location": ["country"], "resolver_identity": ["id"], "resolver": ["ip"],
    "resolver_service": ["resolver_id", "protocol", "port"], "resolver_dohpath": ["resolver_id"], "resolver_asn": ["resolver_id"],
    "resolver_prefix": ["resolver_id"], "resolver_org": ["resolver_id"], "resolver_domain": ["resolver_id"],
    "resolver_location": ["resolver_id"], "resolver_verification": ["resolver_id", "verifying_source"], "qmin_resolver": ["resolver_id"],
    "forwarder_identity": ["id"], "forwarder": ["ip"], "forwarder_protocol": ["forwarder_id", "protocol"],
    "forwarder_endpoint": ["forwarder_id"], "forwarder_asn": ["forwarder_id"], "forwarder_prefix": ["forwarder_id"],
    "forwarder_org": ["forwarder_id"], "forwarder_location": ["forwarder_id"], "forwarder_domain": ["forwarder_id"],
    "forwarder_resolver_upstream": ["forwarder_id", "upstream_resolver_id"],
    "forwarder_forwarder_upstream": ["forwarder_id", "upstream_forwarder_id"],
    "anycast": ["prefix"], "anycast_asn": ["prefix", "asn"], "anycast_country_backend": ["prefix", "country"],
    "anycast_asn_backend": ["prefix", "asn"], "spoofing": ["prefix"], "spoofing_asn": ["prefix"], "spoofing_country": ["prefix"],
    "dnssec_resolver": ["ip"], "dnssec_resolver_dobit": ["ip"], "dnssec_asn": ["asn"], "dnssec_country": ["country"],
}


def _references() -> list[tuple[str, str, str, str]]:
    out = []
    for name in KEYS:
        if name.startswith("resolver") and name != "resolver_identity" or name == "qmin_resolver":
            out.append((name, "resolver_id", "resolver_identity", "id"))
        if name.startswith("forwarder") and name != "forwarder_identity":
            out.append((name, "forwarder_id", "forwarder_identity", "id"))
        if name in ("resolver_location", "forwarder_location", "anycast_country_backend", "spoofing_country", "dnssec_country"):
            out.append((name, "country", "country_location", "country"))
        if name.startswith("anycast_"):
            out.append((name, "prefix", "anycast", "prefix"))
        if name.startswith("spoofing_"):
            out.append((name, "prefix", "spoofing", "prefix"))
        if name in ("resolver", "forwarder", "qmin_resolver", "anycast", "spoofing", "dnssec_asn", "dnssec_country"):
            out.append((name, "source", "data_source", "source"))
        if name.startswith("dnssec_resolver"):
            out.append((name, "ip", "resolver", "ip"))
    out.append(("forwarder_resolver_upstream", "upstream_resolver_id", "resolver_identity", "id"))
    out.append(("forwarder_forwarder_upstream", "upstream_forwarder_id", "forwarder_identity", "id"))
    return out


NOT_NULL = {
    "resolver": ["resolver_id", "is_public", "last_update_ts", "source"], "resolver_asn": ["asn"], "resolver_prefix": ["prefix"],
    "resolver_org": ["org"], "resolver_domain": ["domain"], "resolver_location": ["country"], "forwarder": ["forwarder_id", "type", "source"],
    "anycast": ["partial", "source"], "spoofing": ["source"],
}


def check_contracts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, rule, violations): broken key, reference, null and range rules of the given
    relations; a reference is checked when both sides are given. Clean rules give no row."""
    parts = []

    def add(name: str, rule: str, bad: DataFrame) -> None:
        parts.append(bad.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("table_name"), F.lit(rule).alias("rule"), "violations"))

    for name, df in tables.items():
        keys = KEYS[name]
        add(name, f"unique({', '.join(keys)})", df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1))
        for column in [*keys, *NOT_NULL.get(name, [])]:
            add(name, f"not_null({column})", df.where(F.col(column).isNull()))
        if name == "resolver_service":
            add(name, "port_range", df.where(~F.col("port").between(1, 65535)))
    for name, column, other, key in _references():
        if name in tables and other in tables:
            used = tables[name].where(F.col(column).isNotNull()).select(F.col(column).alias("_k")).distinct()
            add(name, f"reference({column} -> {other})", used.join(tables[other].select(F.col(key).alias("_k")), "_k", "left_anti"))
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part)
    return stacked.where(F.col("violations") > 0)
