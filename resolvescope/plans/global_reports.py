"""Whole-population reports. Each is a handful of aggregates; single rows are put together
with scalar subqueries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resolvescope.functions.clean import pc
from resolvescope.operators.containment import IP_KEY, NET_KEY, longest_match, prefix_join, with_cover_flag
from resolvescope.operators.rows import distribution, one_row
from resolvescope.plans.resolver_reports import anycast_site_facts, spoof_flags, with_coordinates
from resolvescope.plans.scope_reports import RISK_LEVEL, spoofable_asns, spoofable_prefixes


def _count(df: DataFrame, *what) -> DataFrame:
    return df.agg(*(what or [F.count(F.lit(1))]))


def global_ip_version(t) -> DataFrame:
    """Addresses, public share and newest stamp per address family."""
    out = t.resolver.groupBy("family").agg(
        F.count(F.lit(1)).alias("resolver_count"),
        F.count_if("is_public").alias("public_count"),
        F.max("last_update_ts").alias("last_observation_ts"),
    )
    return out.withColumn("public_percent", pc(F.col("public_count"), F.col("resolver_count")))


def global_dual_stack(t) -> DataFrame:
    """Identities with addresses of both families."""
    both = t.resolver.groupBy("resolver_id").agg(
        F.bool_or(F.col("family") == 4).alias("v4"), F.bool_or(F.col("family") == 6).alias("v6")
    )
    return both.agg(F.count_if(F.col("v4") & F.col("v6")).alias("dual_stack_count"))


def global_scope(t) -> DataFrame:
    return one_row(
        t.resolver.sparkSession,
        resolver_count=_count(t.resolver),
        resolver_unique_asn_count=_count(t.resolver_asn, F.count_distinct("asn")),
        resolver_unique_country_count=_count(t.resolver_location, F.count_distinct("country")),
        last_observation_ts=_count(t.resolver, F.max("last_update_ts")),
    )


def global_anycast(t) -> DataFrame:
    """Addresses inside anycast prefixes."""
    covered = with_cover_flag(t.resolver.select(*IP_KEY), t.anycast)
    out = covered.agg(F.count(F.lit(1)).alias("resolver_count"), F.count_if("covered").alias("resolver_anycast_count"))
    return out.withColumn("resolver_anycast_pc", pc(F.col("resolver_anycast_count"), F.col("resolver_count")))


def anycast_reach(t) -> DataFrame:
    """Per covered address: sites, countries and ASNs over all covering prefixes."""
    facts = t.anycast.select(*NET_KEY, "prefix").join(anycast_site_facts(t), "prefix").drop("prefix")
    reach = longest_match(t.resolver, t.anycast).join(facts, NET_KEY)
    return t.resolver.select("ip", *IP_KEY).join(reach, IP_KEY).select(
        "ip", "anycast_site_count", "anycast_country_count", "anycast_asn_count"
    )


def top_anycast(t, k: int = 5) -> DataFrame:
    """The k addresses with most anycast sites, then countries, then ASNs, then address text."""
    order = [F.col(c).desc() for c in ("anycast_site_count", "anycast_country_count", "anycast_asn_count")]
    return anycast_reach(t).orderBy(*order, "ip").limit(k)


def global_qmin(t) -> DataFrame:
    """Measured, enabled and at-risk identities."""
    out = t.qmin_resolver.agg(
        F.count_distinct("resolver_id").alias("qmin_measured_count"),
        F.count_distinct(F.when(F.col("qmin") == "yes", F.col("resolver_id"))).alias("qmin_enabled_count"),
        F.count_distinct(F.when(F.col("max_minimise_count") > RISK_LEVEL, F.col("resolver_id"))).alias("qmin_amplification_risk_count"),
    )
    whole = F.col("qmin_measured_count")
    return out.withColumns({
        "qmin_enabled_pc": pc(F.col("qmin_enabled_count"), whole),
        "qmin_amplification_risk_pc": pc(F.col("qmin_amplification_risk_count"), whole),
    })


def global_qmin_distribution(t, column: str = "max_minimise_count", top: int | None = 10) -> DataFrame:
    return distribution(t.qmin_resolver, column, (), top)


def global_protocols(t) -> DataFrame:
    """Identities per protocol, per port and per service, each as a share of all identities.

    ``level`` tells the three listings apart.
    """
    named = F.trim(F.coalesce("protocol", F.lit(""))) != ""
    rows = t.resolver_service.select("resolver_id", "protocol", "port").distinct()
    both = (F.col("level") != "port") & ~named | (F.col("level") != "protocol") & F.col("port").isNull()
    levels = rows.withColumn("level", F.explode(F.array(F.lit("protocol"), F.lit("port"), F.lit("service")))).where(~both)
    keyed = levels.select(
        "resolver_id", "level",
        F.when(F.col("level") != "port", F.col("protocol")).alias("protocol"),
        F.when(F.col("level") != "protocol", F.col("port")).alias("port"),
    )
    total = t.resolver.agg(F.count_distinct("resolver_id")).scalar()
    out = keyed.groupBy("level", "protocol", "port").agg(F.count_distinct("resolver_id").alias("count"))
    return out.withColumn("resolver_count", total).withColumn("percent", pc(F.col("count"), F.col("resolver_count")))


def global_spoofing(t) -> DataFrame:
    """Addresses in allowing and in blocking prefixes (one address may be in both), and the
    identities and ASNs matched by ASN."""
    ips = t.resolver.select(*IP_KEY)
    blocked = t.spoofing.where(spoof_flags()["blocked"])
    by_asn = t.resolver_asn.select("resolver_id", "asn").join(spoofable_asns(t), "asn", "left_semi")
    out = one_row(
        t.resolver.sparkSession,
        resolver_count=_count(t.resolver),
        resolver_spoofing_allow_count=_count(prefix_join(ips, spoofable_prefixes(t), "left_semi")),
        resolver_spoofing_blocked_count=_count(prefix_join(ips, blocked, "left_semi")),
        resolver_spoofing_allow_asn_resolver_count=_count(by_asn, F.count_distinct("resolver_id")),
        spoofing_allow_asn_match_count=_count(by_asn, F.count_distinct("asn")),
    )
    whole = F.col("resolver_count")
    return out.withColumns({
        "resolver_spoofing_allow_pc": pc(F.col("resolver_spoofing_allow_count"), whole),
        "resolver_spoofing_blocked_pc": pc(F.col("resolver_spoofing_blocked_count"), whole),
        "resolver_spoofing_allow_asn_resolver_pc": pc(F.col("resolver_spoofing_allow_asn_resolver_count"), whole),
    })


def global_countries(t, top: int | None = None) -> DataFrame:
    """Addresses per country with coordinates, most populated first; all of them unless ``top`` is given."""
    rows = t.resolver_location.select("resolver_id", "country").join(t.resolver.select("resolver_id", "is_public"), "resolver_id")
    counted = rows.groupBy("country").agg(
        F.count(F.lit(1)).alias("count"), F.count_if("is_public").alias("public_count"),
        F.count_if(~F.col("is_public")).alias("closed_count"),
    )
    ordered = with_coordinates(counted, t.country_location).orderBy(F.col("count").desc(), "country")
    return ordered if top is None else ordered.limit(top)


def global_asns(t, top: int = 10) -> DataFrame:
    counted = t.resolver_asn.where(F.col("asn").isNotNull()).groupBy("asn").agg(F.count_distinct("resolver_id").alias("count"))
    return counted.orderBy(F.col("count").desc(), "asn").limit(top)


def global_dnssec(t) -> DataFrame:
    return t.dnssec_country.agg(
        F.count_distinct("country").alias("dnssec_country_count"),
        F.round(F.coalesce(F.avg("validating_pc"), F.lit(0.0)), 2).alias("dnssec_validating_avg"),
        F.max("last_update_ts").alias("last_update_ts"),
    )


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per relation, with a flag for whether anything is loaded at all."""
    parts = [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count") for name, df in tables.items()]
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part)
    return stacked.withColumn("loaded", F.col("row_count") > 0)
