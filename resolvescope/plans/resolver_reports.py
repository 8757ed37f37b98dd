"""Reports keyed by resolver address or identity.

``t`` is any object with the relations as attributes (``resolvescope.catalog.Catalog``).
Every report covers all targets; pass ``targets`` where a listing is wanted for given ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from resolvescope.functions.clean import pc, spoof_state, supports
from resolvescope.functions.net import address_order
from resolvescope.operators.containment import (
    IP_KEY,
    NET_KEY,
    ancestor_pairs,
    covering_prefixes,
    prefix_join,
    with_match,
)
from resolvescope.operators.rows import page
from resolvescope.session import materialise

SPOOF_COUNTS = ("allow", "received", "blocked", "unknown")


# ---- records -------------------------------------------------------------------------------


def service_text(services: DataFrame, keys: list[str]) -> DataFrame:
    """Sorted ``protocol:port`` list per key; a key has at most one entry per service."""
    name = F.concat_ws(":", "protocol", F.col("port").cast("string"))
    known = F.col("protocol").isNotNull() & F.col("port").isNotNull()
    return services.where(known).groupBy(*keys).agg(
        F.array_join(F.array_sort(F.collect_set(name)), ",").alias("supported_protocols")
    )


def resolver_base(t) -> DataFrame:
    """Address rows with the one-value attributes of their identity."""
    base = t.resolver.withColumnRenamed("last_update_ts", "last_observation_ts")
    parts = [
        t.resolver_asn.select("resolver_id", "asn"),
        t.resolver_prefix.select("resolver_id", F.col("prefix").alias("bgp_prefix")),
        t.resolver_org.select("resolver_id", "org"),
        t.resolver_domain.select("resolver_id", "domain"),
        t.resolver_location.select("resolver_id", "country", "city"),
    ]
    for part in parts:
        base = base.join(part, "resolver_id", "left")
    return base.withColumnRenamed("resolver_id", "id")


RECORD_COLUMNS = [
    "id", "ip", "asn", "bgp_prefix", "org", "domain", "country", "city", "is_public",
    "last_observation_ts", "source", "supported_protocols",
]


def resolver_records(t, limit: int | None = None, keep_keys: bool = False) -> DataFrame:
    """Full resolver rows; ``limit`` gives the first rows in address order."""
    services = service_text(t.resolver_service, ["resolver_id"]).withColumnRenamed("resolver_id", "id")
    rows = resolver_base(t).join(services, "id", "left")
    if limit is not None:
        rows = rows.orderBy(*address_order()).limit(limit)
    return rows.select(*RECORD_COLUMNS, *(IP_KEY if keep_keys else []))


RECORD_TARGET = {"ip": "ip", "prefix": "bgp_prefix", "asn": "asn", "country": "country"}


def records_by(t, kind: str, targets: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Records per target of one kind (ip, prefix, asn, country, domain).

    ``targets`` is a one-column frame of cleaned targets; without it every target is listed.
    ``limit`` keeps the first rows of each target in address order.
    """
    rows = resolver_records(t, keep_keys=True)
    column = F.lower("domain") if kind == "domain" else F.col(RECORD_TARGET[kind])
    rows = rows.withColumn("target", column).where(F.col("target").isNotNull())
    if targets is not None:
        wanted = F.col(targets.columns[0])
        wanted = F.lower(wanted) if kind == "domain" else wanted
        rows = rows.join(targets.select(wanted.alias("target")).distinct(), "target")
    if limit is not None:
        rows = page(rows, address_order(), 1, limit, by=["target"]).drop("rank")
    return rows.drop(*IP_KEY)


def records_by_service(t, targets: DataFrame, limit: int | None = None) -> DataFrame:
    """Records per (protocol, port) target, port null meaning any.

    The service filter acts before aggregation: the service list shows matching services only.
    """
    wanted = targets.select(
        F.lower("protocol").alias("_protocol"), F.col("port").alias("_port"),
        F.concat_ws(":", F.lower("protocol"), F.col("port").cast("string")).alias("target"),
    ).distinct()
    hits = t.resolver_service.join(
        wanted, (F.lower("protocol") == F.col("_protocol")) & (F.col("_port").isNull() | (F.col("port") == F.col("_port")))
    )
    services = service_text(hits, ["target", "resolver_id"]).withColumnRenamed("resolver_id", "id")
    rows = services.join(resolver_base(t), "id")
    if limit is not None:
        rows = page(rows, address_order(), 1, limit, by=["target"]).drop("rank")
    return rows.select("target", *RECORD_COLUMNS)


def resolver_core(t, targets: DataFrame) -> DataFrame:
    """Each asked address with a found flag and its identity."""
    asked = targets.select(F.col(targets.columns[0]).alias("resolver_ip")).distinct()
    known = t.resolver.select(F.col("ip").alias("resolver_ip"), F.col("resolver_id").alias("id"))
    return asked.join(known, "resolver_ip", "left").withColumn("found", F.col("id").isNotNull())


# ---- identities that belong together --------------------------------------------------------


def alternative_groups(t) -> DataFrame:
    """(resolver_id, group_key): identities sharing a domain, ignoring case, share a group.

    An identity has one domain, so sharing is an equivalence and the relation is stored once
    per identity instead of once per pair.
    """
    ids = t.resolver.select("resolver_id").distinct()
    domains = t.resolver_domain.where(F.col("domain").isNotNull()).select("resolver_id", F.lower("domain").alias("_domain"))
    key = F.coalesce(F.concat(F.lit("domain:"), F.col("_domain")), F.concat(F.lit("id:"), F.col("resolver_id").cast("string")))
    return ids.join(domains, "resolver_id", "left").select("resolver_id", key.alias("group_key"))


def alternative_members(t) -> DataFrame:
    """Addresses of every group: the answer of the alternatives listing, stored once per group."""
    return t.resolver.select("resolver_id", "ip", "family").join(alternative_groups(t), "resolver_id").select(
        "group_key", "ip", "family"
    )


def alternative_ips(t, targets: DataFrame) -> DataFrame:
    """(resolver_id, ip, family) of all related identities for the given identities."""
    asked = targets.select(F.col(targets.columns[0]).alias("resolver_id")).distinct()
    return asked.join(alternative_groups(t), "resolver_id").join(alternative_members(t), "group_key").select(
        "resolver_id", "ip", "family"
    )


def sibling_ips(t, targets: DataFrame) -> DataFrame:
    """(resolver_ip, ip, family): alternatives of the given addresses without the address itself."""
    asked = targets.select(F.col(targets.columns[0]).alias("resolver_ip")).distinct()
    ids = asked.join(t.resolver.select(F.col("ip").alias("resolver_ip"), "resolver_id"), "resolver_ip")
    pairs = ids.join(alternative_groups(t), "resolver_id").join(alternative_members(t), "group_key")
    return pairs.where(F.col("ip") != F.col("resolver_ip")).select("resolver_ip", "ip", "family")


def alternative_summary(t) -> DataFrame:
    """Per address: size of its group and which address families the group has."""
    groups = alternative_members(t).groupBy("group_key").agg(
        F.count(F.lit(1)).alias("alternative_ip_count"),
        F.bool_or(F.col("family") == 4).alias("supports_ipv4"),
        F.bool_or(F.col("family") == 6).alias("supports_ipv6"),
    )
    return (
        t.resolver.select("resolver_id", "ip")
        .join(alternative_groups(t), "resolver_id")
        .join(groups, "group_key")
        .select("ip", "group_key", "alternative_ip_count", (F.col("alternative_ip_count") - 1).alias("sibling_ip_count"),
                "supports_ipv4", "supports_ipv6")
    )


def resolver_facets(t) -> DataFrame:
    """Domain, DoH path and service list per identity."""
    return (
        t.resolver.select("resolver_id").distinct()
        .join(t.resolver_domain.select("resolver_id", "domain"), "resolver_id", "left")
        .join(t.resolver_dohpath.select("resolver_id", "dohpath"), "resolver_id", "left")
        .join(service_text(t.resolver_service, ["resolver_id"]), "resolver_id", "left")
        .withColumnRenamed("supported_protocols", "services")
    )


def resolver_qmin(t) -> DataFrame:
    """Minimisation state per address, null where unmeasured."""
    state = t.qmin_resolver.select(
        "resolver_id", "qmin", "max_minimise_count", "minimize_one_lab", "first_qmin_observation",
        "last_qmin_observation", "last_update_ts", "source",
    )
    return t.resolver.select(F.col("ip").alias("resolver_ip"), "resolver_id").join(state, "resolver_id", "left").drop("resolver_id")


def resolver_dnssec(t) -> DataFrame:
    checks = t.dnssec_resolver.select(
        F.col("ip").alias("resolver_ip"), F.col("validates").alias("resolver_dnssec_validates"),
        F.col("last_update_ts").alias("resolver_dnssec_last_update_ts"),
    )
    return t.resolver.select(F.col("ip").alias("resolver_ip")).join(checks, "resolver_ip", "left")


# ---- anycast and spoofing per address --------------------------------------------------------


def _with_prefix_facts(ips: DataFrame, prefixes: DataFrame, facts: DataFrame) -> DataFrame:
    """Address rows with the facts of their longest covering prefix (nulls when uncovered)."""
    matched = with_match(ips, prefixes, "_match")
    # An uncovered address goes by itself, so that such rows are not dealt to one task.
    keyed = matched.withColumn("_of", F.coalesce("_match.prefix", F.concat_ws(" ", F.lit("none"), *IP_KEY))).drop("_match")
    return keyed.join(facts.withColumnRenamed("prefix", "_of"), "_of", "left").drop("_of")


def _in_prefixes(ips: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Covered address rows with the text of their longest prefix instead of their key."""
    found = with_match(ips, prefixes, "_match").where(F.col("_match").isNotNull())
    return found.withColumn("prefix", F.col("_match.prefix")).drop("_match", *IP_KEY)


def _over_ancestors(prefixes: DataFrame, values: DataFrame) -> DataFrame:
    """Per prefix, the rows of ``values`` (keyed by prefix) of the prefix and all its ancestors."""
    pairs = ancestor_pairs(prefixes).select("prefix", "ancestor")
    return pairs.join(values.withColumnRenamed("prefix", "ancestor"), "ancestor")


def anycast_cover_facts(t) -> DataFrame:
    """Per anycast prefix with its ancestors: how many cover it, any partial, newest stamp."""
    return _over_ancestors(t.anycast, t.anycast.select("prefix", "partial", "last_update_ts")).groupBy("prefix").agg(
        F.count(F.lit(1)).alias("prefix_count"),
        F.bool_or("partial").alias("partial"),
        F.max("last_update_ts").alias("last_update_ts"),
    )


def resolver_anycast(t) -> DataFrame:
    """Anycast cover per address: number of covering prefixes, any partial, newest stamp."""
    rows = _with_prefix_facts(t.resolver.select("ip", *IP_KEY), t.anycast, anycast_cover_facts(t))
    count = F.coalesce("prefix_count", F.lit(0))
    return rows.select("ip", (count > 0).alias("anycast_found"), count.alias("prefix_count"), "partial", "last_update_ts")


def _chain_sites(t, backend: DataFrame, key: str, count: str) -> DataFrame:
    return _over_ancestors(t.anycast, backend.select("prefix", key, count, "last_update_ts")).groupBy("prefix", key).agg(
        F.sum(count).alias("count"), F.max("last_update_ts").alias("last_update_ts")
    )


def resolver_anycast_sites(t, kind: str = "country", targets: DataFrame | None = None) -> DataFrame:
    """Sites behind each covered address by country (with coordinates) or by ASN; of the addresses in
    ``targets`` (column ip) if given, else of all.

    Counts of nested covering prefixes add up; they are added per prefix before meeting the
    addresses, so the address side is joined once, not once per covering prefix.
    """
    if kind == "country":
        sites = _chain_sites(t, t.anycast_country_backend, "country", "country_count")
        sites = with_coordinates(sites, t.country_location)
    else:
        sites = _chain_sites(t, t.anycast_asn_backend, "asn", "asn_count")
    asked = t.resolver if targets is None else t.resolver.join(targets.select("ip").distinct(), "ip", "left_semi")
    out = _in_prefixes(asked.select("ip", *IP_KEY), t.anycast).join(sites, "prefix")
    return out.select("ip", kind, "count", *(["latitude", "longitude"] if kind == "country" else []), "last_update_ts")


def anycast_site_facts(t) -> DataFrame:
    """Per anycast prefix with its ancestors: site count, countries, backend ASNs."""
    countries = _over_ancestors(t.anycast, t.anycast_country_backend.select("prefix", "country", "country_count")).groupBy("prefix").agg(
        F.sum("country_count").alias("anycast_site_count"), F.count_distinct("country").alias("anycast_country_count")
    )
    asns = _over_ancestors(t.anycast, t.anycast_asn_backend.select("prefix", "asn")).groupBy("prefix").agg(
        F.count_distinct("asn").alias("anycast_asn_count")
    )
    zero = F.lit(0).cast("bigint")
    return (
        t.anycast.select("prefix").join(countries, "prefix", "left").join(asns, "prefix", "left")
        .select("prefix", *[F.coalesce(c, zero).alias(c) for c in ("anycast_site_count", "anycast_country_count", "anycast_asn_count")])
    )


def spoof_flags() -> dict[str, Column]:
    return spoof_state(F.col("privatespoof"), F.col("routedspoof"))


def spoofing_facts(t) -> DataFrame:
    """Per spoofing prefix with its ancestors: observation counts by state and newest stamp."""
    flags = t.spoofing.select("prefix", "last_update_ts", *[c.alias(n) for n, c in spoof_flags().items()])
    return _over_ancestors(t.spoofing, flags).groupBy("prefix").agg(
        F.count(F.lit(1)).alias("spoofing_prefix_count"),
        *[F.count_if(n).alias(f"spoofing_{n}_count") for n in SPOOF_COUNTS],
        F.max("last_update_ts").alias("spoofing_last_update_ts"),
    )


def resolver_spoofing(t) -> DataFrame:
    """Spoofing observations covering each address."""
    rows = _with_prefix_facts(t.resolver.select("ip", *IP_KEY), t.spoofing, spoofing_facts(t))
    names = ["spoofing_prefix_count", *[f"spoofing_{n}_count" for n in SPOOF_COUNTS]]
    counts = {n: F.coalesce(F.col(n), F.lit(0).cast("bigint")) for n in names}
    filled = rows.withColumns(counts)
    return filled.select(
        "ip", *names, pc(F.col("spoofing_allow_count"), F.col("spoofing_prefix_count")).alias("spoofing_allow_pc"),
        "spoofing_last_update_ts",
    )


def spoofing_allow_prefixes(t, k: int = 10) -> DataFrame:
    """The k most specific covering prefixes that let spoofed packets out, per address."""
    allowing = t.spoofing.where(spoof_flags()["allow"]).select("prefix", *NET_KEY, "privatespoof", "routedspoof")
    ranked = covering_prefixes(t.resolver.select("ip", *IP_KEY), allowing, k)
    return ranked.select("ip", "rank", "prefix", "privatespoof", "routedspoof")


def with_coordinates(df: DataFrame, dim: DataFrame, key: str = "country") -> DataFrame:
    """Country coordinates; the dimension has one row per country of the world."""
    coords = dim.groupBy(key).agg(F.max("latitude").alias("latitude"), F.max("longitude").alias("longitude"))
    return df.join(coords, key, "left")


# ---- forwarders that relay to an address -----------------------------------------------------


def _relay_members(t) -> DataFrame:
    """(ip, r_id, f_id): what an address can be used as, an identity of each kind; -1 for none."""
    resolvers = t.resolver.select("ip", F.col("resolver_id").alias("r_id"))
    forwarders = t.forwarder.select("ip", F.col("forwarder_id").alias("f_id"))
    known = resolvers.join(forwarders, "ip", "full_outer").distinct()
    return known.select("ip", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("r_id", "f_id")])


def _relay_groups(t, members: DataFrame) -> DataFrame:
    """Distinct (r_id, f_id, forwarder_id): the forwarders behind each pair of identities.

    All addresses of an identity that are no forwarders share one pair, so its forwarders are listed
    once, not once per address. The rows lie by forwarder, which callers join on next: one exchange serves both.
    """
    pairs = members.select("r_id", "f_id").distinct()
    by_resolver = t.forwarder_resolver_upstream.select("forwarder_id", F.col("upstream_resolver_id").alias("r_id"))
    by_forwarder = t.forwarder_forwarder_upstream.select("forwarder_id", F.col("upstream_forwarder_id").alias("f_id"))
    names = ["r_id", "f_id", "forwarder_id"]
    found = pairs.join(by_resolver, "r_id").select(*names).union(pairs.join(by_forwarder, "f_id").select(*names))
    return found.repartition("forwarder_id").distinct()


def forwarder_relays(t) -> DataFrame:
    """Per address: relaying forwarders, their networks, countries and transports.

    Networks and countries are counted as sets, as large as the world has of them at most: two counts of
    distinct values would send every row three times."""
    wire = t.forwarder_protocol.groupBy("forwarder_id").agg(
        F.bool_or(F.lower("protocol") == "tcp").alias("_tcp"), F.bool_or(F.lower("protocol") == "udp").alias("_udp")
    )
    members = _relay_members(t)
    rows = (
        _relay_groups(t, members)
        .join(t.forwarder_asn.select("forwarder_id", "asn"), "forwarder_id", "left")
        .join(t.forwarder_location.select("forwarder_id", "country"), "forwarder_id", "left")
        .join(wire, "forwarder_id", "left")
    )
    counted = rows.groupBy("r_id", "f_id").agg(
        F.count(F.lit(1)).alias("forwarder_entry_count"),
        F.size(F.collect_set("asn")).cast("bigint").alias("forwarder_asn_count"),
        F.size(F.collect_set("country")).cast("bigint").alias("forwarder_country_count"),
        F.count_if("_tcp").alias("forwarder_tcp_count"),
        F.count_if("_udp").alias("forwarder_udp_count"),
        F.count_if(F.col("_tcp") & F.col("_udp")).alias("forwarder_tcp_udp_count"),
    )
    return members.join(counted, ["r_id", "f_id"]).drop("r_id", "f_id")


def forwarder_relays_by(t, kind: str, targets: DataFrame | None = None) -> DataFrame:
    """Relaying forwarders per address split by country or by ASN; of the addresses in ``targets``
    (column ip) if given."""
    table, column = (t.forwarder_location, "country") if kind == "country" else (t.forwarder_asn, "asn")
    known = table.where(F.col(column).isNotNull()).select("forwarder_id", column)
    members = _relay_members(t)
    members = members if targets is None else members.join(targets.select("ip").distinct(), "ip", "left_semi")
    counted = _relay_groups(t, members).join(known, "forwarder_id").groupBy("r_id", "f_id", column).agg(F.count(F.lit(1)).alias("count"))
    return members.join(counted, ["r_id", "f_id"]).select("ip", column, "count")


# ---- composites ------------------------------------------------------------------------------

RELAY_COUNTS = [
    "forwarder_entry_count", "forwarder_asn_count", "forwarder_country_count",
    "forwarder_tcp_count", "forwarder_udp_count", "forwarder_tcp_udp_count",
]


def resolver_summary(t) -> DataFrame:
    """One wide row per address: attributes, minimisation, DNSSEC, anycast, spoofing, relays."""
    zero = F.lit(0).cast("bigint")
    base = resolver_records(t, keep_keys=True).withColumnRenamed("id", "resolver_id")
    qmin = t.qmin_resolver.select(
        "resolver_id", F.col("qmin").alias("resolver_qmin"), F.col("max_minimise_count").alias("resolver_qmin_max_minimise_count"),
        F.col("minimize_one_lab").alias("resolver_qmin_minimize_one_lab"), F.col("last_update_ts").alias("_qmin_ts"),
    )
    dnssec = t.dnssec_resolver.select("ip", F.col("validates").alias("resolver_dnssec_validates"))
    facts = anycast_cover_facts(t).select("prefix", F.lit(True).alias("_covered"), F.col("last_update_ts").alias("_anycast_ts"))
    anycast = _with_prefix_facts(t.resolver.select("ip", *IP_KEY), t.anycast, facts.join(anycast_site_facts(t), "prefix")).drop(*IP_KEY)
    anycast = anycast.withColumn("anycast_found", F.coalesce("_covered", F.lit(False)))
    wide = (
        base.join(t.resolver_dohpath.select("resolver_id", F.col("dohpath").alias("resolver_dohpath")), "resolver_id", "left")
        .join(qmin, "resolver_id", "left")
        .join(dnssec, "ip", "left")
        .join(alternative_summary(t), "ip", "left")
        .join(resolver_spoofing(t), "ip", "left")
        .join(anycast, "ip", "left")
        .join(forwarder_relays(t), "ip", "left")
    )
    counts = ["anycast_site_count", "anycast_country_count", "anycast_asn_count", *RELAY_COUNTS]
    return wide.select(
        F.col("ip").alias("resolver_ip"), "family", "resolver_id",
        F.col("asn").alias("resolver_asn"), F.col("bgp_prefix").alias("resolver_prefix"),
        F.col("country").alias("resolver_country"), F.col("city").alias("resolver_city"), F.col("org").alias("resolver_org"),
        F.col("domain").alias("resolver_domain"), "resolver_qmin", "resolver_qmin_max_minimise_count",
        "resolver_qmin_minimize_one_lab", "resolver_dohpath", "resolver_dnssec_validates",
        F.col("is_public").alias("resolver_is_public"), F.col("supported_protocols").alias("resolver_supported_protocols"),
        supports(F.col("supported_protocols"), "dotcp").alias("resolver_supports_tcp"),
        supports(F.col("supported_protocols"), "doudp").alias("resolver_supports_udp"),
        F.col("supports_ipv4").alias("resolver_supports_ipv4"), F.col("supports_ipv6").alias("resolver_supports_ipv6"),
        "alternative_ip_count", "sibling_ip_count", "spoofing_prefix_count",
        *[f"spoofing_{n}_count" for n in SPOOF_COUNTS], "spoofing_allow_pc", "spoofing_last_update_ts", "anycast_found",
        *[F.coalesce(F.col(c), zero).alias(c) for c in counts],
        F.coalesce("last_observation_ts", "_qmin_ts", "_anycast_ts").alias("last_observation_ts"),
    )


def _domain_scope(summary: DataFrame, limit: int | None) -> DataFrame:
    rows = summary.withColumn("domain", F.lower("resolver_domain")).where(F.col("domain").isNotNull())
    return rows if limit is None else page(rows, [F.col("family"), F.col("resolver_ip")], 1, limit, by=["domain"]).drop("rank")


def domain_summary(t, limit: int | None = None, cut=materialise) -> DataFrame:
    """Per domain over its resolvers; ``limit`` looks at the first rows of each domain only. The
    resolver summary, which three parts read, is written once."""
    rows = cut(_domain_scope(resolver_summary(t), limit))
    single = F.count_distinct("resolver_dnssec_validates")
    measured = F.count("resolver_qmin")
    total = F.count(F.lit(1))
    services = F.array_sort(F.collect_set("_service"))
    out = rows.groupBy("domain").agg(
        total.alias("domain_resolver_count"),
        F.count_if("resolver_is_public").alias("domain_public_count"),
        F.count_distinct("resolver_asn").alias("resolver_asn"),
        F.count_distinct("resolver_country").alias("resolver_country"),
        F.count_distinct("resolver_prefix").alias("resolver_prefix"),
        F.count_distinct("resolver_org").alias("resolver_org"),
        F.min("resolver_dohpath").alias("resolver_dohpath"),
        F.when(measured > 0, F.concat(F.lit("Measured "), measured.cast("string"), F.lit("/"), total.cast("string"))).alias("resolver_qmin"),
        F.when(single == 1, F.bool_or("resolver_dnssec_validates")).alias("resolver_dnssec_validates"),
        F.bool_or("resolver_supports_tcp").alias("resolver_supports_tcp"),
        F.bool_or("resolver_supports_udp").alias("resolver_supports_udp"),
        F.bool_or(F.col("family") == 4).alias("resolver_supports_ipv4"),
        F.bool_or(F.col("family") == 6).alias("resolver_supports_ipv6"),
        *[F.sum(f"spoofing_{n}_count").alias(f"spoofing_{n}_count") for n in ("prefix", *SPOOF_COUNTS)],
        F.bool_or("anycast_found").alias("anycast_found"),
        F.sum("anycast_site_count").alias("anycast_site_count"),
        F.sum("anycast_asn_count").alias("anycast_asn_count"),
        F.max("last_observation_ts").alias("last_observation_ts"),
    )
    out = out.withColumns({
        "resolver_is_public": F.col("domain_public_count") > 0,
        "domain_is_dual_stack": F.col("resolver_supports_ipv4") & F.col("resolver_supports_ipv6"),
    })
    names = rows.select("domain", F.explode(F.split("resolver_supported_protocols", ",")).alias("_service")).distinct()
    texts = names.groupBy("domain").agg(F.array_join(services, ",").alias("resolver_supported_protocols"))
    return out.join(texts, "domain", "left").join(domain_anycast_countries(t, rows), "domain", "left").fillna(0, ["anycast_country_count"])


def domain_anycast_countries(t, rows: DataFrame) -> DataFrame:
    """Distinct anycast countries over a domain's addresses, via the prefixes they fall in."""
    where = (
        rows.select(F.col("resolver_ip").alias("ip"), "domain")
        .join(_in_prefixes(t.resolver.select("ip", *IP_KEY), t.anycast), "ip")
        .select("domain", "prefix").distinct()
    )
    countries = _over_ancestors(t.anycast, t.anycast_country_backend.select("prefix", "country")).select("prefix", "country").distinct()
    return where.join(countries, "prefix").groupBy("domain").agg(F.count_distinct("country").alias("anycast_country_count"))


def browse(
    rows: DataFrame,
    search: str | None = None,
    country: str | None = None,
    is_public: bool | None = None,
    columns: tuple[str, ...] = ("ip", "asn", "country", "org"),
) -> DataFrame:
    """Table search: case-insensitive substring over the columns plus exact filters."""
    if search:
        hit = F.lit(False)
        for name in columns:
            hit = hit | F.coalesce(F.contains(F.lower(F.col(name).cast("string")), F.lit(search.lower())), F.lit(False))
        rows = rows.where(hit)
    if country is not None:
        rows = rows.where(F.col("country") == country)
    if is_public is not None:
        rows = rows.where(F.col("is_public") == is_public)
    return rows
