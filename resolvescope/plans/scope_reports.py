"""Reports per network (ASN), country and prefix, and their prefix pages.

A scope is a frame (target, resolver_id). The same code then serves every kind of target, and
all targets are answered by one grouped job.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resolvescope.functions.clean import pc
from resolvescope.operators.containment import IP_KEY, prefix_join, with_cover_flag
from resolvescope.operators.rows import distribution, page, one_row
from resolvescope.plans.resolver_reports import spoof_flags, with_coordinates

RISK_LEVEL = 10  # fixed value: minimisation counts above this are an amplification risk
ZERO = 0


def scope(t, kind: str) -> DataFrame:
    """Distinct (target, resolver_id) of one kind."""
    source = {
        "asn": lambda: t.resolver_asn.select(F.col("asn").alias("target"), "resolver_id"),
        "country": lambda: t.resolver_location.select(F.col("country").alias("target"), "resolver_id"),
        "prefix": lambda: t.resolver_prefix.select(F.col("prefix").alias("target"), "resolver_id"),
        "qmin": lambda: t.qmin_resolver.where(F.col("qmin").isin("yes", "no")).select(
            F.when(F.col("qmin") == "yes", "enabled").otherwise("disabled").alias("target"), "resolver_id"
        ),
        "global": lambda: t.resolver.select(F.lit("global").alias("target"), "resolver_id"),
    }
    return source[kind]().where(F.col("target").isNotNull()).distinct()


def risky(t, scope_df: DataFrame) -> DataFrame:
    """The part of a scope with high minimisation counts."""
    high = t.qmin_resolver.where(F.col("max_minimise_count") > RISK_LEVEL).select("resolver_id").distinct()
    return scope_df.join(high, "resolver_id", "left_semi").select("target", "resolver_id")


# ---- QNAME minimisation -----------------------------------------------------------------------


def qmin_by(t, kind: str) -> DataFrame:
    """Minimisation totals per target; targets without measurements stay with zeros."""
    rows = scope(t, kind).join(t.qmin_resolver.select("resolver_id", "qmin", "max_minimise_count", "last_update_ts",
                                                      F.lit(True).alias("_measured")), "resolver_id", "left")
    out = rows.groupBy("target").agg(
        F.count("_measured").alias("measured_count"),
        F.count_if(F.col("qmin") == "yes").alias("yes_count"),
        F.count_if(F.col("qmin") == "no").alias("no_count"),
        F.count_if(F.col("qmin") == "unstable").alias("unstable_count"),
        F.count_if(F.col("max_minimise_count") > RISK_LEVEL).alias("amplification_risk_count"),
        F.max("last_update_ts").alias("last_update_ts"),
    )
    whole = F.col("measured_count")
    return out.withColumns({
        "yes_pc": pc(F.col("yes_count"), whole),
        "no_pc": pc(F.col("no_count"), whole),
        "amplification_risk_pc": pc(F.col("amplification_risk_count"), whole),
    })


def qmin_distribution_by(t, kind: str, column: str = "max_minimise_count", top: int | None = 10) -> DataFrame:
    """Value shares per target, the ``top`` most frequent values each."""
    rows = scope(t, kind).join(t.qmin_resolver.select("resolver_id", column), "resolver_id")
    return distribution(rows, column, ["target"], top)


# ---- prefix pages -----------------------------------------------------------------------------


def prefix_totals(t, scope_df: DataFrame) -> DataFrame:
    """Per target: matched and unmapped identities and number of prefixes."""
    rows = scope_df.distinct().join(t.resolver_prefix.select("resolver_id", "prefix"), "resolver_id", "left")
    return rows.groupBy("target").agg(
        F.count_distinct("resolver_id").alias("matched_resolver_count"),
        F.count_distinct(F.when(F.col("prefix").isNotNull(), F.col("resolver_id"))).alias("_mapped"),
        F.count_distinct("prefix").alias("total_prefixes"),
    ).select("target", "matched_resolver_count",
             (F.col("matched_resolver_count") - F.col("_mapped")).alias("unmapped_resolver_count"), "total_prefixes")


def prefix_page(t, scope_df: DataFrame, number: int = 1, size: int = 25) -> DataFrame:
    """One page of (target, prefix, resolver_count), most populated prefixes first."""
    counted = (
        scope_df.distinct().join(t.resolver_prefix.select("resolver_id", "prefix"), "resolver_id")
        .groupBy("target", "prefix").agg(F.count_distinct("resolver_id").alias("resolver_count"))
    )
    return page(counted, [F.col("resolver_count").desc(), F.col("prefix")], number, size, by=["target"])


def prefixes_by(t, kind: str, number: int = 1, size: int = 25) -> DataFrame:
    return prefix_page(t, scope(t, kind), number, size)


def risk_prefixes_by(t, kind: str, number: int = 1, size: int = 25) -> DataFrame:
    return prefix_page(t, risky(t, scope(t, kind)), number, size)


# ---- spoofing ---------------------------------------------------------------------------------


def spoofing_by(t, kind: str) -> DataFrame:
    """Spoofing observations per ASN or country of the observed prefix."""
    flags = t.spoofing.select("prefix", "last_update_ts", *[c.alias(n) for n, c in spoof_flags().items()])
    owner = t.spoofing_asn if kind == "asn" else t.spoofing_country
    rows = owner.select(F.col(kind).alias("target"), "prefix").distinct().join(flags, "prefix")
    out = rows.groupBy("target").agg(
        F.count(F.lit(1)).alias("spoofing_prefix_count"),
        F.count_if("allow").alias("spoofing_allow_count"),
        F.count_if("blocked").alias("spoofing_blocked_count"),
        F.count_if("unknown").alias("spoofing_unknown_count"),
        F.max("last_update_ts").alias("spoofing_last_update_ts"),
    )
    return out.withColumn("spoofing_allow_pc", pc(F.col("spoofing_allow_count"), F.col("spoofing_prefix_count")))


def spoofable_prefixes(t) -> DataFrame:
    return t.spoofing.where(spoof_flags()["allow"])


def spoofable_asns(t) -> DataFrame:
    """ASNs with at least one prefix that lets spoofed packets out."""
    return t.spoofing_asn.join(spoofable_prefixes(t).select("prefix"), "prefix", "left_semi").select("asn").distinct()


def spoofable_resolvers(t) -> DataFrame:
    """Identities with an address inside a spoofable prefix."""
    return prefix_join(t.resolver.select("resolver_id", *IP_KEY), spoofable_prefixes(t), "left_semi").select("resolver_id").distinct()


def spoofing_countries(t) -> DataFrame:
    """Per country: identities in spoofable networks and the prefixes they announce."""
    return (
        spoofable_resolvers(t).join(t.resolver_location.select("resolver_id", "country"), "resolver_id")
        .join(t.resolver_prefix.select("resolver_id", "prefix"), "resolver_id", "left")
        .groupBy("country")
        .agg(F.count_distinct("resolver_id").alias("resolver_count"), F.count_distinct("prefix").alias("prefix_count"))
    )


def spoofing_asns(t) -> DataFrame:
    """Per spoofable ASN that holds resolvers: resolver rows and their prefixes."""
    return (
        t.resolver_asn.select("resolver_id", "asn").join(spoofable_asns(t), "asn", "left_semi")
        .join(t.resolver_prefix.select("resolver_id", "prefix"), "resolver_id", "left")
        .groupBy("asn")
        .agg(F.count("resolver_id").alias("resolver_count"), F.count_distinct("prefix").alias("prefix_count"))
    )


def entity_page(grouped: DataFrame, key: str, number: int = 1, size: int = 25) -> DataFrame:
    """A page of a grouped report with the totals over all groups on each row.

    An empty page still yields one row that carries the totals.
    """
    listed = page(grouped, [F.col("resolver_count").desc(), F.col(key)], number, size)
    rank = F.struct(-F.col("resolver_count"), F.col(key))
    rows = listed.agg(F.transform(F.array_sort(F.collect_list(F.struct(rank.alias("rank"), F.struct(*grouped.columns).alias("row")))), lambda x: x["row"]))  # one page
    totals = one_row(
        grouped.sparkSession,
        total_entities=grouped.agg(F.count(F.lit(1))),
        matched_resolver_count=grouped.agg(F.coalesce(F.sum("resolver_count"), F.lit(0)).cast("bigint")),
        rows=rows,
    )
    return totals.select("total_entities", "matched_resolver_count", F.explode_outer("rows").alias("row")).select("total_entities", "matched_resolver_count", "row.*")


def spoofing_prefixes_by(t, kind: str, number: int = 1, size: int = 25) -> DataFrame:
    """Prefix page of spoofable resolvers: by containment per country, by ASN match per ASN."""
    if kind == "country":
        rows = scope(t, "country").join(spoofable_resolvers(t), "resolver_id", "left_semi")
    else:
        rows = scope(t, "asn").join(spoofable_asns(t).withColumnRenamed("asn", "target"), "target", "left_semi")
    return prefix_page(t, rows.select("target", "resolver_id"), number, size)


# ---- anycast ----------------------------------------------------------------------------------


def asn_anycast_prefixes(t) -> DataFrame:
    """Distinct (target, prefix): the ASN announces the prefix or hosts one of its backends."""
    announced = t.anycast_asn.select(F.col("asn").alias("target"), "prefix")
    hosted = t.anycast_asn_backend.select(F.col("asn").alias("target"), "prefix")
    return announced.union(hosted).distinct()


def anycast_by_asn(t) -> DataFrame:
    known = t.anycast.select("prefix", "last_update_ts")
    return asn_anycast_prefixes(t).join(known, "prefix").groupBy("target").agg(
        F.count_distinct("prefix").alias("prefix_count"), F.max("last_update_ts").alias("last_update_ts")
    )


def anycast_by_country(t) -> DataFrame:
    rows = t.anycast_country_backend.join(t.anycast.select("prefix"), "prefix", "left_semi")
    return rows.groupBy(F.col("country").alias("target")).agg(
        F.count_distinct("prefix").alias("prefix_count"),
        F.sum("country_count").alias("site_count"),
        F.max("last_update_ts").alias("last_update_ts"),
    )


def anycast_sites_by(t, kind: str, part: str, targets: DataFrame | None = None) -> DataFrame:
    """Sites of a target's anycast prefixes split by ``part`` (country with coordinates, or asn).

    ``targets`` (column target) limits the listing, which otherwise holds every network or country of
    each prefix against every other.
    """
    asked = lambda df: df if targets is None else df.join(targets.select("target").distinct(), "target", "left_semi")
    if kind == "country" and part == "country":
        rows = asked(t.anycast_country_backend.withColumn("target", F.col("country"))).groupBy("target", "country").agg(
            F.sum("country_count").alias("count")
        )
        return with_coordinates(rows, t.country_location)
    prefixes = (
        asn_anycast_prefixes(t).join(t.anycast.select("prefix"), "prefix", "left_semi") if kind == "asn"
        else t.anycast_country_backend.select(F.col("country").alias("target"), "prefix").distinct()
    )
    prefixes = asked(prefixes)
    if part == "country":
        sites = t.anycast_country_backend.select("prefix", "country", "country_count")
        rows = prefixes.join(sites, "prefix").groupBy("target", "country").agg(F.sum("country_count").alias("count"))
        return with_coordinates(rows, t.country_location)
    sites = t.anycast_asn_backend.select("prefix", "asn", "asn_count")
    return prefixes.join(sites, "prefix").groupBy("target", "asn").agg(F.sum("asn_count").alias("count"))


# ---- counts -----------------------------------------------------------------------------------


def _resolver_part(t, kind: str) -> DataFrame:
    """Counts of address rows, so an identity with two addresses counts twice."""
    qmin = t.qmin_resolver.select("resolver_id", "qmin", F.lit(True).alias("_measured"))
    flagged = with_cover_flag(t.resolver.select("resolver_id", "is_public", *IP_KEY).distinct(), t.anycast, "_anycast")
    rows = scope(t, kind).join(flagged, "resolver_id").join(qmin, "resolver_id", "left")
    return rows.groupBy("target").agg(
        F.count(F.lit(1)).alias("resolver_count"),
        F.count_if("is_public").alias("public_resolver_count"),
        F.count_if(~F.col("is_public")).alias("closed_resolver_count"),
        F.count_if("_anycast").alias("anycast_resolver_count"),
        F.count("_measured").alias("qmin_measured_count"),
        F.count_if(F.col("qmin") == "yes").alias("qmin_yes_count"),
        F.count_if(F.col("qmin") == "no").alias("qmin_no_count"),
        F.count_if(F.col("qmin") == "unstable").alias("qmin_unstable_count"),
    )


def _forwarder_part(t, kind: str) -> DataFrame:
    owner = t.forwarder_asn if kind == "asn" else t.forwarder_location
    rows = (
        owner.select(F.col(kind).alias("target"), "forwarder_id")
        .join(t.forwarder.select("forwarder_id", "type").distinct(), "forwarder_id").distinct()
    )
    kind_of = F.lower("type")
    return rows.where(F.col("target").isNotNull()).groupBy("target").agg(
        F.count(F.lit(1)).alias("forwarder_count"),
        F.count_if(kind_of == "recursive").alias("recursive_forwarder_count"),
        F.count_if(kind_of == "transparent").alias("transparent_forwarder_count"),
    )


def _per_prefix(backend: DataFrame, count: str) -> DataFrame:
    return backend.groupBy("prefix").agg(F.sum(count).alias("_sites"))


def _country_anycast_part(t) -> DataFrame:
    backend = t.anycast_country_backend.select(F.col("country").alias("target"), "prefix", "country_count")
    own = backend.groupBy("target").agg(
        F.count_distinct("prefix").alias("anycast_prefix_count"), F.sum("country_count").alias("anycast_country_instance_count")
    )
    other = backend.select("target", "prefix").distinct().join(_per_prefix(t.anycast_asn_backend, "asn_count"), "prefix").groupBy(
        "target"
    ).agg(F.sum("_sites").alias("anycast_asn_instance_count"))
    return own.join(other, "target", "left")


def _asn_anycast_part(t) -> DataFrame:
    pairs = asn_anycast_prefixes(t).join(_per_prefix(t.anycast_country_backend, "country_count"), "prefix", "left")
    own = t.anycast_asn_backend.groupBy(F.col("asn").alias("target")).agg(F.sum("asn_count").alias("anycast_asn_instance_count"))
    spread = pairs.groupBy("target").agg(
        F.count("prefix").alias("anycast_prefix_count"),
        F.coalesce(F.sum("_sites"), F.lit(0).cast("bigint")).alias("anycast_country_instance_count"),
    )
    return spread.join(own, "target", "left")


def _combine(parts: list[DataFrame]) -> DataFrame:
    """Merge per-target parts: one union and one grouping instead of a chain of outer joins."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    merged = stacked.groupBy("target").agg(*[F.max(c).alias(c) for c in stacked.columns if c != "target"])
    counts = [c for c in merged.columns if c.endswith("_count")]
    return merged.fillna(ZERO, counts)


def _with_shares(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "anycast_resolver_pc": pc(F.col("anycast_resolver_count"), F.col("resolver_count")),
        "qmin_yes_pc": pc(F.col("qmin_yes_count"), F.col("qmin_measured_count")),
        "qmin_no_pc": pc(F.col("qmin_no_count"), F.col("qmin_measured_count")),
        "spoofing_allow_pc": pc(F.col("spoofing_allow_count"), F.col("spoofing_prefix_count")),
    })


def country_counts(t) -> DataFrame:
    """All counters of every country that occurs in any relation."""
    dnssec = t.dnssec_country.select(
        F.col("country").alias("target"), F.col("validating_pc").alias("dnssec_validating_pc"),
        F.col("partial_validating_pc").alias("dnssec_partial_validating_pc"),
        F.col("last_update_ts").alias("dnssec_last_update_ts"),
    )
    parts = [_resolver_part(t, "country"), _forwarder_part(t, "country"), _country_anycast_part(t),
             spoofing_by(t, "country").drop("spoofing_allow_pc"), dnssec]
    return _with_shares(_combine(parts))


def asn_counts(t) -> DataFrame:
    """All counters of every ASN; the backend instance sum is the ASN's own."""
    parts = [_resolver_part(t, "asn"), _forwarder_part(t, "asn"), _asn_anycast_part(t),
             spoofing_by(t, "asn").drop("spoofing_allow_pc")]
    return _with_shares(_combine(parts))


def prefix_counts(t) -> DataFrame:
    """Per announced prefix: distinct identities, public, closed, anycast-covered."""
    flagged = with_cover_flag(t.resolver.select("resolver_id", "is_public", *IP_KEY), t.anycast, "_anycast")
    # one row per identity and target first: the flags then need no distinct counts
    one = scope(t, "prefix").join(flagged, "resolver_id").groupBy("target", "resolver_id").agg(
        F.bool_or("is_public").alias("_public"), F.bool_or(~F.col("is_public")).alias("_closed"), F.bool_or("_anycast").alias("_anycast")
    )
    return one.groupBy("target").agg(
        F.count(F.lit(1)).alias("resolver_count"),
        F.count_if("_public").alias("public_resolver_count"),
        F.count_if("_closed").alias("closed_resolver_count"),
        F.count_if("_anycast").alias("anycast_resolver_count"),
    )


def dnssec_by_country(t) -> DataFrame:
    return t.dnssec_country.select(
        "country", F.col("validating_pc").alias("dnssec_validating_pc"),
        F.col("partial_validating_pc").alias("dnssec_partial_validating_pc"), F.col("last_update_ts").alias("dnssec_last_update_ts"),
    )


def target_response(t, kind: str, targets: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Records of a target together with its counters (prefix, asn or country)."""
    from resolvescope.plans.resolver_reports import records_by

    counts = {"prefix": prefix_counts, "asn": asn_counts, "country": country_counts}[kind](t)
    return records_by(t, kind, targets, limit).join(counts, "target", "left")
