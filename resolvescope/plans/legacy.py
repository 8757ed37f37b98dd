"""Loads of the older wide layouts: identity linking, anycast site rows, wide upserts.

The older loaders went row by row; here a batch is linked as a whole, so the outcome does not
depend on row order.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from resolvescope.functions.clean import array_to_text, clean_domain, clean_text
from resolvescope.functions.net import with_ip_key
from resolvescope.operators.components import connected_components
from resolvescope.operators.merge import MergeResult, assign_ids, cur, merge, new
from resolvescope.operators.rows import latest_by
from resolvescope.session import materialise


def first_known(df: DataFrame, names: Sequence[str]) -> Column:
    """First non-empty of several synonym columns that exist."""
    present = [n for n in names if n in df.columns]
    texts = [F.when(F.col(n).cast("string") != "", F.col(n)) for n in present]
    return F.coalesce(*texts) if texts else F.lit(None).cast("string")


# ---- identity linking ---------------------------------------------------------------------------


def identity_keys(rows: DataFrame) -> DataFrame:
    """Rows with the name, operator and domain used for linking."""
    domain = clean_domain(first_known(rows, ["resolver_domain", "domain"]))
    name = F.coalesce(*[clean_text(F.col(n)) for n in ("resolver_name", "identity_name", "name") if n in rows.columns], domain)
    operator = clean_text(first_known(rows, ["resolver_operator", "operator"]))
    return rows.withColumns({"_domain": domain, "_name": name, "_operator": operator})


def link_identities(rows: DataFrame, identities: DataFrame, domains: DataFrame, cut: Callable[[DataFrame], DataFrame] = materialise) -> dict[str, DataFrame]:
    """Give rows a ``resolver_identity_id``: kept if set, else by domain, else by name and operator, else
    that of the rows they hang together with.

    Rows found in none of the tables are joined by what they share: a domain, or a name with its operator.
    Whatever chain connects them, they are one identity, in any order of the rows. It is the smallest
    known identity that another row of the batch ties to one of their domains (or that takes its name
    from the batch), else a new one. Only links between evidence are walked, never rows.

    ``identities`` has id, name, operator, source; ``domains`` has resolver_identity_id, domain,
    source, last_observation_ts. Rows with neither name, operator nor domain stay unlinked.
    """
    keyed = identity_keys(rows)
    if "resolver_identity_id" not in rows.columns:
        keyed = keyed.withColumn("resolver_identity_id", F.lit(None).cast("bigint"))
    by_domain = domains.groupBy(F.lower("domain").alias("_domain")).agg(F.min("resolver_identity_id").alias("_by_domain"))
    named = identities.where(F.col("name").isNotNull()).groupBy(
        F.lower("name").alias("_lname"), F.coalesce(F.lower("operator"), F.lit("")).alias("_loperator")
    ).agg(F.min("id").alias("_by_name"))
    keyed = keyed.withColumns({"_lname": F.lower("_name"), "_loperator": F.coalesce(F.lower("_operator"), F.lit(""))})
    linked = keyed.join(by_domain, "_domain", "left").join(named, ["_lname", "_loperator"], "left")
    by_domain_node = F.concat(F.lit("d:"), F.col("_domain"))
    by_name_node = F.when(F.col("_name").isNotNull() | F.col("_operator").isNotNull(), _name_node("_lname", "_loperator"))
    linked = linked.withColumns({"_known": F.coalesce("resolver_identity_id", "_by_domain", "_by_name"), "_of_domain": by_domain_node, "_of_name": by_name_node})
    linked = cut(linked.withColumn("_source", clean_text(F.col("source"))))
    columns = [F.min("_name").alias("name"), F.min("_operator").alias("operator"), F.min("_source").alias("source")]
    seen = linked.where(F.col("_known").isNotNull()).groupBy(F.col("_known").alias("id")).agg(*columns)

    open_rows = linked.where(F.col("_known").isNull() & F.coalesce("_of_domain", "_of_name").isNotNull())
    evidence = cut(open_rows.groupBy("_of_domain", "_of_name").agg(*columns))
    groups = evidence_groups(evidence, known_evidence(linked, identities, seen), cut)
    fresh = evidence.withColumn("node", F.coalesce("_of_domain", "_of_name")).join(groups.where(F.col("known").isNull()), "node").groupBy("group").agg(
        *[F.min(n).alias(n) for n in ("name", "operator", "source")])
    highest = identities.agg(F.max("id")).scalar()
    fresh = cut(assign_ids(fresh, highest, F.pmod(F.xxhash64("group"), F.lit(4096)), [F.col("group")], "id"))
    found = groups.join(fresh.select("group", F.col("id").alias("_fresh")), "group", "left").select(F.col("node").alias("_node"), F.coalesce("known", "_fresh").alias("_found"))
    # A row goes by its domain if it has one: its name hangs together with that.
    linked = linked.withColumn("_node", F.when(F.col("_known").isNull(), F.coalesce("_of_domain", "_of_name"))).join(found, "_node", "left")
    linked = linked.withColumn("resolver_identity_id", F.coalesce("_known", "_found"))
    tied = groups.where(F.col("known").isNotNull())
    joined = evidence.withColumn("node", F.coalesce("_of_domain", "_of_name")).join(tied, "node").select(F.col("known").alias("id"), "name", "operator", "source")
    batch = seen.unionByName(joined).groupBy("id").agg(*[F.min(n).alias(n) for n in ("name", "operator", "source")]).unionByName(fresh.select("id", "name", "operator", "source"))
    fill = {c: F.coalesce(cur(c), new(c)) for c in ("name", "operator", "source")}
    pairs = linked.where(F.col("_domain").isNotNull() & F.col("resolver_identity_id").isNotNull())
    stamp = F.max("last_observation_ts") if "last_observation_ts" in rows.columns else F.lit(None).cast("timestamp")
    new_domains = pairs.groupBy("resolver_identity_id", F.col("_domain").alias("domain")).agg(
        F.min("_source").alias("source"), stamp.alias("last_observation_ts")
    )
    lowered = domains.withColumn("domain", F.lower("domain"))
    domain_merge = merge(
        lowered, new_domains, ["resolver_identity_id", "domain"], F.lit(True),
        {"source": F.coalesce(new("source"), cur("source")), "last_observation_ts": F.greatest(cur("last_observation_ts"), new("last_observation_ts"))},
    )
    kept = [*rows.columns, *([] if "resolver_identity_id" in rows.columns else ["resolver_identity_id"])]
    return {
        "rows": linked.select(*kept),
        "identities": merge(identities, batch, ["id"], F.lit(True), fill).table,
        "domains": domain_merge.table,
    }


def _name_node(name: str, operator: str) -> Column:
    """Evidence by name and operator; the length keeps them apart."""
    known = F.coalesce(F.col(name), F.lit(""))
    return F.concat(F.lit("n:"), F.length(known).cast("string"), F.lit(":"), known, F.col(operator))


def known_evidence(linked: DataFrame, identities: DataFrame, seen: DataFrame) -> DataFrame:
    """(node, id): evidence that the batch itself ties to known identities. The domains of their rows, and
    the name that an identity without one takes from the batch; a name it does not take ties nothing."""
    domains = linked.where(F.col("_known").isNotNull() & F.col("_of_domain").isNotNull()).select(F.col("_of_domain").alias("node"), F.col("_known").alias("id"))
    named = identities.where(F.col("name").isNull()).select("id", F.col("operator").alias("_own")).join(seen.where(F.col("name").isNotNull()), "id")
    taken = named.select("id", F.lower("name").alias("_n"), F.coalesce(F.lower(F.coalesce("_own", "operator")), F.lit("")).alias("_o"))
    both = domains.unionByName(taken.select(_name_node("_n", "_o").alias("node"), "id"))
    return both.groupBy("node").agg(F.min("id").alias("id"))


def evidence_groups(evidence: DataFrame, ties: DataFrame, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, group, known): the component of every piece of evidence, and the smallest known identity tied to it."""
    nodes = evidence.select(F.explode(F.array("_of_domain", "_of_name")).alias("node")).where(F.col("node").isNotNull()).distinct()
    found = connected_components(evidence, "_of_domain", "_of_name", cut)
    grouped = nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("group"))
    known = grouped.join(ties, "node").groupBy("group").agg(F.min("id").alias("known"))
    return cut(grouped.join(known, "group", "left").select("node", "group", "known"))


# ---- anycast site rows ------------------------------------------------------------------------------

# Synonym columns of site rows, first known one wins.
SITE_COLUMNS = {
    "resolver_ip": ["replying_ip", "resolver_ipv4", "resolver_ip", "ipv4"],
    "site_prefix": ["backend_resolver_prefix", "prefix", "bgp_prefix"],
    "ipv4": ["backend_resolver", "site_ipv4", "ipv4"],
    "ipv6": ["site_ipv6", "ipv6"],
    "asn": ["backend_resolver_asn", "asn", "ASN"],
    "org": ["backend_resolver_org", "org", "organization"],
    "org_short": ["org_short", "org_short_name"],
    "country": ["backend_resolver_country", "country", "country_code"],
    "city": ["city"],
    "latitude": ["latitude", "lat"],
    "longitude": ["longitude", "lon", "lng"],
    "last_observation_ts": ["last_observation_ts", "timestamp_request", "last_seen"],
}
SITE_VALUES = [
    "ipv4", "ipv6", "netmask", "asn", "bgp_prefix", "org", "org_short", "country", "city", "latitude", "longitude", "source",
]


SITE_BUCKETS = 256


def site_rows(df: DataFrame, resolver: DataFrame, source: str, now: Column | None = None) -> DataFrame:
    """Site rows of known resolvers with synonym columns resolved."""
    pick = {name: first_known(df, names).alias(name) for name, names in SITE_COLUMNS.items()}
    own = lambda n: first_known(df, [n])
    rows = df.select(*pick.values(), own("netmask").alias("_mask"), own("bgp_prefix").alias("_bgp"), own("instance_id").cast("bigint").alias("instance_id"), own("source").alias("_source"))
    slash = F.col("site_prefix").contains("/")
    part = lambda n: F.nullif(F.substring_index("site_prefix", "/", n), F.lit(""))
    rows = rows.withColumns({
        "resolver_ip": clean_text(F.col("resolver_ip")),
        "netmask": F.coalesce(F.col("_mask").cast("string"), F.when(slash, part(-1))),
        "bgp_prefix": F.coalesce("_bgp", part(1)),
        "source": F.coalesce("_source", F.lit(source)),
        "ipv4": clean_text(F.col("ipv4")), "ipv6": clean_text(F.col("ipv6")),
        "latitude": F.col("latitude").cast("double"), "longitude": F.col("longitude").cast("double"), "asn": F.col("asn").cast("bigint"),
        "last_observation_ts": F.coalesce(F.col("last_observation_ts").cast("timestamp"), F.current_timestamp() if now is None else now),
    })
    ids = resolver.select(F.col("ip").alias("resolver_ip"), "resolver_id")
    return rows.join(ids, "resolver_ip").select("resolver_id", "instance_id", *SITE_VALUES, "last_observation_ts")


def anycast_sites(rows: DataFrame, current: DataFrame) -> MergeResult:
    """Sites known by their IPv4 (else IPv6) address are updated without losing values; others get
    the next instance numbers of their resolver."""
    site = ["resolver_id", "instance_id"]
    key = lambda c: current.where(F.col(c).isNotNull()).groupBy(F.col(c)).agg(F.max(F.struct(*site)).alias(f"_{c}"))
    known = rows.join(key("ipv4"), "ipv4", "left").join(key("ipv6"), "ipv6", "left").withColumn("_site", F.coalesce("_ipv4", "_ipv6"))
    matched = known.where(F.col("_site").isNotNull()).withColumns({n: F.col(f"_site.{n}") for n in site})
    fresh = known.where(F.col("_site").isNull())
    highest = current.groupBy("resolver_id").agg(F.max("instance_id").alias("_max"))
    # A resolver with very many new sites is numbered in buckets, each after the ones before it.
    seen = ["ipv4", "ipv6", "country", "city", "asn", "last_observation_ts"]
    fresh = fresh.withColumn("_bucket", F.pmod(F.xxhash64(*seen), F.lit(SITE_BUCKETS)))
    counted = fresh.where("instance_id is null").groupBy("resolver_id", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("resolver_id").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    inside = Window.partitionBy("resolver_id", "_bucket", F.col("instance_id").isNull()).orderBy(*seen)
    number = F.coalesce("_max", F.lit(0)) + F.col("_before") + F.row_number().over(inside)
    fresh = fresh.join(highest, "resolver_id", "left").join(counted, ["resolver_id", "_bucket"], "left").withColumn("instance_id", F.coalesce("instance_id", number))
    columns = [*site, *SITE_VALUES, "last_observation_ts"]
    batch = latest_by(matched.select(*columns).unionByName(fresh.select(*columns)), site, [F.col("last_observation_ts").desc_nulls_last()])
    update = {c: F.coalesce(new(c), cur(c)) for c in SITE_VALUES}
    update["last_observation_ts"] = F.greatest(cur("last_observation_ts"), new("last_observation_ts"))
    return merge(current, batch, site, F.lit(True), update)


# ---- wide upsert ---------------------------------------------------------------------------------------


def wide_rows(df: DataFrame, columns: Sequence[str], required: Sequence[str] = ("ip",), v6: bool = True) -> DataFrame:
    """Wide rows by synonym address columns; list protocols become text, incomplete rows drop."""
    rows = df.withColumn("_address", first_known(df, ["ip", "ipv4", "ipv6"]))
    protocols = "supported_protocols"
    if protocols in df.columns and df.schema[protocols].dataType.typeName() == "array":
        rows = rows.withColumn(protocols, array_to_text(F.col(protocols)))
    rows = with_ip_key(rows, "_address", out="_ip", v6=v6).withColumn("ip", F.col("_ip"))
    for name in required:
        rows = rows.where(F.col(name).isNotNull())
    present = [c if c in rows.columns else F.lit(None).cast("string").alias(c) for c in columns]
    return rows.select("ip", *[c for c in present if c != "ip"])


def merge_wide(current: DataFrame, batch: DataFrame, ts: str = "last_observation_ts") -> MergeResult:
    """Null-preserving upsert by address with the later of the two stamps.

    Several batch rows of one address fold into one, newest known value first.
    """
    values = [c for c in batch.columns if c not in ("ip", ts)]
    newest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(F.coalesce(F.col(ts), F.lit("0001-01-01").cast("timestamp")), F.col(c))))
    folded = batch.groupBy("ip").agg(*[newest(c).alias(c) for c in values], F.max(ts).alias(ts))
    update = {c: F.coalesce(new(c), cur(c)) for c in values}
    update[ts] = F.greatest(cur(ts), new(ts))
    return merge(current, folded, ["ip"], F.lit(True), update)
