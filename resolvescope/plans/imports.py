"""Import jobs: cleaning of landed rows and the merge policies of every relation.

Each ``merge_*`` takes current tables and a cleaned batch and returns the next tables with a
report. ``force`` takes the batch even when it is older. "newer" means the batch stamp is known
and later. Where the policy lets an older batch change a value, that is intended.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resolvescope.functions import clean
from resolvescope.functions.countries import clean_country
from resolvescope.functions.net import address_order, canonical_prefix, with_ip_key
from resolvescope.operators.containment import IP_KEY
from resolvescope.operators.merge import (
    MergeResult,
    Part,
    any_of,
    assign_ids,
    cur,
    differs,
    ip_bucket,
    merge,
    new,
    newer,
    stack_reports,
    stamp_now,
)
from resolvescope.operators.rows import latest_by, newest_first
from resolvescope.session import materialise
from resolvescope.sources.mapping import FileKind
from resolvescope.sources.registry import check_and_touch_sources, fill_country_locations

Cut = Callable[[DataFrame], DataFrame]
ATTRIBUTES = ("asn", "prefix", "dohpath", "endpoint", "org", "domain")


class ImportResult:
    """Outcome of an import: the next version of each table and one report per module.

    Steps are described on first use, so asking for one table or for the reports alone (a dry
    run) plans only that.
    """

    def __init__(self):
        self._steps: dict[str, Callable[[], MergeResult]] = {}
        self._tables: dict[str, str] = {}
        self._done: dict[str, MergeResult] = {}
        self.input: DataFrame | None = None

    def add(self, module: str, table: str, step: Callable[[], MergeResult]) -> None:
        self._steps[module] = step
        self._tables[table] = module

    def result(self, module: str) -> MergeResult:
        if module not in self._done:
            self._done[module] = self._steps[module]()
        return self._done[module]

    @property
    def table_names(self) -> list[str]:
        return list(self._tables)

    def table(self, name: str) -> DataFrame:
        return self.result(self._tables[name]).table

    def of_table(self, name: str) -> MergeResult:
        return self.result(self._tables[name])

    def part(self, name: str) -> Part | None:
        """The touched buckets of a table stored in buckets; None where the whole table is written."""
        return self.result(self._tables[name]).part

    def report(self, *modules: str) -> DataFrame:
        """One row per module (all of them by default)."""
        names = modules or (*self._steps, *(["input"] if self.input is not None else []))
        return stack_reports({n: self.input if n == "input" else self.result(n).report for n in names})


# ---- row preparation ---------------------------------------------------------------------------


def _pick(df: DataFrame, name: str, build, default: Column) -> Column:
    return build(F.col(name)) if name in df.columns else default


def _address_rows(df: DataFrame, columns: dict[str, Column], iso: DataFrame | None, v6: bool) -> DataFrame:
    rows = with_ip_key(df, "ip", v6=v6).select("ip", *IP_KEY, *[c.alias(n) for n, c in columns.items()])
    if "prefix" in columns:
        rows = canonical_prefix(rows, "prefix", v6=v6)
    if "country" in columns and iso is not None:
        rows = clean_country(rows, "country", iso)
    return rows.where(F.col("ip").isNotNull())


def invalid_addresses(df: DataFrame, v6: bool = True) -> DataFrame:
    """(rows, invalid_ip) of a mapped frame."""
    keyed = with_ip_key(df, "ip", out="_ip", v6=v6)
    return keyed.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("_ip").isNull()).alias("invalid_ip"))


def resolver_rows(
    df: DataFrame, source: str, verified: bool = False, iso: DataFrame | None = None, now: Column | None = None, v6: bool = True
) -> DataFrame:
    """Cleaned resolver rows of a mapped frame; rows without a valid address are dropped."""
    text = lambda n: _pick(df, n, clean.clean_text, F.lit(None).cast("string"))
    columns = {
        "is_public": _pick(df, "is_public", clean.clean_bool, F.lit(False)),
        "source": F.coalesce(text("source"), F.lit(source)),
        "last_update_ts": _pick(df, "last_update_ts", clean.clean_ts, clean.import_day(now)),
        "verified": _pick(df, "verified", clean.clean_bool, F.lit(verified)),
        "asn": _pick(df, "asn", clean.clean_asn, F.lit(None).cast("bigint")),
        "prefix": text("prefix"),
        "country": text("country"),
        **{n: text(n) for n in ("city", "protocol", "dohpath", "org", "domain")},
        "port": _pick(df, "port", clean.clean_port, F.lit(53)),
    }
    return _address_rows(df, columns, iso, v6)


def forwarder_rows(
    df: DataFrame, source: str, iso: DataFrame | None = None, now: Column | None = None, v6: bool = True
) -> DataFrame:
    """Cleaned forwarder rows; ``upstream_ip`` gets its own key columns."""
    text = lambda n: _pick(df, n, clean.clean_text, F.lit(None).cast("string"))
    columns = {
        "is_public": _pick(df, "is_public", clean.clean_bool, F.lit(False)),
        "source": F.coalesce(text("source"), F.lit(source)),
        "last_update_ts": _pick(df, "last_update_ts", clean.clean_ts, stamp_now(now)),
        "type": _pick(df, "type", clean.clean_forwarder_type, F.lit("recursive")),
        "asn": _pick(df, "asn", clean.clean_asn, F.lit(None).cast("bigint")),
        "prefix": text("prefix"),
        "country": text("country"),
        **{n: text(n) for n in ("city", "protocol", "endpoint", "org", "domain", "upstream_ip")},
    }
    rows = _address_rows(df, columns, iso, v6)
    return with_ip_key(rows, "upstream_ip", out="upstream_ip", v6=v6)


def qmin_rows(df: DataFrame, source: str, now: Column | None = None, v6: bool = True) -> DataFrame:
    """Cleaned minimisation rows keyed by resolver address."""
    columns = {
        "qmin": clean.clean_qmin(F.col("qmin")),
        "max_minimise_count": _pick(df, "max_minimise_count", clean.clean_int, F.lit(None).cast("bigint")),
        "minimize_one_lab": _pick(df, "minimize_one_lab", clean.clean_int, F.lit(None).cast("bigint")),
        "last_update_ts": F.coalesce(_pick(df, "last_update_ts", clean.clean_ts, F.lit(None).cast("timestamp")), clean.import_day(now)),
        "source": F.coalesce(_pick(df, "source", clean.clean_text, F.lit(None).cast("string")), F.lit(source)),
    }
    return _address_rows(df.withColumnRenamed("resolver_ip", "ip"), columns, None, v6)


# ---- resolver: rows, identities, verification ----------------------------------------------------


def unique_rows(stage: DataFrame) -> DataFrame:
    """Newest row per address, ties by source and then by the remaining columns."""
    return latest_by(stage, IP_KEY, newest_first("last_update_ts", "source"))


def highest_id(table: DataFrame, name: str = "id") -> Column:
    return table.agg(F.max(name)).scalar()


def number_rows(unique: DataFrame, current: DataFrame, identity: DataFrame, id_name: str) -> DataFrame:
    """Batch rows with the identity of their address: the known one, or a fresh one in address
    order; ``_fresh`` tells which."""
    joined = unique.join(current.select(*IP_KEY, F.col(id_name).alias("_known")), IP_KEY, "left")
    joined = joined.withColumn("_fresh", F.col("_known").isNull())
    # Both tables count: one may be ahead of the other after an interrupted load.
    highest = F.greatest(highest_id(identity), highest_id(current, id_name))
    numbered = assign_ids(joined, highest, ip_bucket(), address_order(), id_name, only=F.col("_fresh"))
    return numbered.withColumn(id_name, F.coalesce("_known", id_name)).drop("_known")


def merge_resolver(resolver: DataFrame, numbered: DataFrame, force: bool = False, now: Column | None = None) -> MergeResult:
    """Update when forced or newer; public once seen public; batch source wins."""
    stamped = F.coalesce(new("last_update_ts"), stamp_now(now))
    public = new("is_public") if force else cur("is_public") | new("is_public")
    existing = F.count_if(F.col("cur").isNotNull() & F.col("new").isNotNull())
    return merge(
        resolver, numbered.select(*[c for c in resolver.columns]), IP_KEY,
        update_when=any_of(force, newer()),
        update={"is_public": public, "last_update_ts": stamped, "source": new("source")},
        insert={"last_update_ts": stamped},
        report={"existing": existing, "growth": F.count_if(F.col("change") == "inserted")},
    )


def merge_resolver_identity(identity: DataFrame, numbered: DataFrame, force: bool = False, now: Column | None = None) -> MergeResult:
    """Verified once seen verified (force: the batch value); stamp to newer; measurement counters
    start at one when verified. Addresses of one identity are combined first."""
    order = F.struct(F.coalesce(F.col("last_update_ts"), F.lit("0001-01-01").cast("timestamp")), F.col("ip"))
    batch = numbered.groupBy(F.col("resolver_id").alias("id")).agg(
        F.max("last_update_ts").alias("last_update_ts"),
        F.bool_or("verified").alias("any_verified"),
        F.max_by("verified", order).alias("last_verified"),
    )
    seen = new("last_verified") if force else new("any_verified")
    first = lambda name: F.when(seen & (cur(name) == 0), 1).otherwise(cur(name))
    stamp = (
        F.coalesce(new("last_update_ts"), cur("last_update_ts")) if force
        else F.when(newer(), new("last_update_ts")).otherwise(cur("last_update_ts"))
    )
    start = F.when(new("any_verified"), 1).otherwise(0)
    changes = (cur("verified") != seen) if force else (seen & ~cur("verified"))
    return merge(
        identity, batch, ["id"],
        update_when=any_of(force, newer(), seen & ~cur("verified")),
        update={
            "last_update_ts": stamp,
            "verified": seen if force else cur("verified") | seen,
            "total_measurements": first("total_measurements"),
            "seen_measurements": first("seen_measurements"),
        },
        insert={
            "last_update_ts": F.coalesce(new("last_update_ts"), stamp_now(now)),
            "verified": new("any_verified"),
            "total_measurements": start,
            "seen_measurements": start,
        },
        report={"verified_updates": F.count_if(F.col("cur").isNotNull() & F.col("new").isNotNull() & changes)},
    )


def merge_verification(verification: DataFrame, numbered: DataFrame) -> MergeResult:
    """Add (identity, source) of verified rows with a source; known pairs stay."""
    batch = numbered.where(F.col("verified") & (F.trim("source") != "")).select(
        "resolver_id", F.col("source").alias("verifying_source")
    ).distinct()
    return merge(verification, batch, ["resolver_id", "verifying_source"], F.lit(False), {})


# ---- one-value attributes, sets -------------------------------------------------------------------


def merge_attribute(
    current: DataFrame, rows: DataFrame, columns: list[str], key: str = "resolver_id", force: bool = False, now: Column | None = None
) -> MergeResult:
    """Value columns of an identity. A different value is taken even from an older batch; the
    stamp moves when forced, newer or different."""
    batch = latest_by(
        rows.where(F.col(key).isNotNull() & F.col(columns[0]).isNotNull()).select(key, *columns, "last_update_ts"), [key]
    )
    changed = any_of(*[differs(c) for c in columns])
    stamped = F.coalesce(new("last_update_ts"), stamp_now(now))
    return merge(
        current, batch, [key],
        update_when=any_of(force, changed, newer()),
        update={
            **{c: new(c) for c in columns},
            "last_update_ts": F.when(any_of(force, newer(), changed), stamped).otherwise(cur("last_update_ts")),
        },
        insert={"last_update_ts": stamped},
    )


def _skipped_of(result: MergeResult, rows: DataFrame) -> MergeResult:
    """Count as skipped every staged identity that was neither inserted nor updated."""
    total = rows.agg(F.count(F.lit(1))).scalar()
    skipped = F.greatest(total - F.col("inserted") - F.col("updated"), F.lit(0))
    return result.with_report(result.report.withColumn("skipped", skipped))


def merge_location(current: DataFrame, rows: DataFrame, key: str = "resolver_id", force: bool = False, now: Column | None = None) -> MergeResult:
    return merge_attribute(current, rows, ["country", "city"], key, force, now)


def _merge_set(current: DataFrame, batch: DataFrame, keys: list[str], force: bool, now: Column | None) -> MergeResult:
    """Set members: insert new ones, move the stamp when forced or newer."""
    stamped = F.coalesce(new("last_update_ts"), stamp_now(now))
    return merge(
        current, batch, keys, any_of(force, newer()), {"last_update_ts": stamped}, {"last_update_ts": stamped}
    )


def _newest_members(rows: DataFrame, keys: list[str]) -> DataFrame:
    # max() of a stamp ignores nulls, which is "newest first, nulls last" for a set member
    return rows.groupBy(*keys).agg(F.max("last_update_ts").alias("last_update_ts"))


def merge_service(current: DataFrame, rows: DataFrame, force: bool = False, now: Column | None = None) -> MergeResult:
    """Services of an identity from comma protocol text and a port."""
    named = rows.where(F.col("resolver_id").isNotNull() & F.col("protocol").isNotNull())
    split = clean.explode_protocols(named, "protocol").where(F.col("port").between(1, 65535))
    keys = ["resolver_id", "protocol", "port"]
    return _merge_set(current, _newest_members(split, keys), keys, force, now)


def merge_forwarder_protocol(current: DataFrame, rows: DataFrame, force: bool = False, now: Column | None = None) -> MergeResult:
    named = rows.where(F.col("forwarder_id").isNotNull() & F.col("protocol").isNotNull())
    keys = ["forwarder_id", "protocol"]
    return _merge_set(current, _newest_members(clean.explode_protocols(named, "protocol", rename=False), keys), keys, force, now)


# ---- forwarders ------------------------------------------------------------------------------------


def merge_forwarder(forwarder: DataFrame, numbered: DataFrame, force: bool = False, now: Column | None = None) -> MergeResult:
    """Every matched row takes the batch's public flag, type and source; counters and
    observation stamps move only when newer."""
    stamped = F.coalesce(new("last_update_ts"), stamp_now(now))
    plus = lambda kind: F.when((new("type") == kind) & newer(), 1).otherwise(0)
    seen = lambda kind: F.when(new("type") == kind, 1).otherwise(0)

    def observed(kind: str) -> Column:
        return F.when((new("type") == kind) & newer(), new("last_update_ts")).otherwise(cur(f"last_observed_as_{kind}"))

    existing = F.col("cur").isNotNull() & F.col("new").isNotNull()
    kinds = ("transparent", "recursive")
    return merge(
        forwarder, numbered, IP_KEY,
        update_when=F.lit(True),
        update={
            "is_public": new("is_public"), "type": new("type"), "source": new("source"),
            **{f"{k}_count": F.coalesce(cur(f"{k}_count"), F.lit(0)) + plus(k) for k in kinds},
            **{f"last_observed_as_{k}": observed(k) for k in kinds},
            "last_update_ts": F.when(any_of(force, newer()), stamped).otherwise(cur("last_update_ts")),
        },
        insert={
            "last_update_ts": stamped,
            **{f"{k}_count": seen(k) for k in kinds},
            **{f"last_observed_as_{k}": F.when(new("type") == k, stamped) for k in kinds},
        },
        report={
            "changed_existing": F.count_if(existing & any_of(force, differs("type"), newer())),
            "growth": F.count_if(F.col("change") == "inserted"),
        },
    )


def classify_upstreams(stage: DataFrame, numbered: DataFrame, resolver: DataFrame, forwarder: DataFrame) -> DataFrame:
    """Newest stamp per (forwarder, upstream address) with what the upstream is: a known resolver,
    otherwise a known or new forwarder other than itself (both ids null: unknown)."""
    ids = numbered.select(*IP_KEY, "forwarder_id")
    up = ["upstream_ip_family", "upstream_ip_hi", "upstream_ip_lo"]
    rows = (
        stage.where(F.col("upstream_ip").isNotNull()).join(ids, IP_KEY)
        .groupBy("forwarder_id", "upstream_ip", *up).agg(F.max("last_update_ts").alias("last_update_ts"))
    )
    named = lambda df, col, out: df.select(*[F.col(k).alias(u) for k, u in zip(IP_KEY, up)], F.col(col).alias(out))
    # fresh batch forwarders are not in the current table, so the two lists never overlap
    forwarders = named(forwarder, "forwarder_id", "_forwarder").union(
        named(numbered.join(forwarder.select(*IP_KEY), IP_KEY, "left_anti"), "forwarder_id", "_forwarder")
    )
    joined = rows.join(named(resolver, "resolver_id", "upstream_resolver_id"), up, "left").join(forwarders, up, "left")
    other = F.col("upstream_resolver_id").isNull() & (F.col("_forwarder") != F.col("forwarder_id"))
    return joined.withColumn("upstream_forwarder_id", F.when(other, F.col("_forwarder"))).drop("_forwarder")


def merge_upstreams(
    current: DataFrame, upstreams: DataFrame, column: str, force: bool = False, now: Column | None = None
) -> MergeResult:
    """Edges to resolvers (``upstream_resolver_id``) or to forwarders (``upstream_forwarder_id``)."""
    keys = ["forwarder_id", column]
    return _merge_set(current, _newest_members(upstreams.where(F.col(column).isNotNull()), keys), keys, force, now)


# ---- anycast ---------------------------------------------------------------------------------------


def with_metadata(rows: DataFrame, source: str, now: Column | None = None) -> DataFrame:
    """Stamp and source defaults of census batches."""
    ts = F.coalesce("last_update_ts", stamp_now(now)) if "last_update_ts" in rows.columns else stamp_now(now)
    src = F.coalesce("source", F.lit(source)) if "source" in rows.columns else F.lit(source)
    return rows.withColumns({"last_update_ts": ts.cast("timestamp"), "source": src})


def _overwrite(current: DataFrame, batch: DataFrame, keys: list[str], columns: list[str], update_when: Column) -> MergeResult:
    return merge(current, batch, keys, update_when, {c: new(c) for c in columns})


def merge_anycast(current: DataFrame, batch: DataFrame) -> MergeResult:
    """Overwrite whenever anything differs, even from older data."""
    columns = ["backing_prefix", "partial", "last_update_ts", "source"]
    return _overwrite(current, batch, ["prefix"], columns, any_of(*[differs(c) for c in columns]))


def merge_anycast_asn(current: DataFrame, batch: DataFrame) -> MergeResult:
    columns = ["last_update_ts", "source"]
    return _overwrite(current, batch, ["prefix", "asn"], columns, any_of(*[differs(c) for c in columns]))


def merge_backend(current: DataFrame, batch: DataFrame, key: str, force: bool = False) -> MergeResult:
    """Site counts: forced, or newer with a higher count."""
    count = f"{key}_count"
    better = newer() & F.coalesce(new(count) > cur(count), F.lit(False))
    return _overwrite(current, batch, ["prefix", key], [count, "last_update_ts", "source"], any_of(force, better))


# ---- spoofing, DNSSEC, minimisation -------------------------------------------------------------------


def spoofing_rows(df: DataFrame, source: str, iso: DataFrame | None = None, now: Column | None = None, v6: bool = True) -> DataFrame:
    """Cleaned spoofing rows with prefix keys, newest per prefix."""
    from resolvescope.functions.net import with_prefix_key

    missing = {"prefix", "nat", "privatespoof", "routedspoof"} - set(df.columns)
    if missing:
        raise ValueError(f"spoofing rows lack columns: {', '.join(sorted(missing))}")
    none = F.lit(None)
    keyed = with_prefix_key(df, "prefix", v6=v6).where(F.col("family").isNotNull())
    rows = with_metadata(keyed, source, now).select(
        "prefix", "family", "masklen", "net_hi", "net_lo", F.col("nat").try_cast("boolean").alias("nat"),
        F.col("privatespoof").cast("string").alias("privatespoof"), F.col("routedspoof").cast("string").alias("routedspoof"),
        (F.col("asn").try_cast("bigint") if "asn" in df.columns else none.cast("bigint")).alias("asn"),
        (F.col("country").cast("string") if "country" in df.columns else none.cast("string")).alias("country"),
        "last_update_ts", "source",
    )
    if iso is not None:
        rows = clean_country(rows, "country", iso)
    return latest_by(rows, ["prefix"])


def merge_spoofing(
    spoofing: DataFrame, spoofing_asn: DataFrame, spoofing_country: DataFrame, batch: DataFrame, force: bool = False,
    modules: tuple[str, ...] = ("spoofing", "asn", "country"),
) -> ImportResult:
    """Observations forced or newer; owner rows only for prefixes that were absent, forced or
    newer before this merge."""
    result = ImportResult()
    columns = ["nat", "privatespoof", "routedspoof", "last_update_ts", "source"]
    eligible = batch.join(spoofing.select("prefix", F.col("last_update_ts").alias("_old")), "prefix", "left").where(
        any_of(force, F.col("_old").isNull(), F.col("last_update_ts") > F.col("_old"))
    ).drop("_old")
    if "spoofing" in modules:
        result.add("spoofing", "spoofing", lambda: _overwrite(spoofing, batch, ["prefix"], columns, any_of(force, newer())))
    for name, table in (("asn", spoofing_asn), ("country", spoofing_country)):
        if name in modules:
            known = eligible.where(F.col(name).isNotNull()).select("prefix", name)
            result.add(name, f"spoofing_{name}", lambda name=name, table=table, known=known: _overwrite(table, known, ["prefix"], [name], any_of(force, differs(name))))
    return result


DNSSEC_METRICS = {"validating": "bigint", "validating_pc": "double", "partial_validating": "bigint", "partial_validating_pc": "double"}


def dnssec_rows(df: DataFrame, key: str, source: str, iso: DataFrame | None = None, now: Column | None = None) -> DataFrame:
    """Cleaned DNSSEC rows, newest per key; rows with a missing metric are dropped."""
    missing = ({key} | set(DNSSEC_METRICS)) - set(df.columns)
    if missing:
        raise ValueError(f"DNSSEC rows lack columns: {', '.join(sorted(missing))}")
    if "last_update_ts" not in df.columns and "last_observation_ts" in df.columns:
        df = df.withColumnRenamed("last_observation_ts", "last_update_ts")
    name = F.col(key).try_cast("bigint") if key == "asn" else F.col(key).cast("string")
    rows = with_metadata(df, source, now).select(
        name.alias(key), *[F.col(c).try_cast(kind).alias(c) for c, kind in DNSSEC_METRICS.items()], "last_update_ts", "source"
    )
    if key == "country" and iso is not None:
        rows = clean_country(rows, "country", iso).select(*rows.columns)
    return latest_by(rows.dropna(subset=[key, *DNSSEC_METRICS, "last_update_ts"]), [key])


def merge_dnssec(current: DataFrame, batch: DataFrame, key: str, force: bool = False) -> MergeResult:
    columns = [*DNSSEC_METRICS, "last_update_ts", "source"]
    return _overwrite(current, batch, [key], columns, any_of(force, newer()))


def resolve_ids(rows: DataFrame, resolver: DataFrame) -> DataFrame:
    """Rows of known addresses with their identity."""
    return rows.join(resolver.select(*IP_KEY, "resolver_id"), IP_KEY)


def missing_resolvers(rows: DataFrame, resolver: DataFrame) -> DataFrame:
    """Rows whose address no resolver has."""
    return rows.join(resolver.select(*IP_KEY), IP_KEY, "left_anti")


def merge_qmin(current: DataFrame, rows: DataFrame, resolver: DataFrame, force: bool = False) -> MergeResult:
    """Values change when forced, newer or different; the stamp never goes back; the first
    observation is set on a change to "yes", the last one on every newer "yes"."""
    values = ["qmin", "max_minimise_count", "minimize_one_lab"]
    batch = latest_by(resolve_ids(rows, resolver).select("resolver_id", *values, "last_update_ts", "source"), ["resolver_id"])
    yes = F.coalesce(new("qmin") == "yes", F.lit(False))
    advance = any_of(force, newer())
    was_yes = F.coalesce(cur("qmin") == "yes", F.lit(False))
    first_stamp = F.when(yes, new("last_update_ts"))
    result = merge(
        current, batch, ["resolver_id"],
        update_when=any_of(force, newer(), *[differs(v) for v in values]),
        update={
            **{v: new(v) for v in values},
            "last_update_ts": F.when(advance, new("last_update_ts")).otherwise(cur("last_update_ts")),
            "first_qmin_observation": F.when(yes & ~was_yes & advance, new("last_update_ts")).otherwise(cur("first_qmin_observation")),
            "last_qmin_observation": F.when(yes & advance, new("last_update_ts")).otherwise(cur("last_qmin_observation")),
            "source": new("source"),
        },
        insert={"first_qmin_observation": first_stamp, "last_qmin_observation": first_stamp},
    )
    total = rows.agg(F.count(F.lit(1))).scalar()
    missing = missing_resolvers(rows, resolver).agg(F.count(F.lit(1))).scalar()
    report = result.report.select(
        total.alias("candidates"), F.col("candidates").alias("matched"), missing.alias("missing_resolver"), "inserted", "updated"
    )
    skipped = F.greatest(F.col("candidates") - F.col("inserted") - F.col("updated") - F.col("missing_resolver"), F.lit(0))
    return result.with_report(report.withColumn("skipped", skipped))


# ---- lookup metadata ------------------------------------------------------------------------------------


def _lookup_report(result: MergeResult, staged: DataFrame, resolved: DataFrame, duplicate_of: str = "resolved") -> MergeResult:
    candidates = staged.agg(F.count(F.lit(1))).scalar()
    found = resolved.agg(F.count(F.lit(1))).scalar()
    report = result.report.select(candidates.alias("candidates"), "inserted", "updated", F.col("candidates").alias("_unique"), found.alias("_found"))
    base = F.col("_found") if duplicate_of == "resolved" else F.col("candidates")
    return result.with_report(report.select(
        "candidates", "inserted", "updated",
        F.greatest(F.col("candidates") - F.col("inserted") - F.col("updated"), F.lit(0)).alias("skipped"),
        (base - F.col("_unique")).alias("duplicate"), (F.col("candidates") - F.col("_found")).alias("missing_resolver"),
    ))


def _lookup_rows(df: DataFrame, v6: bool) -> DataFrame:
    return with_ip_key(df.withColumnRenamed("resolver_ip", "ip"), "ip", v6=v6).where(F.col("ip").isNotNull())


def merge_ptr_domain(
    current: DataFrame, rows: DataFrame, resolver: DataFrame, update_existing: bool = True, now: Column | None = None, v6: bool = True
) -> MergeResult:
    """Domains from reverse lookups: insert, and update only when newer and allowed."""
    staged = _lookup_rows(rows.withColumn("domain", clean.clean_domain(F.col("domain"))), v6).where(F.col("domain").isNotNull())
    resolved = resolve_ids(staged, resolver)
    batch = resolved.groupBy("resolver_id").agg(F.min("domain").alias("domain")).withColumn("last_update_ts", clean.import_day(now))
    when = newer() if update_existing else F.lit(False)
    result = merge(current, batch, ["resolver_id"], when, {"domain": new("domain"), "last_update_ts": new("last_update_ts")})
    return _lookup_report(result, staged, resolved)


def merge_svcb_services(current: DataFrame, rows: DataFrame, resolver: DataFrame, now: Column | None = None, v6: bool = True) -> MergeResult:
    """Services from ALPN lists with a port."""
    staged = _lookup_rows(rows, v6).withColumn("port", clean.clean_port(F.col("port"))).where(F.col("port").isNotNull())
    staged = staged.withColumn("protocol", F.explode(clean.clean_items(F.col("alpn")))).withColumn("protocol", clean.clean_protocol(F.col("protocol")))
    resolved = resolve_ids(staged, resolver)
    keys = ["resolver_id", "protocol", "port"]
    batch = resolved.select(*keys).distinct().withColumn("last_update_ts", clean.import_day(now))
    result = merge(current, batch, keys, newer(), {"last_update_ts": new("last_update_ts")})
    return _lookup_report(result, staged, resolved, "candidates")


def merge_svcb_dohpath(current: DataFrame, rows: DataFrame, resolver: DataFrame, now: Column | None = None, v6: bool = True) -> MergeResult:
    staged = _lookup_rows(rows.withColumn("dohpath", clean.clean_text(F.col("dohpath"))), v6).where(F.col("dohpath").isNotNull())
    resolved = resolve_ids(staged, resolver)
    batch = resolved.groupBy("resolver_id").agg(F.min("dohpath").alias("dohpath")).withColumn("last_update_ts", clean.import_day(now))
    result = merge(current, batch, ["resolver_id"], newer(), {"dohpath": new("dohpath"), "last_update_ts": new("last_update_ts")})
    return _lookup_report(result, staged, resolved)


def merge_ipv6_hints(resolver: DataFrame, rows: DataFrame, source: str, now: Column | None = None) -> MergeResult:
    """IPv6 hints become public addresses of the same identity; known addresses stay as they are."""
    staged = _lookup_rows(rows, True).select("ip", *IP_KEY, F.explode(clean.clean_items(F.col("ipv6hint"))).alias("hint"))
    staged = with_ip_key(staged, "hint", out="hint").where(F.col("hint_family") == 6)
    resolved = resolve_ids(staged, resolver)
    batch = resolved.groupBy(
        F.col("hint").alias("ip"), *[F.col(f"hint_{s}").alias(k) for s, k in (("family", "family"), ("hi", "ip_hi"), ("lo", "ip_lo"))]
    ).agg(F.min("resolver_id").alias("resolver_id")).withColumns(
        {"is_public": F.lit(True), "source": F.lit(source), "last_update_ts": clean.import_day(now)}
    )
    result = merge(resolver, batch, IP_KEY, F.lit(False), {})
    return _lookup_report(result, staged, resolved)


def merge_svcb(t, rows: DataFrame, source: str, now: Column | None = None, v6: bool = True) -> ImportResult:
    """Services, fallback domains (never overwriting), DoH paths and IPv6 hints of SVCB rows."""
    result = ImportResult()
    result.add("service", "resolver_service", lambda: merge_svcb_services(t.resolver_service, rows, t.resolver, now, v6))
    result.add("domain", "resolver_domain", lambda: merge_ptr_domain(t.resolver_domain, rows, t.resolver, False, now, v6))
    result.add("dohpath", "resolver_dohpath", lambda: merge_svcb_dohpath(t.resolver_dohpath, rows, t.resolver, now, v6))
    result.add("ipv6hint", "resolver", lambda: merge_ipv6_hints(t.resolver, rows, source, now))
    return result


# ---- end-to-end imports ------------------------------------------------------------------------------------


def add_resolvers(t, stage: DataFrame, verified: bool = False, now: Column | None = None) -> ImportResult:
    """Add-only load: new addresses; known ones only get a newer stamp and, if asked, the verified mark."""
    result = ImportResult()
    unique = unique_rows(stage)
    numbered = number_rows(unique, t.resolver, t.resolver_identity, "resolver_id").withColumn("verified", F.lit(verified))
    stamped = F.coalesce(new("last_update_ts"), stamp_now(now))
    existing = F.count_if(F.col("cur").isNotNull() & F.col("new").isNotNull())
    rows = merge(
        t.resolver, numbered.select(*t.resolver.columns), IP_KEY, newer(), {"last_update_ts": new("last_update_ts")},
        {"last_update_ts": stamped}, {"existing": existing, "growth": F.count_if(F.col("change") == "inserted")},
    )
    result.add("resolver", "resolver", lambda: _with_duplicates(rows, stage))
    ids = numbered.groupBy(F.col("resolver_id").alias("id")).agg(F.max("last_update_ts").alias("last_update_ts"))
    one = lambda n: F.when(cur(n) == 0, 1).otherwise(cur(n))
    start = F.lit(1 if verified else 0)
    result.add("identity", "resolver_identity", lambda: merge(
        t.resolver_identity, ids, ["id"], F.lit(verified) & ~cur("verified"),
        {"verified": F.lit(True), "total_measurements": one("total_measurements"), "seen_measurements": one("seen_measurements")},
        {"last_update_ts": stamped, "verified": F.lit(verified), "total_measurements": start, "seen_measurements": start},
    ))
    result.add("verification", "resolver_verification", lambda: merge_verification(t.resolver_verification, numbered))
    return result


def _with_duplicates(result: MergeResult, stage: DataFrame) -> MergeResult:
    total = stage.agg(F.count(F.lit(1))).scalar()
    report = result.report.withColumn("duplicate", total - F.col("candidates"))
    report = report.withColumns({"skipped": F.col("skipped") + F.col("duplicate"), "candidates": total})
    return result.with_report(report)


@dataclass(frozen=True)
class Dimensions:
    """Asks an import to keep the shared relations in step: every source of the batch must be
    registered and is stamped as retrieved; countries without coordinates get the gazetteer's."""

    gazetteer: DataFrame | None = None

    def settle(self, t, result: ImportResult, batches: Sequence[DataFrame], now: Column | None = None) -> ImportResult:
        """Add the modules ``sources`` and ``countries``. An unregistered source fails the import here,
        before anything is written."""
        used = _column_of(batches, "source")
        if used is not None:
            touched = check_and_touch_sources(t.data_source, used, stamp_now(now))
            report = touched.join(used.distinct(), "source", "left_semi").agg(F.count(F.lit(1)).alias("updated"))
            result.add("sources", "data_source", lambda: MergeResult(touched, report, touched))
        places = _column_of(batches, "country")
        if places is not None and self.gazetteer is not None:
            result.add("countries", "country_location", lambda: fill_country_locations(t.country_location, places, self.gazetteer))
        return result


def _column_of(batches: Sequence[DataFrame], name: str) -> DataFrame | None:
    found = [b.select(name).where(F.col(name).isNotNull()).distinct() for b in batches if name in b.columns]
    return reduce(DataFrame.union, found) if found else None


def import_resolver_stage(
    t, stage: DataFrame, modules: list[str] | None = None, force: bool = False, now: Column | None = None, cut: Cut = materialise
) -> ImportResult:
    """Merge cleaned resolver rows into the resolver relations, one report per module."""
    modules = modules or ["resolver", *ATTRIBUTES, "location", "protocol"]
    result = ImportResult()
    stage = cut(stage)
    numbered = cut(number_rows(unique_rows(stage), t.resolver, t.resolver_identity, "resolver_id"))
    result.add("resolver", "resolver", lambda: _with_duplicates(merge_resolver(t.resolver, numbered, force, now), stage))
    result.add("identity", "resolver_identity", lambda: merge_resolver_identity(t.resolver_identity, numbered, force, now))
    result.add("verification", "resolver_verification", lambda: merge_verification(t.resolver_verification, numbered))
    for name in modules:
        if name in ATTRIBUTES and name in numbered.columns:
            table = getattr(t, f"resolver_{name}")
            result.add(name, f"resolver_{name}", lambda name=name, table=table: _skipped_of(merge_attribute(table, numbered, [name], "resolver_id", force, now), numbered))
        elif name == "location":
            result.add(name, "resolver_location", lambda: _skipped_of(
                merge_location(t.resolver_location, numbered, "resolver_id", force, now), numbered
            ))
        elif name == "protocol":
            result.add(name, "resolver_service", lambda: merge_service(t.resolver_service, numbered, force, now))
    return result


def import_resolvers(
    t, df: DataFrame, mapping, modules, source: str, verified: bool = False, force: bool = False,
    iso: DataFrame | None = None, now: Column | None = None, v6: bool = True, cut: Cut = materialise, dimensions: Dimensions | None = None,
) -> ImportResult:
    """Landed resolver rows end to end: mapping, cleaning, newest per address, merges. No table is
    changed; a dry run evaluates only the reports.

    All modules start from the cleaned and the numbered rows. ``cut`` writes both once, while the
    result is described, so they are not derived again for each module.
    """
    selection = FileKind("resolver").selection(mapping, modules, df.columns)
    modules, mapped = selection.modules, selection.of(df)
    stage = cut(resolver_rows(mapped, source, verified, iso, now, v6))
    result = import_resolver_stage(t, stage, modules, force, now, lambda df: df if df is stage else cut(df))
    result.input = invalid_addresses(mapped, v6)
    return result if dimensions is None else dimensions.settle(t, result, [stage], now)


def import_forwarder_stage(
    t, stage: DataFrame, modules: list[str] | None = None, force: bool = False, now: Column | None = None, cut: Cut = materialise
) -> ImportResult:
    """Merge cleaned forwarder rows into the forwarder relations."""
    modules = modules or ["forwarder", *ATTRIBUTES, "location", "protocol", "upstream"]
    result = ImportResult()
    stage = cut(stage)
    numbered = cut(number_rows(unique_rows(stage), t.forwarder, t.forwarder_identity, "forwarder_id"))
    result.add("forwarder", "forwarder", lambda: _with_duplicates(merge_forwarder(t.forwarder, numbered, force, now), stage))
    ids = numbered.where("_fresh").select(
        F.col("forwarder_id").alias("id"), F.coalesce("last_update_ts", stamp_now(now)).alias("last_update_ts"),
        F.lit(0).alias("total_measurements"), F.lit(0).alias("seen_measurements"),
    )
    result.add("identity", "forwarder_identity", lambda: merge(t.forwarder_identity, ids, ["id"], F.lit(False), {}))
    for name in modules:
        if name in ATTRIBUTES and name in numbered.columns:
            table = getattr(t, f"forwarder_{name}")
            result.add(name, f"forwarder_{name}", lambda name=name, table=table: _skipped_of(merge_attribute(table, numbered, [name], "forwarder_id", force, now), numbered))
        elif name == "location":
            result.add(name, "forwarder_location", lambda: _skipped_of(
                merge_location(t.forwarder_location, numbered, "forwarder_id", force, now), numbered
            ))
        elif name == "protocol":
            result.add(name, "forwarder_protocol", lambda: merge_forwarder_protocol(t.forwarder_protocol, numbered, force, now))
        elif name == "upstream":
            edges = cut(classify_upstreams(stage, numbered, t.resolver, t.forwarder))  # both edge tables read it
            for column in ("upstream_resolver_id", "upstream_forwarder_id"):
                module = column.removesuffix("_id")
                table = f"forwarder_{module.removeprefix('upstream_')}_upstream"
                result.add(module, table, lambda column=column, table=table: merge_upstreams(
                    getattr(t, table), edges, column, force, now
                ))
    return result


def import_forwarders(
    t, df: DataFrame, mapping, modules, source: str, force: bool = False, iso: DataFrame | None = None,
    now: Column | None = None, v6: bool = True, cut: Cut = materialise, dimensions: Dimensions | None = None,
) -> ImportResult:
    """Landed forwarder rows end to end; see ``import_resolvers``."""
    selection = FileKind("forwarder").selection(mapping, modules, df.columns)
    modules, mapped = selection.modules, selection.of(df)
    stage = cut(forwarder_rows(mapped, source, iso, now, v6))
    result = import_forwarder_stage(t, stage, modules, force, now, lambda df: df if df is stage else cut(df))
    result.input = invalid_addresses(mapped, v6)
    return result if dimensions is None else dimensions.settle(t, result, [stage], now)


def import_qmin(t, df: DataFrame, mapping, source: str, force: bool = False, now: Column | None = None, v6: bool = True,
                dimensions: Dimensions | None = None) -> ImportResult:
    mapped = FileKind("qmin").selection(mapping, ["qmin"], df.columns).of(df)
    rows = qmin_rows(mapped, source, now, v6)
    result = ImportResult()
    result.add("qmin", "qmin_resolver", lambda: merge_qmin(t.qmin_resolver, rows, t.resolver, force))
    result.input = invalid_addresses(mapped.withColumnRenamed("resolver_ip", "ip"), v6)
    return result if dimensions is None else dimensions.settle(t, result, [rows], now)


def import_spoofing(t, df: DataFrame, source: str, modules: Sequence[str] = ("spoofing", "asn", "country"), force: bool = False,
                    iso: DataFrame | None = None, now: Column | None = None, v6: bool = True, cut: Cut = materialise,
                    dimensions: Dimensions | None = None) -> ImportResult:
    """A landed spoofing file end to end: cleaning, newest per prefix, the asked modules."""
    unknown = set(modules) - {"spoofing", "asn", "country"}
    if unknown or not modules:
        raise ValueError(f"spoofing modules are spoofing, asn and country; not {', '.join(sorted(unknown)) or 'none'}")
    rows = cut(spoofing_rows(df, source, iso, now, v6))
    result = merge_spoofing(t.spoofing, t.spoofing_asn, t.spoofing_country, rows, force, tuple(modules))
    return result if dimensions is None else dimensions.settle(t, result, [rows], now)


def import_dnssec(t, source: str, country: DataFrame | None = None, asn: DataFrame | None = None, force: bool = False,
                  iso: DataFrame | None = None, now: Column | None = None, cut: Cut = materialise,
                  dimensions: Dimensions | None = None) -> ImportResult:
    """Landed DNSSEC files by country, by network, or both, end to end."""
    given = {key: df for key, df in (("country", country), ("asn", asn)) if df is not None}
    if not given:
        raise ValueError("a DNSSEC import needs rows by country or by network")
    result, batches = ImportResult(), []
    for key, df in given.items():
        rows = cut(dnssec_rows(df, key, source, iso, now))
        batches.append(rows)
        result.add(key, f"dnssec_{key}", lambda key=key, rows=rows: merge_dnssec(getattr(t, f"dnssec_{key}"), rows, key, force))
    return result if dimensions is None else dimensions.settle(t, result, batches, now)


def import_anycast_frames(
    t, source: str, anycast: DataFrame | None = None, asn: DataFrame | None = None, country_backend: DataFrame | None = None,
    asn_backend: DataFrame | None = None, force: bool = False, now: Column | None = None, dimensions: Dimensions | None = None,
) -> ImportResult:
    """Merge prepared anycast frames; each is optional."""
    result = ImportResult()
    if anycast is not None:
        result.add("anycast", "anycast", lambda: merge_anycast(t.anycast, with_metadata(anycast, source, now)))
    if asn is not None:
        result.add("asn", "anycast_asn", lambda: merge_anycast_asn(t.anycast_asn, with_metadata(asn, source, now)))
    if country_backend is not None:
        batch = with_metadata(country_backend, source, now)
        result.add("country_backend", "anycast_country_backend", lambda batch=batch: merge_backend(t.anycast_country_backend, batch, "country", force))
    if asn_backend is not None:
        batch = with_metadata(asn_backend, source, now)
        result.add("asn_backend", "anycast_asn_backend", lambda batch=batch: merge_backend(t.anycast_asn_backend, batch, "asn", force))
    if dimensions is not None:
        frames = [with_metadata(f, source, now) for f in (anycast, asn, country_backend, asn_backend) if f is not None]
        return dimensions.settle(t, result, frames, now)
    return result
