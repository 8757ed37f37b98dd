"""Classification of a scan into resolver and forwarder feeds and side evidence.

``scan`` has one row per probe: queried_ip, replying_ip and backend_resolver with their asn,
prefix, org and country columns and address keys, resolver_type, protocol, timestamp_request.

What the rules ask about an address (is it anycast, a public resolver, a forwarder) is collected
once into an address table, and the columns that the feeds read are written once. A feed takes the
probes it is about, with the columns it reads and no others. What it reports of the address that its rule
asks about is reduced to distinct combinations, with the newest time of each, before it meets the address
table; where it reports another address, the replying one is looked up first and leaves the rows again.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import cached_property, reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from resolvescope.catalog import Catalog
from resolvescope.functions.clean import array_to_text, org_short, pack, piece, unpacked, value_of
from resolvescope.functions.countries import clean_country
from resolvescope.functions.net import masked, to_slash24, v4_text, with_prefix_key
from resolvescope.operators.containment import IP_KEY, with_match, with_prefix_match
from resolvescope.session import materialise
from resolvescope.sources.versions import open_catalog, write_versions

Cut = Callable[[DataFrame], DataFrame]
RESOLVER, FORWARDER, TRANSPARENT = "Resolver", "Forwarder", "Transparent Forwarder"
ATTRIBUTES = {"asn": "asn", "prefix": "bgp_prefix", "org": "org", "country": "country"}
FEED = ["ipv4", "asn", "bgp_prefix", "org", "country", "last_update_ts", "supported_protocols"]

# Detections above these make an anycast prefix high-confidence.
LATENCY_LEVEL, GEO_LEVEL = 3, 1


def fill_scan_ts(scan: DataFrame) -> DataFrame:
    """Missing probe times become the earliest time of the scan."""
    first = scan.agg(F.min("timestamp_request")).scalar()
    return scan.withColumn("timestamp_request", F.coalesce("timestamp_request", first))


def _any_above(df: DataFrame, prefix: str, level: int) -> Column:
    hit = F.lit(False)
    for name in df.columns:
        if name.startswith(prefix):
            hit = hit | (F.col(name) > level)
    return hit


def high_confidence(census: DataFrame) -> DataFrame:
    """Census rows with both an anycast-based and a latency-based detection."""
    return census.where(_any_above(census, "AB_", LATENCY_LEVEL) & _any_above(census, "GCD_", GEO_LEVEL))


def census_prefixes(census: DataFrame, v6: bool = False) -> DataFrame:
    """Distinct high-confidence prefixes with their keys."""
    rows = high_confidence(census).select("prefix").distinct()
    return with_prefix_key(rows, v6=v6).where(F.col("family").isNotNull()).dropDuplicates(["prefix"])


def address_columns(scan: DataFrame) -> list[str]:
    """Queried and replying address columns of a scan, numbered ones (``replying_ip_2``) included."""
    return [c for c in scan.columns if re.fullmatch(r"(queried|replying)_ip(_[0-9]+)?", c)]


def mark_anycast(scan: DataFrame, prefixes: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per address column: ``<col>_anycast_supported`` (true, or null when uncovered) and
    ``<col>_anycast_prefix``, the most specific covering prefix. By default all address columns."""
    out = scan
    for name in address_columns(scan) if columns is None else columns:
        out = with_prefix_match(out, prefixes, name, "_hit", f"{name}_anycast_prefix")
        out = out.withColumn(f"{name}_anycast_supported", F.when(F.col("_hit"), True)).drop("_hit")
    return out


def rollup_ip(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key: attributes of the newest row, newest time, the set of protocols.

    Each task first combines its own rows of a key, so a row is sent once at most and a hot key not at all.
    """
    out = rows.groupBy(*keys).agg(
        F.max(F.struct("last_update_ts", *ATTRIBUTES.values())).alias("_newest"),
        F.array_sort(F.collect_set("supported_protocols")).alias("supported_protocols"),
    )
    return out.select(*keys, *[f"_newest.{c}" for c in ATTRIBUTES.values()], "_newest.last_update_ts", "supported_protocols")


def _as_feed(rows: DataFrame, column: str, target: str | None = None, keys: bool = False) -> DataFrame:
    """Scan rows seen from one address column, with the keys of the addresses if asked."""
    picked = [F.col(f"{column}_{source}").alias(name) for source, name in ATTRIBUTES.items()]
    named = {"ipv4": column} | ({"resolver": target} if target else {})
    taken = [c for out, name in named.items() for c in (_address(name, out) if keys else [F.col(name).alias(out)])]
    return rows.select(*taken, *picked, F.col("timestamp_request").alias("last_update_ts"), F.col("protocol").alias("supported_protocols"))


def _key(column: str) -> list[str]:
    return [f"{column}_family", f"{column}_hi", f"{column}_lo"]


# What is seen of an address, as bits: it was queried; it was probed as a resolver, as a forwarder; as a forwarder that
# replied itself, or from nowhere.
QUERIED, AS_RESOLVER, AS_FORWARDER, REPLIED_ITSELF, NO_REPLY = (1 << i for i in range(5))


def _known(column: str) -> Column:
    """There is an address, written out or as a key alone (``in_short``)."""
    return F.col(column).isNotNull() | F.col(_key(column)[0]).isNotNull()


def _replied_itself() -> Column:
    """The address that replied is the one queried, by its key."""
    same = [F.col(q) == F.col(r) for q, r in zip(_key("queried_ip"), _key("replying_ip"))]
    return F.coalesce(_known("queried_ip") & reduce(and_, same), F.lit(False))


def seen_addresses(scan: DataFrame) -> DataFrame:
    """(family, ip_hi, ip_lo, seen): queried and replying addresses, with all that was seen of them as bits.

    A probe whose queried address replied itself names that address once. An address probed a million times is
    one row of a task before anything is sent.
    """
    forwarder = F.col("resolver_type") == FORWARDER
    bit = lambda condition, value: F.when(condition, value).otherwise(0)
    bits = F.lit(QUERIED) + bit(F.col("resolver_type") == RESOLVER, AS_RESOLVER) + bit(forwarder, AS_FORWARDER)
    bits = bits + bit(forwarder & _replied_itself(), REPLIED_ITSELF) + bit(forwarder & F.col("replying_ip_family").isNull(), NO_REPLY)
    named = lambda column, seen: F.struct(*[F.col(c).alias(k) for c, k in zip(_key(column), IP_KEY)], seen.cast("int").alias("seen"))
    both = F.array(
        F.when(_known("queried_ip"), named("queried_ip", bits)),
        F.when(F.col("replying_ip_family").isNotNull() & ~_replied_itself(), named("replying_ip", F.lit(0))),
    )
    rows = scan.select(F.explode(both).alias("_address")).where(F.col("_address").isNotNull()).select("_address.*")
    return rows.groupBy(*IP_KEY).agg(F.bit_or("seen").alias("seen"))


def anycast_addresses(scan: DataFrame, prefixes: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """(family, ip_hi, ip_lo, anycast_prefix): queried and replying addresses inside a prefix."""
    seen = seen_addresses(scan) if seen is None else seen
    found = with_match(seen.select(*IP_KEY).where(F.col("family").isNotNull()), prefixes, "_match")
    return found.where(F.col("_match").isNotNull()).select(*IP_KEY, F.col("_match.prefix").alias("anycast_prefix"))


def address_roles(scan: DataFrame, anycast: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """(family, ip_hi, ip_lo, is_public, is_forwarder, is_plain_forwarder) of queried addresses.

    A forwarder is plain if some reply came from an address that is not anycast; the rule mixes the replying
    and the queried mark, which are true or null, and under SQL null logic the queried mark never decides.
    Only forwarders that another address replied for look at distinct (queried, replying).
    """
    seen = seen_addresses(scan) if seen is None else seen
    queried = [F.col(n).alias(k) for n, k in zip(_key("queried_ip"), IP_KEY)]
    replying = _key("replying_ip")
    marks = anycast.select(*[F.col(k).alias(n) for n, k in zip(replying, IP_KEY)])
    relayed = scan.where(_known("queried_ip") & (F.col("resolver_type") == FORWARDER) & F.col(replying[0]).isNotNull() & ~_replied_itself())
    plain = relayed.select(*queried, *replying).distinct().join(marks, replying, "left_anti").select(*IP_KEY).distinct()
    queried_ones = seen.where(F.col("seen").bitwiseAND(QUERIED) != 0)
    known = queried_ones.join(anycast.select(*IP_KEY, F.lit(True).alias("_anycast")), IP_KEY, "left").join(plain.withColumn("_plain", F.lit(True)), IP_KEY, "left")
    was = lambda bit: F.col("seen").bitwiseAND(bit) != 0
    covered = F.col("_anycast").isNotNull()
    return known.select(
        *IP_KEY, (was(AS_RESOLVER) | (was(AS_FORWARDER) & covered)).alias("is_public"), was(AS_FORWARDER).alias("is_forwarder"),
        (was(NO_REPLY) | (was(REPLIED_ITSELF) & ~covered) | F.col("_plain").isNotNull()).alias("is_plain_forwarder"),
    )


ROLES = ("is_public", "is_forwarder", "is_plain_forwarder")


ADDRESSES = ("queried_ip", "replying_ip", "backend_resolver")


def probe_columns(scan: DataFrame) -> list[str]:
    """What the feeds read of a scan, besides the time."""
    wanted = ["resolver_type", "protocol"]
    for name in ADDRESSES:
        wanted += [name, *_key(name), *_attributes(name)]
    return [c for c in wanted if c in scan.columns]


def in_short(scan: DataFrame) -> DataFrame:
    """The scan without the texts that its keys tell: an IPv4 address in its usual form is a key alone."""
    usual = lambda name: (F.col(f"{name}_family") == 4) & (F.col(name) == v4_text(F.col(f"{name}_lo")))
    return scan.withColumns({name: F.when(~F.coalesce(usual(name), F.lit(False)), F.col(name)) for name in ADDRESSES})


def _written(name: str, key: str | None = None) -> Column:
    """The text of an address, in short or not."""
    family, _, lo = _key(key or name)
    return F.coalesce(F.col(name), F.when(F.col(family) == 4, v4_text(F.col(lo))))


def written_out(scan: DataFrame) -> DataFrame:
    """The scan with the texts of all addresses."""
    return scan.withColumns({name: _written(name) for name in ADDRESSES})


def _attributes(name: str) -> list[str]:
    return [f"{name}_{a}" for a in ATTRIBUTES]


LENGTH = "~"


def _network(family: Column, lo: Column, length: Column) -> Column:
    """Text of the IPv4 network of that length around an address."""
    return F.when((family == 4) & length.between(0, 32), F.concat(v4_text(masked(family, F.lit(0).cast("long"), lo, length)[1]), F.lit("/"), length.cast("string")))


def _packed(name: str) -> list[Column]:
    """Attributes of an address as pieces; of the network around the address, as prefixes usually are, the length alone."""
    family, _, lo = (F.col(c) for c in _key(name))
    prefix = F.col(f"{name}_prefix")
    length = F.substring_index(prefix, "/", -1).try_cast("int")
    pieces = {a: piece(F.col(f"{name}_{a}")) for a in ATTRIBUTES}
    around = F.coalesce(prefix == _network(family, lo, length), F.lit(False))
    return list((pieces | {"prefix": F.when(around, F.concat(F.lit(LENGTH), length.cast("string"))).otherwise(pieces["prefix"])}).values())


def _unpacked(name: str, packed: Column, first: int, asn: T.DataType) -> dict[str, Column]:
    """Attributes of an address whose pieces begin at ``first``."""
    family, _, lo = (F.col(c) for c in _key(name))
    found = {a: unpacked(packed, first + i) for i, a in enumerate(ATTRIBUTES)}
    out = {a: value_of(p) for a, p in found.items()}
    length = F.substring(found["prefix"], 2, 2).try_cast("int")
    out["prefix"] = F.when(found["prefix"].startswith(LENGTH), _network(family, lo, length)).otherwise(out["prefix"])
    return out | {"asn": out["asn"].cast(asn)}


def distinct_in_short(scan: DataFrame) -> DataFrame:
    """``distinct_probes`` of a scan in short. Combinations are sent as keys, a time and one text of all the rest."""
    keys = [c for name in ADDRESSES for c in _key(name)]
    texts = ["resolver_type", "protocol", *ADDRESSES]
    pieces = [*[piece(F.col(c)) for c in texts], *[p for name in ADDRESSES for p in _packed(name)]]
    few = scan.select(*keys, pack(pieces).alias("_packed"), "timestamp_request").groupBy(*keys, "_packed").agg(F.max("timestamp_request").alias("timestamp_request"))
    packed = F.col("_packed")
    out = {c: value_of(unpacked(packed, i)).alias(c) for i, c in enumerate(texts)}
    for i, name in enumerate(ADDRESSES):
        found = _unpacked(name, packed, len(texts) + i * len(ATTRIBUTES), scan.schema[f"{name}_asn"].dataType)
        out |= {f"{name}_{a}": c.alias(f"{name}_{a}") for a, c in found.items()}
    return few.select(*[out.get(c, F.col(c)) for c in probe_columns(scan)], "timestamp_request")


def distinct_probes(scan: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The combinations of ``columns`` (by default all that the feeds read) that occur, with the newest time of each."""
    wanted = probe_columns(scan) if columns is None else columns
    return scan.groupBy(*wanted).agg(F.max("timestamp_request").alias("timestamp_request"))


def _spread_key(name: str, far: int, columns: Sequence[str]) -> list[Column]:
    """Join key of an address column. A missing address gets a key of its own that matches nothing,
    so that rows without an address are not dealt to one task."""
    family, hi, lo = (F.col(c) for c in _key(name))
    nowhere = F.xxhash64(*columns)
    return [F.coalesce(family, F.lit(far).cast("tinyint")), F.coalesce(hi, F.lit(0).cast("long")), F.when(family.isNull(), nowhere).otherwise(lo)]


LEADS = {"queried_ip": None, "replying_ip": "reply", "backend_resolver": "back"}


def flag_scan(scan: DataFrame, addresses: DataFrame, names: Sequence[str] = ADDRESSES) -> DataFrame:
    """The scan with anycast marks of queried and replying addresses and the roles of replying
    and backend addresses (false for an address never queried, null for no address).

    Only the address columns ``names`` are looked up."""
    out = scan
    for name in names:
        lead = LEADS[name]
        carried = [] if name == "backend_resolver" else [F.col("anycast_prefix").alias(f"{name}_anycast_prefix")]
        roles = [F.col(r).alias(f"{lead}_{r}") for r in ROLES] if lead else []
        side = addresses.select(*[F.col(k).alias(f"_side_{k}") for k in IP_KEY], *carried, *roles)
        same = [mine == F.col(f"_side_{k}") for mine, k in zip(_spread_key(name, -1, scan.columns), IP_KEY)]
        out = out.join(side, same[0] & same[1] & same[2], "left").drop(*[f"_side_{k}" for k in IP_KEY])
        if lead:
            known = F.col(name).isNotNull()
            out = out.withColumns({f"{lead}_{r}": F.when(known, F.coalesce(F.col(f"{lead}_{r}"), F.lit(False))) for r in ROLES})
        if carried:
            out = out.withColumn(f"{name}_anycast_supported", F.when(F.col(f"{name}_anycast_prefix").isNotNull(), True))
    return out


# Where rows meet what is known about an address: its key, or a hash of a text that is no address, where nothing is known.
PLACE = ["_at_family", "_at_hi", "_at_lo"]
KINDS = {RESOLVER: 1, FORWARDER: 2, TRANSPARENT: 3}


def _place(name: str) -> list[Column]:
    family, hi, lo = (F.col(c) for c in _key(name))
    parts = [F.coalesce(family, F.lit(-1)).cast("tinyint"), F.coalesce(hi, F.lit(0)), F.when(family.isNull(), F.xxhash64(name)).otherwise(lo)]
    return [part.alias(at) for part, at in zip(parts, PLACE)]


def _address(name: str, out: str) -> list[Column]:
    """An address column in short, under another name."""
    return [F.col(c).alias(f"{out}{c.removeprefix(name)}") for c in (name, *_key(name))]


def _of_kind(*kinds: str) -> Column:
    return F.col("_kind").isin(*[KINDS[k] for k in kinds])


FOUND = ["ipv4", *_key("ipv4")]
GROUPS = (("public",), ("forwarders", "backend"), ("reply",))


def _with_texts(rows: DataFrame, *names: str) -> DataFrame:
    """Addresses written out, without their keys."""
    return rows.withColumns({name: _written(name) for name in names}).drop(*[c for name in names for c in _key(name)])


class ScanClassification:
    """All feeds of a scan's probes (a written table) and what is known about the addresses.

    Rows are sent in short: addresses as keys, the kind of probe as a number. A rule's rows meet the address table
    where its address lives, and stay there to be rolled up. With ``strict`` the second closed-resolver rule is
    limited to transparent rows; without it every row counts, as the rule has always been applied.
    """

    def __init__(self, probes: DataFrame, addresses: DataFrame, strict: bool = False):
        self.probes = written_out(probes)
        self.addresses = addresses
        self.strict = strict
        kind = F.when(F.col("resolver_type") == RESOLVER, KINDS[RESOLVER])
        for name in (FORWARDER, TRANSPARENT):
            kind = kind.when(F.col("resolver_type") == name, KINDS[name])
        self._rows = in_short(probes).withColumn("_kind", kind.otherwise(0).cast("tinyint"))

    def _flagged(self, columns: Sequence[str], asked: Sequence[str], of: Column, once: Column | None = None) -> DataFrame:
        """``columns`` of the probes that satisfy ``of``, with their newest times and the facts about the address
        columns ``asked``. Combinations are made distinct before they meet the address table; with ``once``, what
        must hold when the first of ``asked`` is known, that one is looked up first and is not carried on."""
        listed = lambda names: list(dict.fromkeys(["resolver_type", *columns, *[c for name in names for c in (name, *_key(name))]]))
        rows = self.probes.where(of)
        if once is None:
            return flag_scan(distinct_probes(rows, listed(asked)), self.addresses, asked)
        first, *rest = asked
        met = flag_scan(rows.select(*listed(asked), "timestamp_request"), self.addresses, [first]).where(once)
        if not rest:
            return met
        return flag_scan(distinct_probes(met, [*listed(rest), *[f"{LEADS[first]}_{r}" for r in ROLES]]), self.addresses, rest)

    def _met(self, rows: DataFrame) -> DataFrame:
        """Rows with PLACE columns and what is known there: ``_anycast`` and the roles, false where nothing is."""
        side = self.addresses.where(F.col("family").isNotNull()).select(
            *[F.col(k).alias(at) for k, at in zip(IP_KEY, PLACE)], F.col("anycast_prefix").isNotNull().alias("_anycast"), *ROLES
        ).withColumn(PLACE[0], F.col(PLACE[0]).cast("tinyint"))
        return rows.join(side, PLACE, "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("_anycast", *ROLES)})

    def _taken(self, name: str, attributes: bool = True) -> list[Column]:
        """What a feed takes from one address column of a row, to be sent: ``_opened`` makes feed columns of it."""
        return [*_address(name, "ipv4"), *([pack([*_packed(name), piece(F.col("protocol"))]).alias("_packed")] if attributes else [])]

    def _opened(self, rows: DataFrame) -> DataFrame:
        found = _unpacked("ipv4", F.col("_packed"), 0, self.probes.schema["queried_ip_asn"].dataType)
        out = {ATTRIBUTES[a]: c for a, c in found.items()} | {"supported_protocols": value_of(unpacked(F.col("_packed"), len(ATTRIBUTES)))}
        return rows.withColumns(out).drop("_packed")

    # ---- resolvers -----------------------------------------------------------------------

    def _asking_itself(self, name: str, of: Column, condition: Column, attributes: bool) -> DataFrame:
        """Addresses of a column that satisfy a condition about themselves, with PLACE columns."""
        rows = self._rows.where(of).select("_kind", *self._taken(name, attributes), F.col("timestamp_request").alias("last_update_ts"))
        kept = [c for c in rows.columns if c != "last_update_ts"]
        few = rows.groupBy(*kept).agg(F.max("last_update_ts").alias("last_update_ts")) if attributes else rows.select(*kept).distinct()
        return self._met(few.select("*", *_place("ipv4"))).where(condition)

    def _asking_reply(self, names: Sequence[str], attributes: bool) -> DataFrame:
        """Backends by what is known about the address that replied and about themselves, an entry per rule.

        The replying address is looked up first and leaves the rows. What it says comes down to three marks;
        per combination of the rest, each mark keeps its newest time. A resolver that replied itself is public,
        so no rule can hold for its probes and they are not sent.
        """
        hidden = _known("replying_ip") & _known("backend_resolver")
        outsider = ~F.col("is_forwarder") & ~F.col("is_public")
        marks = {
            "forwarders": _of_kind(FORWARDER) & ~F.col("is_public"),
            "plain": _of_kind(TRANSPARENT) & F.col("is_plain_forwarder"),
            "outsider": outsider & _of_kind(TRANSPARENT) if self.strict else outsider,
        }
        of = hidden & ~(_of_kind(RESOLVER) & _replied_itself())
        if names == ("forwarders",):
            marks, of = {"forwarders": marks["forwarders"]}, hidden & _of_kind(FORWARDER)
        elif "forwarders" not in names:
            del marks["forwarders"]
        if self.strict:
            of = of & _of_kind(FORWARDER, TRANSPARENT)
        taken = self._taken("backend_resolver", attributes)
        rows = self._rows.where(of).select("_kind", *_place("replying_ip"), *taken, F.col("timestamp_request").alias("last_update_ts"))
        known = self._met(rows).where(reduce(or_, marks.values())).withColumns({f"_{m}": c for m, c in marks.items()})
        kept = [c for c in rows.columns if c not in ("_kind", "last_update_ts", *PLACE)]
        newest = [F.max(F.when(F.col(f"_{m}"), F.col("last_update_ts"))).alias(f"_{m}_ts") for m in marks] if attributes else []
        few = known.groupBy(*kept).agg(*[F.bool_or(f"_{m}").alias(f"_{m}") for m in marks], *newest)
        met = self._met(few.select("*", *_place("ipv4"))).where(~F.col("is_public"))
        when = {m: F.col(f"_{m}") if m != "outsider" else F.col("_outsider") & ~F.col("is_forwarder") for m in marks}
        rules = {"forwarders": ["forwarders"], "backend": ["plain", "outsider"]}
        entries = []
        for name in names:
            ts = F.greatest(*[F.when(when[m], F.col(f"_{m}_ts")) for m in rules[name]], F.lit(None)) if attributes else F.lit(None)
            entries.append(F.when(reduce(or_, [when[m] for m in rules[name]]), F.struct(F.lit(name).alias("_rule"), ts.alias("last_update_ts"))))
        return met.withColumn("_entry", F.explode(F.array(*entries))).where(F.col("_entry").isNotNull()).select(*kept, *PLACE, "_entry.*")

    def _found(self, group: Sequence[str], attributes: bool = True) -> DataFrame:
        """What the rules of these names find, with PLACE columns, an entry per rule and combination. Rules that
        ask about the same addresses share their lookups."""
        if "public" in group:
            found = self._asking_itself("queried_ip", _of_kind(RESOLVER, FORWARDER), _of_kind(RESOLVER) | F.col("_anycast"), attributes)
        elif "reply" in group:
            closed = ~F.col("is_forwarder") & ~F.col("is_public") & F.col("_anycast")
            found = self._asking_itself("replying_ip", _of_kind(TRANSPARENT) & _known("replying_ip"), closed, attributes)
        else:
            return self._asking_reply(tuple(group), attributes)
        return found.withColumn("_rule", F.lit(group[0]))

    def _rolled(self, group: Sequence[str]) -> DataFrame:
        """What rules find, rolled up by rule and address where it was found."""
        return rollup_ip(self._opened(self._found(group)), ["_rule", *PLACE, *FOUND]).drop(*PLACE)

    def _of_rule(self, name: str) -> DataFrame:
        return _with_texts(self._rolled([name]).drop("_rule"), "ipv4")

    def public_resolvers(self) -> DataFrame:
        """Resolvers, and forwarders that are themselves anycast."""
        return self._of_rule("public")

    def closed_from_forwarders(self) -> DataFrame:
        """Backends of forwarders that are not public resolvers, nor is the replying address."""
        return self._of_rule("forwarders")

    def closed_from_transparent_backend(self) -> DataFrame:
        """Backends behind transparent forwarders whose replying address is a plain forwarder, or
        neither a forwarder nor a public resolver."""
        return self._of_rule("backend")

    def closed_from_transparent_reply(self) -> DataFrame:
        """Anycast replying addresses that are neither forwarders nor public resolvers."""
        return self._of_rule("reply")

    @cached_property
    def _resolvers(self) -> DataFrame:
        rows = reduce(DataFrame.unionByName, [self._rolled(group) for group in GROUPS])
        return rows.withColumn("is_public", F.col("_rule") == "public").drop("_rule")

    @cached_property
    def _resolver_addresses(self) -> DataFrame:
        found = [self._found(group, attributes=False).select(*FOUND) for group in GROUPS]
        return reduce(DataFrame.unionByName, found).where(_known("ipv4")).distinct()

    def write_resolvers(self, cut: Cut = materialise) -> "ScanClassification":
        """Write the resolvers once, for a job that reads them for several feeds."""
        self._resolvers = cut(self._resolvers)
        self._resolver_addresses = self._resolvers.select(*FOUND).where(_known("ipv4")).distinct()
        return self

    @property
    def resolvers(self) -> DataFrame:
        """Public and closed resolvers; one address may come from several closed rules."""
        return _with_texts(self._resolvers, "ipv4")

    @property
    def resolver_addresses(self) -> DataFrame:
        """Distinct addresses of ``resolvers``, taken from the rules without the attributes and the roll-up."""
        return self._resolver_addresses.select(_written("ipv4").alias("ip"))

    def resolver_feed(self, source: str, iso: DataFrame | None = None) -> DataFrame:
        """Import rows of the resolvers, on port 53."""
        rows = self.resolvers.withColumn("org_short", org_short(F.col("org")))
        rows = clean_country(rows, "country", iso) if iso is not None else rows
        text = array_to_text(F.col("supported_protocols"))
        return rows.select(
            F.col("ipv4").alias("ip"), "asn", F.col("bgp_prefix").alias("prefix"), "org", "org_short", "country", "is_public",
            text.alias("protocol"), F.lit(53).alias("port"), text.alias("supported_protocols"), "last_update_ts",
            F.lit(source).alias("source"),
        )

    # ---- forwarders ------------------------------------------------------------------------

    def recursive_forwarders(self) -> DataFrame:
        """Forwarders by (address, backend): public ones whose replying address is no public
        resolver, and closed ones, the replying address of a transparent row that is no resolver."""
        reads = lambda name: [*self._taken(name), *_address("backend_resolver", "resolver"), F.col("timestamp_request").alias("last_update_ts")]
        replied = self._rows.where(_known("replying_ip"))
        public = self._met(replied.where(_of_kind(FORWARDER)).select(*_place("replying_ip"), *reads("queried_ip"))).where(~F.col("is_public"))
        text = F.coalesce("ipv4", F.lit("")).alias("_at_text")  # texts of one key that differ are different addresses
        closed = replied.where(_of_kind(TRANSPARENT)).select(*_place("replying_ip"), *reads("replying_ip")).select("*", text).join(
            self._resolver_addresses.select(*_place("ipv4"), text), [*PLACE, "_at_text"], "left_anti"
        )
        keys = [*FOUND, "resolver", *_key("resolver")]
        parts = [
            rollup_ip(self._opened(public), keys).withColumn("is_public", F.lit(True)),
            rollup_ip(self._opened(closed), [*PLACE, "_at_text", *keys]).drop(*PLACE, "_at_text").withColumn("is_public", F.lit(False)),
        ]
        return _with_texts(parts[0].unionByName(parts[1]), "ipv4", "resolver").withColumn("type", F.lit("recursive"))

    def transparent_forwarders(self) -> DataFrame:
        """Transparent forwarders by (address, replying resolver)."""
        rows = _as_feed(self._rows.where(_of_kind(TRANSPARENT)), "queried_ip", "replying_ip", keys=True)
        out = _with_texts(rollup_ip(rows, [*FOUND, "resolver", *_key("resolver")]), "ipv4", "resolver")
        return out.withColumns({"is_public": F.lit(True), "type": F.lit("transparent")})

    def forwarder_feed(self, source: str, iso: DataFrame | None = None) -> DataFrame:
        """Import rows of all forwarders."""
        rows = self.recursive_forwarders().unionByName(self.transparent_forwarders())
        rows = rows.withColumn("org_short", org_short(F.col("org"), hyphenated=True))
        rows = clean_country(rows, "country", iso) if iso is not None else rows
        return rows.select(
            F.col("ipv4").alias("ip"), F.col("resolver").alias("upstream_ip"), "type", "is_public",
            array_to_text(F.col("supported_protocols")).alias("protocol"), "asn", F.col("bgp_prefix").alias("prefix"), "org",
            "org_short", "country", "last_update_ts", F.lit(source).alias("source"),
        )

    def missing_target_rows(self) -> DataFrame:
        """Forwarder rows whose address is neither a prepared resolver nor a recursive forwarder."""
        recursive = self.recursive_forwarders().select("ipv4", "type")
        rows = recursive.unionByName(self.transparent_forwarders().select("ipv4", "type")).where(F.col("ipv4").isNotNull())
        known = self.resolver_addresses.select(F.col("ip").alias("ipv4")).union(recursive.select("ipv4")).distinct()
        return rows.join(known, "ipv4", "left_anti")

    def missing_targets(self) -> DataFrame:
        """Missing rows and addresses by forwarder type."""
        return self.missing_target_rows().groupBy("type").agg(
            F.count(F.lit(1)).alias("rows"), F.count_distinct("ipv4").alias("unique_resolvers")
        )

    def missing_target_sample(self, k: int = 10) -> DataFrame:
        """The k addresses with most missing rows."""
        counted = self.missing_target_rows().groupBy("ipv4", "type").agg(F.count(F.lit(1)).alias("rows"))
        return counted.orderBy(F.col("rows").desc(), "ipv4", "type").limit(k)

    # ---- side evidence ----------------------------------------------------------------------

    def _anycast_replies(self, *columns: str) -> DataFrame:
        of = (F.col("resolver_type") == TRANSPARENT) & F.col("replying_ip_family").isNotNull()
        return self._flagged(columns, ["replying_ip"], of, F.col("replying_ip_anycast_supported"))

    def _evidence(self, column: str, name: str) -> DataFrame:
        # a missing backend counts as one distinct value
        backends = F.count_distinct("backend_resolver") + F.max(F.when(F.col("backend_resolver").isNull(), 1).otherwise(0))
        rows = self._anycast_replies(column, "backend_resolver").where(F.col(column).isNotNull())
        return rows.groupBy(F.col("replying_ip_anycast_prefix").alias("prefix"), F.col(column).alias(name)).agg(
            backends.alias(f"{name}_count")
        )

    def anycast_country_evidence(self) -> DataFrame:
        """Distinct backends per (anycast prefix, client country)."""
        return self._evidence("queried_ip_country", "country")

    def anycast_asn_evidence(self) -> DataFrame:
        """Distinct backends per (anycast prefix, client ASN)."""
        return self._evidence("queried_ip_asn", "asn")

    def spoofing_evidence(self) -> DataFrame:
        """Client /24 networks that got spoofed packets out through a transparent forwarder."""
        owner = F.struct(F.col("queried_ip_asn").alias("asn"), F.col("queried_ip_country").alias("country"))
        rows = self._anycast_replies("queried_ip", "queried_ip_asn", "queried_ip_country").withColumn("prefix", to_slash24(F.col("queried_ip")))
        out = rows.groupBy("prefix").agg(
            F.max("timestamp_request").alias("last_update_ts"),
            F.max_by(owner, F.struct(F.col("timestamp_request"), owner)).alias("_owner"),
        )
        return out.select(
            "prefix", "last_update_ts", "_owner.*", F.lit(None).cast("boolean").alias("nat"),
            F.lit("unknown").alias("privatespoof"), F.lit("received").alias("routedspoof"),
        )


@dataclass(frozen=True)
class ScanState:
    """What is left of any number of snapshots: the combinations probed, with their newest times, and what
    is known about the addresses. Both merge by maximum and by or, so a snapshot is read once."""

    probes: DataFrame
    addresses: DataFrame

    def merged_with(self, other: "ScanState", cut: Cut = materialise) -> "ScanState":
        """The state of the snapshots of both, which must have been marked with one census. The probes of either
        may still hold a combination more than once."""
        probes = distinct_in_short(in_short(self.probes).unionByName(in_short(other.probes)))
        known = self.addresses.unionByName(other.addresses).groupBy(*IP_KEY).agg(F.max("anycast_prefix").alias("anycast_prefix"), *[F.bool_or(r).alias(r) for r in ROLES])
        return ScanState(cut(probes), cut(known))


def known_addresses(probes: DataFrame, census: DataFrame, cut: Cut = materialise) -> DataFrame:
    """Address roles with anycast marks."""
    seen = cut(seen_addresses(probes))
    covered = cut(anycast_addresses(probes, census_prefixes(census), seen))
    return cut(covered.join(address_roles(probes, covered, seen), IP_KEY, "full_outer"))


def snapshot_state(scan: DataFrame, census: DataFrame, cut: Cut = materialise) -> ScanState:
    """One snapshot's probes, its columns written once and not yet distinct, and what is known about the addresses."""
    probes = fill_scan_ts(cut(in_short(scan.select(*probe_columns(scan), "timestamp_request"))))
    return ScanState(probes, known_addresses(probes, census, cut))


def scan_state(scan: DataFrame, census: DataFrame, cut: Cut = materialise) -> ScanState:
    """The state of one snapshot: distinct probes, and what is known about the addresses."""
    snapshot = snapshot_state(scan, census, cut)
    return ScanState(cut(distinct_in_short(snapshot.probes)), snapshot.addresses)


STATE_TABLES = ("scan_probes", "scan_addresses")


def add_snapshot(spark: SparkSession, root: str, scan: DataFrame, census: DataFrame, cut: Cut = materialise) -> ScanState:
    """Add a snapshot to the state kept under ``root``; only the snapshot and the state are read.

    The snapshot's probes meet those of the state, and become distinct, in the one step whose rows the next
    version is written from."""
    tables = open_catalog(spark, root)
    state = snapshot_state(scan, census, cut)
    if STATE_TABLES[0] in tables.versions:
        stored = ScanState(*[tables.stored(name, part.schema) for name, part in zip(STATE_TABLES, (state.probes, state.addresses))])
        state = stored.merged_with(state, cut=lambda df: df)
    else:
        state = ScanState(distinct_in_short(state.probes), state.addresses)
    frames = dict(zip(STATE_TABLES, (state.probes, state.addresses)))
    written = Catalog(spark, root, write_versions(spark, root, frames, tables))
    return ScanState(*[written.stored(name, part.schema) for name, part in frames.items()])


def classify_state(state: ScanState, strict: bool = False) -> ScanClassification:
    return ScanClassification(state.probes, state.addresses, strict)


def classify_scan(scan: DataFrame, census: DataFrame, strict: bool = False, cut: Cut = materialise) -> ScanClassification:
    """Fill probe times, collect what is known about addresses, set up the feeds.

    ``cut`` ends the lineage four times: the columns that the feeds read, addresses with what was seen of them,
    covered addresses, address roles. The last three hold one row per address. Probes are not made distinct over all columns here, which would
    send each with the attributes of its three addresses: the feeds reduce them over the columns they read.
    """
    return classify_state(snapshot_state(scan, census, cut), strict)


def refresh_scan(t, scan: DataFrame, census: DataFrame, source: str, iso: DataFrame | None = None, now: Column | None = None,
                 strict: bool = False, cut: Cut = materialise):
    """A whole scan refresh: classification, then the resolver, forwarder, anycast-backend and
    spoofing imports. Returns the four import results by name; nothing is written."""
    from resolvescope.plans import imports as m

    feeds = classify_scan(scan, census, strict, cut).write_resolvers(cut)
    resolver_stage = m.resolver_rows(feeds.resolver_feed(source, iso), source, verified=True, now=now, v6=False)
    resolvers = m.import_resolver_stage(t, resolver_stage, ["resolver", "asn", "prefix", "org", "location", "protocol"], now=now, cut=cut)

    merged = cut(resolvers.table("resolver"))

    class AfterResolvers:
        """Forwarder edges see the resolvers of this refresh."""

        def __getattr__(self, name):
            return merged if name == "resolver" else getattr(t, name)

    forwarder_stage = m.forwarder_rows(feeds.forwarder_feed(source, iso), source, now=now, v6=False)
    modules = ["forwarder", "asn", "prefix", "org", "location", "protocol", "upstream"]
    forwarders = m.import_forwarder_stage(AfterResolvers(), forwarder_stage, modules, now=now, cut=cut)
    anycast = m.import_anycast_frames(
        t, source, country_backend=feeds.anycast_country_evidence(), asn_backend=feeds.anycast_asn_evidence(), now=now
    )
    spoof = m.merge_spoofing(
        t.spoofing, t.spoofing_asn, t.spoofing_country, m.spoofing_rows(feeds.spoofing_evidence(), source, iso, now, v6=False)
    )
    return {"resolver": resolvers, "forwarder": forwarders, "anycast": anycast, "spoofing": spoof}
