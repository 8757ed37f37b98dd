"""Domain relations derived from the star-schema tables, so that every registered query has
realistic input whose size follows the data. The same derivations exist as DuckDB text in
``workload.oracle``.
"""

from __future__ import annotations

import math
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from resolvescope.functions.net import v4_text
from resolvescope.session import configure, materialise

# Country list of the fixtures, indexed by nation key.
ISO = (
    "USA DEU FRA GBR NLD JPN BRA IND CHN AUS CAN ITA ESP SWE POL RUS ZAF MEX KOR TUR ARG IDN EGY NGA CHE"
).split()

# Rows of a table that one task takes on. Rows of lookups and of landed scans are far larger than what they are made from.
SPREAD_ROWS = 200_000


def iso(index: Column) -> Column:
    return F.get(F.array(*[F.lit(c) for c in ISO]), index.cast("int"))


def mask(value: Column, length: Column | int) -> Column:
    bits = (F.lit(32) - length).cast("int")
    return F.call_function("shiftleft", F.call_function("shiftright", value, bits), bits)


def rip(k: Column) -> Column:
    return F.lit(16777216).cast("bigint") + (k * 7919) % 16777216


def aip(k: Column) -> Column:
    return F.lit(16777216).cast("bigint") + (k * 167772) % 16777216


def pip(k: Column) -> Column:
    base = F.when(k % 2 == 0, F.lit(16777216)).otherwise(F.lit(33554432)).cast("bigint")
    return base + (k * 7927) % 16777216


def v4_key(number: Column) -> list[Column]:
    return [
        v4_text(number).alias("ip"),
        F.lit(4).cast("tinyint").alias("family"),
        F.lit(0).cast("bigint").alias("ip_hi"),
        number.alias("ip_lo"),
    ]


def prefix_text(net: Column, masklen: Column | int) -> Column:
    masklen = F.lit(masklen) if isinstance(masklen, int) else masklen
    return F.concat(v4_text(net), F.lit("/"), masklen.cast("string"))


def prefix_key(net: Column, masklen: Column | int) -> list[Column]:
    masklen = F.lit(masklen) if isinstance(masklen, int) else masklen
    return [
        prefix_text(net, masklen).alias("prefix"),
        F.lit(4).cast("tinyint").alias("family"),
        masklen.cast("int").alias("masklen"),
        F.lit(0).cast("bigint").alias("net_hi"),
        net.alias("net_lo"),
    ]


class Fixtures:
    """Lazily built relations over one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = configure(spark)
        self.dir = sf_dir

    def raw(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        naive = [f.name for f in df.schema if f.dataType.typeName() == "timestamp_ntz"]
        return df.withColumns({c: F.col(c).cast("timestamp") for c in naive}) if naive else df

    def pieces(self, name: str) -> int:
        """Pieces of a table, growing with it: one per core at least, of SPREAD_ROWS rows at most on average."""
        return max(self.spark.sparkContext.defaultParallelism, math.ceil(self.raw(name).count() / SPREAD_ROWS))

    def spread(self, name: str, rows: DataFrame | None = None) -> DataFrame:
        """A table (or rows made from it) dealt into its pieces. A table that comes as that many files is left as it is."""
        df = self.raw(name)
        pieces = self.pieces(name)
        rows = df if rows is None else rows
        return rows.repartition(pieces) if len(df.inputFiles()) < pieces else rows

    def spread_join(self, name: str, other: DataFrame, key: str) -> DataFrame:
        """A table joined with another. Where ``spread`` would deal the table, both are dealt into its pieces by the key,
        so that the rows are sent once for the join and the spreading."""
        df = self.raw(name)
        pieces = self.pieces(name)
        if len(df.inputFiles()) >= pieces:
            return df.join(other, key)
        return df.repartition(pieces, key).join(other.repartition(pieces, key), key)

    # ---- resolvers -------------------------------------------------------------------

    @cached_property
    def resolver(self) -> DataFrame:
        newest = self.raw("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("ts"))
        k = F.col("c_custkey")
        return self.raw("customer").join(newest, "c_custkey", "left").select(
            *v4_key(rip(k)),
            (k - F.when(k % 50 == 1, 1).otherwise(0)).alias("resolver_id"),
            (F.col("c_acctbal") > 5000).alias("is_public"),
            F.coalesce("ts", F.lit("2020-01-01").cast("timestamp")).alias("last_update_ts"),
            F.lower("c_mktsegment").alias("source"),
        )

    @cached_property
    def resolver_v6(self) -> DataFrame:
        """An IPv6 address of every identity."""
        k = F.col("c_custkey")
        g3 = F.floor(k / 65536).cast("bigint")
        g4 = k % 63 + 1
        low = k % 65536
        text = F.concat(
            F.lit("2001:db8:"), F.lower(F.hex(g3)), F.lit(":"), F.lower(F.hex(g4)), F.lit("::"),
            F.when(low == 0, "").otherwise(F.lower(F.hex(low))),
        )
        return self.raw("customer").select(
            text.alias("ip"),
            F.lit(6).cast("tinyint").alias("family"),
            (F.lit(2306139568115548160) + g3 * 65536 + g4).alias("ip_hi"),
            low.alias("ip_lo"),
            k.alias("resolver_id"),
            (F.col("c_acctbal") > 0).alias("is_public"),
            F.lit("2021-01-01").cast("timestamp").alias("last_update_ts"),
            F.lower("c_mktsegment").alias("source"),
        )

    @cached_property
    def resolver_dual(self) -> DataFrame:
        return self.resolver.unionByName(self.resolver_v6)

    @cached_property
    def resolver_identity(self) -> DataFrame:
        k = F.col("c_custkey")
        return self._one_ip.select(
            k.alias("id"),
            F.lit("2020-06-01").cast("timestamp").alias("last_update_ts"),
            F.lit(0).alias("total_measurements"),
            F.lit(0).alias("seen_measurements"),
            (k % 4 == 0).alias("verified"),
        )

    @cached_property
    def _one_ip(self) -> DataFrame:
        return self.raw("customer").where(F.col("c_custkey") % 50 != 1)

    def _attribute(self, keep: Column, *cols: Column) -> DataFrame:
        return self._one_ip.where(keep).select(
            F.col("c_custkey").alias("resolver_id"), *cols,
            F.lit("2020-06-01").cast("timestamp").alias("last_update_ts"),
        )

    @cached_property
    def resolver_asn(self) -> DataFrame:
        k = F.col("c_custkey")
        return self._attribute(k % 13 != 0, (F.lit(64496) + k % 97).alias("asn"))

    @cached_property
    def resolver_prefix(self) -> DataFrame:
        k = F.col("c_custkey")
        return self._attribute(k % 11 != 0, prefix_text(mask(rip(k), 14), 14).alias("prefix"))

    @cached_property
    def resolver_location(self) -> DataFrame:
        k = F.col("c_custkey")
        city = F.when(k % 3 == 0, F.concat(F.lit("city-"), (k % 7).cast("string")))
        return self._attribute(k % 17 != 0, iso(F.col("c_nationkey")).alias("country"), city.alias("city"))

    @cached_property
    def resolver_org(self) -> DataFrame:
        k = F.col("c_custkey")
        return self._attribute(k % 19 != 0, F.concat(F.col("c_mktsegment"), F.lit(" Net")).alias("org"))

    @cached_property
    def resolver_domain(self) -> DataFrame:
        k = F.col("c_custkey")
        name = F.concat(F.when(k % 2 == 1, "R").otherwise("r"), (k % 400).cast("string"), F.lit(".example.net"))
        return self._attribute(k % 3 == 0, name.alias("domain"))

    @cached_property
    def resolver_dohpath(self) -> DataFrame:
        k = F.col("c_custkey")
        return self._attribute(k % 7 == 0, F.when(k % 2 == 0, "/dns-query{?dns}").otherwise("/q{?dns}").alias("dohpath"))

    @cached_property
    def resolver_service(self) -> DataFrame:
        digit = F.substring("o_orderpriority", 1, 1)
        protocol = (
            F.when(digit == "1", "doudp").when(digit == "2", "dotcp").when(digit == "3", "dot")
            .when(digit == "4", "doh").otherwise("doq")
        )
        port = F.when(digit.isin("1", "2"), 53).when(digit == "4", 443).otherwise(853)
        return (
            self.raw("orders").where(F.col("o_custkey") % 50 != 1)
            .select(F.col("o_custkey").alias("resolver_id"), protocol.alias("protocol"), port.alias("port"), "o_orderdate")
            .groupBy("resolver_id", "protocol", "port")
            .agg(F.max("o_orderdate").alias("last_update_ts"))
        )

    @cached_property
    def qmin_resolver(self) -> DataFrame:
        k = F.col("o_orderkey")
        state = F.when(F.col("o_orderstatus") == "F", "yes").when(F.col("o_orderstatus") == "O", "no").otherwise("unstable")
        newest = F.max_by(F.struct("o_orderkey", "o_orderstatus", "o_orderdate"), F.struct("o_orderdate", "o_orderkey"))
        return (
            self.raw("orders").where(F.col("o_custkey") % 50 != 1).groupBy("o_custkey").agg(newest.alias("n"))
            .select(F.col("o_custkey").alias("resolver_id"), "n.*")
            .select(
                "resolver_id",
                state.alias("qmin"),
                F.when(k % 7 != 0, k % 16).cast("int").alias("max_minimise_count"),
                (k % 5).cast("int").alias("minimize_one_lab"),
                F.col("o_orderdate").alias("last_update_ts"),
                F.when(state == "yes", F.col("o_orderdate")).alias("first_qmin_observation"),
                F.when(state == "yes", F.col("o_orderdate")).alias("last_qmin_observation"),
                F.lit("qmin-scan").alias("source"),
            )
        )

    @cached_property
    def dnssec_resolver(self) -> DataFrame:
        k = F.col("c_custkey")
        return self.raw("customer").where(k % 5 == 0).select(
            *v4_key(rip(k)), (k % 2 == 0).alias("validates"), F.lit("2020-07-01").cast("timestamp").alias("last_update_ts")
        )

    @cached_property
    def dnssec_country(self) -> DataFrame:
        pos = F.count_if(F.col("c_acctbal") > 0)
        part = F.count_if(F.col("c_acctbal") > 5000)
        whole = F.count(F.lit(1))
        return self.raw("customer").groupBy("c_nationkey").agg(
            pos.alias("validating"),
            F.round(pos * 100.0 / whole, 2).cast("double").alias("validating_pc"),
            part.alias("partial_validating"),
            F.round(part * 100.0 / whole, 2).cast("double").alias("partial_validating_pc"),
        ).select(
            iso(F.col("c_nationkey")).alias("country"), "validating", "validating_pc", "partial_validating",
            "partial_validating_pc", F.lit("2020-08-01").cast("timestamp").alias("last_update_ts"),
            F.lit("dnssec-stats").alias("source"),
        )

    @cached_property
    def country_location(self) -> DataFrame:
        n = F.col("n_nationkey")
        return self.raw("nation").where(n % 6 != 5).select(
            iso(n).alias("country"),
            (n * 3 - 30).cast("double").alias("latitude"),
            (n * 7 - 80).cast("double").alias("longitude"),
        )

    # ---- anycast ---------------------------------------------------------------------

    @staticmethod
    def supplier_net(k: Column) -> tuple[Column, Column]:
        length = (F.lit(12) + k % 9).cast("int")
        return mask(aip(k), length), length

    @cached_property
    def anycast(self) -> DataFrame:
        net, length = self.supplier_net(F.col("s_suppkey"))
        return (
            self.raw("supplier").select(net.alias("net"), length.alias("len"), "s_acctbal")
            .groupBy("net", "len").agg(F.bool_or(F.col("s_acctbal") < 0).alias("partial"))
            .select(
                *prefix_key(F.col("net"), F.col("len")),
                prefix_text(F.col("net"), F.col("len")).alias("backing_prefix"),
                "partial",
                F.lit("2020-09-01").cast("timestamp").alias("last_update_ts"),
                F.lit("census").alias("source"),
            )
        )

    @cached_property
    def anycast_v6(self) -> DataFrame:
        k = F.col("s_suppkey")
        length = F.when(k % 3 == 0, 64).when(k % 3 == 1, 60).otherwise(56)
        g4 = mask32 = F.call_function("shiftleft", F.call_function("shiftright", k % 63 + 1, 64 - length), 64 - length)
        text = F.concat(
            F.when(mask32 == 0, F.lit("2001:db8::/")).otherwise(F.concat(F.lit("2001:db8:0:"), F.lower(F.hex(g4)), F.lit("::/"))),
            length.cast("string"),
        )
        return self.raw("supplier").select(
            text.alias("prefix"), F.lit(6).cast("tinyint").alias("family"), length.alias("masklen"),
            (F.lit(2306139568115548160) + g4).alias("net_hi"), F.lit(0).cast("bigint").alias("net_lo"),
        ).distinct()

    @cached_property
    def anycast_asn(self) -> DataFrame:
        k = F.col("s_suppkey")
        net, length = self.supplier_net(k)
        return self.raw("supplier").select(prefix_text(net, length).alias("prefix"), (F.lit(64496) + k % 97).alias("asn")).distinct()

    @cached_property
    def _line_orders(self) -> DataFrame:
        return self.raw("lineitem").join(self._order_customers, "l_orderkey")

    @property
    def _order_customers(self) -> DataFrame:
        return self.raw("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")

    @cached_property
    def _lines(self) -> DataFrame:
        """Lines with their customers, as ``lines_written`` writes them."""
        return self._line_orders.select("l_suppkey", "l_partkey", "o_custkey", "l_shipdate")

    def lines_written(self) -> "Fixtures":
        """The same relations, with the lines and their customers joined and written once: for queries in which several
        relations read them, each of which would send all lines through a join of its own."""
        out = Fixtures(self.spark, self.dir)
        out._lines = materialise(self._lines)
        return out

    def _backend(self, column: Column, name: str, count: str) -> DataFrame:
        net, length = self.supplier_net(F.col("l_suppkey"))
        rows = self._lines
        if name == "country":
            rows = rows.join(self.raw("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
        return (
            rows.groupBy(prefix_text(net, length).alias("prefix"), column.alias(name))
            .agg(F.count_distinct("l_partkey").alias(count))
            .withColumns({
                "last_update_ts": F.lit("2020-09-01").cast("timestamp"),
                "source": F.lit("census"),
            })
        )

    @cached_property
    def anycast_country_backend(self) -> DataFrame:
        return self._backend(iso(F.col("c_nationkey")), "country", "country_count")

    @cached_property
    def anycast_asn_backend(self) -> DataFrame:
        return self._backend(F.lit(64496) + F.col("o_custkey") % 97, "asn", "asn_count")

    # ---- spoofing --------------------------------------------------------------------

    @cached_property
    def spoofing(self) -> DataFrame:
        net = mask(F.lit(16777216).cast("bigint") + (F.col("user_id") * 104729) % 16777216, 16)
        newest = F.max_by(F.struct("event_id", "event_type", "ts"), F.struct("ts", "event_id"))
        kind, n = F.col("event_type"), F.col("event_id") % 4
        return (
            self.raw("events").withColumn("net", net).groupBy("net").agg(newest.alias("e"))
            .select("net", "e.*")
            .select(
                *prefix_key(F.col("net"), 16),
                (F.col("event_id") % 2 == 0).alias("nat"),
                F.when(kind == "click", "blocked").when(kind == "view", "unknown")
                .when(kind == "error", "Received").when(kind == "purchase", "rewritten").alias("privatespoof"),
                F.when(n == 0, "received").when(n == 1, "blocked").when(n == 2, "unknown").alias("routedspoof"),
                F.col("ts").alias("last_update_ts"),
                F.lit("spoof-sessions").alias("source"),
            )
        )

    @cached_property
    def spoofing_asn(self) -> DataFrame:
        n = F.shiftright("net_lo", 16)
        return self.spoofing.where(n % 5 != 0).select("prefix", (F.lit(64496) + n % 97).alias("asn"))

    @cached_property
    def spoofing_country(self) -> DataFrame:
        n = F.shiftright("net_lo", 16)
        return self.spoofing.where(n % 7 != 0).select("prefix", iso(n % 25).alias("country"))

    # ---- forwarders ------------------------------------------------------------------

    @cached_property
    def forwarder(self) -> DataFrame:
        k = F.col("p_partkey")
        kind = F.when(F.col("p_size") % 3 == 0, "transparent").otherwise("recursive")
        seen = F.lit("2020-05-01").cast("timestamp")
        return self.raw("part").select(
            *v4_key(F.lit(33554432).cast("bigint") + (k * 7927) % 16777216),
            k.alias("forwarder_id"),
            (F.col("p_size") % 2 == 0).alias("is_public"),
            seen.alias("last_update_ts"),
            kind.alias("type"),
            F.when(kind == "transparent", 1).otherwise(0).cast("bigint").alias("transparent_count"),
            F.when(kind == "recursive", 1).otherwise(0).cast("bigint").alias("recursive_count"),
            F.when(kind == "recursive", seen).alias("last_observed_as_recursive"),
            F.when(kind == "transparent", seen).alias("last_observed_as_transparent"),
            F.lit("scan").alias("source"),
        )

    def _forwarder_attribute(self, keep: Column, *cols: Column) -> DataFrame:
        return self.raw("part").where(keep).select(
            F.col("p_partkey").alias("forwarder_id"), *cols, F.lit("2020-05-01").cast("timestamp").alias("last_update_ts")
        )

    @cached_property
    def forwarder_asn(self) -> DataFrame:
        k = F.col("p_partkey")
        return self._forwarder_attribute(k % 9 != 0, (F.lit(64496) + k % 53).alias("asn"))

    @cached_property
    def forwarder_location(self) -> DataFrame:
        k = F.col("p_partkey")
        return self._forwarder_attribute(
            k % 8 != 0, iso(F.col("p_size") % 25).alias("country"), F.lit(None).cast("string").alias("city")
        )

    @cached_property
    def forwarder_protocol(self) -> DataFrame:
        flag = F.col("l_returnflag")
        return (
            self.raw("lineitem").where(flag.isin("R", "A"))
            .groupBy(F.col("l_partkey").alias("forwarder_id"), F.when(flag == "R", "udp").otherwise("TCP").alias("protocol"))
            .agg(F.max("l_shipdate").alias("last_update_ts"))
        )

    @cached_property
    def forwarder_resolver_upstream(self) -> DataFrame:
        return (
            self._lines.where(F.col("o_custkey") % 50 != 1)
            .groupBy(F.col("l_partkey").alias("forwarder_id"), F.col("o_custkey").alias("upstream_resolver_id"))
            .agg(F.max("l_shipdate").alias("last_update_ts"))
        )

    @cached_property
    def forwarder_forwarder_upstream(self) -> DataFrame:
        return (
            self.raw("lineitem").where(F.col("l_partkey") != F.col("l_suppkey"))
            .groupBy(F.col("l_partkey").alias("forwarder_id"), F.col("l_suppkey").alias("upstream_forwarder_id"))
            .agg(F.max("l_shipdate").alias("last_update_ts"))
        )

    # ---- scan ------------------------------------------------------------------------

    @cached_property
    def scan(self) -> DataFrame:
        part, order, supp = F.col("l_partkey"), F.col("l_orderkey"), F.col("l_suppkey")
        kind = F.when(part % 3 == 0, "Resolver").when(part % 3 == 1, "Forwarder").otherwise("Transparent Forwarder")
        other = F.lit(50331648).cast("bigint") + (supp * 104729) % 16777216
        reply = (
            F.when(part % 3 == 0, pip(part))
            .when(part % 3 == 1, F.when(order % 2 == 0, pip(part)).otherwise(pip(part - 1)))
            .when(order % 4 == 0, aip(supp) + 1).when(order % 4 == 1, pip(part + 1))
            .when(order % 4 == 2, pip(part - 1)).otherwise(other)
        )
        backend = F.when(order % 23 == 0, F.lit(None)).when(order % 5 == 0, pip(part - part % 3)).otherwise(rip(F.col("o_custkey")))
        out = self.spread_join("lineitem", self._order_customers, "l_orderkey").select(
            (order * 10 + F.col("l_linenumber")).alias("row_id"),
            kind.alias("resolver_type"),
            pip(part).alias("queried"), reply.alias("replying"), backend.alias("backend"),
            F.when(F.col("l_returnflag") == "R", "udp").when(F.col("l_returnflag") == "A", "tcp").alias("protocol"),
            F.when(order % 29 != 0, F.col("l_shipdate")).alias("timestamp_request"),
        )
        for name in ("queried", "replying", "backend"):
            label = "backend_resolver" if name == "backend" else f"{name}_ip"
            n = F.col(name)
            out = out.withColumns({
                label: F.when(n.isNotNull(), v4_text(n)),
                f"{label}_family": F.when(n.isNotNull(), F.lit(4).cast("tinyint")),
                f"{label}_hi": F.when(n.isNotNull(), F.lit(0).cast("bigint")),
                f"{label}_lo": n,
                # attributes are functions of the address, so any row of an address tells the same
                f"{label}_asn": F.when(n % 31 != 0, F.lit(64496) + n % 89),
                f"{label}_prefix": F.when(n.isNotNull(), prefix_text(mask(n, 16), 16)),
                f"{label}_org": F.when(n % 3 != 0, F.concat(F.lit("Org-"), (n % 11).cast("string"), F.lit(" Ltd"))),
                f"{label}_country": F.when(n % 41 != 0, iso(n % 25)),
            })
        return out.drop("queried", "replying", "backend")

    @cached_property
    def census(self) -> DataFrame:
        """Census rows with detection counters, as a feed would deliver them."""
        k = F.col("s_suppkey")
        net, length = self.supplier_net(k)
        locations = F.transform(
            F.sequence(F.lit(0), (k % 5).cast("int")),
            lambda i: F.struct(iso((F.col("s_nationkey") + i * (k % 3)) % 25).alias("country_code"), i.alias("site")),
        )
        return self.raw("supplier").select(
            prefix_text(net, length).alias("prefix"),
            F.when(k % 4 != 0, prefix_text(mask(aip(k), 12), 12)).alias("backing_prefix"),
            (F.col("s_acctbal") < 0).alias("partial"),
            F.when(k % 10 == 0, "-").when(k % 2 == 0, (F.lit(64496) + k % 97).cast("string"))
            .otherwise(F.concat((F.lit(64496) + k % 97).cast("string"), F.lit("_"), (F.lit(64496) + k % 13).cast("string"))).alias("ASN"),
            F.when(k % 6 != 0, locations).alias("locations"),
            (k % 7).cast("int").alias("AB_icmp"),
            (k % 9).cast("int").alias("AB_tcp"),
            (k % 3).cast("int").alias("GCD_icmp"),
            (k % 4).cast("int").alias("GCD_tcp"),
        )

    @cached_property
    def data_source(self) -> DataFrame:
        return self.raw("customer").select(F.lower("c_mktsegment").alias("source")).distinct().where(
            F.col("source") != "machinery"
        ).select(
            "source", F.lit("2020-01-01").cast("date").alias("date_added"),
            F.concat(F.lit("list of "), F.col("source")).alias("description"),
            F.lit(False).alias("apikey_required"), F.lit(None).cast("timestamp").alias("last_retrieved_ts"),
        )
