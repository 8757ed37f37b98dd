"""What the classification of a scan sends to other tasks."""

import random

from pyspark.sql import functions as F

from resolvescope.plans import scan
from tests.test_pages_and_state import probes

CENSUS = [("10.0.1.0/24", 5, 5), ("10.0.0.0/22", 4, 2)]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def moved(text, column):
    return [line for line in text.splitlines() if column in line and ("Aggregate" in line or "Join" in line)]


def test_probes_are_not_sent_with_the_attributes_of_all_their_addresses(spark):
    census = spark.createDataFrame(CENSUS, "prefix string, AB_x int, GCD_x int")
    seen = []

    def cut(df):
        seen.append(plan(df))
        return df

    feeds = scan.classify_scan(probes(spark, random.Random(4), 30), census, cut=cut)
    assert seen and not [line for text in seen for line in moved(text, "_org")]
    for frame, others in ((feeds.closed_from_transparent_reply(), ("queried_ip_org", "backend_resolver_org")),
                          (feeds.anycast_asn_evidence(), ("_org", "_country", "replying_ip_asn")), (feeds.resolver_addresses, ("_org", "_asn"))):
        assert not [line for name in others for line in moved(plan(frame), name)]


def test_roles_of_addresses(spark):
    rows = probes(spark, random.Random(5), 400)
    covered = {"10.0.1.3", "10.0.1.4", "10.0.2.5"}
    anycast = rows.where(F.col("replying_ip").isin(*covered)).select(
        F.col("replying_ip_family").alias("family"), F.col("replying_ip_hi").alias("ip_hi"), F.col("replying_ip_lo").alias("ip_lo")).distinct()
    want = {}
    for r in rows.where(F.col("queried_ip").isNotNull()).collect():
        forwards = r.resolver_type == scan.FORWARDER
        facts = (r.resolver_type == scan.RESOLVER or (forwards and r.queried_ip in covered), forwards, forwards and r.replying_ip not in covered)
        want[r.queried_ip_lo] = tuple(a or b for a, b in zip(facts, want.get(r.queried_ip_lo, (False,) * 3)))
    got = {r.ip_lo: (r.is_public, r.is_forwarder, r.is_plain_forwarder) for r in scan.address_roles(rows, anycast).collect()}
    assert got == want


def exchanges(spark, build):
    """How many times a plan sends rows by key, with no table small enough to broadcast."""
    kept = {name: spark.conf.get(name) for name in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    try:
        for name in kept:
            spark.conf.set(name, "-1")
        return build()._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    finally:
        for name, value in kept.items():
            spark.conf.set(name, value)


def test_what_a_rule_finds_is_rolled_up_where_it_was_looked_up(spark):
    census = spark.createDataFrame(CENSUS, "prefix string, AB_x int, GCD_x int")
    feeds = scan.classify_scan(probes(spark, random.Random(6), 30), census)
    # combinations of a task, the two sides of a lookup; backends look up the replying address before
    assert exchanges(spark, feeds.public_resolvers) == 3
    assert exchanges(spark, feeds.closed_from_transparent_reply) == 3
    assert exchanges(spark, feeds.closed_from_transparent_backend) == 5


def test_forwarders_are_sent_once_for_their_roll_up(spark):
    census = spark.createDataFrame(CENSUS, "prefix string, AB_x int, GCD_x int")
    feeds = scan.classify_scan(probes(spark, random.Random(7), 30), census).write_resolvers()
    assert exchanges(spark, feeds.transparent_forwarders) == 1
    # public ones: two sides of a lookup, the roll-up; closed ones: the resolvers, and the two sides without them
    assert exchanges(spark, feeds.recursive_forwarders) == 6


def test_resolvers_written_for_several_feeds_are_those_of_the_rules(spark):
    census = spark.createDataFrame(CENSUS, "prefix string, AB_x int, GCD_x int")
    rows, cuts = probes(spark, random.Random(10), 300), []
    feeds = scan.classify_scan(rows, census)
    written = scan.classify_scan(rows, census).write_resolvers(lambda df: cuts.append(df) or scan.materialise(df))
    assert len(cuts) == 1
    for feed in ("resolvers", "resolver_addresses"):
        assert sorted(map(str, getattr(written, feed).collect())) == sorted(map(str, getattr(feeds, feed).collect()))
    assert sorted(map(str, written.recursive_forwarders().collect())) == sorted(map(str, feeds.recursive_forwarders().collect()))
    # the second feed starts from the written rows, not from the rules again
    assert plan(written.resolver_addresses).count("Join") == 0 < plan(feeds.resolver_addresses).count("Join")


def test_attributes_sent_as_one_text_come_back(spark):
    texts = [None, "", "=", "~16", "~", "/16", "a\x01b", "\x02\x04", "\x02", "10.0.0.0/16", "10.0.0.0/016", "10.0.0.0/99", "1.2.0.0/16", "::/0"]
    rows = spark.createDataFrame([(t, p, n) for t in texts for p in texts for n in (None, 5)], "text string, prefix string, asn long")
    named = [F.lit("10.0.1.3"), F.lit(4).cast("tinyint"), F.lit(0).cast("long"), F.lit(167772419).cast("long")]
    columns = {}
    for name in scan.ADDRESSES:
        columns |= {c: v for c, v in zip((name, *[f"{name}_{k}" for k in ("family", "hi", "lo")]), named)}
        columns |= {f"{name}_asn": F.col("asn"), f"{name}_prefix": F.col("prefix"), f"{name}_org": F.col("text"), f"{name}_country": F.col("text")}
    wide = scan.in_short(rows.withColumns({"resolver_type": F.col("text"), "protocol": F.col("text"), **columns}))
    wide = wide.withColumn("timestamp_request", F.lit("2024-01-01").cast("timestamp"))
    want = [str(tuple(r)) for r in scan.distinct_probes(wide).collect()]
    got = scan.distinct_in_short(wide)
    assert got.columns == scan.distinct_probes(wide).columns and got.count() == len(want)
    assert sorted(str(tuple(r)) for r in got.collect()) == sorted(want)


def test_a_snapshot_is_sent_once_to_join_the_state(spark, tmp_path, monkeypatch):
    census = spark.createDataFrame(CENSUS, "prefix string, AB_x int, GCD_x int")
    draw, seen, inner = random.Random(8), [], scan.write_versions

    def spied(session, root, frames, *more):
        seen.append(exchanges(spark, lambda: frames["scan_probes"]))
        return inner(session, root, frames, *more)

    monkeypatch.setattr(scan, "write_versions", spied)
    for _ in range(2):
        cuts = []
        state = scan.add_snapshot(spark, str(tmp_path), probes(spark, draw, 40), census, cut=lambda df: cuts.append(df) or scan.materialise(df))
        assert len(cuts) == 4  # the snapshot, and three tables of addresses; none of the merged state
    assert seen == [1, 1]
    assert state.probes.count() == state.probes.drop("timestamp_request").distinct().count()


def test_addresses_in_short_can_be_written_out_again(spark):
    texts = ["10.0.1.3", "010.0.1.3", "::1", "no address", "", None]
    rows = spark.createDataFrame([(t, *key) for t, key in zip(texts, [(4, 0, 167772419), (4, 0, 167772419), (6, 0, 1), *[(None,) * 3] * 3])],
                                 "ip string, family tinyint, hi long, lo long")
    named = [c for name in scan.ADDRESSES for c in (F.col("ip").alias(name), *[F.col(k).alias(f"{name}_{k}") for k in ("family", "hi", "lo")])]
    short = scan.in_short(rows.select(*named))
    assert [r.replying_ip for r in short.collect()] == [None, *texts[1:]]
    assert [r.replying_ip for r in scan.in_short(short).collect()] == [None, *texts[1:]]
    assert [r.replying_ip for r in scan.written_out(short).collect()] == texts


def test_lines_of_the_scan_are_sent_once(spark, fx):
    assert exchanges(spark, lambda: fx.scan) == 2
    assert "Exchange RoundRobin" not in fx.scan._jdf.queryExecution().executedPlan().toString()
