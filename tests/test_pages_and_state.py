"""Pages of a written report, and the state of snapshots that are added one after the other."""

import os
import random

import pytest
from pyspark.sql import functions as F

from resolvescope.functions.net import with_ip_key
from resolvescope.operators import pages
from resolvescope.operators.rows import page
from resolvescope.plans import scan


def plain(df):
    return sorted(map(repr, df.collect()))


def test_page_ten_thousand_reads_one_range(spark, tmp_path):
    path = str(tmp_path / "report")
    rows = spark.range(30_010).select(((F.col("id") * 7919) % 30_011).alias("n"), (F.col("id") % 5).alias("kind"))
    order = [F.col("n").desc()]
    pages.write_pages(rows, order, path, range_rows=1000)
    for number in (1, 2, 777, 10_000, 10_004, 10_005):
        got = pages.read_page(spark, path, order, number, 3)
        want = page(rows, [F.col("n").desc(), F.col("kind")], number, 3)
        assert plain(got.drop("rank")) == plain(want)
        assert [r["rank"] for r in got.orderBy("rank").collect()] == list(range(3 * number - 2, 3 * number - 2 + want.count()))
        if want.count():
            assert len({os.path.dirname(f) for f in got.inputFiles()}) <= 2
    assert len({os.path.dirname(f) for f in pages.read_page(spark, path, order, 10_000, 3).inputFiles()}) == 1


def test_pages_of_groups_ties_and_nulls(spark, tmp_path):
    draw = random.Random(2)
    rows = spark.createDataFrame([(draw.choice(["a", "a", "a", "b", "c", None]), draw.choice([1, 2, None]), i % 40) for i in range(600)], "g string, v int, x int")
    order, path = [F.col("v").asc_nulls_last()], str(tmp_path / "report")
    pages.write_pages(rows, order, path, by=["g"], range_rows=50)
    total = [F.col("v").asc_nulls_last(), F.col("v").asc_nulls_last(), F.col("x").asc_nulls_last()]
    for name in ("a", "b", None):
        for number in (1, 3, 50):
            got = pages.read_page(spark, path, order, number, 7, {"g": name})
            want = page(rows, total, number, 7, by=["g"]).where(F.col("g").eqNullSafe(F.lit(name)))
            assert sorted((repr(r.v), r.x, r["rank"]) for r in got.collect()) == sorted((repr(r.v), r.x, r["rank"]) for r in want.collect())
    pages.write_pages(rows.limit(0), order, str(tmp_path / "none"))
    assert pages.read_page(spark, str(tmp_path / "none"), order).count() == 0


def test_small_ranges_are_not_a_file_each(spark, tmp_path):
    path, order = str(tmp_path / "report"), [F.col("n").desc()]
    rows = spark.range(5_000).select(((F.col("id") * 7919) % 4_999).alias("n"), (F.col("id") % 3).alias("kind"))
    pages.write_pages(rows, order, path, by=["kind"], range_rows=10)
    assert sum(f.endswith(".parquet") for _, _, files in os.walk(f"{path}/rows") for f in files) <= 8
    assert spark.read.parquet(f"{path}/index").select("range_no").distinct().count() >= 500
    for kind, number in ((0, 1), (1, 77), (2, 238), (2, 300)):
        got = pages.read_page(spark, path, order, number, 7, {"kind": kind})
        want = page(rows, [F.col("n").desc()], number, 7, by=["kind"]).where(F.col("kind") == kind)
        assert sorted((r.n, r["rank"]) for r in got.collect()) == sorted((r.n, r["rank"]) for r in want.collect())


def probes(spark, draw, n):
    address = lambda: draw.choice([None, *[f"10.0.{draw.randrange(3)}.{draw.randrange(12)}" for _ in range(9)]])
    rows = []
    for _ in range(n):
        ips = [address() for _ in range(3)]
        rows.append((draw.choice([scan.RESOLVER, scan.FORWARDER, scan.TRANSPARENT]), draw.choice(["udp", "tcp"]), f"2024-01-{draw.randrange(1, 28):02} 00:00:00", *ips, *[draw.choice([None, "x", "y"]) for _ in range(9)], *[draw.choice([None, 5, 6]) for _ in range(3)]))
    names = [f"{c}_{a}" for c in scan.ADDRESSES for a in ("prefix", "org", "country")] + [f"{c}_asn" for c in scan.ADDRESSES]
    df = spark.createDataFrame(rows, "resolver_type string, protocol string, ts string, " + ", ".join(f"{c} string" for c in scan.ADDRESSES) + ", " + ", ".join(f"{c} {'long' if c.endswith('asn') else 'string'}" for c in names))
    df = df.withColumn("timestamp_request", F.col("ts").cast("timestamp")).drop("ts")
    for c in scan.ADDRESSES:
        df = with_ip_key(df, c, out=c, v6=False)
    return df


@pytest.mark.parametrize("strict", [False, True])
def test_snapshots_one_after_the_other_equal_both_at_once(spark, tmp_path, strict):
    draw = random.Random(9 + strict)
    first, second = probes(spark, draw, 150), probes(spark, draw, 150)
    census = spark.createDataFrame([("10.0.1.0/24", 5, 5), ("10.0.0.0/22", 4, 2), ("10.0.2.0/24", 0, 0)], "prefix string, AB_x int, GCD_x int")
    both = scan.classify_scan(first.unionByName(second), census, strict)
    scan.add_snapshot(spark, str(tmp_path), first, census)
    kept = scan.classify_state(scan.add_snapshot(spark, str(tmp_path), second, census), strict)
    for feed in ("resolvers", "resolver_addresses"):
        assert plain(getattr(kept, feed)) == plain(getattr(both, feed))
    for feed in ("recursive_forwarders", "transparent_forwarders", "anycast_country_evidence", "anycast_asn_evidence", "spoofing_evidence", "missing_targets"):
        assert plain(getattr(kept, feed)()) == plain(getattr(both, feed)())
    parts = [both.public_resolvers(), both.closed_from_forwarders(), both.closed_from_transparent_backend(), both.closed_from_transparent_reply()]
    rules = [part.withColumn("is_public", F.lit(i == 0)) for i, part in enumerate(parts)]
    stacked = rules[0].unionByName(rules[1]).unionByName(rules[2]).unionByName(rules[3])
    assert plain(both.resolvers.select(*stacked.columns)) == plain(stacked)
