"""Kept reports against the full ones, over random batches."""

import random

import pytest
from pyspark.sql import functions as F

from resolvescope.plans import imports as m
from resolvescope.plans import kept
from resolvescope.sources import versions

REPORTS = (kept.COUNTRY_COUNTS, kept.ASN_COUNTS)
COLUMNS = ["target", *[x.name for x in kept.COUNTRY_COUNTS.measures]]


def same(kept_frame, full_frame):
    rows = lambda df: sorted(tuple(r) for r in df.select(*COLUMNS).collect())
    assert rows(kept_frame) == rows(full_frame)
    return rows(kept_frame)


@pytest.mark.parametrize("buckets", [None, 8])
def test_three_batches(spark, tmp_path, buckets):
    root, draw = str(tmp_path / "tables"), random.Random(8)
    now = F.lit("2030-01-01").cast("timestamp")

    def landed(n):
        rows = [(f"10.0.0.{draw.randrange(60)}", draw.choice(["yes", "no"]), draw.choice(["DEU", "FRA", "ITA", None]), str(draw.randrange(1, 5)), draw.choice("abc"), f"2020-01-{draw.randrange(1, 28):02}") for _ in range(n)]
        return spark.createDataFrame(rows, "ip string, open string, country string, asn string, src string, ts string")

    def job(tables, batch):
        return m.import_resolvers(tables, batch, "ip:ip,is_public:open,country:country,asn:asn,source:src,last_update_ts:ts", "resolver,location,asn", "list", now=now)

    tables = versions.open_catalog(spark, root)
    versions.commit_import(spark, root, job(tables, landed(60)), tables)
    kept.keep(spark, root, REPORTS[:1], versions.open_catalog(spark, root))  # the other report starts with the first batch
    if buckets:
        versions.deal_into_buckets(spark, root, dict.fromkeys(("resolver", "resolver_location", "resolver_asn"), buckets))
    seen = []
    for size in (5, 20, 1):
        tables = versions.open_catalog(spark, root)
        kept.commit_with_reports(spark, root, job(tables, landed(size)), tables, REPORTS)
        tables = versions.open_catalog(spark, root)
        for report in REPORTS:
            seen.append(same(kept.read_report(report, kept.kept_state(tables, report)), kept.read_report(report, kept.full_state(report, tables))))
    assert seen[0] != seen[2] and len(seen) == 6


def test_a_delta_reads_only_touched_identities(spark):
    from resolvescope.catalog import Catalog

    tables = Catalog(spark, "/nonexistent")
    tables.set("resolver_location", spark.createDataFrame([(i, "DEU" if i % 2 else "FRA", None, None) for i in range(50)], tables.resolver_location.schema))
    tables.set("resolver", spark.createDataFrame([(f"10.0.0.{i}", 4, 0, i, i, True, None, "s") for i in range(50)], tables.resolver.schema))
    moved = spark.createDataFrame([(3, "ITA", None, None), (4, "FRA", None, None)], "resolver_id long, country string, city string, last_update_ts timestamp")
    result = m.ImportResult()
    result.add("location", "resolver_location", lambda: m.merge_location(tables.resolver_location, moved, now=F.lit("2030-01-01").cast("timestamp")))
    assert [r[0] for r in kept.touched_keys(kept.COUNTRY_COUNTS, result).collect()] == [3]
    delta = {(r.target, r.measure, r.value): r.n for r in kept.signed_delta(kept.COUNTRY_COUNTS, tables, result).collect()}
    assert delta[("DEU", "resolver_count", "")] == -1 and delta[("ITA", "identity_count", "3")] == 1 and {k[0] for k in delta} == {"DEU", "ITA"}
