"""Forwarders behind an address: counts, and what is sent to make them."""

import contextlib
import io
from types import SimpleNamespace

from resolvescope.plans import resolver_reports as r


def tables(spark):
    rows = lambda data, schema: spark.createDataFrame(data, schema)
    return SimpleNamespace(
        resolver=rows([("a", 1), ("b", 1), ("c", 2)], "ip string, resolver_id long"),
        forwarder=rows([("c", 50), ("d", 51)], "ip string, forwarder_id long"),
        forwarder_resolver_upstream=rows([(60, 1), (61, 1), (61, 1), (62, 1), (60, 2), (None, 2)], "forwarder_id long, upstream_resolver_id long"),
        forwarder_forwarder_upstream=rows([(60, 50), (63, 50), (63, 51)], "forwarder_id long, upstream_forwarder_id long"),
        forwarder_protocol=rows([(60, "udp"), (60, "TCP"), (61, "udp"), (63, "tcp")], "forwarder_id long, protocol string"),
        forwarder_asn=rows([(60, 7), (61, 7), (62, None), (63, 8)], "forwarder_id long, asn long"),
        forwarder_location=rows([(60, "DEU"), (61, "FRA"), (63, None)], "forwarder_id long, country string"),
    )


def test_relay_counts(spark):
    got = {row["ip"]: tuple(row)[1:] for row in r.forwarder_relays(tables(spark)).select("ip", *r.RELAY_COUNTS).collect()}
    assert got == {"a": (3, 1, 2, 1, 2, 1), "b": (3, 1, 2, 1, 2, 1), "c": (3, 2, 1, 2, 1, 1), "d": (1, 1, 0, 1, 0, 0)}
    by_country = sorted(map(tuple, r.forwarder_relays_by(tables(spark), "country").collect()))
    assert by_country == [("a", "DEU", 1), ("a", "FRA", 1), ("b", "DEU", 1), ("b", "FRA", 1), ("c", "DEU", 1)]


def test_relay_rows_are_not_sent_once_per_count(spark):
    said = io.StringIO()
    with contextlib.redirect_stdout(said):
        r.forwarder_relays(tables(spark)).explain()
    assert "Expand" not in said.getvalue()
    assert "REPARTITION_BY_COL" in said.getvalue()
