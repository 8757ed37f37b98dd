"""Relations made from the lines of orders, which the summaries join and write once."""

from collections import Counter

from workload.fixtures import Fixtures


def test_relations_read_the_lines_that_were_written(spark, tmp_path):
    day = "timestamp'2020-01-0"
    rows = {
        "lineitem": [f"{order} l_orderkey, {part} l_partkey, {supp} l_suppkey, 1 l_linenumber, 'R' l_returnflag, {day}{1 + i % 9}' l_shipdate"
                     for i, (order, part, supp) in enumerate([(1, 1, 1), (1, 1, 1), (2, 2, 1), (2, 3, 2), (3, 3, 2), ("null", 4, 1), (9, 5, 2), (3, "null", "null")])],
        "orders": [f"{order} o_orderkey, {customer} o_custkey" for order, customer in ((1, 10), (2, 11), (2, 12), (3, "null"), ("null", 13), (4, 51))],
        "customer": [f"{customer} c_custkey, {nation} c_nationkey" for customer, nation in ((10, 1), (11, 2), (11, 3), (12, "null"))],
    }
    for name, made in rows.items():
        spark.sql(" union all ".join(f"select {row}" for row in made)).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    joined = Fixtures(spark, str(tmp_path))
    written = joined.lines_written()
    for name in ("anycast_country_backend", "anycast_asn_backend", "forwarder_resolver_upstream"):
        old, new = getattr(joined, name), getattr(written, name)
        assert Counter(map(tuple, new.collect())) == Counter(map(tuple, old.collect())) and not old.isEmpty()
        assert not any("lineitem" in file or "orders" in file for file in new.inputFiles())
    assert written.scan.count() == joined.scan.count()
