"""A part of the registered queries against DuckDB; tools/check_oracle.py runs all of them."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = [
    "j01_prefix_join", "j03_prefix_match", "q01_resolver_records", "q04_records_by_service", "q06_alternative_members", "q11_resolver_spoofing", "q14_qmin_by_asn",
    "q17_risk_prefixes_global", "q20_country_counts", "q23_spoofing_countries", "q29_top_anycast", "q31_global_protocols", "q36_forwarder_relays",
    "m01_merge_resolver", "m08_merge_forwarder", "m13_merge_spoofing_asn", "p08_resolver_feed", "p12_missing_targets", "c12_clean_country",
]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(value):
    value = value.item() if hasattr(value, "item") else value
    return round(float(value), 6) if type(value).__name__ in ("float", "Decimal") else value


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_duckdb(spark, db, name):
    frame = entry.queries()[name](spark, SF)
    cursor = db.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(frame.columns) == sorted(names)
    want = sorted(([plain(row[names.index(c)]) for c in sorted(names)] for row in cursor.fetchall()), key=repr)
    assert sorted(([plain(row[c]) for c in sorted(names)] for row in frame.collect()), key=repr) == want


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 5
