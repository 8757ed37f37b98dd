import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from resolvescope.catalog import TABLES, Catalog
from resolvescope.operators.merge import assign_ids, ip_bucket
from resolvescope.functions.net import address_order, with_ip_key
from resolvescope.plans import imports as m

OLD, MID, NEW = (dt.datetime(2020, 1, d) for d in (1, 10, 20))


def now():
    return F.lit("2030-01-01").cast("timestamp")


def frame(spark, table, rows):
    schema = T.StructType.fromDDL(TABLES[table])
    return spark.createDataFrame([tuple(r.get(n) for n in schema.names) for r in rows], schema)


def attribute_rows(spark, rows):
    return spark.createDataFrame(rows, "resolver_id bigint, asn bigint, last_update_ts timestamp")


@pytest.mark.parametrize("force", [False, True])
def test_attribute_policy(spark, force):
    current = frame(spark, "resolver_asn", [{"resolver_id": i, "asn": 1, "last_update_ts": MID} for i in range(1, 6)])
    batch = attribute_rows(spark, [(1, 1, OLD), (2, 9, OLD), (3, 1, NEW), (4, 9, None), (6, 7, None), (7, None, NEW)])
    result = m.merge_attribute(current, batch, ["asn"], force=force, now=now())
    got = {r.resolver_id: (r.asn, r.last_update_ts) for r in result.table.collect()}
    later = dt.datetime(2030, 1, 1)
    assert got == {
        1: (1, OLD if force else MID),  # same value, older: only a forced import moves the stamp back
        2: (9, OLD),  # another value is taken even from an older batch
        3: (1, NEW),
        4: (9, later),
        5: (1, MID),
        6: (7, later),
    }
    report = result.report.first()
    assert (report.inserted, report.updated, report.skipped) == (1, 4 if force else 3, 0 if force else 1)


def test_merging_twice_changes_nothing(spark):
    current = frame(spark, "resolver_asn", [{"resolver_id": 1, "asn": 1, "last_update_ts": MID}])
    batch = attribute_rows(spark, [(1, 5, NEW), (2, 6, NEW), (2, 7, NEW)])
    once = m.merge_attribute(current, batch, ["asn"], now=now())
    twice = m.merge_attribute(once.table, batch.repartition(3, "asn"), ["asn"], now=now())
    assert sorted(once.table.collect()) == sorted(twice.table.collect())
    assert twice.report.first().updated == 0


def test_qmin_stamp_never_goes_back(spark):
    resolver = frame(spark, "resolver", [{"ip": f"1.1.1.{i}", "family": 4, "ip_hi": 0, "ip_lo": 16843008 + i, "resolver_id": i} for i in (1, 2, 3)])
    current = frame(spark, "qmin_resolver", [
        {"resolver_id": 1, "qmin": "no", "last_update_ts": MID, "source": "a"},
        {"resolver_id": 2, "qmin": "yes", "last_update_ts": MID, "first_qmin_observation": OLD, "last_qmin_observation": MID, "source": "a"},
    ])
    landed = spark.createDataFrame(
        [("1.1.1.1", "1", "2020-01-05"), ("1.1.1.2", "1.0", "2020-01-20T00:00:00Z"), ("1.1.1.3", "1", "2020-01-20"), ("9.9.9.9", "0", "2020-01-20"), ("bad", "0", "")],
        "resolver_ip string, qmin string, ts string")
    tables = Catalog(spark, "/nonexistent").set("resolver", resolver).set("qmin_resolver", current)
    result = m.import_qmin(tables, landed, "resolver_ip:resolver_ip,qmin:qmin,last_update_ts:ts", "b")
    got = {r.resolver_id: (r.qmin, r.last_update_ts, r.first_qmin_observation, r.last_qmin_observation) for r in result.table("qmin_resolver").collect()}
    assert got == {1: ("yes", MID, None, None), 2: ("yes", NEW, OLD, NEW), 3: ("yes", NEW, NEW, NEW)}
    report = result.report("qmin").first()
    assert (report.candidates, report.matched, report.missing_resolver, report.inserted, report.updated) == (4, 3, 1, 1, 2)


def test_import_resolvers_end_to_end(spark):
    landed = spark.createDataFrame(
        [("1.1.1.1", "yes", "a"), ("1.1.1.1", "no", "b"), ("2001:DB8::1", "no", ""), ("oops", "yes", "c")], "addr string, open string, src string")
    result = m.import_resolvers(Catalog(spark, "/nonexistent"), landed, "ip:addr,is_public:open,source:src", "resolver", "list", verified=True, now=now())
    rows = {r.ip: (r.resolver_id, r.is_public, r.source) for r in result.table("resolver").collect()}
    assert rows == {"1.1.1.1": (1, True, "a"), "2001:db8::1": (2, False, "list")}
    report = {r.module: r for r in result.report().collect()}
    assert (report["resolver"].candidates, report["resolver"].inserted, report["resolver"].duplicate) == (3, 2, 1)
    assert (report["input"].rows, report["input"].invalid_ip) == (4, 1)
    assert {(r.resolver_id, r.verifying_source) for r in result.table("resolver_verification").collect()} == {(1, "a"), (2, "list")}


def test_mapping_errors(spark):
    df = spark.createDataFrame([("1.1.1.1",)], "addr string")
    for mapping, modules in (("ip:addr,nope:addr", "resolver"), ("ip:addr", "asn"), ("ip:missing", "resolver"), ("ip", "resolver"), ("", "resolver")):
        with pytest.raises(ValueError):
            m.import_resolvers(None, df, mapping, modules, "list")


def test_ids_are_dense_and_independent_of_partitions(spark):
    rows = with_ip_key(spark.range(1000).select(F.concat(F.lit("10."), (F.col("id") % 7).cast("string"), F.lit("."), F.floor(F.col("id") / 7).cast("string"), F.lit(".1")).alias("ip")))
    ids = lambda df: {r.ip: r.n for r in assign_ids(df, F.lit(50), ip_bucket(), address_order(), "n").collect()}
    first, second = ids(rows), ids(rows.repartition(9))
    assert first == second and sorted(first.values()) == list(range(51, 1051))
    by_address = sorted(first, key=lambda ip: tuple(map(int, ip.split("."))))
    assert [first[ip] for ip in by_address] == list(range(51, 1051))


def test_versions_and_stream(spark, tmp_path):
    from resolvescope.sources.versions import open_catalog
    from resolvescope.streaming.sessions import dedupe_session_stream, merge_stream

    inbox, root = tmp_path / "in", str(tmp_path / "tables")
    for i, line in enumerate(("1.1.1.1", "1.1.1.2")):
        spark.createDataFrame([(line,)], "ip string").coalesce(1).write.mode("append").json(str(inbox))
    job = lambda t, batch: m.import_resolvers(t, batch, "ip:ip", "resolver", "list", now=now())
    query = merge_stream(spark.readStream.schema("ip string").option("maxFilesPerTrigger", 1).json(str(inbox)), root, str(tmp_path / "ck"), job)
    query.awaitTermination()
    assert {r.ip for r in open_catalog(spark, root).resolver.collect()} == {"1.1.1.1", "1.1.1.2"}
    sessions = spark.createDataFrame([("a", NEW), ("a", NEW), ("b", NEW)], "session string, ts timestamp")
    sessions.write.parquet(str(tmp_path / "s"))
    stream = dedupe_session_stream(spark.readStream.schema(sessions.schema).parquet(str(tmp_path / "s")))
    out = stream.writeStream.format("memory").queryName("sessions_once").trigger(availableNow=True).start()
    out.awaitTermination()
    assert spark.table("sessions_once").count() == 2


def test_interrupted_commit_leaves_the_tables_as_they_were(spark, tmp_path):
    from resolvescope.sources.versions import commit_import, open_catalog

    root = str(tmp_path / "tables")
    load = lambda ips: m.import_resolvers(open_catalog(spark, root), spark.createDataFrame([(ip,) for ip in ips], "ip string"), "ip:ip", "resolver", "list", now=now())
    commit_import(spark, root, load(["1.1.1.1"]))

    class Breaks:
        table_names = ["resolver", "resolver_identity"]

        def __init__(self, result):
            self.result = result

        def table(self, name):
            if name == "resolver_identity":
                return spark.createDataFrame([(1,)], "id long").select(m.F.raise_error(m.F.lit("lost")).alias("id"))
            return self.result.table(name)

    with pytest.raises(Exception):
        commit_import(spark, root, Breaks(load(["2.2.2.2"])))
    assert {r.ip for r in open_catalog(spark, root).resolver.collect()} == {"1.1.1.1"}
    commit_import(spark, root, load(["3.3.3.3", "4.4.4.4"]))
    ids = {r.ip: r.resolver_id for r in open_catalog(spark, root).resolver.collect()}
    assert ids.keys() == {"1.1.1.1", "3.3.3.3", "4.4.4.4"} and len(set(ids.values())) == 3


def test_unregistered_source_fails_an_import(spark):
    tables = Catalog(spark, "/nonexistent").set("data_source", spark.createDataFrame([("list",)], "source string").selectExpr("source", "cast(null as timestamp) last_retrieved_ts"))
    landed = spark.createDataFrame([("1.1.1.1", "list", "DE"), ("1.1.1.2", "rumour", "FR")], "ip string, source string, country string")
    load = lambda rows: m.import_resolvers(tables, rows, "ip:ip,source:source,country:country", "resolver,location", "list", now=now(), dimensions=m.Dimensions())
    with pytest.raises(ValueError, match="rumour"):
        load(landed)
    done = load(landed.where("source = 'list'"))
    assert [r.last_retrieved_ts is not None for r in done.table("data_source").collect()] == [True]
    sessions = spark.createDataFrame([("192.0.2.0/24", "x", "received", None)], "prefix string, privatespoof string, routedspoof string, nat boolean")
    with pytest.raises(ValueError, match="rumour"):
        m.import_spoofing(tables, sessions, "rumour", now=now(), dimensions=m.Dimensions())
    assert m.import_spoofing(tables, sessions, "list", now=now()).table("spoofing").count() == 1
    with pytest.raises(ValueError):
        m.import_spoofing(tables, sessions, "list", modules=["other"])
    with pytest.raises(ValueError):
        m.import_dnssec(tables, "list")
