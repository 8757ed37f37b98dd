import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from resolvescope.plans import feeds, scan
from resolvescope.sources import readers

LOOKUPS = [
    {"name": "1.2.3.4", "results": {
        "PTR": {"status": "NOERROR", "data": {"answers": [{"type": "PTR", "name": "4.3.2.1.in-addr.arpa", "answer": "Dns.Example.com."}],
                                              "additionals": [{"deep": {"type": "ptr", "target": "deep.example."}}]}},
        "SVCB": {"status": "NOERROR", "data": {"resolver": "[2001:db8::1]:53", "answers": [
            {"type": "SVCB", "target": "one.example.", "svcparams": {"alpn": ["h2", "h3"], "port": 443, "ipv4hint": "1.1.1.1, 2.2.2.2", "key7": "/q"}},
            {"name": "two.example", "svcparams": {"alpn": "dot"}}]}}}},
    {"name": "5.6.7.8", "results": {"PTR": {"status": "SERVFAIL", "data": {"answers": [{"type": "PTR", "answer": "no.example"}]}},
                                    "HTTPS": {"status": "NOERROR", "data": {"answers": [{"type": "HTTPS", "answer": "a.example."}]}}}},
]


def test_lookup_results(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text("\n".join(json.dumps(r) for r in LOOKUPS) + "\n\n")
    (tmp_path / "r.json").write_text(json.dumps(LOOKUPS))
    for name in ("r.jsonl", "r.json"):
        rows = readers.read_lookup_results(spark, str(tmp_path / name))
        assert {(r.resolver_ip, r.domain) for r in feeds.ptr_domains(rows).collect()} == {("1.2.3.4", "Dns.Example.com"), ("1.2.3.4", "deep.example")}
        got = {r.domain: (r.resolver_ip, r.alpn, r.port, r.ipv4hint, r.dohpath) for r in feeds.svcb_records(rows).collect()}
        assert got == {"one.example": ("2001:db8::1", ["h2", "h3"], 443, ["1.1.1.1", "2.2.2.2"], "/q"),
                       "two.example": ("2001:db8::1", ["dot"], None, None, None), "a.example": ("5.6.7.8", None, None, None, None)}
        assert {r.domain for r in feeds.ptr_domain_targets(rows).collect()} == {"Dns.Example.com", "deep.example", "4.3.2.1.in-addr.arpa"}
    (tmp_path / "bad.jsonl").write_text("{not json\n")
    with pytest.raises(Exception):
        readers.read_lookup_results(spark, str(tmp_path / "bad.jsonl")).collect()


def test_as_links_layout_order(spark):
    one = (r'["<a href=\"/dnssec/AS15?c=1\">AS15</a>","First",{"v":1},"",12] ["<a href=\"/dnssec/AS15?c=1\">AS15</a>","Last \"Q\" &amp; Co",{"v":1},5,12]'
           r' <a href="/dnssec/AS16?x">AS16</a>"," Arr",1,2,3')
    two = '<tr><td><a href="/dnssec/AS17">AS17</a></td><td><b>Tab</b> &eacute;</td><td>1</td><td>2</td><td>3</td></tr> /dnssec/AS18? /dnssec/AS15? /dnssec/AS99999999999?'
    pages = spark.createDataFrame([(1, one), (2, two)], "page_id int, html string")
    assert {r.asn: r.as_name for r in feeds.extract_as_links(pages).collect()} == {15: 'Last "Q" & Co', 16: " Arr", 17: "Tab é", 18: None}


def test_paged_entries_and_readers(spark, tmp_path):
    entry = T.StructType().add("queried_ip", T.StringType()).add("n", T.LongType())
    for i, page in enumerate(({"meta": 1, "dnsEntries": [{"queried_ip": "1.1.1.1", "n": 1}]}, {"data": {"records": [{"queried_ip": "1.1.1.2", "n": 2}]}}, [{"queried_ip": "1.1.1.3"}])):
        (tmp_path / f"page{i}.json").write_text(json.dumps(page))
    rows = readers.read_paged_entries(spark, str(tmp_path / "page*.json"), entry)
    assert {(r.queried_ip, r.n) for r in rows.collect()} == {("1.1.1.1", 1), ("1.1.1.2", 2), ("1.1.1.3", None)}
    (tmp_path / "plain.csv").write_text("1.1.1.1\tx\n")
    assert readers.read_table(spark, str(tmp_path / "plain.csv"), header=False, columns=["ip", "t"], sep=r"\t").first().t == "x"
    with pytest.raises(ValueError):
        readers.read_table(spark, "x.xlsx")
    with pytest.raises(ValueError):
        readers.read_table(spark, str(tmp_path / "plain.csv"), header=False)


def test_exports(spark, tmp_path):
    rows = spark.createDataFrame([("1.1.1.1", 1, True, True, "s", 5, "DEU")], readers.EXPORT_COLUMNS)
    for fmt in ("txt", "csv", "jsonl"):
        readers.export_resolvers(rows, str(tmp_path / fmt), fmt)
    assert spark.read.text(str(tmp_path / "txt")).first().value == "1.1.1.1"
    readers.write_table(rows.where("false"), str(tmp_path / "empty"), ["ip", "resolver_id"], {"resolver_ip": "ip"})
    assert spark.read.parquet(str(tmp_path / "empty")).columns == ["ip", "resolver_id"]


def test_second_closed_rule_counts_all_rows_unless_strict(spark):
    side = "null as {0}_asn, null as {0}_prefix, null as {0}_org, null as {0}_country"
    sides = [c for s in ("queried_ip", "replying_ip", "backend_resolver") for c in side.format(s).split(", ")]
    base = spark.createDataFrame([
        ("Forwarder", "1.0.0.1", "1.0.0.9", "1.0.0.7"),  # replying address was never queried, so the second rule alone picks 1.0.0.7
        ("Transparent Forwarder", "1.0.0.3", "1.0.0.8", "1.0.0.6"),
        ("Transparent Forwarder", "1.0.0.4", "1.0.0.1", None),
    ], "resolver_type string, queried_ip string, replying_ip string, backend_resolver string")
    rows = base.selectExpr("*", *sides, "timestamp'2020-01-01' as timestamp_request", "'udp' as protocol")
    for s in ("queried_ip", "replying_ip", "backend_resolver"):
        rows = readers.with_ip_key(rows, s, out=s, v6=False)
        for a in ("prefix", "org", "country"):
            rows = rows.withColumn(f"{s}_{a}", F.col(f"{s}_{a}").cast("string"))
        rows = rows.withColumn(f"{s}_asn", F.col(f"{s}_asn").cast("bigint"))
    census = spark.createDataFrame([("9.0.0.0/8", 5, 5)], "prefix string, AB_x int, GCD_x int")
    found = lambda strict: {r.ipv4 for r in scan.classify_scan(rows, census, strict).closed_from_transparent_backend().collect()}
    assert found(False) == {"1.0.0.7", "1.0.0.6"}
    assert found(True) == {"1.0.0.6"}


def test_dnssec_latest(spark):
    payload = {"data": [{"cc": "DE", "date": "2024-01-02", "30_day": {"seen": 5, "validating": "", "validating_pc": 1.5}},
                        {"cc": "DE", "date": "2024-01-01", "30_day": {"seen": 4}}, {"cc": "DE"}]}
    rows = spark.createDataFrame([("DE", json.dumps(payload)), ("FR", "no json"), ("IT", '{"data": 5}')], "asked string, payload string")
    got = feeds.dnssec_latest(rows).collect()
    assert [(r.country, r.number_of_measurements, r.validating, str(r.last_observation_ts)) for r in got] == [("DE", "5", None, "2024-01-02 00:00:00")]


def test_anycast_country_shapes(spark):
    structs = spark.createDataFrame([("10.0.0.5/8", [("DE",), ("DE",), ("FR",), (None,)]), ("10.0.0.0/8", None)], "prefix string, places array<struct<country_code:string>>")
    rows = feeds.prepare_anycast_file(structs, "prefix:prefix,country:places", "location")["country_backend"].collect()
    assert {(r.prefix, r.country, r.country_count) for r in rows} == {("10.0.0.0/8", "DE", 2), ("10.0.0.0/8", "FR", 1)}
    scalar = spark.createDataFrame([("10.0.0.0/8", "DE", "3", "1_2_-"), ("10.0.0.0/8", "DE", "-1", "2")], "prefix string, c string, n string, a string")
    out = feeds.prepare_anycast_file(scalar, "prefix:prefix,country:c,country_count:n,asn:a", "anycast,asn,asn_backend,location")
    assert [(r.country, r.country_count) for r in out["country_backend"].collect()] == [("DE", 3)]
    assert {(r.asn, r.asn_count) for r in out["asn_backend"].collect()} == {(1, 1), (2, 2)}


def test_lookup_records_at_any_depth(spark):
    from pyspark.sql import functions as F

    from resolvescope.sources.readers import lookup_rows

    record = '{"type":"PTR","answer":"deep.example."}'
    for _ in range(9):
        record = '{"more":[' + record + "]}"
    texts = [
        '{"name":"192.0.2.1","results":{"PTR":{"status":"NOERROR","data":{"answers":[{"type":"PTR","answer":"flat.example."}]}}}}',
        '{"name":"192.0.2.2","results":{"PTR":{"status":"NOERROR","data":' + record + "}}}",
        '{"name":"192.0.2.3","results":{"PTR":{"status":"NOERROR","data":{"a":{"b":{"type":"PTR","answer":"quoted [{}] \\" .example."}}}}}}',
    ]
    rows = lookup_rows(spark.createDataFrame([(t,) for t in texts], "t string").select(F.parse_json("t").alias("row")))
    found = {(r["resolver_ip"], r["domain"]) for r in feeds.ptr_domains(rows).collect()}
    assert found == {("192.0.2.1", "flat.example"), ("192.0.2.2", "deep.example"), ("192.0.2.3", 'quoted [{}] " .example')}


def test_wide_as_numbers(spark):
    pages = spark.createDataFrame([(1, '<a href="/dnssec/AS4200000000?c=DE">x</a><a href="/dnssec/AS4294967296?c=DE">y</a><A HREF="/DNSSEC/AS1">no details</a>')], "page_id long, html string")
    assert [tuple(r) for r in feeds.extract_as_links(pages).collect()] == [(4200000000, None)]
    series = spark.createDataFrame([("AS4200000000", '{"data":[{"date":"2024-01-02","30_day":{"seen":"1"}}]}')], "asked string, payload string")
    assert [r["asn"] for r in feeds.dnssec_latest(series, "asn").collect()] == [4200000000]


def lookup(spark, texts):
    return readers.lookup_rows(spark.createDataFrame([(t,) for t in texts], "t string").select(F.parse_json("t").alias("row")))


def nested(levels):
    record = '{"type":"PTR","answer":"d%d.example."}' % levels
    for level in range(levels):
        record = '{"more":[' + record + "]}" if level % 2 else '{"below":' + record + "}"
    return '{"name":"192.0.2.1","results":{"PTR":{"status":"NOERROR","data":' + record + "}}}"


def test_few_levels_enter_the_short_block_only(spark, monkeypatch):
    depths = [0, 1, 2, 3, 4, 5, 6, 7, 23, 24, 25, 26, 27, 60]  # around the ends of the blocks
    found = {r["domain"] for r in feeds.ptr_domains(lookup(spark, [nested(d) for d in depths])).collect()}
    assert found == {f"d{d}.example" for d in depths}
    opened = feeds._deeper
    monkeypatch.setattr(feeds, "_deeper", lambda state, levels: opened(state, levels) if levels < 10 else F.when(F.raise_error(F.lit("entered")).isNull(), state))
    usual = feeds.ptr_domains(lookup(spark, [nested(d) for d in (0, 1, 3)])).collect()
    assert {r["domain"] for r in usual} == {"d0.example", "d1.example", "d3.example"}


def test_lookups_of_real_size(spark):
    """A parameter of 100,000 characters, 100,000 answers in one lookup, records 50 levels down: each is found."""
    long = "/" + 'q"\\' * 33333
    answers = [{"type": "PTR", "answer": f"h{i}.example."} for i in range(100_000)]
    deep = {"type": "SVCB", "target": "deep.example.", "svcparams": {"port": 853}}
    for level in range(50):
        deep = {"more": [deep]} if level % 2 else {"more": deep, "text": "[{" * 20}
    rows = lookup(spark, [
        json.dumps({"name": "192.0.2.1", "results": {"SVCB": {"status": "NOERROR", "data": {"answers": [{"type": "SVCB", "target": "long.example.", "svcparams": {"dohpath": long}}]}}}}),
        json.dumps({"name": "192.0.2.2", "results": {"PTR": {"status": "NOERROR", "data": {"answers": answers}}}}),
        json.dumps({"name": "192.0.2.3", "results": {"HTTPS": {"status": "NOERROR", "data": deep}, "SVCB": {"status": "NOERROR", "data": None}}}),
        json.dumps({"name": "192.0.2.4", "results": {"PTR": {"status": "NOERROR", "data": [[[[[[{"type": "PTR", "answer": "listed.example"}]]]]]]}}}),
    ])
    assert {(r.domain, r.dohpath, r.port) for r in feeds.svcb_records(rows).collect()} == {("long.example", long, None), ("deep.example", None, 853)}
    found = feeds.ptr_domains(rows)
    assert found.count() == 100_001 and found.where("resolver_ip = '192.0.2.2'").count() == 100_000
    assert feeds.ptr_domain_targets(rows).count() == 100_001


def test_lookups_read_their_input_once(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text("\n".join(json.dumps(r) for r in LOOKUPS))
    for build in (feeds.svcb_records, feeds.ptr_domains, feeds.ptr_domain_targets):
        plan = build(readers.read_lookup_results(spark, str(tmp_path / "r.jsonl")))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1 and "Python" not in plan


def test_walk_keeps_to_the_plain_walk(spark):
    """Every value of random documents, against a plain recursion."""
    import random

    draw = random.Random(6)

    def value(depth):
        kind = draw.randrange(6) if depth else 0
        if kind < 2:
            return draw.choice([1, "x", True, "{[", ""])
        if kind < 4:
            return [value(depth - 1) for _ in range(draw.randrange(4))]
        return {f"k{i}": value(depth - 1) for i in range(draw.randrange(4))}

    def walked(v):
        yield v
        for child in v if isinstance(v, list) else v.values() if isinstance(v, dict) else []:
            yield from walked(child)

    documents = [value(draw.choice([1, 3, 5, 9])) for _ in range(120)]
    frame = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(documents)], "i int, t string").select("i", F.parse_json("t").alias("v"))
    got = sorted((r.i, r.n) for r in feeds.walk(frame, "v").select("i", F.to_json("node").alias("n")).collect())
    text = lambda v: json.dumps(v, separators=(",", ":"), sort_keys=True)
    assert got == sorted((i, text(v)) for i, d in enumerate(documents) for v in walked(d))


def test_network_names_of_any_length(spark):
    name = "Net \\\" work " * 12_000
    cell = "Plain & wide " * 12_000
    page = f'"<a href="/dnssec/AS15?c=1">AS15</a>","{name}",1 <tr><td><a href="/dnssec/AS17">AS17</a></td><td>{cell}</td></tr>'
    got = {r.asn: r.as_name for r in feeds.extract_as_links(spark.createDataFrame([(1, page)], "page_id int, html string")).collect()}
    assert got == {15: name.replace('\\"', '"'), 17: cell.strip()}
