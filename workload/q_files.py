"""Round trips through files in the shared folder: written from given tables, read back, compared."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from resolvescope.catalog import Catalog
from resolvescope.operators import pages
from resolvescope.plans import imports, scope_reports
from resolvescope.session import shared_folder
from resolvescope.sources import readers, registry, versions
from resolvescope.streaming.sessions import dedupe_session_stream, merge_stream
from workload import batches as b
from workload.fixtures import rip
from workload.oracle_fixtures import rip as sql_rip
from workload.oracle_fixtures import v4 as sql_v4
from workload.q_merges import Tables
from workload.q_reports import EXTRA, counts_sql
from workload.registry import query

ROWS = "SELECT o_orderkey AS k, o_custkey AS c, o_orderpriority AS p FROM orders"


def key():
    return F.col("o_orderkey")


def folder(t, name: str) -> str:
    return f"{shared_folder(t.spark)}/files-{uuid.uuid4().hex}/{name}"


def rows(t):
    return t.raw("orders").select(key().alias("k"), F.col("o_custkey").alias("c"), F.col("o_orderpriority").alias("p"))


def typed(df):
    return df.select(F.col("k").cast("bigint").alias("k"), F.col("c").cast("bigint").alias("c"), "p")


for _suffix, _write in {
    "parquet": lambda df, path: df.write.parquet(path), "csv": lambda df, path: df.write.csv(path, header=True),
    "ndjson": lambda df, path: df.write.json(path), "jsonl": lambda df, path: df.write.json(path),
}.items():

    @query(f"s01_read_{_suffix}", ROWS)
    def _(t, suffix=_suffix, write=_write):
        path = folder(t, f"rows.{suffix}")
        write(rows(t), path)
        return typed(readers.read_table(t.spark, path))


@query("s02_headerless_csv", ROWS)
def _(t):
    path = folder(t, "rows.csv")
    rows(t).write.csv(path, sep="\t")
    return typed(readers.read_table(t.spark, path, header=False, columns=["k", "c", "p"], sep=r"\t"))


@query("s04_paged_entries", ROWS)
def _(t):
    path = folder(t, "pages")
    entry = F.struct("k", "c", "p")
    pages = rows(t).groupBy(F.floor(F.col("k") / 1024).alias("n")).agg(F.collect_list(entry).alias("e"))  # at most 1024 orders a page
    place = F.struct(F.struct(F.col("e").alias("records")).alias("data"))
    text = F.when(F.col("n") % 2 == 0, F.to_json(place)).otherwise(F.to_json("e"))
    listed = pages.select(text.alias("value"))
    listed.repartition(8).write.option("maxRecordsPerFile", 1).text(path)
    return readers.read_paged_entries(t.spark, path, rows(t).schema)


@query("s08_lookup_lines", "SELECT o_custkey::VARCHAR AS name, o_orderpriority AS status, count(*) AS n FROM orders GROUP BY 1,2")
def _(t):
    path = folder(t, "lookups.jsonl")
    line = F.to_json(F.struct(F.col("c").cast("string").alias("name"), F.struct(F.struct(F.col("p").alias("status")).alias("PTR")).alias("results")))
    rows(t).select(line.alias("value")).write.text(path)
    found = readers.read_lookup_results(t.spark, path)
    return found.groupBy("name", F.try_variant_get("results", "$.PTR.status", "string").alias("status")).agg(F.count("*").alias("n"))


@query("s10_write_table", "SELECT o_orderkey AS key, o_orderpriority AS p FROM orders")
def _(t):
    path = folder(t, "prepared")
    readers.write_table(rows(t), path, ["key", "p", "absent"], {"k": "key"})
    return t.spark.read.parquet(path)


EXPORTED = f"SELECT {sql_v4(sql_rip('c_custkey'))} AS resolver_ip, c_custkey AS resolver_id FROM customer"


for _fmt in ("txt", "csv", "jsonl"):

    @query(f"s11_export_{_fmt}", EXPORTED if _fmt != "txt" else f"SELECT resolver_ip FROM ({EXPORTED})")
    def _(t, fmt=_fmt):
        path = folder(t, "export")
        listed = t.raw("customer").select(
            b.v4_text(rip(F.col("c_custkey"))).alias("resolver_ip"), F.col("c_custkey").alias("resolver_id"), F.lit(True).alias("verified"),
            F.lit(True).alias("is_public"), F.lit("list").alias("source"), F.lit(1).alias("asn"), F.lit("DEU").alias("country"))
        readers.export_resolvers(listed, path, fmt)
        if fmt == "txt":
            return t.spark.read.text(path).select(F.col("value").alias("resolver_ip"))
        back = t.spark.read.csv(path, header=True) if fmt == "csv" else t.spark.read.json(path)
        return back.select("resolver_ip", F.col("resolver_id").cast("bigint").alias("resolver_id"))


@query("t01_session_stream", "SELECT DISTINCT user_id::VARCHAR AS session FROM events")
def _(t):
    source, sink, marks = (folder(t, n) for n in ("in", "out", "marks"))
    t.raw("events").select(F.col("user_id").cast("string").alias("session"), F.lit("2024-01-01").cast("timestamp").alias("ts")).write.parquet(source)
    stream = dedupe_session_stream(t.spark.readStream.schema("session string, ts timestamp").parquet(source))
    stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(sink).select("session")


@query("t02_merge_stream", f"SELECT {sql_v4(sql_rip('(o_custkey::BIGINT+1000000)'))} AS ip, strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') AS last_update_ts FROM orders GROUP BY 1")
def _(t):
    """Orders as four micro-batches of resolver rows, merged into a table stored in buckets."""
    source, root, marks = (folder(t, n) for n in ("in", "tables", "marks"))
    rows = t.raw("orders").select(b.v4_text(rip(F.col("o_custkey") + 1000000)).alias("addr"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("seen"))
    files = math.ceil(t.pieces("orders") / 4)  # of a micro-batch
    rows.repartition(4 * files).write.parquet(source)
    stream = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(source)
    versions.write_versions(t.spark, root, {"resolver": Catalog(t.spark, root).resolver})
    versions.deal_into_buckets(t.spark, root, {"resolver": 8})
    job = lambda tables, batch: imports.import_resolvers(tables, batch, "ip:addr,last_update_ts:seen", "resolver", "stream", now=b.now(), v6=False)
    merge_stream(stream, root, marks, job).awaitTermination()
    return versions.open_catalog(t.spark, root).resolver.select("ip", "last_update_ts")


@query("w07_written_page", "SELECT o_orderkey, o_totalprice, rank FROM (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank BETWEEN 7001 AND 7025")
def _(t):
    """Page 281 of all orders, from the range of the written report that it lies in."""
    path, order = folder(t, "pages"), [F.col("o_totalprice").desc(), key()]
    pages.write_pages(t.raw("orders").select("o_orderkey", "o_totalprice"), order, path, range_rows=1000)
    return pages.read_page(t.spark, path, order, 281, 25).select("o_orderkey", "o_totalprice", "rank")


@query("w07_written_page_by_group", "SELECT p_brand, p_partkey, rank FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part) WHERE p_brand = 'Brand#13' AND rank BETWEEN 6 AND 10")
def _(t):
    path, order = folder(t, "pages"), [F.col("p_retailprice").desc(), F.col("p_partkey")]
    pages.write_pages(t.raw("part").select("p_brand", "p_partkey", "p_retailprice"), order, path, by=["p_brand"], range_rows=100)
    return pages.read_page(t.spark, path, order, 2, 5, {"p_brand": "Brand#13"}).select("p_brand", "p_partkey", "rank")


@query("m28_resolver_lists", f"SELECT DISTINCT {sql_v4(sql_rip('(o_custkey::BIGINT+1000000)'))} AS ip, 'one' AS source FROM orders UNION ALL SELECT DISTINCT {sql_v4(sql_rip('(s_suppkey::BIGINT+5000000)'))}, 'one' FROM supplier")
def _(t):
    first, second = folder(t, "list.txt"), folder(t, "list.csv")
    t.raw("orders").select(b.v4_text(rip(F.col("o_custkey") + 1000000)).alias("value")).write.text(first)
    t.raw("supplier").select(b.v4_text(rip(F.col("s_suppkey") + 5000000)).alias("addr")).write.csv(second, header=True)
    configs = [
        {"path": first, "mapping": "ip:value", "modules": "resolver", "source": "one"},
        {"path": second, "mapping": "ip:addr", "modules": "resolver", "source": "one"},
    ]
    results = registry.import_resolver_lists(t.spark, Tables(t), configs, now=b.now())
    known = t.resolver.select("ip")
    return results[-1].table("resolver").join(known, "ip", "left_anti").select("ip", "source")


@query("q39_target_response_asn", f"SELECT st_records.*, n.* FROM st_records JOIN ({counts_sql('asn')}) n ON n.target=asn", EXTRA)
def _(t):
    return scope_reports.target_response(t, "asn")
