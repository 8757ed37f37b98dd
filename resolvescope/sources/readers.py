"""Reading landed files and writing prepared tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from resolvescope.functions.net import key_names, with_ip_key

# Keys under which paged feeds keep their entry list, in lookup order.
ENTRY_KEYS = ("data", "entries", "items", "results", "dns_entries", "dnsEntries", "records")

SPOOFER_SCHEMA = (
    "session string, timestamp string, country string, client4 string, asn4 string, nat4 boolean, privatespoof string, "
    "routedspoof string, client6 string, asn6 string, nat6 boolean, privatespoof6 string, routedspoof6 string"
)


def read_table(
    spark: SparkSession,
    path: str,
    header: bool = True,
    columns: Sequence[str] | None = None,
    sep: str = ",",
    schema: T.StructType | str | None = None,
) -> DataFrame:
    """Read Parquet, CSV, JSON or newline-delimited JSON by suffix.

    Without a header the column names must be given; CSV columns are then text.
    """
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    reader = spark.read if schema is None else spark.read.schema(schema)
    if suffix in ("parquet", "pq"):
        return reader.parquet(path)
    if suffix == "csv":
        sep = "\t" if sep == r"\t" else sep
        if len(sep) != 1:
            raise ValueError("the separator must be one character or \\t")
        if not header:
            if not columns:
                raise ValueError("column names are required for CSV without a header")
            schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
            return spark.read.schema(schema).csv(path, sep=sep)
        return reader.csv(path, header=True, sep=sep)
    if suffix in ("json", "jsonl", "ndjson"):
        return reader.json(path, multiLine=suffix == "json")
    raise ValueError(f"unsupported input file type {suffix!r}; use CSV, Parquet, JSON or NDJSON")


def read_paged_entries(spark: SparkSession, path: str, entry: T.StructType) -> DataFrame:
    """Rows of paged JSON files whose entry list sits at the top, under one of ``ENTRY_KEYS``, or
    one level below such a key. The first candidate that holds a list wins; a page without one
    is an error."""
    pages = spark.read.text(path, wholetext=True)
    page = F.parse_json("value")
    as_list = lambda where: F.try_variant_get(page, where, "array<variant>")
    places = ["$"]
    for key in ENTRY_KEYS:
        places += [f"$.{key}", *[f"$.{key}.{inner}" for inner in ENTRY_KEYS]]
    entries = F.coalesce(*[as_list(place) for place in places])
    checked = F.when(entries.isNull(), F.raise_error(F.lit("no entry list in JSON page"))).otherwise(entries)
    items = pages.select(F.explode(checked).alias("item"))
    return items.select(F.from_json(F.to_json("item"), entry).alias("e")).select("e.*")


def flatten_struct(df: DataFrame) -> DataFrame:
    """Nested objects to dotted columns."""

    def leaves(fields, path):
        for f in fields:
            here = [*path, f.name]
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType.fields, here)
            else:
                yield F.col(".".join(f"`{p}`" for p in here)).alias(".".join(here))

    return df.select(*leaves(df.schema.fields, []))


SCAN_TEXT = ("protocol", "resolver_type") + tuple(
    f"{side}_{name}" for side in ("queried_ip", "replying_ip", "backend_resolver") for name in ("country", "prefix", "org")
)
SCAN_STAMPS = ("timestamp_request", "scan_date")
SCAN_SIDES = ("queried_ip", "replying_ip", "backend_resolver")


def scan_stamp(col: Column) -> Column:
    return col.cast("string").try_cast("timestamp")


def scan_asn(col: Column) -> Column:
    """AS number that passed through a float."""
    number = F.round(col.try_cast("double"), 0).try_cast("bigint")
    return F.when(number.between(0, 4294967295), number)


def standardise_scan(df: DataFrame) -> DataFrame:
    """Typed scan rows: text, UTC stamps, AS numbers, addresses with keys and ``<ip>_uint32``."""
    out = df
    for name in df.columns:
        if name in SCAN_TEXT:
            out = out.withColumn(name, F.col(name).cast("string"))
        elif name in SCAN_STAMPS:
            out = out.withColumn(name, scan_stamp(F.col(name)))
        elif name in tuple(f"{s}_asn" for s in SCAN_SIDES):
            out = out.withColumn(name, scan_asn(F.col(name)))
    for side in SCAN_SIDES:
        if side in df.columns:
            out = with_ip_key(out, side, out=side, v6=False)
            out = out.withColumn(f"{side}_uint32", F.col(key_names(side)[2]))
    return out


def spoofer_sessions_to_prefix_rows(df: DataFrame) -> DataFrame:
    """Spoofer sessions to one row per (session, family) with a client prefix."""
    stamp = F.try_to_timestamp("timestamp", F.lit("yyyy-MM-dd'T'HH:mm:ssXX"))
    stamp = F.coalesce(stamp, F.try_to_timestamp("timestamp", F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")))

    def side(n: str, tail: str) -> DataFrame:
        return df.select(
            F.col(f"client{n}").alias("prefix"), F.col(f"asn{n}").try_cast("bigint").alias("asn"),
            F.upper(F.col("country").cast("string")).alias("country"), F.col(f"nat{n}").alias("nat"),
            F.col(f"privatespoof{tail}").alias("privatespoof"), F.col(f"routedspoof{tail}").alias("routedspoof"),
            stamp.alias("last_update_ts"),
        )

    return side("4", "").unionByName(side("6", "6")).where(F.col("prefix").isNotNull())


def read_lookup_results(spark: SparkSession, path: str) -> DataFrame:
    """DNS lookup output (one JSON array per ``.json`` file, or one object per line) as
    (name, results) with results as a variant; a malformed line fails the job."""
    if path.rstrip("/").endswith(".json"):
        whole = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
        listed = F.coalesce(F.try_variant_get("v", "$", "array<variant>"), F.array("v"))
        rows = whole.select(F.explode(listed).alias("row"))
    else:
        lines = spark.read.text(path).where(F.trim("value") != "")
        rows = lines.select(F.parse_json("value").alias("row"))
    return lookup_rows(rows)


def lookup_rows(rows: DataFrame) -> DataFrame:
    """(name, results) of a frame with a variant column ``row``."""
    return rows.select(
        F.try_variant_get("row", "$.name", "string").alias("name"), F.try_variant_get("row", "$.results", "variant").alias("results")
    )


def latest_snapshot(df: DataFrame, column: str = "snapshot_date") -> DataFrame:
    """Rows of the newest snapshot of a table partitioned by snapshot date; the date is found
    from partition values, so older partitions are not read."""
    newest = df.select(column).agg(F.max(column)).scalar()
    return df.where(F.col(column) == newest)


def newest_file(spark: SparkSession, glob: str) -> str | None:
    """Path of the most recently modified file that matches a pattern."""
    jvm = spark.sparkContext._jvm
    location = jvm.org.apache.hadoop.fs.Path(glob)
    found = location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(location)
    files = sorted(((f.getModificationTime(), f.getPath().toString()) for f in found or []), reverse=True)
    return files[0][1] if files else None


def write_table(df: DataFrame, path: str, columns: Sequence[str], rename: dict[str, str] | None = None) -> None:
    """Write a fixed column list as Parquet; an empty frame still writes the schema."""
    for old, new in (rename or {}).items():
        df = df.withColumnRenamed(old, new)
    df.select(*[c for c in columns if c in df.columns]).write.mode("overwrite").parquet(path)


EXPORT_COLUMNS = ["resolver_ip", "resolver_id", "verified", "is_public", "source", "asn", "country"]


def export_resolvers(df: DataFrame, path: str, fmt: str = "txt") -> None:
    """Write a resolver list as txt (addresses only), csv or jsonl."""
    if fmt == "txt":
        df.select("resolver_ip").write.mode("overwrite").text(path)
    elif fmt == "csv":
        df.select(*EXPORT_COLUMNS).write.mode("overwrite").csv(path, header=True)
    elif fmt == "jsonl":
        df.write.mode("overwrite").json(path)
    else:
        raise ValueError(f"unsupported export format {fmt!r}")
