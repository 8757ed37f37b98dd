"""The fixed relations: schemas and a reader that exposes them as attributes."""

from __future__ import annotations

import weakref
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_STAMP = "last_update_ts timestamp"
_IP = "ip string, family tinyint, ip_hi bigint, ip_lo bigint"
_PREFIX = "prefix string, family tinyint, masklen int, net_hi bigint, net_lo bigint"

TABLES = {
    "data_source": "source string, date_added date, url string, api_endpoint string, documentation_endpoint string, "
    "description string, apikey_required boolean, last_retrieved_ts timestamp, added_ts timestamp",
    "country_location": "country string, latitude double, longitude double",
    "resolver_identity": f"id bigint, {_STAMP}, total_measurements int, seen_measurements int, verified boolean",
    "resolver": f"{_IP}, resolver_id bigint, is_public boolean, {_STAMP}, source string",
    "resolver_service": f"resolver_id bigint, protocol string, port int, {_STAMP}",
    "resolver_dohpath": f"resolver_id bigint, dohpath string, {_STAMP}",
    "resolver_asn": f"resolver_id bigint, asn bigint, {_STAMP}",
    "resolver_prefix": f"resolver_id bigint, prefix string, {_STAMP}",
    "resolver_org": f"resolver_id bigint, org string, {_STAMP}",
    "resolver_domain": f"resolver_id bigint, domain string, {_STAMP}",
    "resolver_location": f"resolver_id bigint, country string, city string, {_STAMP}",
    "resolver_verification": "resolver_id bigint, verifying_source string",
    "qmin_resolver": f"resolver_id bigint, qmin string, max_minimise_count int, minimize_one_lab int, {_STAMP}, "
    "first_qmin_observation timestamp, last_qmin_observation timestamp, source string",
    "forwarder_identity": f"id bigint, {_STAMP}, total_measurements int, seen_measurements int",
    "forwarder": f"{_IP}, forwarder_id bigint, is_public boolean, {_STAMP}, type string, transparent_count bigint, "
    "recursive_count bigint, last_observed_as_recursive timestamp, last_observed_as_transparent timestamp, source string",
    "forwarder_protocol": f"forwarder_id bigint, protocol string, {_STAMP}",
    "forwarder_endpoint": f"forwarder_id bigint, endpoint string, {_STAMP}",
    "forwarder_asn": f"forwarder_id bigint, asn bigint, {_STAMP}",
    "forwarder_prefix": f"forwarder_id bigint, prefix string, {_STAMP}",
    "forwarder_org": f"forwarder_id bigint, org string, {_STAMP}",
    "forwarder_domain": f"forwarder_id bigint, domain string, {_STAMP}",
    "forwarder_location": f"forwarder_id bigint, country string, city string, {_STAMP}",
    "forwarder_resolver_upstream": f"forwarder_id bigint, upstream_resolver_id bigint, {_STAMP}",
    "forwarder_forwarder_upstream": f"forwarder_id bigint, upstream_forwarder_id bigint, {_STAMP}",
    "anycast": f"{_PREFIX}, backing_prefix string, partial boolean, {_STAMP}, source string",
    "anycast_asn": f"prefix string, asn bigint, {_STAMP}, source string",
    "anycast_country_backend": f"prefix string, country string, country_count bigint, {_STAMP}, source string",
    "anycast_asn_backend": f"prefix string, asn bigint, asn_count bigint, {_STAMP}, source string",
    "spoofing": f"{_PREFIX}, nat boolean, privatespoof string, routedspoof string, {_STAMP}, source string",
    "spoofing_asn": "prefix string, asn bigint",
    "spoofing_country": "prefix string, country string",
    "dnssec_resolver": f"{_IP}, validates boolean, total_measurements int, seen_measurements int, validation_count int, "
    f"{_STAMP}, source string",
    "dnssec_resolver_dobit": f"{_IP}, dobit_set boolean, total_measurements int, seen_measurements int, dobit_count int, "
    f"{_STAMP}, source string",
    "dnssec_asn": "asn bigint, validating bigint, validating_pc double, partial_validating bigint, "
    f"partial_validating_pc double, {_STAMP}, source string",
    "dnssec_country": "country string, validating bigint, validating_pc double, partial_validating bigint, "
    f"partial_validating_pc double, {_STAMP}, source string",
}


# What a table may be dealt into buckets by: part of the key of every merge into it.
BUCKET_KEYS = {
    **dict.fromkeys(("resolver", "forwarder", "dnssec_resolver", "dnssec_resolver_dobit"), ("family", "ip_hi", "ip_lo")),
    **dict.fromkeys(("resolver_identity", "forwarder_identity"), ("id",)),
    **{name: ("resolver_id",) for name in TABLES if name.startswith("resolver_") and name != "resolver_identity"},
    "qmin_resolver": ("resolver_id",),
    **{name: ("forwarder_id",) for name in TABLES if name.startswith("forwarder_") and name != "forwarder_identity"},
    **{name: ("prefix",) for name in TABLES if name.startswith(("anycast", "spoofing"))},
}


@dataclass(frozen=True)
class Layout:
    """A stored table dealt into buckets by a hash of key columns, each bucket a folder of its own."""

    spark: SparkSession
    schema: T.StructType
    keys: tuple[str, ...]
    buckets: int
    folders: dict[int, str]

    def number(self) -> Column:
        """The bucket of a row that has the key columns, of whatever integer type."""
        return bucket_number([F.col(k).cast(self.schema[k].dataType) for k in self.keys], self.buckets)

    def hit_by(self, batch: DataFrame) -> list[int]:
        """Buckets that rows of a batch fall into; at most all of them come to the driver."""
        return sorted(r[0] for r in batch.select(self.number().alias("b")).distinct().collect())

    def read(self, numbers: set[int]) -> DataFrame:
        """The rows of some buckets; no other folder is listed."""
        paths = [path for number, path in sorted(self.folders.items()) if number in numbers]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)


def bucket_number(keys: list[Column], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


_layouts: weakref.WeakKeyDictionary[DataFrame, Layout] = weakref.WeakKeyDictionary()


def layout_of(frame: DataFrame) -> Layout | None:
    """The layout of a table exactly as a catalog opened it; None for anything derived."""
    return _layouts.get(frame)


class Catalog:
    """Relations of one table folder as attributes; a relation that was never written is empty.

    ``versions`` names each table's folder below its own, or how it is dealt into buckets:
    {"keys": [...], "buckets": n, "parts": {bucket: folder}}.
    """

    def __init__(self, spark: SparkSession, root: str, versions: dict[str, str | dict] | None = None):
        self._spark = spark
        self._root = root.rstrip("/")
        self._versions = versions or {}
        self._frames: dict[str, DataFrame] = {}
        self._read: set[str] = set()

    @property
    def versions(self) -> dict[str, str | dict]:
        return self._versions

    @property
    def tables_read(self) -> set[str]:
        """Stored tables that have been asked for so far."""
        return set(self._read)

    def path(self, name: str) -> str:
        version = self._versions.get(name)
        return f"{self._root}/{name}" + (f"/{version}" if version else "")

    def set(self, name: str, frame: DataFrame) -> "Catalog":
        self._frames[name] = frame
        return self

    def layout(self, name: str) -> Layout | None:
        version = self._versions.get(name)
        if not isinstance(version, dict):
            return None
        folders = {int(number): f"{self._root}/{name}/{folder}/bucket={number}" for number, folder in version["parts"].items()}
        return Layout(self._spark, T.StructType.fromDDL(TABLES[name]), tuple(version["keys"]), version["buckets"], folders)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in TABLES:
            raise AttributeError(name)
        if name not in self._frames:
            self._read.add(name)
            layout = self.layout(name)
            self._frames[name] = self._stored(name) if layout is None else layout.read(set(layout.folders))
            if layout is not None:
                _layouts[self._frames[name]] = layout
        return self._frames[name]

    def stored(self, name: str, schema: str | T.StructType) -> DataFrame:
        """A table that is kept beside the fixed relations."""
        self._read.add(name)
        return self._stored(name, schema)

    def _stored(self, name: str, schema: str | T.StructType | None = None) -> DataFrame:
        schema = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema or TABLES[name])
        path = self.path(name)
        hadoop = self._spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        store = hadoop.getFileSystem(self._spark.sparkContext._jsc.hadoopConfiguration())
        return self._spark.read.schema(schema).parquet(path) if store.exists(hadoop) else self._spark.createDataFrame([], schema)
