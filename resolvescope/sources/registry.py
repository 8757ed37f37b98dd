"""Source registry and country coordinates."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resolvescope.operators.merge import MergeResult, cur, merge, new

REGISTRY_COLUMNS = ("url", "api_endpoint", "documentation_endpoint", "description", "apikey_required")


def merge_sources(registry: DataFrame, configured: DataFrame, now: Column | None = None) -> MergeResult:
    """Insert configured sources that are not registered yet."""
    stamp = F.current_timestamp() if now is None else now
    insert = {"date_added": F.to_date(stamp), "added_ts": stamp, "apikey_required": F.coalesce(new("apikey_required"), F.lit(False))}
    return merge(registry, configured, ["source"], F.lit(False), {}, insert)


def upsert_source(registry: DataFrame, rows: DataFrame, now: Column | None = None) -> MergeResult:
    """Register sources; a null description keeps the old one."""
    stamp = F.current_timestamp() if now is None else now
    insert = {"date_added": F.to_date(stamp), "added_ts": stamp, "apikey_required": F.lit(False)}
    update = {"description": F.coalesce(new("description"), cur("description"))}
    return merge(registry, rows.select("source", "description"), ["source"], F.lit(True), update, insert)


def missing_sources(registry: DataFrame, batch: DataFrame) -> DataFrame:
    """Sources of a batch that nobody registered."""
    return batch.select("source").where(F.col("source").isNotNull()).distinct().join(registry.select("source"), "source", "left_anti")


def touch_sources(registry: DataFrame, batch: DataFrame, ts: Column) -> DataFrame:
    """Set the retrieval time of every source in a batch."""
    used = batch.select("source").distinct().withColumn("_used", F.lit(True))
    return registry.join(used, "source", "left").withColumn(
        "last_retrieved_ts", F.when(F.col("_used"), ts).otherwise(F.col("last_retrieved_ts"))
    ).select(*registry.columns)


def check_and_touch_sources(registry: DataFrame, batch: DataFrame, ts: Column, named: int = 100) -> DataFrame:
    """``touch_sources`` after making sure all sources are registered; the error counts all that are
    missing and names the first ``named``."""
    missing = missing_sources(registry, batch)
    names = [row["source"] for row in missing.orderBy("source").limit(named + 1).collect()]
    if names:
        more = missing.count() - named if len(names) > named else 0
        raise ValueError(f"sources are not registered: {', '.join(names[:named])}" + (f" and {more} more" if more else ""))
    return touch_sources(registry, batch, ts)


def countries_without_coordinates(dim: DataFrame, countries: DataFrame) -> DataFrame:
    known = dim.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).select("country")
    return countries.select("country").where(F.col("country").isNotNull()).distinct().join(known, "country", "left_anti")


def fill_country_locations(dim: DataFrame, countries: DataFrame, gazetteer: DataFrame) -> MergeResult:
    """Coordinates for countries that lack them, from a gazetteer; known values stay."""
    found = countries_without_coordinates(dim, countries).join(gazetteer.select("country", "latitude", "longitude"), "country")
    update = {c: F.coalesce(cur(c), new(c)) for c in ("latitude", "longitude")}
    return merge(dim, found, ["country"], F.lit(True), update)


def attach_coordinates(df: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Own coordinates if present, else those of (country, city), else of the country alone.

    ``gazetteer`` has country, city (null for the country itself), latitude, longitude.
    """
    key, town = F.upper(F.trim("country")), F.nullif(F.trim("city"), F.lit(""))
    keyed = df.withColumns({"_country": key, "_city": town})
    cities = gazetteer.where(F.col("city").isNotNull()).select(
        F.col("country").alias("_country"), F.col("city").alias("_city"), F.col("latitude").alias("_lat1"), F.col("longitude").alias("_lon1")
    )
    lands = gazetteer.where(F.col("city").isNull()).select(
        F.col("country").alias("_country"), F.col("latitude").alias("_lat2"), F.col("longitude").alias("_lon2")
    )
    joined = keyed.join(cities, ["_country", "_city"], "left").join(lands, "_country", "left")
    return joined.withColumns({
        "latitude": F.coalesce("latitude", "_lat1", "_lat2"), "longitude": F.coalesce("longitude", "_lon1", "_lon2")
    }).select(*df.columns)


def import_resolver_lists(spark, t, configs: Iterable[dict], iso: DataFrame | None = None, now: Column | None = None):
    """Resolver lists from landed text or CSV files, one import per config.

    A config has path, mapping, modules, source and optionally headers, header, separator,
    verified, force. Each import sees the resolver tables left by the one before. Returns one result
    per config, in their order, so several lists of one source keep a result each.
    """
    from resolvescope.plans.imports import import_resolvers
    from resolvescope.sources.readers import read_table

    results = []
    current = t
    for config in configs:
        headers = config.get("headers")
        columns = [h.strip() for h in headers.split(",")] if isinstance(headers, str) else headers
        path = config["path"]
        if path.endswith(".txt"):
            frame = spark.read.text(path).toDF(*(columns or ["value"]))
        else:
            frame = read_table(spark, path, config.get("header", columns is None), columns, config.get("separator", ","))
        result = import_resolvers(
            current, frame, config["mapping"], config["modules"], config["source"],
            config.get("verified", False), config.get("force", False), iso, now,
        )
        results.append(result)
        current = _Next(current, result)
    return results


class _Next:
    """Tables after an import, falling back to the ones before it."""

    def __init__(self, before, result):
        self._before, self._result = before, result

    def __getattr__(self, name):
        return self._result.table(name) if name in self._result.table_names else getattr(self._before, name)
