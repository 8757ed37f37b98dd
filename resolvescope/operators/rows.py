"""Row-level relational helpers: latest-wins, paging, distributions, membership."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from resolvescope.functions.clean import pc


def newest_first(ts: str = "last_update_ts", *ties: str) -> list[Column]:
    """Order newest first with nulls last, then ties ascending."""
    return [F.col(ts).desc_nulls_last(), *[F.col(t).asc_nulls_last() for t in ties]]


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column] | None = None) -> DataFrame:
    """One row per key: the first under ``order``, ties broken by all remaining columns.

    The filter on row number 1 lets Spark keep only each task's best row per key before the
    shuffle (window group limit), so a hot key does not move all of its rows.
    """
    order = list(order or newest_first())
    ties = [F.col(c).asc_nulls_last() for c in sorted(df.columns) if c not in keys]
    ranked = Window.partitionBy(*keys).orderBy(*order, *ties)
    return df.withColumn("_rank", F.row_number().over(ranked)).where(F.col("_rank") == 1).drop("_rank")


def keep_if_in(df: DataFrame, key: str, members: DataFrame) -> DataFrame:
    """Rows whose key occurs in the first column of ``members``."""
    return df.join(members.select(F.col(members.columns[0]).alias(key)).distinct(), key, "left_semi")


def keep_if_not_in(df: DataFrame, key: str, members: DataFrame) -> DataFrame:
    """Rows whose key is known and does not occur in ``members``."""
    others = members.select(F.col(members.columns[0]).alias(key)).distinct()
    return df.where(F.col(key).isNotNull()).join(others, key, "left_anti")


def new_keys(batch: DataFrame, current: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Batch rows whose key the current table lacks."""
    return batch.join(current.select(*keys), list(keys), "left_anti")


def distribution(df: DataFrame, value: str, scope: Sequence[str] = (), top: int | None = 10) -> DataFrame:
    """Counts of each non-null value with its share of the scope total, largest first.

    Rows are counted before the window, so a hot scope reaches it as one row per value.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*scope, F.col(value).alias("value")).agg(
        F.count(F.lit(1)).alias("count")
    )
    largest = [F.col("count").desc(), F.col("value")]
    if scope:
        group = Window.partitionBy(*scope)
        shared = counted.withColumns(
            {"_total": F.sum("count").over(group), "rank": F.row_number().over(group.orderBy(*largest))}
        )
        if top is not None:
            shared = shared.where(F.col("rank") <= top)
    else:
        shared = counted.withColumn("_total", counted.agg(F.sum("count")).scalar())
        if top is not None:
            shared = shared.orderBy(*largest).limit(top)
    return shared.withColumn("percent", pc(F.col("count"), F.col("_total"))).drop("_total")


def page(df: DataFrame, order: Sequence[Column], page: int = 1, size: int = 25, by: Sequence[str] = ()) -> DataFrame:
    """One page of an ordered result, per group when ``by`` is given."""
    if not by:
        return df.orderBy(*order).offset((page - 1) * size).limit(size)
    ranks = Window.partitionBy(*by).orderBy(*order)
    last = page * size
    kept = df.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= last)
    return kept.where(F.col("rank") > last - size) if page > 1 else kept


def dedupe_sessions(df: DataFrame, key: str = "session", fallback: str = "@id") -> DataFrame:
    """Drop repeated sessions of overlapping feed pages; rows without an id are all kept."""
    name = F.col(key).cast("string")
    if fallback in df.columns:
        name = F.coalesce(F.nullif(name, F.lit("")), F.col(f"`{fallback}`").cast("string"))
    keyed = df.withColumn("_session", F.nullif(name, F.lit("")))
    known = keyed.where(F.col("_session").isNotNull()).dropDuplicates(["_session"])
    return known.unionByName(keyed.where(F.col("_session").isNull())).drop("_session")


def one_row(spark, **frames: DataFrame) -> DataFrame:
    """Combine one-row aggregates into a single row through scalar subqueries."""
    return spark.range(1).select(*[frame.scalar().alias(name) for name, frame in frames.items()])
