"""Connected components of an edge table, in rounds of joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resolvescope.session import materialise


def _fingerprint(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first())


def _oriented(links: DataFrame) -> DataFrame:
    ends = links.select(F.greatest("x", "y").alias("high"), F.least("x", "y").alias("low"))
    return ends.where("high <> low").distinct()


def connected_components(edges: DataFrame, x: str, y: str, cut: Callable[[DataFrame], DataFrame] = materialise) -> DataFrame:
    """(node, component) of every node of an edge; a component goes by its smallest node.

    Each round hangs the larger neighbours of a node on its smallest one, then the smaller neighbours.
    A node only ever needs the minimum over its neighbours, so nothing is gathered per component, and the
    number of links never grows. Every round is written; the rounds end when the links stay as they are,
    which takes about the logarithm of the longest chain. Edges with a missing end are no edges.
    """
    links = cut(_oriented(edges.select(F.col(x).alias("x"), F.col(y).alias("y")).where("x is not null and y is not null")))
    before, now = None, _fingerprint(links)
    while now != before:
        both = links.select(F.col("high").alias("x"), F.col("low").alias("y")).unionByName(links.select(F.col("low").alias("x"), F.col("high").alias("y")))
        least = both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("least"))
        upper = both.where("y > x").join(least, "x").select(F.col("y").alias("x"), F.col("least").alias("y"))
        upper = cut(_oriented(upper))
        lowest = upper.groupBy("high").agg(F.min("low").alias("lowest"))
        lower = upper.join(lowest, "high").select(F.col("low").alias("x"), F.col("lowest").alias("y")).unionByName(lowest.select(F.col("high").alias("x"), F.col("lowest").alias("y")))
        links = cut(_oriented(lower))
        before, now = now, _fingerprint(links)
    own = links.select(F.col("low").alias("node")).distinct()
    return links.select(F.col("high").alias("node"), F.col("low").alias("component")).unionByName(own.select("node", F.col("node").alias("component")))
