"""Merge of a batch into a current table under a stated update policy.

Both sides are unique on the key, so one full outer join pairs them without skew; a policy is a
condition and a column expression per updated column over the structs ``cur`` and ``new``. The
job returns the next version of the table and a one-row report. Plain Parquet has no MERGE INTO:
the writer puts the new version next to the old one (``resolvescope.sources.versions``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from resolvescope.catalog import Layout, layout_of


@dataclass(frozen=True)
class Part:
    """The buckets of a stored table that a merge has touched, with their next rows."""

    layout: Layout
    numbers: tuple[int, ...]
    rows: DataFrame


@dataclass
class MergeResult:
    table: DataFrame
    report: DataFrame
    paired: DataFrame = field(repr=False)
    part: Part | None = field(default=None, repr=False)

    def with_report(self, report: DataFrame) -> "MergeResult":
        return replace(self, report=report)

    def touched(self, column: str) -> DataFrame:
        """Values of a column, before and after, in the rows that were inserted or updated."""
        changed = self.paired.where(F.col("change").isin("inserted", "updated"))
        both = changed.select(F.explode(F.array(cur(column), new(column))).alias(column))
        return both.where(F.col(column).isNotNull()).distinct()


def cur(name: str) -> Column:
    return F.col(f"cur.{name}")


def new(name: str) -> Column:
    return F.col(f"new.{name}")


def newer(ts: str = "last_update_ts") -> Column:
    """The batch stamp is known and later than the current one."""
    return F.coalesce(new(ts) > cur(ts), F.lit(False))


def differs(name: str) -> Column:
    return ~cur(name).eqNullSafe(new(name))


def any_of(*conditions: Column | bool) -> Column:
    out = F.lit(False)
    for condition in conditions:
        out = out | (F.lit(condition) if isinstance(condition, bool) else condition)
    return out


def stamp_now(now: Column | None) -> Column:
    return F.current_timestamp() if now is None else now


def pair(current: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of both sides by key, as structs; a missing side is null."""
    left = current.select(*keys, F.struct(*current.columns).alias("cur"))
    right = batch.select(*keys, F.struct(*batch.columns).alias("new"))
    return left.join(right, list(keys), "full_outer")


def merge(
    current: DataFrame,
    batch: DataFrame,
    keys: Sequence[str],
    update_when: Column,
    update: Mapping[str, Column],
    insert: Mapping[str, Column] | None = None,
    report: Mapping[str, Column] | None = None,
) -> MergeResult:
    """Apply a policy. Columns not named keep the current value, or take the batch value when
    inserted (null if the batch lacks them).

    A current table that is stored in buckets of these keys is merged in the buckets that the batch
    falls into; the others are neither read nor joined, and a commit names their files again."""
    layout = layout_of(current)
    if layout is not None and set(layout.keys) <= set(keys):
        hit = set(layout.hit_by(batch))
        touched = _merge(layout.read(hit), batch, keys, update_when, update, insert, report)
        rest = layout.read(set(layout.folders) - hit)
        return replace(touched, table=touched.table.unionByName(rest), part=Part(layout, tuple(sorted(hit)), touched.table))
    return _merge(current, batch, keys, update_when, update, insert, report)


def _merge(current: DataFrame, batch: DataFrame, keys: Sequence[str], update_when: Column, update: Mapping[str, Column],
           insert: Mapping[str, Column] | None, report: Mapping[str, Column] | None) -> MergeResult:
    insert = insert or {}
    paired = pair(current, batch, keys).withColumn(
        "change",
        F.when(F.col("cur").isNull(), "inserted")
        .when(F.col("new").isNull(), "kept")
        .when(update_when, "updated")
        .otherwise("unchanged"),
    )
    change = F.col("change")
    columns = []
    for item in current.schema:
        name = item.name
        if name in keys:
            columns.append(F.col(name))
            continue
        inserted = insert.get(name, new(name) if name in batch.columns else F.lit(None))
        value = F.when(change == "inserted", inserted)
        if name in update:
            value = value.when(change == "updated", update[name])
        columns.append(value.otherwise(cur(name)).cast(item.dataType).alias(name))
    table = paired.select(*[c for c in columns]).select(*current.columns)
    count = lambda what: F.count_if(change == what)
    staged = F.count_if(F.col("new").isNotNull())
    counters = {
        "candidates": staged,
        "inserted": count("inserted"),
        "updated": count("updated"),
        "skipped": count("unchanged"),
        **(report or {}),
    }
    return MergeResult(table, paired.agg(*[c.alias(n) for n, c in counters.items()]), paired)


def assign_ids(
    rows: DataFrame, highest: Column, bucket: Column, order: Sequence[Column], out: str = "id", only: Column | None = None
) -> DataFrame:
    """Dense ids after ``highest``, ordered by (bucket, order), for the rows that satisfy ``only``
    (null elsewhere).

    Rows are numbered inside buckets and shifted by the number of rows in earlier buckets, so no
    task sees more than one bucket. ``bucket`` must be an integer expression with a bounded
    number of values; the running total over buckets is the only single-task step.
    """
    wanted = F.lit(True) if only is None else only
    keyed = rows.withColumns({"_bucket": bucket, "_wanted": wanted})
    sizes = keyed.where("_wanted").groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy("_bucket", "_wanted").orderBy(*order)
    numbered = keyed.withColumn("_n", F.row_number().over(inside)).join(offsets, "_bucket", "left")
    number = F.coalesce(highest, F.lit(0)) + F.col("_before") + F.col("_n")
    return numbered.withColumn(out, F.when(F.col("_wanted"), number)).drop("_bucket", "_wanted", "_before", "_n")


def ip_bucket() -> Column:
    """Bucket of an address for ``assign_ids``: at most 131072 values.

    IPv4 buckets are /16 networks in address order and hold at most 65536 addresses. IPv6
    networks may be arbitrarily crowded, so those buckets are hashes and stay even.
    """
    v6 = F.lit(65536) + F.pmod(F.xxhash64("ip_hi", "ip_lo"), F.lit(65536))
    return F.when(F.col("family") == 4, F.shiftright("ip_lo", 16)).otherwise(v6)


def stack_reports(reports: Mapping[str, DataFrame]) -> DataFrame:
    """One report row per module; counters a module lacks are null."""
    out = None
    for name, frame in reports.items():
        row = frame.select(F.lit(name).alias("module"), "*")
        out = row if out is None else out.unionByName(row, allowMissingColumns=True)
    return out
