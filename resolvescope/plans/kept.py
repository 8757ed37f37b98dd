"""Reports that are kept up to date by signed deltas instead of being computed again.

A kept report counts rows, or distinct values, per group. Its state is a table of reference counts: how
many rows stand behind each (group, measure, value). An import changes the rows of some identities only:
what they gave before is subtracted, what they give after is added, and a value leaves a distinct count
when its last row goes. State and tables are committed in one manifest, so readers never see one without
the other.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resolvescope.catalog import Catalog
from resolvescope.operators.merge import MergeResult, cur, merge, new
from resolvescope.plans.scope_reports import scope
from resolvescope.session import materialise
from resolvescope.sources.versions import write_versions

STATE = "target string, measure string, value string, n bigint"
CELL = ["target", "measure", "value"]


@dataclass(frozen=True)
class Measure:
    """Rows that satisfy an SQL condition, or the distinct values of a column in them."""

    name: str
    when: str = "true"
    of: str | None = None


@dataclass(frozen=True)
class KeptReport:
    """``rows(tables)`` gives rows with ``target``, and what the measures read. A row must follow from the rows
    of ``tables`` that have its ``key``; other relations it reads must not change between two imports."""

    name: str
    key: str
    tables: tuple[str, ...]
    rows: Callable
    measures: tuple[Measure, ...]

    @property
    def table(self) -> str:
        return f"kept_{self.name}"


class Restricted:
    """Relations of a report's key, reduced to some identities; all others as they are."""

    def __init__(self, tables, report: KeptReport, keys: DataFrame):
        self._tables, self._report, self._keys = tables, report, keys

    def __getattr__(self, name):
        frame = getattr(self._tables, name)
        return frame.join(self._keys, self._report.key, "left_semi") if name in self._report.tables else frame


class After:
    """The relations as an import leaves them."""

    def __init__(self, tables, result):
        self._tables, self._result = tables, result

    def __getattr__(self, name):
        return self._result.table(name) if name in self._result.table_names else getattr(self._tables, name)


def cells(report: KeptReport, rows: DataFrame, sign: int = 1) -> DataFrame:
    """Reference counts of a set of rows; counted map-side, so a hot group is a few rows."""
    value = lambda m: F.coalesce(F.col(m.of).cast("string"), F.lit("")) if m.of else F.lit("")
    known = lambda m: F.expr(m.when) & (F.col(m.of).isNotNull() if m.of else F.lit(True))
    marks = F.array(*[F.when(known(m), F.struct(F.lit(m.name).alias("measure"), value(m).alias("value"))) for m in report.measures])
    each = rows.select(F.col("target").cast("string").alias("target"), F.explode(marks).alias("mark")).where("mark is not null")
    return each.groupBy("target", "mark.measure", "mark.value").agg((F.count(F.lit(1)) * sign).alias("n"))


def full_state(report: KeptReport, tables) -> DataFrame:
    return cells(report, report.rows(tables))


def touched_keys(report: KeptReport, result) -> DataFrame | None:
    """Identities whose rows an import has inserted or changed, in any relation of the report."""
    found = [result.of_table(name).touched(report.key) for name in report.tables if name in result.table_names]
    return reduce(DataFrame.unionByName, found).distinct() if found else None


def signed_delta(report: KeptReport, tables, result, cut: Callable[[DataFrame], DataFrame] = materialise) -> DataFrame | None:
    """What an import adds to the state: minus what the touched identities gave, plus what they give now."""
    keys = touched_keys(report, result)
    if keys is None:
        return None
    keys = cut(keys)
    before = cells(report, report.rows(Restricted(tables, report, keys)), -1)
    after = cells(report, report.rows(Restricted(After(tables, result), report, keys)))
    return before.unionByName(after).groupBy(*CELL).agg(F.sum("n").alias("n")).where("n <> 0")


def apply_delta(state: DataFrame, delta: DataFrame) -> MergeResult:
    return merge(state, delta, CELL, F.lit(True), {"n": cur("n") + new("n")})


def read_report(report: KeptReport, state: DataFrame) -> DataFrame:
    """A row per group that still has rows, a column per measure."""
    left = state.where("n > 0")
    count = lambda m: F.sum(F.when(F.col("measure") == m.name, F.col("n") if m.of is None else F.lit(1)))
    return left.groupBy("target").agg(*[F.coalesce(count(m), F.lit(0)).cast("bigint").alias(m.name) for m in report.measures])


def kept_state(tables: Catalog, report: KeptReport) -> DataFrame | None:
    """The committed state of a report; None if it was never kept."""
    return tables.stored(report.table, STATE) if report.table in tables.versions else None


def keep(spark: SparkSession, root: str, reports: Sequence[KeptReport], tables: Catalog) -> None:
    """Start keeping reports: compute them once and commit their states."""
    write_versions(spark, root, {r.table: full_state(r, tables) for r in reports}, tables)


def commit_with_reports(spark: SparkSession, root: str, result, tables: Catalog, reports: Sequence[KeptReport], stream: tuple[str, int] | None = None) -> None:
    """Commit an import together with the reports it changes; a report that is not kept yet is computed in full."""
    written = {name: result.part(name) or result.table(name) for name in result.table_names}
    for report in reports:
        state, delta = kept_state(tables, report), signed_delta(report, tables, result)
        if state is None:
            written[report.table] = full_state(report, After(tables, result))
        elif delta is not None:
            written[report.table] = apply_delta(state, delta).table.where("n <> 0")
    write_versions(spark, root, written, tables, stream)


def _scope_rows(kind: str) -> Callable:
    def rows(t) -> DataFrame:
        qmin = t.qmin_resolver.select("resolver_id", "qmin")
        return scope(t, kind).join(t.resolver.select("resolver_id", "is_public", "source"), "resolver_id").join(qmin, "resolver_id", "left")

    return rows


_COUNTS = (
    Measure("resolver_count"), Measure("public_resolver_count", "is_public"), Measure("closed_resolver_count", "not is_public"),
    Measure("identity_count", of="resolver_id"), Measure("source_count", of="source"),
    *[Measure(f"qmin_{state}_count", f"qmin = '{state}'") for state in ("yes", "no", "unstable")],
)

COUNTRY_COUNTS = KeptReport("country_counts", "resolver_id", ("resolver", "resolver_location", "qmin_resolver"), _scope_rows("country"), _COUNTS)
ASN_COUNTS = KeptReport("asn_counts", "resolver_id", ("resolver", "resolver_asn", "qmin_resolver"), _scope_rows("asn"), _COUNTS)
