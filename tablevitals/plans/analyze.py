"""Entry points: analyze inventories that exist, or collect and analyze a scope."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from datetime import datetime, timezone
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession

from ..config import LayoutConfig
from ..operators import in_scope, supported_tables
from ..schemas import KEY
from . import report as reports
from .assess import assess, issues
from .metrics import table_metrics

if TYPE_CHECKING:
    from ..sources.scratch import Scratch


@dataclass(frozen=True)
class Inventories:
    """The inputs of an analysis, each for all tables at once.

    ``partitions`` and ``partition_counts`` are optional: without them partition
    sizes and counts come from the file inventory. ``failures`` says what could not
    be read, see ``schemas.FAILURES``.
    """

    detail: DataFrame
    ddl: DataFrame
    files: DataFrame
    history: DataFrame
    partitions: DataFrame | None = None
    partition_counts: DataFrame | None = None
    failures: DataFrame | None = None

    def map(self, change) -> Inventories:
        """The same inventories with ``change`` applied to each."""
        frames = {name: getattr(self, name) for name in self.__dataclass_fields__}
        return replace(self, **{n: change(f) for n, f in frames.items() if f is not None})


@dataclass(frozen=True)
class Analysis:
    """Lazy results; everything derives from ``tables``, one row per table (and date).

    That of ``run_analysis`` owns the stored rows it reads, and as a context manager deletes them.
    ``failures`` are the rows behind the error columns, and those of scopes that could not be listed.
    """

    tables: DataFrame
    failures: DataFrame | None = None
    scratch: Scratch | None = None

    def close(self) -> None:
        """Delete the stored rows that ``run_analysis`` made; results cannot be read afterwards."""
        if self.scratch is not None:
            self.scratch.close()

    def __enter__(self) -> Analysis:
        return self

    def __exit__(self, *error) -> None:
        self.close()

    @property
    def report(self) -> DataFrame:
        return reports.table_report(self.tables)

    @property
    def issues(self) -> DataFrame:
        return reports.issue_report(issues(self.tables))

    @property
    def summary(self) -> DataFrame:
        return reports.fleet_summary(self.tables)

    @property
    def maintenance(self) -> DataFrame:
        return reports.maintenance_sql(self.tables)


def analyze(inputs: Inventories, config: LayoutConfig, as_of: datetime | Sequence[datetime]) -> Analysis:
    """Analyze every table of the inventories as of the given time, or of several in one plan."""
    metrics = table_metrics(
        inputs.detail,
        inputs.ddl,
        inputs.files,
        inputs.history,
        config,
        as_of,
        partitions=inputs.partitions,
        partition_counts=inputs.partition_counts,
        failures=inputs.failures,
    )
    return Analysis(assess(metrics, config), inputs.failures)


def analyze_scope(inputs: Inventories, config: LayoutConfig, as_of: datetime | Sequence[datetime]) -> Analysis:
    """Analyze the configured scope of the inventories.

    A schema or catalog scan skips tables in another format; a single table in
    another format is reported with its error.
    """
    scoped = inputs.map(lambda rows: in_scope(rows, config))
    if inputs.failures is not None:
        # What failed before there was a table stays in sight.
        untold = inputs.failures.filter("`table` IS NULL")
        scoped = replace(scoped, failures=untold.unionByName(scoped.failures.filter("`table` IS NOT NULL")))
    if config.scan_mode != "single_table":
        keys = supported_tables(scoped.detail)
        scoped = replace(scoped, detail=scoped.detail.join(keys, list(KEY), "left_semi"))
    return analyze(scoped, config, as_of)


def run_analysis(
    spark: SparkSession,
    config: LayoutConfig,
    as_of: datetime | None = None,
    inputs: Inventories | None = None,
) -> Analysis:
    """Collect the scope's inventories unless given, analyze, and save the reports.

    The row of each table is computed once and kept below the scratch folder; report,
    issues, summary and statements, saved or shown, all start from there. Snapshots of inventories are
    deleted when the rows are computed; the rows are deleted with the result::

        with run_analysis(spark, config) as result:
            result.issues.show()

    A run that fails leaves nothing behind.
    """
    from ..sources import collect_inventories, save_report
    from ..sources.scratch import Scratch, stored

    as_of = as_of or datetime.now(timezone.utc)
    scratch = Scratch(spark, "analysis")
    try:
        with Scratch(spark, "inventories") as snapshots:
            inputs = inputs or collect_inventories(spark, config, snapshots.base)
            analysis = analyze_scope(inputs, config, as_of)
            tables = stored(analysis.tables, "tables", scratch)
            failures = analysis.failures
            failures = None if failures is None else stored(failures, "failures", scratch)
        analysis = Analysis(tables, failures, scratch)
        if config.persist_results:
            save_report(analysis, config)
    except BaseException:
        scratch.close()
        raise
    return analysis
