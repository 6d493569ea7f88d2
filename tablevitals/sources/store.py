"""Saved reports: append and read back.

A run is published in one step. Its report rows and its issue rows are appended first, each
in a job of its own, and then its keys (table and analysis time) to the table of published keys;
readers see a row once its key is there. Rows that are saved already are never appended again, so
a run that broke off half-way is completed by repeating it, and repeating a whole one adds nothing. Two
runs of one table and time at once are not kept apart.
"""

from __future__ import annotations

import logging
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession

from ..config import LayoutConfig
from ..plans.report import report_history
from ..schemas import KEY
from .catalog import ERRORS, quoted

if TYPE_CHECKING:
    from ..plans.analyze import Analysis

log = logging.getLogger(__name__)

# What tells the rows of reports apart, and those of issues.
RUN_KEY = (*KEY, "analysis_timestamp")
ISSUE_KEY = (*RUN_KEY, "issue_id")


def save_report(analysis: Analysis, config: LayoutConfig) -> bool:
    """Append the report and the issues to their tables; False if off or failed.

    ``run_analysis`` hands over rows that are computed already, one for each table. The
    schemas are fixed; formats that can merge schemas also take rows of earlier versions.
    """
    if not config.persist_results:
        log.info("saving reports is switched off")
        return False
    spark = analysis.tables.sparkSession
    try:
        spark.sql(f"CREATE SCHEMA IF NOT EXISTS {quoted(config.output_catalog, config.output_schema)}")
        keys = analysis.report.select(*RUN_KEY)
        _publish_earlier(spark, config)
        _append(analysis.report, config, config.output_table, RUN_KEY)
        _append(analysis.issues, config, config.output_issues_table, ISSUE_KEY)
        _append(keys, config, config.output_runs_table, RUN_KEY)
    except ERRORS:
        log.exception("cannot save to %s", config.output_table_name())
        return False
    return True


def _name(config: LayoutConfig, table: str) -> str:
    return quoted(config.output_catalog, config.output_schema, table)


def _append(rows: DataFrame, config: LayoutConfig, table: str, key: tuple[str, ...]) -> None:
    """Append the rows whose key the table does not hold yet."""
    spark, name = rows.sparkSession, _name(config, table)
    if spark.catalog.tableExists(name):
        rows = rows.join(spark.table(name).select(*key), list(key), "left_anti").select(*rows.columns)
    rows.write.mode("append").format(config.output_format).option("mergeSchema", "true").saveAsTable(name)


def _publish_earlier(spark: SparkSession, config: LayoutConfig) -> None:
    """Reports saved by versions that kept no published keys count as published."""
    reports, runs = _name(config, config.output_table), _name(config, config.output_runs_table)
    if spark.catalog.tableExists(reports) and not spark.catalog.tableExists(runs):
        _append(spark.table(reports).select(*RUN_KEY).distinct(), config, config.output_runs_table, RUN_KEY)


def _published(spark: SparkSession, config: LayoutConfig, table: str) -> DataFrame:
    rows, runs = spark.table(_name(config, table)), _name(config, config.output_runs_table)
    if not spark.catalog.tableExists(runs):
        return rows
    return rows.join(spark.table(runs), list(RUN_KEY), "left_semi").select(*rows.columns)


def read_reports(spark: SparkSession, config: LayoutConfig, limit: int | None = None) -> DataFrame:
    """Published report rows, newest first; the latest ones only if a limit is given."""
    return report_history(_published(spark, config, config.output_table), limit)


def read_issues(spark: SparkSession, config: LayoutConfig) -> DataFrame:
    """Published issue rows."""
    return _published(spark, config, config.output_issues_table)
