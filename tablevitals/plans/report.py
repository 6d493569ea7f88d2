"""Reports over assessed tables, and over saved reports."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import HEALTH, iso_text
from ..functions.severity import ERROR, HEALTHY
from ..schemas import ISSUES, KEY, TABLE_REPORT

_SUMMARY_FIELDS = {
    "id": "issue_id",
    "category": "category",
    "severity": "severity",
    "title": "title",
    "details": "details",
}

# The columns shown when saved reports are read back.
HISTORY_COLUMNS = (
    *KEY,
    "table_size_gb",
    "num_files",
    "avg_file_size_mb",
    "small_files_pct",
    "file_skew_severity",
    "is_partitioned",
    "is_liquid_clustered",
    "optimize_status",
    "vacuum_status",
    "health_status",
    "issue_count",
    "analysis_timestamp",
)


_COMMANDS = "array_compact(transform(issues, i -> i.sql_command))"
_SUMMARIES = "transform(issues, i -> struct({}))".format(
    ", ".join(f"i.{source} AS {name}" for name, source in _SUMMARY_FIELDS.items())
)

# Report columns that are not metrics as they stand, in their text form.
_MADE = {
    "partition_columns": "to_json(partition_columns)",
    "clustering_columns": "to_json(clustering_columns)",
    "zorder_columns": "to_json(zorder_columns)",
    "last_optimize": iso_text("last_optimize_timestamp"),
    "last_optimize_days_ago": "days_since_last_optimize",
    "last_vacuum": iso_text("last_vacuum_timestamp"),
    "last_vacuum_days_ago": "days_since_last_vacuum",
    "issues_summary": f"to_json({_SUMMARIES})",
    "sql_commands": f"to_json({_COMMANDS})",
    "analysis_timestamp": iso_text("analysis_timestamp"),
}

# A table that could not be analyzed shows no figures, only its error.
_INVALID = {
    "table_size_gb": "0",
    "num_files": "0",
    "avg_file_size_mb": "0",
    "small_files_pct": "0",
    "severe_small_files_pct": "0",
    "file_skew_ratio": "0",
    "file_skew_severity": "'none'",
    "is_partitioned": "false",
    "partition_count": "0",
    "partition_columns": "'[]'",
    "partition_skew_ratio": "0",
    "is_liquid_clustered": "false",
    "clustering_columns": "'[]'",
    "zorder_columns": "'[]'",
    "last_optimize": "NULL",
    "last_optimize_days_ago": "NULL",
    "optimize_status": "'Never'",
    "last_vacuum": "NULL",
    "last_vacuum_days_ago": "NULL",
    "vacuum_status": "'Never'",
}


def table_report(assessed: DataFrame) -> DataFrame:
    """The 33-column report, one row per table; lists are JSON, times ISO text."""

    def column(field) -> str:
        value = _MADE.get(field.name, f"`{field.name}`")
        if field.name in _INVALID:
            value = f"CASE WHEN is_valid THEN {value} ELSE {_INVALID[field.name]} END"
        return f"CAST({value} AS {field.dataType.simpleString()}) AS `{field.name}`"

    return assessed.selectExpr(*[column(f) for f in TABLE_REPORT.fields])


def extended_report(assessed: DataFrame) -> DataFrame:
    """Every metric in its own type: arrays, maps, timestamps, issue structs.

    Adds what the 33 columns leave out, such as growth, partition-skew severity
    and where the layout figures come from.
    """
    return assessed.withColumn("sql_commands", F.expr(_COMMANDS))


def issue_report(issue_rows: DataFrame) -> DataFrame:
    """The 13-column issue report; it keeps its schema when there is no issue."""
    when = F.expr(iso_text("analysis_timestamp"))
    return issue_rows.withColumn("analysis_timestamp", when).select(*ISSUES.names)


def fleet_summary(assessed: DataFrame) -> DataFrame:
    """Tables in total and per health status, in one row."""
    statuses = (HEALTHY, *reversed(HEALTH.values()), ERROR)
    return assessed.agg(
        F.count(F.lit(1)).alias("tables"),
        *[F.count_if(F.col("health_status") == s).alias(s) for s in statuses],
    )


def maintenance_sql(assessed: DataFrame) -> DataFrame:
    """Suggested statements, worst issue first, for the tables that have any."""
    listed = assessed.selectExpr(
        *KEY, "full_name", "health_status", f"posexplode_outer({_COMMANDS}) AS (at, statement)"
    )
    stated = listed.filter("at IS NOT NULL")
    return stated.selectExpr(*KEY, "full_name", "health_status", "at + 1 AS step", "statement")


def _newest_first(*columns: str) -> list:
    """Moments are compared as such, not as text; rows of one moment stand in a fixed order."""
    rest = [c for c in HISTORY_COLUMNS if c not in (*KEY, "analysis_timestamp")]
    return [F.to_timestamp("analysis_timestamp").desc(), *[F.col(c) for c in (*columns, *rest)]]


def report_history(saved: DataFrame, limit: int | None = None) -> DataFrame:
    """Saved report rows, newest first; only the latest ones if a limit is given."""
    ordered = saved.select(*HISTORY_COLUMNS).orderBy(*_newest_first(*KEY))
    return ordered if limit is None else ordered.limit(limit)


def latest_reports(saved: DataFrame) -> DataFrame:
    """The newest saved row of each table."""
    window = Window.partitionBy(*KEY).orderBy(*_newest_first())
    ranked = saved.select(*HISTORY_COLUMNS, F.row_number().over(window).alias("_rank"))
    return ranked.filter("_rank = 1").drop("_rank")
