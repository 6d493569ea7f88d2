"""Commit history: the newest commits per table, operation counts, last maintenance.

All figures but ``recent_history`` are over every commit. They are counts, sums,
minima and maxima, so each task folds its commits before the shuffle and a table
with most of the commits costs no more than any other.
"""

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import age_text, floor_days, moment, operation_name
from ..schemas import KEY
from .first import first_per_table

# The operations followed, by upper-cased name.
TRACKED = ("WRITE", "OPTIMIZE", "VACUUM END", "VACUUM START", "MERGE", "DELETE", "UPDATE")


def recent_history(history: DataFrame, n: int) -> DataFrame:
    """The newest n commits of each table."""
    if n < 1:
        raise ValueError("n must be at least 1")
    return first_per_table(history, [F.col("version").desc()], n, spread="version")


def operation_counts(history: DataFrame) -> DataFrame:
    """Commits per table and upper-cased operation."""
    operation = F.expr(operation_name("operation")).alias("operation")
    return history.groupBy(*KEY, operation).agg(F.count(F.lit(1)).alias("commits"))


def with_operation(history: DataFrame) -> DataFrame:
    """Add the upper-cased operation once, for the aggregates below."""
    return history.withColumn("op", F.expr(operation_name("operation")))


# Counts by exact name; a vacuum counts its START and its END.
COUNTS = {
    "total_commits": "count(1)",
    "write_count": "count_if(op = 'WRITE')",
    "optimize_count": "count_if(op = 'OPTIMIZE')",
    "vacuum_count": "count_if(op IN ('VACUUM START', 'VACUUM END'))",
    "merge_count": "count_if(op = 'MERGE')",
    "delete_count": "count_if(op = 'DELETE')",
    "update_count": "count_if(op = 'UPDATE')",
}

# Commits by any operation name.
OPERATION_SUMMARY = {"operation_summary": "map_from_entries(sort_array(collect_list(struct(op, total_commits))))"}

# Latest time per tracked name, found anywhere within the operation: STREAMING
# UPDATE moves the last UPDATE, though it is not counted as one.
LAST = {
    "last_" + name.lower().replace(" ", "_"): f"max(CASE WHEN contains(op, '{name}') THEN timestamp END)"
    for name in TRACKED
}


def aggregate(rows: DataFrame, *aggregates: dict[str, str], by: tuple[str, ...] = ()) -> DataFrame:
    """One row per table (and columns of ``by``) of the given named aggregates."""
    columns = [F.expr(text).alias(name) for group in aggregates for name, text in group.items()]
    return rows.groupBy(*KEY, *by).agg(*columns)


def by_day(rows: DataFrame, *aggregates: dict[str, str], by: tuple[str, ...] = ()) -> DataFrame:
    """One row per table and UTC day (and columns of ``by``) of the given named aggregates."""
    columns = [F.expr(text).alias(name) for group in aggregates for name, text in group.items()]
    return rows.groupBy(*KEY, *by, F.expr("floor(unix_seconds(timestamp) / 86400)").alias("day")).agg(*columns)


def over_days(*aggregates: dict[str, str]) -> dict[str, str]:
    """The aggregates that merge those of single days: minima, maxima, and sums of the rest."""
    kind = {name: text[:3] if text[:4] in ("min(", "max(") else "sum" for group in aggregates for name, text in group.items()}
    return {name: f"{fold}({name})" for name, fold in kind.items()}


def operation_pivot(history: DataFrame) -> DataFrame:
    """One row of operation counts per table."""
    return aggregate(with_operation(history), COUNTS)


def last_operations(history: DataFrame) -> DataFrame:
    """One row of latest times per table."""
    return aggregate(with_operation(history), LAST)


def status_figures(as_of: str) -> dict[str, str]:
    """Maintenance times and ages, at a time given as an expression, over the columns of ``last_operations``.

    A finished vacuum wins over a started one even when the start is newer.
    """
    vacuum = "coalesce(last_vacuum_end, last_vacuum_start)"
    optimized, vacuumed = floor_days(as_of, "last_optimize"), floor_days(as_of, vacuum)
    return {
        "last_write_timestamp": "last_write",
        "last_optimize_timestamp": "last_optimize",
        "last_vacuum_timestamp": vacuum,
        "last_merge_timestamp": "last_merge",
        "days_since_last_write": floor_days(as_of, "last_write"),
        "days_since_last_optimize": optimized,
        "days_since_last_vacuum": vacuumed,
        "optimize_status": age_text(optimized, never="Never run"),
        "vacuum_status": age_text(vacuumed, never="Never run"),
    }


def named(figures: dict[str, str]) -> list[str]:
    return [f"{text} AS {name}" for name, text in figures.items()]


def maintenance_status(history: DataFrame, as_of: datetime) -> DataFrame:
    """Last write, optimize, vacuum and merge with their ages at ``as_of``."""
    return last_operations(history).selectExpr(*KEY, *named(status_figures(moment(as_of))))
