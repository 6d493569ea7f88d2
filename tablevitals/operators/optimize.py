"""Compaction history: cadence, z-order columns, and the latest runs.

Nothing here sorts commits or gathers them in one place. Gaps between optimizes of
one UTC day are below a whole day, so a day's first and last optimize are all that
counts, and only days are put in order. Z-order parameters are few distinct texts.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import floor_days, parse_zorder, round_binary
from ..schemas import KEY
from .first import first_per_table
from .history import aggregate, by_day, named, over_days

_IS_OPTIMIZE = "coalesce(upper(operation) = 'OPTIMIZE', false)"

# Usage counts take any non-empty text, [] included.
ZORDER_SUMS = {
    "zorder_usage_count": "count_if(zorder_by <> '')",
    "predicate_optimizations": "count_if(optimize_predicate <> '')",
}
# Distinct texts of a group, and later the names in them.
ZORDER_TEXTS = {"zorder_texts": "collect_set(nullif(zorder_by, ''))"}
ZORDER_ALL = {"zorder_texts": "array_distinct(flatten(collect_set(zorder_texts)))"}
ZORDER_FIGURES = {
    "zorder_columns": f"array_sort(array_distinct(flatten(transform(zorder_texts, t -> {parse_zorder('t')}))))",
    "zorder_usage_count": "zorder_usage_count",
    "predicate_optimizations": "predicate_optimizations",
}

# The latest optimizes with parameters: the latest of a day, then those among the latest of days.
DETAILS = 5
_NEWEST = "slice(sort_array({}, false), 1, " + str(DETAILS) + ")"
_DETAIL = (
    f"CASE WHEN {_IS_OPTIMIZE} AND size(operationParameters) > 0 "
    "THEN struct(timestamp, version, sort_array(map_entries(operationParameters)) AS entries) END"
)
DETAIL_TEXTS = {"optimize_details": _NEWEST.format(f"collect_list({_DETAIL})")}
DETAIL_ALL = {"optimize_details": _NEWEST.format("flatten(collect_list(optimize_details))")}
DETAIL_FIGURES = {
    "optimize_details": "transform(optimize_details, d -> struct(d.version AS version, d.timestamp AS timestamp, "
    "map_from_entries(d.entries) AS parameters))"
}

# Of one day, and of all days.
DAY_SUMS = {
    "first_optimize": f"min(CASE WHEN {_IS_OPTIMIZE} THEN timestamp END)",
    "newest_optimize": f"max(CASE WHEN {_IS_OPTIMIZE} THEN timestamp END)",
    "timed_optimizes": f"count_if({_IS_OPTIMIZE} AND timestamp IS NOT NULL)",
}
GAP_SUMS = {"gap_sum": "sum(gap_days)", "timed_optimizes": "sum(timed_optimizes)"}
GAP_FIGURES = {
    "optimize_frequency_days": round_binary(
        "CASE WHEN timed_optimizes > 1 "
        "THEN CAST(coalesce(gap_sum, 0L) AS DOUBLE) / CAST(timed_optimizes - 1 AS DOUBLE) END",
        1,
    )
}


def optimize_commits(history: DataFrame) -> DataFrame:
    return history.filter("upper(operation) = 'OPTIMIZE'")


def with_gaps(days: DataFrame) -> DataFrame:
    """Add ``gap_days``: whole days from a day's first optimize back to the last one of an earlier day."""
    names = ", ".join(f"`{k}`" for k in KEY)
    before = (
        f"last(newest_optimize, true) OVER (PARTITION BY {names} ORDER BY day "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    )
    return days.withColumn("gap_days", F.expr(floor_days("first_optimize", before)))


def with_zorder(history: DataFrame) -> DataFrame:
    """Add the z-order and predicate parameters of each optimize."""

    def parameter(name: str):
        return F.expr(f"CASE WHEN {_IS_OPTIMIZE} THEN try_element_at(operationParameters, '{name}') END")

    return history.withColumns(
        {"zorder_by": parameter("zOrderBy"), "optimize_predicate": parameter("predicate")}
    )


def optimize_cadence(history: DataFrame) -> DataFrame:
    """Optimize count, latest optimize, and mean whole-day gap between optimizes."""
    head = {"optimize_count": "count(1)", "last_optimize_timestamp": "max(timestamp)"}
    days = with_gaps(by_day(optimize_commits(history), head, DAY_SUMS))
    sums = aggregate(days, over_days(head), GAP_SUMS)
    return sums.selectExpr(*KEY, *head, *named(GAP_FIGURES))


def zorder_columns(history: DataFrame) -> DataFrame:
    """Distinct z-order columns over a table's optimizes, and how often it z-ordered."""
    sums = aggregate(with_zorder(optimize_commits(history)), ZORDER_SUMS, ZORDER_TEXTS)
    return sums.selectExpr(*KEY, *named(ZORDER_FIGURES))


def recent_optimizes(history: DataFrame, n: int = 5) -> DataFrame:
    """The n latest optimizes with parameters, newest first (``position`` from 1)."""
    stated = optimize_commits(history).filter("size(operationParameters) > 0")
    order = [F.col("timestamp").desc(), F.col("version").desc()]
    return first_per_table(stated, order, n, spread="version", rank="position").selectExpr(
        *KEY, "position", "version", "timestamp", "operationParameters AS parameters"
    )
