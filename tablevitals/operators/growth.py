"""Growth: write frequency, bytes written, and weekday pattern, over all commits."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import digits_to_number, floor_days, round_binary, weekday_name
from ..functions.numbers import MIB
from ..schemas import KEY
from .history import aggregate, named

# Commits that change rows, and where they state written bytes.
MUTATIONS = ("WRITE", "MERGE", "UPDATE", "DELETE")
BYTE_METRICS = ("numOutputBytes", "numAddedBytes")

# Weekday names in English, as date_format writes them.
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")

_IS_MUTATION = f"upper(operation) IN {MUTATIONS}"


def mutations(history: DataFrame) -> DataFrame:
    return history.filter(_IS_MUTATION)


def with_writes(history: DataFrame) -> DataFrame:
    """Add time, weekday and bytes of row-changing commits; null for the others.

    The first non-empty byte metric counts: "0" ends the search, and text without
    digits is 0. Commits without any metric have no bytes.
    """
    stated = ", ".join(f"nullif(try_element_at(operationMetrics, '{m}'), '')" for m in BYTE_METRICS)
    has_metrics = f"{_IS_MUTATION} AND size(operationMetrics) > 0"
    return (
        history.withColumn("byte_metric", F.expr(f"coalesce({stated})"))
        .withColumn("is_mutation", F.expr(f"coalesce({_IS_MUTATION}, false)"))
        .withColumns(
            {
                "written_at": F.expr("CASE WHEN is_mutation THEN timestamp END"),
                "weekday": F.expr(f"CASE WHEN is_mutation THEN {weekday_name('timestamp')} END"),
                "written": F.expr(f"CASE WHEN {has_metrics} THEN {digits_to_number('byte_metric')} END"),
            }
        )
    )


WRITE_SUMS = {
    "writes": "count_if(is_mutation)",
    "first_write": "min(written_at)",
    "newest_write": "max(written_at)",
    "bytes_written": "CAST(sum(written) AS DECIMAL(38, 0))",
    "writes_with_metrics": "count(written)",
    **{f"n_{day}": f"count_if(weekday = '{day}')" for day in WEEKDAYS},
    **{f"v_{day}": f"max(CASE WHEN weekday = '{day}' THEN version END)" for day in WEEKDAYS},
}

_SPAN = f"CAST(greatest({floor_days('newest_write', 'first_write')}, 1) AS DOUBLE)"
_TOTAL = "CAST(coalesce(bytes_written, 0) AS DOUBLE)"
_PER_WRITE = f"try_divide({_TOTAL}, CAST(writes_with_metrics AS DOUBLE))"
_PER_DAY = f"CASE WHEN writes >= 2 AND writes_with_metrics > 0 THEN {_TOTAL} / {_SPAN} END"
_DAYS = ", ".join(
    f"named_struct('commits', n_{day}, 'newest_version', v_{day}, 'day', '{day}')" for day in WEEKDAYS
)
_PATTERN = f"filter(array({_DAYS}), d -> writes >= 2 AND d.commits > 0)"

# ``write_bytes_per_day`` is unrounded. The busiest day has the most commits;
# among equals it is the one met first, newest commit first.
WRITE_FIGURES = {
    "daily_write_count": f"CASE WHEN writes >= 2 THEN {round_binary(f'CAST(writes AS DOUBLE) / {_SPAN}')} ELSE 0D END",
    "avg_write_size_mb": f"coalesce({round_binary(f'{_PER_WRITE} / {MIB}D')}, 0D)",
    "estimated_daily_growth_mb": f"coalesce({round_binary(f'({_PER_DAY}) / {MIB}D')}, 0D)",
    "write_bytes_per_day": f"coalesce({_PER_DAY}, 0D)",
    "write_patterns": f"map_from_entries(transform({_PATTERN}, d -> struct(d.day, d.commits)))",
    "busiest_day": f"array_max({_PATTERN}).day",
}


def growth_rate(bytes_per_day: str, table_bytes: str) -> str:
    """Daily growth in percent of the table size, 4 decimals; 0 for an empty table."""
    share = round_binary(f"try_divide(100D * {bytes_per_day}, CAST({table_bytes} AS DOUBLE))", 4)
    return f"coalesce(CASE WHEN {table_bytes} > 0 THEN {share} END, 0D)"


def growth(history: DataFrame, detail: DataFrame) -> DataFrame:
    """Growth of every table with a row-changing commit."""
    sums = aggregate(with_writes(mutations(history)), WRITE_SUMS)
    figured = sums.selectExpr(*KEY, "writes", *named(WRITE_FIGURES))
    sizes = detail.select(*KEY, "table_size_bytes")
    return figured.join(sizes, list(KEY), "left").selectExpr(
        *KEY,
        "writes AS mutating_commits",
        "daily_write_count",
        "avg_write_size_mb",
        "estimated_daily_growth_mb",
        f"{growth_rate('write_bytes_per_day', 'table_size_bytes')} AS growth_rate_pct_daily",
        "busiest_day",
    )


def weekday_pattern(history: DataFrame) -> DataFrame:
    """Row-changing commits by weekday, and the busiest day, for tables with two or more."""
    sums = aggregate(with_writes(mutations(history)), WRITE_SUMS).filter("writes >= 2")
    return sums.selectExpr(*KEY, *named(WRITE_FIGURES)).select(*KEY, "write_patterns", "busiest_day")
