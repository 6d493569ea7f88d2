"""All metrics of a table in one row."""

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import LayoutConfig
from ..functions import NO_STRINGS, moment
from ..operators import file_profile, layout_profile, partition_sizes, table_detail
from ..operators.clustering import ddl_profile
from ..operators.failures import STEPS, step_errors
from ..operators.files import layout_figures
from ..operators.growth import growth_rate
from ..operators.history import LAST, status_figures
from ..operators.partitions import join_partition_measures, partition_figures, with_stated_counts
from ..operators.profile import history_totals
from ..schemas import KEY

# Values of a table without history or DDL rows; columns not listed stay null.
_DEFAULTS = {
    "total_commits": "0L",
    "write_count": "0L",
    "optimize_count": "0L",
    "vacuum_count": "0L",
    "merge_count": "0L",
    "delete_count": "0L",
    "update_count": "0L",
    "operation_summary": "CAST(map() AS MAP<STRING, BIGINT>)",
    "optimize_details": "CAST(array() AS ARRAY<STRUCT<version: BIGINT, timestamp: TIMESTAMP, parameters: MAP<STRING, STRING>>>)",
    "zorder_columns": NO_STRINGS,
    "zorder_usage_count": "0L",
    "predicate_optimizations": "0L",
    "daily_write_count": "0D",
    "avg_write_size_mb": "0D",
    "estimated_daily_growth_mb": "0D",
    "is_liquid_clustered": "false",
    "clustering_columns": NO_STRINGS,
}


def table_metrics(
    detail: DataFrame,
    ddl: DataFrame,
    files: DataFrame,
    history: DataFrame,
    config: LayoutConfig,
    as_of: datetime | Sequence[datetime],
    partitions: DataFrame | None = None,
    partition_counts: DataFrame | None = None,
    failures: DataFrame | None = None,
) -> DataFrame:
    """Left-join every metric onto the table detail; a missing metric gets its default.

    Each inventory is read once for all tables and comes down to one row per
    table before it is joined. The joined sides are as long as the list of
    tables; whether one is small enough to broadcast is left to Spark's own size
    check, since aggregates keep their table-key partitioning for a merge join.

    With several dates there is a row per table and date: only ages depend on the
    date, so rows are multiplied after all joins. ``failures`` and the errors of ``ddl``
    give a text per table and step, null where the step went well.
    """
    key = list(KEY)
    joined = table_detail(detail)
    if partitions is None:
        joined = joined.join(layout_profile(files, config), key, "left")
        joined = with_stated_counts(joined, partition_counts)
    else:
        joined = joined.join(file_profile(files, config), key, "left")
        joined = join_partition_measures(joined, partition_sizes(partitions), partition_counts)
    joined = joined.join(ddl_profile(ddl), key, "left").join(history_totals(history), key, "left")
    if failures is None:
        joined = joined.withColumns({f"{step}_error": F.lit(None).cast("string") for step in STEPS})
    else:
        joined = joined.join(step_errors(failures), key, "left")
    figures = {
        "ddl_error": "coalesce(ddl_error, ddl_failure)",
        **layout_figures(config),
        **{name: f"coalesce({name}, {value})" for name, value in _DEFAULTS.items()},
        "history_available": "total_commits IS NOT NULL",
        "growth_rate_pct_daily": growth_rate("coalesce(write_bytes_per_day, 0D)", "table_size_bytes"),
    }
    filled = joined.withColumns({name: F.expr(text) for name, text in figures.items()})
    dated = at_dates(partition_figures(filled.drop("write_bytes_per_day", "ddl_failure"), config), as_of)
    status = {name: F.expr(text) for name, text in status_figures("analysis_timestamp").items()}
    return dated.withColumns(status).drop(*LAST)


def at_dates(rows: DataFrame, as_of: datetime | Sequence[datetime]) -> DataFrame:
    """Add ``analysis_timestamp``: the date, or one row for each distinct date."""
    if isinstance(as_of, datetime):
        return rows.withColumn("analysis_timestamp", F.expr(moment(as_of)))
    if not as_of:
        raise ValueError("as_of needs at least one date")
    dates = ", ".join(moment(date) for date in sorted(set(as_of)))
    return rows.withColumn("analysis_timestamp", F.expr(f"explode(array({dates}))"))
