"""Every history figure of a table from one scan."""

from datetime import datetime

from pyspark.sql import DataFrame

from ..functions import moment
from ..schemas import KEY
from .growth import WRITE_FIGURES, WRITE_SUMS, with_writes
from .history import (
    COUNTS,
    LAST,
    OPERATION_SUMMARY,
    aggregate,
    by_day,
    named,
    over_days,
    status_figures,
    with_operation,
)
from .optimize import (
    DAY_SUMS,
    DETAIL_ALL,
    DETAIL_FIGURES,
    DETAIL_TEXTS,
    GAP_FIGURES,
    GAP_SUMS,
    ZORDER_ALL,
    ZORDER_FIGURES,
    ZORDER_SUMS,
    ZORDER_TEXTS,
    with_gaps,
    with_zorder,
)


def history_totals(history: DataFrame) -> DataFrame:
    """Counts, latest times, optimize and growth figures per table: all that no date enters.

    Commits come down to one row per table, day and operation in the tasks that read them. Only
    these rows are then sorted by day, for the gaps, and folded twice where they are: to one row
    per table and operation, and to one per table with its map of operations. Of a day's
    optimizes, and of all days, only the latest keep their parameters.
    """
    sums = (COUNTS, LAST, ZORDER_SUMS, WRITE_SUMS)
    prepared = with_writes(with_zorder(with_operation(history)))
    days = by_day(prepared, *sums, DAY_SUMS, ZORDER_TEXTS, DETAIL_TEXTS, by=("op",))
    merging = (over_days(*sums), ZORDER_ALL, DETAIL_ALL)
    operations = aggregate(with_gaps(days), *merging, GAP_SUMS, by=("op",))
    merged = aggregate(operations, *merging, over_days(GAP_SUMS), OPERATION_SUMMARY)
    figures = {**ZORDER_FIGURES, **GAP_FIGURES, **WRITE_FIGURES, **DETAIL_FIGURES}
    return merged.selectExpr(*KEY, *COUNTS, *LAST, "operation_summary", *named(figures))


def history_profile(history: DataFrame, as_of: datetime) -> DataFrame:
    """The figures of ``history_totals``, with maintenance times and ages at one date."""
    totals = history_totals(history)
    return totals.selectExpr(
        *[c for c in totals.columns if c not in LAST], *named(status_figures(moment(as_of)))
    )
