"""Apply the rules to table metrics; fold issues into counts and health."""

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import LayoutConfig
from ..functions import health_status
from ..functions.severity import ERROR
from ..schemas import KEY
from . import rules as R

_COUNTED = ("critical", "high", "medium", "low")

# Issues are sorted, so the first one is the worst.
_WORST = "try_element_at(issues, 1).severity"


def assess(metrics: DataFrame, config: LayoutConfig, rules: Iterable[str] = R.RULES) -> DataFrame:
    """Metrics with the issue array, its counts and the health of every table.

    All rules are one projection: no union, explode, shuffle or join. The issues
    of a table stand worst first, then in rule order: a struct sorts by its
    leading fields, which are exactly those two. An invalid table raises no issue
    and has the health ``error``. Metrics without error columns are taken as read without failures.
    """
    unstated = [c for c in R.ERROR_COLUMNS if c not in metrics.columns]
    metrics = metrics.withColumns({c: F.lit(None).cast("string") for c in unstated})
    found = ", ".join(R.raised(category, config) for category in rules)
    listed = metrics.withColumn("issues", F.expr(f"array_sort(array_compact(array({found})))"))
    folds = {
        "issue_count": "size(issues)",
        **{f"{s}_issues": f"size(filter(issues, i -> i.severity = '{s}'))" for s in _COUNTED},
        "health_status": f"CASE WHEN is_valid THEN {health_status(_WORST)} ELSE '{ERROR}' END",
    }
    return listed.withColumns({name: F.expr(text) for name, text in folds.items()})


def issues(assessed: DataFrame) -> DataFrame:
    """One row per issue, with its place in the table's list.

    An outer explode, since Spark infers a filter from an inner one that would
    apply all rules a second time.
    """
    rows = assessed.selectExpr(*KEY, "analysis_timestamp", "posexplode_outer(issues) AS (at, issue)")
    found = rows.filter("at IS NOT NULL")
    return found.selectExpr(*KEY, "at + 1 AS position", "issue.*", "analysis_timestamp")


def small_file_issues(metrics: DataFrame, config: LayoutConfig) -> DataFrame:
    """The small-file rule alone."""
    return issues(assess(metrics, config, rules=("small_files",)))


def issue_counts(assessed: DataFrame) -> DataFrame:
    """Issues per table, in total and by severity."""
    return assessed.select(*KEY, "issue_count", *[f"{severity}_issues" for severity in _COUNTED])


def table_health(assessed: DataFrame) -> DataFrame:
    """Health per table, with the worst severity it comes from."""
    return assessed.selectExpr(*KEY, f"coalesce({_WORST}, 'none') AS worst_severity", "health_status")
