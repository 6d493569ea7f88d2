"""The issue rules: each one is a condition and the texts of the issue it raises.

Issue ids, categories, severities, conditions and the order of the rules are
fixed values: saved issues of earlier runs must stay comparable.

Points decided on purpose:

* A stale or never-run optimize suggests one valid statement, with its z-order
  columns inside it.
* Identifiers in statements are back-quoted.
* A table without history counts as never optimized and never vacuumed; the
  metrics carry ``history_available`` for those who want to tell them apart.
* What could not be read is not known to be missing: where the history or the DDL
  failed, no rule says that something was never done (see ``history_error``, ``ddl_error``).
* Clustered tables above the large-table limit are still asked to partition.
* Partition skew is raised above ``partition_skew_threshold`` only, and never
  with the tier none when that threshold is set below the lowest tier.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from ..config import LayoutConfig
from ..functions import number_text, quoted_list, quoted_name, severity_order, sql_string

ISSUE_FIELDS = (
    "severity_order",
    "rule_no",
    "issue_id",
    "category",
    "severity",
    "title",
    "details",
    "current_value",
    "threshold",
    "recommendation",
    "sql_command",
)


@dataclass(frozen=True)
class Issue:
    """One outcome of a rule; all fields are SQL expression texts."""

    when: str
    issue_id: str
    severity: str
    title: str
    details: str
    current_value: str
    threshold: str
    recommendation: str
    sql_command: str = "CAST(NULL AS STRING)"


# Columns of failed steps that rules look at.
ERROR_COLUMNS = ("history_error", "ddl_error")

Rule = Callable[[LayoutConfig], tuple[Issue, ...]]

_lit = sql_string


class _Value(str):
    """An expression inside a text, as opposed to literal words."""


def _join(*parts: str) -> str:
    """Concatenate literal words and ``_Value`` expressions."""
    return f"concat({', '.join(p if isinstance(p, _Value) else _lit(p) for p in parts)})"


def _plain(limit: float) -> str:
    """A configured limit as short text: 32, 0.5, 1000."""
    return f"{limit:g}" if limit < 1e6 else f"{limit:,.0f}"


def _number(column: str, digits: int = 2) -> _Value:
    return _Value(number_text(column, digits))


_NAME = _Value(quoted_name())
_COMPACT = _join("OPTIMIZE ", _NAME, ";")
# OPTIMIZE with the z-order columns the table was ordered by before.
_REORDER = _join(
    "OPTIMIZE ",
    _NAME,
    _Value(
        "CASE WHEN size(zorder_columns) > 0 "
        f"THEN concat(' ZORDER BY (', {quoted_list('zorder_columns')}, ')') ELSE '' END"
    ),
    ";",
)


def small_files(config: LayoutConfig) -> tuple[Issue, ...]:
    severe, acceptable = _plain(config.small_file_severe_mb), _plain(config.small_file_acceptable_mb)
    files = (_number("num_files", 0), " files of ", _number("avg_file_size_mb"), " MB on average; ")
    average = (_number("avg_file_size_mb"), " MB average, ")
    under_severe = (_number("severe_small_files_pct"), "%")
    under_acceptable = (_number("small_files_pct"), "%")
    return (
        Issue(
            when=f"num_files > 0 AND avg_file_size_mb > 0 "
            f"AND (avg_file_size_mb < {config.small_file_severe_mb}D "
            f"OR severe_small_files_pct > {config.small_files_pct_critical}D)",
            issue_id=_lit("SMALL_FILES_CRITICAL"),
            severity=_lit("critical"),
            title=_lit("Most files are far too small"),
            details=_join(
                *files, *under_severe, f" are under {severe} MB and ", *under_acceptable, f" under {acceptable} MB"
            ),
            current_value=_join(*average, *under_severe, f" under {severe} MB"),
            threshold=_lit(
                f"average of {severe} MB or more, at most "
                f"{_plain(config.small_files_pct_critical)}% under {severe} MB"
            ),
            recommendation=_lit("Compact the table now, then write larger batches so that it stays compact."),
            sql_command=_COMPACT,
        ),
        Issue(
            when=f"num_files > 0 AND avg_file_size_mb > 0 "
            f"AND (avg_file_size_mb < {config.small_file_acceptable_mb}D "
            f"OR small_files_pct > {config.small_files_pct_warning}D)",
            issue_id=_lit("SMALL_FILES_WARNING"),
            severity=_lit("medium"),
            title=_lit("Many files are small"),
            details=_join(*files, *under_acceptable, f" are under {acceptable} MB"),
            current_value=_join(*average, *under_acceptable, f" under {acceptable} MB"),
            threshold=_lit(
                f"average of {acceptable} MB or more, at most "
                f"{_plain(config.small_files_pct_warning)}% under {acceptable} MB"
            ),
            recommendation=_lit("Compact the table and put compaction on a schedule."),
            sql_command=_COMPACT,
        ),
    )


def file_skew(config: LayoutConfig) -> tuple[Issue, ...]:
    return (
        Issue(
            when="file_skew_severity <> 'none'",
            issue_id="concat('FILE_SKEW_', upper(file_skew_severity))",
            severity="file_skew_severity",
            title=_join("File sizes are uneven (", _Value("initcap(file_skew_severity)"), ")"),
            details=_join(
                "Largest file ",
                _number("max_file_size_mb"),
                " MB, median ",
                _number("median_file_size_mb"),
                " MB, smallest ",
                _number("min_file_size_mb"),
                " MB; coefficient of variation ",
                _number("coefficient_of_variation"),
                "%",
            ),
            current_value=_join("largest file is ", _number("file_skew_ratio"), " times the median"),
            threshold=_lit(f"at most {_plain(config.skew_low_threshold)} times"),
            recommendation=_lit(
                "Look at how the table is written, and spread rows evenly over tasks before writing."
            ),
        ),
    )


def stale_optimize(config: LayoutConfig) -> tuple[Issue, ...]:
    limit = _lit(f"optimized within {config.optimize_stale_days} days")
    age = _Value("days_since_last_optimize")
    return (
        Issue(
            when="days_since_last_optimize IS NULL AND history_error IS NULL",
            issue_id=_lit("OPTIMIZE_NEVER_RUN"),
            severity=_lit("high"),
            title=_lit("Never compacted"),
            details=_lit("No OPTIMIZE is found in the commits looked at."),
            current_value=_lit("never"),
            threshold=limit,
            recommendation=_lit("Compact the table and put compaction on a schedule."),
            sql_command=_REORDER,
        ),
        Issue(
            when=f"days_since_last_optimize > {config.optimize_stale_days}",
            issue_id=_lit("OPTIMIZE_STALE"),
            severity=_lit("medium"),
            title=_lit("Compaction is overdue"),
            details=_join("The last OPTIMIZE is ", age, " days old."),
            current_value=_join(age, " days ago"),
            threshold=limit,
            recommendation=_lit("Compact the table, and do so more often."),
            sql_command=_REORDER,
        ),
    )


def stale_vacuum(config: LayoutConfig) -> tuple[Issue, ...]:
    limit = _lit(f"vacuumed within {config.vacuum_stale_days} days")
    age = _Value("days_since_last_vacuum")
    command = _join("VACUUM ", _NAME, f" RETAIN {config.vacuum_retain_hours} HOURS;")
    return (
        Issue(
            when="days_since_last_vacuum IS NULL AND history_error IS NULL",
            issue_id=_lit("VACUUM_NEVER_RUN"),
            severity=_lit("medium"),
            title=_lit("Never vacuumed"),
            details=_lit("No VACUUM is found in the commits looked at."),
            current_value=_lit("never"),
            threshold=limit,
            recommendation=_lit(
                "Vacuum the table to free the space of files no longer in use, and repeat it on a schedule."
            ),
            sql_command=command,
        ),
        Issue(
            when=f"days_since_last_vacuum > {config.vacuum_stale_days}",
            issue_id=_lit("VACUUM_STALE"),
            severity=_lit("low"),
            title=_lit("Vacuum is overdue"),
            details=_join("The last VACUUM is ", age, " days old."),
            current_value=_join(age, " days ago"),
            threshold=limit,
            recommendation=_lit("Vacuum the table to free the space of files no longer in use."),
            sql_command=command,
        ),
    )


def no_partitioning(config: LayoutConfig) -> tuple[Issue, ...]:
    size = _number("table_size_gb")
    return (
        Issue(
            when=f"table_size_gb >= {config.large_table_threshold_gb}D AND size(partition_columns) = 0",
            issue_id=_lit("LARGE_TABLE_NO_PARTITION"),
            severity=_lit("high"),
            title=_lit("Large table without partitions"),
            details=_join("The table holds ", size, " GB in one unpartitioned set of files."),
            current_value=_join(size, " GB, not partitioned"),
            threshold=_lit(f"partitioned from {_plain(config.large_table_threshold_gb)} GB"),
            recommendation=_lit(
                "Recreate the table partitioned by a column that queries filter on, such as a date."
            ),
            sql_command=_join(
                "-- Choose the column, then run without the dashes:\n-- CREATE TABLE ",
                _Value(quoted_name(suffix="_by_column")),
                " PARTITIONED BY (chosen_column) AS SELECT * FROM ",
                _NAME,
                ";",
            ),
        ),
    )


def no_clustering(config: LayoutConfig) -> tuple[Issue, ...]:
    return (
        Issue(
            when=f"table_size_gb > {config.clustering_min_gb}D "
            f"AND table_size_gb < {config.large_table_threshold_gb}D AND NOT is_liquid_clustered AND ddl_error IS NULL",
            issue_id=_lit("NO_LIQUID_CLUSTERING"),
            severity=_lit("medium"),
            title=_lit("No clustering columns"),
            details=_join("The table holds ", _number("table_size_gb"), " GB and has no clustering columns."),
            current_value=_lit("not clustered"),
            threshold=_lit(
                f"clustered from {_plain(config.clustering_min_gb)} GB "
                f"to {_plain(config.large_table_threshold_gb)} GB"
            ),
            recommendation=_lit("Cluster the table by the columns that queries filter on."),
            sql_command=_join("ALTER TABLE ", _NAME, " CLUSTER BY (first_filter_column, second_filter_column);"),
        ),
    )


def no_zorder(config: LayoutConfig) -> tuple[Issue, ...]:
    return (
        Issue(
            when=f"table_size_gb > {config.zorder_recommend_threshold_gb}D "
            "AND size(zorder_columns) = 0 AND NOT is_liquid_clustered "
            "AND history_error IS NULL AND ddl_error IS NULL",
            issue_id=_lit("NO_ZORDER"),
            severity=_lit("medium"),
            title=_lit("Large table that was never z-ordered"),
            details=_join(
                "The table holds ", _number("table_size_gb"), " GB and no commit looked at z-ordered it."
            ),
            current_value=_lit("no z-order columns"),
            threshold=_lit(f"z-ordered or clustered above {_plain(config.zorder_recommend_threshold_gb)} GB"),
            recommendation=_lit(
                "Z-order the table by the columns that queries filter on, or cluster it by them."
            ),
            sql_command=_join("OPTIMIZE ", _NAME, " ZORDER BY (first_filter_column, second_filter_column);"),
        ),
    )


def excess_partitions(config: LayoutConfig) -> tuple[Issue, ...]:
    count = _number("partition_count", 0)
    texts = {
        "details": _join(count, " partitions by ", _Value("array_join(partition_columns, ', ')")),
        "current_value": _join(count, " partitions"),
        "threshold": _lit(f"at most {config.max_partition_count:,} partitions"),
    }
    return (
        Issue(
            when=f"partition_count > {config.max_partition_count}",
            issue_id=_lit("EXCESS_PARTITIONS"),
            severity=_lit("critical"),
            title=_lit("Too many partitions"),
            recommendation=_lit("Partition by fewer columns or by a coarser one, such as month instead of day."),
            **texts,
        ),
        Issue(
            when=f"partition_count > {config.max_partition_count * config.high_partition_share}D",
            issue_id=_lit("HIGH_PARTITION_COUNT"),
            severity=_lit("medium"),
            title=_lit("Partition count nears its limit"),
            recommendation=_lit("Watch the partition count, and plan a coarser partitioning if it keeps rising."),
            **texts,
        ),
    )


def partition_skew(config: LayoutConfig) -> tuple[Issue, ...]:
    return (
        Issue(
            when="has_partition_skew AND partition_skew_severity <> 'none'",
            issue_id="concat('PARTITION_SKEW_', upper(partition_skew_severity))",
            severity="partition_skew_severity",
            title=_join("Partition sizes are uneven (", _Value("initcap(partition_skew_severity)"), ")"),
            details=_join(
                "Largest partition ",
                _number("largest_partition_size_mb"),
                " MB, median ",
                _number("median_partition_size_mb"),
                " MB, smallest ",
                _number("smallest_partition_size_mb"),
                " MB",
            ),
            current_value=_join("largest partition is ", _number("partition_skew_ratio"), " times the median"),
            threshold=_lit(f"at most {_plain(config.partition_skew_threshold)} times"),
            recommendation=_lit(
                "Partition by a column, or a function of it, that spreads rows more evenly."
            ),
        ),
    )


# Rule order (it breaks ties between issues of one severity) and category.
RULES: dict[str, Rule] = {
    "small_files": small_files,
    "file_skew": file_skew,
    "stale_optimize": stale_optimize,
    "stale_vacuum": stale_vacuum,
    "no_partitioning": no_partitioning,
    "no_liquid_clustering": no_clustering,
    "no_zorder": no_zorder,
    "excess_partitions": excess_partitions,
    "partition_skew": partition_skew,
}


def raised(category: str, config: LayoutConfig) -> str:
    """The issue a rule raises for a row: the first whose condition holds, or null."""
    rule_no = list(RULES).index(category) + 1

    def struct(issue: Issue) -> str:
        values = {
            "severity_order": severity_order(issue.severity),
            "rule_no": str(rule_no),
            "category": _lit(category),
        }
        fields = (f"'{f}', {values.get(f) or getattr(issue, f)}" for f in ISSUE_FIELDS)
        return f"named_struct({', '.join(fields)})"

    whens = " ".join(f"WHEN {i.when} THEN {struct(i)}" for i in RULES[category](config))
    return f"CASE WHEN NOT is_valid THEN NULL {whens} END"
