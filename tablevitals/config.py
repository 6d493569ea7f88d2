"""Scan scope, thresholds and output location of one analysis."""

from __future__ import annotations

from dataclasses import dataclass, fields

SCOPES = ("single_table", "schema", "catalog")


@dataclass(frozen=True)
class LayoutConfig:
    """Immutable settings; every number enters a plan as a literal.

    The option names and default values are fixed: users carry their settings
    over from run to run, and reports are only comparable when they agree.
    """

    # What to look at.
    scan_mode: str = "single_table"
    catalog: str = "spark_catalog"
    schema: str = "default"
    table: str | None = None

    # File sizes, in MB.
    small_file_severe_mb: float = 32
    small_file_acceptable_mb: float = 128
    optimal_file_size_min_mb: float = 512
    optimal_file_size_max_mb: float = 1024

    # Share of small files, in percent.
    small_files_pct_warning: float = 20.0
    small_files_pct_critical: float = 50.0

    # Largest-to-median ratios: three tier limits, and the two "has skew" flags.
    skew_low_threshold: float = 3.0
    skew_medium_threshold: float = 5.0
    skew_high_threshold: float = 10.0
    file_skew_threshold: float = 10.0
    partition_skew_threshold: float = 10.0

    # Whole-table checks.
    max_partition_count: int = 5000
    high_partition_share: float = 0.8
    large_table_threshold_gb: float = 1000
    zorder_recommend_threshold_gb: float = 500
    clustering_min_gb: float = 10
    optimize_stale_days: int = 30
    vacuum_stale_days: int = 30
    vacuum_retain_hours: int = 168

    # Where reports are appended.
    persist_results: bool = True
    output_catalog: str = "spark_catalog"
    output_schema: str = "default"
    output_table: str = "table_layout_report"
    output_issues_table: str = "table_layout_issues"
    output_runs_table: str = "table_layout_runs"
    output_format: str = "parquet"

    def __post_init__(self) -> None:
        if self.scan_mode not in SCOPES:
            raise ValueError(f"scan_mode must be one of {SCOPES}, not {self.scan_mode!r}")
        if self.scan_mode == "single_table" and self.table == "":
            raise ValueError("single_table scope needs a table name")
        for f in fields(self):
            value = getattr(self, f.name)
            is_number = isinstance(value, (int, float)) and not isinstance(value, bool)
            if is_number and value < 0:
                raise ValueError(f"{f.name} must not be negative")
        tiers = (self.skew_low_threshold, self.skew_medium_threshold, self.skew_high_threshold)
        if list(tiers) != sorted(tiers):
            raise ValueError("skew tier limits must ascend")
        if self.small_file_severe_mb > self.small_file_acceptable_mb:
            raise ValueError("small_file_severe_mb must not exceed small_file_acceptable_mb")

    def full_table_name(self) -> str:
        return ".".join(p for p in (self.catalog, self.schema, self.table) if p)

    def output_table_name(self) -> str:
        return f"{self.output_catalog}.{self.output_schema}.{self.output_table}"

    def output_issues_table_name(self) -> str:
        return f"{self.output_catalog}.{self.output_schema}.{self.output_issues_table}"
