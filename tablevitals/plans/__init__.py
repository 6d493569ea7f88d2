"""Whole analyses: metrics of all tables, issues, reports, and the entry points."""

from .analyze import Analysis, Inventories, analyze, run_analysis
from .assess import assess, issue_counts, issues, small_file_issues, table_health
from .metrics import table_metrics
from .report import (
    extended_report,
    fleet_summary,
    issue_report,
    latest_reports,
    maintenance_sql,
    report_history,
    table_report,
)

__all__ = [
    "Analysis",
    "Inventories",
    "analyze",
    "assess",
    "extended_report",
    "fleet_summary",
    "issue_counts",
    "issue_report",
    "issues",
    "latest_reports",
    "maintenance_sql",
    "report_history",
    "run_analysis",
    "small_file_issues",
    "table_health",
    "table_metrics",
    "table_report",
]
