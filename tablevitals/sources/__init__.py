"""Sources of the inventories, and the store of reports."""

from .catalog import (
    collect_ddl,
    collect_details,
    collect_history,
    command_history,
    discover,
    discover_tables,
    history_of_table,
    tables_in_catalog,
    tables_in_schema,
)
from .collect import collect_inventories
from .collected import Collected
from .commits import commit_history, read_commits
from .listing import file_inventory, list_inventory, walk_files
from .scratch import Scratch
from .store import read_issues, read_reports, save_report

__all__ = [
    "Collected",
    "Scratch",
    "collect_ddl",
    "collect_details",
    "collect_history",
    "collect_inventories",
    "command_history",
    "commit_history",
    "discover",
    "discover_tables",
    "file_inventory",
    "history_of_table",
    "list_inventory",
    "read_commits",
    "read_issues",
    "read_reports",
    "save_report",
    "tables_in_catalog",
    "tables_in_schema",
    "walk_files",
]
