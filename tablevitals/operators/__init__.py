"""Set-wise operators: DataFrames of all tables in, DataFrames out."""

from .clustering import clustering
from .detail import in_scope, supported_tables, table_detail
from .files import file_layout, file_profile, file_size_bands, file_skew, layout_with_fallback
from .growth import growth, weekday_pattern
from .history import (
    last_operations,
    maintenance_status,
    operation_counts,
    operation_pivot,
    recent_history,
)
from .layout import layout_profile
from .optimize import optimize_cadence, recent_optimizes, zorder_columns
from .partitions import (
    partition_count,
    partition_count_from_data,
    partition_sizes,
    partition_stats,
)
from .percentile import floor_percentile
from .profile import history_profile

__all__ = [
    "clustering",
    "file_layout",
    "file_profile",
    "file_size_bands",
    "file_skew",
    "floor_percentile",
    "growth",
    "history_profile",
    "in_scope",
    "last_operations",
    "layout_profile",
    "layout_with_fallback",
    "maintenance_status",
    "operation_counts",
    "operation_pivot",
    "optimize_cadence",
    "partition_count",
    "partition_count_from_data",
    "partition_sizes",
    "partition_stats",
    "recent_history",
    "recent_optimizes",
    "supported_tables",
    "table_detail",
    "weekday_pattern",
    "zorder_columns",
]
