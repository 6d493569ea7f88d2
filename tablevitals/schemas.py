"""Schemas of the five inputs and the two outputs."""

from pyspark.sql import types as T

KEY = ("catalog", "schema", "table")

_STRINGS = T.ArrayType(T.StringType())
_STRING_MAP = T.MapType(T.StringType(), T.StringType())


def _struct(*columns) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns])


_KEY_COLUMNS = tuple((name, T.StringType()) for name in KEY)

TABLE_DETAIL = _struct(
    *_KEY_COLUMNS,
    ("format", T.StringType()),
    ("location", T.StringType()),
    ("sizeInBytes", T.LongType()),
    ("numFiles", T.LongType()),
    ("partitionColumns", _STRINGS),
    ("createdAt", T.TimestampType()),
    ("lastModified", T.TimestampType()),
    ("properties", _STRING_MAP),
    ("minReaderVersion", T.IntegerType()),
    ("minWriterVersion", T.IntegerType()),
    ("error", T.StringType()),
)

TABLE_DDL = _struct(*_KEY_COLUMNS, ("ddl", T.StringType()), ("error", T.StringType()))

FILE_INVENTORY = _struct(
    *_KEY_COLUMNS,
    ("path", T.StringType()),
    ("name", T.StringType()),
    ("partition", T.StringType()),
    ("size_bytes", T.LongType()),
    ("modification_time", T.TimestampType()),
)

PARTITION_INVENTORY = _struct(
    *_KEY_COLUMNS, ("partition", T.StringType()), ("size_bytes", T.LongType())
)

TABLE_HISTORY = _struct(
    *_KEY_COLUMNS,
    ("version", T.LongType()),
    ("timestamp", T.TimestampType()),
    ("operation", T.StringType()),
    ("operationParameters", _STRING_MAP),
    ("operationMetrics", _STRING_MAP),
)

# What could not be read: one row per failing step and path. A scope that cannot be listed has no table.
FAILURES = _struct(
    *_KEY_COLUMNS, ("step", T.StringType()), ("path", T.StringType()), ("error", T.StringType())
)

# Column names, order and types of the saved report are fixed: saved rows of
# earlier runs must stay readable next to new ones.
TABLE_REPORT = _struct(
    *_KEY_COLUMNS,
    ("table_size_gb", T.DoubleType()),
    ("num_files", T.LongType()),
    ("avg_file_size_mb", T.DoubleType()),
    ("small_files_pct", T.DoubleType()),
    ("severe_small_files_pct", T.DoubleType()),
    ("file_skew_ratio", T.DoubleType()),
    ("file_skew_severity", T.StringType()),
    ("is_partitioned", T.BooleanType()),
    ("partition_count", T.IntegerType()),
    ("partition_columns", T.StringType()),
    ("partition_skew_ratio", T.DoubleType()),
    ("is_liquid_clustered", T.BooleanType()),
    ("clustering_columns", T.StringType()),
    ("zorder_columns", T.StringType()),
    ("last_optimize", T.StringType()),
    ("last_optimize_days_ago", T.IntegerType()),
    ("optimize_status", T.StringType()),
    ("last_vacuum", T.StringType()),
    ("last_vacuum_days_ago", T.IntegerType()),
    ("vacuum_status", T.StringType()),
    ("health_status", T.StringType()),
    ("issue_count", T.IntegerType()),
    ("critical_issues", T.IntegerType()),
    ("high_issues", T.IntegerType()),
    ("medium_issues", T.IntegerType()),
    ("low_issues", T.IntegerType()),
    ("issues_summary", T.StringType()),
    ("sql_commands", T.StringType()),
    ("analysis_timestamp", T.StringType()),
    ("error", T.StringType()),
)

ISSUES = _struct(
    *_KEY_COLUMNS,
    ("issue_id", T.StringType()),
    ("category", T.StringType()),
    ("severity", T.StringType()),
    ("title", T.StringType()),
    ("details", T.StringType()),
    ("current_value", T.StringType()),
    ("threshold", T.StringType()),
    ("recommendation", T.StringType()),
    ("sql_command", T.StringType()),
    ("analysis_timestamp", T.StringType()),
)
