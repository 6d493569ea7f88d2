"""Expression helpers.

Each helper takes Spark SQL expression texts (a column name, or any expression)
and returns an expression text built from Spark's own functions, for use with
``selectExpr``, ``F.expr`` or SQL. Text keeps the thresholds and the rules built on
them readable, and one parsed text replaces hundreds of calls into the JVM.
"""

from .numbers import (
    bytes_to_gb,
    bytes_to_mb,
    digits_to_number,
    percent_of,
    round_binary,
    safe_divide,
)
from .severity import HEALTH, SEVERITIES, health_status, severity_order, skew_severity
from .text import (
    NO_STRINGS,
    clustering_columns,
    file_name,
    full_name,
    has_cluster_by,
    number_text,
    operation_name,
    parse_zorder,
    partition_of_path,
    quoted_list,
    quoted_name,
    ratio_text,
    sql_string,
)
from .timing import age_text, floor_days, iso_text, moment, weekday_name

__all__ = [
    "HEALTH",
    "NO_STRINGS",
    "SEVERITIES",
    "age_text",
    "bytes_to_gb",
    "bytes_to_mb",
    "clustering_columns",
    "digits_to_number",
    "file_name",
    "floor_days",
    "full_name",
    "has_cluster_by",
    "health_status",
    "iso_text",
    "moment",
    "number_text",
    "operation_name",
    "parse_zorder",
    "partition_of_path",
    "percent_of",
    "quoted_list",
    "quoted_name",
    "ratio_text",
    "round_binary",
    "safe_divide",
    "severity_order",
    "skew_severity",
    "sql_string",
    "weekday_name",
]
