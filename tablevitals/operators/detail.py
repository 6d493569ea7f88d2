"""Table detail: defaults, validity and scope."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import LayoutConfig
from ..functions import NO_STRINGS, bytes_to_gb, bytes_to_mb, full_name
from ..schemas import KEY, TABLE_DETAIL

SUPPORTED_FORMAT = "delta"
_SUPPORTED = f"coalesce(lower(format) = '{SUPPORTED_FORMAT}', false)"


def _with_all_columns(detail: DataFrame) -> DataFrame:
    """Add detail columns a source does not deliver, as nulls."""
    missing = [f for f in TABLE_DETAIL.fields if f.name not in detail.columns]
    return detail.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing})


def supported_tables(detail: DataFrame) -> DataFrame:
    """Keys of the tables in the supported format; an unknown format is not."""
    return detail.filter(_SUPPORTED).select(*KEY)


def table_detail(detail: DataFrame) -> DataFrame:
    """Detail rows with defaults, sizes in MB and GB, and a validity flag.

    A stated other format is invalid; an unknown (null or empty) one is not.
    """
    other_format = f"coalesce(format, '') <> '' AND NOT {_SUPPORTED}"
    rows = _with_all_columns(detail).withColumn(
        "error",
        F.expr(
            f"coalesce(error, CASE WHEN {other_format} THEN concat('unsupported table format: ', format) END)"
        ),
    )
    size = "coalesce(sizeInBytes, 0L)"
    return rows.selectExpr(
        *KEY,
        f"{full_name()} AS full_name",
        "error IS NULL AS is_valid",
        "error",
        "format",
        "location",
        f"{size} AS table_size_bytes",
        f"{bytes_to_mb(size)} AS table_size_mb",
        f"{bytes_to_gb(size)} AS table_size_gb",
        "coalesce(numFiles, 0L) AS num_files",
        f"coalesce(partitionColumns, {NO_STRINGS}) AS partition_columns",
        "createdAt AS created_at",
        "lastModified AS last_modified",
        "coalesce(properties, CAST(map() AS MAP<STRING, STRING>)) AS table_properties",
        "minReaderVersion AS min_reader_version",
        "minWriterVersion AS min_writer_version",
    )


def in_scope(rows: DataFrame, config: LayoutConfig) -> DataFrame:
    """Keep the rows of the configured table, schema or catalog.

    A plain equality filter on the key columns, so it reaches the scan of a
    stored inventory (and prunes one partitioned by catalog and schema).
    """
    rows = rows.filter(F.col("catalog") == config.catalog)
    if config.scan_mode == "catalog":
        return rows.filter(F.lower("schema") != "information_schema")
    rows = rows.filter(F.col("schema") == config.schema)
    return rows.filter(F.col("table") == config.table) if config.scan_mode == "single_table" else rows
