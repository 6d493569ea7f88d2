"""Partition sizes, counts and balance."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import LayoutConfig
from ..functions import bytes_to_mb, round_binary, skew_severity
from ..schemas import KEY
from .sizes import size_histogram, size_summary


def partition_sizes(files: DataFrame) -> DataFrame:
    """Bytes per table and partition, over all levels of the partition path.

    Works on a file inventory and on a partition inventory alike. Map-side sums
    come before the shuffle, and the shuffle key includes the partition, so one
    large table spreads over many tasks.
    """
    located = files.filter(F.col("partition").isNotNull())
    return located.groupBy(*KEY, "partition").agg(F.sum("size_bytes").alias("size_bytes"))


def partition_count(partitions: DataFrame) -> DataFrame:
    """Distinct partitions per table, empty ones included."""
    return partition_sizes(partitions).groupBy(*KEY).agg(F.count(F.lit(1)).alias("partition_count"))


def partition_count_from_data(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct partition values read from table data, when metadata has none.

    Null parts vanish from the joined text, so (null, 'a') and ('a', null) count
    once: that is the definition.
    """
    value = F.concat_ws("/", *[F.col(c).cast("string") for c in columns])
    return rows.agg(F.count_distinct(value).alias("partition_count"))


# The measures over the columns of a size summary of partitions.
MEASURES = (
    "partition_count",
    "min_mb AS _smallest_mb",
    "max_mb AS _largest_mb",
    "median_mb AS _median_mb",
    "mean_mb AS _mean_mb",
)


def partition_measures(partitions: DataFrame) -> DataFrame:
    """Count and size summary of each table's partitions, in one pass.

    Partitions without bytes are counted but not measured.
    """
    histogram = size_histogram(partitions, counts="size_bytes > 0", partition_count="true")
    return size_summary(histogram, "partition_count").selectExpr(*KEY, *MEASURES)


def partition_figures(joined: DataFrame, config: LayoutConfig) -> DataFrame:
    """Add partition columns to detail rows with their (maybe missing) measures.

    A table with a count but no measured partition is taken to be even: every
    partition is total/count. A table without partition columns has none,
    whatever its paths look like.
    """
    partitioned = "size(partition_columns) > 0"
    counted = joined.withColumn(
        "partition_count",
        F.expr(f"CAST(CASE WHEN {partitioned} THEN coalesce(partition_count, 0L) ELSE 0L END AS INT)"),
    )
    has_any = "partition_count > 0"
    even_mb = bytes_to_mb("floor(try_divide(table_size_bytes, partition_count))")

    def mb(source: str) -> Column:
        return F.expr(
            f"CASE WHEN NOT ({has_any}) THEN 0D WHEN _median_mb IS NULL THEN {even_mb} "
            f"ELSE {round_binary(source)} END"
        )

    sized = counted.withColumns(
        {
            "is_partitioned": F.expr(partitioned),
            "largest_partition_size_mb": mb("_largest_mb"),
            "smallest_partition_size_mb": mb("_smallest_mb"),
            "median_partition_size_mb": mb("_median_mb"),
            "avg_partition_size_mb": mb("_mean_mb"),
            "partition_sizes_estimated": F.expr(f"{has_any} AND _median_mb IS NULL"),
            "partition_note": F.expr(f"CASE WHEN NOT ({partitioned}) THEN 'not partitioned' END"),
        }
    ).drop("_largest_mb", "_smallest_mb", "_median_mb", "_mean_mb")
    # The ratio uses the rounded sizes here, unlike the file ratio.
    ratio = (
        "CASE WHEN median_partition_size_mb > 0 "
        "THEN largest_partition_size_mb / median_partition_size_mb ELSE 0D END"
    )
    return sized.withColumns(
        {
            "partition_skew_ratio": F.expr(round_binary(ratio)),
            "partition_skew_severity": F.expr(skew_severity(ratio, config)),
            "has_partition_skew": F.expr(f"{ratio} > {config.partition_skew_threshold}D"),
        }
    )


def join_partition_measures(
    rows: DataFrame, partitions: DataFrame, counts: DataFrame | None = None
) -> DataFrame:
    """Left-join measures; a count in ``counts`` wins over the one found in the sizes."""
    return with_stated_counts(rows.join(partition_measures(partitions), list(KEY), "left"), counts)


def with_stated_counts(joined: DataFrame, counts: DataFrame | None) -> DataFrame:
    """Rows with measures, with the counts of another source in place of those measured."""
    if counts is None:
        return joined
    stated = counts.select(*KEY, F.col("partition_count").alias("_stated"))
    return joined.join(stated, list(KEY), "left").withColumn(
        "partition_count", F.coalesce("_stated", "partition_count")
    ).drop("_stated")


def partition_stats(
    detail: DataFrame,
    partitions: DataFrame,
    config: LayoutConfig,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Partition balance of every table of ``detail`` (the output of ``table_detail``).

    ``partitions`` is the output of ``partition_sizes``; ``counts`` may give
    partition counts from another source.
    """
    base = detail.select(*KEY, "partition_columns", "table_size_bytes")
    joined = join_partition_measures(base, partitions, counts)
    return partition_figures(joined, config).drop("table_size_bytes")
