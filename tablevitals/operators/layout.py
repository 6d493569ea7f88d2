"""File and partition figures of every table from one scan and one shuffle of the files.

Two grouping sets, by (table, rounded size) and by (table, partition), go through one
aggregation: each task sums up both before the shuffle, and what is shuffled are distinct
sizes and distinct partitions, not the files of every pair of them. Partition sums are then
counted by rounded size like files, and both histograms come down to one row per table.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import LayoutConfig
from ..functions import bytes_to_mb
from ..schemas import KEY
from .files import profile_figures, size_bands
from .partitions import MEASURES
from .sizes import size_summary

_OF_FILES = ("n", "bytes", "min_mb", "max_mb", "median_mb", "mean_mb", "stddev_mb")
_OF_PARTITIONS = ("partition_count", "min_mb", "max_mb", "median_mb", "mean_mb")


def size_histograms(files: DataFrame, bands: dict[str, str]) -> DataFrame:
    """Two histograms per table: of its files, and (``of_partitions``) of its partitions.

    Every partition has one more ``partition_count``; it enters the statistics if it has bytes.
    """
    sized = files.select(*KEY, "partition", "size_bytes", F.expr(bytes_to_mb("size_bytes")).alias("size_mb"))
    grains = sized.groupingSets([[*KEY, "size_mb"], [*KEY, "partition"]], *KEY, "size_mb", "partition").agg(
        F.expr("grouping(size_mb) = 1").alias("of_partitions"),
        F.count(F.lit(1)).alias("n"),
        F.sum("size_bytes").alias("bytes"),
        *[F.expr(f"count_if({condition})").alias(band) for band, condition in bands.items()],
    )
    counted = grains.filter("NOT of_partitions OR partition IS NOT NULL").selectExpr(
        *KEY,
        "of_partitions",
        f"CASE WHEN of_partitions THEN {bytes_to_mb('bytes')} ELSE size_mb END AS size_mb",
        "CASE WHEN NOT of_partitions THEN n WHEN bytes > 0 THEN 1L ELSE 0L END AS n",
        "bytes",
        *bands,
        "CASE WHEN of_partitions THEN 1L ELSE 0L END AS partition_count",
    )
    sums = [F.sum(name).alias(name) for name in ("n", "bytes", *bands, "partition_count")]
    return counted.groupBy(*KEY, "of_partitions", "size_mb").agg(*sums)


def layout_profile(files: DataFrame, config: LayoutConfig) -> DataFrame:
    """The columns of ``file_profile`` and of ``partition_measures`` in one row per table."""
    bands = size_bands(config)
    summary = size_summary(size_histograms(files, bands), *bands, "partition_count", by=("of_partitions",))

    def side(condition: str, columns: tuple[str, ...]):
        return F.expr(f"max(CASE WHEN {condition} THEN struct({', '.join(columns)}) END)")

    # Two rows per table at most.
    sides = summary.groupBy(*KEY).agg(
        side("NOT of_partitions", (*_OF_FILES, *bands)).alias("f"),
        side("of_partitions", _OF_PARTITIONS).alias("p"),
    )
    of_files = sides.select(*KEY, "p", "f.*").selectExpr(*KEY, "p", *profile_figures(config))
    figures = [c for c in of_files.columns if c not in (*KEY, "p")]
    return of_files.select(*KEY, *figures, "p.*").selectExpr(*KEY, *figures, *MEASURES)
