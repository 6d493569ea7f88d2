"""Percentile by floor index."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import KEY
from .sizes import size_histogram


def floor_percentile(files: DataFrame, percentile: float) -> DataFrame:
    """The file size (MB) at index floor(n * p / 100) of each table's sorted sizes.

    The index stops at the last row. This is not ``percentile_disc``: the two
    differ when n * p / 100 is whole. Ranks run over the size histogram, whose
    rows per table are bounded (see ``sizes``), never over the files themselves.
    """
    histogram = size_histogram(files).select(*KEY, "size_mb", "n")
    per_table = Window.partitionBy(*KEY)
    upto = per_table.orderBy("size_mb").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    position = F.floor(F.col("total") * F.lit(float(percentile)) / 100.0)
    ranked = histogram.select(
        *KEY, "size_mb", "n", F.sum("n").over(per_table).alias("total"), F.sum("n").over(upto).alias("upto")
    )
    at = F.least(position, F.col("total") - 1)
    hit = ranked.filter((at < F.col("upto")) & (at >= F.col("upto") - F.col("n")))
    return hit.select(*KEY, F.col("size_mb").alias("percentile_mb"), F.col("total").alias("total_files"))
