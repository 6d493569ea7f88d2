"""The first n rows of each table."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import KEY


def first_per_table(
    rows: DataFrame, order: list[Column], n: int, spread: str, rank: str | None = None
) -> DataFrame:
    """The first n rows of each table in the given order, with their rank if named.

    One plan for every n: a table's rows are first cut within slices by the hash of
    ``spread``, a column that tells them apart, as many as there are shuffle
    partitions. So the last step sees at most slices * n rows of a table, however
    many it has and however many tasks they come from.
    """
    position = rank or "_rank"
    slices = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    within = Window.partitionBy(*KEY, "_slice").orderBy(*order)
    sliced = rows.withColumn("_slice", F.pmod(F.xxhash64(spread), F.lit(slices)))
    firsts = sliced.withColumn(position, F.row_number().over(within)).filter(F.col(position) <= n)
    window = Window.partitionBy(*KEY).orderBy(*order)
    kept = firsts.drop(position, "_slice").withColumn(position, F.row_number().over(window))
    kept = kept.filter(F.col(position) <= n)
    return kept if rank else kept.drop(position)
