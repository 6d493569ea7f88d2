"""Find the table a path belongs to, by its longest table root."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import KEY


# Roots up to this many characters in total are broadcast.
BROADCAST_CHARACTERS = 16 << 20


def located(column: str, spark: SparkSession) -> Column:
    """A location in one form: with a scheme, that of the session's file system by default."""
    default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///").rstrip("/")
    full = F.when(F.col(column).rlike("^[^/]*:"), F.col(column)).otherwise(F.concat(F.lit(default), column))
    plain = F.regexp_replace(full, "^([A-Za-z0-9+.-]+):/+", "$1:/")
    return F.rtrim(plain, F.lit("/"))


def attribute_paths(rows: DataFrame, tables: DataFrame) -> DataFrame:
    """Add the key columns and ``relative_path`` to rows with a ``path``.

    ``tables`` has key columns and ``location``. A path is cut at each depth that
    any root has (few, as a rule) and looked up by equality, deepest first: an
    equi-join per depth, no prefix join. Of nested roots the innermost one owns a
    path. Rows below no root are dropped. The roots are broadcast when their text is
    small enough; else Spark shuffles both sides by root.
    """
    spark = rows.sparkSession
    frame = tables.filter("location IS NOT NULL").select(*KEY, located("location", spark).alias("root"))
    # Of several tables at one root the first by name owns its files.
    frame = frame.groupBy("root").agg(F.min(F.struct(*KEY)).alias("owner")).select("owner.*", "root")
    shape = frame.agg(
        F.sum(F.length(F.concat(*KEY, "root"))), F.collect_set(F.size(F.split("root", "/")))
    ).first()
    if (shape[0] or 0) <= BROADCAST_CHARACTERS:
        frame = F.broadcast(frame)
    depths = sorted(shape[1], reverse=True)
    found = rows.withColumn("_path", located("path", spark))
    for at, depth in enumerate(depths):
        side = frame.filter(F.size(F.split("root", "/")) == depth).select(
            F.struct(*KEY, "root").alias(f"_at{at}"), F.col("root").alias(f"_root{at}")
        )
        cut = F.substring_index("_path", "/", depth)
        # The file itself lies below the root: a path equal to a root is no file of it.
        found = found.join(side, cut == F.col(f"_root{at}"), "left")
    if not depths:
        empty = rows.filter(F.lit(False)).select(*[F.lit("").alias(k) for k in KEY], *rows.columns)
        return empty.withColumn("relative_path", F.lit(""))
    owner = F.coalesce(*[F.col(f"_at{at}") for at in range(len(depths))])
    owned = found.withColumn("_owner", owner).filter("_owner IS NOT NULL")
    return owned.select(
        *[F.col(f"_owner.{k}").alias(k) for k in KEY],
        *rows.columns,
        F.expr("substr(_path, length(_owner.root) + 2)").alias("relative_path"),
    )
