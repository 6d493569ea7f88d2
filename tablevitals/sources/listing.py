"""File inventory: every data file below many table roots.

Directories are listed on the executors, level by level. They are dealt out over
the cluster at every level, so neither the driver nor one task holds a table's
listing, however many files it has. Each level is written below
``spark.checkpoint.dir``: a lost executor costs no second walk, and all users of
the inventory read the stored snapshot. A directory that cannot be read is a
row of its level with an error.

Of tables that lie inside one another the inner one owns its files: at each level,
directories that are the root of some table are not entered from above.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import file_name, partition_of_path
from ..schemas import FILE_INVENTORY, KEY
from .attribute import located
from .collected import Collected, failures_of
from .scratch import scratch_folder
from .walk import ENTRY, directory_lister, roots_of, spread_paths

DATA_SUFFIX = ".parquet"
HIDDEN_PREFIX = "_"

# More than file systems take, so no real directory is lost to it.
_LONGEST_PATH = 32_768


def walk(spark: SparkSession, tables: DataFrame, scratch: str | None = None) -> Collected:
    """List the files of ``tables`` (key columns and ``location``) on the executors.

    The snapshot stays in the scratch folder, as the result reads from it.
    """
    scratch = scratch or scratch_folder(spark, "listing")
    pending = roots_of(tables)
    roots = pending.select(located("root", spark).alias("_root")).distinct()
    lister = directory_lister(DATA_SUFFIX, HIDDEN_PREFIX)
    levels = []
    for depth in count():
        folder = f"{scratch}/level={depth}"
        spread_paths(pending).mapInPandas(lister, ENTRY).write.mode("overwrite").parquet(folder)
        level = spark.read.schema(ENTRY).parquet(folder)
        levels.append(level)
        # An equi-join as long as a level's directories with the list of tables.
        below = level.filter("is_dir").join(roots, located("path", spark) == F.col("_root"), "left_anti")
        pending = below.select(*KEY, "root", "path")
        if pending.isEmpty():
            break
        # A path this long can only come from a directory that links to one above it.
        if not pending.filter(F.length("path") - F.length("root") > _LONGEST_PATH).isEmpty():
            raise ValueError(f"directories below {scratch} go in a circle: a path has over {_LONGEST_PATH} characters")
    entries = reduce(DataFrame.unionByName, levels)
    files = entries.filter("NOT is_dir").drop("error")
    return Collected(
        files.withColumn("relative_path", F.expr("substr(path, length(root) + 2)")), failures_of(entries, "listing")
    )


def walk_files(spark: SparkSession, tables: DataFrame, scratch: str | None = None) -> DataFrame:
    """The files of ``walk`` alone."""
    return walk(spark, tables, scratch).rows


def list_inventory(spark: SparkSession, tables: DataFrame, scratch: str | None = None) -> Collected:
    """One row per data file of each table, with its name and partition, and the failures met.

    Every file counts. The listing is physical: files a
    table no longer uses count until they are vacuumed.
    """
    found = walk(spark, tables, scratch)
    named = found.rows.withColumns(
        {"name": F.expr(file_name("path")), "partition": F.expr(partition_of_path("relative_path"))}
    )
    return Collected(named.select(*FILE_INVENTORY.names), found.failures)


def file_inventory(
    spark: SparkSession, tables: DataFrame, scratch: str | None = None
) -> DataFrame:
    """The rows of ``list_inventory`` alone."""
    return list_inventory(spark, tables, scratch).rows
