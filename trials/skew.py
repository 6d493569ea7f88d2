"""Time the aggregations over made-up rows of which a third belong to one table.

    python trials/skew.py [millions of files] [millions of commits]

Sizes spread over six orders of magnitude, so that few files share a rounded size: the worst case for
counting by size first. Prints seconds of each step on local[$BENCH_CPUS], and of the layout figures both in
one pass at two grains and in two passes.
"""

from __future__ import annotations

import os
import sys
import time
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tablevitals import LayoutConfig  # noqa: E402
from tablevitals import operators as ops  # noqa: E402
from tablevitals.operators.partitions import partition_measures  # noqa: E402
from tablevitals.schemas import KEY  # noqa: E402

CONFIG = LayoutConfig()
TABLE = "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('t', id % 5000) END AS `table`"


def files(spark: SparkSession, millions: float) -> DataFrame:
    return spark.range(0, int(millions * 1e6), 1, 64).selectExpr(
        "'c' AS catalog", "'s' AS schema", TABLE, "concat('p=', id % 9973) AS partition",
        "CAST(exp(pmod(xxhash64(id), 1000003) / 1000003D * 13.8D) * 2000 AS BIGINT) AS size_bytes",
    )


def commits(spark: SparkSession, millions: float) -> DataFrame:
    return spark.range(0, int(millions * 1e6), 1, 64).selectExpr(
        "'c' AS catalog", "'s' AS schema", TABLE, "id AS version",
        "timestamp_seconds(1600000000 + id % 100000000) AS timestamp",
        "element_at(array('WRITE', 'OPTIMIZE', 'MERGE', 'VACUUM END'), CAST(pmod(xxhash64(id), 4) + 1 AS INT)) AS operation",
        "map('zOrderBy', '[\"a\"]') AS operationParameters",
        "map('numOutputBytes', CAST(id AS STRING)) AS operationMetrics",
    )


def main() -> None:
    n_files, n_commits = (float(x) for x in (*sys.argv[1:], 10, 2)[:2])
    spark = (
        SparkSession.builder.master(f"local[{os.environ.get('BENCH_CPUS', '8')}]")
        .config("spark.sql.shuffle.partitions", "64")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def two_passes(rows: DataFrame) -> DataFrame:
        return ops.file_profile(rows, CONFIG).join(partition_measures(ops.partition_sizes(rows)), list(KEY), "left")

    steps = {
        "layout, two passes": lambda: two_passes(files(spark, n_files)),
        "layout, one pass": lambda: ops.layout_profile(files(spark, n_files), CONFIG),
        "floor_percentile": lambda: ops.floor_percentile(files(spark, n_files), 95),
        "history_profile": lambda: ops.history_profile(commits(spark, n_commits), datetime(2024, 1, 1)),
    }
    for name, step in steps.items():
        for run in ("first", "second"):
            start = time.perf_counter()
            step().write.format("noop").mode("overwrite").save()
            print(f"{name}, {run} run: {time.perf_counter() - start:.1f} s", flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
