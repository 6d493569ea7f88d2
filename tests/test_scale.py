"""What must hold at scale: hot tables spread out, filters reach scans, bounds are kept."""

import re
from datetime import datetime

from pyspark.sql import functions as F

from helpers import by_table
from tablevitals import Inventories, LayoutConfig
from tablevitals import operators as ops
from tablevitals.operators.sizes import size_histogram
from tablevitals.plans.analyze import analyze_scope
from tablevitals.schemas import KEY, TABLE_DDL, TABLE_DETAIL, TABLE_HISTORY
from tablevitals.sources.walk import spread_paths

CONFIG = LayoutConfig()


def hot_files(spark, n=60000):
    """A third of all files in one table, the rest in 500 tables."""
    table = "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('t', id % 500) END AS `table`"
    return spark.range(0, n, 1, 8).selectExpr(
        "'c' AS catalog",
        "'s' AS schema",
        table,
        "concat('/lake/', id, '.parquet') AS path",
        "concat(id, '.parquet') AS name",
        "concat('p=', id % 9000) AS partition",
        "1000000 + pmod(hash(id), 900000000) AS size_bytes",
        "CAST(NULL AS TIMESTAMP) AS modification_time",
    )


def rows_per_task(frame):
    counts = [r["count"] for r in frame.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    return max(counts) / (sum(counts) / len(counts))


def test_a_hot_table_spreads_over_all_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files = hot_files(spark)
        assert rows_per_task(size_histogram(files)) < 1.3
        assert rows_per_task(ops.partition_sizes(files)) < 1.3
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_the_hot_table_is_counted_whole(spark):
    rows = by_table(ops.file_profile(hot_files(spark), CONFIG))
    assert rows["hot"].total_files == 20000
    assert sum(r.total_files for r in rows.values()) == 60000
    assert ops.partition_count(hot_files(spark)).filter("`table` = 'hot'").first().partition_count == 3000


def test_listing_work_is_not_coalesced(spark):
    paths = spark.range(100).select(F.concat(F.lit("/p"), "id").alias("path"))
    assert spread_paths(paths).rdd.getNumPartitions() >= 32


def test_scope_reaches_stored_inventories(spark, tmp_path):
    """A single-table analysis prunes catalog and schema folders and filters rows in the scan."""
    for name, schema in (("detail", TABLE_DETAIL), ("ddl", TABLE_DDL), ("history", TABLE_HISTORY)):
        rows = spark.createDataFrame([("c", s, "t", *[None] * (len(schema) - 3)) for s in ("s", "x")], schema)
        rows.write.partitionBy("catalog", "schema").parquet(str(tmp_path / name))
    hot_files(spark, 300).write.partitionBy("catalog", "schema").parquet(str(tmp_path / "files"))
    stored = {name: spark.read.parquet(str(tmp_path / name)) for name in ("detail", "ddl", "files", "history")}
    config = LayoutConfig(catalog="c", schema="s", table="t")
    tables = analyze_scope(Inventories(**stored), config, datetime(2024, 1, 1)).tables
    text = tables._jdf.queryExecution().executedPlan().toString()
    scans = re.findall(r"FileScan parquet .*", text)
    assert len(scans) == 4  # each inventory once
    for scan in scans:
        partition_filters = re.search(r"PartitionFilters: \[(.*?)\], PushedFilters", scan).group(1)
        assert "catalog" in partition_filters and "schema" in partition_filters
        assert "EqualTo(table,t)" in scan or "table" in re.search(r"DataFilters: \[(.*?)\], Format", scan).group(1)
    row = tables.select(*KEY, "num_files").first()
    assert tuple(row) == ("c", "s", "t", 0)


def test_joins_are_as_long_as_the_list_of_tables(spark):
    """No join touches file or commit rows: every joined side is an aggregate."""
    files = hot_files(spark, 300)
    detail = files.groupBy(*KEY).agg(F.lit("delta").alias("format"), F.count("*").alias("numFiles"))
    inputs = Inventories(
        detail=detail,
        ddl=spark.createDataFrame([], TABLE_DDL),
        files=files,
        history=spark.createDataFrame([], TABLE_HISTORY),
    )
    catalog = LayoutConfig(scan_mode="catalog", catalog="c")
    tables = analyze_scope(inputs, catalog, datetime(2024, 1, 1)).tables
    joins = re.findall(r"\w*Join \[[^\]]*\]", tables._jdf.queryExecution().executedPlan().toString())
    assert len(joins) == 4  # supported tables, layout, clustering, history
    assert all("path" not in j and "version" not in j for j in joins)
    assert tables.count() == detail.count()
