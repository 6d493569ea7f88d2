import statistics

from helpers import MB, by_table, detail_frame
from tablevitals import LayoutConfig
from tablevitals import operators as ops
from tablevitals.schemas import PARTITION_INVENTORY

CONFIG = LayoutConfig()


def inventory(spark, rows):
    return spark.createDataFrame([("c", "s", *r) for r in rows], PARTITION_INVENTORY)


def partitioned(spark, *names, **extra):
    rows = [{"table": name, "partitionColumns": ["p"], **extra} for name in names]
    return ops.table_detail(detail_frame(spark, *rows))


def test_sizes_add_up_over_all_levels_and_skip_unpartitioned_rows(spark):
    rows = inventory(spark, [("t", "a=1/b=1", 5), ("t", "a=1/b=1", 6), ("t", "a=1/b=2", 1), ("t", None, 9)])
    found = {r.partition: r.size_bytes for r in ops.partition_sizes(rows).collect()}
    assert found == {"a=1/b=1": 11, "a=1/b=2": 1}
    assert ops.partition_count(rows).first().partition_count == 2


def test_stats_equal_brute_force(spark):
    sizes = {"x": [10, 20, 70, 400], "y": [33], "z": [1, 1, 4, 4, 9]}
    rows = inventory(spark, [(t, f"p={i}", s * MB + 7) for t, v in sizes.items() for i, s in enumerate(v)])
    stats = by_table(ops.partition_stats(partitioned(spark, *sizes), ops.partition_sizes(rows), CONFIG))
    for table, values in sizes.items():
        mb = [round((v * MB + 7) / MB, 2) for v in values]
        median = round(statistics.median(mb), 2)
        row = stats[table]
        assert row.largest_partition_size_mb == round(max(mb), 2)
        assert row.smallest_partition_size_mb == round(min(mb), 2)
        assert row.median_partition_size_mb == median
        assert row.avg_partition_size_mb == round(statistics.mean(mb), 2)
        assert row.partition_skew_ratio == round(round(max(mb), 2) / median, 2)
        assert row.partition_count == len(values)
    assert (stats["x"].partition_skew_severity, stats["x"].has_partition_skew) == ("medium", False)


def test_partitions_without_bytes_are_counted_but_not_measured(spark):
    rows = inventory(spark, [("t", "p=1", 0), ("t", "p=2", 10 * MB), ("t", "p=3", 20 * MB)])
    row = ops.partition_stats(partitioned(spark, "t"), ops.partition_sizes(rows), CONFIG).first()
    assert (row.partition_count, row.smallest_partition_size_mb, row.median_partition_size_mb) == (3, 10.0, 15.0)


def test_unmeasured_partitions_are_taken_to_be_even(spark):
    detail = partitioned(spark, "t", sizeInBytes=100 * MB)
    counts = spark.createDataFrame([("c", "s", "t", 3)], "catalog string, schema string, table string, partition_count bigint")
    row = ops.partition_stats(detail, inventory(spark, []), CONFIG, counts).first()
    assert row.partition_sizes_estimated
    assert row.largest_partition_size_mb == row.median_partition_size_mb == 33.33
    assert (row.partition_skew_ratio, row.partition_skew_severity) == (1.0, "none")
    zero_bytes = inventory(spark, [("t", "p=1", 0), ("t", "p=2", 0)])
    row = ops.partition_stats(detail, zero_bytes, CONFIG).first()
    assert (row.partition_count, row.largest_partition_size_mb, row.partition_sizes_estimated) == (2, 50.0, True)


def test_many_partitions_and_unpartitioned_tables(spark):
    detail = ops.table_detail(
        detail_frame(spark, {"table": "many", "partitionColumns": ["p"]}, {"table": "flat"}, {"table": "none", "partitionColumns": ["p"]})
    )
    rows = inventory(spark, [("many", f"p={i}", MB) for i in range(12_000)] + [("flat", "p=1", MB)])
    stats = by_table(ops.partition_stats(detail, ops.partition_sizes(rows), CONFIG))
    assert (stats["many"].partition_count, stats["many"].largest_partition_size_mb) == (12_000, 1.0)
    assert (stats["flat"].partition_count, stats["flat"].partition_note) == (0, "not partitioned")
    assert (stats["none"].partition_count, stats["none"].partition_skew_ratio) == (0, 0.0)


def test_count_from_data_collapses_nulls(spark):
    data = spark.createDataFrame([(None, "a"), ("a", None), ("a", "b"), ("a", "b")], "x string, y string")
    assert ops.partition_count_from_data(data, ["x", "y"]).first()[0] == 2
