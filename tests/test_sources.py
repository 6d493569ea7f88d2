import json
import os
from datetime import datetime, timezone

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from helpers import by_table
from tablevitals import LayoutConfig
from tablevitals import operators as ops
from tablevitals import sources
from tablevitals.schemas import FILE_INVENTORY, KEY, TABLE_HISTORY
from tablevitals.sources.catalog import TABLES, partition_counts
from tablevitals.sources.collect import inventories_of

LOCATED = "catalog string, schema string, `table` string, location string"


@pytest.fixture(scope="module")
def lake(spark, tmp_path_factory):
    """A partitioned, a flat, an unlisted and a missing table on disk."""
    base = str(tmp_path_factory.mktemp("lake"))
    two_levels = spark.range(200).withColumn("p", F.col("id") % 3).withColumn("q", F.lit("x y+z"))
    two_levels.write.partitionBy("p", "q").parquet(f"{base}/a b/deep")
    spark.range(10).repartition(2).write.parquet(f"{base}/flat")
    os.makedirs(f"{base}/flat/_change_data")
    for name in ("_change_data/x.parquet", "_part.parquet", "note.txt"):
        with open(f"{base}/flat/{name}", "w") as f:
            f.write("x")
    os.makedirs(f"{base}/flat/_delta_log")
    for version in range(3):
        commit = {
            "timestamp": 1700000000000 + version * 86400000,
            "operation": "OPTIMIZE" if version else "WRITE",
            "operationParameters": {"zOrderBy": '["a"]'},
            "operationMetrics": {"numOutputBytes": "100"},
            "unknown": {"x": 1},
        }
        with open(f"{base}/flat/_delta_log/{version:020d}.json", "w") as f:
            f.write(json.dumps({"commitInfo": commit}) + "\n" + json.dumps({"add": {"path": "x", "size": 1}}) + "\n")
    for name in ("_last_checkpoint", "00000000000000000001.checkpoint.json", "latest.json"):
        with open(f"{base}/flat/_delta_log/{name}", "w") as f:
            f.write("{}")
    rows = [
        ("c", "s", "deep", f"{base}/a b/deep"),
        ("c", "s", "flat", f"file:{base}/flat/"),
        ("c", "s", "missing", f"{base}/nowhere"),
        ("c", "s", "unlocated", None),
    ]
    return base, spark.createDataFrame(rows, LOCATED)


def on_disk(root):
    found = {}
    for folder, folders, names in os.walk(root):
        folders[:] = [f for f in folders if not f.startswith("_")]
        for name in names:
            if name.endswith(".parquet") and not name.startswith("_"):
                path = os.path.join(folder, name)
                found[os.path.relpath(path, root)] = os.stat(path)
    return found


def test_inventory_equals_the_disk(spark, lake, tmp_path):
    base, tables = lake
    inventory = sources.file_inventory(spark, tables, scratch=str(tmp_path / "scratch"))
    assert inventory.columns == FILE_INVENTORY.names
    rows = inventory.collect()
    for table, root in (("deep", f"{base}/a b/deep"), ("flat", f"{base}/flat")):
        expected = on_disk(root)
        mine = [r for r in rows if r["table"] == table]
        assert sorted(r.path.split(root + "/")[1] for r in mine) == sorted(expected)
        for r in mine:
            relative = r.path.split(root + "/")[1]
            assert r.size_bytes == expected[relative].st_size
            when = r.modification_time.replace(tzinfo=timezone.utc).timestamp()
            assert abs(when - expected[relative].st_mtime) < 0.01
            assert r.name == os.path.basename(relative)
            assert r.partition == (os.path.dirname(relative) or None)
    assert {r["table"] for r in rows} == {"deep", "flat"}


def test_a_file_far_below_its_root_is_found(spark, tmp_path):
    deep = tmp_path.joinpath("t", *(f"d{i}" for i in range(70)))
    deep.mkdir(parents=True)
    (deep / "x.parquet").write_bytes(b"12345")
    tables = spark.createDataFrame([("c", "s", "t", str(tmp_path / "t"))], LOCATED)
    found = sources.file_inventory(spark, tables, scratch=str(tmp_path / "scratch")).collect()
    assert [(r.name, r.size_bytes) for r in found] == [("x.parquet", 5)]


def test_inventory_feeds_the_operators(spark, lake, tmp_path):
    _, tables = lake
    files = sources.file_inventory(spark, tables, scratch=str(tmp_path / "s"))
    sizes = ops.partition_sizes(files)
    assert {r.partition for r in sizes.collect()} == {f"p={i}/q=x y+z" for i in range(3)}
    assert by_table(ops.file_layout(files, LayoutConfig()))["flat"].total_files == 2


@pytest.mark.parametrize("broadcast", [True, False])
def test_paths_belong_to_their_innermost_root(spark, monkeypatch, broadcast):
    from tablevitals.sources import attribute

    if not broadcast:
        monkeypatch.setattr(attribute, "BROADCAST_CHARACTERS", 0)
    rows = [("c", "s", "outer", "/lake/outer/"), ("c", "s", "inner", "file:///lake/outer/x/inner"), ("c", "s", "gone", None)]
    paths = ["file:/lake/outer/a.parquet", "file:///lake/outer/x/inner/p=1/b.parquet", "file:/lake/elsewhere/c.parquet"]
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    owned = attribute.attribute_paths(files, spark.createDataFrame(rows, LOCATED)).collect()
    assert {(r["table"], r.relative_path) for r in owned} == {("outer", "a.parquet"), ("inner", "p=1/b.parquet")}
    nowhere = spark.createDataFrame(rows[2:], LOCATED)
    assert attribute.attribute_paths(files, nowhere).count() == 0


def test_commit_logs(spark, lake, tmp_path):
    _, tables = lake
    history = sources.commit_history(spark, tables, str(tmp_path / "a"))
    assert history.columns == TABLE_HISTORY.names
    rows = history.orderBy("version").collect()
    assert [(r["table"], r.version, r.operation) for r in rows] == [
        ("flat", 0, "WRITE"), ("flat", 1, "OPTIMIZE"), ("flat", 2, "OPTIMIZE"),
    ]
    assert rows[0].timestamp == datetime(2023, 11, 14, 22, 13, 20)
    assert rows[1].operationParameters == {"zOrderBy": '["a"]'}
    assert rows[1].operationMetrics == {"numOutputBytes": "100"}
    nowhere = tables.filter("`table` = 'missing'")
    assert sources.commit_history(spark, nowhere, str(tmp_path / "b")).count() == 0


def test_every_commit_of_a_log_counts(spark, tmp_path):
    """Plain, with a misleading line first, without commitInfo, and with parameters that are no text."""
    log = tmp_path / "t" / "_delta_log"
    log.mkdir(parents=True)
    info = {"commitInfo": {"timestamp": 1700000000000, "operation": "WRITE"}}
    add = {"add": {"path": "x", "partitionValues": {"commitInfo": "1"}}}
    typed = {"commitInfo": {"timestamp": 1700000000000, "operation": "OPTIMIZE", "operationParameters": {"n": 3, "zOrderBy": ["a"]}}}
    for version, lines in enumerate(([info], [add, info], [add], [typed])):
        (log / f"{version:020}.json").write_text("".join(json.dumps(line) + "\n" for line in lines))
    os.utime(log / f"{2:020}.json", (1700000100, 1700000100))
    tables = spark.createDataFrame([("c", "s", "t", str(tmp_path / "t"))], LOCATED)
    rows = sources.commit_history(spark, tables, str(tmp_path / "scratch")).orderBy("version").collect()
    assert [(r.version, r.operation) for r in rows] == [(0, "WRITE"), (1, "WRITE"), (2, None), (3, "OPTIMIZE")]
    assert [r.timestamp.minute for r in rows] == [13, 13, 15, 13]
    assert rows[3].operationParameters == {"n": "3", "zOrderBy": '["a"]'}
    counts = ops.operation_counts(sources.commit_history(spark, tables, str(tmp_path / "again"))).collect()
    assert {r.operation: r.commits for r in counts} == {"WRITE": 2, "UNKNOWN": 1, "OPTIMIZE": 1}


def test_tables_of_schemas_and_catalogs(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS one")
    spark.sql("CREATE DATABASE IF NOT EXISTS `INFORMATION_SCHEMA`")
    spark.sql("CREATE TABLE IF NOT EXISTS one.t1 (a INT) USING parquet")
    spark.sql("CREATE TABLE IF NOT EXISTS one.t2 (a INT) USING parquet")
    spark.sql("CREATE TABLE IF NOT EXISTS `INFORMATION_SCHEMA`.hidden (a INT) USING parquet")
    spark.range(1).createOrReplaceTempView("passing")
    names = {tuple(r) for r in sources.tables_in_schema(spark, "spark_catalog", "one").collect()}
    assert names == {("spark_catalog", "one", "t1"), ("spark_catalog", "one", "t2")}
    assert sources.tables_in_schema(spark, "spark_catalog", "nowhere").count() == 0
    assert sources.tables_in_catalog(spark, "no_such_catalog").count() == 0
    found = {tuple(r) for r in sources.tables_in_catalog(spark, "spark_catalog").collect()}
    assert names <= found
    assert not any(schema.lower() == "information_schema" for _, schema, _ in found)
    by_scope = {
        scope: sources.discover_tables(spark, LayoutConfig(scan_mode=scope, schema="one", table="t1")).count()
        for scope in ("single_table", "schema", "catalog")
    }
    assert (by_scope["single_table"], by_scope["schema"], by_scope["catalog"]) == (1, 2, len(found))
    with pytest.raises(ValueError):
        sources.discover_tables(spark, LayoutConfig())


class Commands:
    """Stands in for the commands of a table format that is not installed here."""

    def __init__(self, spark, base):
        self.spark, self.base = spark, base

    def __call__(self, text):
        if text.startswith("SHOW PARTITIONS") or "`gone`" in text:
            raise PySparkException("no such command")
        if text.startswith("DESCRIBE DETAIL"):
            columns = "format string, id string, location string, numFiles bigint, sizeInBytes bigint, partitionColumns array<string>"
            name = "deep" if "deep" in text else "flat"
            rows = [("delta", "x", f"{self.base}/{'a b/' if name == 'deep' else ''}{name}", 3, 999, ["p", "q"] if name == "deep" else [])]
            return self.spark.createDataFrame([] if "`empty`" in text else rows, columns)
        if text.startswith("DESCRIBE HISTORY"):
            assert "LIMIT" not in text
            return self.spark.createDataFrame(
                [(5, datetime(2024, 1, 1), "WRITE", {"a": "b"}, {"c": "d"}, "someone")],
                "version bigint, timestamp timestamp, operation string, operationParameters map<string,string>, "
                "operationMetrics map<string,string>, userName string",
            )
        if text.startswith("SELECT"):
            return self.spark.read.parquet(f"{self.base}/a b/deep")
        return self.spark.sql("SELECT 'CREATE TABLE x CLUSTER BY (k)' AS createtab_stmt")


def test_commands_per_table(spark, lake):
    base, _ = lake
    run = Commands(spark, base)
    names = [("c", "s", t) for t in ("deep", "flat", "empty", "gone")]
    tables = spark.createDataFrame(names, TABLES)
    detail = sources.collect_details(spark, tables, run)
    rows = by_table(detail)
    assert (rows["flat"].sizeInBytes, rows["flat"].error, rows["flat"].minReaderVersion) == (999, None, None)
    assert rows["empty"].error == "no detail row"
    assert "no such command" in rows["gone"].error
    ddl = by_table(sources.collect_ddl(spark, tables, run))
    assert ddl["flat"].ddl.startswith("CREATE TABLE") and ddl["gone"].ddl is None
    assert "no such command" in ddl["gone"].error
    counts = by_table(partition_counts(spark, detail, run))
    assert {t: r.partition_count for t, r in counts.items()} == {"deep": 3}
    history = sources.history_of_table(spark, ("c", "s", "flat"), run)
    assert history.columns == TABLE_HISTORY.names
    assert history.first().operation == "WRITE"


def test_history_command_for_many_tables(spark, lake, tmp_path):
    run = Commands(spark, lake[0])
    tables = spark.createDataFrame([("c", "s", t) for t in ("deep", "_fl/at", "gone")], TABLES)
    history = sources.collect_history(spark, tables, str(tmp_path / "h"), run)
    assert history.schema == TABLE_HISTORY
    assert sorted((r["table"], r.version) for r in history.collect()) == [("_fl/at", 5), ("deep", 5)]
    failing = spark.createDataFrame([("c", "s", "gone")], TABLES)
    found = sources.command_history(spark, failing, str(tmp_path / "g"), run)
    assert found.rows.count() == 0 and found.rows.schema == TABLE_HISTORY
    failure = found.failures.first()
    assert (failure["table"], failure.step) == ("gone", "history") and "no such command" in failure.error


def test_collected_inventories_can_be_analyzed(spark, lake, tmp_path):
    from tablevitals import analyze

    base, _ = lake
    run = Commands(spark, base)
    detail = sources.collect_details(spark, spark.createDataFrame([("c", "s", "deep"), ("c", "s", "flat")], TABLES), run)
    inputs = inventories_of(spark, detail, LayoutConfig(), scratch=str(tmp_path / "s"))
    analysis = analyze(inputs, LayoutConfig(), datetime(2024, 3, 1))
    report, tables = by_table(analysis.report), by_table(analysis.tables)
    # SHOW CREATE TABLE and SHOW PARTITIONS fail here: no clustering, counts from the listing.
    assert (report["deep"].is_liquid_clustered, report["deep"].partition_count) == (False, 3)
    assert report["flat"].last_optimize == "2023-11-16T22:13:20"
    # The files are so small that their mean rounds to 0 MB, which the small-file rule skips.
    assert report["deep"].avg_file_size_mb == 0.0
    # Without a commit log nothing is said of its maintenance; the failures are.
    assert (report["deep"].health_status, report["deep"].issue_count) == ("healthy", 0)
    assert "_delta_log" in tables["deep"].history_error and tables["flat"].history_error is None
    assert tables["deep"].ddl_error and tables["flat"].ddl_error and tables["deep"].partitions_error
    assert tables["deep"].listing_error is None
    steps = {(r["table"], r.step) for r in inputs.failures.collect()}
    assert steps == {("deep", "history"), ("deep", "partitions")}
    assert set(report["deep"].asDict()) >= set(KEY)


def test_analysis_of_a_catalog_without_the_table_format(spark):
    """Here DESCRIBE DETAIL fails: a single table reports it, a scan skips such tables."""
    from tablevitals import run_analysis

    spark.sql("CREATE DATABASE IF NOT EXISTS plain")
    spark.sql("CREATE TABLE IF NOT EXISTS plain.t (a INT) USING parquet")
    single = LayoutConfig(schema="plain", table="t", persist_results=False)
    row = run_analysis(spark, single).report.first()
    assert (row["table"], row.health_status, row.optimize_status) == ("t", "error", "Never")
    assert row.error
    scan = LayoutConfig(scan_mode="schema", schema="plain", persist_results=False)
    assert run_analysis(spark, scan).report.count() == 0
    assert run_analysis(spark, LayoutConfig(scan_mode="catalog", persist_results=False)).summary.first().tables == 0
