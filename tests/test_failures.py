"""Failures as data, ownership of nested tables, bounded drivers, and the life of snapshots."""

import json
import os
from datetime import timedelta

import pandas as pd
import pytest
from pyspark.errors import PySparkException

from helpers import AS_OF, GB, MB, by_table, detail_frame, files_frame, history_frame
from tablevitals import Inventories, LayoutConfig, analyze, sources
from tablevitals.operators.failures import step_errors
from tablevitals.plans.analyze import analyze_scope, run_analysis
from tablevitals.schemas import FAILURES, KEY, TABLE_DDL
from tablevitals.sources import catalog
from tablevitals.sources.catalog import TABLES
from tablevitals.sources.walk import directory_lister

LOCATED = "catalog string, schema string, `table` string, location string"
CONFIG = LayoutConfig(scan_mode="schema", catalog="c", schema="s", persist_results=False)


def failures_frame(spark, *rows):
    return spark.createDataFrame([("c", "s", *row) for row in rows], FAILURES)


def test_directories_that_cannot_be_read_are_rows(spark, tmp_path):
    (tmp_path / "good" / "p=1").mkdir(parents=True)
    (tmp_path / "good" / "p=1" / "a.parquet").write_bytes(b"12")
    tables = spark.createDataFrame(
        [("c", "s", "good", str(tmp_path / "good")), ("c", "s", "gone", str(tmp_path / "gone")), ("c", "s", "odd", "nosuch://x/y"), ("c", "s", "none", None)], LOCATED
    )
    found = sources.list_inventory(spark, tables, str(tmp_path / "scratch"))
    assert [(r["table"], r.partition, r.size_bytes) for r in found.rows.collect()] == [("good", "p=1", 2)]
    assert found.failures.columns == FAILURES.names
    rows = {r["table"]: r for r in found.failures.collect()}
    assert set(rows) == {"gone", "odd"} and {r.step for r in rows.values()} == {"listing"}
    assert rows["gone"].error.startswith("FileNotFoundError") and rows["gone"].path == str(tmp_path / "gone")


def test_commit_logs_that_cannot_be_read_are_rows(spark, tmp_path):
    log = tmp_path / "t" / "_delta_log"
    log.mkdir(parents=True)
    commit = {"commitInfo": {"timestamp": 1700000000000, "operation": "WRITE"}}
    (log / f"{0:020}.json").write_text(json.dumps(commit))
    (log / f"{1:020}.json").write_bytes(b"\xff\xfe commitInfo")
    (tmp_path / "bare").mkdir()
    tables = spark.createDataFrame([("c", "s", t, str(tmp_path / t)) for t in ("t", "bare")], LOCATED)
    found = sources.read_commits(spark, tables, str(tmp_path / "scratch"))
    assert [(r["table"], r.version) for r in found.rows.collect()] == [("t", 0)]
    rows = {r["table"]: r for r in found.failures.collect()}
    assert rows["t"].path.endswith("1.json") and rows["t"].error.startswith("UnicodeDecodeError")
    assert rows["bare"].path.endswith("_delta_log") and {r.step for r in rows.values()} == {"history"}


def test_scopes_that_cannot_be_listed_are_rows(spark):
    schema = sources.discover(spark, LayoutConfig(scan_mode="schema", schema="nowhere"))
    assert schema.rows.count() == 0
    assert [(r.catalog, r.schema, r["table"], r.step) for r in schema.failures.collect()] == [("spark_catalog", "nowhere", None, "discovery")]
    whole = sources.discover(spark, LayoutConfig(scan_mode="catalog", catalog="no_such_catalog"))
    assert [(r.catalog, r.schema) for r in whole.failures.collect()] == [("no_such_catalog", None)]
    assert sources.discover(spark, LayoutConfig(table="t")).failures.count() == 0
    with run_analysis(spark, LayoutConfig(scan_mode="schema", schema="nowhere", persist_results=False)) as result:
        assert result.report.count() == 0 and result.failures.count() == 1


def test_errors_fold_to_one_text_per_step(spark):
    rows = failures_frame(
        spark, ("t", "listing", "/b", "denied"), ("t", "listing", "/a", "denied"), ("t", "listing", "/a", "gone"),
        ("t", "history", None, "no log"), ("u", "ddl", None, None), (None, "discovery", None, "x"),
    )
    found = by_table(step_errors(rows.repartition(5)))
    assert set(found) == {"t", "u"}
    assert (found["t"].listing_error, found["t"].history_error, found["t"].ddl_error) == ("/a: denied (and 2 more)", "no log", None)
    assert found["u"].ddl_error == "failed"


def inventories(spark, failures=None, ddl_error=None):
    return Inventories(
        detail=detail_frame(spark, {"table": "a", "sizeInBytes": 600 * GB}, {"table": "b", "sizeInBytes": 600 * GB}),
        ddl=spark.createDataFrame([("c", "s", "a", None, ddl_error)], TABLE_DDL),
        files=files_frame(spark, {"a": [GB, GB], "b": [GB, GB]}),
        history=history_frame(spark, []),
        failures=failures,
    )


def ids(analysis):
    return {(r["table"], r.issue_id) for r in analysis.issues.collect()}


def test_rules_do_not_take_failures_for_absence(spark):
    every = {"OPTIMIZE_NEVER_RUN", "VACUUM_NEVER_RUN", "NO_LIQUID_CLUSTERING", "NO_ZORDER"}
    plain = ids(analyze(inventories(spark), CONFIG, AS_OF))
    assert plain == {(t, i) for t in "ab" for i in every}
    no_history = ids(analyze(inventories(spark, failures_frame(spark, ("a", "history", "/a/_delta_log", "gone"))), CONFIG, AS_OF))
    assert no_history == plain - {("a", i) for i in every - {"NO_LIQUID_CLUSTERING"}}
    no_ddl = ids(analyze(inventories(spark, ddl_error="denied"), CONFIG, AS_OF))
    assert no_ddl == plain - {("a", "NO_LIQUID_CLUSTERING"), ("a", "NO_ZORDER")}
    tables = by_table(analyze(inventories(spark, failures_frame(spark, ("a", "listing", "/a/x", "denied"))), CONFIG, AS_OF).tables)
    assert (tables["a"].listing_error, tables["b"].listing_error) == ("/a/x: denied", None)


def test_failures_follow_the_scope(spark):
    rows = failures_frame(spark, ("a", "history", None, "x"), ("z", "history", None, "x")).unionByName(
        spark.createDataFrame([("c", "other", None, "discovery", None, "x"), ("d", "s", "a", "ddl", None, "x")], FAILURES)
    )
    kept = analyze_scope(inventories(spark, rows), LayoutConfig(catalog="c", schema="s", table="a"), AS_OF).failures
    assert sorted((r["table"] or "", r.step) for r in kept.collect()) == [("", "discovery"), ("a", "history")]


@pytest.mark.parametrize("scheme", ["", "file:", "file://"])
def test_nested_tables_own_their_files(spark, tmp_path, scheme):
    for folder in ("outer/p=1", "outer/inner/q=1", "outer/inner/deep/x"):
        (tmp_path / folder).mkdir(parents=True)
        (tmp_path / folder / "f.parquet").write_bytes(b"1")
    roots = {"outer": tmp_path / "outer", "inner": f"{scheme}{tmp_path}/outer/inner/", "deep": tmp_path / "outer/inner/deep"}
    tables = spark.createDataFrame([("c", "s", t, str(r)) for t, r in roots.items()], LOCATED)
    rows = sources.walk_files(spark, tables, str(tmp_path / "scratch")).collect()
    assert sorted((r["table"], r.relative_path) for r in rows) == [
        ("deep", "x/f.parquet"), ("inner", "q=1/f.parquet"), ("outer", "p=1/f.parquet"),
    ]


def test_a_flat_directory_passes_in_slices(tmp_path):
    for i in range(25_000):
        (tmp_path / f"{i}.parquet").touch()
    (tmp_path / "note.txt").touch()
    row = pd.DataFrame([("c", "s", "t", str(tmp_path), str(tmp_path))], columns=[*KEY, "root", "path"])
    sizes = [len(frame) for frame in directory_lister(".parquet", "_")(iter([row]))]
    assert sizes == [10_000, 10_000, 5_000]


def test_the_driver_holds_one_batch_of_results(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(catalog, "BATCH_ROWS", 3)
    tables = spark.createDataFrame([("c", "s", f"t{i}") for i in range(10)], TABLES)
    running = []

    def run(text):
        running.append(text)
        written = len(list((tmp_path / "ddl").glob("*.parquet")))
        assert len(running) <= 3 * (written + 1)  # none of the next batch before the last is written
        return spark.sql("SELECT 'x' AS createtab_stmt")

    rows = sources.collect_ddl(spark, tables, run, scratch=str(tmp_path / "ddl"))
    assert rows.count() == 10
    counts = [len(pd.read_parquet(p)) for p in (tmp_path / "ddl").glob("*.parquet")]
    assert sorted(counts) == [1, 3, 3, 3]
    assert sources.collect_ddl(spark, tables.limit(0), run, scratch=str(tmp_path / "none")).count() == 0


def snapshots(spark):
    base = (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()).removeprefix("file:")
    return {name for name in os.listdir(base) if name.startswith(("analysis", "inventories", "commands", "listing", "commits", "history", "tables"))}


def test_snapshots_go_when_the_result_is_closed(spark):
    before = snapshots(spark)
    with run_analysis(spark, CONFIG, AS_OF, inventories(spark)) as result:
        assert result.report.count() == 2
        assert len(snapshots(spark) - before) == 1
    assert snapshots(spark) == before
    with run_analysis(spark, LayoutConfig(scan_mode="catalog", persist_results=False), AS_OF):
        assert len(snapshots(spark) - before) == 1  # the inventories are gone already
    assert snapshots(spark) == before


def test_a_failing_run_leaves_no_snapshot(spark, monkeypatch):
    before = snapshots(spark)

    def fail(*_):
        raise RuntimeError("broken")

    monkeypatch.setattr("tablevitals.sources.save_report", fail)
    with pytest.raises(RuntimeError):
        run_analysis(spark, LayoutConfig(scan_mode="schema", catalog="c", schema="s"), AS_OF, inventories(spark))
    assert snapshots(spark) == before


def test_a_run_is_published_whole_and_once(spark, monkeypatch):
    from tablevitals.sources import store

    config = LayoutConfig(
        scan_mode="schema", catalog="c", schema="s", output_schema="whole", output_table="r", output_issues_table="i", output_runs_table="p"
    )
    inputs, append = inventories(spark), store._append

    def breaks(table):
        def failing(rows, settings, name, key):
            if name == table:
                raise PySparkException("lost")
            append(rows, settings, name, key)

        return failing

    def run(when=AS_OF):
        run_analysis(spark, config, when, inputs).close()
        spark.catalog.refreshTable("whole.r")

    def saved():
        return spark.table("whole.r").count(), sources.read_reports(spark, config).count(), sources.read_issues(spark, config).count()

    run()
    first = saved()
    assert first == (2, 2, 8)
    later = AS_OF + timedelta(days=1)
    for table in ("i", "p"):
        monkeypatch.setattr(store, "_append", breaks(table))
        run(later)
        assert saved() == (4, 2, 8)  # appended, not published
    monkeypatch.setattr(store, "_append", append)
    for _ in range(2):
        run(later)
        assert saved() == (4, 4, 16)


def test_reports_of_versions_without_published_keys_stay_in_sight(spark):
    config = LayoutConfig(
        scan_mode="schema", catalog="c", schema="s", output_schema="earlier", output_table="r", output_issues_table="i", output_runs_table="p"
    )
    old = analyze(inventories(spark), CONFIG, AS_OF - timedelta(days=9))
    spark.sql("CREATE SCHEMA IF NOT EXISTS earlier")
    old.report.write.saveAsTable("earlier.r")
    assert sources.read_reports(spark, config).count() == 2
    run_analysis(spark, config, AS_OF, inventories(spark)).close()
    assert sources.read_reports(spark, config).count() == 4


def test_small_files_of_a_partly_listed_table_still_count(spark):
    inputs = inventories(spark, failures_frame(spark, ("a", "listing", "/a/x", "denied")))
    inputs = Inventories(**{**inputs.__dict__, "files": files_frame(spark, {"a": [MB, MB]})})
    assert ("a", "SMALL_FILES_CRITICAL") in ids(analyze(inputs, CONFIG, AS_OF))
