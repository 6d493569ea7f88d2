import json
from datetime import timedelta

import pytest

from helpers import AS_OF, GB, MB, by_table, detail_frame, files_frame, history_frame
from tablevitals import Inventories, LayoutConfig, analyze
from tablevitals import operators as ops
from tablevitals import plans
from tablevitals import sources
from tablevitals.plans.analyze import analyze_scope, run_analysis
from tablevitals.schemas import ISSUES, KEY, TABLE_DDL, TABLE_REPORT

CONFIG = LayoutConfig(scan_mode="schema", catalog="c", schema="s")


def inventories(spark):
    day = timedelta(days=1)
    return Inventories(
        detail=detail_frame(
            spark,
            {"table": "good", "numFiles": 2, "sizeInBytes": 2 * GB, "properties": None},
            {"table": "bad", "numFiles": 3, "sizeInBytes": 20 * GB, "partitionColumns": ["p"]},
            {"table": "unseen", "numFiles": 4, "sizeInBytes": 4 * MB, "format": None},
            {"table": "other", "format": "parquet"},
            {"table": "broken", "format": None, "error": "no detail row"},
        ),
        ddl=spark.createDataFrame([("c", "s", "good", "CLUSTER BY (a)", None)], TABLE_DDL),
        files=files_frame(
            spark,
            {"good": [GB, GB], "bad": [MB, MB, 40 * MB], "other": [MB]},
            {("bad", 0): "p=1", ("bad", 1): "p=1", ("bad", 2): "p=2"},
        ),
        history=history_frame(
            spark,
            [
                ("good", 1, AS_OF - 3 * day, "OPTIMIZE", {"zOrderBy": '["z"]'}, {}),
                ("good", 2, AS_OF - 2 * day, "VACUUM END", {}, {}),
                ("bad", 1, AS_OF - 90 * day, "OPTIMIZE", {}, {}),
                ("other", 1, AS_OF, "OPTIMIZE", {}, {}),
            ],
        ),
    )


@pytest.fixture(scope="module")
def analysis(spark):
    return analyze(inventories(spark), CONFIG, AS_OF)


@pytest.fixture(scope="module")
def report(analysis):
    return by_table(analysis.report)


def test_report_schema_is_fixed(analysis):
    types = [(f.name, f.dataType) for f in analysis.report.schema.fields]
    assert types == [(f.name, f.dataType) for f in TABLE_REPORT.fields]
    assert len(types) == 33
    types = [(f.name, f.dataType) for f in analysis.issues.schema.fields]
    assert types == [(f.name, f.dataType) for f in ISSUES.fields]
    assert len(types) == 13


def test_a_sound_table(report):
    row = report["good"]
    assert (row.health_status, row.issue_count, row.issues_summary, row.sql_commands) == ("healthy", 0, "[]", "[]")
    assert (row.table_size_gb, row.num_files, row.avg_file_size_mb) == (2.0, 2, 1024.0)
    assert (row.is_liquid_clustered, row.clustering_columns, row.zorder_columns) == (True, '["a"]', '["z"]')
    assert (row.last_optimize, row.last_optimize_days_ago) == ((AS_OF - timedelta(days=3)).isoformat(), 3)
    assert (row.vacuum_status, row.is_partitioned, row.partition_columns) == ("2 days ago", False, "[]")
    assert (row.analysis_timestamp, row.error) == (AS_OF.isoformat(), None)


def test_a_troubled_table(report):
    row = report["bad"]
    assert (row.health_status, row.partition_count, row.partition_skew_ratio) == ("critical", 2, 1.9)
    assert (row.file_skew_ratio, row.file_skew_severity) == (40.0, "high")
    summary = json.loads(row.issues_summary)
    assert [i["id"] for i in summary] == [
        "SMALL_FILES_CRITICAL", "FILE_SKEW_HIGH", "OPTIMIZE_STALE", "VACUUM_NEVER_RUN", "NO_LIQUID_CLUSTERING",
    ]
    assert list(summary[0]) == ["id", "category", "severity", "title", "details"]
    assert json.loads(row.sql_commands)[1] == "OPTIMIZE `c`.`s`.`bad`;"
    assert row.issue_count == row.critical_issues + row.high_issues + row.medium_issues + row.low_issues == 5


def test_a_table_without_listing_and_history(report):
    row = report["unseen"]
    assert (row.avg_file_size_mb, row.small_files_pct, row.file_skew_severity) == (1.0, 100.0, "none")
    assert (row.optimize_status, row.vacuum_status, row.zorder_columns) == ("Never run", "Never run", "[]")
    assert row.health_status == "critical"


def test_tables_that_cannot_be_analyzed(report):
    for table, error in (("other", "unsupported table format: parquet"), ("broken", "no detail row")):
        row = report[table]
        assert (row.health_status, row.error, row.issue_count) == ("error", error, 0)
        assert (row.optimize_status, row.vacuum_status, row.num_files, row.table_size_gb) == ("Never", "Never", 0, 0.0)


def test_fleet_summary_and_maintenance(analysis):
    assert analysis.summary.first().asDict() == {
        "tables": 5, "healthy": 1, "needs_attention": 0, "warning": 0, "critical": 2, "error": 2,
    }
    steps = [(r["table"], r.step) for r in analysis.maintenance.orderBy("table", "step").collect()]
    assert steps == [("bad", i) for i in (1, 2, 3, 4)] + [("unseen", i) for i in (1, 2, 3)]


def test_issue_rows_add_up(analysis):
    rows = plans.issues(analysis.tables).groupBy(*KEY).count().collect()
    assert {r["table"]: r["count"] for r in rows} == {
        r["table"]: r.issue_count for r in plans.issue_counts(analysis.tables).collect() if r.issue_count
    }
    health = {r["table"]: (r.worst_severity, r.health_status) for r in plans.table_health(analysis.tables).collect()}
    assert health["good"] == ("none", "healthy")
    assert health["bad"] == ("critical", "critical")


def test_no_issue_keeps_the_schema(spark):
    inputs = inventories(spark).map(lambda rows: rows.filter("`table` = 'good'"))
    issues = analyze(inputs, CONFIG, AS_OF).issues
    assert issues.count() == 0
    assert issues.columns == ISSUES.names


def test_extended_report_has_typed_columns(analysis):
    row = by_table(plans.extended_report(analysis.tables))["good"]
    assert row.zorder_columns == ["z"]
    assert row.last_optimize_timestamp == AS_OF - timedelta(days=3)
    assert row.history_available and row.layout_source == "listing"
    assert (row.growth_rate_pct_daily, row.partition_skew_severity, row.table_properties) == (0.0, "none", {})


def test_scopes(spark):
    inputs = inventories(spark)
    schema = by_table(analyze_scope(inputs, CONFIG, AS_OF).tables)
    assert set(schema) == {"good", "bad"}
    catalog = LayoutConfig(scan_mode="catalog", catalog="c")
    assert set(by_table(analyze_scope(inputs, catalog, AS_OF).tables)) == {"good", "bad"}
    assert analyze_scope(inputs, LayoutConfig(scan_mode="catalog", catalog="d"), AS_OF).tables.count() == 0
    single = LayoutConfig(catalog="c", schema="s", table="other")
    row = analyze_scope(inputs, single, AS_OF).report.first()
    assert (row["table"], row.health_status) == ("other", "error")


def test_detail_defaults(spark):
    row = ops.table_detail(
        spark.createDataFrame([("c", "s", "t", "DELTA")], "catalog string, schema string, `table` string, format string")
    ).first()
    assert row.is_valid and row.error is None
    assert (row.table_size_bytes, row.table_size_gb, row.num_files) == (0, 0.0, 0)
    assert (row.partition_columns, row.table_properties, row.full_name) == ([], {}, "c.s.t")
    frame = detail_frame(spark, {"table": "a", "format": "Delta"}, {"table": "b", "format": None}, {"table": "c", "format": "csv"})
    assert [r["table"] for r in ops.supported_tables(frame).collect()] == ["a"]


def test_result_does_not_depend_on_partitioning(spark, report):
    shuffled = inventories(spark).map(lambda rows: rows.repartition(13))
    assert by_table(analyze(shuffled, CONFIG, AS_OF).report) == report


def test_saving_and_reading_back(spark):
    config = LayoutConfig(
        scan_mode="schema", catalog="c", schema="s", output_schema="vitals", output_table="reports", output_issues_table="issues"
    )
    inputs = inventories(spark)
    for week in (2, 1, 0):
        run_analysis(spark, config, AS_OF - timedelta(weeks=week), inputs)
    saved = spark.table("spark_catalog.vitals.reports")
    assert saved.count() == 6
    assert spark.table("spark_catalog.vitals.issues").columns == ISSUES.names
    shown = sources.read_reports(spark, config).collect()
    assert len(shown) == 6 and len(shown[0]) == 15
    stamps = [r.analysis_timestamp for r in shown]
    assert stamps == sorted(stamps, reverse=True)
    assert len(sources.read_reports(spark, config, limit=2).collect()) == 2
    latest = plans.latest_reports(saved).collect()
    assert {(r["table"], r.analysis_timestamp) for r in latest} == {(t, AS_OF.isoformat()) for t in ("good", "bad")}


def test_saving_can_be_off_and_can_fail(spark, analysis):
    assert sources.save_report(analysis, LayoutConfig(persist_results=False)) is False
    assert sources.save_report(analysis, LayoutConfig(output_format="no_such_format")) is False


def test_all_outputs_start_from_stored_rows(spark):
    """After a run, no output reads an inventory again."""
    config = LayoutConfig(scan_mode="schema", catalog="c", schema="s", persist_results=False)
    result = run_analysis(spark, config, AS_OF, inventories(spark))
    for frame in (result.report, result.issues, result.summary, result.maintenance):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan parquet") == 1 and "LocalTableScan" not in plan and "ExistingRDD" not in plan
    assert by_table(result.report) == by_table(analyze_scope(inventories(spark), config, AS_OF).report)
