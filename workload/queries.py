"""Every registered query: ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from dataclasses import replace
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablevitals import analyze, functions as fx
from tablevitals.plans.analyze import analyze_scope
from tablevitals import operators as ops
from tablevitals import plans
from tablevitals.schemas import KEY
from tablevitals.sources import Scratch, list_inventory, read_commits
from tablevitals.sources.attribute import attribute_paths

from . import inputs as I


def _detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.table_detail(I.detail(spark, sf_dir))


def _analysis(spark: SparkSession, sf_dir: str):
    return analyze(I.inventories(spark, sf_dir), I.CONFIG, I.AS_OF)


def _iso(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.withColumns({c: F.expr(fx.iso_text(c)) for c in columns})


def _joined(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.withColumns({c: F.array_join(c, ",") for c in columns})


# Files ---------------------------------------------------------------------


def file_layout(spark, sf_dir):
    return ops.file_layout(I.files(spark, sf_dir), I.CONFIG)


def file_size_bands(spark, sf_dir):
    return ops.file_size_bands(I.files(spark, sf_dir), I.CONFIG)


def file_skew(spark, sf_dir):
    return ops.file_skew(I.files(spark, sf_dir), I.CONFIG).drop("skew_error")


def floor_percentile(spark, sf_dir):
    return ops.floor_percentile(I.files(spark, sf_dir), 95)


def layout_from_detail(spark, sf_dir):
    """Layout where only the tables with an even number could be listed."""
    listed = I.files(spark, sf_dir).filter("CAST(substring(`table`, 4) AS INT) % 2 = 0")
    profile = ops.file_profile(listed, I.CONFIG)
    rows = ops.layout_with_fallback(_detail(spark, sf_dir), profile, I.CONFIG)
    return rows.select(
        *KEY,
        "layout_source",
        "total_files",
        "avg_file_size_mb",
        "median_file_size_mb",
        "max_file_size_mb",
        "small_files_pct",
        "severe_small_files_pct",
        "file_skew_severity",
    )


# Partitions ----------------------------------------------------------------


def partition_sizes(spark, sf_dir):
    return ops.partition_sizes(I.files(spark, sf_dir))


def partition_stats(spark, sf_dir):
    sizes = ops.partition_sizes(I.files(spark, sf_dir))
    rows = ops.partition_stats(_detail(spark, sf_dir), sizes, I.CONFIG)
    return _joined(rows, "partition_columns").drop("partition_note")


def partition_count(spark, sf_dir):
    return ops.partition_count(I.partition_rows(spark, sf_dir))


def partition_balance(spark, sf_dir):
    """Balance of tables with thousands of partitions."""
    detail = ops.table_detail(I.count_detail(spark, sf_dir))
    sizes = ops.partition_sizes(I.partition_rows(spark, sf_dir))
    rows = ops.partition_stats(detail, sizes, I.COUNT_CONFIG)
    return rows.drop("partition_columns", "partition_note")


def excess_partitions(spark, sf_dir):
    """The partition-count rule over the same tables; no issue leaves nulls."""
    detail = ops.table_detail(I.count_detail(spark, sf_dir))
    counts = ops.partition_count(I.partition_rows(spark, sf_dir))
    rows = detail.join(counts, list(KEY), "left")
    assessed = plans.assess(rows, I.COUNT_CONFIG, rules=("excess_partitions",))
    first = "try_element_at(issues, 1)"
    fields = [f"{first}.{name} AS {name}" for name in ("issue_id", "severity", "current_value", "threshold")]
    return assessed.selectExpr(*KEY, "partition_count", *fields)


def partition_count_from_data(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return ops.partition_count_from_data(rows, ["l_returnflag", "l_linestatus", "l_suppkey"])


# History -------------------------------------------------------------------


def recent_history(spark, sf_dir):
    rows = ops.recent_history(I.history(spark, sf_dir), 100)
    return _iso(rows.select(*KEY, "version", "timestamp", "operation"), "timestamp")


def operation_counts(spark, sf_dir):
    return ops.operation_counts(I.history(spark, sf_dir))


def operation_pivot(spark, sf_dir):
    return ops.operation_pivot(I.history(spark, sf_dir))


def last_operations(spark, sf_dir):
    rows = ops.last_operations(I.history(spark, sf_dir))
    return _iso(rows, *[c for c in rows.columns if c.startswith("last_")])


def maintenance_status(spark, sf_dir):
    rows = ops.maintenance_status(I.history(spark, sf_dir), I.AS_OF)
    return _iso(rows, *[c for c in rows.columns if c.endswith("_timestamp")])


def zorder_columns(spark, sf_dir):
    return _joined(ops.zorder_columns(I.history(spark, sf_dir)), "zorder_columns")


def optimize_cadence(spark, sf_dir):
    return _iso(ops.optimize_cadence(I.history(spark, sf_dir)), "last_optimize_timestamp")


def recent_optimizes(spark, sf_dir):
    rows = ops.recent_optimizes(I.history(spark, sf_dir))
    zorder = "try_element_at(parameters, 'zOrderBy') AS zorder_by"
    return _iso(rows.selectExpr(*KEY, "position", "version", "timestamp", zorder), "timestamp")


def growth(spark, sf_dir):
    return ops.growth(I.history(spark, sf_dir), _detail(spark, sf_dir))


def weekday_pattern(spark, sf_dir):
    rows = ops.weekday_pattern(I.history(spark, sf_dir))
    entries = "transform(map_entries(write_patterns), e -> concat(e.key, '=', e.value))"
    return rows.withColumn("write_patterns", F.expr(f"array_join(array_sort({entries}), ',')"))


# Detail --------------------------------------------------------------------


def table_detail(spark, sf_dir):
    rows = _joined(_detail(spark, sf_dir), "partition_columns")
    return rows.drop("created_at", "last_modified", "table_properties")


def supported_tables(spark, sf_dir):
    return ops.supported_tables(I.detail(spark, sf_dir))


def clustering(spark, sf_dir):
    return _joined(ops.clustering(I.ddl(spark, sf_dir)), "clustering_columns")


def scalar_helpers(spark, sf_dir):
    """Every scalar helper over every event."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id", "ts", "user_id", "event_type", "value"
    )
    prepared = events.selectExpr(
        "*",
        "floor(value * 1000000) AS size",
        "CAST(ts AS TIMESTAMP) AS at",
        "user_id % 5 AS bucket",
        "concat('a, ', event_type) AS names_text",
    ).selectExpr(
        "*",
        f"{fx.floor_days(fx.moment(I.AS_OF), 'at')} - 14 AS age_days",
        "CASE WHEN event_id % 3 = 0 THEN 'n/a' ELSE CAST(size AS STRING) END AS size_text",
    )
    return prepared.selectExpr(
        "event_id",
        f"{fx.bytes_to_mb('size')} AS size_mb",
        f"{fx.bytes_to_gb('size * 1000')} AS size_gb",
        f"{fx.iso_text('at')} AS iso",
        "age_days",
        f"{fx.age_text('nullif(age_days, 7)')} AS age_text",
        f"{fx.safe_divide('value', 'bucket', -1.0)} AS quotient",
        f"{fx.percent_of('bucket', '7')} AS pct",
        f"{fx.skew_severity('value / 4', I.CONFIG)} AS tier",
        f"{fx.weekday_name('at')} AS weekday",
        f"CAST({fx.digits_to_number('size_text')} AS BIGINT) AS digits",
        f"{fx.number_text('value * 1000')} AS grouped",
        f"{fx.ratio_text('value')} AS ratio",
        f"""{fx.operation_name("nullif(event_type, 'error')")} AS operation""",
        f"array_join({fx.parse_zorder('names_text')}, '|') AS names",
    )


# Assessment and reports ----------------------------------------------------


def small_file_issues(spark, sf_dir):
    """Which tables have a small-file problem?"""
    profile = ops.file_profile(I.files(spark, sf_dir), I.CONFIG)
    detail = _detail(spark, sf_dir)
    layout = ops.layout_with_fallback(detail, profile, I.CONFIG)
    rows = detail.join(layout, list(KEY)).withColumn("analysis_timestamp", F.expr(fx.moment(I.AS_OF)))
    found = plans.small_file_issues(rows, I.CONFIG)
    return found.select(*KEY, "issue_id", "category", "severity", "current_value", "sql_command")


METRIC_COLUMNS = (
    "is_valid",
    "layout_source",
    "total_files",
    "avg_file_size_mb",
    "median_file_size_mb",
    "std_dev_mb",
    "small_files_count",
    "optimal_files_count",
    "file_skew_ratio",
    "file_skew_severity",
    "coefficient_of_variation",
    "is_partitioned",
    "partition_count",
    "partition_skew_ratio",
    "partition_skew_severity",
    "is_liquid_clustered",
    "history_available",
    "total_commits",
    "vacuum_count",
    "days_since_last_optimize",
    "days_since_last_vacuum",
    "zorder_usage_count",
    "optimize_frequency_days",
    "daily_write_count",
    "avg_write_size_mb",
    "growth_rate_pct_daily",
    "busiest_day",
)


def table_metrics(spark, sf_dir):
    return _analysis(spark, sf_dir).tables.select(*KEY, *METRIC_COLUMNS)


def issues(spark, sf_dir):
    rows = plans.issues(_analysis(spark, sf_dir).tables)
    return _iso(rows.drop("severity_order"), "analysis_timestamp")


def issue_counts(spark, sf_dir):
    return plans.issue_counts(_analysis(spark, sf_dir).tables)


def table_health(spark, sf_dir):
    return plans.table_health(_analysis(spark, sf_dir).tables)


def table_report(spark, sf_dir):
    return _analysis(spark, sf_dir).report


def _scoped(spark, sf_dir, **scope):
    return analyze_scope(I.inventories(spark, sf_dir), replace(I.CONFIG, **scope), I.AS_OF).report


def scope_single(spark, sf_dir):
    """One table, which is reported though its format is not supported."""
    return _scoped(spark, sf_dir, scan_mode="single_table", table="src19")


def scope_schema(spark, sf_dir):
    return _scoped(spark, sf_dir, scan_mode="schema")


def scope_catalog(spark, sf_dir):
    return _scoped(spark, sf_dir, scan_mode="catalog")


_ISSUE_IDS = "array_join(transform(issues, i -> i.issue_id), ',') AS issue_ids"


def source_failures(spark, sf_dir):
    """What could not be read of each table, and the issues that are raised nevertheless."""
    tables = analyze(I.failing(spark, sf_dir), I.CONFIG, I.AS_OF).tables
    errors = ("listing_error", "history_error", "ddl_error")
    return tables.selectExpr(*KEY, *errors, "total_files", "history_available", "is_liquid_clustered", _ISSUE_IDS)


def table_defaults(spark, sf_dir):
    """Tables without files, listing, partition sizes, history or DDL."""
    tables = analyze(I.sparse(spark, sf_dir), I.CONFIG, I.AS_OF).tables
    figures = (
        "layout_source", "total_files", "avg_file_size_mb", "small_files_pct", "partition_count",
        "partition_sizes_estimated", "largest_partition_size_mb", "partition_skew_ratio", "history_available",
        "total_commits", "optimize_status", "is_liquid_clustered",
    )
    return tables.selectExpr(*KEY, *figures, _ISSUE_IDS)


def extended_report(spark, sf_dir):
    """The operations and latest optimizes of each table, which the 33 columns leave out."""
    rows = plans.extended_report(_analysis(spark, sf_dir).tables)
    summary = "array_join(transform(sort_array(map_entries(operation_summary)), e -> concat(e.key, '=', e.value)), ',')"
    detail = "concat(d.version, '@', {}, ' ', d.parameters['zOrderBy'], ' ', d.parameters['predicate'])"
    details = f"array_join(transform(optimize_details, d -> {detail.format(fx.iso_text('d.timestamp'))}), ';')"
    return rows.selectExpr(
        *KEY,
        f"{summary} AS operation_summary",
        f"{details} AS optimize_details",
        "total_commits",
        "optimize_frequency_days",
        "daily_write_count",
        "partition_skew_severity",
    )


def file_owners(spark, sf_dir):
    """The table each file belongs to where tables lie inside one another."""
    files, roots = I.nested_roots(spark, sf_dir)
    return attribute_paths(files, roots).select(*KEY, "doc_id", "relative_path")


def walked_files(spark, sf_dir):
    """The partitions found by listing tables on disk, with their files."""
    folder, roots = I.written_tables(spark, sf_dir)
    files = list_inventory(spark, roots, f"{folder}/listed").rows
    Scratch(spark, base=f"{folder}/tables").close()  # the listing is a snapshot of its own
    named = "count_if(endswith(path, name) AND endswith(name, '.parquet') AND modification_time IS NOT NULL)"
    return files.groupBy(*KEY, "partition").agg(
        F.count(F.lit(1)).alias("files"), F.expr(named).alias("named_files"), F.expr("min(size_bytes) > 0").alias("have_bytes")
    )


def logged_commits(spark, sf_dir):
    """Commits read from log files on disk."""
    for folder, roots in I.written_logs(spark, sf_dir):
        turn = read_commits(spark, roots, f"{folder}/read").rows
        turn.write.mode("append").parquet(f"{folder}/commits")  # the next turn's snapshot takes the place of this one
    commits = spark.read.schema(turn.schema).parquet(f"{folder}/commits")
    rows = commits.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("commits"),
        F.expr("count_if(operation = 'OPTIMIZE')").alias("optimizes"),
        F.max("version").alias("newest_version"),
        F.max("timestamp").alias("newest"),
        F.expr("sum(size(operationParameters))").alias("parameters"),
        F.expr("count(operationMetrics['numOutputBytes'])").alias("sized_commits"),
    )
    return _iso(rows, "newest")


def fleet_summary(spark, sf_dir):
    return _analysis(spark, sf_dir).summary


def maintenance_sql(spark, sf_dir):
    return _analysis(spark, sf_dir).maintenance


def _saved(spark, sf_dir):
    """Reports of three weekly runs, as they would stand in the report table, from one plan."""
    weeks = [I.AS_OF - timedelta(weeks=week) for week in (2, 1, 0)]
    return analyze(I.inventories(spark, sf_dir), I.CONFIG, weeks).report


def report_history(spark, sf_dir):
    return plans.report_history(_saved(spark, sf_dir))


def latest_reports(spark, sf_dir):
    return plans.latest_reports(_saved(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        file_layout,
        file_size_bands,
        file_skew,
        floor_percentile,
        layout_from_detail,
        partition_sizes,
        partition_stats,
        partition_count,
        partition_balance,
        excess_partitions,
        partition_count_from_data,
        recent_history,
        operation_counts,
        operation_pivot,
        last_operations,
        maintenance_status,
        zorder_columns,
        optimize_cadence,
        recent_optimizes,
        growth,
        weekday_pattern,
        table_detail,
        supported_tables,
        clustering,
        scalar_helpers,
        small_file_issues,
        table_metrics,
        issues,
        issue_counts,
        table_health,
        table_report,
        scope_single,
        scope_schema,
        scope_catalog,
        source_failures,
        table_defaults,
        extended_report,
        file_owners,
        walked_files,
        logged_commits,
        fleet_summary,
        maintenance_sql,
        report_history,
        latest_reports,
    )
}
