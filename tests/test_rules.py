"""Every rule at, just below and just above its limits."""

import pytest

from helpers import AS_OF
from tablevitals import LayoutConfig
from tablevitals import plans
from tablevitals.functions import moment

CONFIG = LayoutConfig()

# A table with nothing to complain about.
SOUND = {
    "catalog": "'c'",
    "schema": "'s'",
    "table": "'t'",
    "full_name": "'c.s.t'",
    "is_valid": "true",
    "num_files": "10L",
    "table_size_gb": "1D",
    "avg_file_size_mb": "512D",
    "median_file_size_mb": "512D",
    "min_file_size_mb": "500D",
    "max_file_size_mb": "600D",
    "small_files_pct": "0D",
    "severe_small_files_pct": "0D",
    "file_skew_ratio": "1D",
    "file_skew_severity": "'none'",
    "coefficient_of_variation": "1D",
    "partition_columns": "array('p')",
    "partition_count": "3",
    "has_partition_skew": "false",
    "partition_skew_ratio": "1D",
    "partition_skew_severity": "'none'",
    "largest_partition_size_mb": "1D",
    "median_partition_size_mb": "1D",
    "smallest_partition_size_mb": "1D",
    "is_liquid_clustered": "true",
    "zorder_columns": "CAST(array() AS ARRAY<STRING>)",
    "days_since_last_optimize": "1",
    "days_since_last_vacuum": "1",
    "analysis_timestamp": moment(AS_OF),
}


def assess(spark, config=CONFIG, **changes):
    row = {**SOUND, **changes}
    return plans.assess(spark.range(1).selectExpr(*[f"{v} AS `{k}`" for k, v in row.items()]), config)


CASES = [
    ({}, []),
    ({"avg_file_size_mb": "31.99D"}, ["SMALL_FILES_CRITICAL"]),
    ({"avg_file_size_mb": "32D"}, ["SMALL_FILES_WARNING"]),
    ({"avg_file_size_mb": "127.99D"}, ["SMALL_FILES_WARNING"]),
    ({"avg_file_size_mb": "128D"}, []),
    ({"severe_small_files_pct": "50D"}, []),
    ({"severe_small_files_pct": "50.01D"}, ["SMALL_FILES_CRITICAL"]),
    ({"small_files_pct": "20D"}, []),
    ({"small_files_pct": "20.01D"}, ["SMALL_FILES_WARNING"]),
    ({"avg_file_size_mb": "0D", "small_files_pct": "100D", "severe_small_files_pct": "100D"}, []),
    ({"avg_file_size_mb": "1D", "num_files": "0L"}, []),
    ({"file_skew_severity": "'low'"}, ["FILE_SKEW_LOW"]),
    ({"file_skew_severity": "'medium'"}, ["FILE_SKEW_MEDIUM"]),
    ({"file_skew_severity": "'high'"}, ["FILE_SKEW_HIGH"]),
    ({"days_since_last_optimize": "CAST(NULL AS INT)"}, ["OPTIMIZE_NEVER_RUN"]),
    ({"days_since_last_optimize": "30"}, []),
    ({"days_since_last_optimize": "31"}, ["OPTIMIZE_STALE"]),
    ({"days_since_last_vacuum": "CAST(NULL AS INT)"}, ["VACUUM_NEVER_RUN"]),
    ({"days_since_last_vacuum": "30"}, []),
    ({"days_since_last_vacuum": "31"}, ["VACUUM_STALE"]),
    ({"table_size_gb": "1000D"}, []),
    ({"table_size_gb": "999.99D", "partition_columns": "CAST(array() AS ARRAY<STRING>)"}, []),
    ({"table_size_gb": "1000D", "partition_columns": "CAST(array() AS ARRAY<STRING>)"}, ["LARGE_TABLE_NO_PARTITION"]),
    ({"table_size_gb": "10D", "is_liquid_clustered": "false"}, []),
    ({"table_size_gb": "10.01D", "is_liquid_clustered": "false"}, ["NO_LIQUID_CLUSTERING"]),
    ({"table_size_gb": "500D", "is_liquid_clustered": "false"}, ["NO_LIQUID_CLUSTERING"]),
    ({"table_size_gb": "500.01D", "is_liquid_clustered": "false"}, ["NO_LIQUID_CLUSTERING", "NO_ZORDER"]),
    ({"table_size_gb": "500.01D", "is_liquid_clustered": "false", "zorder_columns": "array('z')"}, ["NO_LIQUID_CLUSTERING"]),
    ({"table_size_gb": "1000D", "is_liquid_clustered": "false"}, ["NO_ZORDER"]),
    ({"partition_count": "4000"}, []),
    ({"partition_count": "4001"}, ["HIGH_PARTITION_COUNT"]),
    ({"partition_count": "5000"}, ["HIGH_PARTITION_COUNT"]),
    ({"partition_count": "5001"}, ["EXCESS_PARTITIONS"]),
    ({"has_partition_skew": "true", "partition_skew_severity": "'high'"}, ["PARTITION_SKEW_HIGH"]),
    ({"has_partition_skew": "true"}, []),
    ({"partition_skew_severity": "'high'"}, []),
]


@pytest.fixture(scope="module")
def outcomes(spark):
    """All cases assessed in one job."""
    frame = None
    for at, (changes, _) in enumerate(CASES):
        row = {**SOUND, **changes, "case": str(at)}
        one = spark.range(1).selectExpr(*[f"{v} AS `{k}`" for k, v in row.items()])
        frame = one if frame is None else frame.unionByName(one)
    return {r["case"]: r for r in plans.assess(frame, CONFIG).collect()}


@pytest.mark.parametrize("at", range(len(CASES)))
def test_rule_limits(outcomes, at):
    assert [i.issue_id for i in outcomes[at].issues] == CASES[at][1], CASES[at][0]


def test_severities_and_categories(outcomes):
    seen = {i.issue_id: (i.severity, i.category) for r in outcomes.values() for i in r.issues}
    assert seen == {
        "SMALL_FILES_CRITICAL": ("critical", "small_files"),
        "SMALL_FILES_WARNING": ("medium", "small_files"),
        "FILE_SKEW_LOW": ("low", "file_skew"),
        "FILE_SKEW_MEDIUM": ("medium", "file_skew"),
        "FILE_SKEW_HIGH": ("high", "file_skew"),
        "OPTIMIZE_NEVER_RUN": ("high", "stale_optimize"),
        "OPTIMIZE_STALE": ("medium", "stale_optimize"),
        "VACUUM_NEVER_RUN": ("medium", "stale_vacuum"),
        "VACUUM_STALE": ("low", "stale_vacuum"),
        "LARGE_TABLE_NO_PARTITION": ("high", "no_partitioning"),
        "NO_LIQUID_CLUSTERING": ("medium", "no_liquid_clustering"),
        "NO_ZORDER": ("medium", "no_zorder"),
        "HIGH_PARTITION_COUNT": ("medium", "excess_partitions"),
        "EXCESS_PARTITIONS": ("critical", "excess_partitions"),
        "PARTITION_SKEW_HIGH": ("high", "partition_skew"),
    }
    texts = [i for r in outcomes.values() for i in r.issues]
    assert all(i.title and i.details and i.current_value and i.threshold and i.recommendation for i in texts)


def test_issues_stand_worst_first_then_in_rule_order(spark):
    row = assess(
        spark,
        partition_count="9000",
        file_skew_severity="'low'",
        days_since_last_optimize="CAST(NULL AS INT)",
        days_since_last_vacuum="99",
        small_files_pct="50D",
        table_size_gb="700D",
        is_liquid_clustered="false",
    ).first()
    assert [(i.severity, i.rule_no) for i in row.issues] == [
        ("critical", 8), ("high", 3), ("medium", 1), ("medium", 6), ("medium", 7), ("low", 2), ("low", 4),
    ]
    counts = (row.issue_count, row.critical_issues, row.high_issues, row.medium_issues, row.low_issues)
    assert counts == (7, 1, 1, 3, 2)


@pytest.mark.parametrize(
    "changes, health",
    [
        ({}, "healthy"),
        ({"days_since_last_vacuum": "99"}, "healthy"),
        ({"days_since_last_optimize": "99"}, "needs_attention"),
        ({"days_since_last_optimize": "CAST(NULL AS INT)"}, "warning"),
        ({"days_since_last_optimize": "CAST(NULL AS INT)", "partition_count": "9999"}, "critical"),
        ({"partition_count": "9999", "is_valid": "false"}, "error"),
    ],
)
def test_health(spark, changes, health):
    row = assess(spark, **changes).first()
    assert row.health_status == health
    if health == "error":
        assert (row.issues, row.issue_count) == ([], 0)


def test_statements(spark):
    row = assess(
        spark,
        table="'we`ird'",
        zorder_columns="array('a', 'b c')",
        days_since_last_optimize="99",
        days_since_last_vacuum="99",
    ).first()
    assert [i.sql_command for i in row.issues] == [
        "OPTIMIZE `c`.`s`.`we``ird` ZORDER BY (`a`, `b c`);",
        "VACUUM `c`.`s`.`we``ird` RETAIN 168 HOURS;",
    ]


def test_custom_limits(spark):
    config = LayoutConfig(small_file_severe_mb=64, optimize_stale_days=14, large_table_threshold_gb=500, max_partition_count=2)
    row = assess(spark, config, avg_file_size_mb="63D", days_since_last_optimize="15", partition_count="2").first()
    assert [i.issue_id for i in row.issues] == ["SMALL_FILES_CRITICAL", "OPTIMIZE_STALE", "HIGH_PARTITION_COUNT"]
