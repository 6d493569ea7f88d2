from datetime import datetime

import pytest

from helpers import evaluate
from tablevitals import LayoutConfig
from tablevitals import functions as fx


@pytest.mark.parametrize("value", [2.675, 0.125, 0.015, 0.025, 1.005, 2.5, 1234567.885, 0.0, 3.25, 99.995])
@pytest.mark.parametrize("digits", [1, 2, 4])
def test_rounding_is_that_of_the_binary_value(spark, value, digits):
    assert evaluate(spark, fx.round_binary("x", digits), x=value) == round(value, digits)


@pytest.mark.parametrize(
    "size", [0, 1, 5242, 5243, 131072, 10485, 393216, 104857600, 54610255, 2**40 + 12345, 7 * 2**30 + 1]
)
def test_megabytes_and_gigabytes(spark, size):
    assert evaluate(spark, fx.bytes_to_mb("x"), x=size) == round(size / (1024 * 1024), 2)
    assert evaluate(spark, fx.bytes_to_gb("x"), x=size) == round(size / (1024**3), 2)


def test_null_sizes_are_zero(spark):
    assert evaluate(spark, fx.bytes_to_mb("CAST(NULL AS BIGINT)")) == 0.0
    assert evaluate(spark, fx.bytes_to_gb("CAST(NULL AS BIGINT)")) == 0.0


def test_a_tie_goes_to_the_even_hundredth(spark):
    assert evaluate(spark, fx.bytes_to_mb("x"), x=131072) == 0.12


def test_safe_divide_and_percent(spark):
    assert evaluate(spark, fx.safe_divide("x", "y", 7.0), x=1, y=0) == 7.0
    assert evaluate(spark, fx.safe_divide("x", "y"), x=1, y=4) == 0.25
    assert evaluate(spark, fx.percent_of("x", "y"), x=1, y=3) == 33.33
    assert evaluate(spark, fx.percent_of("x", "y"), x=1, y=0) is None


@pytest.mark.parametrize(
    "text, number", [("12", 12), ("0", 0), ("", 0), ("abc", 0), ("1.5", 0), ("-3", 0), ("9" * 25, int("9" * 25))]
)
def test_digits_to_number(spark, text, number):
    assert int(evaluate(spark, fx.digits_to_number("x"), x=text)) == number


@pytest.mark.parametrize(
    "later, earlier",
    [
        (datetime(2024, 3, 1), datetime(2024, 2, 28, 12)),
        (datetime(2024, 3, 1), datetime(2024, 3, 1)),
        (datetime(2024, 3, 1), datetime(2024, 3, 1, 0, 0, 1)),
        (datetime(2024, 3, 1), datetime(2024, 3, 5, 3)),
        (datetime(2024, 3, 1, 23, 59), datetime(2024, 2, 29)),
    ],
)
def test_floor_days(spark, later, earlier):
    days = evaluate(spark, fx.floor_days(fx.moment(later), fx.moment(earlier)))
    assert days == (later - earlier).days


@pytest.mark.parametrize("days, text", [(None, "Never"), (0, "Today"), (1, "Yesterday"), (9, "9 days ago"), (-1, "-1 days ago")])
def test_age_text(spark, days, text):
    value = "CAST(NULL AS INT)" if days is None else str(days)
    assert evaluate(spark, fx.age_text(f"({value})")) == text


@pytest.mark.parametrize("ts", [datetime(2024, 1, 2, 3, 4, 5), datetime(2024, 1, 2, 3, 4, 5, 60), datetime(1969, 1, 1, 0, 0, 0, 5)])
def test_iso_text(spark, ts):
    assert evaluate(spark, fx.iso_text(fx.moment(ts))) == ts.isoformat()
    assert evaluate(spark, fx.weekday_name(fx.moment(ts))) == ts.strftime("%A")


@pytest.mark.parametrize(
    "ratio, tier",
    [(0.0, "none"), (3.0, "none"), (3.0001, "low"), (5.0, "low"), (5.01, "medium"), (10.0, "medium"), (10.01, "high")],
)
def test_skew_tiers(spark, ratio, tier):
    assert evaluate(spark, fx.skew_severity("x", LayoutConfig()), x=ratio) == tier


@pytest.mark.parametrize(
    "ddl, clustered, columns",
    [
        ("CREATE TABLE t (id INT)\nUSING delta\nCLUSTER BY (id, created_at)", True, ["id", "created_at"]),
        ("create table t cluster\n by ( `a b` , \"c\", `d,(``e`, f.`g h` )", True, ["a b", "c", "d,(`e", "f.g h"]),
        ("... CLUSTER BY größe ...", True, ["größe"]),
        ("... CLUSTER BY AUTO", True, ["AUTO"]),
        ("... CLUSTER BY ( )", True, []),
        ("-- we do not CLUSTER BY x here\nCLUSTER BY y", True, ["y"]),
        ("COMMENT 'CLUSTER BY (z)' /* CLUSTER BY\n q */", False, []),
        ("CREATE TABLE t (id INT)", False, []),
        ("PARTITIONED BY (cluster_by(a, b))", False, []),
        (
            "PARTITIONED BY (cluster_by(a, b))\nTBLPROPERTIES (\n  'clusteringColumns' = '[[\"a\"],[\"b\",\"c\"]]')",
            True,
            ["a", "b.c"],
        ),
    ],
)
def test_clustering(spark, ddl, clustered, columns):
    assert evaluate(spark, fx.has_cluster_by("x"), x=ddl) is clustered
    assert evaluate(spark, fx.clustering_columns("x"), x=ddl) == columns


def test_clustering_of_a_table_spark_made(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS probe")
    spark.sql("CREATE TABLE IF NOT EXISTS probe.clustered (a INT, b INT) USING parquet CLUSTER BY (a, b)")
    ddl = spark.sql("SHOW CREATE TABLE probe.clustered").first()[0]
    assert evaluate(spark, fx.clustering_columns("x"), x=ddl) == ["a", "b"]


@pytest.mark.parametrize(
    "text, columns",
    [
        ('["c1","c2"]', ["c1", "c2"]),
        ("[]", []),
        ("", []),
        ("a, 'b' ,\"c\"", ["a", "b", "c"]),
        ("a,,b", ["a", "", "b"]),
        ('[a, "b"', ["a", "b"]),
        ("[a, , b]", ["a", "b"]),
        ('["a"] tail', ["a tail"]),
    ],
)
def test_zorder(spark, text, columns):
    assert evaluate(spark, fx.parse_zorder("x"), x=text) == columns


def test_names_and_paths(spark):
    key = {"catalog": "c", "schema": "s", "table": "we`ird"}
    assert evaluate(spark, fx.full_name(), **key) == "c.s.we`ird"
    assert evaluate(spark, fx.quoted_name(), **key) == "`c`.`s`.`we``ird`"
    assert evaluate(spark, fx.partition_of_path("x"), x="a=1/b=x y/part.parquet") == "a=1/b=x y"
    assert evaluate(spark, fx.partition_of_path("x"), x="part-0=1.parquet") is None
    assert evaluate(spark, fx.file_name("x"), x="/a/b.parquet") == "b.parquet"
    assert evaluate(spark, fx.operation_name("x"), x="merge") == "MERGE"
    assert evaluate(spark, fx.operation_name("x"), x="") == "UNKNOWN"
    assert evaluate(spark, fx.operation_name("CAST(NULL AS STRING)")) == "UNKNOWN"


@pytest.mark.parametrize("value", [3.25, 3.35, 12.05, 0.0])
def test_ratio_text(spark, value):
    assert evaluate(spark, fx.ratio_text("x"), x=value) == f"{value:.1f}"


def test_sql_string_survives_odd_text(spark):
    odd = "it's a \\ back\nslash"
    assert evaluate(spark, fx.sql_string(odd)) == odd


def test_config_checks_its_values():
    for bad in (
        {"scan_mode": "galaxy"},
        {"optimize_stale_days": -1},
        {"skew_low_threshold": 6.0},
        {"small_file_severe_mb": 500},
    ):
        with pytest.raises(ValueError):
            LayoutConfig(**bad)
    config = LayoutConfig(catalog="a", schema="b", table="c", output_catalog="x", output_schema="y", output_table="z")
    assert config.full_table_name() == "a.b.c"
    assert config.output_table_name() == "x.y.z"


def test_numbers_no_size_can_have_are_missing(spark):
    assert evaluate(spark, fx.digits_to_number("x"), x="9" * 29) is None
    assert int(evaluate(spark, fx.digits_to_number("CAST(x AS STRING)"), x=None)) == 0


def test_suggested_names_are_identifiers(spark):
    """Spark's own parser reads the names that statements hold."""
    row = {"catalog": "c a", "schema": "s`b", "table": "t.1"}
    frame = spark.createDataFrame([tuple(row.values())], ", ".join(f"`{k}` STRING" for k in row))
    parser = spark._jsparkSession.sessionState().sqlParser()
    for suffix in ("", "_by_column"):
        name = frame.selectExpr(fx.quoted_name(suffix)).first()[0]
        parts = parser.parseMultipartIdentifier(name)
        assert [parts.apply(i) for i in range(parts.size())] == ["c a", "s`b", "t.1" + suffix]
