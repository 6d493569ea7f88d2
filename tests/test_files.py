import random
import statistics

import pytest

from helpers import MB, by_table, detail_frame, files_frame
from tablevitals import LayoutConfig
from tablevitals import operators as ops
from tablevitals.operators.sizes import size_histogram, size_summary

CONFIG = LayoutConfig()


def brute_force(sizes):
    """The definitions, over plain Python lists."""
    rounded = [round(s / MB, 2) if s else 0.0 for s in sizes]
    n, median, mean = len(sizes), statistics.median(rounded), statistics.mean(rounded)
    deviation = statistics.stdev(rounded) if n > 1 else 0.0
    ratio = max(rounded) / median if n > 1 and median > 0 else 0
    limits = ((3, "none"), (5, "low"), (10, "medium"))
    out = {
        "total_files": n,
        "total_size_bytes": sum(sizes),
        "avg_file_size_bytes": sum(sizes) / n,
        "avg_file_size_mb": round(mean, 2),
        "median_file_size_mb": round(median, 2),
        "min_file_size_mb": round(min(rounded), 2),
        "max_file_size_mb": round(max(rounded), 2),
        "std_dev_mb": round(deviation, 2),
        "file_skew_ratio": round(ratio, 2),
        "has_file_skew": ratio > 10,
        "file_skew_severity": next((name for limit, name in limits if ratio <= limit), "high"),
        "coefficient_of_variation": round(deviation / mean * 100, 2) if n > 1 and mean > 0 else 0.0,
    }
    for name, test in (
        ("severe_small_files", lambda s: s < 32 * MB),
        ("small_files", lambda s: s < 128 * MB),
        ("optimal_files", lambda s: 512 * MB <= s <= 1024 * MB),
    ):
        count = sum(map(test, sizes))
        out[f"{name}_count"] = count
        out[f"{name}_pct"] = round(100 * count / n, 2)
    return out


def random_fleet():
    rng = random.Random(7)
    fleet = {
        f"t{i}": [int(rng.lognormvariate(rng.uniform(8, 20), rng.uniform(0.1, 2))) for _ in range(rng.randint(1, 60))]
        for i in range(40)
    }
    fleet["one"] = [5 * MB]
    fleet["tiny"] = [1, 2, 3]
    fleet["zero"] = [0, 0]
    fleet["edges"] = [32 * MB, 32 * MB - 1, 128 * MB, 128 * MB - 1, 512 * MB, 1024 * MB, 1024 * MB + 1]
    fleet["tie"] = [131072, 131072, 393216]
    fleet["pair"] = [round(17.06 * MB), round(17.07 * MB)]
    fleet["golden"] = [46804904, 44643673, 52425955, 50607679, 54610255, 51097757]
    return fleet


def test_profile_equals_brute_force(spark):
    fleet = random_fleet()
    found = by_table(ops.file_profile(files_frame(spark, fleet), CONFIG))
    assert set(found) == set(fleet)
    for table, sizes in fleet.items():
        expected = brute_force(sizes)
        assert {name: found[table][name] for name in expected} == expected, table


def test_published_example(spark):
    sizes = [46804904, 44643673, 52425955, 50607679, 54610255, 51097757]
    row = ops.file_skew(files_frame(spark, {"t": sizes}), CONFIG).first()
    assert (row.file_skew_ratio, row.file_skew_severity) == (1.07, "none")


def test_one_file_has_no_skew(spark):
    row = ops.file_skew(files_frame(spark, {"t": [MB]}), CONFIG).first()
    assert (row.file_skew_ratio, row.file_skew_severity, row.skew_error) == (0.0, "none", "fewer than two files")


@pytest.mark.parametrize(
    "largest, severity", [(300, "none"), (301, "low"), (500, "low"), (501, "medium"), (1000, "medium"), (1001, "high")]
)
def test_skew_boundaries(spark, largest, severity):
    sizes = [100 * MB] * 3 + [largest * MB]
    row = ops.file_skew(files_frame(spark, {"t": sizes}), CONFIG).first()
    assert row.file_skew_severity == severity


def test_result_does_not_depend_on_partitioning(spark):
    files = files_frame(spark, random_fleet())
    results = [
        sorted(map(str, ops.file_profile(files.repartition(n), CONFIG).collect())) for n in (1, 3, 17)
    ]
    assert results[0] == results[1] == results[2]


def test_histogram_rows_stay_within_their_bound(spark):
    """The k smallest distinct sizes add up to k*k/200 MB, so k <= sqrt(200 * MB) + 1."""
    sizes = [int(i * 0.01 * MB) + 1 for i in range(3000)]
    histogram = size_histogram(files_frame(spark, {"t": sizes * 2}))
    total_mb = 2 * sum(sizes) / MB
    assert histogram.count() <= (200 * total_mb) ** 0.5 + 1
    assert size_summary(histogram).first().n == 6000


def test_percentile_by_floor_index(spark):
    fleet = random_fleet()
    files = files_frame(spark, fleet)
    for p in (0, 25, 50, 95, 100):
        found = by_table(ops.floor_percentile(files, p))
        for table, sizes in fleet.items():
            ordered = sorted(round(s / MB, 2) for s in sizes)
            expected = ordered[min(int(len(ordered) * p / 100), len(ordered) - 1)]
            assert found[table].percentile_mb == expected, (table, p)


def test_layout_falls_back_to_detail_averages(spark):
    detail = ops.table_detail(
        detail_frame(
            spark,
            {"table": "listed", "numFiles": 9, "sizeInBytes": 9000},
            {"table": "small", "numFiles": 3, "sizeInBytes": 100 * MB},
            {"table": "severe", "numFiles": 4, "sizeInBytes": 4 * MB},
            {"table": "large", "numFiles": 1, "sizeInBytes": 128 * MB},
            {"table": "no_files", "numFiles": 0},
            {"table": "no_location", "location": None},
            {"table": "empty_but_listed", "numFiles": 0},
        )
    )
    files = files_frame(spark, {"listed": [MB, 3 * MB], "empty_but_listed": [MB], "no_location": [MB]})
    rows = by_table(ops.layout_with_fallback(detail, ops.file_profile(files, CONFIG), CONFIG))
    assert {t: r.layout_source for t, r in rows.items()} == {
        "listed": "listing",
        "small": "detail",
        "severe": "detail",
        "large": "detail",
        "no_files": "none",
        "no_location": "none",
        "empty_but_listed": "none",
    }
    assert (rows["listed"].total_files, rows["listed"].avg_file_size_mb) == (2, 2.0)
    small = rows["small"]
    assert (small.avg_file_size_mb, small.median_file_size_mb, small.max_file_size_mb) == (33.33, 33.33, 0.0)
    assert (small.small_files_pct, small.severe_small_files_pct, small.small_files_count) == (100.0, 0.0, 0)
    assert (rows["severe"].small_files_pct, rows["severe"].severe_small_files_pct) == (100.0, 100.0)
    assert (rows["large"].small_files_pct, rows["large"].file_skew_severity) == (0.0, "none")
    assert (rows["no_files"].avg_file_size_mb, rows["no_location"].total_files) == (0.0, 0)


def test_rounding_ties_of_small_tables(spark):
    """Means and medians of few files often lie on a tie of the 2-decimal rounding."""
    rng = random.Random(11)
    fleet = {
        f"t{i}": [rng.randint(0, 300 * 2 ** rng.randint(10, 22)) for _ in range(rng.choice([1, 2, 2, 2, 4, 5, 8]))]
        for i in range(3000)
    }
    found = by_table(ops.file_profile(files_frame(spark, fleet), CONFIG))
    wrong = {}
    for table, sizes in fleet.items():
        expected = brute_force(sizes)
        actual = {name: found[table][name] for name in expected}
        if actual != expected:
            wrong[table] = {n: (actual[n], expected[n]) for n in expected if actual[n] != expected[n]}
    assert wrong == {}
