"""One pass at two grains, maps and latest rows folded by day, and many dates in one plan."""

import random
import re
from datetime import timedelta

import pytest

from helpers import AS_OF, GB, MB, by_table, detail_frame, files_frame, history_frame
from tablevitals import Inventories, LayoutConfig, analyze
from tablevitals import operators as ops
from tablevitals.operators.partitions import partition_measures
from tablevitals.operators.profile import history_totals
from tablevitals.plans import extended_report
from tablevitals.schemas import KEY, TABLE_DDL, TABLE_HISTORY
from workload.queries import QUERIES

CONFIG = LayoutConfig(scan_mode="schema", catalog="c", schema="s")


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_layout_profile_equals_its_two_parts(spark):
    rng = random.Random(5)
    sizes = {f"t{i}": [rng.choice([0, 1, 5000, MB, 40 * MB + rng.randrange(9), GB]) for _ in range(rng.randrange(1, 60))] for i in range(12)}
    parts = {(t, i): rng.choice([None, "p=1", "p=2", f"p={i}"]) for t, values in sizes.items() for i in range(len(values)) if t != "t3"}
    files = files_frame(spark, sizes, parts).repartition(7)
    profile, measures = by_table(ops.file_profile(files, CONFIG)), by_table(partition_measures(ops.partition_sizes(files)))
    both = by_table(ops.layout_profile(files, CONFIG))
    assert set(both) == set(profile)
    for table, row in both.items():
        found = row.asDict()
        assert {c: found[c] for c in profile[table].asDict()} == profile[table].asDict()
        expected = measures[table].asDict() if table in measures else dict.fromkeys(measures["t0"].asDict())
        for column in set(expected) - set(KEY):
            assert found[column] == expected[column], (table, column)


def test_layout_profile_reads_files_once(spark, tmp_path):
    files_frame(spark, {"t": [MB] * 50}).write.parquet(str(tmp_path / "files"))
    text = plan(ops.layout_profile(spark.read.parquet(str(tmp_path / "files")), CONFIG))
    assert text.count("FileScan parquet") == 1
    # Both grains are summed up in the tasks that read the files, before anything is shuffled.
    below = text[text.rindex("Exchange") :]
    assert "partial_sum" in below and below.index("partial_sum") < below.index("Expand")


def test_reports_read_each_inventory_once(spark, sf_dir):
    # Details, DDL texts and files all come from documents here, commits from events.
    assert plan(QUERIES["table_report"](spark, sf_dir)).count("FileScan parquet") == 4
    assert plan(QUERIES["report_history"](spark, sf_dir)).count("FileScan parquet") == 4


def commits(n=400, seed=2):
    rng, rows = random.Random(seed), []
    for version in range(n):
        operation = rng.choice(["WRITE", "OPTIMIZE", "OPTIMIZE", "optimize", "VACUUM END", None, "", "RESTORE"])
        when = None if rng.random() < 0.02 else AS_OF - timedelta(hours=rng.randrange(300))
        parameters = rng.choice([{}, {"zOrderBy": '["a"]'}, {"predicate": "[]", "zOrderBy": ""}, None])
        rows.append((rng.choice("xyz"), version, when, operation, parameters, {}))
    return rows


def test_operations_and_latest_optimizes_equal_plain_python(spark):
    rows = commits()
    found = by_table(history_totals(history_frame(spark, rows).repartition(6)))
    for table in "xyz":
        own = [r for r in rows if r[0] == table]
        names = [(r[3] or "UNKNOWN").upper() for r in own]
        assert found[table].operation_summary == {name: names.count(name) for name in set(names)}
        stated = [r for r in own if (r[3] or "").upper() == "OPTIMIZE" and r[4]]
        stated.sort(key=lambda r: (r[2] is not None, r[2] or AS_OF, r[1]), reverse=True)
        assert [(d.version, d.timestamp, d.parameters) for d in found[table].optimize_details] == [(r[1], r[2], r[4]) for r in stated[:5]]
        assert found[table].total_commits == len(own)


def test_folds_need_one_scan_and_no_sort_of_commits(spark, tmp_path):
    history_frame(spark, commits(50)).write.parquet(str(tmp_path / "history"))
    text = plan(history_totals(spark.read.schema(TABLE_HISTORY).parquet(str(tmp_path / "history"))))
    assert text.count("FileScan parquet") == 1
    assert len(re.findall("Exchange hashpartitioning", text)) == 2


def inventories(spark):
    rows = commits()
    return Inventories(
        detail=detail_frame(spark, *[{"table": t, "sizeInBytes": 20 * GB} for t in ("x", "y", "quiet")]),
        ddl=spark.createDataFrame([], TABLE_DDL),
        files=files_frame(spark, {"x": [MB, GB], "y": [MB]}),
        history=history_frame(spark, rows),
    )


def test_many_dates_equal_many_analyses(spark):
    dates = [AS_OF, AS_OF + timedelta(days=40, seconds=1), AS_OF - timedelta(days=3)]
    inputs = inventories(spark)
    together = {(r["table"], r.analysis_timestamp): r for r in analyze(inputs, CONFIG, dates).report.collect()}
    apart = {(r["table"], r.analysis_timestamp): r for d in dates for r in analyze(inputs, CONFIG, d).report.collect()}
    assert together == apart and len(together) == 9
    assert len({r.optimize_status for r in together.values()}) > 2
    assert analyze(inputs, CONFIG, dates + dates).report.count() == 9
    with pytest.raises(ValueError):
        analyze(inputs, CONFIG, [])


def test_extended_report_has_operations_and_optimizes(spark):
    rows = by_table(extended_report(analyze(inventories(spark), CONFIG, AS_OF).tables))
    assert len(rows["x"].optimize_details) == 5 and sum(rows["x"].operation_summary.values()) == rows["x"].total_commits
    assert (rows["quiet"].operation_summary, rows["quiet"].optimize_details, rows["quiet"].history_available) == ({}, [], False)
    ages = {c: rows["x"][c] for c in rows["x"].asDict() if c.startswith("days_since")}
    assert set(ages) == {"days_since_last_write", "days_since_last_optimize", "days_since_last_vacuum"}
