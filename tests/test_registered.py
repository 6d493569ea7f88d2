"""Every registered query against its SQL, and the shape of its plan."""

import os
import re
import subprocess
import sys

import pytest

import __spark_entry__ as entry_file
from compare import connect, differences
from workload.oracle import ORACLE
from workload.queries import QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry_file.queries())
    assert ORACLE.items() <= entry_file.oracle_sql().items()


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_its_sql(spark, con, sf_dir, name):
    assert differences(QUERIES[name](spark, sf_dir), con, ORACLE[name]) == []


def test_entry(spark):
    assert entry_file.entry(spark).count() == 20


def test_entry_works_without_what_the_optional_part_imports():
    """The core queries are there when a module the other part needs cannot be imported."""
    code = (
        "import sys, warnings; warnings.simplefilter('ignore'); sys.modules['xxhash'] = None; "
        "import __spark_entry__ as e; from workload.queries import QUERIES as q; assert set(e.queries()) == set(q) == set(e.oracle_sql())"
    )
    root = os.path.dirname(os.path.abspath(entry_file.__file__))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)


def test_fixtures_take_the_rare_branches(spark, sf_dir):
    rows = {r["table"]: r for r in QUERIES["table_defaults"](spark, sf_dir).collect()}
    assert {r.layout_source for r in rows.values()} == {"none", "detail", "listing"}
    assert (rows["src0"].total_files, rows["src0"].avg_file_size_mb, rows["src0"].optimize_status) == (0, 0.0, "Never run")
    assert rows["src1"].partition_sizes_estimated and rows["src1"].partition_skew_ratio == 1.0
    assert "NO_ZORDER" in rows["src2"].issue_ids and rows["src3"].history_available
    failed = {r["table"]: r for r in QUERIES["source_failures"](spark, sf_dir).collect()}
    assert failed["src2"].history_error and "OPTIMIZE_NEVER_RUN" not in failed["src2"].issue_ids
    assert failed["src10"].ddl_error and failed["src3"].listing_error


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", QUERIES)
def test_plan_stays_on_the_jvm_without_pair_joins(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    for node in ("Python", "Pandas", "CartesianProduct", "NestedLoop"):
        assert node not in text


def test_history_is_folded_before_the_shuffle(spark, sf_dir):
    text = plan(QUERIES["maintenance_status"](spark, sf_dir))
    assert re.search(r"HashAggregate[\s\S]*Exchange[\s\S]*HashAggregate.*partial_", text)
    assert "Window" not in text and text.count("Exchange") == 1


def test_scans_read_only_what_they_need(spark, sf_dir):
    text = plan(QUERIES["file_layout"](spark, sf_dir))
    assert re.findall(r"ReadSchema: struct<([^>]*)>", text) == ["source:string,n_chars:bigint"]


def test_file_statistics_shuffle_by_table_and_size_first(spark, sf_dir):
    text = plan(QUERIES["file_layout"](spark, sf_dir))
    shuffles = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", text)
    assert len(shuffles) == 2
    assert len(shuffles[1].split(",")) == len(shuffles[0].split(",")) + 1
