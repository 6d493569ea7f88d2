"""Decontamination over a large benchmark, and texts with many passages: what its steps hold in memory."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tablevitals.llm import decontamination

ITEM = "item_id long, text string"


def sentence(rng, n=24):
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))


@pytest.fixture(autouse=True)
def small_broadcasts(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100k")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_index_of_a_large_benchmark_is_not_broadcast(spark):
    """Forty items have 11,840 rows in the index; their files alone are under the limit."""
    rng = random.Random(1)
    items = [(i, sentence(rng)) for i in range(40)]
    docs = spark.createDataFrame([(i, f"{sentence(rng)} {t} {sentence(rng)}") for i, t in items], "doc_id long, text string")
    rows = decontamination.matches(docs, spark.createDataFrame(items, ITEM))
    assert sorted((r.doc_id, r.item_id, r.start) for r in rows.collect()) == [(i, i, 24) for i, _ in items]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    final = plan[: plan.index("== Initial Plan ==")]
    assert not re.search(r"BroadcastHashJoin \[length#", final)
    assert re.search(r"SortMergeJoin \[length#", final)


def test_items_of_equal_words_are_indexed_once(spark):
    rng = random.Random(2)
    text, other = sentence(rng), sentence(rng)
    rows = [(i, text if i % 2 else text.upper()) for i in range(300)] + [(7, text), (None, text), (None, text), (7, other), (8, ""), (9, None)]
    benchmark = spark.createDataFrame(rows, ITEM)
    assert decontamination.items_of(benchmark).count() == 2
    docs = spark.createDataFrame([(1, f"before {text} after"), (2, f"{other} {text}"), (None, text), (3, "none of it")], "doc_id long, text string")
    found = sorted((r.doc_id, -1 if r.item_id is None else r.item_id, r.start) for r in decontamination.matches(docs, benchmark).collect())
    assert found == sorted([(1, i, 1) for i in (-1, *range(300))] + [(2, i, 24) for i in (-1, *range(300))] + [(2, 7, 0)])
    assert sorted(r.doc_id for r in decontamination.kept(docs, benchmark).collect()) == [3]


def test_rows_of_windows_hold_no_text(spark):
    """A text of 60 passages has hundreds of windows; each holds its own words only, at both ends of the text too."""
    rng = random.Random(3)
    items = [(i, sentence(rng)) for i in range(60)] + [(60, "one two three")]
    text = " ".join(t for _, t in items)
    docs = spark.createDataFrame([(1, text), (1, "one two"), (2, "one two three")], "doc_id long, text string")
    listed = decontamination.items_of(spark.createDataFrame(items, ITEM)).localCheckpoint()
    windows = decontamination.windows_of(docs, "doc_id", decontamination.anchors(docs, "doc_id", listed).localCheckpoint())
    generated = re.findall(r"Generate explode\(.*", windows._jdf.queryExecution().optimizedPlan().toString())
    assert generated and not any("words" in line.split("], ")[-1] or "text" in line for line in generated)
    own = text.split()
    hashes = {n: [r.h for r in spark.createDataFrame([(own,)], "words array<string>").select(F.explode(F.expr(decontamination.shingle_hashes("words", str(n)))).alias("h")).collect()] for n in (3, 5)}
    rows = [r for r in windows.collect() if len(r.own) > 0 and r.doc_id == 1 and r.length == 24]
    assert len(rows) > 600 and min(r.start for r in rows) < 0 and max(r.start + r.length for r in rows) > len(own)
    for r in rows:
        first, last = max(r.start, 0), min(r.start + r.length, len(own))
        assert list(r.own) in (hashes[5][first : last - 4], []), r
    assert [(r.start, list(r.own) == [hashes[3][-1]]) for r in windows.where("doc_id = 2").collect()] == [(0, True)]
    assert {(r.doc_id, r.item_id) for r in decontamination.matches(docs, spark.createDataFrame(items, ITEM)).collect()} == {(1, i) for i in range(61)} | {(2, 60)}
