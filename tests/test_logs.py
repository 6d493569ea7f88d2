"""Log files of many commits: how many lie on disk at once, and that all are read."""

import os

from pyspark.sql import functions as F

from workload import inputs as I
from workload.queries import logged_commits


def events(spark, folder, ids):
    rows = spark.createDataFrame([(i,) for i in ids], "event_id long").selectExpr(
        "event_id", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, event_id) AS ts", "event_id % 7 AS user_id",
        "element_at(array('view', 'signup', 'purchase', 'error', 'click'), CAST(event_id % 5 AS INT) + 1) AS event_type",
        "CAST(event_id AS DOUBLE) AS value", "'{}' AS props",
    )
    rows.write.parquet(f"{folder}/events.parquet")
    return str(folder)


def files_below(folder):
    return [os.path.join(d, n) for d, _, names in os.walk(folder.removeprefix("file://").removeprefix("file:")) for n in names if n.endswith(".json")]


def test_log_files_lie_on_disk_in_turns(spark, tmp_path, monkeypatch):
    """Every commit has a file, in one turn; few files exist at a time, and none at the end."""
    sf_dir = events(spark, tmp_path / "in", range(1000))
    monkeypatch.setattr(I, "LOG_FILES", 150)
    seen, most = [], 0
    for base, roots in I.written_logs(spark, sf_dir):
        now = files_below(f"{base}/tables")
        assert {r.location for r in roots.collect()} == {f"{base}/tables/src{k}" for k in {int(f.split("/src")[1].split("/")[0]) for f in now}}
        seen, most = seen + now, max(most, len(now))
    assert len(seen) == len(set(seen)) == 1000 and most < 300
    assert not files_below(f"{base}/tables") and not os.path.exists(f"{base.removeprefix('file://')}/lines")


def test_turns_change_no_commit(spark, tmp_path, monkeypatch):
    """Commits of equal table and version share a file, whatever the number of turns."""
    sf_dir = events(spark, tmp_path / "in", [*range(300), *range(40)])
    key = lambda r: tuple(r)
    whole = sorted(map(key, logged_commits(spark, sf_dir).collect()))
    monkeypatch.setattr(I, "LOG_FILES", 100)
    made = []
    monkeypatch.setattr(I, "delete_tables", lambda roots, delete=I.delete_tables: (made.append(roots.count()), delete(roots)))
    assert sorted(map(key, logged_commits(spark, sf_dir).collect())) == whole
    assert len(made) == 4 and sum(r[3] for r in whole) == 300
    empty = spark.read.parquet(f"{sf_dir}/events.parquet").where(F.lit(False))
    empty.write.parquet(str(tmp_path / "none/events.parquet"))
    assert logged_commits(spark, str(tmp_path / "none")).count() == 0
