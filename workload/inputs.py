"""Inventories of a make-believe fleet, projected from the supplied tables.

Twenty tables src0 .. src19, numbered k, by ``documents.source`` (or by
``user_id % 20`` and ``l_suppkey % 20``). Every projection reads its whole table
and stays lazy, so pruning and pushdown reach the scan.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablevitals import Inventories, LayoutConfig
from tablevitals.schemas import KEY
from tablevitals.sources import Scratch
from tablevitals.sources.walk import spread_paths

AS_OF = datetime(2024, 2, 15)
CONFIG = LayoutConfig(scan_mode="schema", catalog="lake", schema="main", partition_skew_threshold=3.0)
COUNT_CONFIG = LayoutConfig(
    scan_mode="schema", catalog="lake", schema="main", max_partition_count=2700
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _key(table: str) -> tuple[str, str, str]:
    return "'lake' AS catalog", "'main' AS schema", f"{table} AS `table`"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files_of(_table(spark, sf_dir, "documents"))


def files_of(documents: DataFrame) -> DataFrame:
    rows = documents.selectExpr("*", "CAST(substring(source, 4) AS INT) % 4 AS style")
    return rows.selectExpr(
        *_key("source"),
        "CAST(doc_id AS STRING) AS path",
        "CAST(doc_id AS STRING) AS name",
        "lang AS partition",
        """CASE style WHEN 0 THEN n_chars * 8000 WHEN 1 THEN n_chars * 60000
           WHEN 2 THEN 400000000 + n_chars * 20000 ELSE 60000000 + n_chars * 60000 END AS size_bytes""",
        "CAST(NULL AS TIMESTAMP) AS modification_time",
    )


def detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detail_of(files(spark, sf_dir))


def detail_of(files: DataFrame) -> DataFrame:
    sums = files.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("numFiles"), F.sum("size_bytes").alias("bytes")
    )
    return sums.selectExpr("*", "CAST(substring(`table`, 4) AS INT) AS k").selectExpr(
        *KEY,
        "CASE WHEN k = 19 THEN 'iceberg' ELSE 'delta' END AS format",
        "concat('/lake/main/', `table`) AS location",
        "bytes * element_at(array(1L, 4L, 16L, 64L, 256L), k % 5 + 1) AS sizeInBytes",
        "numFiles",
        "CASE WHEN k % 2 = 0 THEN array('lang') ELSE CAST(array() AS ARRAY<STRING>) END AS partitionColumns",
        "CAST(NULL AS TIMESTAMP) AS createdAt",
        "CAST(NULL AS TIMESTAMP) AS lastModified",
        "CAST(map() AS MAP<STRING, STRING>) AS properties",
        "1 AS minReaderVersion",
        "2 AS minWriterVersion",
    )


def ddl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ddl_of(_table(spark, sf_dir, "documents"))


def ddl_of(documents: DataFrame) -> DataFrame:
    sources = documents.select("source").distinct()
    return sources.selectExpr(
        *_key("source"),
        r"""concat('CREATE TABLE lake.main.', source, ' (a INT) USING delta',
            CASE CAST(substring(source, 4) AS INT) % 3 WHEN 0 THEN '\nCLUSTER BY (`a`, b)'
            WHEN 1 THEN '\ncluster  by c' ELSE '' END) AS ddl""",
    )


def partition_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A partition inventory with thousands of partitions per table."""
    return _table(spark, sf_dir, "lineitem").selectExpr(
        *_key("concat('src', l_suppkey % 20)"),
        "CAST(l_orderkey AS STRING) AS partition",
        "floor(l_extendedprice) * 1000 AS size_bytes",
    )


def count_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detail rows for the tables of ``partition_rows``, all partitioned."""
    sums = partition_rows(spark, sf_dir).groupBy(*KEY).agg(F.sum("size_bytes").alias("sizeInBytes"))
    return sums.selectExpr(*KEY, "'delta' AS format", "sizeInBytes", "array('orderkey') AS partitionColumns")


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").selectExpr("*", "user_id % 20 AS k")
    # Some tables are never optimized or vacuumed, some no longer: those commits are writes.
    kinds = events.selectExpr(
        "*",
        """CASE WHEN event_type = 'purchase' AND k IN (0, 7) OR event_type = 'error' AND k IN (3, 7)
             OR event_type IN ('purchase', 'error') AND k IN (1, 5, 9) AND ts >= TIMESTAMP_NTZ '2024-01-06 00:00:00'
           THEN 'view' ELSE event_type END AS kind""",
    )
    return kinds.selectExpr(
        *_key("concat('src', k)"),
        "event_id AS version",
        "CAST(ts AS TIMESTAMP) AS timestamp",
        """CASE WHEN kind = 'view' THEN 'WRITE' WHEN kind = 'signup' THEN 'MERGE'
           WHEN kind = 'purchase' THEN 'OPTIMIZE'
           WHEN kind = 'error' THEN if(event_id % 2 = 0, 'VACUUM START', 'VACUUM END')
           ELSE if(event_id % 2 = 0, 'DELETE', 'STREAMING UPDATE') END AS operation""",
        """CASE WHEN kind = 'purchase' THEN map('zOrderBy', CASE event_id % 3
             WHEN 0 THEN '["c1","c2"]' WHEN 1 THEN '[]' ELSE 'c3, c4' END,
             'predicate', if(event_id % 7 = 0, '["a = 1"]', ''))
           ELSE CAST(map() AS MAP<STRING, STRING>) END AS operationParameters""",
        """CASE event_id % 10 WHEN 0 THEN map('numFiles', '1') WHEN 5 THEN map('numOutputBytes', 'n/a')
           WHEN 7 THEN CAST(map() AS MAP<STRING, STRING>)
           WHEN 3 THEN map('numOutputBytes', '', 'numAddedBytes', CAST(floor(value * 1000000) AS STRING))
           ELSE map('numOutputBytes', CAST(floor(value * 1000000) AS STRING)) END AS operationMetrics""",
    )


_NUMBER = "CAST(substring({}, 4) AS INT)"
_K = _NUMBER.format("`table`")


def failing(spark: SparkSession, sf_dir: str) -> Inventories:
    """The fleet where some directories, commit logs and DDL texts could not be read."""
    documents = _table(spark, sf_dir, "documents").withColumn("k", F.expr(_NUMBER.format("source")))
    listed = files_of(documents.filter("NOT (k % 7 = 3 AND doc_id % 3 = 0)"))
    unlisted = documents.filter("k % 7 = 3 AND doc_id % 3 = 0").select("source", "lang").distinct()
    directories = unlisted.selectExpr(
        *_key("source"), "'listing' AS step", "concat('/lake/main/', source, '/lang=', lang, '/b=0') AS path",
        "'PermissionError: denied' AS error",
    )
    logs = documents.filter("k % 5 = 2").select("source").distinct().selectExpr(
        *_key("source"), "'history' AS step", "concat('/lake/main/', source, '/_delta_log') AS path",
        "'FileNotFoundError: no such directory' AS error",
    )
    failed = f"{_K} % 6 = 4"
    texts = ddl_of(documents).selectExpr(
        *KEY, f"CASE WHEN NOT {failed} THEN ddl END AS ddl", f"CASE WHEN {failed} THEN 'command failed' END AS error"
    )
    return Inventories(
        detail=detail_of(files_of(documents)),
        ddl=texts,
        files=listed,
        history=history(spark, sf_dir).filter(f"{_K} % 5 <> 2"),
        failures=directories.unionByName(logs),
    )


def sparse(spark: SparkSession, sf_dir: str) -> Inventories:
    """The fleet with little known of most tables.

    By k % 4: tables without files (0), never listed but with a partition count (1), large ones without
    history (2), and ordinary ones (3). Only those of 1 and 3 have a DDL text, only those of 3 commits.
    """
    documents = _table(spark, sf_dir, "documents").withColumn("k", F.expr(_NUMBER.format("source")))
    described = detail_of(files_of(documents)).withColumns(
        {
            "numFiles": F.expr(f"CASE WHEN {_K} % 4 = 0 THEN 0L ELSE numFiles END"),
            "sizeInBytes": F.expr(
                f"CASE {_K} % 4 WHEN 0 THEN 0L WHEN 2 THEN 600 * 1073741824L + sizeInBytes ELSE sizeInBytes END"
            ),
            "partitionColumns": F.expr(
                f"CASE WHEN {_K} % 4 = 1 THEN array('lang') ELSE CAST(array() AS ARRAY<STRING>) END"
            ),
        }
    )
    counts = documents.filter("k % 4 = 1").groupBy("source").agg(F.count_distinct("lang").alias("partition_count"))
    return Inventories(
        detail=described,
        ddl=ddl_of(documents.filter("k % 2 = 1")),
        files=files_of(documents.filter("k % 4 <> 1")),
        history=history(spark, sf_dir).filter(f"{_K} % 4 = 3"),
        partition_counts=counts.selectExpr(*_key("source"), "partition_count"),
    )


def nested_roots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Files without owners, and table roots of which every other one lies inside the one before."""
    documents = _table(spark, sf_dir, "documents").withColumn("k", F.expr(_NUMBER.format("source")))
    outer = "concat('/lake/main/src', k - k % 2)"
    inner = f"concat({outer}, '/nested/', source)"
    folder = f"CASE WHEN k = 19 THEN '/elsewhere' WHEN k % 2 = 0 OR doc_id % 5 = 0 THEN {outer} ELSE {inner} END"
    paths = documents.selectExpr(
        "doc_id", f"concat(if(doc_id % 2 = 0, 'file://', 'file:'), {folder}, '/lang=', lang, '/', doc_id, '.parquet') AS path"
    )
    roots = documents.select("source", "k").distinct().selectExpr(
        *_key("source"), f"concat(CASE WHEN k % 2 = 0 THEN {outer} ELSE {inner} END, '/') AS location"
    )
    return paths, roots


def _lake(spark: SparkSession) -> str:
    """A new folder that executors share; a temporary one only where a local session names none."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='lake-')}"
    base = base if ":" in base else f"file://{base}"
    return f"{base.rstrip('/')}/lake-{uuid.uuid4().hex}"


def written_tables(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """The documents as partitioned tables on disk, one per source: their folder, and their roots."""
    folder = _lake(spark)
    documents = _table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    documents.repartition("source", "lang").write.partitionBy("source", "lang").parquet(f"{folder}/tables")
    roots = documents.select("source").distinct()
    return folder, roots.selectExpr(*_key("source"), f"concat('{folder}/tables/source=', source) AS location")


#: Log files that lie on disk at one time. Each takes an inode and a block, and a disk has fewer than a large fleet has commits.
LOG_FILES = 250_000


def written_logs(spark: SparkSession, sf_dir: str) -> Iterator[tuple[str, DataFrame]]:
    """The commits as log files on disk, one per commit, in turns: their folder, and the roots of a turn's tables.

    Files are dealt out by their path, about LOG_FILES a turn, so equal ones share a turn. They are to be read
    before the next turn is asked for: a turn's files are deleted then.
    """
    folder = _lake(spark)
    info = "struct(unix_millis(timestamp) AS timestamp, operation, operationParameters, operationMetrics)"
    commits = history(spark, sf_dir).selectExpr(
        *KEY,
        f"concat('{folder}/tables/', `table`, '/_delta_log/', lpad(CAST(version AS STRING), 20, '0'), '.json') AS path",
        f"to_json(struct({info} AS commitInfo)) AS line",
    )
    turns = max(1, -(-commits.count() // LOG_FILES))
    lines = commits.withColumn("turn", F.pmod(F.xxhash64(F.expr(f"substr(path, {len(folder) + 1})")), F.lit(turns)))
    lines.write.partitionBy("turn").parquet(f"{folder}/lines")  # once, not once a turn
    lines = spark.read.schema(lines.schema).parquet(f"{folder}/lines")

    def write(batches):
        from pyarrow import fs

        (system, base), made = fs.FileSystem.from_uri(folder), set()
        for batch in batches:
            for path, line in zip(batch["path"], batch["line"]):
                place = base + path[len(folder) :]
                log = place.rpartition("/")[0]
                if log not in made:
                    system.create_dir(log, recursive=True)
                    made.add(log)
                with system.open_output_stream(place) as out:
                    out.write(line.encode() + b"\n")
            yield batch[["path"]]

    for turn in range(turns):
        own = lines.filter(F.col("turn") == turn)
        # Dealt over all cores, however few row groups hold the events.
        files = spread_paths(own.select("path", "line")).mapInPandas(write, "path STRING")
        files.write.format("noop").mode("overwrite").save()
        roots = own.select(*KEY).distinct().selectExpr(*KEY, f"concat('{folder}/tables/', `table`) AS location")
        yield folder, roots
        delete_tables(roots)
        Scratch(spark, base=f"{folder}/tables").close()
    Scratch(spark, base=f"{folder}/lines").close()


def delete_tables(roots: DataFrame) -> None:
    """Delete the folders of tables, each by one task: millions of files are many calls."""

    def delete(batches):
        from pyarrow import fs

        for batch in batches:
            for location in batch["path"]:
                system, place = fs.FileSystem.from_uri(location)
                system.delete_dir(place)
            yield batch[["path"]]

    places = roots.selectExpr("location AS path")
    spread_paths(places).mapInPandas(delete, "path STRING").write.format("noop").mode("overwrite").save()


def inventories(spark: SparkSession, sf_dir: str) -> Inventories:
    documents = _table(spark, sf_dir, "documents")
    listed = files_of(documents)
    return Inventories(
        detail=detail_of(listed),
        ddl=ddl_of(documents),
        files=listed,
        history=history(spark, sf_dir),
    )
