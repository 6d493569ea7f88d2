"""Thin adapters over catalog commands.

Listing tables and describing one table are driver commands by nature: each
returns a few rows per table. The adapters only run them, a few at a time, and write
their results below the scratch folder in batches, so the driver holds one batch whatever
the number of tables. Failures become rows with an ``error``.
"""

from __future__ import annotations

import logging
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from itertools import islice

from py4j.protocol import Py4JError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import LayoutConfig
from ..schemas import FAILURES, KEY, TABLE_DDL, TABLE_DETAIL, TABLE_HISTORY
from .collected import Collected, failures_of, no_failures
from .scratch import scratch_folder

log = logging.getLogger(__name__)

# What a failing command or write may raise; some Java errors come unconverted.
ERRORS = (PySparkException, Py4JError)

# Results of commands that the driver holds at once.
BATCH_ROWS = 1000

Runner = Callable[[str], DataFrame]

TABLES = T.StructType([T.StructField(name, T.StringType(), True) for name in KEY])


def quoted(*parts: str) -> str:
    return ".".join("`" + part.replace("`", "``") + "`" for part in parts)


def _no_tables(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], TABLES)


def _untold(spark: SparkSession, catalog: str, schema: str | None, error: Exception) -> DataFrame:
    """The failure to list a schema, or the schemas of a catalog: it belongs to no table."""
    return spark.createDataFrame([(catalog, schema, None, "discovery", None, str(error))], FAILURES)


def _shown(spark: SparkSession, catalog: str, schema: str) -> Collected:
    try:
        shown = spark.sql(f"SHOW TABLES IN {quoted(catalog, schema)}")
    except ERRORS as e:
        log.error("cannot list tables of %s.%s: %s", catalog, schema, e)
        return Collected(_no_tables(spark), _untold(spark, catalog, schema, e))
    rows = shown.filter("NOT isTemporary").select(
        F.lit(catalog).alias("catalog"), F.lit(schema).alias("schema"), F.col("tableName").alias("table")
    )
    return Collected(rows, no_failures(spark))


def tables_in_schema(spark: SparkSession, catalog: str, schema: str) -> DataFrame:
    """Keys of the tables of a schema; none, with a log entry, when it cannot be listed."""
    return _shown(spark, catalog, schema).rows


def _shown_everywhere(spark: SparkSession, catalog: str) -> Collected:
    try:
        shown = spark.sql(f"SHOW SCHEMAS IN {quoted(catalog)}")
    except ERRORS as e:
        log.error("cannot list schemas of %s: %s", catalog, e)
        return Collected(_no_tables(spark), _untold(spark, catalog, None, e))
    # The name is the first column: it is called namespace or databaseName.
    names = [row[0] for row in shown.toLocalIterator()]
    listed = [_shown(spark, catalog, name) for name in names if name.lower() != "information_schema"]
    return Collected(
        reduce(DataFrame.unionByName, (found.rows for found in listed), _no_tables(spark)),
        reduce(DataFrame.unionByName, (found.failures for found in listed), no_failures(spark)),
    )


def tables_in_catalog(spark: SparkSession, catalog: str) -> DataFrame:
    """Keys of the tables of every schema but ``information_schema``."""
    return _shown_everywhere(spark, catalog).rows


def discover(spark: SparkSession, config: LayoutConfig) -> Collected:
    """Keys of the tables in the configured scope, and the schemas that could not be listed."""
    if config.scan_mode == "catalog":
        return _shown_everywhere(spark, config.catalog)
    if config.scan_mode == "schema":
        return _shown(spark, config.catalog, config.schema)
    if not config.table:
        raise ValueError("single_table scope needs a table name")
    only = spark.createDataFrame([(config.catalog, config.schema, config.table)], TABLES)
    return Collected(only, no_failures(spark))


def discover_tables(spark: SparkSession, config: LayoutConfig) -> DataFrame:
    """The rows of ``discover`` alone."""
    return discover(spark, config).rows


def _per_table(
    spark: SparkSession,
    tables: DataFrame,
    read: Callable[[Row], dict],
    schema: T.StructType,
    workers: int,
    scratch: str | None = None,
    beside: tuple[str, ...] = (),
) -> DataFrame:
    """Run a command per table on a few driver threads; errors become rows.

    ``read`` gets a table's key, and the columns named in ``beside``.

    Results are written in batches of BATCH_ROWS, and the next batch is only begun
    when the last one is written.
    """

    def attempt(key: Row) -> tuple:
        try:
            found = read(key)
        except ERRORS as e:
            found = {"error": str(e)}
        found = {**dict(zip(KEY, key)), **found}
        return tuple(found.get(name) for name in schema.names)

    folder = scratch or scratch_folder(spark, "commands")
    keys: Iterator[Row] = tables.select(*KEY, *beside).toLocalIterator()
    with ThreadPoolExecutor(workers) as pool:
        while batch := list(islice(keys, BATCH_ROWS)):
            rows = spark.createDataFrame(list(pool.map(attempt, batch)), schema)
            rows.coalesce(1).write.mode("append").parquet(folder)
    try:
        return spark.read.schema(schema).parquet(folder)
    except AnalysisException:  # nothing was written: there are no tables
        return spark.createDataFrame([], schema)


def collect_details(
    spark: SparkSession, tables: DataFrame, run: Runner | None = None, workers: int = 8, scratch: str | None = None
) -> DataFrame:
    """Table detail of each key: one small row per table."""
    run = run or spark.sql

    def read(key: Row) -> dict:
        row = run(f"DESCRIBE DETAIL {quoted(*key)}").first()
        if row is None:
            return {"error": "no detail row"}
        # The command may have columns of its own, and lack some of ours.
        return {n: v for n, v in row.asDict().items() if n in TABLE_DETAIL.names and n not in KEY}

    return _per_table(spark, tables, read, TABLE_DETAIL, workers, scratch)


def collect_ddl(
    spark: SparkSession, tables: DataFrame, run: Runner | None = None, workers: int = 8, scratch: str | None = None
) -> DataFrame:
    """CREATE TABLE text of each key; a command without a result is a failure."""
    run = run or spark.sql

    def read(key: Row) -> dict:
        row = run(f"SHOW CREATE TABLE {quoted(*key)}").first()
        return {"ddl": row[0]} if row else {"error": "no CREATE TABLE text"}

    return _per_table(spark, tables, read, TABLE_DDL, workers, scratch)


def partition_counts(
    spark: SparkSession, detail: DataFrame, run: Runner | None = None, workers: int = 8, scratch: str | None = None
) -> DataFrame:
    """Partition count of each partitioned table from SHOW PARTITIONS.

    Where the command does not work, distinct partition values are counted in the
    table's data: the one read of table data, a distributed aggregation. Where that fails
    too, the row has an ``error`` and no count.
    """
    from ..operators import partition_count_from_data

    run = run or spark.sql
    schema = T.StructType(
        [*TABLES.fields, T.StructField("partition_count", T.LongType()), T.StructField("error", T.StringType())]
    )

    def read(key: Row) -> dict:
        name = quoted(*key[: len(KEY)])
        try:
            return {"partition_count": run(f"SHOW PARTITIONS {name}").count()}
        except ERRORS:
            data = run(f"SELECT * FROM {name}")
            return partition_count_from_data(data, key["partitionColumns"]).first().asDict()

    partitioned = detail.filter("size(partitionColumns) > 0")
    return _per_table(spark, partitioned, read, schema, workers, scratch, beside=("partitionColumns",))


def history_of_table(
    spark: SparkSession, key: tuple[str, str, str], run: Runner | None = None
) -> DataFrame:
    """Commits of one table from the history command, newest first.

    For many tables use ``commit_history``, which reads commit logs in one job.
    """
    run = run or spark.sql
    rows = run(f"DESCRIBE HISTORY {quoted(*key)}")
    keyed = rows.withColumns({name: F.lit(value) for name, value in zip(KEY, key)})
    return keyed.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in TABLE_HISTORY.fields])


def command_history(
    spark: SparkSession,
    tables: DataFrame,
    scratch: str | None = None,
    run: Runner | None = None,
    workers: int = 8,
) -> Collected:
    """Commits of many tables from the history command, for logs that cannot be read.

    Each table's result, with every commit, is written below the
    scratch folder as it comes, so the driver never holds more than a few of them.
    A table whose command fails is a failure.
    """
    folder = scratch or scratch_folder(spark, "history")

    def read(key: Row) -> dict:
        history_of_table(spark, tuple(key), run).write.parquet(f"{folder}/commits/{uuid.uuid4().hex}")
        return {"done": True}

    schema = T.StructType(
        [*TABLES.fields, T.StructField("done", T.BooleanType()), T.StructField("error", T.StringType())]
    )
    outcome = _per_table(spark, tables, read, schema, workers, f"{folder}/outcome")
    if outcome.filter("done").isEmpty():
        rows = spark.createDataFrame([], TABLE_HISTORY)
    else:
        rows = spark.read.schema(TABLE_HISTORY).option("recursiveFileLookup", True).parquet(f"{folder}/commits")
    return Collected(rows, failures_of(outcome, "history"))


def collect_history(
    spark: SparkSession,
    tables: DataFrame,
    scratch: str | None = None,
    run: Runner | None = None,
    workers: int = 8,
) -> DataFrame:
    """The rows of ``command_history`` alone."""
    return command_history(spark, tables, scratch, run, workers).rows
