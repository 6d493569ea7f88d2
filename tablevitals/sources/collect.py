"""Collect every inventory of the configured scope."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from ..config import LayoutConfig
from ..operators import supported_tables
from ..plans.analyze import Inventories
from ..schemas import KEY
from .catalog import (
    collect_ddl,
    collect_details,
    command_history,
    discover,
    partition_counts,
)
from .collected import failures_of
from .commits import read_commits
from .listing import list_inventory


def collect_inventories(
    spark: SparkSession,
    config: LayoutConfig,
    scratch: str | None = None,
    history: str = "logs",
) -> Inventories:
    """Discover tables, describe them, list their files, and read their commits.

    ``history`` says how: from the commit ``logs``, or by ``command`` where these
    cannot be read. All snapshots lie below ``scratch``, if given.
    """
    found = discover(spark, config)
    detail = collect_details(spark, found.rows, scratch=scratch and f"{scratch}/detail")
    inputs = inventories_of(spark, detail, config, scratch, history)
    return replace(inputs, failures=inputs.failures.unionByName(found.failures))


def inventories_of(
    spark: SparkSession,
    detail: DataFrame,
    config: LayoutConfig,
    scratch: str | None = None,
    history: str = "logs",
) -> Inventories:
    """Inventories of described tables; only those in the supported format are read.

    What could not be read is in ``failures``: directories, log files and commands.
    """
    if history not in ("logs", "command"):
        raise ValueError(f"history must be 'logs' or 'command', not {history!r}")
    located = detail.join(supported_tables(detail), list(KEY), "left_semi").select(
        *KEY, "location", "partitionColumns"
    )
    read_history = command_history if history == "command" else read_commits
    commits = read_history(spark, located, scratch and f"{scratch}/history")
    files = list_inventory(spark, located, scratch and f"{scratch}/files")
    counts = partition_counts(spark, located, scratch=scratch and f"{scratch}/partitions")
    return Inventories(
        detail=detail,
        ddl=collect_ddl(spark, located, scratch=scratch and f"{scratch}/ddl"),
        files=files.rows,
        history=commits.rows,
        partition_counts=counts,
        failures=files.failures.unionByName(commits.failures).unionByName(failures_of(counts, "partitions")),
    )
