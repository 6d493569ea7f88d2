"""Failures of the sources, folded to one text per table and step."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import KEY

# Steps of a table whose failures have a column of their own.
STEPS = ("listing", "history", "ddl", "partitions")


def step_errors(failures: DataFrame) -> DataFrame:
    """One row per table with failures: the first failure of each step, and how many more there are.

    The first is that with the least text, path before error, so it does not depend on
    the order of rows. Failures fold in the tasks that read them: a directory tree that
    cannot be read at all costs one text per table.
    """
    text = "concat_ws(': ', path, coalesce(error, 'failed'))"
    sums = [F.expr(f"min(CASE WHEN step = '{s}' THEN {text} END) AS {s}_first") for s in STEPS]
    sums += [F.expr(f"count_if(step = '{s}') AS {s}_n") for s in STEPS]
    folded = failures.filter("`table` IS NOT NULL").groupBy(*KEY).agg(*sums)
    shown = "CASE WHEN {0}_n > 1 THEN concat({0}_first, ' (and ', {0}_n - 1, ' more)') ELSE {0}_first END AS {0}_error"
    return folded.selectExpr(*KEY, *[shown.format(s) for s in STEPS])

