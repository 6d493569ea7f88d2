"""Clustering read from DDL text."""

from pyspark.sql import DataFrame

from ..functions import NO_STRINGS, clustering_columns, has_cluster_by
from ..schemas import KEY


_FIGURES = (
    f"{has_cluster_by('ddl')} AS is_liquid_clustered",
    f"coalesce({clustering_columns('ddl')}, {NO_STRINGS}) AS clustering_columns",
)


def clustering(ddl: DataFrame) -> DataFrame:
    """Whether the DDL names clustering columns, and which.

    ``CLUSTER BY AUTO`` reports a column AUTO. Comments and literals do not count. A
    missing DDL is not clustered.
    """
    return ddl.selectExpr(*KEY, *_FIGURES)


def ddl_profile(ddl: DataFrame) -> DataFrame:
    """The columns of ``clustering``, and the error of a DDL text that could not be read."""
    error = "error" if "error" in ddl.columns else "CAST(NULL AS STRING)"
    return ddl.selectExpr(*KEY, *_FIGURES, f"{error} AS ddl_failure")
