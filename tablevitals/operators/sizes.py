"""Exact size statistics per table that hold up when one table has most rows.

Mean, median and deviation are defined over sizes already rounded to 0.01 MB.
So the rows are first counted per (table, rounded size): that shuffle spreads
even one huge table over all tasks. What is left per table is its histogram,
and a table of M megabytes has at most sqrt(200 * M) distinct rounded sizes (the
k smallest ones add up to k*k/200 MB): about 141,000 for a 100 TB table. The
second aggregation therefore has a bounded group whatever the number of files.

All sums are sums of whole numbers, so results do not depend on the partitioning,
and the mean is the exact mean of the rounded sizes as doubles, rounded once. With
two files every second mean lies on a tie of the 2-decimal rounding that follows,
where the last bit of the double decides.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bytes_to_mb
from ..schemas import KEY

# A double of at least 0.01 is a whole number of 2^-59: the bits after the point
# are summed as two numbers, which fit a bigint up to 8 billion files of a table.
_HIGH_BITS, _LOW_BITS = 29, 30
# Likewise squares, for tables up to 2.8 EB. An overflow would fail in ANSI mode.
_SQUARE_BASE = 1 << 15


def size_histogram(rows: DataFrame, counts: str = "true", **flags: str) -> DataFrame:
    """Rows, bytes and flagged rows per table and rounded size.

    ``counts`` says which rows enter the statistics; ``flags`` (name -> condition)
    are counted over all rows.
    """
    counted = [F.expr(f"count_if({flag})").alias(name) for name, flag in flags.items()]
    rounded = F.expr(bytes_to_mb("size_bytes")).alias("size_mb")
    return rows.groupBy(*KEY, rounded).agg(
        F.expr(f"count_if({counts})").alias("n"), F.sum("size_bytes").alias("bytes"), *counted
    )


def size_summary(histogram: DataFrame, *flags: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Per table (and columns of ``by``): count, bytes, and unrounded statistics of the rounded MB."""
    keys = [*KEY, *by]
    hundredths = "CAST(size_mb * 100 + 0.5D AS BIGINT)"
    fraction = f"(size_mb - floor(size_mb)) * {1 << _HIGH_BITS}D"
    aggregates = {
        "n": "sum(n)",
        "bytes": "sum(bytes)",
        "min_mb": "min(CASE WHEN n > 0 THEN size_mb END)",
        "max_mb": "max(CASE WHEN n > 0 THEN size_mb END)",
        "median_mb": "percentile(size_mb, 0.5D, n)",
        # Sum, and sum of squares in two digits, of the size in hundredths.
        "s1": f"sum({hundredths} * n)",
        "s2_high": f"sum({hundredths} * n * ({hundredths} DIV {_SQUARE_BASE}L))",
        "s2_low": f"sum({hundredths} * n * ({hundredths} % {_SQUARE_BASE}L))",
        # Sum of the size as a double: whole MB, and the fraction in two digits.
        "whole": "sum(floor(size_mb) * n)",
        "part_high": f"sum(floor({fraction}) * n)",
        "part_low": f"sum(CAST(({fraction} - floor({fraction})) * {1 << _LOW_BITS}D AS BIGINT) * n)",
        **{name: f"sum({name})" for name in flags},
    }
    sums = histogram.groupBy(*keys).agg(*[F.expr(a).alias(name) for name, a in aggregates.items()])
    doubles = f"((whole * {1 << _HIGH_BITS}BD + part_high) * {1 << _LOW_BITS}BD + part_low)"
    joined = {
        "s1": "CAST(s1 AS DECIMAL(19, 0))",
        "s2": f"CAST(s2_high * {_SQUARE_BASE}BD + s2_low AS DECIMAL(36, 0))",
        "total": f"CAST(4 * {doubles} AS DECIMAL(38, 0))",
    }
    spread = "CAST(CAST(n AS DECIMAL(19, 0)) * s2 AS DECIMAL(38, 0)) - CAST(s1 * s1 AS DECIMAL(38, 0))"
    pairs = "CAST(n AS DOUBLE) * CAST(n - 1 AS DOUBLE)"
    # Four times the total, divided by n; an odd last digit stands for a remainder,
    # so that the cast to double rounds the true quotient.
    quotient = "CAST((total - total % nullif(n, 0)) / nullif(n, 0) AS DECIMAL(38, 0))"
    return (
        sums.withColumns({name: F.expr(text) for name, text in joined.items()})
        .withColumn("quotient", F.expr(quotient))
        .selectExpr(
            *keys,
            "n",
            "bytes",
            "min_mb",
            "max_mb",
            "median_mb",
            f"""CAST(quotient + CASE WHEN total % nullif(n, 0) > 0 AND quotient % 2 = 0 THEN 1 ELSE 0 END AS DOUBLE)
                / {4 << (_HIGH_BITS + _LOW_BITS)}D AS mean_mb""",
            f"coalesce(sqrt(try_divide(CAST({spread} AS DOUBLE), {pairs})) / 100D, 0D) AS stddev_mb",
            *flags,
        )
    )
