"""Small builders of inputs, and single-expression evaluation."""

from datetime import datetime

from pyspark.sql import functions as F

from tablevitals.schemas import FILE_INVENTORY, TABLE_DETAIL, TABLE_HISTORY

MB = 1 << 20
GB = 1 << 30
AS_OF = datetime(2024, 3, 1)


def evaluate(spark, expression, **columns):
    """Value of an expression over one row of text columns."""
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()])
    return row.selectExpr(f"{expression} AS v").first()[0]


def files_frame(spark, sizes_by_table, partitions=None):
    rows = [
        ("c", "s", table, f"/{table}/{i}", str(i), (partitions or {}).get((table, i)), size, None)
        for table, sizes in sizes_by_table.items()
        for i, size in enumerate(sizes)
    ]
    return spark.createDataFrame(rows, FILE_INVENTORY)


def detail_frame(spark, *rows):
    """Rows are dicts; a table name and overrides are enough."""
    base = {
        "catalog": "c",
        "schema": "s",
        "format": "delta",
        "location": "/x",
        "sizeInBytes": GB,
        "numFiles": 1,
        "partitionColumns": [],
        "properties": {},
    }
    names = TABLE_DETAIL.names
    return spark.createDataFrame(
        [tuple({**base, **row}.get(n) for n in names) for row in rows], TABLE_DETAIL
    )


def history_frame(spark, rows):
    """Rows: (table, version, timestamp, operation, parameters, metrics)."""
    return spark.createDataFrame([("c", "s", *r) for r in rows], TABLE_HISTORY)


def by_table(frame):
    return {row["table"]: row for row in frame.collect()}
