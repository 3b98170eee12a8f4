"""One-row results as scalar subqueries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row aggregate to every row.

    The aggregate runs once as a scalar subquery and reaches the rows as a constant,
    so no join is planned. More than one row is an error at run time.
    """
    box = one_row.select(F.struct(*one_row.columns).alias("box")).scalar()
    return df.withColumn("_box", box).select(*df.columns, "_box.*")
