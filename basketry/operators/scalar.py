"""Attach a one-row result (a scalar subquery) to every row.

The one-row frame (a global aggregate, a top-1) becomes an uncorrelated
scalar subquery (``DataFrame.scalar``): Spark computes it once and inlines the
value into the projection, so there is no join of any kind, and nothing but
that one row ever leaves its job.  Several columns travel as one struct, so
the subquery runs once.  An empty one-row frame gives nulls, as in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_COL = "__scalar"


def attach_scalar(df: DataFrame, one_row: DataFrame) -> DataFrame:
    cols = one_row.columns
    packed = one_row.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("v")).scalar()
    out = df.select("*", packed.alias(_COL))
    return out.select(*[F.col(f"`{c}`") for c in df.columns], *[F.col(f"{_COL}.`{c}`").alias(c) for c in cols])
