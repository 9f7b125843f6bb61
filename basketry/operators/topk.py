"""Top-k with a deterministic tie-break.

``orderBy(...).limit(k)`` is planned as ``TakeOrderedAndProject``: each task
keeps its own k best rows and only those reach the final merge, so the work
is distributed and the driver receives k rows.  The id tie-break makes the
result stable where the source's ``order by ... limit`` is not.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def order_cols(order_by: Sequence[tuple[str, bool]]) -> list[Column]:
    return [F.col(c).desc_nulls_last() if d else F.col(c).asc_nulls_first() for c, d in order_by]


def top_k(df: DataFrame, order_by: Sequence[tuple[str, bool]], k: int | None) -> DataFrame:
    ordered = df.orderBy(*order_cols(order_by))
    return ordered.limit(int(k)) if k else ordered


def order_small(df: DataFrame, *cols: str | Column) -> DataFrame:
    """Order a result whose row count is bounded by construction (calendar
    periods, 30-day buckets, payment types): the finished rows go to one
    partition and are sorted there, without the sampling job of a global range
    sort.  The aggregate itself stays spread.  Unbounded results keep ``orderBy``."""
    return df.repartition(1).sortWithinPartitions(*cols)
