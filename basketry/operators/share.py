"""Shares of a total over an already aggregated (small) frame.

``sum(x) over ()`` is a single-partition window, which is only acceptable on
small inputs.  Here the total is a one-row global aggregate (partial sums in
every task, one tiny final merge) attached as a scalar subquery, so the plan
stays distributed whatever the input size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.functions.columns import money_sum
from basketry.operators.scalar import attach_scalar


def with_shares(df: DataFrame, measures: Sequence[str], suffix: str = "_share", prefix: str = "",
                money: Sequence[str] = ()) -> DataFrame:
    """Add ``<measure><suffix>`` = value / total.  Columns listed in ``money``
    are totalled in decimal (exact, order-independent)."""
    totals = df.agg(*[(money_sum(m) if m in money else F.sum(m)).alias(f"__total_{m}") for m in measures])
    out = attach_scalar(df, totals)
    for m in measures:
        name = f"{prefix}{m}{suffix}" if not prefix else f"{prefix}{m}"
        total = F.col(f"__total_{m}").cast("double")
        out = out.withColumn(name, F.when(total != 0, F.col(m).cast("double") / total))
    return out.drop(*[f"__total_{m}" for m in measures])
