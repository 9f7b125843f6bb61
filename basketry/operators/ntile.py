"""Exact, distributed NTILE over a whole table.

``ntile(k) OVER (ORDER BY key, id)`` without ``PARTITION BY`` is planned by Spark
as a window in one task.  A tile is decided by k - 1 rows, the last of each tile but
the last one: with ``n`` rows, ``q = n div tiles`` and ``r = n mod tiles``, tile i
ends at rank ``i * q + min(i, r)``.  These rows are found by counting
(``selection.rows_at``); every row's tile is then a comparison with them, a projection
that stays in the caller's stage.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.operators.selection import SAMPLE, Order, before, rows_at


def global_ntiles(df: DataFrame, tiles: int, orders: Mapping[str, Order], sample: int = SAMPLE) -> DataFrame:
    """Add a column NTILE(tiles) over the whole frame for each entry of ``orders`` (column name -> order).

    An order must be total (end with a unique id) for the result to be
    deterministic, exactly as with SQL ``ntile``.  The frame is read a few times: give a stored one.
    """
    n = df.count()
    ends = sorted({e for i in range(1, tiles) if 1 <= (e := i * (n // tiles) + min(i, n % tiles)) < n})
    cuts = rows_at(df, {name: (order, ends) for name, order in orders.items()}, n, sample) if ends else {}
    out = {}
    for name, order in orders.items():
        # the first tiles of a frame with fewer rows than tiles hold one row each, so ranks and tiles still agree
        passed = [F.when(before(df, order, key, or_at=True), 0).otherwise(1) for key in cuts.get(name, [])]
        out[name] = sum(passed, F.lit(1)).cast("int")
    return df.select("*", *[c.alias(name) for name, c in out.items()])


def global_ntile(df: DataFrame, tiles: int, order_by: Order, out: str, sample: int | None = None) -> DataFrame:
    """Add column ``out`` = NTILE(tiles) over the whole frame in one order."""
    return global_ntiles(df, tiles, {out: order_by}, sample or SAMPLE)
