"""Exact ``row_number() OVER (PARTITION BY key ORDER BY ...)`` that splits hot keys.

A keyed window sends every row of one key to one task.  Here the rows are
placed in the order (key, order...) by a range-partitioned sort, so a hot key
spans several ranges; a key's number is the row's position less the key's
first position.  First positions are minima, combined inside each range before
the shuffle, and come back by a join on the key whose small side has one row
for each key: AQE can split a hot key there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.operators.hotkeys import hot_keys
from basketry.operators.placed import order_col, placed


def keyed_row_number(df: DataFrame, keys: Sequence[str], order_by: Sequence[tuple[str, bool]], out: str, ranges: int | None = None) -> DataFrame:
    """Add ``out`` = 1, 2, ... within each ``keys`` group in ``order_by`` order.

    ``order_by`` is a list of ``(column, descending)``; as with SQL
    ``row_number`` it must be a total order inside a key for the result to be
    deterministic.  Null keys form one group, as in a window.
    """
    rows, _ = placed(df, [(k, False) for k in keys] + list(order_by), ranges)
    names = {k: f"__key{i}" for i, k in enumerate(keys)}
    firsts = rows.groupBy(*keys).agg(F.min("__pos").alias("__first"))
    firsts = firsts.select(*[F.col(k).alias(n) for k, n in names.items()], "__first")
    same = None
    for k, n in names.items():
        one = rows[k].eqNullSafe(firsts[n])
        same = one if same is None else same & one
    joined = rows.join(firsts, same)
    return joined.withColumn(out, (F.col("__pos") - F.col("__first") + 1).cast("bigint")).select(*df.columns, out)


def split_row_number(df: DataFrame, key: str, order_by: Sequence[tuple[str, bool]], out: str, tasks: int | None = None) -> DataFrame:
    """As ``keyed_row_number`` by one key, with one shuffle of the rows instead of two and a write.

    The rows of ordinary keys are numbered by a keyed window.  Only the null key and keys with more than an
    even share of a task (``hot_keys``: fewer than ``tasks``, their values come to the driver) are placed by ranges.
    ``tasks`` number the ordinary keys if it is given; else Spark's shuffle setting and AQE decide.
    """
    hot = [r[0] for r in hot_keys(df, key, tasks).collect()]
    at = F.col(key)
    ranged = at.isNull() | at.isin(hot) if hot else at.isNull()
    window = Window.partitionBy(key).orderBy(*[order_col(c, d) for c, d in order_by])
    ordinary = df.where(~ranged)
    ordinary = ordinary.repartition(tasks, key) if tasks else ordinary
    numbered = ordinary.withColumn(out, F.row_number().over(window).cast("bigint"))
    some = df.where(ranged)
    return numbered if some.isEmpty() else numbered.unionByName(keyed_row_number(some, [key], order_by, out))
