"""Position of every row in a total order over the whole table, with no single-task sort.

Spark range-partitions the rows on the whole order (its own sampled range
partitioner; a heavily tied or hot leading value spans several ranges as long
as the order ends with a unique column), sorts inside each range and writes the rows
once, each with its range number and its place in the range
(``monotonically_increasing_id`` over the sorted partition holds both).  The
counts of the ranges, one row for each task, become running offsets that are
broadcast back: their size is the number of ranges, not of rows.

The same path runs at every size.  The write below the shared folder pins the
ranges: nothing is sampled twice, and a lost executor re-reads stored rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.session import shared_root, shuffles_dropped

_PLACE_BITS = 33  # of monotonically_increasing_id: the row's place inside its partition


def order_col(name: str, descending: bool) -> Column:
    return F.col(name).desc() if descending else F.col(name).asc()


def placed(df: DataFrame, order_by: Sequence[tuple[str, bool]], ranges: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows with ``__range`` and zero-based ``__pos``, one-row frame with ``n``).

    ``order_by`` is a list of ``(column, descending)``.  ``ranges`` sets the number
    of ranges; by default Spark's shuffle setting and AQE decide.
    """
    spark = df.sparkSession
    order = [order_col(c, d) for c, d in order_by]
    ranged = df.repartitionByRange(ranges, *order) if ranges else df.repartitionByRange(*order)
    at = F.monotonically_increasing_id()
    path = f"{shared_root(spark)}/basketry-placed/{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        ranged.sortWithinPartitions(*order).withColumn("__at", at).write.parquet(path)
    rows = spark.read.schema(f"{_ddl(df)}, __at bigint").parquet(path)
    rows = rows.withColumn("__range", F.shiftright("__at", _PLACE_BITS))
    rows = rows.withColumn("__place", F.col("__at") - F.shiftleft(F.col("__range"), _PLACE_BITS))
    counts = rows.groupBy("__range").agg(F.count(F.lit(1)).alias("__cnt"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    offsets = counts.select("__range", F.coalesce(F.sum("__cnt").over(before), F.lit(0)).alias("__offset"))
    total = counts.agg(F.coalesce(F.sum("__cnt"), F.lit(0)).alias("n"))
    joined = rows.join(F.broadcast(offsets), "__range")
    return joined.withColumn("__pos", F.col("__offset") + F.col("__place")).drop("__at", "__place", "__offset"), total


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
