"""Equi-joins that deal the rows of hot keys over several tasks.

A join by key sends all rows of one key to one task.  Here a frequency sketch
(Spark's own ``approx_top_k``: one partial aggregate in bounded memory, one small
sketch for each task) names the keys that hold more rows than an even share of a
task.  There are fewer such keys than tasks, whatever the data, which bounds the
table of hot keys and so its broadcast.  On the side with many rows a hot
key's rows get a number below its count of pieces, by a hash of columns that tell
them apart; the other side's rows of that key are repeated once for each piece.
The join is then by (key, piece): exact, whichever keys the sketch names, because
every row of the large side meets each partner in just one piece.

A sketch may miss a key by the width of its error (about 3.5 / 16,384 of the rows),
so a key within that of the threshold may stay whole; results do not change.
Null keys match nothing, are not counted and keep one piece.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRACKED = 10_000  # keys that a sketch holds
FINER = 4  # pieces of a hot key for each even share of a task: chance puts several into one task, small ones even out
PIECES, _PIECE = "__pieces", "__piece"


def hot_keys(df: DataFrame, key: str, tasks: int | None = None) -> DataFrame:
    """(key, pieces) of the keys with more than a ``tasks``-th of the rows: fewer than ``tasks`` rows.

    ``tasks`` is Spark's shuffle setting by default, and half of what a sketch tracks at most.
    """
    tasks = min(tasks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), TRACKED // 2)
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("k"))
    sketch = rows.agg(F.expr(f"approx_top_k(k, {tasks}, {TRACKED})").alias("top"), F.count(F.lit(1)).alias("n"))
    each = sketch.select("n", F.explode("top").alias("t")).select("n", F.col("t.item").alias(key), F.col("t.count").alias("c"))
    return each.where(F.col("c") * tasks > F.col("n")).select(key, F.ceil(F.col("c") * (FINER * tasks) / F.col("n")).cast("int").alias(PIECES))


def split_join(many: DataFrame, one: DataFrame, key: str, apart: Sequence[str], hot: DataFrame, how: str = "inner") -> DataFrame:
    """``many.join(one, key, how)`` (inner or left) with the rows of ``hot`` keys in pieces.

    ``apart`` are columns of ``many`` that differ between the rows of a key; ``hot`` comes from
    ``hot_keys`` (written, so that both sides read the same).
    """
    if how not in ("inner", "left"):
        raise ValueError(f"not a join of one side's rows: {how}")
    hot = F.broadcast(hot)
    piece = F.coalesce(F.pmod(F.xxhash64(*apart), F.col(PIECES)), F.lit(0)).cast("int")
    dealt = many.join(hot, key, "left").withColumn(_PIECE, piece).drop(PIECES)
    copies = one.join(hot, key, "left").withColumn(_PIECE, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(PIECES), F.lit(1)) - 1))).drop(PIECES)
    return dealt.join(copies, [key, _PIECE], how).drop(_PIECE)
