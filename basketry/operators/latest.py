"""Latest row per key, as aggregates instead of a window.

``row_number() over (partition by key order by ...) = 1`` sends every row of a
key to one task; a key holding a third of the rows makes one task do a third
of the work.  ``max(struct(order..., payload...))`` is a hash aggregate with a
map-side partial step, so a hot key is reduced inside each input partition
before the shuffle, and the result is the same row.

A struct compares its fields in one direction, so the order columns are cut
into runs of one direction.  Numeric columns fit either run (``-x`` sorts like
``x`` reversed).  With a single run the answer is one ``max``/``min`` of a
struct.  Runs before the last join it where their columns can be turned round
exactly (integers, decimals, dates, timestamps): then one aggregate does, and no
row of the input moves.  Only else (a text or a double in the other direction)
each run but the last is an aggregate of its values per key, joined back
(null-safe, on key and values) to keep only the rows that tie on it; the last
run picks the row.  Null order values sort low
in a struct: last in descending order, first in ascending, as in Spark SQL
(a negated numeric column keeps its nulls last).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DateType, DecimalType, IntegralType, NumericType, TimestampNTZType, TimestampType


def _runs(order_by: Sequence[tuple[str, bool]], numeric: set[str]) -> list[tuple[bool, list[tuple[str, bool]]]]:
    """[(descending, [(column, negate)])]: consecutive columns sharing one direction."""
    runs: list[tuple[bool, list[tuple[str, bool]]]] = []
    for name, desc in order_by:
        if runs and (runs[-1][0] == desc or name in numeric):
            run_desc = runs[-1][0]
            runs[-1][1].append((name, run_desc != desc))
        else:
            runs.append((desc, [(name, False)]))
    return runs


def _fields(cols: list[tuple[str, bool]], prefix: str) -> list[Column]:
    return [(-F.col(c) if neg else F.col(c)).alias(f"{prefix}{i}") for i, (c, neg) in enumerate(cols)]


def _turned(c: Column, kind: DataType) -> Column | None:
    """A value that sorts like ``c`` reversed (null: null), exact over the whole type; none where there is no such value."""
    if isinstance(kind, IntegralType):
        return F.bitwise_not(c)
    if isinstance(kind, DecimalType):
        return -c
    if isinstance(kind, DateType):
        return F.bitwise_not(F.unix_date(c))
    if isinstance(kind, TimestampType):
        return F.bitwise_not(F.unix_micros(c))
    if isinstance(kind, TimestampNTZType):  # an interval: no time zone takes part
        return -(c - F.lit("1970-01-01").cast("timestamp_ntz"))
    return None


def _one_run(runs: list[tuple[bool, list[tuple[str, bool]]]], kinds: dict[str, DataType]) -> list[Column] | None:
    """The fields of all runs in the direction of the last one, each with its run's place for nulls; none if one does not turn."""
    last, out = runs[-1][0], []
    for desc, cols in runs:
        for c, neg in cols:
            if desc == last:
                out.append(-F.col(c) if neg else F.col(c))
                continue
            value = F.col(c) if neg else _turned(F.col(c), kinds[c])
            if value is None or (neg and _turned(F.col(c), kinds[c]) is None):
                return None
            # a null, the lowest value of its run, is the highest one here
            out += [F.col(c).isNull(), value]
    return [f.alias(f"o{i}") for i, f in enumerate(out)]


def latest_per_key(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[tuple[str, bool]],
    payload: Sequence[str],
) -> DataFrame:
    """One row per ``keys``: the first row in ``order_by`` order.

    ``order_by`` is ``[(column, descending), ...]``.  Returns ``keys + payload``.
    """
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)}
    runs = _runs(order_by, numeric)
    order = _one_run(runs, {f.name: f.dataType for f in df.schema.fields})
    if order is not None:
        runs = runs[-1:]
    cur = df
    for r, (desc, cols) in enumerate(runs[:-1]):
        agg = F.max if desc else F.min
        best = cur.groupBy(*keys).agg(agg(F.struct(*_fields(cols, "o"))).alias("__b"))
        best = best.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
                           *[F.col(f"__b.o{i}").alias(f"__v{r}_{i}") for i in range(len(cols))])
        cond = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
        cond += [(-F.col(c) if neg else F.col(c)).eqNullSafe(F.col(f"__v{r}_{i}")) for i, (c, neg) in enumerate(cols)]
        cur = cur.join(best, reduce(lambda a, b: a & b, cond), "left_semi")
    desc, cols = runs[-1]
    agg = F.max if desc else F.min
    pick = agg(F.struct(*(order or _fields(cols, "o")), *[F.col(p).alias(p) for p in payload])).alias("__best")
    out = cur.groupBy(*keys).agg(pick)
    return out.select(*keys, *[F.col(f"__best.{p}").alias(p) for p in payload])
