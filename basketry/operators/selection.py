"""Rows at given ranks of a total order, found by counting, without sorting the table.

Each wanted rank has a bracket of keys that is known to hold it.  In a round, a
sample of every bracket (rows by hash of their key, about ``sample`` of them) gives
two splitters close around the rank; one aggregate counts the rows before and
between the splitters exactly, and the counts say in which part the rank lies, whatever the
sample was.  A bracket shrinks by about sqrt(sample) / 8 in each round; one with no
more rows than the sample is taken whole and the row is picked.  All ranks of all
orders share the jobs of a round.

To the driver come counts and at most ``sample`` keys for each bracket (in expectation; a fixed
parameter).  No row is shuffled, written or sorted on the executors.  Tied values
are told apart by the later columns of the order, which must be total.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = 8192

Order = Sequence[tuple[str, bool]]  # (column, descending); nulls first ascending, last descending


def _value_before(a, b) -> bool:
    """Spark's order of two values: nulls first, NaN last."""
    if a is None or b is None:
        return a is None and b is not None
    if a != a or b != b:
        return a == a and b != b
    return a < b


def _compare(order: Order, a: tuple, b: tuple) -> int:
    for (_, desc), x, y in zip(order, a, b):
        less, more = _value_before(x, y), _value_before(y, x)
        if less or more:
            return -1 if less != desc else 1
    return 0


def before(df: DataFrame, order: Order, key: tuple, or_at: bool = False) -> Column:
    """Whether a row comes before ``key`` (``or_at``: or is at it)."""
    out, same = F.lit(False), F.lit(True)
    for (name, desc), v in zip(order, key):
        c, at = F.col(name), F.lit(v).cast(df.schema[name].dataType)
        if desc:
            here = c.isNotNull() if v is None else F.coalesce(c > at, F.lit(False))
        else:
            here = F.lit(False) if v is None else c.isNull() | (c < at)
        out = out | (same & here)
        same = same & c.eqNullSafe(at)
    return out | same if or_at else out


@dataclass
class _Target:
    order: Order
    rank: int  # one-based
    size: int  # rows of the bracket
    base: int = 0  # rows before it
    low: tuple | None = None  # first key of the bracket
    low_out: bool = False  # ... which itself is not in it
    high: tuple | None = None  # first key after the bracket
    found: tuple | None = None

    def inside(self, df: DataFrame) -> Column:
        c = F.lit(True)
        if self.low is not None:
            c = c & ~before(df, self.order, self.low, self.low_out)
        if self.high is not None:
            c = c & before(df, self.order, self.high)
        return c

    def splitters(self, keys: list[tuple], sample: int) -> tuple[tuple, tuple | None] | None:
        """(low, high) around the rank, from the sorted sample; the whole bracket picks the row itself."""
        keys = sorted(keys, key=functools.cmp_to_key(lambda a, b: _compare(self.order, a, b)))
        if self.size <= sample:
            self.found = keys[self.rank - self.base - 1]
            return None
        if not keys:
            return ()
        at = (self.rank - self.base) / self.size * len(keys)
        away = 2 * math.sqrt(len(keys)) + 1
        i, j = max(0, math.floor(at - away)), math.ceil(at + away)
        return keys[min(i, len(keys) - 1)], keys[j] if j < len(keys) else self.high


def rows_at(df: DataFrame, wanted: Mapping[str, tuple[Order, Sequence[int]]], n: int, sample: int = SAMPLE) -> dict[str, list[tuple]]:
    """For each name the keys at its one-based ranks among the ``n`` rows of ``df``, in its order."""
    sample = max(sample, 128)  # fewer keys leave brackets that hardly shrink
    targets = {name: [_Target(order, r, n) for r in ranks] for name, (order, ranks) in wanted.items()}
    turn = 0
    while open_ := [t for some in targets.values() for t in some if t.found is None]:
        turn += 1
        brackets: dict[tuple, list[_Target]] = {}
        for t in open_:  # ranks of one order start in one bracket
            brackets.setdefault((tuple(t.order), t.low, t.low_out, t.high), []).append(t)
        keys: list[list[tuple]] = [[] for _ in brackets]
        picks: dict[tuple, DataFrame] = {}  # one job for the brackets of an order
        for k, some in enumerate(brackets.values()):
            t, names = some[0], [c for c, _ in some[0].order]
            take = t.inside(df)
            if t.size > sample:
                take = take & (F.pmod(F.xxhash64(F.lit(turn), *names), F.lit(1 << 30)) < int((1 << 30) * sample / t.size))
            rows = df.where(take).select(F.lit(k).alias("bracket"), *names)
            of = tuple(names)
            picks[of] = picks[of].unionAll(rows) if of in picks else rows
        for rows in picks.values():
            for r in rows.collect():
                keys[r[0]].append(tuple(r)[1:])
        tried = [(t, s) for some, got in zip(brackets.values(), keys) for t in some if (s := t.splitters(got, sample))]
        if not tried:
            continue
        counts = []
        for k, (t, (low, high)) in enumerate(tried):
            inside = t.inside(df)
            early = before(df, t.order, low)
            counts += [F.count_if(inside & early).alias(f"b{k}"), F.count_if(inside & ~early & before(df, t.order, low, True)).alias(f"e{k}")]
            if high is not None:
                counts.append(F.count_if(inside & before(df, t.order, high)).alias(f"h{k}"))
        row = df.agg(*counts).first()
        for k, (t, (low, high)) in enumerate(tried):
            first, equal = t.base + row[f"b{k}"], row[f"e{k}"]
            last = t.base + (row[f"h{k}"] if high is not None else t.size)
            if t.rank <= first:
                t.high, t.size = low, first - t.base
            elif t.rank <= first + equal:
                t.found = low
            elif t.rank <= last:
                t.low, t.low_out, t.high, t.base, t.size = low, True, high, first + equal, last - first - equal
            else:
                t.low, t.low_out, t.size, t.base = high, False, t.base + t.size - last, last
    return {name: [t.found for t in some] for name, some in targets.items()}
