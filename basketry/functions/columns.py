"""Column expressions for the business definitions shared by every job.

All are built-in Catalyst expressions (whole-stage codegen, no Python per row).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Statuses that make an order invalid, churn and cooling limits,
# recency bucket width, segment names and rules.
INVALID_STATUSES = ("canceled", "unavailable")
ACCEPTED_STATUSES = (
    "delivered",
    "shipped",
    "canceled",
    "invoiced",
    "processing",
    "unavailable",
    "created",
    "approved",
)
CHURN_DAYS = 180
COOLING_FROM = 91
BUCKET_DAYS = 30
SEGMENT_ORDER = (
    "Champions",
    "Loyal Customers",
    "Promising / New Customers",
    "Potential Loyalists",
    "About to Sleep",
    "At Risk / Need Attention",
    "Lost / Hibernating",
)


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def valid_order(status: str | Column = "order_status") -> Column:
    """Valid order: status not canceled / unavailable (null status is not valid)."""
    return ~col_(status).isin(*INVALID_STATUSES)


def date_key(d: str | Column) -> Column:
    """yyyymmdd as bigint, computed arithmetically (no string formatting)."""
    d = F.to_date(col_(d))
    return (F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)).cast("bigint")


def int_div(a: Column, b: Column | int) -> Column:
    """Integer division truncating toward zero, exact on bigint (SQL ``div``)."""
    b = b if isinstance(b, Column) else F.lit(b)
    return ((a - a % b) / b).cast("bigint")


def recency_bucket(recency: str | Column = "recency_days") -> Column:
    """30-day bucket start: div(r - 1, 30) * 30 + 1."""
    r = col_(recency).cast("bigint")
    return int_div(r - 1, BUCKET_DAYS) * BUCKET_DAYS + 1


def f_score(frequency: str | Column = "frequency_orders") -> Column:
    f = col_(frequency)
    return F.when(f >= 4, 5).when(f == 3, 4).when(f == 2, 3).otherwise(1)


def segment(r: str | Column = "r_score", f: str | Column = "f_score") -> Column:
    r, f = col_(r), col_(f)
    return (
        F.when((r >= 4) & (f >= 4), "Champions")
        .when((r >= 3) & (f >= 3), "Loyal Customers")
        .when((r >= 4) & (f == 1), "Promising / New Customers")
        .when((r == 3) & (f == 1), "Potential Loyalists")
        .when((r <= 2) & (f >= 3), "At Risk / Need Attention")
        .when((r == 2) & (f == 1), "About to Sleep")
        .otherwise("Lost / Hibernating")
    )


def is_churn(recency: str | Column = "recency_days") -> Column:
    return F.coalesce(col_(recency) > CHURN_DAYS, F.lit(False))


def is_cooling(recency: str | Column = "recency_days") -> Column:
    return col_(recency).between(COOLING_FROM, CHURN_DAYS)


def safe_divide(num: Column, den: Column) -> Column:
    """Null when the divisor is 0 or null (plain '/' raises under ANSI)."""
    return F.when(den != 0, num / den)


def as_double(c: str | Column) -> Column:
    """Money leaves the engine as double, after exact decimal aggregation."""
    return col_(c).cast("double")


def money_sum(c: str | Column) -> Column:
    """Sum of money held as double (results of exact 4-decimal sums): added
    back in decimal(38,4), so the total is exact and independent of row
    order, then returned as double."""
    return F.sum(col_(c).cast("decimal(38,4)")).cast("double")


def ordered_sum(c: str | Column) -> Column:
    """Sum of doubles in ascending order of the values (nulls skipped), so the
    result does not depend on row order.  It gathers the values of a group:
    for small, bounded groups only (one row per state, segment, ...)."""
    return F.aggregate(F.array_sort(F.collect_list(col_(c))), F.lit(0.0), lambda acc, x: acc + x)


def count_if(cond: Column) -> Column:
    return F.count_if(F.coalesce(cond, F.lit(False)))


def title_case(s: str | Column) -> Column:
    """Title case as in Python's ``str.title``: a letter is upper-cased when it
    follows a non-letter (or starts the text), lower-cased otherwise.
    (``initcap`` only breaks words at spaces.)  Built-in higher-order
    expression, no Python per row."""
    s = col_(s)
    idx = F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1)))

    def char(i: Column) -> Column:
        cur = F.substring(s, i, 1)
        prev = F.substring(s, i - 1, 1)
        starts = (i == 1) | ~prev.rlike(r"\p{L}")
        return F.when(starts, F.upper(cur)).otherwise(F.lower(cur))

    return F.when(s.isNotNull(), F.array_join(F.transform(idx, char), ""))
