"""Dataset profile: the calendar and the date constants the queries use.

The source hard-codes its own dataset's years; here they are parameters, and
``TEST_PROFILE`` holds the values for the driver-generated test tables.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date


@dataclass(frozen=True)
class Profile:
    calendar_start: date
    calendar_end: date
    data_start: date  # a previous period starting before this is not compared
    min_date: date
    max_date: date
    default_range: tuple[date, date]
    compare_years: tuple[int, int]  # same-months comparison, first year then second
    compare_last_month: int  # months 1..this month are compared
    presets: tuple[tuple[str, date, date], ...]
    origin_states: tuple[str, str]  # buyers' state and sellers' state of the late-delivery question


# The source dataset's own calendar and presets.
SOURCE_PROFILE = Profile(
    calendar_start=date(2016, 1, 1),
    calendar_end=date(2018, 12, 31),
    data_start=date(2016, 10, 1),
    min_date=date(2016, 9, 1),
    max_date=date(2018, 10, 31),
    default_range=(date(2017, 1, 1), date(2018, 8, 31)),
    compare_years=(2017, 2018),
    compare_last_month=8,
    presets=(
        ("all", date(2016, 10, 1), date(2018, 10, 31)),
        ("year_2018", date(2018, 1, 1), date(2018, 8, 31)),
        ("year_2017", date(2017, 1, 1), date(2017, 12, 31)),
        ("last_12_months", date(2017, 9, 1), date(2018, 8, 31)),
    ),
    origin_states=("RJ", "SP"),
)

# The same shape over the test tables (purchases 1995-01-01 .. 2001-08-01).
TEST_PROFILE = Profile(
    calendar_start=date(1995, 1, 1),
    calendar_end=date(2001, 12, 31),
    data_start=date(1995, 1, 1),
    min_date=date(1995, 1, 1),
    max_date=date(2001, 12, 31),
    default_range=(date(1997, 1, 1), date(1998, 8, 31)),
    compare_years=(1997, 1998),
    compare_last_month=8,
    presets=(
        ("all", date(1995, 1, 1), date(2001, 12, 31)),
        ("year_1998", date(1998, 1, 1), date(1998, 8, 31)),
        ("year_1997", date(1997, 1, 1), date(1997, 12, 31)),
        ("last_12_months", date(1997, 9, 1), date(1998, 8, 31)),
    ),
    origin_states=("NATION_2", "NATION_1"),
)
