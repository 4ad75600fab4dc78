"""Months, seasons and lead times as column expressions. Dates stand for months and lie on day 1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
MAX_LEAD = 6


def season_table() -> list[tuple[str, int, int]]:
    """(code, months, last month) of all seasons of one, two and three months: JFM, JF, Jan and so on."""
    rows = []
    for start in range(12):
        names = [MONTHS[(start + i) % 12] for i in range(3)]
        rows.append((names[0], 1, start + 1))
        rows.append(("".join(n[0] for n in names[:2]), 2, (start + 1) % 12 + 1))
        rows.append(("".join(n[0] for n in names), 3, (start + 2) % 12 + 1))
    return rows


def month_index(time: Column | str) -> Column:
    """Months since year 0, so that neighbouring months differ by one."""
    time = F.col(time) if isinstance(time, str) else time
    return (F.year(time) * 12 + F.month(time)).cast("int")


def month_of_index(index: Column) -> Column:
    """The first day of a month index."""
    return F.make_date(F.floor((index - 1) / 12).cast("int"), (F.pmod(index - 1, F.lit(12)) + 1).cast("int"), F.lit(1))


def month_number(name: Column) -> Column:
    """Jan ... Dec as 1 ... 12; other names as null."""
    return F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), F.left(name, F.lit(3))).cast("int"), F.lit(0))


def snap(date: Column) -> Column:
    return F.trunc(date, "MM")


def season_start(target: Column) -> Column:
    """First month of a target such as Dec-Feb or Dec."""
    return month_number(target)


def is_seasonal(target: Column) -> Column:
    return F.length(target) > 3


def lead_months(source: Column, target: Column) -> Column:
    """Months from a source month to a target's first month, 0 to 11."""
    return F.pmod(target - source, F.lit(12)).cast("int")


def lead_is_valid(lead: Column, least: int = 0) -> Column:
    return lead.between(least, MAX_LEAD)


def season_end_year(year: Column, months: Column, last_month: Column) -> Column:
    """The year in which a season ends that starts in the given year."""
    return F.when(last_month - months < 0, year + 1).otherwise(year).cast("int")


def days_since_360(base_year: int, days: Column) -> tuple[Column, Column, Column]:
    """Year, month and day of days since 1 January of a base year, in a calendar of 12 months of 30 days."""
    days = F.floor(days).cast("long")
    return (base_year + F.floor(days / 360)).cast("int"), (F.floor(F.pmod(days, F.lit(360)) / 30) + 1).cast("int"), (F.pmod(days, F.lit(30)) + 1).cast("int")


def date_of_360(year: Column, month: Column, day: Column) -> Column:
    """The same date in the standard calendar; null for one that does not exist there, such as 30 February."""
    first = F.make_date(year, month, F.lit(1))
    return F.when(day <= F.dayofmonth(F.last_day(first)), F.date_add(first, (day - 1).cast("int")))
