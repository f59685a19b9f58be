"""Holidays of exchanges by rule, as a dimension table.

``us`` (also ``regular``) is the stock exchange of New York, ``cme`` the futures that trade around the clock in Chicago.
Rules are n-th weekdays, days before Easter and fixed days; those on a weekend are observed on the nearest weekday, but New
Year's Day only on a Monday.  Days closed once are listed.  Years before ``FIRST`` had other rules and are an error.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIRST = 1998

# Days of mourning, and days that the stock exchange was closed otherwise.
MOURNING = ("2004-06-11", "2007-01-02", "2018-12-05", "2025-01-09")
CLOSED = ("2001-09-11", "2001-09-12", "2001-09-13", "2001-09-14", "2012-10-29", "2012-10-30")


def easter(year: int) -> dt.date:
    """Easter Sunday: the Sunday after the first full moon of spring, both by the tables of the Gregorian calendar."""
    golden, century = year % 19, year // 100
    skipped = century - century // 4  # leap days that the Gregorian calendar left out
    moon = (19 * golden + 15 + skipped - (8 * century + 13) // 25) % 30  # days from 21 March to the full moon
    if moon == 29 or moon == 28 and golden > 10:
        moon -= 1
    full = dt.date(year, 3, 21) + dt.timedelta(days=moon)
    return full + dt.timedelta(days=7 - full.isoweekday() % 7)


def nth_weekday(year: int, month: int, weekday: int, n: int) -> dt.date:
    """The n-th of a weekday (0: Monday) of a month; n = -1: the last."""
    if n > 0:
        first = dt.date(year, month, 1)
        return first + dt.timedelta(days=(weekday - first.weekday()) % 7 + 7 * (n - 1))
    last = dt.date(year + month // 12, month % 12 + 1, 1) - dt.timedelta(days=1)
    return last - dt.timedelta(days=(last.weekday() - weekday) % 7 + 7 * (-n - 1))


def nearest(day: dt.date) -> dt.date:
    """Friday for a Saturday, Monday for a Sunday."""
    return day + dt.timedelta(days={5: -1, 6: 1}.get(day.weekday(), 0))


def _common(year: int) -> dict[str, dt.date]:
    new_year = dt.date(year, 1, 1)
    out = {"good friday": easter(year) - dt.timedelta(days=2), "christmas": nearest(dt.date(year, 12, 25))}
    if new_year.weekday() != 5:
        out["new year"] = nearest(new_year)
    return out


def _us(year: int) -> dict[str, dt.date]:
    out = _common(year) | {
        "martin luther king": nth_weekday(year, 1, 0, 3), "presidents": nth_weekday(year, 2, 0, 3), "memorial": nth_weekday(year, 5, 0, -1),
        "independence": nearest(dt.date(year, 7, 4)), "labor": nth_weekday(year, 9, 0, 1), "thanksgiving": nth_weekday(year, 11, 3, 4),
    }
    if year >= 2022:
        out["juneteenth"] = nearest(dt.date(year, 6, 19))
    return out


RULES = {"cme": (_common, MOURNING), "us": (_us, (*MOURNING, *CLOSED)), "regular": (_us, (*MOURNING, *CLOSED))}


def closed_days(name: str, years: Iterable[int]) -> dict[dt.date, str]:
    """{day: holiday} of a calendar; a holiday of January that is observed in December counts to its own year."""
    if name.lower() not in RULES:
        raise ValueError(f"unknown calendar {name!r}: one of {sorted(RULES)}")
    rule, once = RULES[name.lower()]
    out: dict[dt.date, str] = {}
    for year in years:
        if year < FIRST:
            raise ValueError(f"no rules before {FIRST}")
        out |= {day: holiday for holiday, day in rule(year).items()}
        out |= {day: "closed" for day in map(dt.date.fromisoformat, once) if day.year == year}
    return dict(sorted(out.items()))


def holidays(spark: SparkSession, name: str, first: int, last: int) -> DataFrame:
    """(date, holiday) of the years from first to last: a dozen rows a year."""
    return spark.createDataFrame(list(closed_days(name, range(first, last + 1)).items()), "date date, holiday string")


def sessions(days: DataFrame, name: str, first: int, last: int, date: str = "date") -> DataFrame:
    """The rows of ``days`` on which the calendar's exchange trades; their years are from first to last."""
    closed = F.broadcast(holidays(days.sparkSession, name, first, last).select(F.col("date").alias("_closed")))  # bounded by the years
    return days.where(F.dayofweek(date).between(2, 6)).join(closed, F.col(date) == F.col("_closed"), "left_anti")
