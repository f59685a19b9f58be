"""Holidays by rule against the published days of ten years."""

import datetime as dt

import pytest

from depthforge.sources.calendars import closed_days, easter, holidays, nth_weekday, sessions
from depthforge.sources.dated import expand_dates

# Closed days of the stock exchange of New York, month and day.
CLOSED = {
    2015: "01-01 01-19 02-16 04-03 05-25 07-03 09-07 11-26 12-25", 2016: "01-01 01-18 02-15 03-25 05-30 07-04 09-05 11-24 12-26", 2017: "01-02 01-16 02-20 04-14 05-29 07-04 09-04 11-23 12-25",
    2018: "01-01 01-15 02-19 03-30 05-28 07-04 09-03 11-22 12-05 12-25", 2019: "01-01 01-21 02-18 04-19 05-27 07-04 09-02 11-28 12-25", 2020: "01-01 01-20 02-17 04-10 05-25 07-03 09-07 11-26 12-25",
    2021: "01-01 01-18 02-15 04-02 05-31 07-05 09-06 11-25 12-24", 2022: "01-17 02-21 04-15 05-30 06-20 07-04 09-05 11-24 12-26", 2023: "01-02 01-16 02-20 04-07 05-29 06-19 07-04 09-04 11-23 12-25",
    2024: "01-01 01-15 02-19 03-29 05-27 06-19 07-04 09-02 11-28 12-25",
}


def test_ten_years():
    for year, days in CLOSED.items():
        assert [d.strftime("%m-%d") for d in closed_days("us", [year])] == days.split(), year
    assert [d.isoformat() for d in closed_days("CME", [2022, 2023])] == ["2022-04-15", "2022-12-26", "2023-01-02", "2023-04-07", "2023-12-25"]
    assert closed_days("regular", [2012])[dt.date(2012, 10, 29)] == "closed"


def test_rules():
    assert [easter(y).strftime("%m-%d") for y in (1954, 1981, 2000, 2008, 2011, 2038, 2049)] == ["04-18", "04-19", "04-23", "03-23", "04-24", "04-25", "04-18"]
    assert nth_weekday(2024, 12, 6, -1) == dt.date(2024, 12, 29) and nth_weekday(2024, 2, 3, 5) == dt.date(2024, 2, 29)
    with pytest.raises(ValueError, match="unknown calendar"):
        closed_days("moon", [2024])
    with pytest.raises(ValueError):
        closed_days("us", [1990])


def test_expand_dates():
    assert expand_dates("20240703-20240708", calendar="us") == ["20240703", "20240705", "20240708"]
    assert expand_dates("20240703-20240705", calendar="cme", iso=True) == ["2024-07-03", "2024-07-04", "2024-07-05"]
    assert expand_dates("20231229-20240102", calendar="us", end_date=False) == ["20231229"]


def test_tables(spark):
    assert holidays(spark, "us", 2023, 2024).count() == 20
    days = spark.createDataFrame([(dt.date(2024, 7, d),) for d in range(1, 9)] + [(None,)], "date date")
    assert sorted(r.date.day for r in sessions(days, "us", 2024, 2024).collect()) == [1, 2, 3, 5, 8]
