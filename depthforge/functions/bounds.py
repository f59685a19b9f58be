"""Time bounds given as text, dates or datetimes."""

from __future__ import annotations

import datetime as dt
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_utc(value: str | dt.date | dt.datetime | None, timezone: str = "UTC", end: bool = False) -> dt.datetime | None:
    """The instant of a bound; without a zone it is local to ``timezone``; a day as an end is its last microsecond."""
    if value is None:
        return None
    if isinstance(value, str):
        text = value.strip()
        if len(text) == 8 and text.isdigit():
            text = f"{text[:4]}-{text[4:6]}-{text[6:]}"
        value = dt.date.fromisoformat(text) if len(text) == 10 else dt.datetime.fromisoformat(text)
    if not isinstance(value, dt.datetime):
        if not isinstance(value, dt.date):
            raise TypeError(f"not a time: {value!r}")
        value = dt.datetime.combine(value, dt.time.max if end else dt.time.min)
    return (value if value.tzinfo else value.replace(tzinfo=ZoneInfo(timezone))).astimezone(dt.UTC)


def between(ts: Column, start=None, end=None, timezone: str = "UTC") -> Column:
    """Rows from start to end, both included; None is open; an end before the start is an error."""
    a, b = to_utc(start, timezone), to_utc(end, timezone, end=True)
    if a and b and b < a:
        raise ValueError("the end is before the start")
    out = F.lit(True)
    for bound, test in ((a, lambda t, x: t >= x), (b, lambda t, x: t <= x)):
        if bound:
            micros = int((bound - dt.datetime(1970, 1, 1, tzinfo=dt.UTC)) / dt.timedelta(microseconds=1))
            out = out & test(ts.cast("timestamp"), F.timestamp_micros(F.lit(micros)))
    return out
