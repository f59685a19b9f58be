"""Durations as text, seconds or timedelta, in nanoseconds."""

from __future__ import annotations

from datetime import timedelta
from decimal import Decimal
from itertools import groupby

#: Nanoseconds per unit; "i" counts rows or index steps.
UNITS = {"ns": 1, "us": 1_000, "µs": 1_000, "ms": 10**6, "s": 10**9, "m": 60 * 10**9, "h": 3600 * 10**9, "d": 86400 * 10**9, "w": 7 * 86400 * 10**9, "i": 1}
DIGITS = frozenset("0123456789")


def _amounts(text: str) -> list[list[str]]:
    """[number, unit] for each run of digits and points and the run of other characters after it; the first number may be missing."""
    out: list[list[str]] = []
    for numeric, run in groupby(text, lambda c: c in DIGITS or c == "."):
        if numeric or not out:
            out.append(["", ""])
        out[-1][0 if numeric else 1] = "".join(run)
    return out


def _is_number(text: str, bare_point: bool) -> bool:
    """Digits with one point at most; at an end only with ``bare_point``."""
    whole, point, rest = text.partition(".")
    if not DIGITS.issuperset(whole + rest) or not whole + rest:
        return False
    return bare_point or not point or bool(whole and rest)


def _total(text: str, without: str = "", bare_point: bool = True) -> int:
    amounts = _amounts(text)
    if not amounts or any(u not in UNITS or u == without or not _is_number(n, bare_point) for n, u in amounts):
        raise ValueError(f"not a duration: {text!r}")
    total = sum(Decimal(n) * UNITS[u] for n, u in amounts)
    if total <= 0:
        raise ValueError(f"not a positive duration: {text!r}")
    return int(round(total))


def half_life_ns(value: str | timedelta | float) -> int:
    """A half-life: text such as "1h30m", spaces around it aside, a timedelta, or positive seconds."""
    if isinstance(value, bool):
        raise TypeError("a half-life is no truth value")
    if isinstance(value, str):
        return _total(value.strip())
    if isinstance(value, timedelta):
        ns = value // timedelta(microseconds=1) * 1000
    else:
        ns = round(float(value) * 10**9)
    if ns <= 0:
        raise ValueError("a half-life is positive")
    return ns


def horizon_ns(value: str) -> int:
    """A label horizon: text without index steps, points only between digits."""
    return _total(value, without="i", bare_point=False)
