"""Interval texts, UTC bounds and what a backfill reads around them."""

from __future__ import annotations

import re
from datetime import UTC, date, datetime, timedelta

_UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}


def seconds(interval: str) -> int:
    """Of '<n> <unit>'; ValueError for anything else, so that no unknown grain is guessed at."""
    m = re.fullmatch(r"\s*(\d+)\s+(second|minute|hour|day|week)s?\s*", interval, re.I)
    if not m or not int(m[1]):
        raise ValueError(f"not an interval: {interval!r}")
    return int(m[1]) * _UNITS[m[2].lower()]


def parse_day(text: str) -> date:
    return date.fromisoformat(text)


def utc_bounds(start: date, end: date) -> tuple[datetime, datetime]:
    """The half-open range of instants of two days, midnight UTC; the end must come after the start."""
    if end <= start:
        raise ValueError("the end must come after the start")
    return tuple(datetime(d.year, d.month, d.day, tzinfo=UTC) for d in (start, end))


def as_utc(moment: datetime) -> datetime:
    return moment.replace(tzinfo=UTC) if moment.tzinfo is None else moment.astimezone(UTC)


def aligned(start: datetime, end: datetime, interval: str) -> tuple[datetime, datetime]:
    """The bounds moved outwards to the edges of the epoch-aligned windows that they cut."""
    width = seconds(interval)
    low = int(as_utc(start).timestamp()) // width * width
    high = -(-int(as_utc(end).timestamp()) // width) * width
    epoch = datetime(1970, 1, 1, tzinfo=UTC)
    return epoch + timedelta(seconds=low), epoch + timedelta(seconds=high)
