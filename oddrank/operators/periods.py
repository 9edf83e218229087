"""Arithmetic on period labels: hours ``2024-01-31T23``, days, weeks (their Monday) and months ``2024-01``."""

from __future__ import annotations

from datetime import datetime, timedelta

FORMAT = {"hour": "%Y-%m-%dT%H", "day": "%Y-%m-%d", "week": "%Y-%m-%d", "month": "%Y-%m"}
STEP = {"hour": timedelta(hours=1), "day": timedelta(days=1), "week": timedelta(weeks=1)}


def begin(label: str, granularity: str) -> datetime:
    return datetime.strptime(label, FORMAT[granularity])


def label_of(at: datetime, granularity: str, roll_weekend: bool = False) -> str:
    """Label of the period that a time is in; with ``roll_weekend`` days of a weekend belong to Friday."""
    if granularity == "week":
        at -= timedelta(days=at.weekday())
    elif granularity == "day" and roll_weekend and at.weekday() > 4:
        at -= timedelta(days=at.weekday() - 4)
    return at.strftime(FORMAT[granularity])


def step(label: str, granularity: str, n: int) -> str:
    """The label ``n`` periods later (earlier if it is negative)."""
    at = begin(label, granularity)
    if granularity == "month":
        months = at.year * 12 + at.month - 1 + n
        return f"{months // 12:04d}-{months % 12 + 1:02d}"
    return (at + n * STEP[granularity]).strftime(FORMAT[granularity])


def bounds(label: str, granularity: str) -> tuple[datetime, datetime]:
    """Half-open window of a period."""
    return begin(label, granularity), begin(step(label, granularity, 1), granularity)


def span(first: str, last: str, granularity: str, roll_weekend: bool = False) -> list[str]:
    """All labels from ``first`` to ``last``; days of weekends are left out where they roll back."""
    out = []
    while first <= last:
        if not (granularity == "day" and roll_weekend and begin(first, granularity).weekday() > 4):
            out.append(first)
        first = step(first, granularity, 1)
    return out


def backfill(
    last_complete: str | None, reference: str, granularity: str, bootstrap: int, lookback: int, most: int, roll_weekend: bool = False
) -> list[str]:
    """Labels to run before ``reference``, which is the caller's own.

    Cold (nothing complete): ``bootstrap`` periods back. Warm: from the one after
    the last complete one, at most ``lookback`` back. Reference complete: all of
    ``lookback``, for gaps. The latest ``most`` of them.
    """
    end = step(reference, granularity, -1)
    if last_complete is None:
        start = step(reference, granularity, -bootstrap)
    else:
        start = step(reference, granularity, -lookback)
        if last_complete < reference:
            start = max(start, step(last_complete, granularity, 1))
    return span(start, end, granularity, roll_weekend)[-most:] if most > 0 else []


def default_reference(labels: list[str], current: str) -> tuple[str | None, bool]:
    """(period that a trend ends at, whether it is still going on): the latest with totals that has ended."""
    ended = [x for x in labels if x < current]
    if ended:
        return max(ended), False
    return (max(labels), True) if labels else (None, False)


def windows(reference: str, size: int, granularity: str) -> tuple[list[str], list[str]]:
    """Labels of the window that ends at ``reference`` and of the one before it."""
    start = step(reference, granularity, 1 - size)
    return span(start, reference, granularity), span(step(start, granularity, -size), step(start, granularity, -1), granularity)
