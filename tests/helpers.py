"""Small helpers for fixtures and brute-force references."""

from __future__ import annotations

import datetime as dt
import random
from decimal import Decimal


def day(text: str) -> dt.date:
    return dt.date.fromisoformat(text)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=repr)


def months_before(d: dt.date, n: int) -> dt.date:
    month = d.year * 12 + d.month - 1 - n
    year, month = divmod(month, 12)
    for last in (31, 30, 29, 28):
        try:
            return dt.date(year, month + 1, min(d.day, last))
        except ValueError:
            continue
    raise AssertionError


def random_day(rng: random.Random, start="2020-01-01", days=400) -> dt.date:
    return day(start) + dt.timedelta(days=rng.randrange(days))


def money(rng: random.Random, top=5000) -> Decimal:
    return Decimal(rng.randrange(1, top * 100)) / 100
