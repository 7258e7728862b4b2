"""Durations written as text, such as ``2 minutes``."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


def _delta(text: str) -> timedelta:
    amount, unit = text.split()
    unit = unit.lower()
    return timedelta(**{unit if unit.endswith("s") else unit + "s": float(amount)})


def micros(text: str) -> int:
    return _delta(text) // timedelta(microseconds=1)


def interval(text: str) -> Column:
    return F.lit(_delta(text))
