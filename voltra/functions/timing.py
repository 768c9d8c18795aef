"""Samples and time. Sample 1 is time 0."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

LIMIT = 2_000_000_000
_UNITS = {"s": "s", "sec": "s", "second": "s", "seconds": "s", "secs": "s", "ms": "ms", "msec": "ms", "millisecond": "ms", "milliseconds": "ms", "sample": "sample", "samples": "sample"}


def scaling(rate: float, unit: str) -> float:
    """Samples in one unit of time."""
    kind = _UNITS.get(unit.lower())
    if kind is None:
        raise ValueError(f"unknown unit {unit!r}; use seconds, milliseconds or samples")
    return {"s": rate, "ms": rate / 1000, "sample": 1.0}[kind]


def as_time(sample: Column, rate: float, unit: str = "s") -> Column:
    return (sample - 1) / F.lit(scaling(rate, unit))


def as_sample(time: Column | float, rate: float, unit: str = "s"):
    """Sample of a time; given in samples it stays as it is."""
    shift = 0 if _UNITS[unit.lower()] == "sample" else 1
    if isinstance(time, Column):
        return F.rint(time * scaling(rate, unit) + shift).cast("int")
    return clamp(time * scaling(rate, unit) + shift)


def clamp(x: float) -> int:
    """Rounded half to even; infinite limits become the farthest sample."""
    return int(math.copysign(LIMIT, x)) if math.isinf(x) else max(-LIMIT, min(LIMIT, round(x)))
