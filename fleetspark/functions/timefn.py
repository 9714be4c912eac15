"""Time arithmetic on naive timestamps, in whole microseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNIT_US = {
    "us": 1, "ms": 1_000, "s": 1_000_000, "sec": 1_000_000, "second": 1_000_000,
    "min": 60_000_000, "minute": 60_000_000, "h": 3_600_000_000, "hour": 3_600_000_000,
    "d": 86_400_000_000, "day": 86_400_000_000,
}
HOUR_US = _UNIT_US["hour"]
DAY_US = _UNIT_US["day"]


def duration_us(text: str) -> int:
    """``"30 seconds"``, ``"6 hours"``, ``"15min"`` in microseconds."""
    text = text.strip()
    digits = len(text) - len(text.lstrip("0123456789"))
    unit = text[digits:].strip().lower()
    unit = unit if unit in _UNIT_US else unit.rstrip("s")
    if unit not in _UNIT_US:
        raise ValueError(f"not a duration: {text!r}")
    return int(text[:digits] or 1) * _UNIT_US[unit]


def micros(ts: str | Column) -> Column:
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(ts.cast("timestamp"))


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us).cast("timestamp_ntz")


def bucket(ts: str | Column, width: str) -> Column:
    """Start of the left-closed time bin."""
    w = duration_us(width)
    us = micros(ts)
    return from_micros(us - F.pmod(us, F.lit(w)))


def snap(ts: str | Column, grid_us: Column) -> Column:
    """Nearest multiple of the grid, the even multiple when halfway."""
    us = micros(ts)
    rest = F.pmod(us, grid_us)
    steps = (us - rest) / grid_us
    steps = steps.cast("long")
    up = F.when(rest * 2 > grid_us, 1).when(rest * 2 < grid_us, 0).otherwise(F.pmod(steps, F.lit(2)))
    return from_micros((steps + up) * grid_us)


def ntz(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")
