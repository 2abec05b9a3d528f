"""Date arithmetic of the library: whole days by floor, and fractional days since 2000."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_US = 86_400_000_000
ORIGIN = "2000-01-01 00:00:00"


def microseconds(start: Column, end: Column) -> Column:
    """end - start in microseconds."""
    return F.timestamp_diff("MICROSECOND", start, end)


def floor_days(a: Column, b: Column) -> Column:
    """|floor((a - b) in days)|: the floor comes first, so the order of the pair matters."""
    d = microseconds(b, a)
    return F.abs(((d - F.pmod(d, F.lit(DAY_US))) / F.lit(DAY_US)).cast("long"))


def days_since_2000(date: Column) -> Column:
    """Fractional days; NULL counts as day 0."""
    origin = F.lit(ORIGIN).cast("timestamp_ntz")
    return F.coalesce(microseconds(origin, date).cast("double") / F.lit(float(DAY_US)), F.lit(0.0))


def midnight(date: Column) -> Column:
    return date.cast("timestamp_ntz")
