"""Integer division. ``/`` on bigint goes through double, which cannot hold
epoch nanoseconds exactly."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def floor_div(c: Column, n: int) -> Column:
    """Exact floor(c / n) for bigint, also below zero."""
    d = F.lit(n).cast("bigint")
    return F.call_function("div", c - F.pmod(c, d), d)
