"""Epoch numbers and ISO text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .exact import floor_div

NS = 1_000_000_000


def iso_to_ns(text: Column) -> Column:
    """ISO text (0 to 9 fraction digits, optional ``Z``) to epoch nanoseconds.

    Kept in integers throughout: a timestamp column stops at microseconds.
    """
    bare = F.regexp_replace(text, "Z$", "")
    seconds = F.unix_seconds(
        F.try_to_timestamp(F.substring(bare, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    )
    fraction = F.regexp_extract(bare, r"^.{19}\.([0-9]{1,9})", 1)
    nanos = F.rpad(fraction, 9, "0").try_cast("bigint")
    return seconds * F.lit(NS) + F.coalesce(nanos, F.lit(0).cast("bigint"))


def iso_to_ns_micro_only(text: Column) -> Column:
    """As ``iso_to_ns`` but null for more than six fraction digits, which is
    all a microsecond date parser accepts."""
    too_long = text.rlike(r"\.[0-9]{7,}Z?$")
    return F.when(~too_long, iso_to_ns(text))


def ts_to_ns(ts: Column) -> Column:
    return F.unix_micros(ts) * F.lit(1000)


def ns_to_ts(ns: Column) -> Column:
    return F.timestamp_micros(floor_div(ns, 1000))


def ts_to_iso_micros(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def ts_to_iso_nanos(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'000Z'")


def start_bound_ns(value: Column, strict: bool = True) -> Column:
    """Guess the unit of a user-given start time and return nanoseconds.

    ``strict`` uses bands that fit present-day values: seconds below 1e11,
    milliseconds below 1e14, microseconds below 1e17. The loose form uses the
    bands 1e12 (milliseconds) and 1e15 (microseconds), under which a present-day
    millisecond value is taken for microseconds.
    """
    v = value.cast("bigint")
    if strict:
        return (
            F.when(v < 10**11, v * F.lit(NS))
            .when(v < 10**14, v * F.lit(1_000_000))
            .when(v < 10**17, v * F.lit(1000))
            .otherwise(v)
        )
    return (
        F.when(v < 10**12, v * F.lit(1_000_000)).when(v < 10**15, v * F.lit(1000)).otherwise(v)
    )


def epoch_to_iso(value: Column, strict: bool = True) -> Column:
    """Span time to ISO seconds in UTC.

    The loose form knows only two units: nanoseconds above 1e12, else
    milliseconds, so a present-day millisecond value lands in 1970.
    """
    v = value.cast("bigint")
    if strict:
        seconds = floor_div(start_bound_ns(v), NS)
    else:
        seconds = F.when(v > 10**12, floor_div(v, NS)).otherwise(floor_div(v, 1000))
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def ns_to_iso_millis(ns: Column) -> Column:
    return F.date_format(
        F.timestamp_millis(floor_div(ns, 1_000_000)),
        "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'",
    )
