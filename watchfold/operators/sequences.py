"""Rules over several logs of one key: order, time span, repetition.

Rows are first cut down to those that satisfy an observation; then each operator
reduces per (key, time bucket), so a busy key is split by time and partly
aggregated before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exact import floor_div
from .skew import salted_join

NS = 1_000_000_000


def followed_by(df: DataFrame, key: list[str], ns: str, first: Column, then: Column,
                row_id: list[str]) -> DataFrame:
    """Rows satisfying ``then`` that have an earlier ``first`` row of their key.

    The earliest ``first`` per key decides, one number per key. Adds
    ``first_ns``, that earliest time.
    """
    starts = df.where(first).groupBy(*key).agg(F.min(ns).alias("first_ns"))
    ends = df.where(then)
    joined = salted_join(ends, starts, key, "inner", [ns, *row_id])
    return joined.where(F.col("first_ns") < F.col(ns))


def followed_within(df: DataFrame, key: list[str], ns: str, first: Column, then: Column,
                    seconds: float, row_id: list[str]) -> DataFrame:
    """As ``followed_by``, with at most ``seconds`` between the two rows.

    Per (key, bucket of that length) the ``first`` rows are reduced to earliest
    and latest time. A ``then`` row has a match in its own bucket if the
    earliest is before it, and in the bucket before if the latest is near
    enough; nothing further back can be in reach. Adds ``first_ns``: the time
    of a matching row (own bucket's earliest, else previous bucket's latest).
    """
    width = int(seconds * NS)
    bucket = floor_div(F.col(ns), width)
    reduced = df.where(first).withColumn("_bucket", bucket).groupBy(*key, "_bucket").agg(
        F.min(ns).alias("_first"), F.max(ns).alias("_last"))
    no_ns = F.lit(None).cast("bigint")
    views = reduced.select(*key, F.explode(F.array(
        F.struct(F.col("_bucket").alias("b"), F.col("_first").alias("own"),
                 no_ns.alias("before")),
        F.struct((F.col("_bucket") + 1).alias("b"), no_ns.alias("own"),
                 F.col("_last").alias("before")),
    )).alias("v")).select(*key, "v.*")
    per_bucket = views.groupBy(*key, F.col("b").alias("_bucket")).agg(
        F.max("own").alias("_own"), F.max("before").alias("_before"))
    ends = df.where(then).withColumn("_bucket", bucket)
    joined = salted_join(ends, per_bucket, [*key, "_bucket"], "inner", [ns, *row_id])
    t = F.col(ns)
    witness = F.when(F.col("_own") < t, F.col("_own")).when(
        t - F.col("_before") <= F.lit(width), F.col("_before"))
    return joined.withColumn("first_ns", witness).where("first_ns IS NOT NULL").drop(
        "_bucket", "_own", "_before")


def start_stop(df: DataFrame, ns: str, start_ns: int, stop_ns: int) -> DataFrame:
    """Observations in [start, stop)."""
    return df.where((F.col(ns) >= start_ns) & (F.col(ns) < stop_ns))


def repeats(df: DataFrame, key: list[str], ns: str, condition: Column, times: int,
            seconds: float) -> DataFrame:
    """(key, time) at which the condition held at least ``times`` times in the
    trailing ``seconds`` (both ends included), with that count.

    Equal times are summed first. Each bucket of the window's length is its own
    group, with the previous bucket's rows copied in as history, so a key is
    split by time and no group spans more than two windows.
    """
    width = int(seconds * NS)
    counted = df.where(condition).groupBy(*key, F.col(ns).alias("_ns")).agg(
        F.count(F.lit(1)).alias("_n"))
    bucket = floor_div(F.col("_ns"), width)
    placed = counted.withColumn("_copy", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn(
        "_bucket", bucket + F.col("_copy"))
    w = Window.partitionBy(*key, "_bucket").orderBy("_ns").rangeBetween(-width, 0)
    out = placed.withColumn("repeats", F.sum("_n").over(w))
    return out.where((F.col("_copy") == 0) & (F.col("repeats") >= times)).select(
        *key, F.col("_ns").alias(ns), "repeats")


def observation_and(df: DataFrame, key: list[str], ts: str, a: Column, b: Column,
                    window: str) -> DataFrame:
    """(key, window) in which both observations occurred, on any rows: a count by fixed windows.
    Within a distance of each other, for any number of observations: ``observations.together``."""
    return _observed(df, key, ts, a, b, window).where("has_a AND has_b")


def observation_or(df: DataFrame, key: list[str], ts: str, a: Column, b: Column,
                   window: str) -> DataFrame:
    return _observed(df, key, ts, a, b, window).where("has_a OR has_b")


def _observed(df, key, ts, a, b, window):
    rows = df.where(a | b)
    return rows.groupBy(*key, F.window(ts, window).alias("_w")).agg(
        F.bool_or(a).alias("has_a"), F.bool_or(b).alias("has_b"),
    ).withColumn("window_start", F.col("_w.start")).drop("_w")
