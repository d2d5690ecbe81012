"""Deduplication, benign baselines, allow-list profiles and rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from ..sources.bundles import WILDCARD
from .skew import ROWS_PER_TASK, first_n_per_key, first_per_key, salted_join, split_join, wide_join


def dedupe(df: DataFrame, key: str = "dedup_key", order: list[str] | None = None) -> DataFrame:
    """First row per fingerprint in time order."""
    order = order or ["event_ts_ns", "corr_id"]
    return first_per_key(df, [key], [F.col(c).asc() for c in order])


def observed_counts(df: DataFrame, key: str = "dedup_key", ts: str = "event_ts") -> DataFrame:
    """number_observed, first_observed and last_observed per fingerprint."""
    return df.groupBy(key).agg(
        F.count(F.lit(1)).alias("number_observed"), F.min(ts).alias("first_observed"),
        F.max(ts).alias("last_observed"))


def drop_benign(df: DataFrame, benign: DataFrame, key: str = "dedup_key",
                salt_by: list[str] | None = None) -> DataFrame:
    """Logs whose fingerprint was not marked benign.

    Most logs are not, and those need no shuffle: a filter of the marks lets them pass where they
    are read, and only the probable hits are joined.
    """
    marks = cut_lineage(benign.select(key).where(F.col(key).isNotNull()).distinct())
    count = marks.count()
    if count > MOST_FILTERED:
        return wide_join(df, marks, [key], "left_anti")
    known = maybe_in(df, marks, [key], count)
    passed = known.where("NOT _maybe").drop("_maybe")
    return passed.unionByName(wide_join(known.where("_maybe").drop("_maybe"), marks, [key], "left_anti"))


BITS_A_KEY = 16
MOST_FILTERED = 64_000_000  # keys: 128 MB of bits
MAP_BITS = 32_768           # of one row of Spark's bitmaps


def maybe_in(df: DataFrame, keys: DataFrame, on: list[str], count: int) -> DataFrame:
    """``df`` with ``_maybe``: false only for rows whose ``on`` is surely not among ``keys``.

    A Bloom filter with two hashes and ``BITS_A_KEY`` bits for each of the ``count`` keys, about one
    in 70 of the others is let through. It is made of Spark's bitmaps, by partial aggregation, and
    broadcast: two bytes a key, which ``MOST_FILTERED`` bounds. Null never is among the keys.
    """
    maps = max(1, -(-count * BITS_A_KEY // MAP_BITS))
    rows, tests = df, F.lit(True)
    for i in range(2):
        at = F.pmod(F.xxhash64(F.lit(i), *on), F.lit(maps * MAP_BITS))
        bits = keys.select(at.alias("_at")).groupBy(F.floor(F.col("_at") / MAP_BITS).alias(f"_map{i}")).agg(
            F.bitmap_construct_agg(F.col("_at") % MAP_BITS).alias(f"_bits{i}"))
        rows = rows.withColumn(f"_at{i}", at).withColumn(f"_map{i}", F.floor(F.col(f"_at{i}") / MAP_BITS))
        rows = rows.join(F.broadcast(bits), f"_map{i}", "left")
        place = F.col(f"_at{i}") % MAP_BITS
        byte = F.conv(F.hex(F.substring(F.col(f"_bits{i}"), F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        tests = tests & (F.coalesce(F.call_function("shiftright", byte, (place % 8).cast("int")).bitwiseAND(F.lit(1)), F.lit(0)) == 1)
    some = F.lit(True)
    for c in on:
        some = some & F.col(c).isNotNull()
    return rows.withColumn("_maybe", some & tests).select(*df.columns, "_maybe")


def append_rate(df: DataFrame, ts: str = "event_ts", by: list[str] | None = None,
                every: str = "1 minute") -> DataFrame:
    """Rows per source and minute."""
    w = F.window(ts, every)
    return (df.groupBy(w.alias("w"), *(by or ["source"])).agg(F.count(F.lit(1)).alias("n"))
            .withColumn("minute", F.col("w.start")).drop("w"))


def equilibrium(rate: DataFrame, quiet_minutes: int, now, by: str = "source") -> DataFrame:
    """Sources that appended nothing for ``quiet_minutes`` before ``now``."""
    last = rate.groupBy(by).agg(F.max("minute").alias("last_minute"))
    bound = F.lit(now) - F.expr(f"INTERVAL '{quiet_minutes}' MINUTE")
    return last.withColumn("reached", F.col("last_minute") < bound)


# --- profiles ---------------------------------------------------------------------

BEHAVIOUR = ["workload", "kind", "entry"]


def learn_profile(df: DataFrame, ts: str = "event_ts", minutes: float = 5) -> DataFrame:
    """Distinct behaviours of each workload in its own learning period, which
    starts with its first event. Tall rows: no list per workload is built."""
    start = df.groupBy("workload").agg(F.min(ts).alias("_start"))
    joined = wide_join(df, start, ["workload"], "inner")
    end = F.col("_start") + F.make_interval(mins=F.lit(0), secs=F.lit(minutes * 60))
    return joined.where(F.col(ts) < end).select(*BEHAVIOUR).distinct()


def deviations(df: DataFrame, profile: DataFrame, salt_by: list[str] | None = None) -> DataFrame:
    """Events whose behaviour is not in the profile, exact entries only."""
    known = profile.select(*BEHAVIOUR).distinct()
    return wide_join(df, known, BEHAVIOUR, "left_anti")


def _segments(path: Column) -> Column:
    return F.split(path, "/")


def deviations_wildcard(df: DataFrame, profile: DataFrame, salt_by: list[str] | None = None,
                        rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """As ``deviations``, with entries in which one mark stands for one path
    segment.

    Still equi-joins: every entry has a mask (number of segments, positions of
    its wildcards), and a path is tested by blanking the same positions and
    looking the result up. A profile uses few masks, an exact entry being the
    empty mask. Only distinct behaviours are tested, so frequent ones cost one
    probe.
    """
    entries = profile.select(*BEHAVIOUR).distinct().withColumn("_seg", _segments(F.col("entry")))
    entries = entries.withColumn("_n", F.size("_seg")).withColumn(
        "_mask", F.array_compact(F.transform(
            "_seg", lambda s, i: F.when(s == WILDCARD, i))))
    masks = entries.select("_n", "_mask").distinct()

    tested = df.select(*BEHAVIOUR).distinct().withColumn("_seg", _segments(F.col("entry")))
    tested = tested.withColumn("_n", F.size("_seg"))
    # Paths have few lengths, so the length alone is a hot key: salted widely.
    paired = salted_join(tested, masks, ["_n"], "inner", ["workload", "entry"], salts=64)
    probes = paired.withColumn("_masked", F.array_join(F.transform(
        "_seg", lambda s, i: F.when(F.array_contains("_mask", i), F.lit(WILDCARD)).otherwise(s)),
        "/"))
    known = entries.select("workload", "kind", F.col("entry").alias("_masked"))
    # All ``/proc/<n>/…`` paths of a workload mask to one key: hot keys are split.
    hits = split_join(probes, known, ["workload", "kind", "_masked"], "left_semi", ["entry"],
                      rows_per_task).select(*BEHAVIOUR)
    return wide_join(df, hits.distinct(), BEHAVIOUR, "left_anti")


# Kind of behaviour -> name of the alert a deviation raises.
DEVIATION_ALERTS = {
    "exec": "Unexpected process launched",
    "open": "Unexpected file access",
    "syscall": "Unexpected system call",
    "capability": "Unexpected capability used",
    "endpoint": "Unexpected domain request",
}


def deviation_alert(kind: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, name in DEVIATION_ALERTS.items():
        out = F.when(kind == k, F.lit(name)).otherwise(out)
    return out


def cooldown(alerts: DataFrame, keys: list[str], ts: str, duration: str, first_n: int,
             tie: list[str]) -> DataFrame:
    """The first ``first_n`` alerts per key in each period of ``duration``."""
    period = F.window(ts, duration)["start"]
    order = [F.col(ts).asc(), *[F.col(t).asc() for t in tie]]
    return first_n_per_key(alerts.withColumn("period", period),
                           [*[F.col(k) for k in keys], F.col("period")], order, first_n)


# --- profiles of several environments ------------------------------------------------

def common_entries(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def only_in_first(a: DataFrame, b: DataFrame, keep_repeats: bool = False) -> DataFrame:
    return a.exceptAll(b) if keep_repeats else a.subtract(b)


def portability(profiles: DataFrame, entry: list[str], environment: str = "environment",
                ) -> DataFrame:
    """Per entry: in how many environments it occurs, first and last of them.

    Distinct (entry, environment) first: repeats vanish on the map side.
    """
    pairs = profiles.select(*entry, environment).distinct()
    return pairs.groupBy(*entry).agg(
        F.count(F.lit(1)).alias("environments"), F.min(environment).alias("first_environment"),
        F.max(environment).alias("last_environment"))
