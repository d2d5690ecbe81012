"""Structured Streaming forms of the operators.

Progress lives in the checkpoint folder, so a restarted query continues where it
stopped; nothing is read twice and rows that tie on a time are not lost.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.exact import floor_div
from ..operators import baseline, bundles, normalize, observations, rules as rule_ops
from ..operators.skew import wide_join
from ..session import cut_lineage, scratch_dir
from ..sources import sinks
from ..sources.rules import Rule

# Poll intervals.
OBJECT_INTERVAL, MATCH_INTERVAL, SPAN_INTERVAL = "10 seconds", "5 seconds", "10 seconds"
LATENESS = "10 minutes"


def start(writer, interval: str | None) -> StreamingQuery:
    """``interval`` polls forever; None drains what is there and stops."""
    if interval is None:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=interval).start()


def drain_to_table(stream: DataFrame, purpose: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is available into Parquet and read that back."""
    spark = stream.sparkSession
    out, checkpoint = scratch_dir(spark, purpose), scratch_dir(spark, purpose + "-checkpoint")
    query = (stream.writeStream.format("parquet").outputMode(mode)
             .option("path", out).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def drain_updates(stream: DataFrame, keys: list[str], purpose: str) -> DataFrame:
    """Run a stream with state in update mode and read back the last state of
    every key, windows that the watermark has not closed yet included."""
    spark = stream.sparkSession
    out, checkpoint = scratch_dir(spark, purpose), scratch_dir(spark, purpose + "-checkpoint")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/_update={batch_id}")

    (stream.writeStream.foreachBatch(write).outputMode("update")
     .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()).awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("_update", T.LongType())])
    updates = spark.read.schema(schema).option("basePath", out).parquet(out)
    return sinks.latest_per_key(updates, keys, ["_update"]).drop("_update")


def incremental(stream: DataFrame, process: Callable[[DataFrame], DataFrame], root: str,
                table: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Periodic ETL: ``process`` is a DataFrame -> DataFrame function plugged in
    per table. Batches are written under their id, so a retry replaces."""
    def write(batch: DataFrame, batch_id: int) -> None:
        sinks.append_batch(process(batch), root, table, batch_id)

    return start(stream.writeStream.foreachBatch(write).option(
        "checkpointLocation", checkpoint), interval)


def span_etl(stream: DataFrame, to_traffic: Callable[[DataFrame], DataFrame], root: str,
             raw_table: str, object_table: str, checkpoint: str,
             interval: str | None = None) -> StreamingQuery:
    """Dual write of one batch: raw rows and their objects, same batch id. Each
    write reads the batch's files again; nothing is held on executors."""
    def write(batch: DataFrame, batch_id: int) -> None:
        sinks.append_batch(batch, root, raw_table, batch_id)
        sinks.append_batch(
            normalize.span_object_rows(to_traffic(batch)), root, object_table, batch_id)

    return start(stream.writeStream.foreachBatch(write).option(
        "checkpointLocation", checkpoint), interval)


def match_etl(stream: DataFrame, to_norm: Callable[[DataFrame], DataFrame],
              rules: Callable[[], list[Rule]], root: str, checkpoint: str,
              object_table: str = "kernel_objects", layout: str = "flat",
              interval: str | None = None) -> StreamingQuery:
    """Normalise, write objects, match, write matches.

    A batch is read, parsed and normalised once, into a table of its own from which both
    outputs come. ``rules`` is called once per batch, so rules added while the stream runs
    apply from the next batch on.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        catalogue, norm = rules(), cut_lineage(to_norm(batch))
        sinks.append_batch(normalize.object_rows(norm), root, object_table, batch_id)
        matched = rule_ops.match_rules(norm, catalogue, layout)
        sinks.append_batch(
            bundles.matched_rule_rows(matched, catalogue, layout == "flat"),
            root, "matched_rules", batch_id)

    return start(stream.writeStream.foreachBatch(write).option(
        "checkpointLocation", checkpoint), interval)


HITS, MATCHED = "rule_hits", "rule_matches"
DAY_NS = 24 * 3600 * observations.NS


def rules_etl(stream: DataFrame, to_norm: Callable[[DataFrame], DataFrame], rules: Callable[[], list[Rule]],
              key: list[str], root: str, checkpoint: str, ns: str = "event_ts_ns", layout: str = "flat",
              retention: float = 24 * 3600.0, bucket_seconds: float = observations.BUCKET_SECONDS,
              interval: str | None = None) -> StreamingQuery:
    """Rules over several logs, on a stream: each batch adds the matches that its logs complete.

    The state is a table of hits, (rule, observation, key, time) by day and batch, so it is spread
    like any table and a busy key is no one task's. A batch writes its own hits, reads those that
    can share a match with them (a span to both sides, so logs may come late and in any order),
    works the rules out on these as in batch, and writes the matches that no batch before has.
    Both tables are written under the batch's id: a batch that is run again writes the same. A rule
    without a span takes ``retention`` seconds. ``rules`` is called once per batch: a rule added
    while the stream runs applies to the logs of the batches that follow.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark, catalogue = batch.sparkSession, rules()
        trees = {}
        for rule in catalogue:
            tree = rule_ops.rule_tree(rule)
            trees[rule.key] = tree if tree.span() is not None else observations.Observed(of=(tree,), within=retention)
        span = round(max((t.span() for t in trees.values()), default=0) * observations.NS)
        own = rule_ops.rule_hits(to_norm(batch), catalogue, key, ns, layout)
        _write_batch(own, f"{root}/{HITS}", "ns", batch_id)
        seen = _read_batches(spark, f"{root}/{HITS}", own.schema)
        lo, hi = seen.where(F.col("batch") == batch_id).agg(F.min("ns"), F.max("ns")).first()
        if lo is None:
            return
        seen = _between(seen, "ns", lo - span, hi + span).where(F.col("batch") <= batch_id)
        seen = seen.groupBy("rule", "observation", *key, "ns").agg(F.sum("n").alias("n"))
        found = observations.matches(seen, trees, key, bucket_seconds)
        found = found.where(F.col("last") >= lo).select("rule", *key, F.col("last").alias(ns), F.col("first").alias("first_ns"))
        known = _between(_read_batches(spark, f"{root}/{MATCHED}", found.schema), ns, lo, hi + span).where(F.col("batch") < batch_id)
        same = [found[c].eqNullSafe(known[c]) for c in ["rule", *key, ns]]
        _write_batch(found.join(known, same, "left_anti"), f"{root}/{MATCHED}", ns, batch_id)

    return start(stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint), interval)


def _write_batch(df: DataFrame, path: str, ns: str, batch_id: int) -> None:
    dated = df.withColumn("day", floor_div(F.col(ns), DAY_NS)).withColumn("batch", F.lit(batch_id).cast("long"))
    dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(path)


def _read_batches(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    parts = [T.StructField(n, T.LongType()) for n in ("day", "batch")]
    whole = T.StructType([*schema.fields, *parts])
    return spark.read.schema(whole).parquet(path) if sinks._exists(spark, path) else spark.createDataFrame([], whole)


def _between(df: DataFrame, ns: str, lo: int, hi: int) -> DataFrame:
    """Rows of [lo, hi]; whole days outside are not listed."""
    return df.where(F.col("day").between(lo // DAY_NS, hi // DAY_NS) & F.col(ns).between(lo, hi))


def rule_matches(spark: SparkSession, root: str) -> DataFrame:
    """All matches so far."""
    return spark.read.parquet(f"{root}/{MATCHED}").drop("day", "batch")


def profile_etl(stream: DataFrame, root: str, checkpoint: str, ts: str = "event_ts", minutes: float = 5,
                salt_by: list[str] | None = None, interval: str | None = None) -> StreamingQuery:
    """Learns each workload's behaviours in its first ``minutes`` and from then on writes its
    deviations: rows (workload, kind, entry, ``ts``, ...) whose behaviour it has not learned.

    The phase of a workload follows from event time: its first row opens it, and a row later than
    that by ``minutes`` is judged, whatever the batch. First rows, behaviours and deviations are
    tables by batch, so a batch that is run again replaces its own rows. A row that comes so late
    that it begins its workload's period anew does not take back what has been reported.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        first = batch.groupBy("workload").agg(F.min(ts).alias("start"))
        starts = _with_batch(first, f"{root}/profile_starts", batch_id).groupBy("workload").agg(F.min("start").alias("_start"))
        dated = wide_join(batch, starts, ["workload"], "inner")
        learning = F.col(ts) < F.col("_start") + F.make_interval(mins=F.lit(0), secs=F.lit(minutes * 60))
        learned = _with_batch(dated.where(learning).select(*baseline.BEHAVIOUR).distinct(), f"{root}/profile", batch_id)
        judged = dated.where(~learning).drop("_start")
        _with_batch(baseline.deviations(judged, learned, salt_by or [ts]), f"{root}/deviations", batch_id)

    return start(stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint), interval)


def _with_batch(df: DataFrame, path: str, batch_id: int) -> DataFrame:
    """Writes ``df`` as the rows of its batch; all rows up to that batch."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    whole = T.StructType([*df.schema.fields, T.StructField("batch", T.LongType())])
    return df.sparkSession.read.schema(whole).parquet(path).where(F.col("batch") <= batch_id).drop("batch")


def quiet_stream(stream: DataFrame, ts: str, by: list[str], quiet: str, lateness: str = LATENESS) -> DataFrame:
    """Sources that fell quiet: (*by, last): nothing came for ``quiet`` after ``last``.

    A session of a source ends when nothing follows for that long, and the watermark closes it: the
    report needs no row of the source itself. One that starts again opens another session and can
    be reported again. State is one row for each source that is not quiet.
    """
    sessions = stream.withWatermark(ts, lateness).groupBy(*by, F.session_window(ts, quiet).alias("_w"))
    return sessions.agg(F.max(ts).alias("last")).select(*by, "last")


def dedupe_stream(stream: DataFrame, key: str = "dedup_key", ts: str = "event_ts",
                  lateness: str = LATENESS) -> DataFrame:
    """First row per fingerprint within the watermark; state older than that is
    dropped, so it does not grow with the stream."""
    return stream.withWatermark(ts, lateness).dropDuplicatesWithinWatermark([key])


def dedupe_periods(stream: DataFrame, key: str = "dedup_key", ts: str = "event_ts",
                   period: str = "10 minutes", lateness: str = LATENESS) -> DataFrame:
    """One row per fingerprint and period of event time, however the stream is cut
    into batches. State is dropped once the watermark has passed the period."""
    rows = stream.withWatermark(ts, lateness).withColumn("period", F.window(ts, period)["start"])
    return rows.dropDuplicates([key, "period"])


def cooldown_stream(stream: DataFrame, key: list[str], ts: str, period: str, most: int,
                    lateness: str = LATENESS) -> DataFrame:
    """Per key and period of event time: how many alerts came, and how many of them
    a cooldown of ``most`` lets through."""
    counted = stream.withWatermark(ts, lateness).groupBy(*key, F.window(ts, period).alias("w")).agg(
        F.count(F.lit(1)).alias("n"))
    return counted.select(*key, F.col("w.start").alias("period"), "n",
                          F.least("n", F.lit(most).cast("bigint")).alias("passed"))


def rate_stream(stream: DataFrame, ts: str = "event_ts", by: list[str] | None = None,
                every: str = "1 minute", lateness: str = LATENESS) -> DataFrame:
    """Append rate; rows later than ``lateness`` are left out, and the query's
    progress reports how many (numRowsDroppedByWatermark)."""
    w = F.window(ts, every)
    rows = stream.withWatermark(ts, lateness)
    return rows.groupBy(w.alias("w"), *(by or ["source"])).agg(
        F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("minute"), *(by or ["source"]), "n")


def late_rows(query: StreamingQuery) -> int:
    """Rows dropped as late so far, over all state operators."""
    return sum(
        op.get("numRowsDroppedByWatermark", 0)
        for p in query.recentProgress for op in p["stateOperators"])


def context_stream(alerts: DataFrame, spans: DataFrame, alert_ts: str, span_ts: str,
                   seconds: int = 15, by: list[tuple[str, str]] | None = None,
                   lateness: str = LATENESS, salts: int = 8) -> DataFrame:
    """Stream–stream join of alerts and spans closer than ``seconds``.

    Both sides carry a watermark and the condition bounds both times, so each
    side's state is dropped once the other cannot reach it any more. The time
    bucket and a salt are equalities, which key the state: a busy bucket's spans
    lie in ``salts`` state partitions, and the alert, the smaller side, is
    repeated for each of them and for three buckets.
    """
    epoch = floor_div(F.unix_micros(F.col(alert_ts)), seconds * 1_000_000)
    left = alerts.withWatermark(alert_ts, lateness).withColumn(
        "_b", F.explode(F.array(epoch - 1, epoch, epoch + 1))).withColumn(
        "_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    content = [c for c, t in spans.dtypes if "map" not in t and "variant" not in t]
    right = spans.withWatermark(span_ts, lateness).withColumn(
        "_sb", floor_div(F.unix_micros(F.col(span_ts)), seconds * 1_000_000)).withColumn(
        "_own", F.pmod(F.xxhash64(*content), F.lit(salts)).cast("int"))
    gap = F.expr(f"INTERVAL {seconds} SECONDS")
    condition = (
        (F.col("_b") == F.col("_sb")) & (F.col("_salt") == F.col("_own"))
        & (F.col(span_ts) > F.col(alert_ts) - gap) & (F.col(span_ts) < F.col(alert_ts) + gap)
    )
    for a, b in by or []:
        condition = condition & (F.col(a) == F.col(b))
    return left.join(right, condition, "inner").drop("_b", "_sb", "_salt", "_own")


def repeats_stream(stream: DataFrame, key: list[str], ts: str, condition: Column, times: int,
                   window: str, slide: str, lateness: str = LATENESS) -> DataFrame:
    """Sliding windows in which the condition held at least ``times`` times."""
    counted = stream.where(condition).withWatermark(ts, lateness).groupBy(
        *key, F.window(ts, window, slide).alias("w")).agg(F.count(F.lit(1)).alias("repeats"))
    return counted.where(F.col("repeats") >= times).select(
        *key, F.col("w.start").alias("window_start"), "repeats")


def observation_and_stream(stream: DataFrame, key: list[str], ts: str, a: Column, b: Column,
                           window: str, lateness: str = LATENESS,
                           either: bool = False) -> DataFrame:
    """(key, window) in which both observations occurred; with ``either`` one is
    enough."""
    rows = stream.where(a | b).withWatermark(ts, lateness)
    both = rows.groupBy(*key, F.window(ts, window).alias("w")).agg(
        F.bool_or(a).alias("has_a"), F.bool_or(b).alias("has_b"))
    return both.where("has_a OR has_b" if either else "has_a AND has_b").select(*key, F.col("w.start").alias("window_start"))


def followed_by_stream(stream: DataFrame, key: list[str], ts: str, first: Column, then: Column,
                       within_seconds: float, lateness: str = LATENESS) -> DataFrame:
    """Rows satisfying ``then`` with an earlier ``first`` row of their key, at most
    ``within_seconds`` before: each row once, as soon as its match is there.

    A left-semi stream–stream join, so the state is Spark's own and is dropped
    once the watermark is out of reach. The bucket of the span's length is part
    of the join key, which spreads a busy key over time; a ``first`` row is
    repeated in the bucket after its own. A rule without a time span takes the
    retention as its span, since unbounded state is no option on a stream.
    """
    width = int(within_seconds * 1_000_000)
    bucket = floor_div(F.unix_micros(F.col(ts)), width)
    ends = stream.where(then).withWatermark(ts, lateness).withColumn("_bucket", bucket)
    starts = stream.where(first).select(
        *[F.col(k).alias(f"_a_{k}") for k in key], F.col(ts).alias("_a_ts")
    ).withWatermark("_a_ts", lateness)
    own = floor_div(F.unix_micros("_a_ts"), width)
    starts = starts.withColumn("_a_bucket", F.explode(F.array(own, own + 1)))
    condition = (
        (F.col("_bucket") == F.col("_a_bucket")) & (F.col("_a_ts") < F.col(ts))
        & (F.col("_a_ts") >= F.col(ts) - F.make_interval(secs=F.lit(within_seconds)))
    )
    for k in key:
        condition = condition & (F.col(k) == F.col(f"_a_{k}"))
    return ends.join(starts, condition, "left_semi").drop("_bucket")


def file_stream(spark: SparkSession, folder: str, schema, glob: str, fmt: str = "parquet",
                files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.format(fmt).load(folder)
