"""Streams: same result as batch, resumable, idempotent per batch."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from watchfold import schemas
from watchfold.operators import normalize, rules as rule_ops, sequences
from watchfold.sources import sinks, tail
from watchfold.sources.rules import CORE_RULES
from watchfold.streaming import pipelines

T0 = datetime.datetime(2025, 1, 1)


def events(spark, folder, rows, name):
    df = spark.createDataFrame(
        [(i, k, T0 + datetime.timedelta(seconds=s), e) for i, k, s, e in rows],
        "row_id bigint, pod string, ts timestamp, kind string")
    df.coalesce(1).write.mode("append").parquet(f"{folder}/{name}")
    return df


def stream(spark, folder, schema, per_trigger=1):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).option(
        "recursiveFileLookup", "true").parquet(str(folder))


ROWS = [(i, "hot" if i % 3 else f"p{i % 5}", i * 7 % 400, "abc"[i % 3 if i % 2 else i % 2])
        for i in range(120)]


@pytest.fixture
def folder(spark, tmp_path):
    for part in range(3):
        events(spark, tmp_path / "in", ROWS[part::3], f"f{part}")
    return tmp_path / "in"


def batch(spark, folder):
    return spark.read.option("recursiveFileLookup", "true").parquet(str(folder))


def test_followed_by_stream_equals_batch(spark, folder):
    df = batch(spark, folder)
    a, b = F.col("kind") == "a", F.col("kind") == "b"
    out = pipelines.followed_by_stream(stream(spark, folder, df.schema), ["pod"], "ts", a, b, 20)
    got = {r["row_id"] for r in pipelines.drain_to_table(out.select("row_id"), "t").collect()}
    ns = df.withColumn("ns", F.unix_micros("ts") * 1000)
    want = sequences.followed_within(ns, ["pod"], "ns", a, b, 20, ["row_id"])
    assert got == {r["row_id"] for r in want.collect()} != set()


def test_context_stream_equals_batch(spark, folder):
    df = batch(spark, folder)
    s = stream(spark, folder, df.schema)
    alerts = s.where("kind = 'a'").select(F.col("row_id").alias("a"), F.col("ts").alias("ats"),
                                          F.col("pod").alias("apod"))
    rest = s.where("kind = 'b'").select(F.col("row_id").alias("b"), F.col("ts").alias("bts"),
                                        F.col("pod").alias("bpod"))
    out = pipelines.context_stream(alerts, rest, "ats", "bts", 15, [("apod", "bpod")])
    got = sorted(tuple(r) for r in pipelines.drain_to_table(out.select("a", "b"), "t").collect())
    want = sorted((x[0], y[0]) for x in ROWS for y in ROWS if x[3] == "a" and y[3] == "b"
                  and x[1] == y[1] and abs(x[2] - y[2]) < 15)
    assert got == want != []


def test_dedupe_and_rate_over_several_batches(spark, folder):
    df = batch(spark, folder)
    s = stream(spark, folder, df.schema)
    once = pipelines.drain_to_table(
        pipelines.dedupe_stream(s, "pod", "ts").select("pod"), "t").collect()
    assert sorted(r[0] for r in once) == sorted({r[1] for r in ROWS})
    rate = pipelines.drain_to_table(
        pipelines.rate_stream(s, "ts", ["kind"], lateness="1 hour"), "t")
    assert rate.count() == 0  # the watermark has not passed any window yet


def test_repeats_and_observation_streams_need_closed_windows(spark, folder):
    df = batch(spark, folder)
    events(spark, folder, [(999, "z", 7200, "c")], "late-marker")
    s = stream(spark, folder, df.schema, 1000)
    a = F.col("kind") == "a"
    out = pipelines.repeats_stream(s, ["pod"], "ts", a | (F.col("kind") == "c"), 2, "2 minutes",
                                   "1 minute", "1 minute")
    got = {(r["pod"], int(r["window_start"].timestamp())): r["repeats"]
           for r in pipelines.drain_to_table(out, "t").collect()}
    base = int(T0.replace(tzinfo=datetime.timezone.utc).timestamp())
    want = {}
    for i, pod, sec, kind in ROWS:
        if kind in "ac":
            for w in (sec // 60 * 60, sec // 60 * 60 - 60):
                want[(pod, base + w)] = want.get((pod, base + w), 0) + 1
    assert got == {k: n for k, n in want.items() if n >= 2}
    both = pipelines.observation_and_stream(s, ["pod"], "ts", a, F.col("kind") == "b", "1 minute",
                                            "1 minute")
    got = {(r["pod"], int(r["window_start"].timestamp()))
           for r in pipelines.drain_to_table(both, "t").collect()}
    kinds = {}
    for i, pod, sec, kind in ROWS:
        kinds.setdefault((pod, base + sec // 60 * 60), set()).add(kind)
    # Only rows of the two kinds move the watermark, one minute behind them.
    mark = base + max(r[2] for r in ROWS if r[3] in "ab") - 60
    assert got == {k for k, v in kinds.items() if {"a", "b"} <= v and k[1] + 60 <= mark} != set()


def kernel_lines(n, start):
    return [json.dumps({
        "time": f"2031-02-11T07:{i // 60:02d}:{i % 60:02d}.000000001Z", "node_name": "n",
        "type": "process_kprobe", "payload": {
            "process": {"pid": i, "binary": "/bin/x", "start_time": "2031-02-11T07:00:00.5Z",
                        "pod": {"name": "p", "namespace": "web",
                                "container": {"id": "containerd://abc"}}},
            "function_name": "__x64_sys_setns" if i % 2 else "other", "parent": {}}})
        for i in range(start, start + n)]


def test_match_etl_resumes_and_picks_up_new_rules(spark, tmp_path):
    source, root, cp = tmp_path / "log", str(tmp_path / "out"), str(tmp_path / "cp")
    source.mkdir()
    (source / "1.json").write_text("\n".join(kernel_lines(20, 0)))
    rules = [r for r in CORE_RULES if r.key == "priv-mount"]

    def run():
        s = tail.tail_files(spark, str(source), schemas.KERNEL_LONG)
        q = pipelines.match_etl(s, normalize.normalize_kernel, lambda: rules, root, cp)
        q.awaitTermination()

    run()
    rules = CORE_RULES
    (source / "2.json").write_text("\n".join(kernel_lines(10, 20)))
    run()
    run()  # nothing new
    objects = spark.read.parquet(f"{root}/kernel_objects")
    assert objects.count() == 30
    matched = spark.read.parquet(f"{root}/matched_rules")
    assert matched.count() == 5  # odd rows of the second file only


def test_a_retried_batch_replaces_itself(spark, tmp_path):
    root = str(tmp_path)
    df = spark.createDataFrame([("t", "b", "m")], schemas.RESULT_TABLES["matched_rules"][0])
    for _ in range(2):
        sinks.append_batch(df, root, "matched_rules", 7)
    assert spark.read.parquet(f"{root}/matched_rules").count() == 1


def test_tail_drops_the_init_record_and_old_rows(spark, tmp_path):
    source = tmp_path / "log"
    source.mkdir()
    init = json.dumps({"time": "2031-02-11T07:00:16Z", "node_name": "init", "type": "process_exec",
                       "payload": {"init": True}})
    (source / "1.json").write_text("\n".join([init] + kernel_lines(5, 0)))
    s = tail.tail_files(spark, str(source), schemas.KERNEL_LONG)
    got = pipelines.drain_to_table(s.select("time", "event_ts"), "t")
    assert got.count() == 5
    text = schemas.KERNEL_LONG_TEXT
    t = tail.tail_files(spark, str(source), text)
    assert pipelines.drain_to_table(t.select("time"), "t").count() == 5
    rows = got.withColumn("event_ts", F.when(F.col("time").contains(":04."), F.col("event_ts"))
                          .otherwise(F.col("event_ts") - F.expr("INTERVAL 5 HOURS")))
    assert tail.within_retention(rows).count() == 1


def test_late_rows_are_reported(spark, tmp_path):
    folder = tmp_path / "in"
    df = events(spark, folder, [(1, "a", 36000, "a")], "f1")
    s = stream(spark, folder, df.schema)
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")

    def run():
        q = (pipelines.rate_stream(s, "ts", ["kind"]).writeStream.format("parquet")
             .option("path", out).option("checkpointLocation", cp).trigger(availableNow=True).start())
        q.awaitTermination()
        return q

    run()
    events(spark, folder, [(2, "a", 60, "a"), (3, "a", 36060, "a")], "f2")
    assert pipelines.late_rows(run()) == 1


def test_stream_match_equals_batch(spark, tmp_path):
    source = tmp_path / "log"
    source.mkdir()
    for i in range(3):
        (source / f"{i}.json").write_text("\n".join(kernel_lines(20, 20 * i)))
    s = tail.tail_files(spark, str(source), schemas.KERNEL_LONG, files_per_trigger=1)
    norm = rule_ops.match_rules(normalize.normalize_kernel(s), CORE_RULES)
    got = pipelines.drain_to_table(norm.select("pid", "matches"), "t")
    assert sorted(r["pid"] for r in got.collect()) == list(range(1, 60, 2))


def test_rules_over_a_stream(spark, tmp_path):
    """Late logs in any order, restarts, a batch run again, and a rule added while it runs."""
    import random

    from watchfold.operators import rules as rule_ops
    from watchfold.operators.observations import NS, Observed
    from watchfold.sources.rules import Predicate, Rule

    def rule(key, n, **how):
        seen = tuple(Predicate(0, "process:command_line", "=", "abc"[i], observation=i) for i in range(n))
        return Rule(key, "1", "n", "a", "a", "a", "i", "i", "i", "r", seen, **how)

    rng = random.Random(5)
    schema = "pod string, event_ts_ns bigint, command_line string"
    logs = [(rng.choice("pq"), (86_400 * 20_000 - 100 + rng.randint(0, 200)) * NS, rng.choice("abc")) for _ in range(90)]
    rules = [rule("chain", 3, combine="FOLLOWEDBY", within=9.0), rule("both", 2, combine="AND", within=2.0),
             rule("many", 1, repeats=3, within=12.0),
             rule("tree", 3, tree=Observed(combine="AND", within=6, of=(
                 Observed(2), Observed(combine="FOLLOWEDBY", of=(Observed(0), Observed(1)), within=4))).text())]
    source, root, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    later = rule("later", 2, combine="OR", within=5.0)

    def run(catalogue):
        stream = pipelines.file_stream(spark, source, spark.createDataFrame([], schema).schema, "*.parquet", files_per_trigger=1)
        pipelines.rules_etl(stream, lambda x: x, lambda: catalogue, ["pod"], root, checkpoint, bucket_seconds=3).awaitTermination()

    for i in range(4):
        spark.createDataFrame(logs[i::4], schema).coalesce(1).write.mode("append").parquet(source)
        run(rules if i < 2 else [*rules, later])
    got = sorted((r.rule, r.pod, r.event_ts_ns) for r in pipelines.rule_matches(spark, root).collect())
    want = rule_ops.match_sequences(spark.createDataFrame(logs, schema), rules, ["pod"])
    want = [(r.rule, r.pod, r.event_ts_ns) for r in want.collect()]
    new = rule_ops.match_sequences(spark.createDataFrame(logs[2::4] + logs[3::4], schema), [later], ["pod"])
    want += [(r.rule, r.pod, r.event_ts_ns) for r in new.collect()]
    assert got == sorted(want) and {r[0] for r in got} == {"chain", "both", "many", "tree", "later"}

    # The last batch once more, as after a crash between its write and its commit.
    import glob
    import os

    os.remove(sorted(glob.glob(f"{checkpoint}/commits/[0-9]*"))[-1])
    for path in glob.glob(f"{checkpoint}/commits/.*"):
        os.remove(path)
    run([*rules, later])
    assert sorted((r.rule, r.pod, r.event_ts_ns) for r in pipelines.rule_matches(spark, root).collect()) == got


def test_profiles_on_a_stream_equal_batch(spark, folder):
    from watchfold.operators import baseline

    def behaviour(df):
        return df.select("row_id", F.col("pod").alias("workload"), F.col("kind"), (F.col("row_id") % 10).cast("string").alias("entry"), F.col("ts").alias("event_ts"))

    df = batch(spark, folder)
    ordered = str(folder) + "-ordered"
    for i in range(4):
        df.where((F.col("ts") >= T0 + datetime.timedelta(seconds=100 * i)) & (F.col("ts") < T0 + datetime.timedelta(
            seconds=100 * i + 100))).coalesce(1).write.mode("append").parquet(f"{ordered}/f{i}")
    root = str(folder) + "-out"
    pipelines.profile_etl(behaviour(stream(spark, ordered, df.schema)), root, root + "-cp", minutes=1).awaitTermination()
    got = {r.row_id for r in spark.read.parquet(f"{root}/deviations").collect()}
    b = behaviour(df)
    want = {r.row_id for r in baseline.deviations(b, baseline.learn_profile(b, minutes=1)).collect()}
    assert got == want != set()


def test_sources_fall_quiet_and_start_again(spark, tmp_path):
    rows = [(0, "a", 0, "x"), (1, "a", 50, "x"), (2, "b", 60, "x"), (3, "a", 500, "x"), (4, "b", 70, "x"), (5, "c", 5000, "x")]
    events(spark, tmp_path / "in", rows, "f")
    s = stream(spark, tmp_path / "in", batch(spark, tmp_path / "in").schema)
    out = pipelines.drain_to_table(pipelines.quiet_stream(s, "ts", ["pod"], "2 minutes", "1 minute"), "q")
    got = {(r.pod, int((r.last - T0).total_seconds())) for r in out.collect()}
    assert got == {("a", 50), ("a", 500), ("b", 70)}
