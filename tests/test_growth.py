"""Steps whose cost must not outgrow the tables."""

import collections
import re

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from watchfold.functions import ids
from watchfold.operators import policies, rules, skew
from watchfold.plans import catalogue, standins


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_side_that_grows_is_not_broadcast(spark):
    left, right = spark.range(100).withColumn("v", F.lit(1)), spark.range(10)
    assert "Broadcast" not in plan_of(skew.wide_join(left, right, ["id"], "left_semi"))
    assert "Broadcast" in plan_of(left.join(right, ["id"], "left_semi"))


def test_scored_bundle_broadcasts_only_the_pods(spark, testdata):
    joins = re.findall(r"(\w+Join) \[([^\]]*)\]", plan_of(catalogue.QUERIES["scored_bundle"](spark, testdata)))
    assert {k.split("#")[0] for kind, k in joins if kind.startswith("Broadcast")} == {"remote_addr"}


def test_an_id_hashes_its_parts_once(spark, testdata):
    c = ids.object_id("bundle", F.col("id"), F.lit("x"))
    assert str(c).count("md5") == 1
    plan = plan_of(catalogue.QUERIES["graph_edges"](spark, testdata))
    assert all(line.count("md5") < 20 for line in plan.splitlines() if "transform(" in line)


def test_gate_counts_are_those_of_every_pair(spark):
    logs = spark.createDataFrame([(f, c) for f in ("f", "g", None) for c in ("a tok 1", "tok", "x", None)] * 3,
                                 "function_name string, command_line string")
    given = [("r1", "f", "tok", "t.k"), ("r1", "f", "tok", "t.k"), ("r2", "f", "tok", "t.k"), ("r3", "g", "tok", "^tok"),
             ("r4", "f", "tok", None), ("r5", None, "tok", "tok"), (None, "g", "1", "1$"), ("r6", "g", "x", "y")]
    table = spark.createDataFrame(given, "key string, function_name string, token string, regex string")
    pairs = collections.Counter(r.key for r in rules.gate_by_function(logs, table).select("key").collect())
    got = rules.gate_counts(logs, table)
    assert {r.key: r.n for r in got.collect()} == dict(pairs) == {"r1": 12, "r2": 6, "r3": 3, None: 3}
    # A log meets one test for all rules that are the same but for the key.
    many = table.where("key = 'r2'").select(F.explode(F.sequence(F.lit(1), F.lit(50)).cast("array<string>")).alias("key"),
                                            "function_name", "token", "regex")
    assert {r.n for r in rules.gate_counts(logs, many).collect()} == {6}


def test_indexed_counts_are_those_of_every_pair(spark):
    from watchfold.operators.rule_index import counts_indexed, match_indexed

    logs = spark.createDataFrame([(t, f) for t in ("the cat sat", "a cat", "b", "", None) for f in ("f", "g", None)] * 2,
                                 "command_line string, function_name string")
    given = [(1, "cat", None), (1, "cat", None), (2, "cat", "f"), (3, "b", None), (4, "b", "g"), (None, "the c", None),
             (5, "dog", None), (6, None, None), (7, "b|cat", "f")]
    table = spark.createDataFrame(given, "key long, regex string, function_name string")
    pairs = collections.Counter(r.key for r in match_indexed(logs, table).collect())
    assert {r.key: r.n for r in counts_indexed(logs, table).collect()} == dict(pairs)
    assert pairs[1] == 24 and pairs[2] == 4 and pairs[3] == 6 and pairs[4] == 2 and None not in pairs


@pytest.mark.parametrize("few,broadcast,lengths", [(150, 1_000_000, 16), (0, 2, 16), (0, 1_000_000, 1)])
def test_counts_of_plain_texts_are_those_of_every_pair(spark, monkeypatch, few, broadcast, lengths):
    from watchfold.operators import rule_index

    for name, value in (("FEW_PLAIN", few), ("MOST_BROADCAST", broadcast), ("MOST_LENGTHS", lengths)):
        monkeypatch.setattr(rule_index, name, value)
    texts = ["the cat sat on the cat", "a.cat", "aXcat", "é\u00e9\U0001f600cat", "\U0001f600", "c", "", "\n", None]
    logs = spark.createDataFrame([(t, f) for t in texts for f in ("f", "g", None)] * 2, "command_line string, function_name string")
    given = [r"a\.cat", "cat", "cat", "the cat", "é", "\U0001f600", "\U0001f600cat", "?cat", "c", "a.cat", "^c", "", "\n", r"\d", "dog", "}", r"\}", None]
    rules = [(i, r, f) for i, r in enumerate(given) if r != "?cat" for f in (None, "f")]
    table = spark.createDataFrame(rules, "key int, regex string, function_name string")
    want = collections.Counter()
    for key, regex, function in rules:
        if regex is not None:
            hit = logs.where(F.col("command_line").rlike(regex))
            want[key] += (hit.where(F.col("function_name") == function) if function else hit).count()
    got = rule_index.counts_indexed(logs, table).collect()
    assert {r.key: r.n for r in got} == {k: n for k, n in want.items() if n}
    plain = rule_index.counts_indexed(logs, table.drop("function_name"), function=None)
    assert {r.key: r.n for r in plain.collect()} == {
        i: 2 * logs.where(F.col("command_line").rlike(r)).count() for i, r in enumerate(given)
        if r not in (None, "?cat") and logs.where(F.col("command_line").rlike(r)).count()}


def test_pairs_of_plain_texts_are_not_made(spark, monkeypatch):
    from watchfold.operators import rule_index

    monkeypatch.setattr(rule_index, "match_indexed", None)  # what would pair them
    logs = spark.range(40).select(F.concat(F.lit("log "), F.col("id").cast("string")).alias("command_line"))
    rules = spark.range(40).select(F.col("id").alias("key"), F.concat(F.lit("log "), F.col("id").cast("string")).alias("regex"))
    got = {r.key: r.n for r in rule_index.counts_indexed(logs, rules, function=None).collect()}
    assert got == {i: 11 if 1 <= i <= 3 else 1 for i in range(40)}
    assert rule_index.plain_text(r"a\.b") == "a.b" and rule_index.plain_text("a.b") is None and rule_index.plain_text(r"\d") is None


@pytest.mark.parametrize("most", [0, 2_000])
def test_rules_without_a_sure_text_as_rows(spark, monkeypatch, most):
    from watchfold.operators import rule_index

    monkeypatch.setattr(rule_index, "MOST_LOOSE", most)
    logs = spark.createDataFrame([(1, "ab"), (2, "b.c"), (3, None)], "i long, command_line string")
    table = spark.createDataFrame([(1, "a|b"), (2, "a|b"), (3, r"b\."), (4, "z")], "key long, regex string")
    got = rule_index.match_indexed(logs, table, function=None).select("i", "key").collect()
    assert sorted(map(tuple, got)) == [(1, 1), (1, 2), (2, 1), (2, 2), (2, 3)]


def test_a_block_that_stands_many_times_is_split(spark):
    rows = spark.range(400).select("id", F.lit("10.0.0.7").alias("addr"))
    blocks = spark.range(50).select(F.col("id").alias("b"), F.lit("10.0.0.0/24").alias("block"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        def tasks(**kw):
            hits = policies.in_block_table(rows, "addr", blocks, "block", **kw).select("id", "b", F.spark_partition_id().alias("p"))
            found = hits.collect()
            assert len({(r.id, r.b) for r in found}) == len(found) == 20_000
            return len({r.p for r in found})

        assert tasks() == 1 and tasks(pairs_per_task=1_000) > 3
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_a_batch_is_one_file_of_several_parts(spark, tmp_path):
    raw = spark.range(1_500_000).select(F.col("id").alias("event_id"), F.timestamp_micros(F.col("id") * 1000).alias("ts"),
                                        F.md5(F.col("id").cast("string")).alias("props"))
    catalogue._event_files(raw, str(tmp_path / "ev"), range(catalogue.FILES))
    files = list((tmp_path / "ev").glob("*.parquet"))
    assert len(files) == catalogue.FILES
    assert all(pq.ParquetFile(f).num_row_groups > 3 for f in files)


def test_one_row_group_of_events_is_work_for_several_tasks(spark, tmp_path):
    rows = spark.range(100).select(F.col("id").alias("event_id"), F.timestamp_seconds("id").alias("ts"), F.col("id").alias("user_id"),
                                   F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit('{"k": 1}').alias("props"))
    rows.union(rows).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    ev = standins.events(spark, str(tmp_path))
    assert ev.select(F.spark_partition_id().alias("p")).distinct().count() > 4
    assert ev.groupBy("event_id").count().where("count = 2").count() == 100
    stream = catalogue._files_stream(spark, str(tmp_path / "events.parquet"), rows.schema)
    tasks = []
    stream.select(F.spark_partition_id().alias("p")).writeStream.foreachBatch(
        lambda batch, _: tasks.append(batch.distinct().count())).option("checkpointLocation", str(tmp_path / "cp")).trigger(
        availableNow=True).start().awaitTermination()
    assert max(tasks) > 4


def test_matches_are_not_broadcast_to_the_rules(spark):
    matches = spark.createDataFrame([(1, "a", "i1"), (2, "a", "i1"), (3, "b", "i2"), (4, None, "i2"), (5, "b", None)],
                                    "pid int, key string, indicator_id string")
    edges = spark.createDataFrame([("a", "i1", "t1"), ("b", "i2", "t2"), ("b", "i2", "t3")], "key string, source_ref string, target_ref string")
    attacks = spark.createDataFrame([("a", "t1", "one"), ("b", "t2", "two"), ("b", "t2", "two")], "key string, attack_id string, attack_name string")
    hit = rules.resolve_indicators(matches.repartition(3), edges, attacks)
    plan = plan_of(hit)
    assert plan.count("BroadcastHashJoin") == 2 and "BuildLeft" not in plan and "SortMergeJoin" not in plan
    assert sorted((r.pid, r.attack_name) for r in hit.collect()) == [(1, "one"), (2, "one"), (3, "two"), (3, "two")]
