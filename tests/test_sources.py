"""Readers, sinks and filters on files."""

import json

import pytest
from pyspark.sql import functions as F

from watchfold import schemas
from watchfold.operators import filters, normalize
from watchfold.plans import api
from watchfold.sources import bundles as bundle_io
from watchfold.sources import logs, sinks, spans, tail


def write(tmp_path, name, docs):
    folder = tmp_path / name
    folder.mkdir()
    (folder / "a.json").write_text("\n".join(
        d if isinstance(d, str) else json.dumps(d) for d in docs))
    return str(folder)


def test_parse_or_drop_counts_what_it_drops(spark):
    from pyspark.sql import Observation

    df = spark.createDataFrame([('{"a": 1}',), ("nope",), ('{"a": ',), (None,), ("{}",)], "t string")
    schema = schemas._struct(a=schemas.L)
    out = logs.parse_or_drop(df, "t", schema, observe="parse")
    seen = Observation("check")
    rows = out.observe(seen, F.count(F.lit(1)).alias("kept")).collect()
    assert sorted(str(r["a"]) for r in rows) == ["1", "None"]
    assert seen.get["kept"] == 2


def test_a_field_of_the_wrong_type_costs_only_that_field(spark, tmp_path):
    path = write(tmp_path, "w", [{"timestamp": "soon", "processId": 7}, "[1]", "7", "", "{}"])
    rows = logs.read_syscall_trace(spark, path)
    assert rows.count() == 2
    assert sorted(str(r["processId"]) for r in rows.collect()) == ["7", "None"]


def test_rule_alert_reader(spark, tmp_path):
    message = json.dumps({
        "output_fields": {"container.id": "beef00112233", "proc.tty": "70707",
                          "proc.commandline": "sh -c id", "evt.type": "execve"},
        "rule": "Terminal shell", "priority": "Notice", "tags": ["a", "b"], "hostname": "h-1",
        "source": "syscall"})
    path = write(tmp_path, "r", [
        {"timestamp": "2033-09-21T05:06:07.808182838Z", "message": message, "file": "x"},
        {"timestamp": "t", "message": "not json"}])
    rows = normalize.normalize_rule_alert(logs.read_rule_alerts(spark, path)).collect()
    ok = [r for r in rows if r["rule_id"] == "Terminal shell"]
    assert len(ok) == 1
    assert ok[0]["corr_id"] == "330921T05060780" + "beef00112233" + "00070707" + "000000000h-1"
    assert ok[0]["interpretation"] == "a, b" and ok[0]["parent_command_line"] == "None"


def test_syscall_trace_reader(spark, tmp_path):
    path = write(tmp_path, "t", [{
        "timestamp": 1920143327412007009, "processId": 7, "processName": "sh", "hostName": "node",
        "syscall": "openat", "container": {"id": "abcdef0123456789", "image": "i"},
        "kubernetes": {"podName": "p", "podNamespace": "n"},
        "metadata": {"Properties": {"signatureName": "s", "Category": "c", "Technique": "t",
                                    "external_id": "e", "id": "attack-pattern--x"}},
        "args": [{"name": "flags", "type": "string", "value": "O_RDONLY"}], "matchedPolicies": "m"}])
    row = normalize.normalize_trace(logs.read_syscall_trace(spark, path)).select(
        "*", normalize.observed_object().alias("o")).first()
    assert row["created_time"] == "2030-11-05T21:08:47.412Z"
    assert row["trace_args"] == {"0_name": "flags", "0_type": "string", "0_value": "O_RDONLY"}
    observed = json.loads(row["o"])
    assert observed["object_refs"] == [row["process_id"], "attack-pattern--x"]
    assert observed["extensions"]["interpretation"] == "c t e"


def test_bulk_load_skips_bad_and_timeless_lines(spark, tmp_path):
    path = write(tmp_path, "b", [{"time": "2025-01-01T00:00:00Z", "event": {"a": 1}}, {"msg": "x"},
                                 "garbage"])
    kept = logs.load_alert_file(spark, path).collect()
    assert len(kept) == 1 and json.loads(kept[0]["event"]) == {"a": 1} and kept[0]["RuleID"] == ""
    assert logs.load_alert_file(spark, path, "2024-01-01T00:00:00Z").count() == 2


def test_bundle_files_bare_and_wrapped(spark, tmp_path):
    doc = {"type": "bundle", "id": "bundle--1", "spec_version": "2.1",
           "objects": [{"type": "process", "id": "p1", "x": {"y": 1}},
                       {"type": "observed-data", "id": "o1", "object_refs": ["p1"]}]}
    path = write(tmp_path, "s", [doc, {"stix_bundle": {**doc, "id": "bundle--2"}}, {"type": "x"}])
    rows = bundle_io.explode_objects(bundle_io.read_bundles(spark, path)).collect()
    assert sorted((r["bundle_id"], r["pos"], r["type"], r["object_id"]) for r in rows) == [
        (f"bundle--{i}", p, t, o) for i in (1, 2)
        for p, t, o in ((0, "process", "p1"), (1, "observed-data", "o1"))]


def test_tables_prune_dates_and_give_the_newest(spark, tmp_path):
    root = str(tmp_path)
    rows = [(f"2025-01-{d:02d}T00:00:{s:02d}Z", "n", "process_exec" if s % 2 else "process_exit",
             str(d)) for d in range(1, 21) for s in range(6)]
    df = spark.createDataFrame(rows, schemas.KERNEL_LONG_TEXT)
    sinks.append_table(df, root, "kernel_logs")
    assert sinks.table_dates(spark, root, "kernel_logs")[0] == "2025-01-20"
    got = api.query_table(spark, root, "kernel_logs", {"type": "process_exec", "payload": "9"}, 7)
    want = sorted((r[0] for r in rows if r[2] == "process_exec"), reverse=True)[:7]
    assert [r["time"] for r in got.collect()] == want
    assert "2025-01-17" in got._jdf.queryExecution().toString()  # a date bound in the scan
    assert api.query_table(spark, root, "kernel_logs", {}, 1000).count() == 120
    with pytest.raises(KeyError):
        api.query_table(spark, root, "secrets")

    seen, mark = [], None
    while True:
        batch = api.next_batch(spark, root, "kernel_logs", mark, 50, ["payload"]).collect()
        if not batch:
            break
        seen += [r["time"] for r in batch]
        mark = (batch[-1]["time"], batch[-1]["payload"])
    assert seen == sorted(r[0] for r in rows)


def test_span_bounds_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "h")
    spark.createDataFrame([], schemas.HTTP_SPAN).write.parquet(path)
    df = spans.read_http_spans(spark, path, last_seen_ns=5, start_ns=9, pod="p", namespace="n")
    plan = spark._jvm.PythonSQLUtils.explainString(
        df.select("req_path")._jdf.queryExecution(), "formatted")
    assert "GreaterThanOrEqual(time_,9)" in plan and "EqualTo(pod_name,p)" in plan
    assert "resp_body" not in plan


def test_look_back_is_twenty_minutes(spark):
    now = 10**18
    df = spark.createDataFrame([(now,), (now - 1200 * 10**9,), (now - 1201 * 10**9,)],
                               "time_ bigint")
    assert spans.select_spans(df, now_ns=now).count() == 2


def test_upsert_keeps_the_last_write(spark, tmp_path):
    path = str(tmp_path / "store")
    df = lambda rows: spark.createDataFrame(rows, "k string, t int, v string")
    sinks.upsert(spark, path, df([("a", 1, "x"), ("a", 3, "y"), ("b", 1, "z")]), ["k"], ["t"], 4)
    sinks.upsert(spark, path, df([("a", 2, "late"), ("c", 1, "new"), ("b", 9, "w")]), ["k"], ["t"], 4)
    got = {r["k"]: r["v"] for r in sinks.read_store(spark, path).collect()}
    assert got == {"a": "y", "b": "w", "c": "new"}
    # The number of slots stays the one that the store was made with, until they are full.
    sinks.upsert(spark, path, df([("d", 1, "q")]), ["k"], ["t"], 9)
    assert {r["k"] for r in sinks.read_store(spark, path).collect()} == set("abcd")
    assert sinks._state(spark, path)["buckets"] == 4


def test_a_store_grows_and_keeps_its_snapshots(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = lambda lo, hi, t: spark.range(lo, hi).select(F.col("id").alias("k"), F.lit(t).alias("t"))
    want, readers = {}, []
    for t, (lo, hi) in enumerate([(0, 100), (50, 300), (0, 20), (900, 901)]):
        sinks.upsert(spark, path, rows(lo, hi, t), ["k"], ["t"], 2, rows_per_slot=40)
        want.update({k: t for k in range(lo, hi)})
        assert {r.k: r.t for r in sinks.read_store(spark, path).collect()} == want
        readers.append((sinks.read_store(spark, path), dict(want)))
    assert sinks._state(spark, path)["buckets"] >= 8
    # Older plans and versions still read what they saw; nothing was overwritten.
    for version, (reader, seen) in enumerate(readers, 1):
        assert {r.k: r.t for r in reader.collect()} == seen
        assert {r.k: r.t for r in sinks.read_store(spark, path, version).collect()} == seen
    sinks.vacuum(spark, path, keep=2)
    assert {r.k: r.t for r in sinks.read_store(spark, path, 3).collect()} == readers[2][1]
    sinks.vacuum(spark, path)
    assert {r.k: r.t for r in sinks.read_store(spark, path).collect()} == want
    assert sinks.store_files(spark, path) == len(sinks._state(spark, path)["slots"])
    # A write that never came to its log entry, and one that lost against another.
    rows(0, 5, 99).write.parquet(f"{path}/data/dead/slot=0")
    assert {r.k: r.t for r in sinks.read_store(spark, path).collect()} == want
    with pytest.raises(Exception, match="exist"):
        sinks._put(spark, f"{path}/log/{4:010d}.json", "{}")


def test_small_slots_are_written_by_several_tasks(spark, tmp_path):
    path = str(tmp_path / "store")
    sinks.upsert(spark, path, spark.range(200).select("id", F.lit(1).alias("t")), ["id"], ["t"], 40)
    tasks = {file.name.split("-")[1] for file in tmp_path.glob("store/data/*/slot=*/part-*.parquet")}
    assert len(tasks) > 1
    assert sorted(r.id for r in sinks.read_store(spark, path).collect()) == list(range(200))


def test_compacted_dates_read_the_same(spark, tmp_path):
    root, day = str(tmp_path), 86_400 * 10**9
    columns = [f.name for f in schemas.RESULT_TABLES["dns_events"][0].fields]

    def batch(rows):
        return spark.createDataFrame([(d * day + n, n) for d, n in rows], "time_ long, pid long").select(
            *[F.col(c) if c in ("time_", "pid") else F.lit(None).alias(c) for c in columns])

    def read():
        return sorted((r.time_ // day, r.pid) for r in sinks.read_table(spark, root, "dns_events").select("time_", "pid").collect())

    want = []
    for i in range(5):
        rows = [(d, 10 * i + d) for d in (1, 2, 3)]
        sinks.append_batch(batch(rows), root, "dns_events", i)
        want += rows
    sinks.append_table(batch([(1, 77)]), root, "dns_events")
    want.append((1, 77))
    older = sinks.read_table(spark, root, "dns_events").select("time_", "pid")
    assert sinks.compact_table(spark, root, "dns_events", "1970-01-04") == ["1970-01-03", "1970-01-02"]
    assert read() == sorted(want) and older.count() == len(want)
    sinks.append_batch(batch([(1, 999)]), root, "dns_events", 2)      # a covered batch runs again
    sinks.append_batch(batch([(1, 55), (3, 56)]), root, "dns_events", 7)  # a late one
    want += [(1, 55), (3, 56)]
    assert read() == sorted(want)
    assert sinks.compact_table(spark, root, "dns_events", "1970-01-04") == ["1970-01-02"]
    batch([(2, 1)]).write.parquet(f"{root}/dns_events/dt=1970-01-03/batch=c2")  # died before its mark
    sinks.remove_compacted(spark, root, "dns_events")
    assert read() == sorted(want) and sinks.compact_table(spark, root, "dns_events", "1970-01-04") == []
    one = sinks.read_table(spark, root, "dns_events").where("dt = '1970-01-02'")
    assert len(one.inputFiles()) >= 1 and one.select(F.input_file_name()).distinct().count() == 1


def test_a_slot_with_two_rounds_reads_its_newest(spark, tmp_path):
    path = str(tmp_path / "store")
    df = lambda rows: spark.createDataFrame(rows, "k string, t int")
    for t in range(3):
        sinks.upsert(spark, path, df([("a", t), (f"n{t}", t)]), ["k"], ["t"], 1)
    assert sorted(map(tuple, sinks.read_store(spark, path).collect())) == [("a", 2), ("n0", 0), ("n1", 1), ("n2", 2)]


def test_null_fields_are_left_out(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (None, "x")], "a int, b string")
    sinks.append_json_lines(df, str(tmp_path / "j"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "j")).collect()) == [
        '{"a":1}', '{"b":"x"}']


@pytest.mark.parametrize("path,out", [
    ("/var/log/pods/kube-system_netd-x1/a/0.log", True),
    ("/var/log/pods/honeypot_x/a/0.log", True),
    ("/var/log/pods/gke-managed-cim/a/0.log", True),
    ("/var/log/pods/kube-system_dns-x1/a/0.log", False),
    ("/var/log/pods/default_storm-x/a/0.log", False),
    ("/a/Error getting SSL certificate x", True),
    ("/a/kubeshark_kubeshark-worker1/b", True),
])
def test_excluded_paths(spark, path, out):
    assert spark.range(1).select(tail.excluded_path(F.lit(path))).first()[0] is out


def test_excluded_files_of_a_scan(spark, tmp_path):
    for pod in ("kube-system_netd-1", "web_app-1"):
        (tmp_path / pod / "c").mkdir(parents=True)
        (tmp_path / pod / "c" / "0.log").write_text(pod)
    df = spark.read.option("recursiveFileLookup", "true").text(str(tmp_path))
    assert [r["value"] for r in tail.drop_excluded(df).collect()] == ["web_app-1"]


def test_upid_spells_the_pid(spark):
    df = spark.createDataFrame([("00000003-0000-3529-0000-0000000118f6", 1, 1, None, None, None)],
                               "upid string, time_ bigint, latency bigint, container_id string, "
                               "pid bigint, node_name string")
    dim = spark.createDataFrame([], "upid string, container_id string, pid bigint, node_name string")
    assert spans.with_process(df, dim).first()["pid"] == 0x3529


def test_endpoint_sides(spark):
    df = spark.createDataFrame(
        [("10.0.0.1", 2, "ns/me", "/"), ("10.0.0.9", 1, "ns/me", "/"), ("10.0.0.9", 2, "", "/")],
        "remote_addr string, trace_role int, pod string, req_path string")
    pods = spark.createDataFrame([("10.0.0.1", "ns/peer")], "ip string, pod_of_ip string")
    rows = sorted((r["source"], r["destination"], r["is_source_pod_type"], r["is_dest_pod_type"])
                  for r in filters.http_endpoints(df, pods).collect())
    assert rows == [("ns/me", "10.0.0.9", True, False), ("ns/peer", "ns/me", True, True)]


def test_namespace_filters(spark):
    df = spark.createDataFrame(
        [("honey", [1]), ("web", [1]), (None, [1]), ("web", None)], "ns string, args array<int>")
    assert filters.shipped_traces(df, "ns", "args").count() == 2
    k = spark.createDataFrame(
        [("process_exec", "", False), ("process_exec", "web", True), ("process_exit", "web", False),
         ("process_kprobe", "web", None), ("process_exec", None, False)],
        "type string, ns string, health boolean")
    assert filters.export_filter(k, "type", "ns", "health").collect()[0]["type"] == "process_kprobe"
    assert filters.export_filter(k, "type", "ns").count() == 2


def test_connect_line(spark):
    df = spark.createDataFrame(
        [("_pid:12 _comm:my app _saddr:10.0.0.1 _lport:80 _daddr:1.2.3.4 _dport:443",),
         ("nothing",)], "value string")
    a, b = filters.parse_connect_line(df).collect()
    assert tuple(a) == (12, "my app", "10.0.0.1", 80, "1.2.3.4", 443)
    assert set(b) == {None}
