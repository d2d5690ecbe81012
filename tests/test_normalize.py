"""Normalisers, rules and bundles on small logs of the real shapes."""

import json

import pytest
from pyspark.sql import functions as F

from watchfold import schemas
from watchfold.operators import bundles, normalize, rules as rule_ops
from watchfold.plans import api
from watchfold.sources import logs, rules as catalogue
from watchfold.sources.rules import CORE_RULES, Predicate, Rule

CONTAINER = "containerd://5b7e0c4d9a1f0cc175b9c0f1b6a831c399e26977266192eb5ffee6ae2fec3ad7"
NODE = "worker-blue-07"


def kernel_row(kind, pid, binary, arguments, args=None, function=None, start=".118273645Z"):
    payload = {
        "process": {
            "exec_id": "ZXhlYw==", "pid": pid, "uid": 0, "auid": 0, "cwd": "/", "binary": binary,
            "arguments": arguments, "flags": "execve", "start_time": "2031-02-11T07:45:09" + start,
            "pod": {"namespace": "default", "name": "kh-1",
                    "container": {"id": CONTAINER, "image": {"id": "img"}}},
        },
        "parent": {"exec_id": "cA==", "binary": "/bin/p", "arguments": "-x",
                   "parent_exec_id": "Zw=="},
    }
    if function:
        payload.update(function_name=function, args=args, action="KPROBE_ACTION_POST",
                       policy_name="p")
    return {"time": "2031-02-11T07:45:09.301020304Z", "node_name": NODE, "type": kind,
            "payload": payload}


def sample():
    """Thirteen rows: five execs and eight setns calls, one with the namespace flag
    as its second argument, one without arguments."""
    rows = [kernel_row("process_exec", 31415, "/bin/sh", "-c x")]
    rows += [kernel_row("process_exec", 27182, "/usr/bin/nsenter", "-t 1", start=".274400012Z")
             for _ in range(4)]
    for i in range(8):
        flag = 1073741824 if i == 3 else 0
        rows.append(kernel_row("process_kprobe", 27182, "/bin/bash", None if i == 7 else "-l",
                               [{"int_arg": 3}, {"int_arg": flag}], "__x64_sys_setns",
                               ".274400012Z"))
    return rows


@pytest.fixture(scope="module")
def kernel(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("kernel") / "log.json"
    init = {"time": "2031-02-12T00:00:00Z", "node_name": "init", "type": "process_exec",
            "payload": {"init": True}}
    lines = [json.dumps(init)] + [json.dumps(r) for r in sample()] + ["{broken"]
    path.write_text("\n".join(lines))
    return logs.read_kernel_long(spark, str(path))


def test_reader_drops_init_and_broken(kernel):
    assert kernel.count() == 13


def test_rules_on_kernel_logs(kernel):
    norm = normalize.normalize_kernel(kernel)

    def counts(layout):
        return {r["key"]: r["n"] for r in rule_ops.match_counts(
            rule_ops.match_rules(norm, CORE_RULES, layout)).collect()}

    assert counts("flat") == {"tree": 8}
    assert counts("nested") == {}
    assert counts("intended") == {"tree": 8, "nsenter": 1, "escapemount": 1}


def test_missing_arguments_print_as_none(kernel):
    norm = normalize.normalize_kernel(kernel)
    assert norm.where("command_line = '/bin/bash None'").count() == 1


def test_correlation_of_kernel_rows(kernel):
    got = {r[0][:35] for r in normalize.normalize_kernel(kernel).select("corr_id").collect()}
    assert got == {"310211T074509115b7e0c4d9a1f00031415", "310211T074509275b7e0c4d9a1f00027182"}


def test_bundle_objects(kernel):
    norm, built = api.kernel_bundles(kernel, layout="flat")
    docs = [json.loads(r[0]) for r in built.select(bundles.bundle_text()).collect()]
    assert len(docs) == 8
    for doc in docs:
        assert [o["type"] for o in doc["objects"]] == [
            "process", "observed-data", "relationship", "attack-pattern", "indicator",
            "relationship"]
        process, observed, link = doc["objects"][:3]
        assert observed["object_refs"] == [process["id"], "indicator--containerescapeplusmount"]
        assert link["source_ref"] == doc["id"]
        assert process["extensions"]["function_name"] == "__x64_sys_setns"
        assert process["extensions"]["kprobe0"] == ""


def test_nested_layout_of_objects(kernel):
    row = normalize.normalize_kernel(kernel).select(
        normalize.process_object().alias("p"), normalize.observed_object().alias("o")).first()
    assert "function_name" in json.loads(row.p)["extensions"]["x-tetra-ext"]
    assert json.loads(row.o)["extensions"]["x-tetra-ext"]["node_info"] == {"node_name": NODE}


def test_wide_form_promotes_arguments(spark, tmp_path):
    rows = [{"node_name": r["node_name"], "time": r["time"], r["type"]: r["payload"]}
            for r in sample()]
    (tmp_path / "w.json").write_text("\n".join(json.dumps(r) for r in rows))
    wide = logs.read_kernel_wide(spark, str(tmp_path))
    norm = normalize.normalize_kernel(logs.wide_to_long(wide))
    ks = sorted(tuple(r) for r in norm.select("k0", "k1", "k2").collect())
    assert ks.count(("3", "", "")) == 7 and ks.count(("3", "1073741824", "")) == 1
    assert ks.count(("", "", "")) == 5


ALERT = {
    "BaseRuntimeMetadata": {
        "alertName": "Unexpected system call", "arguments": {"syscall": "unshare"},
        "infectedPID": 60221, "severity": 1, "timestamp": "2030-11-05T21:08:47.412007009Z",
        "trace": {}},
    "CloudMetadata": "empty", "RuleID": "R0003",
    "RuntimeK8sDetails": {
        "containerID": "c0ffee15600d4a8a08f09d37b73795649038408b5f338277e0910d750195b448",
        "namespace": "webapp", "podName": "shop-frontend-7c4d-x2k9q",
        "podNamespace": "webapp"},
    "RuntimeProcessDetails": {"processTree": {
        "cmdline": "storefront --serve", "cwd": "/srv/store", "pcomm": "shop-init",
        "pid": 60221, "ppid": 60100}},
    "event": {"k8s": {"node": "ctrl-3"}, "timestamp": 1920143327412007009},
    "level": "error", "message": "Unexpected system call: unshare",
    "msg": "Unexpected system call", "time": "2030-11-05T21:08:47Z",
}


@pytest.fixture(scope="module")
def alert(spark):
    row = tuple(json.dumps(ALERT[k]) if k in logs.ALERT_NESTED and ALERT[k] != "empty"
                else ALERT[k] for k in schemas.ALERT_ROOT_KEYS)
    return logs.alerts_from_text(spark.createDataFrame([row, row], schemas.ALERT_TEXT))


def test_alert_object_rows(alert):
    rows = normalize.object_rows(normalize.normalize_alert(alert)).collect()
    assert len(rows) == 2
    for r in rows:
        assert (r["timestamp"], r["pod_name"], r["namespace"]) == (
            "2030-11-05T21:08:47Z", "shop-frontend-7c4d-x2k9q", "webapp")
        process, observed = json.loads(r["data"])
        assert observed["extensions"]["correlation"] == (
            "301105T210847Zc0ffee15600d000601003921529a2234")
        assert process["extensions"]["kprobe1.syscall"] == "unshare"
        assert process["extensions"]["kprobe2.trace"] == {}
        assert process["extensions"]["kprobe4.infectedPID"] == 60221
        assert observed["extensions"]["children"] == []


def test_alert_v1_uses_cloud_host(alert):
    row = normalize.normalize_alert(alert, v1_ids=True).first()
    assert row["pid"] == 60221
    assert row["corr_id"] == "301105T210847.41".replace(".", "") + "c0ffee15600d" + "00060221" + "0" * 12


def test_span_objects(spark):
    http = {
        "time_": 1919191919191, "remote_addr": "10.77.3.9", "remote_port": 40404,
        "local_addr": "10.77.3.4", "local_port": 8080, "req_method": "GET", "req_path": "/ping",
        "resp_status": 200, "req_headers": '{"Host": "10.77.3.4:8080"}', "pod_name": "http-pod",
        "namespace": "n", "container_id": "beadfeed0042", "pid": 4711,
    }
    df = spark.createDataFrame([tuple(http.get(f.name) for f in schemas.HTTP_SPAN)],
                               schemas.HTTP_SPAN)
    row = normalize.normalize_http(df).first()
    assert row["url"] == "http://10.77.3.4:8080/ping" and row["start"] == "2030-10-25T20:51:59Z"
    traffic, observed = (json.loads(o) for o in row["objects"])
    ext = traffic["extensions"][normalize.HTTP_EXTENSION]
    assert (ext["method"], ext["status_code"], ext["dst_port"]) == ("GET", 200, 8080)
    assert ext["raw_row"]["req_path"] == "/ping"
    assert observed["object_refs"] == [traffic["id"]]

    dns = {
        "time_": 1888777666555000000, "remote_addr": "10.99.1.2", "remote_port": 53,
        "local_addr": "-", "local_port": -1, "pod_name": "asks-names", "container_id": "c0ffee0042",
        "req_body": '{"queries": [{"name": "lamp.attic.example", "type": "AAAA"}]}',
        "resp_header": '{"txid": 808, "qr": 1, "rcode": 2}', "resp_body": '{"answers": []}',
        "pid": 4711,
    }
    df = spark.createDataFrame([tuple(dns.get(f.name) for f in schemas.DNS_SPAN)], schemas.DNS_SPAN)
    row = normalize.normalize_dns(df).first()
    assert (row["query_name"], row["query_type"], row["response_code"], row["answers"]) == (
        "lamp.attic.example", "AAAA", 2, [])


# --- the rule language -----------------------------------------------------------

def rule(*predicates):
    return Rule("r", "1", "r", "a", "a", "a", "i", "i", "i", "rel", tuple(predicates))


CMD, NS = "process:command_line", "process:extensions.namespace"


@pytest.mark.parametrize("predicates,expected", [
    ([Predicate(0, CMD, "=", "10.1.0.5")], {1}),
    ([Predicate(0, CMD, "!=", "10.1.0.5")], {2, 3}),
    ([Predicate(0, CMD, "=", "10.1.0.5", negated=True)], {2, 3}),
    ([Predicate(0, "process:pid", ">", 1, "int")], {2, 3, 4}),
    ([Predicate(0, "process:pid", "<=", 2.5, "float")], {1, 2}),
    ([Predicate(0, "process:pid", "IN", (1, 3), "int")], {1, 3}),
    ([Predicate(0, "process:pid", "IN", (1, 3), "int", True)], {2, 4}),
    ([Predicate(0, CMD, "LIKE", "10.%_5")], {1}),
    ([Predicate(0, CMD, "MATCHES", r"^\d+\.1")], {1}),
    ([Predicate(0, CMD, "MATCHES", "0.[12]")], {1, 2}),
    ([Predicate(0, CMD, "ISSUBSET", "10.1.0.0/16")], {1}),
    ([Predicate(0, CMD, "ISSUPERSET", "10.2.3.4/32")], {2}),
    ([Predicate(0, CMD, "EXISTS")], {1, 2, 3}),
    ([Predicate(0, CMD, "EXISTS", negated=True)], {4}),
    ([Predicate(0, "process:extensions.no_such", "EXISTS", negated=True)], {1, 2, 3, 4}),
    ([Predicate(0, "process:extensions.no_such", "=", "x", negated=True)], set()),
    ([Predicate(0, "process:cwd", "=", "746578740a", "hex", False)], set()),
    ([Predicate(0, "process:cwd", "=", "2f746d70", "hex")], {3}),
    ([Predicate(0, "process:cwd", "=", "L3RtcA==", "binary")], {3}),
    ([Predicate(0, "process:created_time", ">=", "2025-01-02T00:00:00Z", "timestamp")], {2, 3}),
    # AND binds tighter than OR
    ([Predicate(0, NS, "=", "a"), Predicate(0, "process:pid", "=", 1, "int"),
      Predicate(1, "process:pid", "=", 4, "int")], {1, 4}),
    ([Predicate(0, "process:extensions.kprobe_arguments.sock_arg.state", "=", "110")], {2}),
    ([Predicate(0, "process:extensions.kprobe_arguments.int_arg_1", "=", 7, "int")], {2}),
    ([Predicate(0, "process:extensions.kprobe_arguments.int_arg", "=", 7, "int")], {2, 3}),
    ([Predicate(0, "process:extensions.kprobe_arguments.flags[0]", "MATCHES", "RDONLY")], {4}),
    ([Predicate(0, "process:extensions.kprobe_arguments.flags[*]", "MATCHES", "CLOEXEC")], {4}),
    ([Predicate(0, "process:extensions.kprobe_arguments.value.name", "MATCHES", "magic")], {4}),
    ([Predicate(0, "process:extensions.kprobe0.file_arg.path", "MATCHES", "/run")], {3}),
])
def test_predicates(spark, predicates, expected):
    def arg(**kw):
        return tuple(kw.get(f.name) for f in schemas.ARG)

    sock = tuple("110" if f.name == "state" else None for f in schemas.SOCK_ARG)
    rows = [
        dict(pid=1, command_line="10.1.0.5", namespace="a", created_time="2025-01-01T00:00:00Z"),
        dict(pid=2, command_line="10.2.0.0/16", namespace="a", created_time="2025-01-02T00:00:00Z",
             args=[arg(sock_arg=sock), arg(int_arg=7)]),
        dict(pid=3, command_line="x", namespace="b", cwd="/tmp",
             created_time="2025-01-03T00:00:00Z",
             args=[arg(int_arg=7, file_arg=("/run/x", "r"))]),
        dict(pid=4, namespace="b", alert_flags=["O_RDONLY", "O_CLOEXEC"],
             trace_args={"0_value": "has magic", "0_name": "x"}),
    ]
    df = spark.createDataFrame(
        [tuple({"source": "kernel", **r}.get(f.name) for f in schemas.NORM) for r in rows],
        schemas.NORM)
    hit = df.where(rule_ops.rule_column(rule(*predicates), "intended"))
    assert {r["pid"] for r in hit.collect()} == expected


def test_trace_paths_need_the_trace_source(spark):
    rows = [dict(source=s, pid=i, trace_args={"0_value": "magic"})
            for i, s in enumerate(["trace", "kernel"])]
    df = spark.createDataFrame([tuple(r.get(f.name) for f in schemas.NORM) for r in rows],
                               schemas.NORM)
    p = Predicate(0, "process:extensions.kprobe_arguments.0_value", "=", "magic")
    assert [r["pid"] for r in df.where(rule_ops.rule_column(rule(p))).collect()] == [0]


def test_catalogue_sizes_and_text():
    assert [len(catalogue.CATALOGUES[n]) for n in ("core", "posted", "calibration")] == [18, 17, 7]
    assert len({r.key for r in CORE_RULES}) == 18
    by_key = {r.key: catalogue.pattern_text(r) for r in CORE_RULES}
    assert by_key["module-load"] == (
        "[process:command_line MATCHES 'modprobe' AND "
        "process:extensions.function_name MATCHES 'sys_init_module']")
    assert "= 1073741824 OR " in by_key["escapemount"]


def test_rules_survive_tables(spark):
    back = catalogue.load_rules(catalogue.rules_frame(spark, CORE_RULES),
                                catalogue.predicates_frame(spark, CORE_RULES))
    want = {r.key: sorted(map(repr, r.predicates)) for r in CORE_RULES}
    assert {r.key: sorted(map(repr, r.predicates)) for r in back} == want
    rest = {r.key: (r.references, r.target_ref, catalogue.pattern_text(r)) for r in back}
    assert rest == {r.key: (r.references, r.target_ref, catalogue.pattern_text(r)) for r in CORE_RULES}


def test_rules_over_several_logs(spark, kernel):
    two = Rule("two", "1", "n", "a", "a", "a", "i", "i", "i", "r", (
        Predicate(0, CMD, "MATCHES", "nsenter"), Predicate(0, CMD, "MATCHES", "bash", observation=1)),
        combine="FOLLOWEDBY", within=60.0)
    assert catalogue.pattern_text(two) == (
        "([process:command_line MATCHES 'nsenter'] FOLLOWEDBY [process:command_line MATCHES 'bash']) "
        "WITHIN 60 SECONDS")
    with pytest.raises(ValueError):
        rule_ops.match_rules(kernel, [two])
    rows = [("p", 0, "nsenter"), ("p", 50, "bash"), ("p", 61, "bash"), ("q", 5, "bash"), ("q", 6, "nsenter")]
    logs_ = spark.createDataFrame([(k, t * 10**9, c) for k, t, c in rows], "pod string, ns bigint, command_line string")
    got = rule_ops.match_sequences(logs_, [two], ["pod"], "ns").collect()
    assert [(r.rule, r.pod, r.ns) for r in got] == [("two", "p", 50 * 10**9)]
    three = Rule("three", "1", "n", "a", "a", "a", "i", "i", "i", "r", (
        *two.predicates, Predicate(0, CMD, "MATCHES", "nsenter", observation=2)), combine="FOLLOWEDBY")
    assert rule_ops.match_sequences(logs_, [three], ["pod"], "ns").count() == 0


def test_rule_store(spark, tmp_path):
    store = catalogue.RuleStore(spark, str(tmp_path / "rules"))
    assert store.list() == {}
    assert [store.add(r) for r in CORE_RULES[:3]] == [1, 2, 3]
    store.delete(2)
    assert {i: r.key for i, r in store.list().items()} == {1: "nsenter", 3: "priv-mount"}
    assert store.add(CORE_RULES[3]) == 4
    assert store.list()[1] == CORE_RULES[0]


def test_long_catalogue_is_chunked(spark, kernel):
    many = [Rule(f"k{i}", "1", "n", "a", "a", "a", "i", "i", "i", "r",
                 (Predicate(0, CMD, "MATCHES", "bash" if i % 50 == 0 else f"no{i}"),))
            for i in range(250)]
    norm = normalize.normalize_kernel(kernel)
    got = rule_ops.match_rules(norm, many).select(F.size("matches")).distinct().collect()
    assert [r[0] for r in got] == [5]


def test_store_keys(kernel):
    matched = rule_ops.match_rules(normalize.normalize_kernel(kernel), CORE_RULES, "intended")
    rows = matched.select("matches", bundles.store_key(CORE_RULES).alias("last"),
                          bundles.store_key(CORE_RULES, per_match=True).alias("all")).collect()
    three = [r for r in rows if len(r["matches"]) == 3]
    assert len(three) == 1
    assert [k.split(":")[0] for k in three[0]["all"]] == ["1", "12", "13"]
    assert three[0]["last"].startswith("13:")


def test_what_a_match_must_hold():
    from watchfold.operators.rule_index import required_text

    for regex, want in {
        "nsenter": "nsenter", "/bin/(ba)?sh": "/bin/", r"a\.conf$": "a.conf", "abc|def": None, "(?i)abc": None,
        "abcd?ef": "abc", "abcd*": "abc", "abcd+e": "abcd", "x{0,3}abcd{0}": "abc", "x{2}abcd": "abcd", r"\d+tok[a-z]{3}end": "tok",
        r"\Qa.b\E": None, "a.b": None, "[abc]def[^]]": None, "abc(d(e|f)[)])ghij": "ghij", "abc(": None, "": None, "a+?bcd": "bcd",
    }.items():
        assert required_text(regex) == want, regex


def test_indexed_rules_equal_each_rule_by_itself(spark):
    from watchfold.operators.rule_index import match_indexed

    texts = ["nsenter -t 1 sh", "/bin/bash -c ls", "/bin/sh", "cat /etc/a.conf", "cat aXconf", "", None, "ééé öö", "nsenter -t 1 sh"]
    logs_ = spark.createDataFrame([(i, t, f) for i, t in enumerate(texts * 20) for f in ("f", "g", None)],
                                  "i long, command_line string, function_name string")
    rules = [(1, "nsenter", None), (2, "/bin/(ba)?sh", "f"), (3, r"a\.conf$", None), (4, "ls|sh", "g"), (5, "ééé ö+", None),
             (6, "not there", None), (7, "^$", None), (8, "(?i)NSENTER", "f"), (9, "nsenter", "g")]
    frame = spark.createDataFrame(rules, "key long, regex string, function_name string")
    got = sorted((r.i, r.function_name or "", r.key) for r in match_indexed(logs_, frame, salt_by=["i"], rows_per_task=40).collect())
    want = []
    for key, regex, function in rules:
        hit = logs_.where(F.col("command_line").rlike(regex))
        if function:
            hit = hit.where(F.col("function_name") == function)
        want += [(r.i, r.function_name or "", key) for r in hit.collect()]
    assert got == sorted(want) and len({k for *_, k in got}) == 8
    no_function = match_indexed(logs_, frame.drop("function_name"), function=None, salt_by=["i"])
    assert no_function.where("key = 9").count() == logs_.where("command_line LIKE '%nsenter%'").count()
