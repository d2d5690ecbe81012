"""Joins, groupings and sequences against brute force on random small data."""

import random

import pytest
from pyspark.sql import functions as F

from watchfold.operators import baseline, bundles, context, graph, policies, sequences, skew
from watchfold.plans import api
from watchfold.sources import bundles as bundle_io

W = 15


def two_sides(spark, seed, hot=False):
    rnd = random.Random(seed)
    span = 100 if hot else 600
    left = [(i, rnd.choice("ab"), rnd.randint(-span, span)) for i in range(60)]
    right = [(i, rnd.choice("ab"), rnd.randint(0, 3) if hot and i % 3 else rnd.randint(-span, span))
             for i in range(120)]
    return left, right, spark.createDataFrame(left, "lid int, pod string, lt bigint"), (
        spark.createDataFrame(right, "rid int, pod string, rt bigint"))


@pytest.mark.parametrize("seed,hot,by,rows_per_task", [
    (1, False, [], 4_000_000), (2, False, ["pod"], 4_000_000), (3, True, [], 5), (4, True, ["pod"], 3),
])
def test_interval_join(spark, seed, hot, by, rows_per_task):
    left, right, ldf, rdf = two_sides(spark, seed, hot)
    if not by:
        rdf = rdf.drop("pod")
    got = context.interval_join(ldf, rdf, "lt", "rt", W, by=by, salt_by=["rid"], rows_per_task=rows_per_task)
    want = sorted((x[0], y[0]) for x in left for y in right
                  if abs(x[2] - y[2]) < W and (not by or x[1] == y[1]))
    assert sorted((r["lid"], r["rid"]) for r in got.collect()) == want


@pytest.mark.parametrize("seed,hot,by", [(1, False, []), (2, False, ["pod"]), (3, True, ["pod"]),
                                         (4, True, [])])
def test_near_any(spark, seed, hot, by):
    left, right, ldf, rdf = two_sides(spark, seed, hot)
    right = right[:12]
    rdf = rdf.where("rid < 12")
    if not by:
        rdf = rdf.drop("pod")
    got = context.near_any(ldf, rdf, "lt", "rt", "near", ["lid"], W, by)
    want = {x[0]: any(abs(x[2] - y[2]) < W and (not by or x[1] == y[1]) for y in right)
            for x in left}
    assert {r["lid"]: r["near"] for r in got.collect()} == want
    assert len(set(want.values())) == 2


def test_context_pages_are_bounded_and_whole(spark):
    left, right, ldf, rdf = two_sides(spark, 9, hot=True)
    pairs = context.interval_join(ldf, rdf.drop("pod"), "lt", "rt", W, salt_by=["rid"])
    pages = context.context_arrays(ldf, pairs, "lid", ["rid", "rt"], "spans", 5).collect()
    assert max(len(p["spans"]) for p in pages) <= 5
    got = sorted((p["lid"], s["rid"]) for p in pages for s in p["spans"])
    assert got == sorted((r["lid"], r["rid"]) for r in pairs.collect())
    assert {p["lid"] for p in pages} == {x[0] for x in left}


@pytest.mark.parametrize("seed,hot,page_size,run_rows", [(1, False, 4, 1000), (3, True, 4, 5), (5, True, 1, 1), (9, True, 7, 8)])
def test_pages_cut_of_runs_are_those_of_the_pairs(spark, seed, hot, page_size, run_rows):
    _, _, ldf, rdf = two_sides(spark, seed, hot)
    odd = [(None, "a", 1), (None, "a", 1), (60, "a", None), (61, "a", 5000), (62, "b", 2), (62, "b", 2), (62, "c", 2),
           (63, "a", 1), (63, "a", 9), (64, "a", 2), (64, "b", None), (65, "a", -30)] + [(66, "a", 3)] * 101
    ldf = ldf.union(spark.createDataFrame(odd, ldf.schema))
    rdf = rdf.union(spark.createDataFrame([(7, "a", None), (None, "a", 2), (3, "b", 2), (3, "b", 2)], rdf.schema)).drop("pod")
    pairs = context.interval_join(ldf, rdf, "lt", "rt", W, salt_by=["rid"])
    want = context.context_arrays(ldf, pairs, "lid", ["rt", "rid"], "spans", page_size)
    got = context.context_arrays(ldf, rdf, "lid", ["rt", "rid"], "spans", page_size, ("lt", "rt", W), run_rows)
    assert got.columns == want.columns and got.schema["page"].dataType == want.schema["page"].dataType
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_a_span_stands_in_one_run(spark):
    """But for those at the borders of runs, which a page may need from the run before."""
    spans = spark.range(3000).select((F.col("id") % 45).alias("rt"), F.col("id").cast("int").alias("rid"))
    listed = context._runs(spans, ["rt", "rid"], W, 4, 100).collect()
    assert sum(len(r["_listed"]) for r in listed) < 3200
    assert max(len(r["_listed"]) for r in listed) < 210


@pytest.mark.parametrize("page_size,run_rows", [(4, 20), (20, 20), (50, 50)])
def test_pages_over_short_and_full_buckets(spark, page_size, run_rows):
    rnd = random.Random(page_size)
    times = [rnd.choice([rnd.randint(0, 40), rnd.randint(60, 90), rnd.randint(-300, 300)]) for _ in range(400)]
    rdf = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "rid int, rt bigint")
    alerts = [(i % 70, rnd.randint(-320, 320)) for i in range(70)]
    ldf = spark.createDataFrame([*alerts, *alerts[:20], *alerts[:5]], "lid int, lt bigint")
    pairs = context.interval_join(ldf, rdf, "lt", "rt", W, salt_by=["rid"])
    want = context.context_arrays(ldf, pairs, "lid", ["rt", "rid"], "spans", page_size)
    got = context.context_arrays(ldf, rdf, "lid", ["rt", "rid"], "spans", page_size, ("lt", "rt", W), run_rows)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_pairs_of_context_pages_are_not_shuffled(spark):
    _, _, ldf, rdf = two_sides(spark, 9, hot=True)
    near = ("lt", "rt", W)
    pages = context._pages_of_runs(ldf, context._ids(ldf, "lid", "lt"), rdf, "lid", ["rt", "rid"], "spans", 4, near, 1000)
    plan = pages._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Join") < plan.index("Exchange")
    with pytest.raises(ValueError):
        context.context_arrays(ldf, rdf, "lid", ["rid", "rt"], "spans", 4, near)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(spark, how):
    left = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(90)],
                                 "id int, k string")
    right = spark.createDataFrame([("hot", 1), ("k3", 2), ("zz", 3)], "k string, v int")
    salted = skew.salted_join(left, right, ["k"], how, ["id"])
    plain = left.join(right, ["k"], how)
    assert sorted(map(str, salted.select(plain.columns).collect())) == sorted(
        map(str, plain.collect()))


def test_dedupe_is_idempotent_and_first(spark):
    rnd = random.Random(5)
    rows = [(f"k{rnd.randint(0, 9)}" if i % 3 else "hot", rnd.randint(0, 50), str(i))
            for i in range(300)]
    df = spark.createDataFrame(rows, "dedup_key string, event_ts_ns bigint, corr_id string")
    once = baseline.dedupe(df)
    first = {}
    for key, t, c in sorted(rows, key=lambda r: (r[1], r[2])):
        first.setdefault(key, (key, t, c))
    assert {tuple(r) for r in once.collect()} == set(first.values())
    assert sorted(map(tuple, baseline.dedupe(once).collect())) == sorted(first.values())
    spread = df.repartition(7, "corr_id")
    assert sorted(map(tuple, baseline.dedupe(spread).collect())) == sorted(first.values())


def test_wildcard_profile_against_brute_force(spark):
    rnd = random.Random(7)
    seg = ["proc", "1", "task", "fd", "etc"]
    mark = bundle_io.WILDCARD

    def path(wild):
        return "/" + "/".join(
            mark if wild and rnd.random() < .4 else rnd.choice(seg)
            for _ in range(rnd.randint(1, 4)))

    profile = [(f"w{rnd.randint(0, 2)}", "open", path(True)) for _ in range(25)]
    seen = [(i, f"w{rnd.randint(0, 2)}", "open", path(False)) for i in range(300)]

    def allowed(w, k, e):
        parts = e.split("/")
        for pw, pk, pe in profile:
            ps = pe.split("/")
            if (pw, pk) == (w, k) and len(ps) == len(parts) and all(
                    a == mark or a == b for a, b in zip(ps, parts)):
                return True
        return False

    df = spark.createDataFrame(seen, "id int, workload string, kind string, entry string")
    pdf = spark.createDataFrame(profile, "workload string, kind string, entry string")
    got = {r["id"] for r in baseline.deviations_wildcard(df, pdf, ["id"]).collect()}
    assert got == {i for i, w, k, e in seen if not allowed(w, k, e)}
    assert 0 < len(got) < 300


def test_profile_documents_become_rows(spark):
    doc = [("Deployment", "web", "ns", [(
        "app", ["NET_RAW"], [(":80/ping", "inbound", ["GET"])],
        [("/bin/sh", ["/bin/sh", "-c"])], [("/proc/⋯/mounts", ["O_RDONLY"])], ["read"])])]
    df = spark.createDataFrame(doc, """workload_kind string, workload string, namespace string,
        containers array<struct<name:string, capabilities:array<string>,
        endpoints:array<struct<endpoint:string,direction:string,methods:array<string>>>,
        execs:array<struct<path:string,args:array<string>>>,
        opens:array<struct<path:string,flags:array<string>>>, syscalls:array<string>>>""")
    rows = {r["kind"]: (r["entry"], r["detail"], r["is_wildcard"])
            for r in bundle_io.profile_from_documents(df).collect()}
    assert rows == {
        "capability": ("NET_RAW", None, False), "endpoint": (":80/ping", "inbound GET", False),
        "exec": ("/bin/sh", "/bin/sh -c", False), "open": ("/proc/⋯/mounts", "O_RDONLY", True),
        "syscall": ("read", None, False)}


def test_block_table(spark):
    rnd = random.Random(3)
    ips = [f"10.{rnd.randint(0, 3)}.{rnd.randint(0, 255)}.{rnd.randint(0, 255)}" for _ in range(200)]
    blocks = [f"10.{rnd.randint(0, 3)}.{rnd.randint(0, 255)}.0/{rnd.randint(8, 32)}"
              for _ in range(40)] + ["10.1.2.3", "bad"]
    import ipaddress

    want = sorted((a, b) for a in set(ips) for b in set(blocks) if b != "bad" and
                  ipaddress.ip_address(a) in ipaddress.ip_network(b, strict=False))
    got = policies.in_block_table(
        spark.createDataFrame([(a,) for a in set(ips)], "ip string"), "ip",
        spark.createDataFrame([(b,) for b in set(blocks)], "block string"), "block")
    assert sorted((r["ip"], r["block"]) for r in got.collect()) == want


def objects_for(rnd, i):
    import json

    n = rnd.randint(1, 4)
    out = []
    for j in range(n):
        fields = [("type", rnd.choice(["process", "indicator"])), ("id", f"x--{i}-{j}"),
                  ("created", str(i)), ("pid", rnd.randint(0, 2)),
                  rnd.choice([
                      ("ext", {"b": rnd.randint(0, 1), "a": [1, {"z": 1.50, "y": 2}]}),
                      ("refs", ["a", "b"][:rnd.randint(1, 2)]), ("rate", 0.5), ("name", "x")])]
        rnd.shuffle(fields)
        out.append(json.dumps(dict(fields), separators=rnd.choice([(",", ":"), (", ", ": ")])))
    return out


@pytest.mark.parametrize("keep_first", [False, True])
def test_consolidation_against_pairwise_comparison(spark, keep_first):
    import json

    rnd = random.Random(11)
    rows = [(f"b{i:03d}", rnd.randint(0, 2), i // 2, objects_for(rnd, i)) for i in range(60)]
    df = spark.createDataFrame(
        rows, "bundle_id string, rule_id bigint, seen bigint, objects array<string>")

    def core(o):
        return {k: v for k, v in json.loads(o).items()
                if k not in ("id", "created", "modified", "spec_version")}

    want = {}
    for bid, rid, seen, objs in sorted(rows, key=lambda r: (r[2], r[0])):
        if rid not in want:
            want[rid] = (bid, list(objs) if keep_first else [])
            if keep_first:
                continue
        kept = want[rid][1]
        for o in objs:
            if not any(core(o) == core(x) for x in kept):
                kept.append(o)
    for frame in (df, df.repartition(5)):
        got = {}
        merged = bundles.consolidate_by_rule(frame, ["seen"], keep_first_whole=keep_first)
        for r in merged.collect():
            got.setdefault(r["group_key"], (r["merged_id"], []))[1].append(r["object"])
        assert {k: (v[0], sorted(v[1])) for k, v in got.items()} == {
            k: (v[0], sorted(v[1])) for k, v in want.items()}


def test_bundle_parts_are_bounded_ordered_and_whole(spark):
    import json

    rows = [(f"b{i:04d}", 0 if i % 3 else i, i,
             [json.dumps({"type": "process", "id": str(i), "pid": i})]) for i in range(200)]
    df = spark.createDataFrame(
        rows, "bundle_id string, rule_id bigint, seen bigint, objects array<string>")
    merged = bundles.consolidate_by_rule(df, ["seen"])
    parts = bundles.bundle_parts(merged, ["seen"], 10).collect()
    assert max(len(p["objects"]) for p in parts) <= 10
    assert sorted(o for p in parts for o in p["objects"]) == sorted(o for r in rows for o in r[3])
    for p in parts:
        pids = [json.loads(o)["pid"] for o in p["objects"]]
        assert pids == sorted(pids)
        assert len(json.loads(p["bundle"])["objects"]) == len(pids)


@pytest.mark.parametrize("seed", [1, 2])
def test_descendants_and_ancestry(spark, seed):
    rnd = random.Random(seed)
    parent = {i: (rnd.randint(0, i - 1) if i and rnd.random() < .9 else None) for i in range(80)}
    parent[300] = 999  # a parent that is not in the log
    roots = {i for i in parent if i % 17 == 3}
    df = spark.createDataFrame([(i, p) for i, p in parent.items()], "id bigint, parent_id bigint")

    def chain(i):
        out, at = [], parent.get(i)
        while at is not None and len(out) < 100:
            out.append(at)
            at = parent.get(at)
        return out

    want = {i for i in parent if i in roots or roots & set(chain(i))}
    got = graph.descendants_of(df, F.col("id") % 17 == 3)
    assert {r["id"] for r in got.collect()} == want
    up = graph.ancestry(df.where("id < 200"))
    assert sorted(tuple(r) for r in up.collect()) == sorted(
        (i, a, d + 1) for i in parent if i < 200 for d, a in enumerate(chain(i)))


def sequence_rows(seed):
    rnd = random.Random(seed)
    return [(i, "hot" if i % 3 else f"p{rnd.randint(0, 2)}", rnd.randint(0, 200) * 500_000_000,
             rnd.choice("abc")) for i in range(150)]


def test_sequences_against_brute_force(spark):
    rows = sequence_rows(4)
    df = spark.createDataFrame(rows, "id int, pod string, ns bigint, kind string")
    a, b = F.col("kind") == "a", F.col("kind") == "b"

    got = sequences.followed_by(df, ["pod"], "ns", a, b, ["id"])
    want = {y[0] for y in rows if y[3] == "b" and any(
        x[3] == "a" and x[1] == y[1] and x[2] < y[2] for x in rows)}
    assert {r["id"] for r in got.collect()} == want

    for seconds in (1, 3, 10):
        reach = seconds * 10**9
        got = sequences.followed_within(df, ["pod"], "ns", a, b, seconds, ["id"])
        near = {y[0]: {x[2] for x in rows if x[3] == "a" and x[1] == y[1]
                       and 0 < y[2] - x[2] <= reach} for y in rows if y[3] == "b"}
        assert {r["id"] for r in got.collect()} == {i for i, s in near.items() if s}
        assert all(r["first_ns"] in near[r["id"]] for r in got.collect())

        got = sequences.repeats(df, ["pod"], "ns", a, 2, seconds)
        want = {}
        for _, pod, ns, kind in rows:
            if kind == "a":
                n = sum(1 for x in rows if x[3] == "a" and x[1] == pod and 0 <= ns - x[2] <= reach)
                if n >= 2:
                    want[(pod, ns)] = n
        assert {(r["pod"], r["ns"]): r["repeats"] for r in got.collect()} == want


def test_cooldown_and_equilibrium(spark):
    rows = [(i, "hot" if i % 3 else "cold", i * 60) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, rule string, s bigint").withColumn(
        "ts", F.timestamp_seconds("s"))
    out = baseline.cooldown(df, ["rule"], "ts", "30 minutes", 4, ["id"]).collect()
    want = []
    for rule in ("hot", "cold"):
        for period in (0, 1):
            want += [r[0] for r in rows if r[1] == rule and r[2] // 1800 == period][:4]
    assert sorted(r["id"] for r in out) == sorted(want)


def test_oldest_after_mark_loses_no_ties(spark):
    df = spark.createDataFrame([(5, i) for i in range(30)] + [(6, 1), (4, 9)], "t int, id int")
    mark, seen = (4, 9), []
    while True:
        batch = api.oldest_after(df, "t", mark, 10, ["id"]).collect()
        if not batch:
            break
        seen += [tuple(r) for r in batch]
        mark = tuple(batch[-1])
    assert seen == [(5, i) for i in range(30)] + [(6, 1)]


def test_scored_bundle_end_to_end(spark):
    from watchfold import schemas
    from watchfold.plans import standins as si

    ev = spark.createDataFrame(
        [(i, 1, "error", 1.0, '{"k": 9}', f"2024-01-01 00:00:{i:02d}") for i in range(3)]
        + [(10, 1, "signup", 1.0, '{"k": 9}', "2024-01-01 00:00:05")],
        "event_id bigint, user_id bigint, event_type string, value double, props string, ts string"
    ).withColumn("ts", F.to_timestamp("ts"))
    ev = si.event_fields(ev)
    alerts = si.alerts(ev.where("event_type = 'error'")).drop("event_id")
    kernel = si.kernel_long(ev.where("event_type = 'signup'").withColumn("event_id", F.lit(1)))
    dns = si.dns_spans(ev.where("event_type = 'signup'")).drop("event_id")
    http = si.http_spans(ev.where("event_type = 'signup'")).drop("event_id").withColumn(
        "trace_role", F.lit(1).cast("smallint"))
    pods = spark.createDataFrame([], "ip string, pod_of_ip string")
    rows = api.scored_bundle(alerts, kernel, dns, http, pods).orderBy("timestamp").collect()
    # security.ubuntu.com near (+1.5) and an InRelease request near (+1.0)
    assert [float(r["score"]) for r in rows] == [2.5, 2.5, 2.5]
    assert [r["severity"] for r in rows] == ["Medium"] * 3
    assert [r["pid"] for r in rows] == [0, 1, 2]
    assert len(schemas.RESULT_TABLES) == 9


@pytest.mark.parametrize("score,band", [
    ("0.0", "Low"), ("2.0", "Low"), ("2.3", "Medium"), ("5.0", "Medium"), ("5.3", "High"),
    ("7.0", "High"), ("7.3", "Critical"), ("8.8", "Critical"),
])
def test_band_edges(spark, score, band):
    c = context.band_column(F.lit(score).cast("decimal(4,1)"))
    assert spark.range(1).select(c).first()[0] == band


def test_severity_terms(spark):
    def score(**kw):
        base = dict(exec_id=None, uid=None, auid=None, tree=None, args=None, dns=False, http=False)
        base.update(kw)
        types = {"exec_id": "string", "uid": "bigint", "auid": "bigint", "tree": "boolean",
                 "args": "string", "dns": "boolean", "http": "boolean"}
        flags = context.severity_flags(*[F.lit(base[k]).cast(t) for k, t in types.items()])
        return float(spark.range(1).select(context.score_column(flags)).first()[0])

    assert score() == 0
    assert score(exec_id="XX-UNExpected") == 3
    assert score(uid=0, auid=0, tree=False) == 2
    assert score(uid=0, auid=0, tree=True) == 1 == score(uid=0, auid=0)
    assert score(uid=0, auid=1) == 0
    assert score(args="APT update") == 1.3
    assert score(exec_id="unexpected", uid=0, auid=0, tree=False, args="apt", dns=True,
                 http=True) == 8.8


def test_follow_pids_and_negation(spark):
    lineage = spark.createDataFrame(
        [("a", None, "/bin/sh", 1), ("b", "a", "x", 5), ("c", "b", "x", 6), ("d", None, "y", 7)],
        "id string, parent_id string, binary string, pid int")
    ev = spark.createDataFrame([(i, e) for i, e in enumerate("abcdd")], "n int, exec_id string")

    def got(**kw):
        return sorted(r["n"] for r in policies.followed(ev, lineage, **kw).collect())

    assert got(binaries=policies.SHELL_BINARIES) == [0, 1, 2]
    assert got(pids=(5,)) == [1, 2]
    assert got(pids=(0, 1), negated=True) == [3, 4]


def test_pid_namespace_selector(spark):
    from watchfold import schemas

    df = spark.createDataFrame(
        [(1, "", "/proc/3/root"), (2, "containerd://x", "/proc/3/root/etc"),
         (3, "containerd://x", "/proc/30/rootx")], "n int, con string, path string")
    payload = F.from_json(F.to_json(F.struct(
        F.struct(F.struct(F.struct(F.col("con").alias("id")).alias("container")).alias("pod"))
        .alias("process"),
        F.array(F.struct(F.lit(None).cast("string").alias("string_arg")),
                F.struct(F.col("path").alias("string_arg"))).alias("args"))),
        schemas.KERNEL_PAYLOAD)
    df = df.withColumn("payload", payload)
    policy = next(p for p in policies.POLICIES if p.name == "detect-share-ps-namespace")
    hit = policies.tag_policies(df, [policy], F.lit("__x64_sys_openat"),
                                policies.kernel_fields(F.col("payload")))
    assert [r["n"] for r in hit.collect()] == [2]


def test_a_deep_chain_is_whole(spark):
    df = spark.createDataFrame([(i, i - 1 if i else None) for i in range(40)], "id bigint, parent_id bigint")
    got = {(r.id, r.ancestor_id, r.depth) for r in graph.ancestry(df).collect()}
    assert got == {(i, j, i - j) for i in range(40) for j in range(i)} and len(got) == 780
    assert graph.descendants_of(df, F.col("id") == 0).count() == 40


def test_a_cycle_is_an_error(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1)], "id bigint, parent_id bigint")
    with pytest.raises(ValueError):
        graph.ancestry(df)
    with pytest.raises(ValueError):
        graph.descendants_of(df, F.col("id") == 9)


def test_lineage_takes_one_log(spark):
    row = "struct<process:struct<exec_id:string,parent_exec_id:string,binary:string,pid:bigint>>"
    df = spark.createDataFrame([("t1", (("a", "z", "/bin/a", 9),)), ("t2", (("a", "b", "/bin/b", 3),))],
                               f"time string, payload {row}")
    assert [tuple(r) for r in graph.lineage_of(df).collect()] == [("a", "b", "/bin/b", 3)]


def test_few_pairs_are_one_array(spark):
    left, right, ldf, rdf = two_sides(spark, 9, hot=True)
    pairs = context.interval_join(ldf, rdf.drop("pod"), "lt", "rt", W, salt_by=["rid"])
    pages = context.context_arrays(ldf, pairs, "lid", ["rt", "rid"], "spans").collect()
    assert len(pages) == len(left) and {p["page"] for p in pages} == {0}
    assert all([tuple(x) for x in p["spans"]] == sorted(tuple(x) for x in p["spans"]) for p in pages)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_split_join_of_a_hot_key(spark, how):
    left = spark.createDataFrame([(i, 7 if i % 10 else i) for i in range(400)], "id int, k int")
    right = spark.createDataFrame([(7, "a"), (7, "b"), (20, "c"), (999, "d")], "k int, v string")
    got = skew.split_join(left, right, ["k"], how, ["id"], rows_per_task=50)
    want = left.join(right, "k", how)
    assert sorted(map(repr, got.select(want.columns).collect())) == sorted(map(repr, want.collect()))


def test_one_parent_of_nearly_all(spark):
    df = spark.createDataFrame([(i, (1 if i % 10 else 2) if i > 2 else (0 if i else None)) for i in range(300)],
                               "id bigint, parent_id bigint")
    assert graph.descendants_of(df, F.col("id") == 0, rows_per_task=20).count() == 300
    assert sorted(map(tuple, graph.ancestry(df, rows_per_task=20).collect())) == sorted(
        map(tuple, graph.ancestry(df).collect()))


def test_one_block_of_nearly_all(spark):
    rows = spark.createDataFrame([(i, f"10.{i % 3 == 0 and 9 or 1}.0.{i % 200}") for i in range(300)], "i int, ip string")
    blocks = spark.createDataFrame([("a", "10.1.0.0/16"), ("b", "10.0.0.0/8")], "name string, block string")
    got = policies.in_block_table(rows, "ip", blocks, "block", rows_per_task=25)
    assert got.groupBy("name").count().sort("name").collect() == [("a", 200), ("b", 300)]
    assert set(got.columns) == {"i", "ip", "name", "block"}


def test_a_filter_of_keys_lets_no_key_go(spark):
    keys = spark.range(5000).select(F.concat(F.lit("k"), F.col("id")).alias("k"), (F.col("id") % 7).alias("m"))
    rows = keys.union(spark.range(5000, 45_000).select(F.concat(F.lit("k"), F.col("id")), F.lit(1))).union(
        spark.sql("SELECT NULL, 1"))
    got = baseline.maybe_in(rows, keys, ["k", "m"], 5000)
    assert got.columns == ["k", "m", "_maybe"] and got.count() == 45_001
    assert got.join(keys, ["k", "m"], "left_semi").where("NOT _maybe").count() == 0
    assert got.join(keys, ["k", "m"], "left_anti").where("_maybe").count() < 40_000 / 30
    none = baseline.maybe_in(rows, keys.limit(0), ["k", "m"], 0)
    assert none.where("_maybe").count() == 0


def test_benign_logs_by_filter_and_by_join(spark, monkeypatch):
    logs = spark.createDataFrame([(f"k{i % 40}" if i % 9 else None, i) for i in range(400)], "dedup_key string, id long")
    marks = spark.createDataFrame([(f"k{i}",) for i in range(0, 80, 2)] + [(None,)], "dedup_key string")
    want = sorted(r.id for r in logs.collect() if r.dedup_key is None or int(r.dedup_key[1:]) % 2)
    for most in (baseline.MOST_FILTERED, 0):
        monkeypatch.setattr(baseline, "MOST_FILTERED", most)
        assert sorted(r.id for r in baseline.drop_benign(logs, marks, salt_by=["id"]).collect()) == want


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 1, 0), (1, 0, 2)])
def test_increments_equal_one_merge(spark, order):
    import json

    rows = [(f"b{i}", f"r{i % 3}", i // 2, [json.dumps({"type": "t", "id": str(i), "v": i % 5}), json.dumps({"type": "u", "v": i % 2})])
            for i in range(60)]
    df = spark.createDataFrame(rows, "bundle_id string, rule_id string, seen long, objects array<string>")
    state = None
    for part in order:
        state = bundles.consolidate_increment(state, df.where(F.col("seen") % 3 == part), F.col("rule_id"), ["seen"])
    columns = ["group_key", "merged_id", "bundle_id", "pos", "type", "fingerprint", "object"]
    got = sorted(map(tuple, bundles.merged_state(state, ["seen"]).select(columns).collect()))
    assert got == sorted(map(tuple, bundles.consolidate_by_rule(df, ["seen"]).select(columns).collect())) != []
