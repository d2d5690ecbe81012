"""The query catalogue: every operator over whole tables.

Each entry takes (spark, folder) and returns a DataFrame. Security logs are not
among the tables, so queries start from the projections in ``standins``. The
matching SQL is in ``oracles``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import fingerprints, ids, net, text, times
from ..operators import (
    baseline, bundles, context, filters, graph, normalize, observations, policies, sequences,
)
from ..operators import rules as rule_ops
from ..operators.barrier import once
from ..operators.observations import Observed
from ..operators.rule_index import counts_indexed
from ..operators.skew import spread
from ..session import cut_lineage, scratch_dir
from ..sources import bundles as bundle_io
from ..sources import logs, sinks, spans, tail
from ..sources.rules import (
    CALIBRATION_RULES, CORE_RULES, Predicate, Rule, edges_frame, load_rules, predicates_frame,
    rules_frame,
)
from ..streaming import pipelines
from . import api
from . import standins as si

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _kernel_norm(spark, d, **kw):
    return normalize.normalize_kernel(si.kernel_long(si.events(spark, d)), **kw)


# --- identifiers, times, text ------------------------------------------------------

@query
def corr_id(spark, d):
    return _kernel_norm(spark, d).select(
        "pid", "corr_id", "process_id", ids.short_md5(F.col("node"), 6).alias("short_host"))


@query
def corr_id_v1(spark, d):
    return _kernel_norm(spark, d, v1_ids=True).select("pid", "corr_id", "process_id")


@query
def object_ids(spark, d):
    ev = si.events(spark, d)
    exec_id = F.base64(F.encode(si.text(F.col("node"), ":", F.col("container")), "utf-8"))
    return ev.select(
        "event_id", ids.object_id("bundle", F.col("event_id"), F.col("pod")).alias("bundle_id"),
        ids.process_id_from_exec(exec_id).alias("from_exec"),
        ids.process_id_from_exec(F.col("pod")).alias("undecodable"))


@query
def iso_to_ns(spark, d):
    ev = si.events(spark, d)
    return ev.select(
        "event_id", times.iso_to_ns(F.col("time_text")).alias("from_nanos"),
        times.iso_to_ns(times.ts_to_iso_micros(F.col("ts"))).alias("from_micros"),
        times.iso_to_ns(si.text(F.substring("time_text", 1, 19), "Z")).alias("from_seconds"),
        times.iso_to_ns_micro_only(F.col("time_text")).alias("micro_only"))


@query
def epoch_unit_guess(spark, d):
    ev = si.events(spark, d)
    us = F.unix_micros("ts")
    ms, s = F.unix_millis("ts"), F.unix_seconds("ts")
    return ev.select(
        "event_id", times.start_bound_ns(s).alias("from_s"),
        times.start_bound_ns(ms).alias("from_ms"), times.start_bound_ns(us).alias("from_us"),
        times.start_bound_ns(F.col("ns")).alias("from_ns"),
        times.start_bound_ns(ms, strict=False).alias("loose_ms"))


@query
def epoch_to_iso(spark, d):
    ev = si.events(spark, d)
    ms = F.unix_millis("ts")
    return ev.select(
        "event_id", times.epoch_to_iso(F.col("ns")).alias("iso"),
        times.epoch_to_iso(ms).alias("iso_from_ms"),
        times.epoch_to_iso(ms, strict=False).alias("iso_loose"),
        times.ns_to_iso_millis(F.col("ns")).alias("iso_millis"),
        times.ts_to_iso_micros(F.col("ts")).alias("iso_micros"))


@query
def arg_pick(spark, d):
    ev, k, kind = si.events(spark, d), F.col("k"), F.col("event_type")
    arg = si.typed({
        "string_arg": F.when(kind == "view", F.lit("")).when(kind == "click", kind),
        "int_arg": F.when(kind.isin("view", "error"), k % 3),
        "file_arg": F.when(kind.isin("error", "purchase"), si.typed(
            {"path": si.text("/data/", k), "permission": F.lit("r")}, schemas.FILE_ARG)),
    }, schemas.ARG)
    return ev.select("event_id", text.arg_text(arg).alias("picked"),
                     text.promoted_arg(F.array(arg), 0).alias("kprobe0"),
                     text.promoted_arg(F.array(arg), 1).alias("kprobe1"))


@query
def command_line(spark, d):
    return _kernel_norm(spark, d).select("pid", "command_line", "parent_command_line")


@query
def json_fields(spark, d):
    dns = si.dns_spans(si.events(spark, d))
    f = normalize.dns_fields()
    return dns.select(
        "event_id", f["query_name"].alias("query_name"), f["query_type"].alias("query_type"),
        f["response_code"].alias("response_code"),
        F.size(f["answers"]).alias("answers"),
        F.get(f["answers"], F.lit(0)).alias("first_answer"))


@query
def json_or_self(spark, d):
    ev, kind = si.events(spark, d), F.col("event_type")
    c = F.when(kind == "error", F.lit("null")).when(
        kind == "click", si.text("plain ", F.col("k"))).otherwise(F.col("props"))
    ev = ev.withColumn("c", c)
    v = text.json_or_self(F.col("c"))
    return ev.select(
        "event_id", text.json_or_text(F.col("c")).alias("as_text"),
        F.try_variant_get(v, "$.k", "bigint").alias("k"), v.isNull().alias("is_null"),
        F.schema_of_variant(v).alias("kind"))


@query
def parse_or_drop(spark, d):
    ev = si.events(spark, d)
    broken = F.when(F.col("event_type") == "error", si.text("broken ", F.col("props"))).otherwise(
        F.col("props"))
    lines = ev.select("event_id", broken.alias("line"))
    schema = si.T.StructType([si.T.StructField("k", si.T.LongType())])
    return logs.parse_or_drop(lines, "line", schema)


@query
def scalar_misc(spark, d):
    """Small functions: byte wrappers, port swap, split, select, contains, url."""
    ev, k, user = si.events(spark, d), F.col("k"), F.col("user_id")
    return ev.select(
        "event_id",
        text.strip_bytes_wrapper(si.text("b'", F.col("pod"), "'")).alias("unwrapped"),
        text.strip_bytes_wrapper(F.col("pod")).alias("kept"),
        text.bytes_to_text(F.encode(F.col("props"), "utf-8")).alias("decoded"),
        text.swap_port((k * 257 + user) % 65536).alias("port"),
        text.second_part(si.text(F.col("namespace"), "/", F.col("pod"))).alias("short_pod"),
        text.url(si.text("10.0.0.", k), F.when(k > 5, k), si.text("/p/", user)).alias("url"),
        text.interpretation(F.col("event_type"), si.text("T", k), F.lit(None).cast("string"))
        .alias("interpretation"),
        F.regexp_replace(F.col("pod"), "^(.{0,5}).*", "$1").alias("cut"),
        F.to_json(F.struct(F.lit("process").alias("type"), k.alias("pid"),
                           F.col("pod").alias("pod_name"))).alias("document"))


@query
def flatten_args(spark, d):
    t = si.traces(si.events(spark, d))
    lists = F.transform("args", lambda a: si.typed({
        "name": a["name"], "type": a["type"],
        "value": F.when(a["name"] == "doc", a["value"]).otherwise(
            F.concat(F.lit("["), a["value"], F.lit(',"x"]')))}, schemas.TRACE_ARG))
    flat = F.explode(F.map_entries(text.flatten_trace_args(lists)))
    return t.select("event_id", flat.alias("e")).select("event_id", "e.key", "e.value")


@query
def object_fingerprint(spark, d):
    """Objects of orders: equal ones share a fingerprint whatever their id."""
    o = si.table(spark, d, "orders")
    document = F.to_json(F.struct(
        F.lit("process").alias("type"), si.text("process--", F.col("o_orderkey")).alias("id"),
        F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"),
        F.struct(F.lit("x").alias("z"), (F.col("o_custkey") % 5).alias("a")).alias("ext")))
    # One of a number, the same as text, and a truth value.
    kind = F.col("o_orderkey") % 3
    n = F.when(kind == 0, F.lit("1")).when(kind == 1, F.lit('"1"')).otherwise(F.lit("true"))
    document = F.concat(F.lit('{"n":'), n, F.lit(","), F.substring(document, 2, 1 << 30))
    rows = fingerprints.with_object_fingerprint(o.select("o_orderkey", document.alias("document")), "document", "fingerprint")
    return rows.groupBy("fingerprint").agg(
        F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_order"))


# --- fingerprints and normalisers -----------------------------------------------------

@query
def log_fingerprint(spark, d):
    return _kernel_norm(spark, d).select("pid", "dedup_key")


@query
def normalise_kernel(spark, d):
    """Process objects of the wide form, arguments promoted, nested layout."""
    wide = si.kernel_wide(si.events(spark, d))
    norm = normalize.normalize_kernel(logs.wide_to_long(wide))
    return norm.select("pid", "k0", "k1", "function_name", "event_ts_ns", "observed_id",
                       normalize.process_object().alias("object"))


@query
def normalise_alert(spark, d):
    norm = normalize.normalize_alert(si.alerts(si.events(spark, d)))
    return norm.select("corr_id", "process_id", "dedup_key", "command_line", "rule_id", "k4",
                       normalize.process_object().alias("object"))


@query
def normalise_alert_v1(spark, d):
    norm = normalize.normalize_alert(si.alerts(si.events(spark, d)), v1_ids=True)
    return norm.select("pid", "corr_id", "process_id", "node", "created_time")


@query
def normalise_trace(spark, d):
    norm = normalize.normalize_trace(filters.shipped_traces(si.traces(si.events(spark, d))))
    return norm.select("pid", "corr_id", "process_id", "dedup_key", "interpretation", "time_text",
                       F.try_element_at("trace_args", F.lit("0_value")).alias("first_value"))


@query
def normalise_rule_alert(spark, d):
    norm = normalize.normalize_rule_alert(si.rule_alerts(si.events(spark, d)))
    return norm.select("event_ts_ns", "corr_id", "process_id", "dedup_key", "command_line",
                       "image_id", "alert_name", "interpretation", "k1")


@query
def normalise_http(spark, d):
    t = normalize.normalize_http(si.http_spans(si.events(spark, d)).drop("event_id"))
    return t.select("timestamp", "start", "corr_id", "method", "url", "status_code",
                    F.try_element_at("headers", F.lit("Host")).alias("host"),
                    F.size("objects").alias("objects"))


@query
def normalise_dns(spark, d):
    t = normalize.normalize_dns(si.dns_spans(si.events(spark, d)).drop("event_id"))
    return t.select("timestamp", "start", "corr_id", "query_name", "query_type", "response_code",
                    F.get_json_object(F.get("objects", F.lit(1)), "$.extensions.correlation")
                    .alias("correlation"))


@query
def normalise_union(spark, d):
    """A mixed queue of raw lines, each dispatched by the key it carries."""
    ev = si.events(spark, d)
    kind = F.col("event_type")

    def lines(df):
        return df.select(F.to_json(F.struct(*[c for c in df.columns if c != "event_id"]))
                         .alias("value"))

    queue = (
        lines(si.kernel_wide(ev.where(kind.isin("signup", "error"))))
        .unionByName(lines(si.alerts(ev.where(kind == "click"))))
        .unionByName(lines(si.traces(ev.where(kind == "view"))))
        .unionByName(lines(si.rule_alerts(ev.where(kind == "purchase"))))
        .unionByName(ev.where(kind == "view").select(si.text("broken ", F.col("k")).alias("value")))
    )
    return normalize.normalize_mixed(queue).select(
        "source", "event_ts_ns", "pod", "namespace", "corr_id", "process_id", "command_line",
        "dedup_key")


@query
def object_rows(spark, d):
    rows = normalize.object_rows(normalize.normalize_alert(si.alerts(si.events(spark, d))))
    return rows.select("timestamp", "pod_name", "namespace",
                       F.get_json_object("data", "$[1].extensions.correlation").alias("corr_id"),
                       F.get_json_object("data", "$[0].id").alias("process_id"))


@query
def alert_to_kernel(spark, d):
    k = filters.alert_to_kernel(si.alerts(si.events(spark, d)))
    p = F.col("payload.process")
    return k.select(
        "time", "node_name", "type", p["pid"].alias("pid"), p["exec_id"].alias("exec_id"),
        p["auid"].alias("auid"), p["pod"]["name"].alias("pod"),
        p["pod"]["workload"].alias("workload"), p["docker"].alias("docker"),
        F.col("payload.arguments.path").alias("path"))


# --- filters and projections -------------------------------------------------------------

@query
def export_filter(spark, d):
    long = si.kernel_long(si.events(spark, d))
    kept = filters.export_filter(long)
    return kept.groupBy("type", F.col("payload.process.pod.namespace").alias("namespace")).agg(
        F.count(F.lit(1)).alias("n"))


@query
def rule_binding(spark, d):
    a = si.alerts(si.events(spark, d)).select(
        "event_id", F.col("BaseRuntimeMetadata.alertName").alias("alert_name"),
        F.col("BaseRuntimeMetadata.arguments.path").alias("path"),
        F.col("RuntimeK8sDetails.podNamespace").alias("namespace"))
    return filters.rule_binding(a)


@query
def message_filter(spark, d):
    a = filters.message_contains(logs.alerts_present(si.alerts(si.events(spark, d))))
    return a.select("event_id", "message")


@query
def api_filters(spark, d):
    """Equality filters: a permitted key applies, an unknown one is ignored."""
    rows = si.http_spans(si.events(spark, d))
    kept = filters.equality_filters(
        rows, {"namespace": "webapp", "remote_addr": "10.0.0.7", "req_method": "PUT"},
        api.ALLOWED_FILTERS["http_events"])
    return kept.select("event_id", "pod_name", "remote_addr")


@query
def span_bounds(spark, d):
    """Lower bound twenty minutes before the newest span, per table."""
    rows = si.dns_spans(si.events(spark, d))
    recent = spans.select_spans(rows, now_ns=spans.newest_ns(rows))
    since = spans.select_spans(rows, last_seen_ns=1704672000000000000,
                               start_ns=1705276800000000000, namespace="webapp")
    both = recent.select(F.lit("recent").alias("bound"), "event_id").unionByName(
        since.select(F.lit("since").alias("bound"), "event_id"))
    return both.groupBy("bound").agg(
        F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"))


@query
def span_process(spark, d):
    """Spans with process columns looked up by upid; unknown ones spell a pid."""
    rows = si.http_spans(si.events(spark, d))
    dim = si.table(spark, d, "customer").select(
        si.upid(F.col("c_custkey")).alias("upid"),
        F.md5(F.col("c_name")).alias("container_id"),
        (F.col("c_custkey") + 1000000).alias("pid"), F.col("c_mktsegment").alias("node_name"))
    return spans.with_process(rows, dim).select("event_id", "pid", "container_id", "node_name")


@query
def path_exclusion(spark, d):
    ev = si.events(spark, d)
    path = F.concat(
        F.lit("/var/log/pods/"), F.col("namespace"), F.lit("_"),
        F.when(F.col("k") % 3 == 0, F.lit("netd-")).otherwise(F.lit("web-")), F.col("pod"),
        F.lit("/main/0.log"))
    rows = ev.select("event_id", path.alias("path"))
    return rows.where(~tail.excluded_path(F.col("path")))


@query
def retention(spark, d):
    return tail.within_retention(si.events(spark, d), "ts").select("event_id")


@query
def connect_lines(spark, d):
    ev, k = si.events(spark, d), F.col("k")
    line = si.text("_pid:", F.col("event_id"), " _comm:", F.col("event_type"), " x _saddr:10.0.0.",
                   k, " _lport:", k * 3, " _daddr:10.1.0.", k, " _dport:",
                   F.when(k == 4, F.lit("bad")).otherwise(F.lit("443")))
    rows = ev.select(line.alias("value"), F.when(k % 3 == 0, F.lit(2)).when(
        k % 3 == 1, F.lit(10)).otherwise(F.lit(1)).alias("family"))
    return filters.parse_connect_line(filters.keep_ip_families(rows))


@query
def http_endpoints(spark, d):
    pages = si.page_spans(si.table(spark, d, "pages"))
    pods = si.table(spark, d, "nation").select(
        si.text("10.0.0.", F.col("n_nationkey")).alias("ip"),
        si.text("ns/", F.col("n_name")).alias("pod_of_ip"))
    return filters.http_endpoints(pages, pods).select(
        "page_id", "source", "destination", "is_source_pod_type", "is_dest_pod_type", "req_path")


# --- selection policies --------------------------------------------------------------------

DEMO_POLICIES = [
    policies.Policy("equal", "ECONOMY", ((policies.Part("arg0", "Equal", ("red ring",
                                                                         "blue bolt")),),)),
    policies.Policy("prefix", "SMALL", ((policies.Part("arg0", "Prefix", ("red", "small")),),)),
    policies.Policy("postfix", "ECONOMY", (
        (policies.Part("arg0", "Postfix", ("widget",)),
         policies.Part("binary", "NotIn", ("Brand#1", "Brand#2"))),
        (policies.Part("binary", "In", ("Brand#3",)),))),
]


@query
def policy_tags(spark, d):
    p = si.table(spark, d, "part")
    tagged = policies.tag_policies(
        p, DEMO_POLICIES, F.col("p_type"), {"arg0": F.col("p_name"), "binary": F.col("p_brand")})
    return tagged.select("p_partkey", F.explode("policies").alias("policy"))


@query
def kernel_policies(spark, d):
    long = si.kernel_long(si.events(spark, d))
    tagged = policies.tag_policies(
        long, policies.POLICIES, F.col("payload.function_name"),
        policies.kernel_fields(F.col("payload")))
    return tagged.select("event_id", F.explode("policies").alias("policy"))


@query
def every_policy(spark, d):
    """Every shipped policy on logs that it takes and logs that it nearly takes."""
    log = si.policy_log(si.events(spark, d))
    tagged = policies.tag_policies(log, policies.POLICIES, F.col("payload.function_name"), policies.kernel_fields(F.col("payload")))
    return tagged.select("event_id", F.explode("policies").alias("policy"))


def _addresses(spark, d):
    n = F.col("c_custkey")
    part = lambda c: F.call_function("div", n, F.lit(c).cast("bigint"))
    return si.table(spark, d, "customer").select("c_custkey", F.concat(
        F.lit("10."), (n % 4).cast("string"), F.lit("."), (part(4) % 256).cast("string"),
        F.lit("."), (n % 256).cast("string")).alias("addr"))


@query
def cidr_policy(spark, d):
    a = _addresses(spark, d)
    ip = net.ipv4(F.col("addr"))
    blocks = ["10.1.0.0/20", "10.2.3.14", "10.3.128.0/17"]
    return a.select(
        "c_custkey", ip.alias("ip"), net.in_blocks(ip, blocks).alias("daddr"),
        (~net.in_blocks(ip, blocks)).alias("not_daddr"),
        net.is_subset(F.concat("addr", F.lit("/24")), "10.0.0.0/10").alias("subset"),
        net.is_superset(F.concat("addr", F.lit("/24")), "10.2.7.64/30").alias("superset"))


@query
def cidr_table(spark, d):
    """Addresses against a table of blocks of several lengths."""
    s = F.col("s_suppkey")
    blocks = si.table(spark, d, "supplier").select("s_suppkey", F.concat(
        F.lit("10."), (s % 4).cast("string"), F.lit("."), (s % 256).cast("string"),
        F.lit(".0/"), (18 + s % 9).cast("string")).alias("block"))
    hits = policies.in_block_table(_addresses(spark, d), "addr", blocks, "block")
    return hits.select("c_custkey", "s_suppkey")


def _order_lineage(spark, d):
    o = F.col("o_orderkey")
    return si.table(spark, d, "orders").select(
        o.alias("id"),
        F.when(o > 0, F.call_function("div", o, F.lit(3).cast("bigint"))).alias("parent_id"),
        F.col("o_orderpriority").alias("binary"), F.col("o_orderstatus").alias("status"))


@query
def descendants(spark, d):
    lineage = _order_lineage(spark, d)
    return graph.descendants_of(lineage, (F.col("id") % 97 == 5) & (F.col("status") != "P"))


@query
def follow_children(spark, d):
    """Line items of orders below an urgent finished order in the order tree."""
    lineage = _order_lineage(spark, d).withColumn(
        "binary", F.when((F.col("binary") == "1-URGENT") & (F.col("status") == "F") &
                         (F.col("id") > 50), F.lit("/bin/sh")).otherwise(F.lit("x")))
    items = si.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("exec_id"), "l_linenumber", "l_partkey")
    return policies.followed(items, lineage, policies.SHELL_BINARIES)


@query
def ancestry(spark, d):
    return graph.ancestry(_order_lineage(spark, d))


# --- rules ------------------------------------------------------------------------------------

def _text_rule(key, predicates):
    return Rule(key, key[-1], key, "attack-pattern--" + key, key, key, "indicator--" + key, key,
                key, "relationship--" + key, tuple(predicates))


CMD = "process:command_line"
TEXT_RULES = [
    _text_rule("text-1", [Predicate(0, CMD, "MATCHES", "(?i)licen[cs]e")]),
    _text_rule("text-2", [Predicate(0, CMD, "MATCHES", r"\d+\.\d+\.\d+\.\d+")]),
    _text_rule("text-3", [Predicate(0, CMD, "LIKE", "%token%"),
                          Predicate(1, CMD, "LIKE", "%Token%")]),
    _text_rule("text-4", [Predicate(0, CMD, "MATCHES", "the"),
                          Predicate(0, "process:extensions.namespace", "=", "fr", negated=True),
                          Predicate(0, "process:pid", "<", 500, "int")]),
    _text_rule("text-5", [Predicate(0, "process:extensions.namespace", "IN", ("de", "es"))]),
    _text_rule("text-6", [Predicate(0, "process:extensions.image_id", "EXISTS"),
                          Predicate(0, "process:pid", ">=", 9000, "int")]),
    _text_rule("text-7", [Predicate(0, "process:extensions.nothing", "EXISTS", negated=True),
                          Predicate(0, CMD, "MATCHES", r"^\S+@\S+|[a-z]+@[a-z]+\.[a-z]+")]),
    _text_rule("text-8", [Predicate(0, "process:extensions.function_name", "!=", "src0"),
                          Predicate(0, "process:pid", ">", 17.5, "float"),
                          Predicate(0, "process:pid", "<=", 40, "int")]),
]


def _document_norm(spark, d):
    """Documents in the normalised shape: text as the command line."""
    doc = si.table(spark, d, "documents")
    return normalize._norm(
        doc, source=F.lit("kernel"), pid=F.col("doc_id"), command_line=F.col("text"),
        namespace=F.col("lang"), function_name=F.col("source"),
        image_id=F.when(F.col("n_chars") > 300, F.col("source")),
        corr_id=F.col("doc_id").cast("string"), dedup_key=F.md5("text"))


@query
def rule_match(spark, d):
    m = rule_ops.match_rows(_document_norm(spark, d), TEXT_RULES)
    return m.select(F.col("pid").alias("doc_id"), "key", "indicator_id")


@query
def rule_match_counts(spark, d):
    return rule_ops.match_counts(rule_ops.match_rules(_document_norm(spark, d), TEXT_RULES))


@query
def kernel_rule_match(spark, d):
    """The shipped catalogue over kernel logs, paths as the authors meant them."""
    m = rule_ops.match_rules(_kernel_norm(spark, d), CORE_RULES, "intended")
    return m.select("pid", F.array_join("matches", ",").alias("matches"))


def _tagged(layout):
    return lambda k: F.struct(F.lit(layout).alias("layout"), k.alias("key"))


@query
def strict_vs_intended_paths(spark, d):
    norm = _kernel_norm(spark, d)
    keys = F.explode(F.concat(*[
        F.transform(rule_ops.matched_keys(CORE_RULES + CALIBRATION_RULES, name),
                    _tagged(name)) for name in rule_ops.LAYOUTS]))
    return norm.select(keys.alias("m")).select("m.*").groupBy("layout", "key").agg(
        F.count(F.lit(1)).alias("n"))


@query
def gated_rules(spark, d):
    """Rules as rows, gated by function name and a word, with the regex as residual."""
    p = si.table(spark, d, "part").select(
        si.text("part-", F.col("p_partkey")).alias("key"),
        F.get(F.array(*[F.lit(v) for v in si.FUNCTIONS.values()]),
              (F.col("p_partkey") % 3).cast("int")).alias("function_name"),
        (F.col("p_partkey") % 100).cast("string").alias("token"),
        si.text('"k": ', F.col("p_partkey") % 100, "[}]").alias("regex"))
    return rule_ops.gate_counts(_kernel_norm(spark, d), p)


@query
def rule_index(spark, d):
    """Two rules from every document, each a stretch of its text, against all documents."""
    doc = si.table(spark, d, "documents").select("doc_id", F.col("text").alias("command_line"))
    special = r"([\\.^$*+?{}()|\[\]-])"

    def rules(key, begin, size):
        piece = F.substring(F.col("command_line"), begin, size)
        return doc.where(piece != "").select(key.alias("key"), F.regexp_replace(piece, special, r"\\$1").alias("regex"))

    i = F.col("doc_id")
    both = rules(2 * i, (3 + i % 50).cast("int"), (6 + i % 5).cast("int")).unionByName(
        rules(2 * i + 1, (20 + i % 90).cast("int"), (10 + i % 7).cast("int")))
    return counts_indexed(doc, both, function=None)


@query
def indicator_resolution(spark, d):
    m = rule_ops.match_rows(_kernel_norm(spark, d), CORE_RULES, "intended").select(
        "pid", "key", "indicator_id")
    rules = rules_frame(spark, CORE_RULES).select("key", "attack_id", "attack_name")
    hit = rule_ops.resolve_indicators(m, edges_frame(spark, CORE_RULES), rules)
    return hit.groupBy("indicator_id", "target_ref", "attack_name").agg(
        F.count(F.lit(1)).alias("n"))


# --- bundles ----------------------------------------------------------------------------------

def _kernel_bundles(spark, d):
    matched = rule_ops.match_rules(_kernel_norm(spark, d), CORE_RULES, "flat")
    return bundles.assemble(matched, CORE_RULES, flat=True)


@query
def bundle_assembly(spark, d):
    b = _kernel_bundles(spark, d)
    return b.select(
        "pid", "bundle_id", F.size("objects").alias("n_objects"),
        bundles.store_key(CORE_RULES).alias("store_key"),
        F.get("objects", F.lit(0)).alias("process"), F.get("objects", F.lit(1)).alias("observed"),
        F.get_json_object(F.get("objects", F.lit(2)), "$.target_ref").alias("first_target"),
        text.first_of_type(F.col("objects"), "observed-data").alias("observed_id"))


@query
def matched_rule_rows(spark, d):
    matched = rule_ops.match_rules(_kernel_norm(spark, d), CORE_RULES, "flat")
    rows = bundles.matched_rule_rows(matched, CORE_RULES, flat=True)
    return rows.select(
        "timestamp",
        F.array_join(F.from_json("matches", "array<struct<pattern_id:string>>")["pattern_id"], ",")
        .alias("pattern_ids"),
        F.get_json_object("bundle", "$.id").alias("bundle_id"),
        F.get_json_object("bundle", "$.objects[0].id").alias("process_id"))


@query
def graph_nodes(spark, d):
    objects = bundle_io.explode_objects(
        _kernel_bundles(spark, d).select(F.col("bundle_id").alias("id"), "objects"))
    return graph.nodes(objects).groupBy("type").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("node_id").alias("n_ids"))


@query
def graph_edges(spark, d):
    objects = bundle_io.explode_objects(
        _kernel_bundles(spark, d).select(F.col("bundle_id").alias("id"), "objects"))
    return graph.edges(objects).select("bundle_id", "src", "dst", "label")


def _lineitem_bundles(spark, d):
    """One small bundle per line item: its process and its kind."""
    li = si.table(spark, d, "lineitem")
    process = F.to_json(F.struct(
        F.lit("process").alias("type"), si.text("process--", F.col("l_orderkey")).alias("id"),
        (F.col("l_partkey") % 50).alias("pid")))
    kind = F.to_json(F.struct(
        F.lit("indicator").alias("type"),
        si.text("indicator--", F.col("l_orderkey"), "-", F.col("l_linenumber")).alias("id"),
        F.concat("l_returnflag", "l_linestatus").alias("name")))
    # A line can occur twice, so the bundle id takes every column of it.
    line = si.text(F.col("l_orderkey"), "-", F.col("l_linenumber"), "-", F.col("l_partkey"), "-",
                   F.col("l_suppkey"))
    return once(li, "objects", F.array(process, kind, kind), [
        si.text("bundle--", line).alias("bundle_id"), (F.col("l_suppkey") % 7).alias("rule_id"),
        F.col("l_orderkey").alias("seen")])


@query
def consolidate_by_rule(spark, d):
    merged = bundles.consolidate_by_rule(_lineitem_bundles(spark, d), ["seen"])
    return merged.select("group_key", "merged_id", "bundle_id", "pos", "type", "object")


@query
def consolidate_keep_first(spark, d):
    merged = bundles.consolidate_by_rule(
        _lineitem_bundles(spark, d), ["seen"], keep_first_whole=True)
    return merged.groupBy("group_key", "merged_id", "type").agg(F.count(F.lit(1)).alias("n"))


@query
def consolidate_by_process(spark, d):
    merged = bundles.consolidate_by_process(_lineitem_bundles(spark, d), ["seen"])
    return merged.select("group_key", "merged_id", "bundle_id", "pos", "type", "object")


@query
def consolidate_increments(spark, d):
    """Bundles merged in three increments, the latest of them first."""
    rows, state = _lineitem_bundles(spark, d), None
    for part in (2, 0, 1):
        state = bundles.consolidate_increment(state, rows.where(F.col("seen") % 3 == part), F.col("rule_id"), ["seen"])
    merged = bundles.merged_state(state, ["seen"])
    return merged.select("group_key", "merged_id", "bundle_id", "pos", "type", "object")


@query
def bundle_parts(spark, d):
    """Merged bundles as documents of bounded size: totals per bundle."""
    merged = bundles.consolidate_by_rule(_lineitem_bundles(spark, d), ["seen"])
    parts = bundles.bundle_parts(merged, ["seen"], size=20)
    return parts.groupBy("group_key", "bundle_id").agg(
        F.sum(F.size("objects")).alias("objects"), (F.max(F.size("objects")) <= 20).alias("bounded"))


# --- deduplication, stores, baselines ---------------------------------------------------------

@query
def dedupe_first(spark, d):
    return baseline.dedupe(_kernel_norm(spark, d), order=["event_ts_ns", "pid"]).select(
        "dedup_key", "pid", "event_ts_ns")


@query
def observed_counts(spark, d):
    return baseline.observed_counts(_kernel_norm(spark, d), ts="event_ts_ns")


@query
def upsert_latest(spark, d):
    o = si.table(spark, d, "orders")
    return sinks.latest_per_key(o, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select(
        "o_custkey", "o_orderkey", "o_orderstatus")


@query
def benign_filter(spark, d):
    """Documents whose text was not marked benign (a label of good quality)."""
    doc = si.table(spark, d, "documents").withColumn("dedup_key", F.md5("text"))
    good = si.table(spark, d, "labels").where("quality = 1").select("doc_id")
    benign = doc.join(good, "doc_id", "left_semi").select("dedup_key")
    return baseline.drop_benign(doc, benign, salt_by=["doc_id"]).select("doc_id", "dedup_key")


@query
def append_rate(spark, d):
    rate = baseline.append_rate(si.events(spark, d), "ts", ["event_type"])
    return rate.select("event_type", F.unix_seconds("minute").alias("minute"), "n")


@query
def equilibrium(spark, d):
    rate = baseline.append_rate(si.events(spark, d), "ts", ["pod"])
    import datetime

    now = datetime.datetime(2024, 1, 31, tzinfo=datetime.timezone.utc)
    out = baseline.equilibrium(rate, 12 * 60, now, "pod")
    return out.select("pod", "reached", F.unix_seconds("last_minute").alias("last_minute"))


def _behaviour(spark, d):
    return _behaviour_of(si.events(spark, d))


def _behaviour_of(events):
    return events.select(
        "event_id", F.col("pod").alias("workload"), F.col("event_type").alias("kind"),
        si.text("/p/", F.col("k") % 40).alias("entry"), F.col("ts").alias("event_ts"))


@query
def learn_profile(spark, d):
    return baseline.learn_profile(_behaviour(spark, d), minutes=3 * 24 * 60)


@query
def profile_deviation(spark, d):
    b = _behaviour(spark, d)
    profile = baseline.learn_profile(b, minutes=3 * 24 * 60)
    return baseline.deviations(b, profile, ["event_id"]).select(
        "event_id", "workload", "kind", "entry",
        baseline.deviation_alert(F.lit("open")).alias("alert"))


@query
def profile_wildcard(spark, d):
    """Page paths against profiles with one-segment wildcards."""
    pages = si.page_spans(si.table(spark, d, "pages"))
    seen = pages.select("page_id", F.col("pod").alias("workload"), F.lit("open").alias("kind"),
                        F.col("req_path").alias("entry"))
    learned = seen.where(F.col("page_id") % 2 == 0)
    wild = learned.withColumn("entry", F.when(
        F.col("page_id") % 4 == 0,
        F.regexp_replace("entry", "/[^/]*$", "/" + bundle_io.WILDCARD)).otherwise(F.col("entry")))
    profile = bundle_io.with_wildcards(wild.select("workload", "kind", "entry"))
    return baseline.deviations_wildcard(seen, profile, ["page_id"]).select(
        "page_id", "workload", "entry")


@query
def cooldown(spark, d):
    a = si.events(spark, d).where("event_type = 'error'")
    out = baseline.cooldown(a, ["namespace"], "ts", "6 hours", 3, ["event_id"])
    return out.select("event_id", "namespace", F.unix_seconds("period").alias("period"),
                      "rank_in_key")


@query
def profile_portability(spark, d):
    nations = si.table(spark, d, "customer").select(F.col("c_nationkey").alias("entry"))
    suppliers = si.table(spark, d, "supplier").select(F.col("s_nationkey").alias("entry"))
    a = nations.withColumn("environment", F.lit("customer"))
    b = suppliers.withColumn("environment", F.lit("supplier"))
    return baseline.portability(a.unionByName(b), ["entry"])


@query
def profile_sets(spark, d):
    a = si.table(spark, d, "customer").select((F.col("c_nationkey") % 20).alias("entry"))
    b = si.table(spark, d, "supplier").select((F.col("s_nationkey") % 15 + 4).alias("entry"))
    parts = {
        "common": baseline.common_entries(a, b),
        "only_first": baseline.only_in_first(a, b),
        "only_first_all": baseline.only_in_first(a, b, keep_repeats=True),
    }
    out = None
    for name, df in parts.items():
        df = df.select(F.lit(name).alias("part"), "entry")
        out = df if out is None else out.unionByName(df)
    return out.groupBy("part", "entry").agg(F.count(F.lit(1)).alias("n"))


# --- context and severity ------------------------------------------------------------------------

def _alerts_and_spans(spark, d):
    ev = si.events(spark, d)
    a = ev.where("event_type = 'error'").select(
        "event_id", F.col("ns").alias("time_ns"), F.col("pod").alias("source"), "user_id", "k")
    return a, ev.where("event_type != 'error'")


@query
def dns_context(spark, d):
    a, rest = _alerts_and_spans(spark, d)
    dns = si.dns_spans(rest).withColumnRenamed("event_id", "span_id")
    pairs = context.dns_context(a, dns)
    return pairs.select("event_id", "span_id", "query_name")


@query
def http_context(spark, d):
    a, rest = _alerts_and_spans(spark, d)
    http = si.http_spans(rest).select(
        F.col("event_id").alias("span_id"), "time_", "req_path", F.col("pod_name").alias("source"))
    return context.http_context(a, http, width_ns=3600 * times.NS).select(
        "event_id", "span_id", "source", "req_path")


@query
def context_arrays(spark, d):
    """Alerts with their lookups as arrays, in pages of four."""
    a, rest = _alerts_and_spans(spark, d)
    lookups = context.dns_lookups(si.dns_spans(rest).drop("event_id"))
    near = ("time_ns", "time_", 300 * times.NS)
    paged = context.context_arrays(a, lookups, "event_id", context.DNS_KEPT, "dns_logs", 4, near)
    entries = F.transform("dns_logs", lambda s: F.concat(
        s["time_"].cast("string"), F.lit(" "), s["req_body"]))
    return paged.select("event_id", "page", F.array_join(entries, "|").alias("dns_logs"))


@query
def context_counts(spark, d):
    a, rest = _alerts_and_spans(spark, d)
    http = si.http_spans(rest).select("time_", "req_path", F.col("pod_name").alias("source"))
    pairs = context.http_context(a, http, width_ns=3600 * times.NS)
    return context.context_counts(a, pairs, "event_id", "time_", "http").select(
        "event_id", "http_count", "http_first", "http_last")


def _scored(spark, d):
    a, rest = _alerts_and_spans(spark, d)
    k, user = F.col("k"), F.col("user_id")
    a = a.withColumns({
        "exec_id": F.when(k % 4 == 0, si.text("Unexpected-", k)).otherwise(si.text("e", k)),
        "uid": user % 2, "auid": user % 3, "in_init_tree": F.when(k % 5 != 0, k % 2 == 0),
        "arguments": F.when(k < 40, F.lit("apt install x")).otherwise(F.lit("ls"))})
    dns = si.dns_spans(rest)
    http = si.http_spans(rest).withColumn("source", F.col("pod_name"))
    names = {n: n for n in ("exec_id", "uid", "auid", "in_init_tree", "arguments")}
    # A wide window stands in for fifteen seconds: the events are sparse.
    near = context.near_any(a, context.marked_dns(dns), "time_ns", "time_", "_dns", ["event_id"],
                            width_ns=1800 * times.NS)
    near = context.near_any(near, context.marked_http(http), "time_ns", "time_", "_http",
                            ["event_id"], width_ns=24 * 3600 * times.NS, by=["source"])
    flags = context.severity_flags(*[F.col(names[n]) for n in names], F.col("_dns"),
                                   F.col("_http"))
    return context.add_severity(near, flags)


@query
def severity_score(spark, d):
    return _scored(spark, d).select(
        "event_id", F.col("score").cast("string").alias("score"), "severity",
        F.size("reasons").alias("n_reasons"), F.array_join("reasons", "|").alias("reasons"))


@query
def severity_bands(spark, d):
    return context.severity_bands(_scored(spark, d))


@query
def scored_bundle(spark, d):
    """Alerts scored end to end: with the exec of their process and the lookups and
    requests of the fifteen seconds around them."""
    ev = si.events(spark, d)
    execs = si.kernel_long(ev.withColumn("event_type", F.lit("signup")))
    pods = si.table(spark, d, "nation").select(
        si.text("10.0.0.", F.col("n_nationkey")).alias("ip"), si.text("ns/", F.col("n_name")).alias("pod_of_ip"))
    out = api.scored_bundle(si.alerts(ev), execs, si.dns_spans(ev), si.http_spans(ev), pods)
    return out.select("pod", "pid", "timestamp", "severity", F.array_join("reasons", "|").alias("reasons"),
                      F.col("score").cast("string").alias("score"))


@query
def cross_source(spark, d):
    """Coverage of process ids by the kernel and trace sources."""
    ev = si.events(spark, d)
    kernel = normalize.normalize_kernel(
        si.kernel_long(ev.where("k % 3 != 0")), v1_ids=True)
    trace = normalize.normalize_trace(si.traces(ev.where("k % 2 = 0 OR k % 3 = 0")))
    norm = normalize.union_sources(kernel, trace)
    both = context.correlate(norm)
    return both.groupBy("n_kernel", "n_trace").agg(F.count(F.lit(1)).alias("ids"))


@query
def seen_by_both(spark, d):
    ev = si.events(spark, d)
    norm = normalize.union_sources(
        normalize.normalize_kernel(si.kernel_long(ev.where("k % 3 != 0")), v1_ids=True),
        normalize.normalize_trace(si.traces(ev.where("k % 2 = 0 OR k % 3 = 0"))))
    return context.seen_by_both(norm, "kernel", "trace").select("source", "process_id", "pid")


# --- sorting ----------------------------------------------------------------------------------------

@query
def kernel_descendants(spark, d):
    """Lineage from kernel logs themselves; events under the launchers of node-1."""
    long = si.kernel_long(si.events(spark, d))
    lineage = graph.lineage_of(long)
    roots = F.col("parent_id").isin("p1", "p6") | (F.col("pid") == 3)
    hits = graph.descendants_of(lineage, roots).select(F.col("id").alias("exec_id"))
    exec_id = F.col("payload.process.exec_id").alias("exec_id")
    return long.select("event_id", exec_id).join(hits, "exec_id", "left_semi").select("event_id")


@query
def process_tree(spark, d):
    """Events under processes of a pid, under none of them, and under those of a binary, by
    lineage read from the log itself; its chains are as deep as the log is long in bits."""
    log = si.process_tree(si.events(spark, d))
    lineage = graph.lineage_of(log)
    own = log.select("event_id", F.col("payload.process.exec_id").alias("exec_id"))
    parts = {"pids": {"pids": (5, 11)}, "others": {"pids": (5, 11), "negated": True}, "binary": {"binaries": ("/usr/bin/signup",)}}
    found = [policies.followed(own, lineage, **how).select(F.lit(name).alias("part"), "event_id") for name, how in parts.items()]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query
def raw_alert_bundles(spark, d):
    """Raw alerts to bundles of those that a rule matches."""
    norm, found = api.alert_bundles(si.alerts(si.events(spark, d)), layout="intended")
    return found.select(F.col("k4").cast("bigint").alias("event_id"), F.size("objects").alias("n_objects"), F.array_join("matches", ",").alias("keys"),
                        F.get_json_object(F.get("objects", F.lit(0)), "$.id").alias("process_id"))


@query
def raw_kernel_bundles(spark, d):
    """Kernel logs to bundles through the same call."""
    norm, found = api.kernel_bundles(si.kernel_long(si.events(spark, d)), layout="flat")
    return found.select("pid", "bundle_id", F.size("objects").alias("n_objects"))


@query
def preview_rows(spark, d):
    """A preview has the chosen columns and as many rows as asked for, all of them the table's.
    Which ones is not laid down."""
    spans_ = si.http_spans(si.events(spark, d))
    rows = cut_lineage(api.preview(spans_, 7, ["time_", "pod_name"]))
    own = spans_.select("time_", "pod_name").distinct().withColumn("own", F.lit(True))
    return rows.join(own, ["time_", "pod_name"], "left").agg(
        F.count(F.lit(1)).alias("n"), F.lit(",".join(rows.columns)).alias("columns"), F.count("own").alias("own"))


@query
def newest_n(spark, d):
    rows = si.events(spark, d)
    return api.newest(rows, "ts", 100, {"event_type": "error", "value": 0}, ["event_type"],
                      tie=["event_id"]).select("event_id", "pod", "ns")


@query
def oldest_after_mark(spark, d):
    o = si.table(spark, d, "orders")
    import datetime

    mark = (datetime.datetime(1998, 6, 1), 100)
    return api.oldest_after(o, "o_orderdate", mark, 10, ["o_orderkey"]).select(
        "o_orderkey", "o_custkey")


@query
def high_water_mark(spark, d):
    rows = si.http_spans(si.events(spark, d))
    return rows.groupBy("namespace").agg(F.max("time_").alias("last_seen_ns"))


@query
def script_outputs(spark, d):
    """Two named outputs of one script, put side by side."""
    def script(tables):
        http = tables["http"]
        return {
            "status": http.groupBy("resp_status").agg(F.count(F.lit(1)).alias("n")).select(
                F.col("resp_status").cast("string").alias("name"), "n"),
            "paths": http.groupBy("req_path").agg(F.count(F.lit(1)).alias("n")).select(
                F.col("req_path").alias("name"), "n"),
        }

    outs = api.run_script({"http": si.http_spans(si.events(spark, d))}, script, scratch_dir(spark, "script"))
    return outs["status"].withColumn("output", F.lit("status")).unionByName(
        outs["paths"].withColumn("output", F.lit("paths")))


# --- sequences ----------------------------------------------------------------------------------------

def _kinds():
    return F.col("event_type") == "error", F.col("event_type") == "purchase"


@query
def followed_by(spark, d):
    first, then = _kinds()
    ev = si.events(spark, d)
    return sequences.followed_by(ev, ["user_id"], "ns", first & (F.col("k") > 90), then,
                                 ["event_id"]).select("event_id", "user_id", "first_ns")


@query
def followed_within(spark, d):
    first, then = _kinds()
    ev = si.events(spark, d)
    return sequences.followed_within(ev, ["user_id"], "ns", first, then, 7200, ["event_id"]
                                     ).select("event_id", "user_id")


@query
def repeats(spark, d):
    first, _ = _kinds()
    ev = si.events(spark, d)
    return sequences.repeats(ev, ["user_id"], "ns", first, 2, 24 * 3600)


@query
def start_stop(spark, d):
    ev = si.events(spark, d)
    return sequences.start_stop(ev, "ns", 1704672000000000000, 1705276800000000000).groupBy(
        "event_type").agg(F.count(F.lit(1)).alias("n"))


@query
def observation_and(spark, d):
    first, then = _kinds()
    out = sequences.observation_and(si.events(spark, d), ["user_id"], "ts", first, then, "1 hour")
    return out.select("user_id", F.unix_seconds("window_start").alias("window_start"))


@query
def observation_or(spark, d):
    first, then = _kinds()
    out = sequences.observation_or(si.events(spark, d), ["user_id"], "ts", first & (F.col("k") < 5),
                                   then & (F.col("k") < 5), "1 hour")
    return out.select("user_id", F.unix_seconds("window_start").alias("window_start"), "has_a",
                      "has_b")


@query
def dialogue_followed_by(spark, d):
    """Per conversation: assistant turns after a system turn."""
    c = si.table(spark, d, "conversations")
    out = sequences.followed_by(c, ["conv_id"], "turn", F.col("role") == "system",
                                F.col("role") == "assistant", ["role"])
    return out.select("conv_id", "turn")


# Rules over several logs, as the rows of a rule table.
def _sequence_rule(key, kinds, **how):
    """One observation for each kind of event, told by its binary."""
    seen = tuple(Predicate(0, "process:command_line", "MATCHES", f"/usr/bin/{kind} ", observation=i)
                 for i, kind in enumerate(kinds))
    return Rule(key, "s", "n", "a", "a", "a", "i", "i", "i", "r", seen, **how)


SEQUENCE_RULES = [
    Rule("setns-then-mount", "s1", "n", "a", "a", "a", "i", "i", "i", "r", (
        Predicate(0, "process:extensions.function_name", "MATCHES", "sys_setns"),
        Predicate(0, "process:extensions.function_name", "MATCHES", "sys_mount", observation=1)),
        combine="FOLLOWEDBY", within=7200.0),
    Rule("setns-repeats", "s2", "n", "a", "a", "a", "i", "i", "i", "r", (
        Predicate(0, "process:extensions.function_name", "MATCHES", "sys_setns"),),
        within=86400.0, repeats=2),
    Rule("setns-and-mount", "s3", "n", "a", "a", "a", "i", "i", "i", "r", (
        Predicate(0, "process:extensions.function_name", "MATCHES", "sys_setns"),
        Predicate(0, "process:extensions.function_name", "MATCHES", "sys_mount", observation=1)),
        combine="AND", within=3600.0),
]
CHAIN_RULES = [
    _sequence_rule("three", ["error", "purchase", "click"], combine="FOLLOWEDBY", within=3600.0),
    _sequence_rule("four", ["error", "purchase", "click", "view"], combine="FOLLOWEDBY", within=5400.0),
    _sequence_rule("unbounded", ["error", "purchase", "click", "signup"], combine="FOLLOWEDBY"),
]
_ONE, _TWO, _THREE = Observed(0), Observed(1), Observed(2)
TREE_RULES = [
    _sequence_rule("bracket", ["error", "purchase", "click"], tree=Observed(combine="FOLLOWEDBY", within=7200, of=(
        Observed(combine="AND", of=(_ONE, _TWO), within=3600), _THREE)).text()),
    _sequence_rule("period", ["error"], tree=Observed(
        0, repeats=3, within=86400, start=1704672000000000000, stop=1705276800000000000).text()),
    _sequence_rule("either", ["error", "click", "view", "signup"], tree=Observed(combine="FOLLOWEDBY", within=3600, of=(
        _ONE, Observed(combine="OR", of=(
            _TWO, Observed(combine="AND", of=(_THREE, Observed(3)), within=1800))))).text()),
]


def _loaded(spark, rules):
    return load_rules(rules_frame(spark, rules), predicates_frame(spark, rules))


@query
def rule_sequences(spark, d):
    """Rules with order, repetition and conjunction, loaded from their tables."""
    found = rule_ops.match_sequences(_kernel_norm(spark, d), _loaded(spark, SEQUENCE_RULES), ["pod"])
    return found.select("rule", "pod", "event_ts_ns")


def _busy_pod(norm):
    """Nine tenths of the logs in one pod."""
    return norm.withColumn("pod", F.when(F.col("pid") % 10 < 9, "pod-hot").otherwise(F.col("pod")))


@query
def rule_chain(spark, d):
    """Three and four steps in order, under one span and without."""
    return rule_ops.match_sequences(_busy_pod(_kernel_norm(spark, d)), _loaded(spark, CHAIN_RULES), ["pod"])


@query
def rule_tree(spark, d):
    """Brackets with qualifiers of their own: spans, repetition, START and STOP."""
    return rule_ops.match_sequences(_busy_pod(_kernel_norm(spark, d)), _loaded(spark, TREE_RULES), ["pod"])


@query
def observations_together(spark, d):
    """Three observations of one user within an hour of each other, wherever the hour begins."""
    kinds = [F.col("event_type") == kind for kind in ("error", "purchase", "click")]
    return observations.together(si.events(spark, d), ["user_id"], "ns", kinds, 6 * 3600)


BLOCK_RULES = [
    Rule(key, "b", "n", "a", "a", "a", "i", "i", "i", "r", (
        Predicate(0, "process:extensions.kprobe0.sock_arg.daddr", op, block, negated=negated),))
    for key, op, block, negated in (
        ("inside", "ISSUBSET", "10.1.0.0/20", False), ("outside", "ISSUBSET", "10.1.0.0/20", True),
        ("one", "ISSUBSET", "10.1.7.7", False), ("holds", "ISSUPERSET", "10.1.3.7/32", False),
        ("wide", "ISSUPERSET", "10.1.0.0/16", False))]


@query
def rule_blocks(spark, d):
    """Rule rows that compare a destination with address blocks."""
    matched = rule_ops.match_rules(_kernel_norm(spark, d), _loaded(spark, BLOCK_RULES), "intended")
    return matched.select("pid", F.explode("matches").alias("key"))


LITERAL_RULES = [
    Rule(key, "l", "n", "a", "a", "a", "i", "i", "i", "r", (p,)) for key, p in {
        "hex": Predicate(0, "process:cwd", "=", "2f", "hex"),
        "binary": Predicate(0, "process:extensions.namespace", "=", "d2ViYXBw", "binary"),
        "timestamp": Predicate(0, "process:created_time", "<", "2024-01-10T00:00:00Z", "timestamp"),
        "bool": Predicate(0, "process:extensions.kprobe0", "=", True, "bool", negated=True),
        "not-utf8": Predicate(0, "process:cwd", "=", "ff", "hex"),
    }.items()]


@query
def rule_literals(spark, d):
    matched = rule_ops.match_rules(_kernel_norm(spark, d), LITERAL_RULES)
    return rule_ops.match_counts(matched)


@query
def rule_store(spark, d):
    """Rules added and deleted at run time, then matched; references stay."""
    from ..sources.rules import RuleStore

    store = RuleStore(spark, scratch_dir(spark, "rule-store"))
    for rule in CORE_RULES:
        store.add(rule)
    store.delete(next(i for i, r in store.list().items() if r.key == "tree"))
    rules = store.rules()
    counts = rule_ops.match_counts(rule_ops.match_rules(_kernel_norm(spark, d), rules, "intended"))
    linked = spark.createDataFrame([(r.key, len(r.references)) for r in rules], "key string, refs bigint")
    return counts.join(linked, "key")


# --- files, tables, stores ------------------------------------------------------------------------------

def _write_lines(df: DataFrame, spark, purpose: str) -> str:
    path = scratch_dir(spark, purpose)
    df.write.text(path)
    return path


@query
def file_kernel_wide(spark, d):
    """The wide log written as JSON lines with broken ones, read back typed."""
    wide = si.kernel_wide(si.events(spark, d))
    lines = wide.select(F.to_json(F.struct("*")).alias("value")).unionByName(
        wide.where("time < '2024-01-05'").select(F.lit('{"time": "x", ').alias("value")))
    path = _write_lines(lines, spark, "kernel-wide")
    norm = normalize.normalize_kernel(logs.wide_to_long(logs.read_kernel_wide(spark, path)))
    return norm.select("pid", "corr_id", "k0", "k1", "dedup_key")


@query
def kernel_table_form(spark, d):
    """The log as it lies in its table, the payload as JSON text, and back."""
    long = si.kernel_long(si.events(spark, d)).drop("event_id")
    table = long.withColumn("payload", logs.payload_text(F.col("payload")))
    return normalize.normalize_kernel(logs.kernel_long_from_text(table)).select("pid", "corr_id", "dedup_key")


@query
def file_kernel_long(spark, d):
    long = si.kernel_long(si.events(spark, d)).drop("event_id")
    init = long.where("time < '2024-01-02'").select(F.lit(
        '{"time":"2025-05-15T10:00:16Z","node_name":"init","type":"process_exec",'
        '"payload":{"init":true}}').alias("value"))
    lines = long.select(F.to_json(F.struct("*")).alias("value")).unionByName(init)
    rows = logs.read_kernel_long(spark, _write_lines(lines, spark, "kernel-long"))
    return normalize.normalize_kernel(rows).select("pid", "corr_id", "function_name")


@query
def file_alerts(spark, d):
    a = si.alerts(si.events(spark, d)).drop("event_id")
    path = _write_lines(a.select(F.to_json(F.struct("*")).alias("value")), spark, "alerts")
    return normalize.normalize_alert(logs.read_alerts(spark, path)).select(
        "corr_id", "command_line", "dedup_key")


@query
def file_traces(spark, d):
    t = si.traces(si.events(spark, d)).drop("event_id")
    path = _write_lines(t.select(F.to_json(F.struct("*")).alias("value")), spark, "traces")
    return normalize.normalize_trace(logs.read_syscall_trace(spark, path)).select(
        "pid", "corr_id", "dedup_key")


@query
def file_rule_alerts(spark, d):
    r = si.rule_alerts(si.events(spark, d))
    message = F.to_json(F.struct(
        F.col("interesting").alias("output_fields"), "rule", "source", "priority", "tags",
        "hostname"))
    lines = r.select(F.to_json(F.struct("timestamp", message.alias("message"))).alias("value"))
    path = _write_lines(lines, spark, "rule-alerts")
    return normalize.normalize_rule_alert(logs.read_rule_alerts(spark, path)).select(
        "event_ts_ns", "corr_id", "dedup_key")


@query
def bulk_load(spark, d):
    a = si.alerts(si.events(spark, d)).drop("event_id")
    lines = a.select(F.to_json(F.struct("*")).alias("value")).unionByName(
        a.select(F.lit("not json").alias("value")))
    path = _write_lines(lines, spark, "bulk")
    rows = logs.load_alert_file(spark, path, fixed_time="2025-01-01T00:00:00Z")
    return rows.groupBy("time", "RuleID", "level").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.get_json_object("RuntimeK8sDetails", "$.podName")).alias("first_pod"))


@query
def bundle_files(spark, d):
    """Bundles written wrapped, one per line, and read back as objects."""
    b = _kernel_bundles(spark, d).select(F.col("bundle_id").alias("id"), "objects")
    path = _write_lines(bundle_io.wrap_bundle(b), spark, "bundles")
    back = bundle_io.explode_objects(bundle_io.read_bundles(spark, path))
    return back.groupBy("type", "pos").agg(F.count(F.lit(1)).alias("n"))


@query
def appended_objects(spark, d):
    """One more object at the end of every bundle."""
    note = F.array(F.concat(F.lit('{"type":"note","id":"note--'), F.col("pid").cast("string"), F.lit('"}')))
    b = bundles.append_objects(_kernel_bundles(spark, d), note)
    return b.select("pid", F.size("objects").alias("n_objects"),
                    text.first_of_type(F.col("objects"), "note").alias("note"))


@query
def json_without_nulls(spark, d):
    ev = si.events(spark, d)
    kind = F.when(F.col("event_type") != "error", F.col("event_type"))
    return ev.select("event_id", sinks.strip_nulls(F.struct("event_id", kind.alias("kind"), "pod")).alias("row"))


@query
def span_pod_columns(spark, d):
    rows = si.http_spans(si.events(spark, d))
    rows = rows.select("time_", F.concat_ws("/", "namespace", "pod_name").alias("context_pod"))
    return spans.with_pod_columns(rows)


@query
def json_lines_sink(spark, d):
    """JSON lines without null fields."""
    rows = _kernel_norm(spark, d).select("pid", "alert_name", "rule_id", "command_line")
    path = scratch_dir(spark, "json-lines")
    sinks.append_json_lines(rows, path)
    back = spark.read.text(path)
    return back.select(
        F.get_json_object("value", "$.pid").cast("bigint").alias("pid"),
        F.array_join(F.array_sort(F.json_object_keys("value")), ",").alias("keys"))


@query
def table_api(spark, d):
    """Spans appended to their table, then the newest rows by the read API."""
    root = scratch_dir(spark, "tables")
    sinks.append_table(si.http_spans(si.events(spark, d)).drop("event_id"), root, "http_events")
    rows = api.query_table(spark, root, "http_events", {"namespace": "webapp", "pid": 1}, 50)
    return rows.select("time_", "pod_name", "pid")


@query
def span_files(spark, d):
    """Span tables written and read back from a high-water mark on."""
    path = scratch_dir(spark, "spans")
    ev = si.events(spark, d)
    si.dns_spans(ev).drop("event_id").write.parquet(f"{path}/dns")
    si.http_spans(ev).drop("event_id").write.parquet(f"{path}/http")
    mark = 1704672000 * times.NS
    dns = spans.read_dns_spans(spark, f"{path}/dns", last_seen_ns=mark, inclusive=False, namespace="webapp")
    http = spans.read_http_spans(spark, f"{path}/http", start_ns=mark, pod="pod-1")
    return dns.select(F.lit("dns").alias("kind"), "time_", "pid").unionByName(
        http.select(F.lit("http").alias("kind"), "time_", "pid"))


@query
def profile_files(spark, d):
    """Profiles written as JSON lines, read back and split by kind."""
    pages = si.page_spans(si.table(spark, d, "pages"))
    kind = F.get(F.array(*[F.lit(k) for k in bundle_io.PROFILE_KINDS]), (F.col("page_id") % 5).cast("int"))
    rows = pages.select(F.col("pod").alias("workload"), kind.alias("kind"), F.when(
        F.col("page_id") % 2 == 0, F.lit("/a/" + bundle_io.WILDCARD)).otherwise(F.col("req_path")).alias("entry"))
    path = scratch_dir(spark, "profiles")
    rows.write.json(path)
    parts = bundle_io.split_profile(bundle_io.read_profiles(spark, path))
    out = None
    for name, part in parts.items():
        part = part.groupBy("is_wildcard").agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(name).alias("part"), "is_wildcard", "n")
        out = part if out is None else out.unionByName(part)
    return out


@query
def tail_retention(spark, d):
    """A tail of kernel logs: init rows dropped, rows older than the retention dropped."""
    long = si.kernel_long(si.events(spark, d)).drop("event_id")
    init = long.where("time < '2024-01-02'").select(F.lit(
        '{"time":"2024-01-20T10:00:16Z","node_name":"init","type":"process_exec",'
        '"payload":{"init":true}}').alias("value"))
    path = _write_lines(long.select(F.to_json(F.struct("*")).alias("value")).unionByName(init), spark, "tail")
    rows = tail.tail_files(spark, path, schemas.KERNEL_LONG)
    rows = rows.select("event_ts", F.col("payload.process.pid").alias("pid"), "node_name")
    kept = tail.within_retention(pipelines.drain_to_table(rows, "tail"), retention_hours=96)
    return kept.select("pid", "node_name")


@query
def keyed_store(spark, d):
    """Two rounds of upserts into the keyed store; the last write stays."""
    path = scratch_dir(spark, "store")
    o = si.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate",
                                            "o_orderstatus")
    for part in ("o_orderkey % 2 = 0", "o_orderkey % 2 = 1"):
        sinks.upsert(spark, path, o.where(part), ["o_custkey"], ["o_orderdate", "o_orderkey"],
                     buckets=8)
    return sinks.read_store(spark, path).select("o_custkey", "o_orderkey", "o_orderstatus")


@query
def store_growth(spark, d):
    """Three rounds of upserts into a store that doubles its slots, cleared of what is old."""
    path = scratch_dir(spark, "store")
    o = si.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    for part in (0, 1, 2):
        sinks.upsert(spark, path, o.where(F.col("o_orderkey") % 3 == part), ["o_custkey"], ["o_orderdate", "o_orderkey"],
                     buckets=2, rows_per_slot=100)
    sinks.vacuum(spark, path)
    return sinks.read_store(spark, path).select("o_custkey", "o_orderkey", "o_orderstatus")


@query
def table_compacted(spark, d):
    """Rows and files of each date of a table of six batches, old dates compacted after five."""
    root, rows = scratch_dir(spark, "compacted"), si.dns_spans(si.events(spark, d))
    for batch in range(6):
        if batch == 5:
            sinks.compact_table(spark, root, "dns_events", "2024-01-20")
            sinks.remove_compacted(spark, root, "dns_events")
        sinks.append_batch(rows.where(F.col("event_id") % 6 == batch), root, "dns_events", batch)
    sinks.compact_table(spark, root, "dns_events", "2024-01-20")
    table = sinks.read_table(spark, root, "dns_events").withColumn("file", F.input_file_name())
    return table.groupBy("dt").agg(F.count(F.lit(1)).alias("n"), F.sum("pid").alias("pids"), F.countDistinct("file").alias("f")).select(
        "dt", "n", "pids", F.when(F.col("dt") < "2024-01-20", F.col("f")).alias("files"))


@query
def queue_to_merged(spark, d):
    """Raw queue lines to stored bundles to bundles merged per rule."""
    wide = si.kernel_wide(si.events(spark, d))
    lines = wide.select(F.to_json(F.struct("*")).alias("value"))
    stored = cut_lineage(api.convert_queue(lines).select(
        "store_key", "bundle_id", "event_ts_ns", "objects"))
    return api.merge_by_rule(stored).groupBy("group_key", "type").agg(
        F.count(F.lit(1)).alias("n"))


# --- streams ----------------------------------------------------------------------------------------------

FILES = 4
ROW_GROUP = 1 << 20  # bytes: a batch is one file, and only row groups deal it to several tasks


def _event_files(raw, folder, places, late=False):
    """Events in files, one per batch, in the order of their time: those of ``places``."""
    first, last = raw.agg(F.unix_micros(F.min("ts")), F.unix_micros(F.max("ts"))).first()
    width = (last - first) // FILES + 1
    place = F.floor((F.unix_micros("ts") - F.lit(first)) / width)
    for i in places:
        rows = raw.where((place == i) | (place == 0) if late and i == FILES - 1 else place == i)
        rows.repartition(1).write.mode("append").option("parquet.block.size", ROW_GROUP).parquet(folder)


def _files_stream(spark, folder, schema):
    return si.event_fields(spread(pipelines.file_stream(spark, folder, schema, "*.parquet", files_per_trigger=1)))


def _event_stream(spark, d, late=False):
    """Events in four files, one per batch. With ``late`` the last file also holds the rows of
    the first again."""
    raw = si.utc(spark.read.parquet(f"{d}/events.parquet"))
    folder = scratch_dir(spark, "stream-events")
    _event_files(raw, folder, range(FILES), late)
    return _files_stream(spark, folder, raw.schema)


def _norm_stream(spark, d):
    return normalize.normalize_kernel(si.kernel_long(_event_stream(spark, d)))


@query
def stream_dedupe(spark, d):
    """One row per fingerprint and ten minutes of event time."""
    once = pipelines.dedupe_periods(_norm_stream(spark, d)).select(
        "dedup_key", F.unix_seconds("period").alias("period"))
    return pipelines.drain_to_table(once, "stream-dedupe")


@query
def stream_match(spark, d):
    """Stream to object and match tables in one pass per batch."""
    root, checkpoint = scratch_dir(spark, "stream-match"), scratch_dir(spark, "stream-match-cp")
    pipelines.match_etl(
        si.kernel_long(_event_stream(spark, d)), normalize.normalize_kernel,
        lambda: CORE_RULES, root, checkpoint).awaitTermination()
    rows = sinks.read_table(spark, root, "matched_rules")
    ids_of = F.from_json("matches", "array<struct<pattern_id:string>>")["pattern_id"]
    return rows.select(F.explode(ids_of).alias("pattern_id")).groupBy("pattern_id").agg(
        F.count(F.lit(1)).alias("n"))


@query
def stream_spans(spark, d):
    """Dual write of a span stream: raw rows and their objects."""
    root, checkpoint = scratch_dir(spark, "stream-spans"), scratch_dir(spark, "stream-spans-cp")
    pipelines.span_etl(
        si.dns_spans(_event_stream(spark, d)).drop("event_id"), normalize.normalize_dns, root,
        "dns_events", "dns_objects", checkpoint).awaitTermination()
    raw = sinks.read_table(spark, root, "dns_events").select("time_", "pid")
    objects = sinks.read_table(spark, root, "dns_objects").select(
        F.col("timestamp").alias("time_"),
        F.get_json_object("data", f"$.objects[0].extensions.{normalize.DNS_EXTENSION}.pid")
        .cast("bigint").alias("pid"))
    return raw.withColumn("written", F.lit("raw")).unionByName(
        objects.withColumn("written", F.lit("objects")))


@query
def stream_incremental(spark, d):
    """Periodic ETL with a plugged-in DataFrame function."""
    root, checkpoint = scratch_dir(spark, "stream-etl"), scratch_dir(spark, "stream-etl-cp")
    pipelines.incremental(
        si.alerts(_event_stream(spark, d)),
        lambda batch: normalize.object_rows(normalize.normalize_alert(batch)),
        root, "alert_objects", checkpoint).awaitTermination()
    return sinks.read_table(spark, root, "alert_objects").groupBy("pod_name", "namespace").agg(
        F.count(F.lit(1)).alias("n"), F.max("timestamp").alias("last"))


@query
def stream_rate(spark, d):
    return _rate(_event_stream(spark, d))


def _rate(events):
    rate = pipelines.rate_stream(events, "ts", ["event_type"], "1 hour")
    rate = rate.withColumn("hour", F.unix_seconds("minute")).drop("minute")
    return pipelines.drain_updates(rate, ["event_type", "hour"], "stream-rate")


@query
def stream_profile(spark, d):
    """Profiles learned and deviations reported while the events come in, in four batches."""
    root, checkpoint = scratch_dir(spark, "stream-profile"), scratch_dir(spark, "stream-profile-cp")
    behaviour = _behaviour_of(_event_stream(spark, d))
    pipelines.profile_etl(behaviour, root, checkpoint, minutes=3 * 24 * 60, salt_by=["event_id"]).awaitTermination()
    rows = spark.read.parquet(f"{root}/deviations").drop("batch", "event_ts")
    return rows.withColumn("alert", baseline.deviation_alert(F.lit("open")))


@query
def stream_equilibrium(spark, d):
    """Pods that appended nothing for a day, each time, up to the watermark."""
    quiet = pipelines.quiet_stream(_event_stream(spark, d), "ts", ["pod"], "24 hours")
    rows = pipelines.drain_to_table(quiet, "stream-quiet")
    return rows.select("pod", F.unix_micros("last").alias("last_us"))


@query
def stream_late(spark, d):
    """Rows far behind the watermark change nothing."""
    return _rate(_event_stream(spark, d, late=True))


@query
def stream_cooldown(spark, d):
    alerts = _event_stream(spark, d).where("event_type = 'error'")
    out = pipelines.cooldown_stream(alerts, ["namespace"], "ts", "6 hours", 3)
    out = out.withColumn("period", F.unix_seconds("period"))
    return pipelines.drain_updates(out, ["namespace", "period"], "stream-cooldown")


@query
def stream_observation_and(spark, d):
    first, then = _kinds()
    both = pipelines.observation_and_stream(_event_stream(spark, d), ["user_id"], "ts", first, then, "1 hour")
    both = both.withColumn("window_start", F.unix_seconds("window_start"))
    return pipelines.drain_updates(both, ["user_id", "window_start"], "stream-observation-and")


@query
def stream_rules(spark, d):
    """The rules of ``rule_sequences`` over a stream of four batches, stopped after two of them."""
    raw = si.utc(spark.read.parquet(f"{d}/events.parquet"))
    folder, root, checkpoint = (scratch_dir(spark, f"stream-rules{n}") for n in ("", "-out", "-cp"))
    for places in ((0, 1), (2, 3)):
        _event_files(raw, folder, places)
        pipelines.rules_etl(
            _files_stream(spark, folder, raw.schema), lambda ev: normalize.normalize_kernel(si.kernel_long(ev)),
            lambda: _loaded(spark, SEQUENCE_RULES), ["pod"], root, checkpoint).awaitTermination()
    return pipelines.rule_matches(spark, root).select("rule", "pod", "event_ts_ns")


@query
def stream_then_next_batch(spark, d):
    """A stream's table read by the read API: two batches after a mark, then the newest rows."""
    root, checkpoint = scratch_dir(spark, "stream-next"), scratch_dir(spark, "stream-next-cp")
    pipelines.span_etl(
        si.dns_spans(_event_stream(spark, d)).drop("event_id"), normalize.normalize_dns, root,
        "dns_events", "dns_objects", checkpoint).awaitTermination()
    tie = ["pid"]
    one = api.next_batch(spark, root, "dns_events", limit=10, tie=tie)
    last = one.orderBy(F.col("time_").desc(), F.col("pid").desc()).select("time_", "pid").first()
    two = api.next_batch(spark, root, "dns_events", tuple(last), 10, tie)
    new = api.query_table(spark, root, "dns_events", {"namespace": "webapp"}, 10)
    parts = [df.select(F.lit(name).alias("part"), "time_", "pid")
             for name, df in (("first", one), ("second", two), ("newest", new))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def stream_context(spark, d):
    ev = _event_stream(spark, d)
    a = ev.where("event_type = 'error'").select(F.col("event_id").alias("alert_id"),
                                                F.col("ts").alias("alert_ts"))
    s = ev.where("event_type != 'error'").select(F.col("event_id").alias("span_id"),
                                                 F.col("ts").alias("span_ts"))
    joined = pipelines.context_stream(a, s, "alert_ts", "span_ts")
    return pipelines.drain_to_table(joined.select("alert_id", "span_id"), "stream-context")


@query
def stream_repeats(spark, d):
    first, _ = _kinds()
    out = pipelines.repeats_stream(_event_stream(spark, d), ["user_id"], "ts", first, 2,
                                   "2 hours", "1 hour")
    return pipelines.drain_updates(out.withColumn("window_start", F.unix_seconds("window_start")),
                                   ["user_id", "window_start"], "stream-repeats")


@query
def stream_followed_by(spark, d):
    first, then = _kinds()
    ev = _event_stream(spark, d).select("event_id", "user_id", "event_type", "ts")
    out = pipelines.followed_by_stream(ev, ["user_id"], "ts", first, then, 7200)
    return pipelines.drain_to_table(out.select("event_id", "user_id"), "stream-followed-by")
