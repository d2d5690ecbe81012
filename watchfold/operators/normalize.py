"""Every log source to one wide row per log, and that row to JSON objects.

The normalised row is flat: predicates, joins and groupings all touch plain
columns, which keeps them inside generated code and lets Parquet prune them.
Objects are only printed at the sink, by ``process_object`` and friends.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import ids, text, times
from ..functions import fingerprints as fp
from .barrier import null_of, once

# Names the object format uses for the extension blocks.
KERNEL_EXTENSION = "x-tetra-ext"
DNS_EXTENSION = "x-pixie-dns-ext"
HTTP_EXTENSION = "x-pixie-http-ext"
HTTP_NOTE = "Pixie HTTP data wrapped in STIX observed-data"
DNS_NOTE = "Pixie DNS data wrapped in STIX observed-data"


def _fields(columns: dict[str, Column]) -> list[Column]:
    """The normalised columns; those not given are null."""
    return [
        (columns[f.name].cast(f.dataType.simpleString()) if f.name in columns
         else null_of(f.dataType.simpleString())).alias(f.name)
        for f in schemas.NORM.fields
    ]


def _norm(df: DataFrame, **columns: Column) -> DataFrame:
    return df.select(*_fields(columns))


def _blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


KERNEL_KINDS = ["process_exec", "process_kprobe"]


def normalize_kernel(df: DataFrame, v1_ids: bool = False) -> DataFrame:
    """exec and kprobe rows; exit rows carry no object and are left out.

    The promoted arguments come from the log root when the shipper put them
    there (columns kprobe0..4); the long form has none, which gives ``""``.
    The payload's own ``args`` stay available for rules that ask for them.
    """
    df = df.where(F.col("type").isin(*KERNEL_KINDS))
    promoted = None
    if "kprobe0" in df.columns:
        promoted = F.col("_k")
        df = once(df, "_k", F.struct(*[
            F.from_json(F.nullif(f"kprobe{i}", F.lit("null")), schemas.ARG).alias(f"k{i}") for i in range(text.ARG_SLOTS)
        ]), ["time", "node_name", "type", "payload"])
    return _norm(df, **_kernel_columns(F.col("payload"), F.col("node_name"), F.col("time"),
                                       F.col("type"), promoted, v1_ids))


def _kernel_columns(payload: Column, node: Column, time: Column, kind: Column,
                    promoted_args: Column | None, v1_ids: bool) -> dict[str, Column]:
    proc, parent = payload["process"], payload["parent"]
    container = _blank(proc["pod"]["container"]["id"])
    pid = F.coalesce(proc["pid"], F.lit(-1).cast("bigint"))
    start = proc["start_time"]
    if v1_ids:
        corr = ids.corr_id_v1(container, pid, node, start, "kernel")
    else:
        corr = ids.corr_id(container, pid, node, start, kernel=True)
    is_kprobe = kind == "process_kprobe"
    if promoted_args is not None:
        promoted = {
            f"k{i}": F.when(is_kprobe, text.arg_text(promoted_args[f"k{i}"])).otherwise("")
            for i in range(text.ARG_SLOTS)
        }
    else:
        promoted = {f"k{i}": F.lit("") for i in range(text.ARG_SLOTS)}
    seen_at = F.coalesce(time, start)
    ns = times.iso_to_ns(seen_at)
    return dict(
        source=F.lit("kernel"), event_ts=times.ns_to_ts(ns), event_ts_ns=ns,
        time_text=seen_at, node=node, pod=_blank(proc["pod"]["name"]),
        namespace=_blank(proc["pod"]["namespace"]), container_id=container, pid=pid,
        command_line=text.command_line(proc["binary"], proc["arguments"]), cwd=proc["cwd"],
        created_time=start, function_name=_blank(payload["function_name"]),
        image_id=_blank(proc["pod"]["container"]["image"]["id"]), flags=_blank(proc["flags"]),
        parent_pid=parent["exec_id"],
        parent_command_line=text.command_line(parent["binary"], parent["arguments"]),
        parent_cwd=parent["cwd"], grand_parent_pid=parent["parent_exec_id"], **promoted,
        args=payload["args"], alert_name=payload["action"], rule_id=payload["policy_name"],
        children=F.lit(""), corr_id=corr, process_id=ids.process_id(corr),
        observed_id=ids.object_id("observed-data", corr, seen_at, payload["function_name"]),
        dedup_key=F.concat(
            fp.kernel_fingerprint(payload, is_kprobe), fp.kind_suffix(kind)),
    )


def normalize_alert(df: DataFrame, v1_ids: bool = False) -> DataFrame:
    """Runtime alerts. The newer form keys on the parent pid and the pod name,
    so that ids meet those of the kernel and span sources; the older form keys
    on the tree's pid and the cloud instance."""
    return _norm(df, **_alert_columns(F.col, v1_ids))


def _alert_columns(c: Callable[[str], Column], v1_ids: bool = False) -> dict[str, Column]:
    base, k8s = c("BaseRuntimeMetadata"), c("RuntimeK8sDetails")
    tree = c("RuntimeProcessDetails")["processTree"]
    node = c("event")["k8s"]["node"]
    container = _blank(k8s["containerID"])
    minus = F.lit(-1).cast("bigint")
    if v1_ids:
        pid = F.coalesce(tree["pid"], minus)
        created = base["timestamp"]
        host = _blank(c("CloudMetadata")["instance_id"])
        corr = ids.corr_id_v1(container, pid, host, created)
        node, pod = host, _blank(k8s["podName"])
        seen_at = F.coalesce(c("time"), created)
    else:
        pid = F.coalesce(tree["ppid"], minus)
        pod = F.coalesce(k8s["podName"], F.lit(ids.UNKNOWN_HOST))
        created = F.coalesce(c("time"), F.lit("UnknownTime"))
        corr = ids.corr_id(container, pid, pod, created)
        seen_at = created
    ns = F.coalesce(times.iso_to_ns(c("time")), c("event")["timestamp"])
    args = base["arguments"]
    return dict(
        source=F.lit("alert"), event_ts=times.ns_to_ts(ns), event_ts_ns=ns,
        time_text=seen_at, node=_blank(node), pod=pod, namespace=_blank(k8s["namespace"]),
        container_id=container, pid=pid, command_line=_blank(tree["cmdline"]),
        cwd=_blank(tree["cwd"]), created_time=created, function_name=_blank(c("RuleID")),
        image_id=_blank(k8s["image"]), flags=_blank(c("message")),
        parent_pid=F.coalesce(tree["ppid"], minus), parent_command_line=_blank(tree["pcomm"]),
        parent_cwd=F.lit(""), grand_parent_pid=F.lit(""),
        k0=_blank(args["capability"]), k1=_blank(args["syscall"]),
        k2=F.coalesce(base["trace"], F.lit("{}")),
        k3=F.coalesce(base["severity"].cast("string"), F.lit("{}")),
        k4=F.coalesce(base["infectedPID"].cast("string"), F.lit("{}")),
        alert_flags=args["flags"], alert_name=_blank(base["alertName"]),
        rule_id=_blank(c("RuleID")), children=F.coalesce(tree["children"], F.lit("[]")),
        corr_id=corr, process_id=ids.process_id(corr),
        observed_id=ids.object_id("observed-data", corr, seen_at, c("RuleID")),
        dedup_key=fp.alert_fingerprint(base, k8s, c("RuntimeProcessDetails")),
    )


def normalize_trace(df: DataFrame) -> DataFrame:
    """Syscall traces; nested arguments become one flat map."""
    # Qualified, since a row has an ``args`` of its own that is built beside these.
    return _norm(df.alias("_trace"), **_trace_columns(lambda name: F.col("_trace." + name)))


def _trace_columns(c: Callable[[str], Column]) -> dict[str, Column]:
    seen_at = times.ns_to_iso_millis(c("timestamp"))
    container = _blank(c("container")["id"])
    pid = F.coalesce(c("processId"), F.lit(-1).cast("bigint"))
    host = _blank(c("hostName"))
    corr = ids.corr_id_v1(container, pid, host, seen_at)
    meta = c("metadata")["Properties"]
    row = {n: c(n) for n in
           ("cgroupId", "containerId", "eventName", "args", "mountNamespace", "pidNamespace")}
    return dict(
        source=F.lit("trace"), event_ts=times.ns_to_ts(c("timestamp")),
        event_ts_ns=c("timestamp"), time_text=seen_at, node=host,
        pod=_blank(c("kubernetes")["podName"]),
        namespace=_blank(c("kubernetes")["podNamespace"]), container_id=container, pid=pid,
        command_line=_blank(c("processName")), cwd=F.lit(""), created_time=seen_at,
        function_name=_blank(c("syscall")), image_id=_blank(c("container")["image"]),
        flags=F.lit(""), trace_args=text.flatten_trace_args(c("args")),
        alert_name=_blank(meta["signatureName"]), rule_id=_blank(meta["signatureID"]),
        interpretation=text.interpretation(
            meta["Category"], meta["Technique"], meta["external_id"]),
        extra_ref=_blank(meta["id"]), children=F.lit(""),
        corr_id=corr, process_id=ids.process_id(corr),
        observed_id=ids.object_id("observed-data", corr, seen_at, meta["signatureID"]),
        dedup_key=fp.trace_fingerprint(row),
    )


def normalize_rule_alert(df: DataFrame) -> DataFrame:
    """Rule-engine alerts. Their tty stands in for the pid, which they lack."""
    return _norm(df, **_rule_alert_columns(F.col))


def _rule_alert_columns(c: Callable[[str], Column]) -> dict[str, Column]:
    def field(key):
        return F.try_element_at(c("interesting"), F.lit(key))

    def word(key):
        return F.coalesce(field(key), F.lit("None"))

    seen_at = c("timestamp")
    container = _blank(field("container.id"))
    pid = F.coalesce(field("proc.tty"), F.lit("-1"))
    host = _blank(c("hostname"))
    corr = ids.corr_id_v1(container, pid, host, seen_at, "rule_alert")
    ns = times.iso_to_ns(seen_at)
    return dict(
        source=F.lit("rule_alert"), event_ts=times.ns_to_ts(ns), event_ts_ns=ns,
        time_text=seen_at, node=host, pod=_blank(field("k8s.pod.name")),
        namespace=_blank(field("k8s.pod.namespace")), container_id=container,
        pid=pid.try_cast("bigint"), command_line=word("proc.commandline"),
        cwd=_blank(field("proc.exepath")), created_time=F.coalesce(field("evt.time"), seen_at),
        function_name=F.lit(""),
        image_id=F.concat(word("container.image.repository"), F.lit(" "),
                          word("container.image.tag")),
        flags=_blank(field("evt.arg.flags")),
        parent_pid=F.coalesce(field("proc.ppid"), F.lit("-1")),
        parent_command_line=word("proc.pname"),
        k0=_blank(field("fd.l4proto")), k1=_blank(field("fd.name")),
        k2=_blank(field("fd.type")), k3=_blank(field("evt.res")), k4=_blank(field("user.name")),
        alert_name=_blank(c("priority")), rule_id=_blank(c("rule")),
        interpretation=F.array_join(c("tags"), ", "), children=F.lit(""),
        corr_id=corr, process_id=ids.process_id(corr),
        observed_id=ids.object_id("observed-data", corr, seen_at, c("rule")),
        dedup_key=fp.rule_alert_fingerprint(c("interesting")),
    )


def union_sources(*frames: DataFrame) -> DataFrame:
    """All normalised sources as one table."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


# A dispatcher field and the source it marks, in the order they are tried.
DISCRIMINATORS = [
    ("process_exec", "kernel"), ("process_kprobe", "kernel"),
    ("BaseRuntimeMetadata", "alert"), ("matchedPolicies", "trace"),
    ("interesting", "rule_alert"),
]


def source_of(json_text: Column) -> Column:
    """Which source a raw JSON line comes from, by the key it has."""
    keys = F.json_object_keys(json_text)
    out = F.lit(None).cast("string")
    for key, name in reversed(DISCRIMINATORS):
        out = F.when(F.array_contains(keys, key), F.lit(name)).otherwise(out)
    return out


def normalize_mixed(lines: DataFrame, column: str = "value") -> DataFrame:
    """A mixed queue of JSON lines: each line to its source's normaliser.

    One scan: a line's keys name its source, and it is parsed once, with that
    source's schema. Lines of no known source and lines that are not JSON give
    no row, and neither do exit rows.
    """
    line, src = F.col("_line"), F.col("_src")
    tagged = once(lines, "_src", source_of(F.col(column)), [F.col(column).alias("_line")])
    tagged = tagged.where(src.isNotNull())

    def parsed(name, schema):
        return F.when(src == name, F.from_json(line, schema)).alias(name)

    docs = once(tagged, "_doc", F.struct(
        parsed("kernel", schemas.KERNEL_WIDE), parsed("alert", schemas.ALERT),
        parsed("trace", schemas.TRACE), parsed("rule_alert", schemas.RULE_ALERT)), ["_src"])
    kernel = F.col("_doc.kernel")
    slots = once(docs, "_k", F.when(src == "kernel", F.struct(*[
        F.coalesce(
            F.from_json(F.nullif(kernel[f"kprobe{i}"], F.lit("null")), schemas.ARG),
            F.get(kernel["process_kprobe"]["args"], F.lit(i))).alias(f"k{i}")
        for i in range(text.ARG_SLOTS)])))
    kind = (
        F.when(kernel["process_exec"].isNotNull(), "process_exec")
        .when(kernel["process_exit"].isNotNull(), "process_exit")
        .otherwise("process_kprobe")
    )
    payload = F.coalesce(kernel["process_exec"], kernel["process_kprobe"])
    rows = slots.where((src != "kernel") | kind.isin(*KERNEL_KINDS))

    def of(name):
        return lambda field: F.col(f"_doc.{name}")[field]

    norm = (
        F.when(src == "kernel", F.struct(*_fields(_kernel_columns(
            payload, kernel["node_name"], kernel["time"], kind, F.col("_k"), False))))
        .when(src == "alert", F.struct(*_fields(_alert_columns(of("alert")))))
        .when(src == "trace", F.struct(*_fields(_trace_columns(of("trace")))))
        .when(src == "rule_alert", F.struct(*_fields(_rule_alert_columns(of("rule_alert")))))
    )
    return once(rows, "_norm", norm, []).select("_norm.*")


# --- objects as JSON text ----------------------------------------------------

def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))


def _raw(c: Column) -> Column:
    """A text column that already holds JSON, to be printed unquoted."""
    return F.try_parse_json(c)


def process_object(flat: bool = False) -> Column:
    """The ``process`` object of a normalised row, per source.

    Kernel rows nest their fields under an extension block unless ``flat``.
    """
    c = F.col
    kernel_fields = dict(
        flags=c("flags"), image_id=c("image_id"), container_id=c("container_id"),
        pod_name=c("pod"), namespace=c("namespace"), function_name=c("function_name"),
        parent_pid=c("parent_pid"), parent_command_line=c("parent_command_line"),
        parent_cwd=c("parent_cwd"), grand_parent_pid=c("grand_parent_pid"),
        kprobe0=c("k0"), kprobe1=c("k1"), kprobe2=c("k2"), kprobe3=c("k3"), kprobe4=c("k4"),
    )

    def struct(fields):
        return F.struct(*[v.alias(k) for k, v in fields.items()])

    if flat:
        kernel_ext = struct(kernel_fields)
    else:
        kernel_ext = struct({KERNEL_EXTENSION: struct(
            {"extension_type": F.lit("property-extension"), **kernel_fields})})
    alert_ext = struct({
        "container_id": c("container_id"), "flags": c("flags"), "image_id": c("image_id"),
        "pod_name": c("pod"), "namespace": c("namespace"), "function_name": c("function_name"),
        "parent_pid": c("parent_pid").try_cast("bigint"),
        "parent_command_line": c("parent_command_line"),
        "kprobe0.capability": c("k0"), "kprobe1.syscall": c("k1"), "kprobe2.trace": _raw(c("k2")),
        "kprobe3.severity": _raw(c("k3")), "kprobe4.infectedPID": _raw(c("k4")),
    })
    trace_ext = struct({
        "container_id": c("container_id"), "flags": c("flags"), "image_id": c("image_id"),
        "pod_name": c("pod"), "namespace": c("namespace"), "function_name": c("function_name"),
        "kprobe_arguments": c("trace_args"),
    })
    rule_ext = struct({
        "flags": c("flags"), "image_id": c("image_id"), "container_id": c("container_id"),
        "pod_name": c("pod"), "namespace": c("namespace"), "function_name": c("function_name"),
        "parent_pid": c("parent_pid"), "parent_command_line": c("parent_command_line"),
        "kprobe0.fdl4proto": c("k0"), "kprobe1.fdname": c("k1"), "kprobe2.fdtype": c("k2"),
        "kprobe3.evtres": c("k3"), "kprobe4.username": c("k4"),
    })

    def whole(ext):
        return _json(type=F.lit("process"), id=c("process_id"), pid=c("pid"),
                     command_line=c("command_line"), cwd=c("cwd"),
                     created_time=c("created_time"), extensions=ext)

    return (
        F.when(c("source") == "kernel", whole(kernel_ext))
        .when(c("source") == "alert", whole(alert_ext))
        .when(c("source") == "trace", whole(trace_ext))
        .when(c("source") == "rule_alert", whole(rule_ext))
    )


def observed_object(more_refs: Column | None = None, flat: bool = False) -> Column:
    """The ``observed-data`` object; ``more_refs`` are appended to its refs."""
    c = F.col
    refs = F.array_compact(F.array(c("process_id"), c("extra_ref")))
    if more_refs is not None:
        refs = F.concat(refs, more_refs)
    ext = {
        "alert_name": c("alert_name"), "correlation": c("corr_id"), "rule_id": c("rule_id"),
    }

    def struct(fields):
        return F.struct(*[v.alias(k) for k, v in fields.items()])

    kernel_fields = {
        **ext, "node_info": F.struct(c("node").alias("node_name")), "children": c("children"),
    }
    if flat:
        kernel_ext = struct(kernel_fields)
    else:
        kernel_ext = struct({KERNEL_EXTENSION: struct(
            {"extension_type": F.lit("toplevel-property-extension"), **kernel_fields})})
    alert_ext = struct({**ext, "node_info": c("node"), "children": _raw(c("children"))})
    other_ext = struct({**ext, "interpretation": c("interpretation"), "node_info": c("node"),
                        "children": c("children")})

    def whole(created: list[str], extensions):
        t = c("time_text")
        return _json(
            type=F.lit("observed-data"), id=c("observed_id"), **{k: t for k in created},
            first_observed=t, last_observed=t, number_observed=F.lit(1), object_refs=refs,
            extensions=extensions)

    return (
        F.when(c("source") == "kernel", whole(["created"], kernel_ext))
        .when(c("source") == "alert", whole(["created_time"], alert_ext))
        .otherwise(whole(["created", "modified"], other_ext))
    )


def object_rows(norm: DataFrame) -> DataFrame:
    """Object-table rows: timestamp, pod, namespace and both objects as JSON."""
    data = F.concat(F.lit("["), process_object(), F.lit(","), observed_object(), F.lit("]"))
    unknown = F.lit("unknown")
    return norm.select(
        F.col("time_text").alias("timestamp"),
        F.coalesce(F.nullif("pod", F.lit("")), unknown).alias("pod_name"),
        F.coalesce(F.nullif("namespace", F.lit("")), unknown).alias("namespace"),
        data.alias("data"),
    )


# --- spans -------------------------------------------------------------------

def _traffic(df: DataFrame, seen_at: Column, kind: str, protocol: str, extension: str,
             note: str, fields: dict[str, Column]) -> DataFrame:
    """network-traffic and observed-data objects of a span, plus flat columns."""
    corr = ids.corr_id(F.col("container_id"), F.col("pid"),
                       F.coalesce("pod_name", F.lit(ids.UNKNOWN_HOST)), seen_at)
    raw = F.to_json(F.struct(*df.columns))
    out = df.withColumns({
        "_seen": seen_at, "corr_id": corr, "_raw": raw,
        **{f"_{k}": v for k, v in fields.items()},
    })
    out = out.withColumn(
        "traffic_id", ids.object_id("network-traffic", F.col("corr_id"), F.col("_raw")))
    c = F.col
    ext = F.struct(
        c("pid"), c("container_id"), c("pod_name"), c("namespace"), c("node_name"),
        *[c(f"_{k}").alias(k) for k in fields],
        c("remote_addr").alias("src_ip"), c("local_addr").alias("dst_ip"),
        c("remote_port").alias("src_port"), c("local_port").alias("dst_port"),
        F.struct(*[c(x) for x in df.columns]).alias("raw_row"),
    )
    traffic = _json(
        type=F.lit("network-traffic"), id=c("traffic_id"), protocols=F.array(F.lit(protocol)),
        extensions=F.struct(ext.alias(extension)), start=c("_seen"))
    observed = _json(
        type=F.lit("observed-data"), id=ids.object_id("observed-data", c("traffic_id")),
        created_time=c("_seen"), first_observed=c("_seen"), last_observed=c("_seen"),
        number_observed=F.lit(1), object_refs=F.array(c("traffic_id")),
        extensions=F.struct(c("corr_id").alias("correlation"), F.lit(note).alias("note")))
    return out.select(
        F.lit(kind).alias("kind"), c("time_").alias("timestamp"), c("_seen").alias("start"),
        c("pod_name"), c("namespace"), c("corr_id"), c("traffic_id"),
        *[c(f"_{k}").alias(k) for k in fields],
        F.array(traffic, observed).alias("objects"),
    )


def normalize_http(df: DataFrame, strict_time: bool = True) -> DataFrame:
    fields = {
        "method": F.col("req_method"),
        "url": text.url(F.col("local_addr"), F.col("local_port"), F.col("req_path")),
        "status_code": F.col("resp_status"),
        "headers": F.from_json("req_headers", "map<string,string>"),
    }
    seen_at = times.epoch_to_iso(F.col("time_"), strict_time)
    return _traffic(df, seen_at, "http", "tcp", HTTP_EXTENSION, HTTP_NOTE, fields)


def dns_fields() -> dict[str, Column]:
    """Query name and type, response code and answers of a DNS span."""
    query = F.get(F.from_json("req_body", schemas.DNS_REQUEST)["queries"], F.lit(0))
    return {
        "query_name": query["name"], "query_type": query["type"],
        "response_code": F.from_json("resp_header", schemas.DNS_HEADER)["rcode"],
        "answers": F.coalesce(
            F.from_json("resp_body", schemas.DNS_REPLY)["answers"],
            F.array().cast("array<string>")),
    }


def normalize_dns(df: DataFrame, strict_time: bool = True) -> DataFrame:
    """The span's own time is used, so the result does not change with the
    clock of the run."""
    seen_at = times.epoch_to_iso(F.col("time_"), strict_time)
    return _traffic(df, seen_at, "dns", "udp", DNS_EXTENSION, DNS_NOTE, dns_fields())


def span_object_rows(traffic: DataFrame) -> DataFrame:
    """Object-table rows of spans: timestamp and the bundle as JSON."""
    bundle = F.concat(
        F.lit('{"type":"bundle","id":"'), ids.object_id("bundle", F.col("traffic_id")),
        F.lit('","spec_version":"2.1","objects":['), F.array_join("objects", ","), F.lit("]}"),
    )
    return traffic.select("timestamp", bundle.alias("data"))
