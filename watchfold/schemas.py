"""Row types of the input logs, the normalised log and the result tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields.items()])


S, L, I, B, D = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType(), T.DoubleType()
SMALL = T.ShortType()

# --- kernel-process log -----------------------------------------------------
# Field names and types as the source writes them.

IMAGE = _struct(id=S, name=S)
CONTAINER = _struct(id=S, name=S, start_time=S, pid=L, image=IMAGE)
POD = _struct(
    namespace=S, name=S, workload=S, workload_kind=S,
    pod_labels=T.MapType(S, S), container=CONTAINER,
)
PROC = _struct(
    exec_id=S, pid=L, uid=L, auid=L, cwd=S, binary=S, arguments=S, flags=S,
    start_time=S, docker=S, parent_exec_id=S, refcnt=L, tid=L, in_init_tree=B, pod=POD,
)
SOCK_ARG = _struct(
    family=S, type=S, protocol=S, saddr=S, daddr=S, sport=L, dport=L, cookie=L, state=S,
)
FILE_ARG = _struct(path=S, permission=S)
ARG = _struct(
    int_arg=L, string_arg=S, size_arg=L, bytes_arg=S, file_arg=FILE_ARG,
    truncated_bytes_arg=_struct(bytes_arg=S, orig_size=L), sock_arg=SOCK_ARG,
)
KERNEL_PAYLOAD = _struct(
    process=PROC, parent=PROC, function_name=S, args=T.ArrayType(ARG),
    action=S, policy_name=S, return_action=S, init=B, dedup=S,
)
# A promoted argument is either an argument object or a bare word such as
# "null", so it is kept as JSON text.
KERNEL_WIDE = _struct(
    node_name=S, time=S, process_exec=KERNEL_PAYLOAD, process_exit=KERNEL_PAYLOAD,
    process_kprobe=KERNEL_PAYLOAD, kprobe0=S, kprobe1=S, kprobe2=S, kprobe3=S, kprobe4=S,
    md5_hash=S, dedup=S,
)
KERNEL_LONG_TEXT = _struct(time=S, node_name=S, type=S, payload=S)
KERNEL_LONG = _struct(time=S, node_name=S, type=S, payload=KERNEL_PAYLOAD)

# --- runtime alert log ------------------------------------------------------
# Field names and types as the source writes them.

ALERT_ARGUMENTS = _struct(
    syscall=S, capability=S, path=S, exec=S, args=T.ArrayType(S),
    flags=T.ArrayType(S), retval=L,
)
# ``trace`` and ``children`` are open-ended and kept as JSON text.
ALERT_BASE = _struct(
    alertName=S, arguments=ALERT_ARGUMENTS, infectedPID=L, severity=I, size=S,
    timestamp=S, md5Hash=S, sha1Hash=S, trace=S, node_name=S, exec_id=S,
    startTime=S, auid=L, flags=S, cwd=S, path=S, in_init_tree=B, parent_exec_id=S,
)
ALERT_CLOUD = _struct(instance_id=S)
ALERT_K8S = _struct(
    clusterName=S, containerName=S, image=S, imageDigest=S, namespace=S, containerID=S,
    podName=S, podNamespace=S, workloadName=S, workloadNamespace=S, workloadKind=S,
    hostNetwork=B, podLabels=T.MapType(S, S),
)
ALERT_TREE = _struct(
    pid=L, ppid=L, uid=L, gid=L, cmdline=S, comm=S, pcomm=S, cwd=S, path=S,
    startTime=S, children=S, childrenMap=S,
)
ALERT_PROCESS = _struct(containerID=S, processTree=ALERT_TREE)
ALERT_EVENT = _struct(
    runtime=_struct(
        runtimeName=S, containerId=S, containerName=S,
        containerImageName=S, containerImageDigest=S,
    ),
    k8s=_struct(
        namespace=S, podName=S, podLabels=T.MapType(S, S), containerName=S, node=S,
        workloadName=S, workloadKind=S,
    ),
    timestamp=L, type=S,
)
ALERT_ROOT_KEYS = [
    "BaseRuntimeMetadata", "CloudMetadata", "RuleID", "RuntimeK8sDetails",
    "RuntimeProcessDetails", "event", "level", "message", "msg", "time",
]
ALERT_TEXT = _struct(**{k: S for k in ALERT_ROOT_KEYS})
ALERT = _struct(
    BaseRuntimeMetadata=ALERT_BASE, CloudMetadata=ALERT_CLOUD, RuleID=S,
    RuntimeK8sDetails=ALERT_K8S, RuntimeProcessDetails=ALERT_PROCESS, event=ALERT_EVENT,
    level=S, message=S, msg=S, time=S,
)

# --- syscall trace and rule-engine alerts -----------------------------------
# Field names and types as the source writes them.

TRACE_ARG = _struct(name=S, type=S, value=S)
TRACE = _struct(
    timestamp=L, processId=L, processName=S, hostName=S, syscall=S, eventName=S,
    containerId=S, cgroupId=L, mountNamespace=L, pidNamespace=L,
    container=_struct(id=S, image=S), kubernetes=_struct(podName=S, podNamespace=S),
    metadata=_struct(
        Properties=_struct(
            signatureName=S, signatureID=S, Category=S, Technique=S, external_id=S, id=S,
        )
    ),
    args=T.ArrayType(TRACE_ARG), matchedPolicies=S,
)
RULE_ALERT_MESSAGE = _struct(
    output_fields=T.MapType(S, S), rule=S, source=S, priority=S,
    tags=T.ArrayType(S), hostname=S,
)
RULE_ALERT = _struct(
    timestamp=S, hostname=S, rule=S, source=S, priority=S,
    tags=T.ArrayType(S), interesting=T.MapType(S, S),
)

# --- spans ------------------------------------------------------------------
# Field names and types as the source writes them.

HTTP_SPAN = _struct(
    time_=L, upid=S, remote_addr=S, remote_port=I, local_addr=S, local_port=I,
    trace_role=SMALL, encrypted=SMALL, major_version=I, minor_version=I, content_type=I,
    req_headers=S, req_method=S, req_path=S, req_body=S, req_body_size=L, resp_headers=S,
    resp_status=I, resp_message=S, resp_body=S, resp_body_size=L, latency=L,
    pod_name=S, namespace=S, container_id=S, pid=L, node_name=S,
)
DNS_SPAN = _struct(
    time_=L, upid=S, remote_addr=S, remote_port=I, local_addr=S, local_port=I,
    trace_role=SMALL, encrypted=SMALL, req_header=S, req_body=S, resp_header=S,
    resp_body=S, latency=L, pod_name=S, namespace=S, container_id=S, pid=L, node_name=S,
)
DNS_REQUEST = _struct(queries=T.ArrayType(_struct(name=S, type=S)))
DNS_HEADER = _struct(txid=L, qr=I, rcode=I)
DNS_REPLY = _struct(answers=T.ArrayType(S))

# --- normalised log ---------------------------------------------------------

NORM = _struct(
    source=S, event_ts=T.TimestampType(), event_ts_ns=L, time_text=S, node=S, pod=S,
    namespace=S, container_id=S, pid=L, command_line=S, cwd=S, created_time=S,
    function_name=S, image_id=S, flags=S, parent_pid=S, parent_command_line=S,
    parent_cwd=S, grand_parent_pid=S, k0=S, k1=S, k2=S, k3=S, k4=S,
    args=T.ArrayType(ARG), alert_flags=T.ArrayType(S), trace_args=T.MapType(S, S),
    alert_name=S, rule_id=S, interpretation=S, extra_ref=S, children=S,
    corr_id=S, process_id=S, observed_id=S, dedup_key=S,
)

# --- bundles, profiles ------------------------------------------------------

PROFILE = _struct(
    workload_kind=S, workload=S, namespace=S, container=S, kind=S, entry=S, detail=S,
)
BUNDLE_LINE = _struct(type=S, id=S, spec_version=S, objects=T.ArrayType(S))

# Result tables: columns, and the column rows are sorted by inside a file.
RESULT_TABLES: dict[str, tuple[T.StructType, str]] = {
    "alert_logs": (ALERT_TEXT, "time"),
    "alert_objects": (_struct(timestamp=S, pod_name=S, namespace=S, data=S), "timestamp"),
    "kernel_logs": (KERNEL_LONG_TEXT, "time"),
    "kernel_objects": (_struct(timestamp=S, pod_name=S, namespace=S, data=S), "timestamp"),
    "matched_rules": (_struct(timestamp=S, bundle=S, matches=S), "timestamp"),
    "http_events": (HTTP_SPAN, "time_"),
    "http_objects": (_struct(timestamp=L, data=S), "timestamp"),
    "dns_events": (DNS_SPAN, "time_"),
    "dns_objects": (_struct(timestamp=L, data=S), "timestamp"),
}
