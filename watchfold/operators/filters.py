"""Row filters and column shaping shared by the pipelines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .skew import salted_join

# Fixed values -----------------------------------------------------------------
EXPORT_EVENT_SET = ["process_kprobe", "process_exec"]
EXPORT_DENIED_NAMESPACES = [
    "", "storm", "cert-manager", "honey", "cilium", "kube-system", "gmp-system", "pl", "olm",
    "px-operator",
]
SHIPPER_DENIED_NAMESPACES = ["honey", "storm"]
BINDING_EXCLUDED_NAMESPACES = [
    "kubescape", "kube-system", "cert-manager", "openebs", "kube-public", "kube-flannel",
    "kube-node-lease", "kubeconfig", "gmp-system", "gmp-public", "honey", "storm", "lightening",
]
FILE_ACCESS_RULE = "Unexpected file access"
FILE_ACCESS_PREFIXES = [
    "/proc",
    "/run/secrets/kubernetes.io/serviceaccount",
    "/var/run/secrets/kubernetes.io/serviceaccount",
    "/tmp",
    "/etc",
    "/var/spool/cron/",
    "/var/log/",
    "/var/run/",
    "/dev/shm/",
    "/run/",
    "/var/www/",
    "/var/lib/docker/",
    "/opt/",
    "/usr/local/",
    "/app/",
    "/.dockerenv",
    "/proc/self/environ",
    "/var/lib/kubelet/",
    "/etc/cni/net.d/",
    "/var/run/secrets/kubernetes.io/",
    "/var/run/secrets/kubernetes.io/serviceaccount/",
    "/run/containerd/",
    "/run/flannel/",
    "/run/calico/",
]
BOUND_RULES = [
    "Unexpected process launched",
    "Unexpected file access",
    "Unexpected system call",
    "Unexpected capability used",
    "Unexpected domain request",
    "Unexpected Service Account Token Access",
    "Kubernetes Client Executed",
    "Exec from malicious source",
    "Kernel Module Load",
    "Exec Binary Not In Base Image",
    "Fileless Execution",
    "XMR Crypto Mining Detection",
    "Exec from mount",
    "Crypto Mining Related Port Communication",
    "Crypto Mining Domain Communication",
    "Read Environment Variables from procfs",
    "eBPF Program Load",
    "Symlink Created Over Sensitive File",
    "Unexpected Sensitive File Access",
    "Hardlink Created Over Sensitive File",
    "Exec to pod",
    "Port forward",
    "Malicious Ptrace Usage",
    "Cross-Site Scripting (XSS) Attempt",
    "SQL Injection Attempt",
    "Server-Side Request Forgery Attack Attempt",
    "Remote File Inclusion Attack Attempt",
    "Local File Inclusion Attempt",
    "XML External Entity Attack Attempt",
    "Server-Side Template Injection Attack",
    "Command Injection Attempt",
    "Unexpected Exec Source",
    "Unexpected Open Source",
    "Unexpected Symlink Source",
    "Unexpected Hardlink Source",
    "Unexpected io_uring Operation Detected",
    "ReDoS Attack",
    "Prototype Pollution Attack",
    "Execution of base64 Encoded Command",
    "Execution of interpreter command",
    "Code Sharing Site Access",
    "Web Application File Write Access",
    "Cron Job File Created or Modified",
    "Hidden File Created",
    "Reverse Shell Patterens Detected",
    "Unauthorized IMDS Connection Attempt",
    "Credentials Detection Attempts",
    "HTTP Request Smuggling Attempt",
]
PROCESS_LAUNCH_MESSAGE = "Unexpected process launched"
CLUSTER_NAMES = "^.*.cluster.local$"
# -------------------------------------------------------------------------------


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def not_in(c: Column, values: list[str]) -> Column:
    """``NOT IN`` under which a missing value passes."""
    return F.coalesce(~c.isin(values), F.lit(True))


def message_contains(df: DataFrame, needle: str = PROCESS_LAUNCH_MESSAGE,
                     column: str = "message") -> DataFrame:
    return df.where(F.col(column).contains(needle))


def shipped_traces(df: DataFrame, namespace: str = "kubernetes.podNamespace",
                   args: str = "args") -> DataFrame:
    """Namespace deny list, and arguments must be present."""
    return df.where(not_in(F.col(namespace), SHIPPER_DENIED_NAMESPACES) & F.col(args).isNotNull())


def export_filter(df: DataFrame, kind: str = "type",
                  namespace: str = "payload.process.pod.namespace",
                  health_check: str | None = None) -> DataFrame:
    """Event set, namespaces and health checks the sensor does not export.

    A row without a namespace counts as namespace ``""``, which is denied.
    """
    keep = F.col(kind).isin(EXPORT_EVENT_SET) & ~F.coalesce(F.col(namespace), F.lit("")).isin(
        EXPORT_DENIED_NAMESPACES)
    if health_check:
        keep = keep & ~F.coalesce(F.col(health_check), F.lit(False))
    return df.where(keep)


def equality_filters(df: DataFrame, filters: dict[str, object], allowed: list[str]) -> DataFrame:
    """AND of equality tests; keys that are not allowed are ignored."""
    return df.where(all_of([F.col(k) == F.lit(v) for k, v in filters.items() if k in allowed]))


def outside_cluster(name: Column) -> Column:
    """Full-match reject of cluster-local names; a missing name passes."""
    return F.coalesce(~name.rlike(CLUSTER_NAMES), F.lit(True))


def rule_binding(df: DataFrame, namespace: str = "namespace", alert: str = "alert_name",
                 path: str = "path") -> DataFrame:
    """Alerts whose namespace, rule name and (for file access) path are bound."""
    under_prefix = any_of([F.col(path).startswith(p) for p in FILE_ACCESS_PREFIXES])
    return df.where(
        not_in(F.col(namespace), BINDING_EXCLUDED_NAMESPACES)
        & F.col(alert).isin(BOUND_RULES)
        & ((F.col(alert) != FILE_ACCESS_RULE) | F.coalesce(under_prefix, F.lit(False)))
    )


def http_endpoints(spans: DataFrame, pod_dim: DataFrame, pod: str = "pod",
                   salt_by: list[str] | None = None) -> DataFrame:
    """Source and destination of a span from the side that traced it.

    ``pod_dim(ip, pod_of_ip)`` names remote addresses that are pods; an unknown
    address keeps its IP. Spans without one of the two ends are rejected.
    """
    by_ip = pod_dim.select(F.col("ip").alias("remote_addr"), "pod_of_ip")
    named = salted_join(spans, by_ip, ["remote_addr"], "left", salt_by or [pod, "req_path"])
    remote_pod = F.coalesce("pod_of_ip", F.lit(""))
    known = remote_pod != ""
    remote = F.when(known, remote_pod).otherwise(F.col("remote_addr"))
    server = F.col("trace_role") == 2
    return (
        named.withColumns({
            "source": F.when(server, remote).otherwise(F.col(pod)),
            "destination": F.when(server, F.col(pod)).otherwise(remote),
            "is_source_pod_type": F.when(server, known).otherwise(F.lit(True)),
            "is_dest_pod_type": F.when(server, F.lit(True)).otherwise(known),
        })
        .drop("pod_of_ip")
        .where("source != '' AND destination != ''")
    )


# key -> (pattern, type): a printed connect line ``_pid:7 _comm:curl _saddr:…``
CONNECT_KEYS = {
    "pid": "bigint", "comm": "string", "saddr": "string", "lport": "int",
    "daddr": "string", "dport": "int",
}


def parse_connect_line(df: DataFrame, column: str = "value") -> DataFrame:
    """Key:value trace text to typed columns; missing keys are null.

    The text of a key runs up to the next known key, so commands with spaces
    survive.
    """
    keys = list(CONNECT_KEYS)
    out = []
    for i, key in enumerate(keys):
        stop = rf"(?= _{keys[i + 1]}:)" if i + 1 < len(keys) else r"\s*$"
        found = F.regexp_extract(column, rf"_{key}:(.*?){stop}", 1)
        out.append(F.nullif(found, F.lit("")).try_cast(CONNECT_KEYS[key]).alias(key))
    return df.select(*[c for c in df.columns if c != column], *out)


def keep_ip_families(df: DataFrame, family: str = "family") -> DataFrame:
    """IPv4 (2) and IPv6 (10) sockets only."""
    return df.where(F.col(family).isin(2, 10))


def alert_to_kernel(df: DataFrame) -> DataFrame:
    """Alert rows in the kernel-process long form, defaults filled in."""
    base, event = F.col("BaseRuntimeMetadata"), F.col("event")
    runtime, k8s = event["runtime"], event["k8s"]
    tree = F.col("RuntimeProcessDetails")["processTree"]
    unknown, no_time = F.lit("unknown"), F.lit("0001-01-01T00:00:00Z")

    def either(c, default):
        return F.coalesce(c, default)

    container = F.struct(
        either(runtime["containerId"], unknown).alias("id"),
        either(runtime["containerName"], unknown).alias("name"),
        F.struct(
            either(runtime["containerImageDigest"], unknown).alias("id"),
            either(runtime["containerImageName"], unknown).alias("name"),
        ).alias("image"),
        either(base["startTime"], no_time).alias("start_time"),
    )
    pod = F.when(k8s.isNotNull(), F.struct(
        either(k8s["namespace"], F.lit("default")).alias("namespace"),
        either(k8s["podName"], unknown).alias("name"),
        container.alias("container"),
        k8s["podLabels"].alias("pod_labels"),
        either(k8s["workloadName"], unknown).alias("workload"),
        either(k8s["workloadKind"], unknown).alias("workload_kind"),
    ))
    process = F.when(tree.isNotNull(), F.struct(
        tree["pid"].alias("pid"), tree["ppid"].alias("ppid"), tree["uid"].alias("uid"),
        tree["gid"].alias("gid"), tree["cmdline"].alias("cmdline"), tree["comm"].alias("comm"),
        tree["pcomm"].alias("pcomm"), either(base["exec_id"], unknown).alias("exec_id"),
        either(base["startTime"], no_time).alias("start_time"),
        either(base["auid"], F.lit(4294967295).cast("bigint")).alias("auid"),
        either(base["flags"], unknown).alias("flags"), either(base["cwd"], F.lit("/")).alias("cwd"),
        either(base["path"], unknown).alias("path"),
        either(base["in_init_tree"], F.lit(False)).alias("in_init_tree"),
        tree["pid"].alias("tid"), either(base["parent_exec_id"], unknown).alias("parent_exec_id"),
        pod.alias("pod"), either(runtime["containerId"], unknown).alias("docker"),
    ))
    return df.where(base.isNotNull() & event.isNotNull()).select(
        base["timestamp"].alias("time"),
        F.coalesce(F.nullif(base["node_name"], F.lit("")), k8s["node"], unknown).alias("node_name"),
        base["alertName"].alias("type"),
        F.struct(process.alias("process"), base["arguments"].alias("arguments")).alias("payload"),
    )
