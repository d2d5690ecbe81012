"""Log-shaped frames derived from general tables.

The query catalogue runs on tables without security logs, so each log source is
shown on a projection of one of them: same shape, same operators, work that
grows with the table. Only projections here, no joins or groupings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions import times
from ..operators.barrier import null_of, once
from ..operators.skew import spread


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table by name; plain timestamps are taken as UTC."""
    return utc(spark.read.parquet(f"{folder}/{name}.parquet"))


def utc(df: DataFrame) -> DataFrame:
    plain = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in plain}) if plain else df


def typed(fields: dict[str, Column], schema: T.StructType) -> Column:
    """Struct of exactly this type; fields not given are null."""
    return F.struct(*[
        (fields[f.name].cast(f.dataType.simpleString()) if f.name in fields
         else null_of(f.dataType.simpleString())).alias(f.name) for f in schema.fields
    ])


def choose(c: Column, options: dict[str, str], default: str | None = None) -> Column:
    out = F.lit(default).cast("string")
    for key, value in options.items():
        out = F.when(c == key, F.lit(value)).otherwise(out)
    return out


def text(*parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


FUNCTIONS = {
    "error": "__x64_sys_setns", "purchase": "__x64_sys_mount",
    "click": "security_file_permission",
}
ALERT_NAMES = {
    "error": "Unexpected process launched", "click": "Unexpected file access",
    "view": "Unexpected system call", "purchase": "Unexpected capability used",
    "signup": "Custom rule",
}
NAMESPACES = {"0": "default", "1": "webapp", "2": "storm", "3": "kube-system"}


def events(spark: SparkSession, folder: str) -> DataFrame:
    """Events with the derived fields all log stand-ins share, spread over the tasks: a log that is
    made of one event is many times as long."""
    return event_fields(spread(table(spark, folder, "events")))


def event_fields(df: DataFrame) -> DataFrame:
    user = F.col("user_id")
    k = F.from_json("props", "k bigint")["k"]
    return df.withColumns({
        "k": k,
        "time_text": times.ts_to_iso_nanos(F.col("ts")),
        "ns": times.ts_to_ns(F.col("ts")),
        "node": text("node-", user % 5),
        "pod": text("pod-", user),
        "namespace": choose((user % 4).cast("string"), NAMESPACES),
        "container": F.md5(text("c", user)),
    })


def kernel_long(ev: DataFrame) -> DataFrame:
    """Kernel-process log, long form: signups are exec rows, the rest kprobes
    with the arguments their function takes."""
    kind, k = F.col("event_type"), F.col("k")
    is_exec = kind == "signup"
    opens = (kind == "view") & (k < 50)
    connects = (kind == "view") & (k >= 50)

    def arg(**fields):
        return typed(fields, schemas.ARG)

    file_path = (
        F.when(k < 20, F.lit("/run/secrets/kubernetes.io/serviceaccount/token"))
        .when(k < 40, F.lit("/etc/kubernetes/pki/apiserver.key"))
        .otherwise(text("/tmp/", k))
    )
    args = (
        F.when(kind == "error", F.array(
            arg(int_arg=F.lit(3)),
            arg(int_arg=F.when(k % 10 == 0, F.lit(1073741824)).otherwise(k))))
        .when(kind == "purchase", F.array(
            arg(string_arg=F.lit("proc")),
            arg(string_arg=F.when(k % 3 == 0, F.lit("/proc")).otherwise(text("/mnt/", k)))))
        .when(kind == "click", F.array(
            arg(file_arg=typed({"path": file_path, "permission": F.lit("r")}, schemas.FILE_ARG)),
            arg(int_arg=F.when(k % 2 == 0, F.lit(4)).otherwise(F.lit(2)))))
        .when(opens, F.array(
            arg(int_arg=F.lit(-100)), arg(string_arg=text("/proc/", k % 25, "/root"))))
        .when(connects, F.array(arg(sock_arg=typed({
            "daddr": text("10.1.", k % 32, ".7"),
            "state": F.when(k % 5 == 0, F.lit("110")).otherwise(F.lit("TCP_SYN")),
        }, schemas.SOCK_ARG))))
    )
    pod = typed({
        "namespace": F.col("namespace"), "name": F.col("pod"),
        "container": typed({
            "id": text("containerd://", F.col("container")), "name": F.lit("main"),
            "image": typed({"id": text("img-", F.col("user_id") % 7)}, schemas.IMAGE),
        }, schemas.CONTAINER),
    }, schemas.POD)
    process = typed({
        "exec_id": F.base64(F.encode(text(F.col("node"), ":", F.col("event_id")), "utf-8")),
        "pid": F.col("event_id"), "uid": F.col("user_id") % 2, "auid": F.col("user_id") % 3,
        "cwd": F.lit("/"), "binary": text("/usr/bin/", kind),
        "arguments": F.when(k != 13, F.col("props")), "flags": F.lit("execve"),
        "start_time": F.col("time_text"), "in_init_tree": k % 2 == 0, "pod": pod,
        "parent_exec_id": text("p", F.col("user_id")),
    }, schemas.PROC)
    parent = typed({
        "exec_id": text("p", F.col("user_id")), "binary": F.lit("/bin/sh"), "cwd": F.lit("/"),
        "parent_exec_id": text("g", F.col("user_id") % 10),
    }, schemas.PROC)
    function = F.when(opens, F.lit("__x64_sys_openat")).when(
        connects, F.lit("tcp_connect")).otherwise(choose(kind, FUNCTIONS))
    payload = typed({
        "process": process, "parent": parent, "function_name": function, "args": args,
        "action": F.when(~is_exec, F.lit("KPROBE_ACTION_POST")),
        "policy_name": F.when(~is_exec, text("policy-", kind)),
    }, schemas.KERNEL_PAYLOAD)
    return once(ev, "payload", payload, [
        "event_id", F.col("time_text").alias("time"), F.col("node").alias("node_name"),
        F.when(is_exec, F.lit("process_exec")).otherwise(F.lit("process_kprobe")).alias("type")])


# One log for each way a selection policy can go: function, first and second argument (a dotted
# address is a destination), binary, pid, whether the process is the host's.
POLICY_CASES = [
    ("tcp_sendmsg", "169.254.169.254", None, "/usr/bin/curl", 7, False),
    ("tcp_sendmsg", "169.254.169.254", None, "/usr/bin/kubelet", 7, False),
    ("tcp_sendmsg", "169.254.169.253", None, "/usr/bin/curl", 7, False),
    ("tcp_close", None, None, "/usr/sbin/sshd", 7, False),
    ("tcp_close", None, None, "/bin/x", 7, False),
    ("tcp_create_openreq_child", None, None, "/usr/sbin/tcpserver", 7, False),
    ("__x64_sys_execve", "/bin/sh", None, "/usr/sbin/sshd", 7, False),
    ("__x64_sys_execve", "/bin/sh", None, "/bin/x", 7, False),
    ("inet_csk_accept", None, None, "/usr/sbin/sshd", 7, False),
    ("inet_csk_accept", None, None, "/bin/x", 7, False),
    ("__x64_sys_execve", "/usr/sbin/sshd", None, "/usr/sbin/sshd", 7, False),
    ("tcp_connect", "10.43.0.1", None, "/usr/bin/curl", 7, False),
    ("tcp_connect", "10.1.15.255", None, "/usr/bin/rancher", 7, False),
    ("tcp_connect", "127.0.0.1", None, "/usr/bin/curl", 7, False),
    ("tcp_connect", "172.16.0.15", None, "/usr/bin/curl", 7, False),
    ("security_file_permission", "/run/secrets/kubernetes.io/serviceaccount/token", "4", "/bin/cat", 7, False),
    ("security_file_permission", "/run/secrets/kubernetes.io/serviceaccount/token", "4", "/main", 7, False),
    ("security_file_permission", "/run/secrets/kubernetes.io/serviceaccount/token", "2", "/bin/cat", 7, False),
    ("fd_install", "3", "/usr/bin/python3.10", "/bin/x", 7, False),
    ("fd_install", "3", "/usr/bin/vim", "/bin/x", 7, False),
    ("__x64_sys_execve", "/usr/lib/openssh/sftp-server", None, "/bin/x", 7, False),
    ("security_file_permission", "/usr/local/lib/python3.10/dist-packages/kubernetes/client/api.py", "4", "/bin/x", 7, False),
    ("security_file_permission", "/usr/local/lib/python3.10/dist-packages/kubernetes/client/api.py", "6", "/bin/x", 7, False),
    ("__x64_sys_symlinkat", "/home/ansible/.id_rsa_tmp", "l", "/bin/ln", 7, False),
    ("__x64_sys_symlinkat", "/home/ansible/.id_rsa_tmp", "l", "/usr/bin/dumb-init", 7, False),
    ("__x64_sys_symlinkat", "near", "l", "/bin/ln", 7, False),
    ("security_file_permission", "/etc/kubernetes/pki/apiserver.key", "4", "/bin/cat", 7, False),
    ("security_file_permission", "/etc/kubernetes/pki/apiserver.key", "4", "/usr/bin/nginx", 7, False),
    ("security_file_permission", "/var/secrets/google/key.json", "4", "/main", 7, False),
    ("security_file_permission", "/var/secrets/google/key.json", "4", "/bin/cat", 7, False),
    ("__x64_sys_ptrace", "16", "1", "/bin/x", 7, False),
    ("__x64_sys_ptrace", "16", "1", "/bin/x", 7, True),
    ("__x64_sys_execve", "/usr/bin/strace", None, "/bin/x", 7, False),
    ("__x64_sys_init_module", None, None, "/bin/x", 7, False),
    ("__x64_sys_delete_module", None, None, "/bin/x", 7, False),
    ("__x64_sys_setns", "3", "0", "/bin/x", 7, False),
    ("__x64_sys_mount", "proc", "/mnt", "/bin/x", 7, False),
    ("__x64_sys_umount", "/mnt", None, "/bin/x", 7, False),
    ("fd_install", "3", "/usr/sbin/iptables-restore", "/bin/x", 7, False),
    ("security_file_permission", "/proc/sys/kernel/core_pattern", "2", "/bin/x", 7, False),
    ("security_file_permission", "/proc/sys/kernel/core_pattern", "2", "/bin/x", 7, True),
    ("security_file_permission", "/proc/sys/kernel/core_pattern", "1", "/bin/x", 7, False),
    ("__x64_sys_execve", "/pause", None, "/bin/x", 7, False),
    ("__x64_sys_execve", "/pause2", None, "/bin/x", 7, False),
    ("__x64_sys_openat", "-100", "/root/.kube/config", "/bin/x", 7, False),
    ("__x64_sys_read", "0", None, "/bin/cat", 7, False),
    ("__x64_sys_read", "0", None, "/bin/cat", 1, False),
    ("__x64_sys_read", "0", None, "/usr/bin/jq", 7, False),
    ("__x64_sys_openat", "-100", "/proc/1/mem", "/bin/cat", 7, False),
    ("__x64_sys_openat", "-100", "/proc/1/mem", "/bin/cat", 7, True),
    ("__x64_sys_write", "/tmp/breakout", None, "/bin/bash", 7, False),
    ("__x64_sys_write", "1", None, "/bin/bash", 7, True),
    ("__x64_sys_write", "9", None, "/bin/cat", 7, False),
    ("__x64_sys_fsync", "3", None, "/bin/sh", 7, False),
    ("__x64_sys_fsync", "3", None, "/bin/sh", 7, True),
    ("__x64_sys_openat", "-100", "/host/etc/cron.d/breakout", "/bin/x", 7, False),
    ("__x64_sys_dup2", "3", "2", "/bin/x", 7, False),
    ("__x64_sys_dup2", "3", "5", "/bin/x", 7, False),
    ("__x64_sys_connect", "3", None, "/usr/local/bin/crictl", 7, False),
    ("__x64_sys_connect", "3", None, "/bin/nc", 7, False),
    ("__x64_sys_openat", "-100", "/var/run/token", "/bin/cat", 7, False),
    ("__x64_sys_openat", "-100", "/var/run/token", "/usr/bin/kubelet", 7, False),
    ("__x64_sys_openat", "-100", "/proc/20/root/etc", "/bin/x", 7, False),
    ("__x64_sys_openat", "-100", "/proc/20/root/etc", "/bin/x", 7, True),
    ("__x64_sys_openat", "-100", "/proc/21/root", "/bin/x", 7, False),
    ("__x64_sys_chown", "/x", None, "/bin/x", 7, False),
]


def policy_log(ev: DataFrame) -> DataFrame:
    """Kernel logs that take the cases in turn."""
    case = F.get(F.array(*[F.struct(*[F.lit(v).cast(t).alias(n) for n, t, v in zip(
        ("function", "first", "second", "binary", "pid", "host"),
        ("string", "string", "string", "string", "bigint", "boolean"), c, strict=True)]) for c in POLICY_CASES]),
        (F.col("event_id") % len(POLICY_CASES)).cast("int"))
    rows = once(ev, "case", case)

    def arg(name):
        c = F.col(f"case.{name}")
        return F.when(c.rlike(r"^-?\d+$"), typed({"int_arg": c.try_cast("bigint")}, schemas.ARG)).when(
            c.rlike(r"^\d+(\.\d+){3}$"), typed({"sock_arg": typed({"daddr": c}, schemas.SOCK_ARG)}, schemas.ARG)).when(
            F.col("case.function").startswith("security"), typed({"file_arg": typed({"path": c}, schemas.FILE_ARG)}, schemas.ARG)).otherwise(
            typed({"string_arg": c}, schemas.ARG))

    pod = typed({"name": F.col("pod"), "container": typed(
        {"id": F.when(~F.col("case.host"), text("containerd://", F.col("container")))}, schemas.CONTAINER)}, schemas.POD)
    process = typed({"exec_id": text("e", F.col("event_id")), "pid": F.col("case.pid"), "binary": F.col("case.binary"),
                     "pod": pod}, schemas.PROC)
    return once(rows, "payload", typed({
        "process": process, "function_name": F.col("case.function"), "args": F.array(arg("first"), arg("second"))},
        schemas.KERNEL_PAYLOAD), ["event_id"])


def process_tree(ev: DataFrame) -> DataFrame:
    """Kernel logs whose processes descend from each other: event n from event n div 2."""
    n = F.col("event_id")
    proc = typed({
        "exec_id": text("e", n), "parent_exec_id": F.when(n > 1, text("e", F.call_function("div", n, F.lit(2).cast("bigint")))),
        "binary": text("/usr/bin/", F.col("event_type")), "pid": n}, schemas.PROC)
    return once(ev, "payload", typed({"process": proc}, schemas.KERNEL_PAYLOAD), [
        "event_id", F.col("time_text").alias("time")])


def kernel_wide(ev: DataFrame) -> DataFrame:
    """The same log in wide form, arguments promoted to the root."""
    long = kernel_long(ev)
    none = F.lit(None).cast(schemas.KERNEL_PAYLOAD)
    is_exec = F.col("type") == "process_exec"
    args = F.col("payload.args")
    return long.select(
        "node_name", "time",
        F.when(is_exec, F.col("payload")).alias("process_exec"), none.alias("process_exit"),
        F.when(~is_exec, F.col("payload")).alias("process_kprobe"),
        *[F.coalesce(F.to_json(F.get(args, F.lit(i))), F.lit("null")).alias(f"kprobe{i}")
          for i in range(5)],
    )


def alerts(ev: DataFrame) -> DataFrame:
    kind, k = F.col("event_type"), F.col("k")
    name = choose(kind, ALERT_NAMES)
    arguments = typed({
        "syscall": F.when(kind == "view", text("sys_", k)),
        "capability": F.when(kind == "purchase", text("CAP_", k % 4)),
        "path": F.when(kind == "click", text(F.when(k < 50, F.lit("/etc/f")).otherwise(
            F.lit("/home/f")), k)),
        "exec": F.when(kind == "error", text("/bin/x", k % 9)),
        "flags": F.when(kind == "click", F.array(
            F.when(k % 2 == 0, F.lit("O_RDONLY")).otherwise(F.lit("O_RDWR")), F.lit("O_CLOEXEC"))),
    }, schemas.ALERT_ARGUMENTS)
    base = typed({
        "alertName": name, "arguments": arguments, "infectedPID": F.col("event_id"),
        "severity": k % 10, "timestamp": F.col("time_text"), "trace": F.lit("{}"),
    }, schemas.ALERT_BASE)
    k8s = typed({
        "containerID": F.col("container"), "podName": F.col("pod"),
        "podNamespace": F.col("namespace"), "namespace": F.col("namespace"),
        "image": text("img-", F.col("user_id") % 7),
    }, schemas.ALERT_K8S)
    tree = typed({
        "pid": F.col("event_id"), "ppid": F.col("user_id"),
        "cmdline": text(kind, " ", F.col("props")), "cwd": F.lit("/"), "pcomm": F.lit("shim"),
        "comm": kind, "uid": F.col("user_id") % 2,
    }, schemas.ALERT_TREE)
    event = typed({
        "k8s": typed({"node": F.col("node"), "podName": F.col("pod"),
                      "namespace": F.col("namespace")}, schemas.ALERT_EVENT["k8s"].dataType),
        "runtime": typed({"containerId": F.col("container")},
                         schemas.ALERT_EVENT["runtime"].dataType),
        "timestamp": F.col("ns"),
    }, schemas.ALERT_EVENT)
    row = typed({
        "BaseRuntimeMetadata": base, "RuleID": text("R", k % 10), "RuntimeK8sDetails": k8s,
        "CloudMetadata": typed({"instance_id": text("cloud-", F.col("node"))},
                               schemas.ALERT_CLOUD),
        "RuntimeProcessDetails": typed({"processTree": tree}, schemas.ALERT_PROCESS),
        "event": event, "level": F.lit("error"), "message": text(name, ": ", k), "msg": name,
        "time": text(F.substring("time_text", 1, 19), "Z"),
    }, schemas.ALERT)
    return once(ev, "a", row, ["event_id"]).select("event_id", "a.*")


def traces(ev: DataFrame) -> DataFrame:
    k = F.col("k")
    meta = typed({"Properties": typed({
        "signatureName": text("sig ", F.col("event_type")), "signatureID": text("TRC-", k % 20),
        "Category": F.lit("escape"), "Technique": text("T", k),
        "id": text("attack-pattern--", k % 20),
    }, schemas.TRACE["metadata"].dataType["Properties"].dataType)},
        schemas.TRACE["metadata"].dataType)
    row = typed({
        "timestamp": F.col("ns"), "processId": F.col("event_id"), "processName": F.col("event_type"),
        "hostName": F.col("node"), "syscall": text("sys_", F.col("event_type")),
        "eventName": F.col("event_type"), "containerId": F.col("container"),
        "cgroupId": F.col("user_id"), "mountNamespace": F.col("user_id") % 11,
        "pidNamespace": F.col("user_id") % 13,
        "container": typed({"id": F.col("container"), "image": F.lit("img")},
                           schemas.TRACE["container"].dataType),
        "kubernetes": typed({"podName": F.col("pod"), "podNamespace": F.col("namespace")},
                            schemas.TRACE["kubernetes"].dataType),
        "metadata": meta,
        "args": F.when(k != 7, F.array(
            typed({"name": text("arg", k % 5), "type": F.lit("int"), "value": k},
                  schemas.TRACE_ARG),
            typed({"name": F.lit("doc"), "type": F.lit("object"), "value": F.col("props")},
                  schemas.TRACE_ARG))),
        "matchedPolicies": F.lit("p"),
    }, schemas.TRACE)
    return once(ev, "t", row, ["event_id"]).select("event_id", "t.*")


def rule_alerts(ev: DataFrame) -> DataFrame:
    """Rule-engine alerts; the fields are a map with dotted keys."""
    k = F.col("k")
    pairs = {
        "container.id": F.substring("container", 1, 12), "container.name": F.col("pod"),
        "container.image.repository": F.lit("repo"), "proc.commandline": text(
            F.col("event_type"), " ", k),
        "proc.cmdline": F.col("event_type"), "proc.pname": F.lit("sh"),
        "proc.tty": (F.col("event_id") % 1000).cast("string"), "proc.exepath": F.lit("/bin/x"),
        "evt.type": F.col("event_type"), "user.uid": (F.col("user_id") % 3).cast("string"),
        "k8s.pod.name": F.col("pod"), "k8s.pod.namespace": F.col("namespace"),
        "fd.name": text("10.0.0.", k),
    }
    fields = F.create_map(*[x for n, v in pairs.items() for x in (F.lit(n), v)])
    return once(ev, "interesting", fields, [
        "event_id", F.col("time_text").alias("timestamp"), F.col("node").alias("hostname"),
        text("rule ", k % 6).alias("rule"), F.lit("syscall").alias("source"),
        choose(F.col("event_type"), {"error": "Critical"}, "Notice").alias("priority"),
        F.array(F.lit("container"), F.col("event_type")).alias("tags")])


def dns_spans(ev: DataFrame) -> DataFrame:
    """Every event as a lookup; names with even numbers are cluster-local."""
    k = F.col("k")
    name = F.when(k % 2 == 0, text("svc-", k, ".ns.svc.cluster.local")).when(
        k == 9, F.lit("security.ubuntu.com")).otherwise(text("host-", k, ".example.com"))
    row = typed({
        "time_": F.col("ns"), "upid": upid(F.col("event_id")),
        "remote_addr": text("10.43.0.", k), "remote_port": F.lit(53),
        "local_addr": text("10.42.0.", F.col("user_id") % 250), "local_port": F.lit(-1),
        "trace_role": F.lit(1), "encrypted": F.lit(0),
        "req_header": text('{"txid":', F.col("event_id"), ',"qr":0}'),
        "req_body": text('{"queries":[{"name":"', name, '","type":"A"}]}'),
        "resp_header": text('{"txid":', F.col("event_id"), ',"qr":1,"rcode":', k % 4, "}"),
        "resp_body": F.when(k % 4 == 0, text('{"answers":["10.0.0.', k, '"]}')).otherwise(
            F.lit('{"answers":[]}')),
        "latency": k * 1000, "pod_name": F.col("pod"), "namespace": F.col("namespace"),
        "container_id": F.col("container"), "pid": F.col("event_id"), "node_name": F.col("node"),
    }, schemas.DNS_SPAN)
    return once(ev, "d", row, ["event_id"]).select("event_id", "d.*")


def upid(c: Column) -> Column:
    """ASID-PID-start-time id whose PID part spells the number."""
    pid = F.lower(F.lpad(F.hex(c), 8, "0"))
    return F.concat(F.lit("00000003-"), F.substring(pid, 1, 4), F.lit("-"),
                    F.substring(pid, 5, 4), F.lit("-0000-0000000118f6"))


def http_spans(ev: DataFrame) -> DataFrame:
    """Every event as a request; some are package-list downloads."""
    k, user = F.col("k"), F.col("user_id")
    row = typed({
        "time_": F.col("ns"), "upid": upid(F.col("event_id")),
        "remote_addr": text("10.0.0.", k % 50), "remote_port": 30000 + k,
        "local_addr": text("10.42.0.", user % 250), "local_port": F.lit(8080),
        "trace_role": 1 + k % 2, "encrypted": F.lit(0), "major_version": F.lit(1),
        "minor_version": F.lit(1), "content_type": F.lit(0),
        "req_headers": F.when(k < 30, F.lit('{"Host":"archive.ubuntu.com"}')).otherwise(
            F.lit('{"Host":"example.com"}')),
        "req_method": F.lit("GET"),
        "req_path": F.when(k % 3 == 0, F.lit("/dists/jammy/InRelease")).otherwise(text("/p/", k)),
        "req_body": F.lit(""), "req_body_size": F.lit(0),
        "resp_headers": F.lit('{"Content-Length":"2"}'), "resp_status": 200 + k % 5,
        "resp_message": F.lit("OK"), "resp_body": F.lit("ok"), "resp_body_size": F.lit(2),
        "latency": k * 1000, "pod_name": F.col("pod"), "namespace": F.col("namespace"),
        "container_id": F.col("container"), "pid": F.col("event_id"), "node_name": F.col("node"),
    }, schemas.HTTP_SPAN)
    return once(ev, "h", row, ["event_id"]).select("event_id", "h.*")


def page_spans(pages: DataFrame) -> DataFrame:
    """Crawled pages as requests: path from the URL, size from the document."""
    path = F.regexp_extract("url", r"^https?://[^/]+(/[^?#]*)", 1)
    n = F.col("page_id")
    return pages.select(
        "page_id", F.col("url"), path.alias("req_path"),
        F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("host"),
        text("10.0.0.", n % 50).alias("remote_addr"), (1 + n % 2).alias("trace_role"),
        text("web/page-", n % 17).alias("pod"), F.length("html").alias("resp_body_size"))
