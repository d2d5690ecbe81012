"""Selection policies: which kernel events each policy selects.

A policy is (function, selector parts). All parts of a selector must hold, any
selector suffices. The result is the event with the array of policy names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import net
from .barrier import once
from .filters import all_of, any_of
from .rules import SEPARATOR
from .skew import PAIRS_PER_TASK, ROWS_PER_TASK, split_join, wide_join


@dataclass(frozen=True)
class Part:
    """One selector part. ``field`` is arg0..arg4, binary, pid or pid_ns."""

    field: str
    op: str
    values: tuple[str, ...]


@dataclass(frozen=True)
class Policy:
    """One call of a policy. A policy of several calls is several rows of its name."""

    name: str
    function: str
    selectors: tuple[tuple[Part, ...], ...] = ((),)


# Shipped policies ---------------------------------------------------
AGENT_BINARIES = ("/usr/bin/rancher", "/usr/bin/dumb-init", "/nginx-ingress-controller",
                  "/usr/bin/nginx")
POLICIES = [
    Policy("metadata-api-tracing", "tcp_sendmsg", ((
        Part("arg0", "DAddr", ("169.254.169.254",)),
        Part("binary", "NotIn", (
            "/usr/bin/kubelet", "/usr/bin/dockerd", "/usr/bin/containerd",
            "/opt/cni/bin/cilium-cni", "/usr/bin/dumb-init", "/nginx-ingress-controller",
            "/main")),
    ),)),
    Policy("ssh-close", "tcp_close", ((
        Part("binary", "In", ("/usr/sbin/sshd", "/usr/sbin/tcpserver")),),)),
    Policy("ssh-close", "tcp_create_openreq_child", ((
        Part("binary", "In", ("/usr/sbin/sshd", "/usr/sbin/tcpserver")),),)),
    Policy("ssh-spawn-bash", "sys_execve", ((
        Part("binary", "In", ("/usr/sbin/sshd",)), Part("arg0", "Equal", ("/bin/sh",))),)),
    Policy("successful-ssh-connections", "inet_csk_accept", ((
        Part("binary", "In", ("/usr/sbin/sshd",)),),)),
    Policy("successful-ssh-connections", "sys_execve", ((
        Part("binary", "In", ("/usr/sbin/sshd",)), Part("arg0", "Equal", ("/usr/sbin/sshd",))),)),
    Policy("k8s-api-calls", "tcp_connect", ((
        Part("arg0", "DAddr", ("10.43.0.1", "10.1.0.0/20")),
        Part("binary", "NotIn", ("/usr/bin/rancher", "/usr/bin/dumb-init"))),)),
    Policy("enumerate-service-account", "security_file_permission", ((
        Part("arg0", "Prefix", ("/run/secrets/kubernetes.io/serviceaccount",)),
        Part("arg1", "Equal", ("4",)),
        Part("binary", "NotIn", ("/usr/bin/rancher", "/nginx-ingress-controller",
                                 "/usr/bin/dumb-init", "/main"))),)),
    Policy("enumerate-util", "fd_install", ((
        Part("arg1", "Prefix", (
            "/usr/bin/uname", "/usr/bin/python3", "/usr/bin/pip", "/usr/bin/apt", "/usr/bin/c++",
            "/usr/bin/which", "/usr/bin/whereis", "/usr/bin/cat", "/usr/bin/chmod",
            "/usr/bin/grep", "/usr/bin/find", "/usr/bin/who", "/usr/bin/xargs", "/usr/bin/ln",
            "/usr/bin/env", "/usr/bin/ls", "/usr/bin/cp", "/usr/bin/wget", "/usr/bin/curl")),),)),
    Policy("detect-scp-usage", "sys_execve", ((
        Part("arg0", "Equal", ("/usr/lib/openssh/sftp-server",)),),)),
    Policy("detect-k8sapi-invoke", "security_file_permission", ((
        Part("arg0", "Prefix", ("/usr/local/lib/python3.10/dist-packages/kubernetes/client/",)),
        Part("arg1", "Equal", ("4",))),)),
    Policy("detect-symlinkat", "sys_symlinkat", ((
        Part("arg0", "Equal", ("/etc/kubernetes/pki/apiserver.key", "/home/ansible/.id_rsa_tmp")),
        Part("binary", "NotIn", ("/usr/bin/dumb-init",))),)),
    Policy("detect-sensitive-file-access", "security_file_permission", (
        (Part("arg0", "Equal", ("/etc/kubernetes/pki/apiserver.key",
                                "/home/ansible/.id_rsa_tmp")),
         Part("arg1", "Equal", ("4",)), Part("binary", "NotIn", AGENT_BINARIES)),
        (Part("arg0", "Equal", ("/var/run/secrets/azure/tokens/azure-identity-token",
                                "/var/secrets/google/key.json")),
         Part("arg1", "Equal", ("4",)), Part("binary", "NotIn", AGENT_BINARIES + ("/main",))),
    )),
    Policy("monitor-network-activity-outside-cluster-cidr-range", "tcp_connect", ((
        Part("arg0", "NotDAddr", ("127.0.0.1", "172.16.0.0/28", "192.168.64.0/24")),),)),
    Policy("detect-ce-sys-ptrace", "sys_ptrace", ((Part("pid_ns", "NotIn", ("host_ns",)),),)),
    Policy("detect-ce-sys-ptrace", "sys_execve", ((
        Part("arg0", "Postfix", ("gdb", "strace", "ltrace", "lldb")),),)),
    Policy("detect-ce-module-load", "sys_init_module"),
    Policy("detect-ce-nsenter", "sys_setns"),
    Policy("detect-ce-priv-mount", "sys_mount"),
    Policy("detect-iptables-mitm", "fd_install", ((
        Part("arg1", "Prefix", ("/sbin/iptables", "/usr/sbin/iptables", "/usr/bin/mitmdump")),),)),
    Policy("detect-ce-umh-core-pattern", "security_file_permission", ((
        Part("arg0", "Prefix", ("/proc/sys/kernel", "/sysproc")),
        Part("arg1", "Equal", ("2", "4", "6")), Part("pid_ns", "NotIn", ("host_ns",))),)),
    Policy("detect-container-attach", "sys_execve", ((Part("arg0", "Equal", ("/pause",)),),)),
    Policy("detect-pod-exec", "sys_execve", ((Part("arg0", "Equal", ("/pause",)),),)),
    Policy("detect-POD_ATTACH", "sys_execve", ((Part("arg0", "Equal", ("/pause",)),),)),
    Policy("detect-pod-create-using-kubectl", "sys_openat", ((
        Part("arg1", "Prefix", ("/root/.kube/cache", "/root/.kube/config")),),)),
    Policy("detect-pod-create-using-kubectl", "sys_read", ((
        Part("pid", "NotIn", ("0", "1")), Part("arg0", "Equal", ("0",)),
        Part("binary", "NotIn", ("/usr/bin/jq",))),)),
    Policy("detect-identity-assume", "security_file_permission", ((
        Part("arg0", "Prefix", ("/run/secrets/kubernetes.io/serviceaccount",)),
        Part("arg1", "Equal", ("4",)),
        Part("binary", "NotIn", ("/usr/bin/rancher", "/nginx-ingress-controller",
                                 "/usr/bin/dumb-init", "/main"))),)),
    Policy("detect-exploit-host-read", "sys_openat", ((
        Part("arg1", "Equal", ("/proc/1/status", "/proc/1/mem")),
        Part("pid_ns", "NotIn", ("host_ns",))),)),
    Policy("detect-exploit-host-write", "sys_write", ((
        Part("binary", "In", ("/bin/sh", "/bin/bash")), Part("pid_ns", "NotIn", ("host_ns",)),
        Part("arg0", "Postfix", ("breakout",))),)),
    Policy("detect-exploit-host-write", "sys_fsync", ((
        Part("binary", "In", ("/bin/sh", "/bin/bash")), Part("pid_ns", "NotIn", ("host_ns",))),)),
    Policy("detect-exploit-host-write", "sys_openat", ((
        Part("arg1", "Equal", ("/host/etc/cron.d/breakout",)),),)),
    Policy("detect-containerd-sock-exploit-dup2", "sys_dup2", ((
        Part("arg1", "Equal", ("0", "1", "2")), Part("pid_ns", "NotIn", ("host_ns",))),)),
    Policy("capture-stdin-stdout", "sys_write", ((
        Part("binary", "In", (
            "/usr/bin/sh", "/bin/sh", "/usr/bin/bash", "/bin/bash", "/usr/bin/zsh", "/bin/zsh",
            "/usr/bin/dash", "/bin/dash")),
        Part("arg0", "Equal", ("1", "2", "3"))),)),
    *[Policy("list-syscalls", call) for call in (
        "sys_dup", "sys_dup2", "sys_open", "sys_openat", "sys_read", "sys_write", "sys_close",
        "sys_fork", "sys_clone", "sys_socket", "sys_connect", "sys_bind", "sys_listen",
        "sys_accept", "sys_sendto", "sys_recvfrom", "sys_access", "sys_chmod", "sys_chown",
        "sys_mkdir", "sys_rmdir", "sys_link", "sys_unlink", "sys_rename", "sys_chdir",
        "sys_getcwd", "sys_mount", "sys_chroot", "sys_ptrace", "sys_symlink", "sys_readlink",
        "sys_lstat", "sys_stat", "sys_fstat", "sys_fsync", "sys_fdatasync")],
    Policy("detect-exploit-containerd-sock", "sys_connect", ((
        Part("binary", "Postfix", ("crictl",)),),)),
    Policy("detect-kubelet-pods-access", "sys_openat", ((
        Part("arg1", "Postfix", ("token", "/proc/mounts")),
        Part("binary", "NotIn", (
            "/usr/bin/kubelet", "/usr/local/sbin/runc", "/usr/local/bin/containerd",
            "/usr/local/bin/containerd-shim-runc-v2", "/usr/bin/dumb-init",
            "/nginx-ingress-controller"))),)),
    Policy("detect-ce-var-log-symlink", "sys_symlinkat", ((Part("arg0", "Prefix", ("/",)),),)),
    Policy("detect-share-ps-namespace", "sys_openat", ((
        Part("arg1", "Prefix", tuple(f"/proc/{i}/root" for i in range(1, 21))),
        Part("pid_ns", "NotIn", ("host_ns",))),)),
]
SHELL_BINARIES = (
    "/usr/bin/sh", "/bin/sh", "/usr/bin/bash", "/bin/bash", "/usr/bin/zsh", "/bin/zsh",
    "/usr/bin/dash", "/bin/dash",
)
# -----------------------------------------------------------------------------------


def part_column(part: Part, fields: dict[str, Column]) -> Column:
    """A missing field matches no positive test and every ``Not…`` test."""
    c = fields[part.field]
    values = list(part.values)
    if part.op in ("Equal", "In"):
        hit = c.cast("string").isin(values)
    elif part.op in ("NotEqual", "NotIn"):
        return F.coalesce(~c.cast("string").isin(values), F.lit(True))
    elif part.op == "Prefix":
        hit = any_of([c.startswith(v) for v in values])
    elif part.op == "Postfix":
        hit = any_of([c.endswith(v) for v in values])
    elif part.op == "DAddr":
        return net.in_blocks(net.ipv4(c), values)
    elif part.op == "NotDAddr":
        # An event without a destination is not traffic, so it is not selected.
        ip = net.ipv4(c)
        return F.coalesce(ip.isNotNull() & ~net.in_blocks(ip, values), F.lit(False))
    else:
        raise ValueError(f"unknown selector operator {part.op}")
    return F.coalesce(hit, F.lit(False))


def selected(policy: Policy, fields: dict[str, Column]) -> Column:
    """An event of the policy's function that one of its selectors takes."""
    return any_of([all_of([part_column(p, fields) for p in parts]) for parts in policy.selectors])


def kernel_fields(payload: Column) -> dict[str, Column]:
    """Selector fields of a kernel payload. A file argument is its path, a
    socket argument its destination address."""
    def arg(i):
        a = F.get(payload["args"], F.lit(i))
        return F.coalesce(a["string_arg"], a["file_arg"]["path"], a["sock_arg"]["daddr"],
                          a["int_arg"].cast("string"))

    proc = payload["process"]
    return {
        **{f"arg{i}": arg(i) for i in range(5)},
        "binary": proc["binary"], "pid": proc["pid"],
        # No namespace id in the log: a container id means "not the host".
        "pid_ns": F.when(F.coalesce(proc["pod"]["container"]["id"], F.lit("")) == "",
                         F.lit("host_ns")).otherwise(F.lit("container")),
    }


def tag_policies(events: DataFrame, policies: list[Policy], function: Column,
                 fields: dict[str, Column]) -> DataFrame:
    """Events selected by at least one policy, with the array ``policies``.

    Function and fields are computed once per event; only the policies of its
    function are tested. Functions are named with or without their architecture
    prefix.
    """
    bare = F.regexp_replace(function, "^__x64_", "").alias("function")
    row = once(events, "_event", F.struct(bare, *[c.alias(n) for n, c in fields.items()]))
    own = {n: F.col("_event")[n] for n in fields}
    by_function: dict[str, list[Policy]] = {}
    for p in policies:
        by_function.setdefault(p.function, []).append(p)
    names = F.lit("")
    for name, those in by_function.items():
        names = F.when(F.col("_event.function") == name, F.concat_ws(SEPARATOR, *[
            F.when(selected(p, own), F.lit(p.name)) for p in those])).otherwise(names)
    hit = once(row, "_names", names).where("_names != ''")
    return hit.withColumn("policies", F.array_distinct(F.split("_names", SEPARATOR))).drop(
        "_names", "_event")


def in_block_table(rows: DataFrame, ip: str, blocks: DataFrame, block: str,
                   rows_per_task: int = ROWS_PER_TASK, pairs_per_task: int = PAIRS_PER_TASK) -> DataFrame:
    """Addresses against a table of blocks, as an equi-join.

    An address is inside a /p block when its top p bits are the block's, so each
    address is shifted by every prefix length in use (at most 33 values) and
    joined on (length, shifted address). No range comparison, no nested loop; a
    wide block that holds most addresses is a hot key, which is split, and so is a block that
    stands in the table many times.
    """
    key, bits = net.block_key(F.col(block))
    keyed = blocks.select("*", key.alias("_net"), bits.alias("_bits")).where("_net IS NOT NULL")
    in_use = keyed.agg(F.collect_set("_bits")).first()[0]  # at most 33 integers
    lengths = F.array(*[F.lit(b) for b in sorted(in_use)]).cast("array<int>")
    probes = rows.withColumn("_ip", net.ipv4(F.col(ip))).where("_ip IS NOT NULL").select(
        "*", F.explode(lengths).alias("_bits")
    ).withColumn("_net", F.expr("shiftright(_ip, 32 - _bits)"))
    joined = split_join(probes.withColumnRenamed(ip, "_addr"), keyed, ["_bits", "_net"], "inner", [
        "_ip", *[c for c, t in rows.dtypes if c != ip and "map" not in t and "variant" not in t]], rows_per_task, pairs_per_task)
    return joined.withColumnRenamed("_addr", ip).drop("_bits", "_net", "_ip")


def followed(events: DataFrame, lineage: DataFrame, binaries: tuple[str, ...] = (),
             pids: tuple[int, ...] = (), exec_id: str = "exec_id", negated: bool = False,
             salt_by: list[str] | None = None) -> DataFrame:
    """Events whose process, or one of its ancestors, runs one of the binaries or
    has one of the pids; with ``negated`` the other events.

    ``lineage(id, parent_id, binary, pid)`` has one row per process; ``pid`` is
    needed only for pids.
    """
    from .graph import descendants_of

    tests = []
    if binaries:
        tests.append(F.col("binary").isin(*binaries))
    if pids:
        tests.append(F.col("pid").isin(*pids))
    hits = descendants_of(lineage, any_of(tests)).select(F.col("id").alias(exec_id))
    return wide_join(events, hits, [exec_id], "left_anti" if negated else "left_semi")
