"""The rule catalogue as data.

A rule is a disjunction of groups; all predicates of a group must hold on the
same log. Rule ids are not unique in the catalogue (2, 3 and 4 are used twice),
so every rule also has its own ``key``.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


@dataclass(frozen=True)
class Predicate:
    group: int
    path: str
    op: str
    value: object = None
    type: str = "string"
    negated: bool = False
    observation: int = 0


@dataclass(frozen=True)
class Rule:
    key: str
    rule_id: str
    name: str
    attack_id: str
    attack_name: str
    attack_description: str
    indicator_id: str
    indicator_name: str
    indicator_description: str
    relationship_id: str
    predicates: tuple[Predicate, ...] = field(default_factory=tuple)
    references: tuple[tuple[str, str, str], ...] = ()
    # What the relationship points to and how the pattern was written, where
    # that is not what follows from the rest.
    target: str = ""
    written: str = ""
    # How several observations combine: AND, OR or FOLLOWEDBY; a time span for
    # all of them in seconds; how often one must be seen.
    combine: str = ""
    within: float | None = None
    repeats: int = 1
    # Brackets and qualifiers of their own: ``operators.observations.Observed``
    # as JSON; it takes the place of the three above.
    tree: str = ""

    @property
    def target_ref(self) -> str:
        return self.target or self.attack_id

    @property
    def observations(self) -> list[int]:
        return sorted({p.observation for p in self.predicates}) or [0]

    @property
    def one_log(self) -> bool:
        """Whether a single log decides."""
        return self.observations == [0] and self.repeats == 1 and not self.tree

    def groups(self, observation: int = 0) -> list[list[Predicate]]:
        out: dict[int, list[Predicate]] = {}
        for p in self.predicates:
            if p.observation == observation:
                out.setdefault(p.group, []).append(p)
        return list(out.values())


FN = "process:extensions.function_name"
CMD = "process:command_line"
KARG = "process:extensions.kprobe_arguments."


def _m(group, path, value):
    return Predicate(group, path, "MATCHES", value)


def _eq(group, path, value, type_="int"):
    return Predicate(group, path, "=", value, type_)


# The shipped rules ------------------------------------------------
VALID_FROM = "2024-01-01T00:00:00Z"
PTRACE_NOTE = (
    "Detecting the attempted use of the 'ptrace' system call from within a container, which can "
    "be used to manipulate other processes. TODO: thats not true"
)
VAR_LOG_NOTE = "Arbitrary file reads on the host from a node via an exposed /var/log mount.."
MITRE_ESCAPE = (
    ("Mitre", "https://attack.mitre.org/techniques/T1611/",
     "Usually a priviledged container can escape to the host using nsenter"),
)

CORE_RULES = [
    Rule("nsenter", "1", "CE_NSENTER", "attack-pattern--kh-ce-nsenter", "CE_NSENTER",
         "Attempted Container Escape via NSENTER.", "indicator--kh-ce-nsenter",
         "NSenter binary executed", "Calibration test", "relationship--kh-ce-nsenter",
         (_m(0, FN, "__x64_sys_setns"), _eq(0, KARG + "int_arg_1", 1073741824)), MITRE_ESCAPE),
    Rule("sys-ptrace", "2", "CE_SYS_PTRACE", "attack-pattern--kh-ce-sys-ptrace", "CE_SYS_PTRACE",
         "Strace from inside a container.", "indicator--kh-ce-sys-ptrace",
         "Ptrace System Call from Container", PTRACE_NOTE, "relationship--kh-ce-sys-ptrace",
         (_m(0, FN, "__x64_sys_ptrace"), _m(0, CMD, "/usr/bin/strace"),
          _m(1, FN, "__x64_sys_execve"), _m(1, KARG + "string_arg", "/usr/bin/gdb"))),
    Rule("priv-mount", "3", "CE_PRIV_MOUNT", "attack-pattern--kh-ce-priv-mount", "CE_PRIV_MOUNT",
         "Mounting directories from inside a container.", "indicator--kh-ce-priv-mount",
         "Mounting the /proc dir from Container", "Detecting the mounting of the proc directory.",
         "relationship--kh-ce-priv-mount",
         (_m(0, FN, "__x64_sys_mount"), _m(0, KARG + "string_arg_1", "/proc"))),
    Rule("module-load", "5", "CE_MODULE_LOAD", "attack-pattern--kh-ce-module-load",
         "CE_MODULE_LOAD", "Loading kernel modules from inside a container.",
         "indicator--kh-ce-module-load", "Modprobe from within Container",
         "Detecting an attempt to execute modprobe", "relationship--kh-ce-module-load",
         (_m(0, CMD, "modprobe"), _m(0, FN, "sys_init_module"))),
    Rule("net-mitm", "4", "CE_NET_MITM", "attack-pattern--kh-ce-net-mitm", "CE_NET_MITM",
         "Attempting to tamper with iptables and trying to run mitmdump.",
         "indicator--kh-ce-net-mitm", "Person in the middle attack",
         "Detecting an attempt to tamper with iptables", "relationship--kh-ce-net-mitm",
         (_m(0, CMD, "iptables -t nat -A PREROUTING"), _m(0, CMD, "mitmdump"))),
    Rule("var-log-symlink", "6", "CE_VAR_LOG_SYMLINK", "attack-pattern--kh-ce-var-log-symlink",
         "CE_VAR_LOG_SYMLINK", VAR_LOG_NOTE, "indicator--kh-ce-var-log-symlink",
         "Symlink to log dir", "Symbolic link to /var/log/root_link",
         "relationship--kh-ce-var-log-symlink",
         (_m(0, CMD, "ln -s"), _m(0, FN, "__x64_sys_symlinkat"),
          _m(1, "process:extensions.kprobe2.string_arg", "var/log"),
          _m(2, CMD, "/proc/net/route"), _m(3, CMD, "ip")),
         written="[(process:command_line MATCHES 'ln -s' AND process:extensions.function_name "
                 "MATCHES '__x64_sys_symlinkat' OR process:extensions.kprobe2.string_arg MATCHES "
                 "'var/log') OR (process:command_line MATCHES '/proc/net/route' OR "
                 "process:command_line MATCHES 'ip')]"),
    Rule("var-log-route", "2", "CE_VAR_LOG_ROUTE", "attack-pattern--kh-ce-var-log-route",
         "CE_VAR_LOG_ROUTE",
         "Arbitrary file reads on the host from a node via an exposed /var/log mount by calling "
         "to API:10250",
         "indicator--kh-ce-var-log-route", "Symlink to log dir",
         "Symbolic link to /var/log/root_link", "relationship--kh-ce-var-log-route",
         (_m(0, CMD, "10250/logs/"),)),
    Rule("var-log-token", "3", "CE_VAR_LOG_TOKEN", "attack-pattern--kh-ce-var-log-TOKEN",
         "CE_VAR_LOG_TOKEN", "In order to access the logs, the pods own token must be used",
         "indicator--kh-ce-var-log-token", "pods own token must be used", "pod token used",
         "relationship--kh-ce-var-log-token",
         (_m(0, FN, "security_file_permission"),
          _m(0, "process:extensions.kprobe0.file_arg.path",
             "/run/secrets/kubernetes.io/serviceaccount/")),
         target="attack-pattern--kh-ce-var-log-token"),
    Rule("var-log-rm-symlink", "4", "CE_VAR_LOG_RM_SYMLINK",
         "attack-pattern--kh-ce-var-log-rm-symlink", "CE_VAR_LOG_SYMLINK", VAR_LOG_NOTE,
         "indicator--kh-ce-var-log-rm-symlink", "Remove Symlink to log dir",
         "Remove Symbolic link to /var/log/root_link", "relationship--kh-ce-var-log-rm-symlink",
         (_m(0, CMD, "/bin/rm /var/log/"),)),
    Rule("umh-core-pattern", "7", "CE_UMH_CORE_PATTERN", "attack-pattern--kh-ce-umh-core-pattern",
         "CE_UMH_CORE_PATTERN", "Exploiting the User Mode Helper Core Pattern.",
         "indicator--kh-ce-umh-core-pattern", "", "Detecting ",
         "relationship--kh-ce-umh-core-pattern", (_m(0, FN, "security_file_permission"),)),
    Rule("containerd-sock", "8", "EXPLOIT_CONTAINERD_SOCK",
         "attack-pattern--kh-exploit-containerd-sock", "EXPLOIT_CONTAINERD_SOCK",
         "Exploiting the CR socket mounted (readonly) into the container.",
         "indicator--kh-exploit-containerd-sock", "", "Detecting a socket connection by crictl",
         "relationship--exploit-containerd-sock",
         (_m(0, FN, "sys_connect"), _m(0, KARG + "sock_arg.state", "110"))),
    Rule("host-read", "9", "EXPLOIT_HOST_READ", "attack-pattern--kh-exploit-host-read",
         "EXPLOIT_HOST_READ", "Exfiltration of a process memory dump.",
         "indicator--kh-exploit-host-read", "", "Detecting procdump()",
         "relationship--kh-exploit-host-read", (_m(0, FN, "openat"), _m(0, CMD, "dd"))),
    Rule("host-write", "11", "EXPLOIT_HOST_WRITE", "attack-pattern--kh-exploit-host-write",
         "EXPLOIT_HOST_WRITE", "Host Write to modify /etc/cron.d",
         "indicator--kh-exploit-host-write", "Host Write to modify /etc/cron.d",
         "Detecting a opening the crontab on host filesystem",
         "relationship--kh-exploit-host-write",
         (_m(0, FN, "openat"), _m(0, KARG + "string_arg", "/etc/cron.d/breakout"))),
    Rule("tree", "12", "TREE", "attack-pattern--containerescapeplusmount", "TREE",
         "nsenter followed by mount", "indicator--containerescapeplusmount",
         "Container Escape followed by Mount /proc", "Detecting containerescapeplusmount",
         "relationship--containerescapeplusmount",
         (_m(0, FN, "__x64_sys_setns"), _m(1, FN, "__x64_sys_mount"))),
    Rule("escapemount", "13", "ESCAPEMOUNT", "attack-pattern--containerescapemount", "ESCAPEMOUNT",
         "nsenter followed by mount", "indicator--containerescapemount",
         "Container Escape followed by Mount /proc", "Detecting containerescapeplusmount",
         "relationship--containerescapemount",
         (_eq(0, KARG + "int_arg_1", 1073741824), _m(1, FN, "__x64_sys_mount"))),
    Rule("alert-flags", "14", "kubescapetest", "attack-pattern--kubescapetest", "kubescapetest",
         "description kubescapetest", "indicator--kubescapetest", "", "Detecting kubescapetest",
         "relationship--kubescapetest", (_m(0, KARG + "flags[0]", "RDONLY"),)),
    Rule("trace-value", "15", "NAME", "attack-pattern--tracee", "tracee", "description",
         "indicator--tracee", "tracee", "Detecting tracee", "relationship--tracee",
         (_m(0, KARG + "value.name", "magic"),)),
    Rule("ping-mounts", "16", "CE_VAR_LOG_SYMLINK", "attack-pattern--kh-ce-var-log-symlink",
         "CE_VAR_LOG_SYMLINK", VAR_LOG_NOTE, "indicator--kh-ce-var-log-symlink",
         "Symlink to log dir", "Symbolic link to /var/log/root_link",
         "relationship--kh-ce-var-log-symlink",
         (_m(0, CMD, "/bin/sh -c ping -c 4 1.1.1.1;cat /proc/self/mounts"),)),
]


def _calibration(base_key, description, predicates, **changes):
    base = next(r for r in CORE_RULES if r.key == base_key)
    return replace(base, key="calibration-" + base_key, attack_description=description,
                   predicates=predicates, written="", **changes)


CALIBRATION_RULES = [
    _calibration("nsenter", "Attempted Container Escape via NSENTER.",
                 (_m(0, CMD, "/usr/bin/nsenter -t 1"), _m(1, FN, "__x64_sys_setns"))),
    _calibration("sys-ptrace", "Attempted use of GDB", (_m(0, CMD, "/usr/bin/gdb"),)),
    _calibration("priv-mount", "Mounting directories from inside a container.",
                 (_m(0, CMD, "mount -t proc proc /proc"),),
                 indicator_name="Ptrace System Call from Container"),
    _calibration("module-load", "Loading kernel modules from inside a container.",
                 (_m(0, CMD, "modprobe"),)),
    _calibration("net-mitm", "Attempting to tamper with iptables and trying to run mitmdump.",
                 (_m(0, CMD, "iptables -t nat -A PREROUTING"), _m(0, CMD, "mitmdump"))),
    _calibration("var-log-symlink",
                 "Attempting to tamper with iptables and trying to run mitmdump.",
                 (_m(0, CMD, "ln -s"), _m(0, CMD, "/var/log")),
                 indicator_description="Detecting an attempt to tamper with iptables"),
    _calibration("umh-core-pattern", "Exploiting the User Mode Helper Core Pattern.",
                 (_m(0, FN, "security_file_permission"),)),
]
# --------------------------------------------------------------------------------

# The posted catalogue is the core one without its last rule.
CATALOGUES = {
    "core": CORE_RULES,
    "posted": CORE_RULES[:-1],
    "calibration": CALIBRATION_RULES,
}


def _literal(p: Predicate) -> str:
    if p.type in ("int", "float"):
        return str(p.value)
    if p.type == "bool":
        return str(p.value).lower()
    prefix = {"timestamp": "t", "hex": "h", "binary": "b"}.get(p.type, "")
    return prefix + "'" + str(p.value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def _time(ns: int) -> str:
    day = datetime.fromtimestamp(ns // 1_000_000_000, timezone.utc).strftime("%Y-%m-%dT%H:%M:%S")
    return f"{day}.{ns % 1_000_000_000:09d}Z"


def pattern_text(rule: Rule) -> str:
    """The rule as a pattern expression, printed from its predicates."""
    def one(p):
        neg = "NOT " if p.negated else ""
        if p.op == "EXISTS":
            return f"{neg}EXISTS {p.path}"
        if p.op == "IN":
            items = ", ".join(_literal(replace(p, value=v)) for v in p.value)
            return f"{p.path} {neg}IN ({items})"
        return f"{p.path} {neg}{p.op} {_literal(p)}"

    def observation(n):
        groups = [" AND ".join(one(p) for p in g) for g in rule.groups(n)]
        if len(groups) > 1:
            groups = [f"({g})" if " AND " in g else g for g in groups]
        return "[" + " OR ".join(groups) + "]"

    def bracket(node: dict) -> str:
        if node.get("of"):
            inside = f" {node.get('combine', '')} ".join(bracket(o) for o in node["of"])
            text = f"({inside})"
        else:
            text = observation(node["observation"])
        if node.get("repeats", 1) > 1:
            text += f" REPEATS {node['repeats']} TIMES"
        if node.get("within") is not None:
            text += f" WITHIN {node['within']:g} SECONDS"
        if node.get("start") is not None:
            text += f" START t'{_time(node['start'])}' STOP t'{_time(node['stop'])}'"
        return text

    if rule.written:
        return rule.written
    if rule.tree:
        return bracket(json.loads(rule.tree))
    text = f" {rule.combine or 'AND'} ".join(observation(n) for n in rule.observations)
    if len(rule.observations) > 1 and (rule.within is not None or rule.repeats > 1):
        text = f"({text})"
    if rule.repeats > 1:
        text += f" REPEATS {rule.repeats} TIMES"
    if rule.within is not None:
        text += f" WITHIN {rule.within:g} SECONDS"
    return text


def rule_objects(rule: Rule) -> list[dict]:
    """attack-pattern, indicator and relationship objects of a rule."""
    attack = {
        "type": "attack-pattern", "id": rule.attack_id, "name": rule.attack_name,
        "description": rule.attack_description,
    }
    if rule.references:
        attack["external_references"] = [
            {"source_name": s, "url": u, "description": d} for s, u, d in rule.references
        ]
    indicator = {
        "type": "indicator", "id": rule.indicator_id, "name": rule.indicator_name,
        "description": rule.indicator_description, "pattern": pattern_text(rule),
        "pattern_type": "stix", "valid_from": VALID_FROM,
    }
    relationship = {
        "type": "relationship", "id": rule.relationship_id, "relationship_type": "indicates",
        "source_ref": rule.indicator_id, "target_ref": rule.target_ref,
    }
    return [attack, indicator, relationship]


def rule_objects_json(rule: Rule) -> list[str]:
    return [json.dumps(o, separators=(",", ":"), ensure_ascii=False) for o in rule_objects(rule)]


# --- rules as tables --------------------------------------------------------------

_TEXT = ["key", "rule_id", "name", "attack_id", "attack_name", "attack_description",
         "indicator_id", "indicator_name", "indicator_description", "relationship_id"]
_MORE = ["target", "written", "combine", "tree"]
RULE_SCHEMA = T.StructType([
    *[T.StructField(n, T.StringType()) for n in [*_TEXT, *_MORE, "references"]],
    T.StructField("within", T.DoubleType()), T.StructField("repeats", T.IntegerType())])
PREDICATE_SCHEMA = T.StructType([
    T.StructField("key", T.StringType()), T.StructField("observation", T.IntegerType()),
    T.StructField("or_group", T.IntegerType()), T.StructField("path", T.StringType()),
    T.StructField("negated", T.BooleanType()), T.StructField("op", T.StringType()),
    T.StructField("value", T.StringType()), T.StructField("value_type", T.StringType()),
])


def rules_frame(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    rows = [(*[getattr(r, n) for n in [*_TEXT, *_MORE]], json.dumps(r.references),
             None if r.within is None else float(r.within), r.repeats) for r in rules]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def predicates_frame(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    rows = [
        (r.key, p.observation, p.group, p.path, p.negated, p.op,
         json.dumps(p.value), p.type)
        for r in rules for p in r.predicates
    ]
    return spark.createDataFrame(rows, PREDICATE_SCHEMA)


def edges_frame(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """The relationship objects as rows: indicator -> attack pattern."""
    return spark.createDataFrame(
        [(r.key, r.relationship_id, r.indicator_id, r.target_ref) for r in rules],
        "key string, relationship_id string, source_ref string, target_ref string")


def load_rules(rules: DataFrame, predicates: DataFrame) -> list[Rule]:
    """Rules back from their two tables. The catalogue is configuration of tens
    to thousands of rows and is needed on the driver to build the plan."""
    by_key: dict[str, list[Predicate]] = {}
    for p in predicates.orderBy("key", "observation", "or_group").toLocalIterator():
        by_key.setdefault(p["key"], []).append(Predicate(
            p["or_group"], p["path"], p["op"], json.loads(p["value"]), p["value_type"],
            p["negated"], p["observation"]))
    return [
        Rule(**{n: r[n] for n in [*_TEXT, *_MORE, "within", "repeats"]},
             predicates=tuple(by_key.get(r["key"], ())),
             references=tuple(tuple(x) for x in json.loads(r["references"])))
        for r in rules.toLocalIterator()
    ]


class RuleStore:
    """Rules added, listed and deleted at run time, as an append-only log.

    The current catalogue is the newest entry per bundle number that is not a
    deletion. Streams read it once per batch.
    """

    SCHEMA = T.StructType([
        T.StructField("bundle_id", T.LongType()), T.StructField("version", T.LongType()),
        T.StructField("deleted", T.BooleanType()), T.StructField("rule", T.StringType()),
    ])

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _log(self) -> list:
        from .sinks import _exists

        if not _exists(self.spark, self.path):
            return []
        return self.spark.read.schema(self.SCHEMA).json(self.path).collect()

    def _append(self, bundle_id: int, version: int, rule: Rule | None) -> None:
        text = None if rule is None else json.dumps(_rule_dict(rule))
        row = [(bundle_id, version, rule is None, text)]
        self.spark.createDataFrame(row, self.SCHEMA).write.mode("append").json(self.path)

    def add(self, rule: Rule) -> int:
        log = self._log()
        bundle_id = max((r["bundle_id"] for r in log), default=0) + 1
        self._append(bundle_id, len(log) + 1, rule)
        return bundle_id

    def delete(self, bundle_id: int) -> None:
        self._append(bundle_id, len(self._log()) + 1, None)

    def list(self) -> dict[int, Rule]:
        newest: dict[int, object] = {}
        for r in sorted(self._log(), key=lambda r: r["version"]):
            newest[r["bundle_id"]] = r
        return {
            i: _rule_from_dict(json.loads(r["rule"]))
            for i, r in sorted(newest.items()) if not r["deleted"]
        }

    def rules(self) -> list[Rule]:
        return list(self.list().values())


def _rule_dict(rule: Rule) -> dict:
    return {
        **{n: getattr(rule, n) for n in [*_TEXT, *_MORE, "within", "repeats"]},
        "predicates": [vars(p) for p in rule.predicates],
        "references": [list(r) for r in rule.references],
    }


def _rule_from_dict(d: dict) -> Rule:
    d = dict(d)
    d["predicates"] = tuple(Predicate(**p) for p in d["predicates"])
    d["references"] = tuple(tuple(r) for r in d["references"])
    return Rule(**d)
