"""SQL with the same results as the query catalogue, for an independent engine.

Written against the tables, not against the Spark code: common projections are
repeated here as common table expressions.
"""

from __future__ import annotations

# Written out again, so that a mistake in the implementation shows.
REASONS = {
    "unexpected": "⚠️ Suspicious command execution detected: Marked as 'unexpected' execution.",
    "root_outside": "⚠️ Root-level command executed outside the normal init process tree. "
                    "Possible direct shell access.",
    "root": "⚠️ Command executed with root privileges.",
    "package": "⚠️ Detected package manager command (e.g., apt update). Could indicate "
               "installation attempt.",
    "dns": "⚠️ DNS query to security.ubuntu.com detected. Indicates interactive package "
           "installation.",
    "http": "⚠️ HTTP request to Ubuntu archive/security servers for InRelease files. Indicates "
            "package list update.",
}
# Key, rule id, and what follows "indicator--" and "attack-pattern--", and the attack's name.
RULES = [
    ("nsenter", "1", "kh-ce-nsenter", "kh-ce-nsenter", "CE_NSENTER"),
    ("sys-ptrace", "2", "kh-ce-sys-ptrace", "kh-ce-sys-ptrace", "CE_SYS_PTRACE"),
    ("priv-mount", "3", "kh-ce-priv-mount", "kh-ce-priv-mount", "CE_PRIV_MOUNT"),
    ("module-load", "5", "kh-ce-module-load", "kh-ce-module-load", "CE_MODULE_LOAD"),
    ("net-mitm", "4", "kh-ce-net-mitm", "kh-ce-net-mitm", "CE_NET_MITM"),
    ("var-log-symlink", "6", "kh-ce-var-log-symlink", "kh-ce-var-log-symlink", "CE_VAR_LOG_SYMLINK"),
    ("var-log-route", "2", "kh-ce-var-log-route", "kh-ce-var-log-route", "CE_VAR_LOG_ROUTE"),
    ("var-log-token", "3", "kh-ce-var-log-token", "kh-ce-var-log-TOKEN", "CE_VAR_LOG_TOKEN"),
    ("var-log-rm-symlink", "4", "kh-ce-var-log-rm-symlink", "kh-ce-var-log-rm-symlink",
     "CE_VAR_LOG_SYMLINK"),
    ("umh-core-pattern", "7", "kh-ce-umh-core-pattern", "kh-ce-umh-core-pattern", "CE_UMH_CORE_PATTERN"),
    ("containerd-sock", "8", "kh-exploit-containerd-sock", "kh-exploit-containerd-sock",
     "EXPLOIT_CONTAINERD_SOCK"),
    ("host-read", "9", "kh-exploit-host-read", "kh-exploit-host-read", "EXPLOIT_HOST_READ"),
    ("host-write", "11", "kh-exploit-host-write", "kh-exploit-host-write", "EXPLOIT_HOST_WRITE"),
    ("tree", "12", "containerescapeplusmount", "containerescapeplusmount", "TREE"),
    ("escapemount", "13", "containerescapemount", "containerescapemount", "ESCAPEMOUNT"),
    ("alert-flags", "14", "kubescapetest", "kubescapetest", "kubescapetest"),
    ("trace-value", "15", "tracee", "tracee", "tracee"),
    ("ping-mounts", "16", "kh-ce-var-log-symlink", "kh-ce-var-log-symlink", "CE_VAR_LOG_SYMLINK"),
]

ORACLES: dict[str, str] = {}

EV = """
ev AS (
  SELECT event_id, user_id, event_type, value, props, ts,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
    strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '000Z' AS time_text,
    strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z' AS sec_text,
    epoch_us(ts) * 1000 AS ns,
    'node-' || (user_id % 5) AS node,
    'pod-' || user_id AS pod,
    CASE user_id % 4 WHEN 0 THEN 'default' WHEN 1 THEN 'webapp' WHEN 2 THEN 'storm'
      ELSE 'kube-system' END AS namespace,
    md5('c' || user_id) AS container
  FROM events)"""


def zfill(expr: str, n: int = 8) -> str:
    t = f"CAST({expr} AS VARCHAR)"
    return f"CASE WHEN length({t}) >= {n} THEN {t} ELSE lpad({t}, {n}, '0') END"


def stamp(t: str) -> str:
    return f"regexp_replace(substr({t}, 3, 20), '[-:.]', '', 'g')"


def corr(t: str, con: str, pid: str, host: str) -> str:
    return f"({stamp(t)} || substr({con}, 1, 12) || ({zfill(pid)}) || substr(md5({host}), 1, 12))"


def corr_v1(t: str, con: str, pid: str, host: str) -> str:
    h = f"substr({host}, 1, 12)"
    return f"({stamp(t)} || substr({con}, 1, 12) || ({zfill(pid)}) || ({zfill(h, 12)}))"


def oid(kind: str, *parts: str) -> str:
    h = f"md5(concat_ws('|', '{kind}', {', '.join(f'CAST({p} AS VARCHAR)' for p in parts)}))"
    cuts = " || '-' || ".join(
        f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
    return f"('{kind}--' || {cuts})"


def proc(c: str) -> str:
    return f"('process--' || substr({c}, 1, 36))"


FN = """CASE WHEN event_type = 'error' THEN '__x64_sys_setns'
  WHEN event_type = 'purchase' THEN '__x64_sys_mount'
  WHEN event_type = 'click' THEN 'security_file_permission'
  WHEN event_type = 'view' AND k < 50 THEN '__x64_sys_openat'
  WHEN event_type = 'view' THEN 'tcp_connect' END"""
PATH = """CASE WHEN k < 20 THEN '/run/secrets/kubernetes.io/serviceaccount/token'
  WHEN k < 40 THEN '/etc/kubernetes/pki/apiserver.key' ELSE '/tmp/' || k END"""
SETNS = "CASE WHEN k % 10 = 0 THEN 1073741824 ELSE k END"
MOUNT = "CASE WHEN k % 3 = 0 THEN '/proc' ELSE '/mnt/' || k END"

# Kernel rows with every field the queries show.
KER = EV + f""",
ker0 AS (
  SELECT *, event_id AS pid, {FN} AS fn,
    '/usr/bin/' || event_type || ' ' || CASE WHEN k <> 13 THEN props ELSE 'None' END AS cmd,
    CASE event_type WHEN 'error' THEN '3' WHEN 'purchase' THEN 'proc' WHEN 'click' THEN {PATH}
      WHEN 'view' THEN CASE WHEN k < 50 THEN '-100' ELSE '1' END ELSE '1' END AS f1,
    CASE event_type WHEN 'error' THEN CAST({SETNS} AS VARCHAR) WHEN 'purchase' THEN {MOUNT}
      WHEN 'click' THEN 'r'
      WHEN 'view' THEN CASE WHEN k < 50 THEN '/proc/' || (k % 25) || '/root' ELSE '1' END
      ELSE '1' END AS f2,
    CASE event_type WHEN 'click' THEN CASE WHEN k % 2 = 0 THEN '4' ELSE '2' END END AS f2c,
    {corr('time_text', 'container', 'event_id', 'node')} AS corr_id
  FROM ev),
ker AS (
  SELECT *, {proc('corr_id')} AS process_id, {oid('observed-data', 'corr_id', 'time_text', 'fn')} AS observed_id,
    md5('containerd://' || container || '/usr/bin/' || event_type ||
        CASE WHEN k <> 13 THEN props ELSE '1' END || '1' || '/bin/sh' || '1' ||
        coalesce(fn, '1') || f1 || f2 || coalesce(f2c, f2))
      || CASE WHEN event_type = 'signup' THEN 'exec' ELSE 'kpro' END AS dedup_key
  FROM ker0)"""


def add(name: str, sql: str) -> None:
    ORACLES[name] = sql


def ev(name: str, body: str) -> None:
    add(name, f"WITH {EV} {body}")


def ker(name: str, body: str, extra: str = "") -> None:
    add(name, f"WITH {KER}{extra} {body}")


# --- identifiers, times, text ------------------------------------------------------

ker("corr_id", "SELECT pid, corr_id, process_id, substr(md5(node), 1, 6) AS short_host FROM ker")
V1 = corr_v1("time_text", "container", "event_id", "node")
ev("corr_id_v1", f"SELECT event_id AS pid, {V1} AS corr_id, {proc(V1)} AS process_id FROM ev")
ev("object_ids", f"""SELECT event_id, {oid('bundle', 'event_id', 'pod')} AS bundle_id,
  'process--' || right(node || ':' || container, 36) AS from_exec,
  CAST(NULL AS VARCHAR) AS undecodable FROM ev""")
ev("iso_to_ns", """SELECT event_id, ns AS from_nanos, ns AS from_micros,
  CAST(floor(epoch(date_trunc('second', ts))) AS BIGINT) * 1000000000 AS from_seconds,
  CAST(NULL AS BIGINT) AS micro_only FROM ev""")
ev("epoch_unit_guess", """SELECT event_id, epoch_us(ts) // 1000000 * 1000000000 AS from_s,
  epoch_us(ts) // 1000 * 1000000 AS from_ms, ns AS from_us, ns AS from_ns,
  epoch_us(ts) // 1000 * 1000 AS loose_ms
  FROM ev""")
ev("epoch_to_iso", """SELECT event_id, sec_text AS iso, sec_text AS iso_from_ms,
  strftime(make_timestamp(epoch_ms(ts) // 1000000000 * 1000000), '%Y-%m-%dT%H:%M:%S') || 'Z'
    AS iso_loose,
  strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS iso_millis,
  strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS iso_micros FROM ev""")
ev("arg_pick", """, a AS (SELECT *,
    CASE event_type WHEN 'view' THEN '' WHEN 'click' THEN 'click' END AS s,
    CASE WHEN event_type IN ('view', 'error') THEN k % 3 END AS i,
    CASE WHEN event_type IN ('error', 'purchase')
      THEN '{"path":"/data/' || k || '","permission":"r"}' END AS f FROM ev)
  SELECT event_id,
    coalesce(nullif(s, ''), CAST(nullif(i, 0) AS VARCHAR), f, '') AS picked,
    '{' || concat_ws(',', '"int_arg":' || i, '"string_arg":"' || s || '"', '"file_arg":' || f)
      || '}' AS kprobe0, 'null' AS kprobe1 FROM a""")
ker("command_line", "SELECT pid, cmd AS command_line, '/bin/sh None' AS parent_command_line FROM ker")

DNS_NAME = """CASE WHEN k % 2 = 0 THEN 'svc-' || k || '.ns.svc.cluster.local'
  WHEN k = 9 THEN 'security.ubuntu.com' ELSE 'host-' || k || '.example.com' END"""
ev("json_fields", f"""SELECT event_id, {DNS_NAME} AS query_name, 'A' AS query_type,
  CAST(k % 4 AS INTEGER) AS response_code, CAST(CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END AS INTEGER) AS answers,
  CASE WHEN k % 4 = 0 THEN '10.0.0.' || k END AS first_answer FROM ev""")
ev("json_or_self", """SELECT event_id,
  CASE event_type WHEN 'error' THEN NULL WHEN 'click' THEN 'plain ' || k
    ELSE '{"k":' || k || '}' END AS as_text,
  CASE WHEN event_type NOT IN ('error', 'click') THEN k END AS k,
  event_type = 'error' AS is_null,
  CASE event_type WHEN 'error' THEN NULL WHEN 'click' THEN 'STRING' ELSE 'OBJECT<k: BIGINT>' END AS kind
  FROM ev""")
ev("parse_or_drop", "SELECT event_id, k FROM ev WHERE event_type <> 'error'")
ev("scalar_misc", """, p AS (SELECT *, (k * 257 + user_id) % 65536 AS port0 FROM ev)
  SELECT event_id, pod AS unwrapped, pod AS kept, props AS decoded,
  CAST((port0 >> 8) | ((port0 << 8) & 65280) AS BIGINT) AS port, pod AS short_pod,
  CASE WHEN k > 5 THEN 'http://10.0.0.' || k || ':' || k || '/p/' || user_id END AS url,
  event_type || ' T' || k || ' ' AS interpretation, substr(pod, 1, 5) AS cut,
  '{"type":"process","pid":' || k || ',"pod_name":"' || pod || '"}' AS document FROM p""")
ev("flatten_args", """, t AS (SELECT * FROM ev WHERE k <> 7),
  e AS (
    SELECT event_id, '0_name' AS key, 'arg' || (k % 5) AS value FROM t
    UNION ALL SELECT event_id, '0_type', 'int' FROM t
    UNION ALL SELECT event_id, '0_value[0]', CAST(k AS VARCHAR) FROM t
    UNION ALL SELECT event_id, '0_value[1]', 'x' FROM t
    UNION ALL SELECT event_id, '1_name', 'doc' FROM t
    UNION ALL SELECT event_id, '1_type', 'object' FROM t
    UNION ALL SELECT event_id, '1_value_k', CAST(k AS VARCHAR) FROM t)
  SELECT event_id, key, value FROM e""")
add("object_fingerprint", """SELECT md5('{"ext":{"a":' || (o_custkey % 5) || ',"z":"x"},"n":'
    || CASE o_orderkey % 3 WHEN 0 THEN '1' WHEN 1 THEN '"1"' ELSE 'true' END
    || ',"priority":"' || o_orderpriority || '","status":"' || o_orderstatus || '","type":"process"}')
    AS fingerprint, count(*) AS n, min(o_orderkey) AS first_order
  FROM orders GROUP BY 1""")

# --- fingerprints and normalisers -----------------------------------------------------

ker("log_fingerprint", "SELECT pid, dedup_key FROM ker")
K0 = f"""CASE event_type WHEN 'error' THEN '3' WHEN 'purchase' THEN 'proc'
  WHEN 'click' THEN '{{"path":"' || ({PATH}) || '","permission":"r"}}'
  WHEN 'view' THEN CASE WHEN k < 50 THEN '-100' ELSE '{{"daddr":"10.1.' || (k % 32) || '.7","state":"'
    || CASE WHEN k % 5 = 0 THEN '110' ELSE 'TCP_SYN' END || '"}}' END ELSE '' END"""
K1 = f"""CASE event_type WHEN 'error' THEN CAST(nullif({SETNS}, 0) AS VARCHAR)
  WHEN 'purchase' THEN {MOUNT} WHEN 'click' THEN CASE WHEN k % 2 = 0 THEN '4' ELSE '2' END
  WHEN 'view' THEN CASE WHEN k < 50 THEN '/proc/' || (k % 25) || '/root' ELSE '' END ELSE '' END"""


def kernel_object(k0: str, k1: str, flat: bool) -> str:
    fields = f"""'"flags":"execve","image_id":"img-' || (user_id % 7)
      || '","container_id":"containerd://' || container || '","pod_name":"' || pod
      || '","namespace":"' || namespace || '","function_name":"' || coalesce(fn, '')
      || '","parent_pid":"p' || user_id || '","parent_command_line":"/bin/sh None","parent_cwd":"/",'
      || '"grand_parent_pid":"g' || (user_id % 10) || '","kprobe0":' || to_json({k0})
      || ',"kprobe1":' || to_json({k1}) || ',"kprobe2":"","kprobe3":"","kprobe4":""'"""
    ext = f"'{{' || {fields} || '}}'" if flat else (
        f"""'{{"x-tetra-ext":{{"extension_type":"property-extension",' || {fields} || '}}}}'""")
    return f"""'{{"type":"process","id":"' || process_id || '","pid":' || pid || ',"command_line":'
      || to_json(cmd) || ',"cwd":"/","created_time":"' || time_text || '","extensions":' || {ext}
      || '}}'"""


ker("normalise_kernel", f"""SELECT pid, k0, k1, coalesce(fn, '') AS function_name,
    ns AS event_ts_ns, observed_id, {kernel_object('k0', 'k1', False)} AS object
  FROM (SELECT *, {K0} AS k0, {K1} AS k1 FROM ker)""")

ALERT = """CASE event_type WHEN 'error' THEN 'Unexpected process launched'
  WHEN 'click' THEN 'Unexpected file access' WHEN 'view' THEN 'Unexpected system call'
  WHEN 'purchase' THEN 'Unexpected capability used' ELSE 'Custom rule' END"""
APATH = """CASE WHEN event_type = 'click' THEN
  CASE WHEN k < 50 THEN '/etc/f' ELSE '/home/f' END || k END"""
AL = EV + f""",
al AS (SELECT *, {ALERT} AS alert_name, {APATH} AS path,
    event_type || ' ' || props AS cmd,
    {corr('sec_text', 'container', 'user_id', 'pod')} AS corr_id,
    md5({ALERT} || container || pod || coalesce(
      CASE WHEN event_type = 'purchase' THEN 'CAP_' || (k % 4) END, {APATH},
      CASE WHEN event_type = 'error' THEN '/bin/x' || (k % 9) END, '1')
      || event_type || ' ' || props || event_id) AS dedup_key
  FROM ev)"""
add("normalise_alert", f"""WITH {AL} SELECT corr_id, {proc('corr_id')} AS process_id, dedup_key,
  cmd AS command_line, 'R' || (k % 10) AS rule_id, CAST(event_id AS VARCHAR) AS k4,
  '{{"type":"process","id":"' || {proc('corr_id')} || '","pid":' || user_id || ',"command_line":'
    || to_json(cmd) || ',"cwd":"/","created_time":"' || sec_text || '","extensions":{{"container_id":"'
    || container || '","flags":"' || alert_name || ': ' || k || '","image_id":"img-' || (user_id % 7)
    || '","pod_name":"' || pod || '","namespace":"' || namespace || '","function_name":"R' || (k % 10)
    || '","parent_pid":' || user_id || ',"parent_command_line":"shim","kprobe0.capability":"'
    || CASE WHEN event_type = 'purchase' THEN 'CAP_' || (k % 4) ELSE '' END
    || '","kprobe1.syscall":"' || CASE WHEN event_type = 'view' THEN 'sys_' || k ELSE '' END
    || '","kprobe2.trace":{{}},"kprobe3.severity":' || (k % 10) || ',"kprobe4.infectedPID":' || event_id
    || '}}}}' AS object FROM al""")
AV1 = corr_v1("time_text", "container", "event_id", "('cloud-' || node)")
ev("normalise_alert_v1", f"""SELECT event_id AS pid, {AV1} AS corr_id, {proc(AV1)} AS process_id,
  'cloud-' || node AS node, time_text AS created_time FROM ev""")
MS = "strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"
TR = EV + f""",
tr AS (SELECT *, {MS} AS ms_text FROM ev),
trace AS (SELECT *, {corr_v1('ms_text', 'container', 'event_id', 'node')} AS corr_id,
    md5(user_id || container || event_type || CASE WHEN k <> 7 THEN 'arg' || (k % 5) ELSE '1' END
      || (user_id % 11) || (user_id % 13)) AS dedup_key FROM tr)"""
add("normalise_trace", f"""WITH {TR} SELECT event_id AS pid, corr_id, {proc('corr_id')} AS process_id,
  dedup_key, 'escape T' || k || ' ' AS interpretation, ms_text AS time_text,
  CAST(k AS VARCHAR) AS first_value FROM trace WHERE namespace <> 'storm' AND k <> 7""")
RA = EV + f""",
ra AS (SELECT *, {corr_v1('time_text', 'container', '(event_id % 1000)', 'node')} AS corr_id,
    md5(substr(container, 1, 12) || pod || event_type || 'sh' || event_type || (user_id % 3) || '1'
      || '/bin/x') AS dedup_key FROM ev)"""
add("normalise_rule_alert", f"""WITH {RA} SELECT ns AS event_ts_ns, corr_id,
  {proc('corr_id')} AS process_id, dedup_key, event_type || ' ' || k AS command_line,
  'repo None' AS image_id, CASE WHEN event_type = 'error' THEN 'Critical' ELSE 'Notice' END
    AS alert_name, 'container, ' || event_type AS interpretation, '10.0.0.' || k AS k1 FROM ra""")
SPAN_CORR = corr("sec_text", "container", "event_id", "pod")
REQ_PATH = "CASE WHEN k % 3 = 0 THEN '/dists/jammy/InRelease' ELSE '/p/' || k END"
ev("normalise_http", f"""SELECT ns AS "timestamp", sec_text AS start, {SPAN_CORR} AS corr_id,
  'GET' AS method, 'http://10.42.0.' || (user_id % 250) || ':8080' || {REQ_PATH} AS url,
  CAST(200 + k % 5 AS INTEGER) AS status_code,
  CASE WHEN k < 30 THEN 'archive.ubuntu.com' ELSE 'example.com' END AS host,
  CAST(2 AS INTEGER) AS objects FROM ev""")
ev("normalise_dns", f"""SELECT ns AS "timestamp", sec_text AS start, {SPAN_CORR} AS corr_id,
  {DNS_NAME} AS query_name, 'A' AS query_type, CAST(k % 4 AS INTEGER) AS response_code,
  {SPAN_CORR} AS correlation FROM ev""")
add("normalise_union", f"""WITH {KER}, {AL.replace(EV + ',', '')}, {TR.replace(EV + ',', '')},
  {RA.replace(EV + ',', '')}
  SELECT 'kernel' AS source, ns AS event_ts_ns, pod, namespace, corr_id, process_id,
    cmd AS command_line, dedup_key FROM ker WHERE event_type IN ('signup', 'error')
  UNION ALL SELECT 'alert', epoch_us(ts) // 1000000 * 1000000000, pod, namespace, corr_id,
    {proc('corr_id')}, cmd, dedup_key FROM al WHERE event_type = 'click'
  UNION ALL SELECT 'trace', ns, pod, namespace, corr_id, {proc('corr_id')}, event_type, dedup_key
    FROM trace WHERE event_type = 'view'
  UNION ALL SELECT 'rule_alert', ns, pod, namespace, corr_id, {proc('corr_id')},
    event_type || ' ' || k, dedup_key FROM ra WHERE event_type = 'purchase'""")
add("object_rows", f"""WITH {AL} SELECT sec_text AS "timestamp", pod AS pod_name, namespace, corr_id,
  {proc('corr_id')} AS process_id FROM al""")
add("alert_to_kernel", f"""WITH {AL} SELECT time_text AS "time", node AS node_name, alert_name AS type,
  event_id AS pid, 'unknown' AS exec_id, CAST(4294967295 AS BIGINT) AS auid, pod,
  'unknown' AS workload, container AS docker, path FROM al""")

# --- filters and projections -------------------------------------------------------------

ker("export_filter", """SELECT CASE WHEN event_type = 'signup' THEN 'process_exec'
  ELSE 'process_kprobe' END AS type, namespace, count(*) AS n FROM ker
  WHERE namespace IN ('default', 'webapp') GROUP BY 1, 2""")
add("rule_binding", f"""WITH {AL} SELECT event_id, alert_name, path, namespace FROM al
  WHERE namespace IN ('default', 'webapp') AND alert_name <> 'Custom rule'
  AND (alert_name <> 'Unexpected file access' OR path LIKE '/etc%')""")
add("message_filter", f"""WITH {AL} SELECT event_id, alert_name || ': ' || k AS message FROM al
  WHERE event_type = 'error'""")
ev("api_filters", """SELECT event_id, pod AS pod_name, '10.0.0.' || (k % 50) AS remote_addr FROM ev
  WHERE namespace = 'webapp' AND k % 50 = 7""")
ev("span_bounds", """SELECT 'recent' AS bound, count(*) AS n, min(event_id) AS first_event FROM ev
    WHERE ns >= (SELECT max(ns) FROM ev) - 1200000000000
  UNION ALL SELECT 'since', count(*), min(event_id) FROM ev
    WHERE ns >= 1705276800000000000 AND namespace = 'webapp'""")
ev("span_process", """SELECT event_id, coalesce(c_custkey + 1000000, event_id) AS pid,
  md5(c_name) AS container_id, c_mktsegment AS node_name
  FROM ev LEFT JOIN customer ON c_custkey = event_id""")
ev("path_exclusion", """SELECT event_id, '/var/log/pods/' || namespace || '_'
    || CASE WHEN k % 3 = 0 THEN 'netd-' ELSE 'web-' END || pod || '/main/0.log' AS path FROM ev
  WHERE namespace <> 'storm' AND NOT (namespace = 'kube-system' AND k % 3 = 0)""")
ev("retention", "SELECT event_id FROM ev WHERE ts > (SELECT max(ts) FROM ev) - INTERVAL 4 HOURS")
ev("connect_lines", """SELECT CAST(CASE WHEN k % 3 = 0 THEN 2 ELSE 10 END AS INTEGER) AS family,
  event_id AS pid, event_type || ' x' AS comm, '10.0.0.' || k AS saddr,
  CAST(k * 3 AS INTEGER) AS lport, '10.1.0.' || k AS daddr,
  CAST(CASE WHEN k = 4 THEN NULL ELSE 443 END AS INTEGER) AS dport FROM ev WHERE k % 3 < 2""")
add("http_endpoints", """WITH s AS (SELECT *, 'web/page-' || (page_id % 17) AS pod,
    regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) AS req_path,
    '10.0.0.' || (page_id % 50) AS remote_addr, page_id % 2 = 1 AS server FROM pages),
  j AS (SELECT s.*, 'ns/' || n_name AS ra FROM s LEFT JOIN nation ON page_id % 50 = n_nationkey)
  SELECT page_id, CASE WHEN server THEN coalesce(ra, remote_addr) ELSE pod END AS source,
    CASE WHEN server THEN pod ELSE coalesce(ra, remote_addr) END AS destination,
    CASE WHEN server THEN ra IS NOT NULL ELSE true END AS is_source_pod_type,
    CASE WHEN server THEN true ELSE ra IS NOT NULL END AS is_dest_pod_type, req_path FROM j""")

# --- selection policies --------------------------------------------------------------------

add("policy_tags", """SELECT p_partkey, 'equal' AS policy FROM part
    WHERE p_type = 'ECONOMY' AND p_name IN ('red ring', 'blue bolt')
  UNION ALL SELECT p_partkey, 'prefix' FROM part
    WHERE p_type = 'SMALL' AND (p_name LIKE 'red%' OR p_name LIKE 'small%')
  UNION ALL SELECT p_partkey, 'postfix' FROM part WHERE p_type = 'ECONOMY' AND
    ((p_name LIKE '%widget' AND p_brand NOT IN ('Brand#1', 'Brand#2')) OR p_brand = 'Brand#3')""")
ker("kernel_policies", f"""SELECT event_id, 'enumerate-service-account' AS policy FROM ker
    WHERE event_type = 'click' AND k < 20 AND k % 2 = 0
  UNION ALL SELECT event_id, 'detect-sensitive-file-access' FROM ker
    WHERE event_type = 'click' AND k >= 20 AND k < 40 AND k % 2 = 0
  UNION ALL SELECT event_id, 'detect-share-ps-namespace' FROM ker
    WHERE event_type = 'view' AND k < 50 AND k % 25 BETWEEN 1 AND 20
  UNION ALL SELECT event_id, 'k8s-api-calls' FROM ker WHERE fn = 'tcp_connect' AND k % 32 < 16
  UNION ALL SELECT event_id, 'monitor-network-activity-outside-cluster-cidr-range' FROM ker
    WHERE fn = 'tcp_connect'
  UNION ALL SELECT event_id, 'detect-identity-assume' FROM ker
    WHERE event_type = 'click' AND k < 20 AND k % 2 = 0
  UNION ALL SELECT event_id, 'detect-ce-nsenter' FROM ker WHERE event_type = 'error'
  UNION ALL SELECT event_id, 'detect-ce-priv-mount' FROM ker WHERE event_type = 'purchase'
  UNION ALL SELECT event_id, 'list-syscalls' FROM ker
    WHERE event_type = 'purchase' OR (event_type = 'view' AND k < 50)""")
ADDR = """a AS (SELECT c_custkey, c_custkey % 4 AS o2, (c_custkey // 4) % 256 AS o3,
    c_custkey % 256 AS o4 FROM customer),
  ip AS (SELECT *, 167772160 + o2 * 65536 + o3 * 256 + o4 AS ip FROM a)"""
add("cidr_policy", f"""WITH {ADDR}, d AS (SELECT *,
    (o2 = 1 AND o3 < 16) OR (o2 = 2 AND o3 = 3 AND o4 = 14) OR (o2 = 3 AND o3 >= 128) AS daddr FROM ip)
  SELECT c_custkey, ip, daddr, NOT daddr AS not_daddr, o2 < 64 AS subset,
    o2 = 2 AND o3 = 7 AS superset FROM d""")
add("cidr_table", f"""WITH {ADDR}, b AS (SELECT s_suppkey, 18 + s_suppkey % 9 AS bits,
    167772160 + (s_suppkey % 4) * 65536 + (s_suppkey % 256) * 256 AS base FROM supplier)
  SELECT c_custkey, s_suppkey FROM ip JOIN b ON ip >> (32 - bits) = base >> (32 - bits)""")
LIN = """lin AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey > 0 THEN o_orderkey // 3 END AS parent_id,
    o_orderpriority, o_orderstatus AS status FROM orders)"""
add("descendants", f"""WITH RECURSIVE {LIN}, hit(id) AS (
    SELECT id FROM lin WHERE id % 97 = 5 AND status <> 'P'
    UNION SELECT lin.id FROM lin JOIN hit ON lin.parent_id = hit.id)
  SELECT id FROM hit""")
add("follow_children", f"""WITH RECURSIVE {LIN}, hit(id) AS (
    SELECT id FROM lin WHERE o_orderpriority = '1-URGENT' AND status = 'F' AND id > 50
    UNION SELECT lin.id FROM lin JOIN hit ON lin.parent_id = hit.id)
  SELECT l_orderkey AS exec_id, l_linenumber, l_partkey FROM lineitem
  WHERE l_orderkey IN (SELECT id FROM hit)""")
add("ancestry", f"""WITH RECURSIVE {LIN}, up(id, ancestor_id, depth) AS (
    SELECT id, parent_id, 1 FROM lin WHERE parent_id IS NOT NULL
    UNION ALL SELECT up.id, lin.parent_id, depth + 1 FROM up JOIN lin ON up.ancestor_id = lin.id
      WHERE lin.parent_id IS NOT NULL)
  SELECT id, ancestor_id, CAST(depth AS INTEGER) AS depth FROM up""")

# --- rules ------------------------------------------------------------------------------------

TEXT_PREDICATES = {
    "text-1": "regexp_matches(text, '(?i)licen[cs]e')",
    "text-2": r"regexp_matches(text, '\d+\.\d+\.\d+\.\d+')",
    "text-3": "text LIKE '%token%' OR text LIKE '%Token%'",
    "text-4": "contains(text, 'the') AND lang <> 'fr' AND doc_id < 500",
    "text-5": "lang IN ('de', 'es')",
    "text-6": "n_chars > 300 AND doc_id >= 9000",
    "text-7": r"regexp_matches(text, '^\S+@\S+|[a-z]+@[a-z]+\.[a-z]+')",
    "text-8": "source <> 'src0' AND doc_id > 17.5 AND doc_id <= 40",
}
TEXT_HITS = " UNION ALL ".join(
    f"SELECT doc_id, '{k}' AS key, 'indicator--{k}' AS indicator_id FROM documents WHERE {p}"
    for k, p in TEXT_PREDICATES.items())
add("rule_match", TEXT_HITS)
add("rule_match_counts", f"SELECT key, count(*) AS n FROM ({TEXT_HITS}) GROUP BY key")

# What each shipped rule says about the kernel stand-in, by layout. The command
# lines are "/usr/bin/<event type> <props>", which no command-line rule matches.
INTENDED = {
    "nsenter": "event_type = 'error' AND k % 10 = 0",
    "priv-mount": "event_type = 'purchase' AND k % 3 = 0",
    "var-log-token": "event_type = 'click' AND k < 20",
    "umh-core-pattern": "event_type = 'click'",
    "tree": "event_type IN ('error', 'purchase')",
    "escapemount": "(event_type = 'error' AND k % 10 = 0) OR event_type = 'purchase'",
}
FLAT = {
    "umh-core-pattern": "event_type = 'click'",
    "tree": "event_type IN ('error', 'purchase')",
    "escapemount": "event_type = 'purchase'",
}
CALIBRATION = {
    "calibration-nsenter": "event_type = 'error'",
    "calibration-umh-core-pattern": "event_type = 'click'",
}


def hits(rules: dict[str, str], columns: str = "*") -> str:
    return " UNION ALL ".join(
        f"SELECT {columns}, '{k}' AS key FROM ker WHERE {p}" for k, p in rules.items())


ORDER = {r[0]: i for i, r in enumerate(RULES)}
RANK = "CASE key " + " ".join(f"WHEN '{k}' THEN {i}" for k, i in ORDER.items()) + " END"
ker("kernel_rule_match", f"""SELECT pid, string_agg(key, ',' ORDER BY {RANK}) AS matches
  FROM ({hits(INTENDED, 'pid')}) GROUP BY pid""")
ker("strict_vs_intended_paths", f"""SELECT layout, key, count(*) AS n FROM (
    SELECT 'flat' AS layout, key FROM ({hits({**FLAT, **CALIBRATION}, 'pid')})
    UNION ALL SELECT 'intended', key FROM ({hits({**INTENDED, **CALIBRATION}, 'pid')}))
  GROUP BY layout, key""")
# Case of ``standins.policy_log`` -> the policies that take it; "L" is list-syscalls.
TAKEN = {
    0: "metadata-api-tracing", 3: "ssh-close", 5: "ssh-close", 6: "ssh-spawn-bash", 8: "successful-ssh-connections",
    10: "successful-ssh-connections", 11: "k8s-api-calls monitor-network-activity-outside-cluster-cidr-range",
    12: "monitor-network-activity-outside-cluster-cidr-range", 15: "enumerate-service-account detect-identity-assume",
    18: "enumerate-util", 20: "detect-scp-usage", 21: "detect-k8sapi-invoke", 23: "detect-symlinkat detect-ce-var-log-symlink",
    24: "detect-ce-var-log-symlink", 26: "detect-sensitive-file-access", 29: "detect-sensitive-file-access",
    30: "detect-ce-sys-ptrace L", 31: "L", 32: "detect-ce-sys-ptrace", 33: "detect-ce-module-load", 35: "detect-ce-nsenter",
    36: "detect-ce-priv-mount L", 38: "detect-iptables-mitm", 39: "detect-ce-umh-core-pattern",
    42: "detect-container-attach detect-pod-exec detect-POD_ATTACH", 44: "detect-pod-create-using-kubectl L",
    45: "detect-pod-create-using-kubectl L", 46: "L", 47: "L", 48: "detect-exploit-host-read L", 49: "L",
    50: "detect-exploit-host-write L", 51: "capture-stdin-stdout L", 52: "L", 53: "detect-exploit-host-write L", 54: "L",
    55: "detect-exploit-host-write L", 56: "detect-containerd-sock-exploit-dup2 L", 57: "L",
    58: "detect-exploit-containerd-sock L", 59: "L", 60: "detect-kubelet-pods-access L", 61: "L",
    62: "detect-share-ps-namespace L", 63: "L", 64: "L", 65: "L",
}
ev("every_policy", "SELECT event_id, policy FROM ev JOIN (VALUES " + ", ".join(
    f"({case}, '{'list-syscalls' if name == 'L' else name}')" for case, names in TAKEN.items() for name in names.split())
    + ") t(kase, policy) ON event_id % 66 = kase")
ev("process_tree", """, RECURSIVE up AS (SELECT event_id, event_id AS anc FROM ev
    UNION ALL SELECT event_id, anc // 2 FROM up WHERE anc > 1),
  hit AS (SELECT DISTINCT event_id FROM up WHERE anc IN (5, 11))
  SELECT 'pids' AS part, event_id FROM hit
  UNION ALL SELECT 'others', event_id FROM ev WHERE event_id NOT IN (SELECT event_id FROM hit)
  UNION ALL SELECT DISTINCT 'binary', up.event_id FROM up JOIN ev b ON b.event_id = up.anc WHERE b.event_type = 'signup'""")
ORACLES["process_tree"] = ORACLES["process_tree"].replace("WITH", "WITH RECURSIVE", 1).replace(", RECURSIVE up", ", up", 1)
add("raw_alert_bundles", f"""WITH {AL} SELECT event_id, CAST(6 AS INTEGER) AS n_objects, 'alert-flags' AS keys,
  {proc('corr_id')} AS process_id FROM al WHERE event_type = 'click' AND k % 2 = 0""")
ker("gated_rules", """SELECT 'part-' || p_partkey AS key, count(*) AS n FROM part JOIN ker
    ON fn = CASE p_partkey % 3 WHEN 0 THEN '__x64_sys_setns' WHEN 1 THEN '__x64_sys_mount'
      ELSE 'security_file_permission' END AND contains(cmd, '"k": ' || (p_partkey % 100) || '}')
  GROUP BY 1""")
add("rule_index", """WITH r AS (
    SELECT 2 * doc_id AS key, substr(text, 3 + doc_id % 50, 6 + doc_id % 5) AS piece FROM documents
    UNION ALL SELECT 2 * doc_id + 1, substr(text, 20 + doc_id % 90, 10 + doc_id % 7) FROM documents)
  SELECT key, count(*) AS n FROM r JOIN documents ON contains(text, piece) WHERE piece <> '' GROUP BY key""")
RULE_ROWS = "rules(key, rule_id, indicator_id, attack_id, attack_name) AS (VALUES " + ", ".join(
    f"('{key}', '{rule}', 'indicator--{ind}', 'attack-pattern--{att}', '{name}')"
    for key, rule, ind, att, name in RULES) + ")"
ker("indicator_resolution", f"""SELECT indicator_id, attack_id AS target_ref, attack_name,
    count(*) AS n FROM ({hits(INTENDED, 'pid')}) JOIN rules USING (key)
    WHERE key <> 'var-log-token' GROUP BY 1, 2, 3""",  # its relationship points to no attack
    f", {RULE_ROWS}")

# --- bundles ----------------------------------------------------------------------------------

BUNDLE_ID = oid("bundle", "corr_id", "time_text", "dedup_key")
MATCHED = f""", {RULE_ROWS},
matched AS (
  SELECT pid, string_agg(key, ',' ORDER BY {RANK}) AS keys, count(*) AS n_matches,
    string_agg(rule_id, ',' ORDER BY {RANK}) AS rule_ids,
    arg_max(rule_id, {RANK}) AS last_rule, arg_min(indicator_id, {RANK}) AS first_indicator,
    string_agg('"' || indicator_id || '"', ',' ORDER BY {RANK}) AS indicators
  FROM ({hits(FLAT, 'pid')}) JOIN rules USING (key) GROUP BY pid),
kb AS (SELECT *, {BUNDLE_ID} AS bundle_id FROM ker JOIN matched USING (pid))"""
ker("bundle_assembly", f"""SELECT pid, bundle_id, CAST(2 + 4 * n_matches AS INTEGER) AS n_objects,
  last_rule || ':' || dedup_key AS store_key, {kernel_object("''", "''", True)} AS process,
  '{{"type":"observed-data","id":"' || observed_id || '","created":"' || time_text
    || '","first_observed":"' || time_text || '","last_observed":"' || time_text
    || '","number_observed":1,"object_refs":["' || process_id || '",' || indicators
    || '],"extensions":{{"alert_name":"KPROBE_ACTION_POST","correlation":"' || corr_id
    || '","rule_id":"policy-' || event_type || '","node_info":{{"node_name":"' || node
    || '"}},"children":""}}}}' AS observed,
  first_indicator AS first_target, observed_id FROM kb""", MATCHED)
ker("raw_kernel_bundles", "SELECT pid, bundle_id, CAST(2 + 4 * n_matches AS INTEGER) AS n_objects FROM kb", MATCHED)
ker("matched_rule_rows", """SELECT time_text AS "timestamp", rule_ids AS pattern_ids, bundle_id,
  process_id FROM kb""", MATCHED)
ker("graph_nodes", """SELECT 'process' AS type, count(*) AS n, count(DISTINCT process_id) AS n_ids
    FROM kb
  UNION ALL SELECT 'observed-data', count(*), count(DISTINCT observed_id) FROM kb
  UNION ALL SELECT 'attack-pattern', count(*), count(DISTINCT attack_id) FROM f JOIN rules USING (key)
  UNION ALL SELECT 'indicator', count(*), count(DISTINCT indicator_id) FROM f JOIN rules USING (key)
  UNION ALL SELECT 'relationship', 2 * count(*), count(*) + count(DISTINCT key) FROM f""",
    MATCHED + f", f AS ({hits(FLAT, 'pid')})")
ker("graph_edges", """SELECT bundle_id, observed_id AS src, process_id AS dst, 'refers' AS label FROM kb
  UNION ALL SELECT bundle_id, observed_id, indicator_id, 'refers' FROM kb JOIN f USING (pid)
    JOIN rules ON f.key = rules.key
  UNION ALL SELECT bundle_id, bundle_id, indicator_id, 'indicates' FROM kb JOIN f USING (pid)
    JOIN rules ON f.key = rules.key
  UNION ALL SELECT bundle_id, indicator_id, attack_id, 'indicates' FROM kb JOIN f USING (pid)
    JOIN rules ON f.key = rules.key""", MATCHED + f", f AS ({hits(FLAT, 'pid')})")

LI = """li AS (SELECT *, 'bundle--' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-'
      || l_suppkey AS bundle_id, l_suppkey % 7 AS rule_id, l_orderkey AS seen,
    '{"type":"process","id":"process--' || l_orderkey || '","pid":' || (l_partkey % 50) || '}' AS o1,
    '{"type":"indicator","id":"indicator--' || l_orderkey || '-' || l_linenumber || '","name":"'
      || l_returnflag || l_linestatus || '"}' AS o2, l_partkey % 50 AS pid,
    l_returnflag || l_linestatus AS kind FROM lineitem),
  obj AS (
    SELECT *, 0 AS pos, 'process' AS type, o1 AS object, CAST(pid AS VARCHAR) AS fp FROM li
    UNION ALL SELECT *, 1, 'indicator', o2, kind FROM li
    UNION ALL SELECT *, 2, 'indicator', o2, kind FROM li)"""


def merged(group: str) -> str:
    return f"""WITH {LI}, g AS (SELECT *, {group} AS group_key FROM obj),
  kept AS (SELECT * FROM g QUALIFY row_number() OVER (
      PARTITION BY group_key, type, fp ORDER BY seen, bundle_id, pos) = 1),
  heads AS (SELECT group_key, bundle_id AS merged_id FROM g QUALIFY row_number() OVER (
      PARTITION BY group_key ORDER BY seen, bundle_id, pos) = 1)"""


MERGED_ROWS = """SELECT group_key, merged_id, bundle_id, CAST(pos AS INTEGER) AS pos, type, object
  FROM kept JOIN heads USING (group_key)"""
add("consolidate_by_rule", f"{merged('rule_id')} {MERGED_ROWS}")
add("consolidate_by_process", f"""{merged("'process--' || l_orderkey")} {MERGED_ROWS}""")
add("consolidate_keep_first", f"""{merged('rule_id')},
  whole AS (SELECT g.group_key, merged_id, g.type FROM g JOIN heads USING (group_key)
      WHERE g.bundle_id = merged_id
    UNION ALL SELECT kept.group_key, merged_id, kept.type FROM kept JOIN heads USING (group_key)
      WHERE kept.bundle_id <> merged_id)
  SELECT group_key, merged_id, type, count(*) AS n FROM whole GROUP BY 1, 2, 3""")
add("bundle_parts", f"""{merged('rule_id')} SELECT group_key, merged_id AS bundle_id,
  count(*) AS objects, true AS bounded FROM kept JOIN heads USING (group_key) GROUP BY 1, 2""")

# --- deduplication, stores, baselines ---------------------------------------------------------

ker("dedupe_first", """SELECT dedup_key, pid, ns AS event_ts_ns FROM ker
  QUALIFY row_number() OVER (PARTITION BY dedup_key ORDER BY ns, pid) = 1""")
ker("observed_counts", """SELECT dedup_key, count(*) AS number_observed, min(ns) AS first_observed,
  max(ns) AS last_observed FROM ker GROUP BY dedup_key""")
LATEST = """SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (
  PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1"""
add("upsert_latest", LATEST)
add("keyed_store", LATEST)
add("store_growth", LATEST)
ev("table_compacted", """SELECT strftime(ts, '%Y-%m-%d') AS dt, count(*) AS n, sum(event_id)::BIGINT AS pids,
    CASE WHEN dt < '2024-01-20' THEN 1::BIGINT END AS files FROM ev GROUP BY 1""")
add("benign_filter", """SELECT doc_id, md5(text) AS dedup_key FROM documents WHERE NOT EXISTS (
  SELECT 1 FROM documents g JOIN labels USING (doc_id)
  WHERE quality = 1 AND md5(g.text) = md5(documents.text))""")
ev("append_rate", """SELECT event_type, CAST(epoch(date_trunc('minute', ts)) AS BIGINT) AS minute,
  count(*) AS n FROM ev GROUP BY 1, 2""")
ev("equilibrium", """SELECT pod, date_trunc('minute', max(ts)) < TIMESTAMP '2024-01-30 12:00:00'
  AS reached, CAST(epoch(date_trunc('minute', max(ts))) AS BIGINT) AS last_minute
  FROM ev GROUP BY pod""")
BEH = EV + """,
b AS (SELECT event_id, pod AS workload, event_type AS kind, '/p/' || (k % 40) AS entry, ts FROM ev),
prof AS (SELECT DISTINCT b.workload, kind, entry FROM b JOIN (
    SELECT workload, min(ts) AS start FROM b GROUP BY 1) s ON b.workload = s.workload
  WHERE ts < start + INTERVAL 3 DAYS)"""
add("learn_profile", f"WITH {BEH} SELECT workload, kind, entry FROM prof")
add("profile_deviation", f"""WITH {BEH} SELECT event_id, workload, kind, entry,
  'Unexpected file access' AS alert FROM b WHERE NOT EXISTS (SELECT 1 FROM prof
  WHERE prof.workload = b.workload AND prof.kind = b.kind AND prof.entry = b.entry)""")
add("profile_wildcard", """WITH seen AS (SELECT page_id, 'web/page-' || (page_id % 17) AS workload,
    regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) AS entry FROM pages),
  prof AS (SELECT DISTINCT workload, page_id % 4 = 0 AND entry <> '' AS wild,
      CASE WHEN page_id % 4 = 0 THEN regexp_replace(entry, '/[^/]*$', '/') ELSE entry END AS head
    FROM seen WHERE page_id % 2 = 0)
  SELECT page_id, workload, entry FROM seen WHERE NOT EXISTS (SELECT 1 FROM prof
    WHERE prof.workload = seen.workload AND CASE WHEN wild
      THEN starts_with(entry, head) AND NOT contains(substr(entry, length(head) + 1), '/')
      ELSE entry = head END)""")
ev("cooldown", """, c AS (SELECT event_id, namespace,
    CAST(epoch(time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01')) AS BIGINT) AS period, ts
    FROM ev WHERE event_type = 'error')
  SELECT event_id, namespace, period, CAST(row_number() OVER (PARTITION BY namespace, period
    ORDER BY ts, event_id) AS INTEGER) AS rank_in_key FROM c
  QUALIFY rank_in_key <= 3""")
add("profile_portability", """WITH p AS (SELECT c_nationkey AS entry, 'customer' AS env FROM customer
    UNION SELECT s_nationkey, 'supplier' FROM supplier)
  SELECT entry, count(*) AS environments, min(env) AS first_environment, max(env) AS last_environment
  FROM p GROUP BY entry""")
add("profile_sets", """WITH a AS (SELECT c_nationkey % 20 AS entry FROM customer),
  b AS (SELECT s_nationkey % 15 + 4 AS entry FROM supplier),
  parts AS (SELECT 'common' AS part, entry FROM (SELECT entry FROM a INTERSECT SELECT entry FROM b)
    UNION ALL SELECT 'only_first', entry FROM (SELECT entry FROM a EXCEPT SELECT entry FROM b)
    UNION ALL SELECT 'only_first_all', entry
      FROM (SELECT entry FROM a EXCEPT ALL SELECT entry FROM b))
  SELECT part, entry, count(*) AS n FROM parts GROUP BY 1, 2""")

# --- context and severity ------------------------------------------------------------------------

CTX = EV + f""",
al AS (SELECT * FROM ev WHERE event_type = 'error'),
sp AS (SELECT *, {DNS_NAME} AS query_name, {REQ_PATH} AS req_path FROM ev WHERE event_type <> 'error')"""
add("dns_context", f"""WITH {CTX} SELECT al.event_id, sp.event_id AS span_id, sp.query_name FROM al
  JOIN sp ON abs(al.ns - sp.ns) < 15000000000 AND sp.k % 2 <> 0""")
add("http_context", f"""WITH {CTX} SELECT al.event_id, sp.event_id AS span_id, al.pod AS source,
  sp.req_path FROM al JOIN sp ON al.pod = sp.pod AND abs(al.ns - sp.ns) < 3600000000000""")
add("context_arrays", f"""WITH {CTX}, p AS (SELECT al.event_id, sp.ns,
    '{{"queries":[{{"name":"' || sp.query_name || '","type":"A"}}]}}' AS body, sp.k
    FROM al JOIN sp ON abs(al.ns - sp.ns) < 300000000000 AND sp.k % 2 <> 0),
  n AS (SELECT *, CAST((row_number() OVER (PARTITION BY event_id ORDER BY ns, k) - 1) // 4 AS INTEGER) AS page
    FROM p),
  g AS (SELECT event_id, page, string_agg(ns || ' ' || body, '|' ORDER BY ns, k) AS dns_logs FROM n GROUP BY 1, 2)
  SELECT al.event_id, coalesce(page, 0) AS page, coalesce(dns_logs, '') AS dns_logs
  FROM al LEFT JOIN g USING (event_id)""")
add("context_counts", f"""WITH {CTX} SELECT al.event_id, count(sp.event_id) AS http_count,
  min(sp.ns) AS http_first, max(sp.ns) AS http_last FROM al LEFT JOIN sp
  ON al.pod = sp.pod AND abs(al.ns - sp.ns) < 3600000000000 GROUP BY 1""")
SCORED = CTX + """,
fl AS (SELECT *, k % 4 = 0 AS f1,
    user_id % 2 = 0 AND user_id % 3 = 0 AND NOT coalesce(CASE WHEN k % 5 <> 0 THEN k % 2 = 0 END, true) AS f2,
    user_id % 2 = 0 AND user_id % 3 = 0 AND coalesce(CASE WHEN k % 5 <> 0 THEN k % 2 = 0 END, true) AS f3,
    k < 40 AS f4,
    EXISTS (SELECT 1 FROM sp WHERE sp.k = 9 AND abs(sp.ns - al.ns) < 1800000000000) AS f5,
    EXISTS (SELECT 1 FROM sp WHERE sp.pod = al.pod AND sp.k < 30 AND sp.k % 3 = 0
      AND abs(sp.ns - al.ns) < 86400000000000) AS f6 FROM al),
sc AS (SELECT *, CAST(CASE WHEN f1 THEN 3.0 ELSE 0 END + CASE WHEN f2 THEN 2.0 ELSE 0 END
    + CASE WHEN f3 THEN 1.0 ELSE 0 END + CASE WHEN f4 THEN 1.3 ELSE 0 END
    + CASE WHEN f5 THEN 1.5 ELSE 0 END + CASE WHEN f6 THEN 1.0 ELSE 0 END AS DECIMAL(4, 1)) AS s
  FROM fl),
bd AS (SELECT *, CASE WHEN s <= 2 THEN 'Low' WHEN s <= 5 THEN 'Medium' WHEN s <= 7 THEN 'High'
    ELSE 'Critical' END AS severity FROM sc)"""
REASON_LIST = ", ".join(
    f"CASE WHEN {f} THEN '" + REASONS[k].replace("'", "''") + "' END"
    for f, k in zip(("f1", "f2", "f3", "f4", "f5", "f6"), REASONS))
add("severity_score", f"""WITH {SCORED} SELECT event_id, CAST(s AS VARCHAR) AS score, severity,
  CAST(f1::INT + f2::INT + f3::INT + f4::INT + f5::INT + f6::INT AS INTEGER) AS n_reasons,
  coalesce(array_to_string(list_sort([{REASON_LIST}]), '|'), '') AS reasons
  FROM bd""")
add("severity_bands", f"WITH {SCORED} SELECT severity, count(*) AS n FROM bd GROUP BY 1")
add("scored_bundle", f"""WITH {EV}, al AS (SELECT *, epoch_us(date_trunc('second', ts)) * 1000 AS at FROM ev
    WHERE event_type = 'error'),
  fl AS (SELECT *, user_id % 6 = 0 AND k % 2 <> 0 AS f2, user_id % 6 = 0 AND k % 2 = 0 AS f3,
    EXISTS (SELECT 1 FROM ev s WHERE s.k = 9 AND abs(s.ns - al.at) < 15000000000) AS f5,
    EXISTS (SELECT 1 FROM ev s WHERE s.user_id = al.user_id AND s.k < 30 AND s.k % 6 = 0
      AND abs(s.ns - al.at) < 15000000000) AS f6 FROM al),
  sc AS (SELECT *, CAST(CASE WHEN f2 THEN 2.0 ELSE 0 END + CASE WHEN f3 THEN 1.0 ELSE 0 END
    + CASE WHEN f5 THEN 1.5 ELSE 0 END + CASE WHEN f6 THEN 1.0 ELSE 0 END AS DECIMAL(4, 1)) AS s FROM fl)
  SELECT pod, event_id AS pid, sec_text AS "timestamp", CASE WHEN s <= 2 THEN 'Low' WHEN s <= 5 THEN 'Medium'
      WHEN s <= 7 THEN 'High' ELSE 'Critical' END AS severity,
    coalesce(array_to_string(list_sort([{", ".join(f"CASE WHEN {f} THEN '" + REASONS[k].replace("'", "''") + "' END"
      for f, k in (("f2", "root_outside"), ("f3", "root"), ("f5", "dns"), ("f6", "http")))}]), '|'), '') AS reasons,
    CAST(s AS VARCHAR) AS score FROM sc""")
VK = corr_v1("time_text", "container", "event_id", "node")
VT = corr_v1("ms_text", "container", "event_id", "node")
BOTH = EV + f""",
n AS (SELECT 'kernel' AS source, event_id AS pid, {proc(VK)} AS process_id FROM ev WHERE k % 3 <> 0
  UNION ALL SELECT 'trace', event_id, {proc(VT)} FROM (SELECT *, {MS} AS ms_text FROM ev)
    WHERE k % 2 = 0 OR k % 3 = 0)"""
add("cross_source", f"""WITH {BOTH}, c AS (SELECT process_id,
    count(*) FILTER (WHERE source = 'kernel') AS n_kernel,
    count(*) FILTER (WHERE source = 'trace') AS n_trace FROM n GROUP BY 1)
  SELECT n_kernel, n_trace, count(*) AS ids FROM c GROUP BY 1, 2""")
add("seen_by_both", f"""WITH {BOTH} SELECT source, process_id, pid FROM n WHERE process_id IN (
  SELECT process_id FROM n GROUP BY 1 HAVING count(DISTINCT source) = 2)""")

# --- sorting ----------------------------------------------------------------------------------------

ev("newest_n", """SELECT event_id, pod, ns FROM ev WHERE event_type = 'error'
  ORDER BY ts DESC, event_id DESC LIMIT 100""")
add("oldest_after_mark", """SELECT o_orderkey, o_custkey FROM orders
  WHERE o_orderdate > TIMESTAMP '1998-06-01' OR (o_orderdate = TIMESTAMP '1998-06-01'
    AND o_orderkey > 100) ORDER BY o_orderdate, o_orderkey LIMIT 10""")
ev("high_water_mark", "SELECT namespace, max(ns) AS last_seen_ns FROM ev GROUP BY 1")
ev("script_outputs", f"""SELECT 'status' AS output, CAST(200 + k % 5 AS VARCHAR) AS name, count(*) AS n
    FROM ev GROUP BY 2
  UNION ALL SELECT 'paths', {REQ_PATH}, count(*) FROM ev GROUP BY 2""")

# --- sequences ----------------------------------------------------------------------------------------

ev("followed_by", """, a AS (SELECT user_id, min(ns) AS first_ns FROM ev
    WHERE event_type = 'error' AND k > 90 GROUP BY 1)
  SELECT event_id, ev.user_id, first_ns FROM ev JOIN a USING (user_id)
  WHERE event_type = 'purchase' AND first_ns < ns""")
WITHIN = """SELECT event_id, user_id FROM ev b WHERE event_type = 'purchase' AND EXISTS (
  SELECT 1 FROM ev a WHERE a.user_id = b.user_id AND a.event_type = 'error' AND a.ns < b.ns
    AND b.ns - a.ns <= 7200000000000)"""
ev("followed_within", WITHIN)
ev("repeats", """, r AS (SELECT DISTINCT user_id, ns, CAST(count(*) OVER (PARTITION BY user_id
    ORDER BY ns RANGE BETWEEN 86400000000000 PRECEDING AND CURRENT ROW) AS BIGINT) AS repeats FROM ev
    WHERE event_type = 'error')
  SELECT user_id, ns, repeats FROM r WHERE repeats >= 2""")
ev("start_stop", """SELECT event_type, count(*) AS n FROM ev
  WHERE ns >= 1704672000000000000 AND ns < 1705276800000000000 GROUP BY 1""")
ev("observation_and", """SELECT user_id, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS window_start
  FROM ev GROUP BY 1, 2 HAVING bool_or(event_type = 'error') AND bool_or(event_type = 'purchase')""")
ev("observation_or", """SELECT user_id, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS window_start,
    bool_or(event_type = 'error') AS has_a, bool_or(event_type = 'purchase') AS has_b
  FROM ev WHERE k < 5 AND event_type IN ('error', 'purchase') GROUP BY 1, 2""")
add("dialogue_followed_by", """SELECT conv_id, turn FROM conversations b WHERE role = 'assistant'
  AND EXISTS (SELECT 1 FROM conversations a WHERE a.conv_id = b.conv_id AND a.role = 'system'
    AND a.turn < b.turn)""")


SEQUENCES = """SELECT DISTINCT 'setns-then-mount' AS rule, pod, ns AS event_ts_ns FROM ker b
    WHERE event_type = 'purchase' AND EXISTS (SELECT 1 FROM ker a WHERE a.pod = b.pod
      AND a.event_type = 'error' AND a.ns < b.ns AND b.ns - a.ns <= 7200000000000)
  UNION ALL SELECT 'setns-repeats', pod, ns FROM (SELECT DISTINCT pod, ns, count(*) OVER (PARTITION BY pod
      ORDER BY ns RANGE BETWEEN 86400000000000 PRECEDING AND CURRENT ROW) AS n FROM ker
      WHERE event_type = 'error') WHERE n >= 2
  UNION ALL SELECT DISTINCT 'setns-and-mount', a.pod, greatest(a.ns, b.ns) FROM ker a JOIN ker b USING (pod)
    WHERE a.event_type = 'error' AND b.event_type = 'purchase' AND abs(a.ns - b.ns) <= 3600000000000"""
ker("rule_sequences", SEQUENCES)
ker("stream_rules", SEQUENCES)


# Every stretch (pod, a, z) from first to last log of every combination, by inequality joins.
HOT = ", hot AS (SELECT DISTINCT CASE WHEN pid % 10 < 9 THEN 'pod-hot' ELSE pod END AS pod, ns, event_type FROM ker)"


def _seen(kind: str) -> str:
    return f"SELECT pod, ns AS a, ns AS z FROM hot WHERE event_type = '{kind}'"


def _then(one: str, two: str, seconds: int | None) -> str:
    """Of the ones that end before a two only the latest start is kept, or there would be too many."""
    most = "" if seconds is None else f"AND r.z - l.a <= {seconds}000000000"
    return f"SELECT r.pod, max(l.a) AS a, r.z FROM ({one}) l JOIN ({two}) r ON l.pod = r.pod AND l.z < r.a {most} GROUP BY r.pod, r.a, r.z"


def _both(one: str, two: str, seconds: int) -> str:
    return f"""SELECT l.pod, least(l.a, r.a) AS a, greatest(l.z, r.z) AS z FROM ({one}) l JOIN ({two}) r ON l.pod = r.pod
      AND greatest(l.z, r.z) - least(l.a, r.a) <= {seconds}000000000"""


def _ends(rule: str, stretches: str) -> str:
    return f"SELECT '{rule}' AS rule, pod, z AS event_ts_ns, max(a) AS first_ns FROM ({stretches}) GROUP BY pod, z"


def _steps(kinds: list[str], seconds: int | None) -> str:
    out = _seen(kinds[0])
    for kind in kinds[1:]:
        out = _then(out, _seen(kind), seconds)
    return out


ker("rule_chain", " UNION ALL ".join([
    _ends("three", _steps(["error", "purchase", "click"], 3600)),
    _ends("four", _steps(["error", "purchase", "click", "view"], 5400)),
    _ends("unbounded", _steps(["error", "purchase", "click", "signup"], None))]), HOT)
ker("rule_tree", " UNION ALL ".join([
    _ends("bracket", _then(_both(_seen("error"), _seen("purchase"), 3600), _seen("click"), 7200)),
    _ends("period", """SELECT pod, a, z FROM (SELECT pod, ns AS z, lag(ns, 2) OVER (PARTITION BY pod ORDER BY ns) AS a
      FROM (SELECT CASE WHEN pid % 10 < 9 THEN 'pod-hot' ELSE pod END AS pod, ns FROM ker WHERE event_type = 'error'))
      WHERE z - a <= 86400000000000 AND a >= 1704672000000000000 AND z < 1705276800000000000"""),
    _ends("either", _then(_seen("error"), _seen("click") + " UNION ALL " + _both(_seen("view"), _seen("signup"), 1800), 3600)),
]), HOT)
ev("observations_together", """, e AS (SELECT user_id, ns, event_type FROM ev), p AS (
    SELECT a.user_id, greatest(a.ns, b.ns) AS z, least(a.ns, b.ns) AS y FROM e a JOIN e b USING (user_id)
    WHERE a.event_type = 'error' AND b.event_type = 'purchase' AND abs(a.ns - b.ns) <= 21600000000000)
  SELECT user_id, greatest(z, ns) AS ns, max(least(y, ns)) AS first_ns FROM p JOIN e USING (user_id)
  WHERE event_type = 'click' AND greatest(z, ns) - least(y, ns) <= 21600000000000 GROUP BY 1, 2""")
ker("rule_literals", """SELECT key, count(*) AS n FROM (
    SELECT 'hex' AS key FROM ker UNION ALL SELECT 'binary' FROM ker WHERE namespace = 'webapp'
    UNION ALL SELECT 'timestamp' FROM ker WHERE ts < TIMESTAMP '2024-01-10') GROUP BY 1""")
ker("rule_blocks", """SELECT pid, key FROM ker JOIN (VALUES ('inside'), ('outside'), ('one'), ('holds')) t(key)
  ON fn = 'tcp_connect' AND CASE key WHEN 'inside' THEN k % 32 < 16 WHEN 'outside' THEN k % 32 >= 16
    WHEN 'one' THEN k % 32 = 7 ELSE k % 32 = 3 END""")
ker("rule_store", f"""SELECT key, count(*) AS n, CAST(CASE WHEN key = 'nsenter' THEN 1 ELSE 0 END AS BIGINT)
    AS refs FROM ({hits({k: v for k, v in INTENDED.items() if k != 'tree'}, 'pid')}) GROUP BY 1""")
ev("span_files", """SELECT 'dns' AS kind, ns AS time_, event_id AS pid FROM ev
    WHERE ns > 1704672000000000000 AND namespace = 'webapp'
  UNION ALL SELECT 'http', ns, event_id FROM ev WHERE ns >= 1704672000000000000 AND pod = 'pod-1'""")
add("profile_files", """SELECT CASE page_id % 5 WHEN 0 THEN 'exec' WHEN 1 THEN 'open' WHEN 2 THEN 'syscall'
    WHEN 3 THEN 'capability' ELSE 'endpoint' END AS part, page_id % 2 = 0 AS is_wildcard, count(*) AS n
  FROM pages GROUP BY 1, 2""")
ev("tail_retention", """SELECT event_id AS pid, node AS node_name FROM ev
  WHERE ts > (SELECT max(ts) FROM ev) - INTERVAL 96 HOURS""")
ev("kernel_descendants", "SELECT event_id FROM ev WHERE user_id IN (1, 6) OR event_id = 3")
ev("preview_rows", """SELECT least(count(*), 7) AS n, 'time_,pod_name' AS columns, least(count(*), 7) AS own FROM ev""")

# --- files, tables, stores ------------------------------------------------------------------------------

ker("file_kernel_wide", f"""SELECT pid, corr_id, {K0} AS k0, {K1} AS k1, dedup_key FROM ker""")
ker("file_kernel_long", "SELECT pid, corr_id, coalesce(fn, '') AS function_name FROM ker")
add("file_alerts", f"WITH {AL} SELECT corr_id, cmd AS command_line, dedup_key FROM al")
add("file_traces", f"WITH {TR} SELECT event_id AS pid, corr_id, dedup_key FROM trace")
add("file_rule_alerts", f"WITH {RA} SELECT ns AS event_ts_ns, corr_id, dedup_key FROM ra")
ev("bulk_load", """SELECT '2025-01-01T00:00:00Z' AS "time", 'R' || (k % 10) AS "RuleID",
  'error' AS level, count(*) AS n, min(pod) AS first_pod FROM ev GROUP BY 2""")
ker("bundle_files", """SELECT type, CAST(pos AS INTEGER) AS pos, count(*) AS n FROM (
    SELECT 'process' AS type, 0 AS pos FROM kb UNION ALL SELECT 'observed-data', 1 FROM kb
    UNION ALL SELECT 'relationship', 2 + unnest(range(n_matches)) FROM kb
    UNION ALL SELECT 'attack-pattern', 2 + n_matches + 3 * unnest(range(n_matches)) FROM kb
    UNION ALL SELECT 'indicator', 3 + n_matches + 3 * unnest(range(n_matches)) FROM kb
    UNION ALL SELECT 'relationship', 4 + n_matches + 3 * unnest(range(n_matches)) FROM kb)
  GROUP BY 1, 2""", MATCHED)
ker("kernel_table_form", "SELECT pid, corr_id, dedup_key FROM ker")
ker("appended_objects", """SELECT pid, CAST(3 + 4 * n_matches AS INTEGER) AS n_objects,
  'note--' || pid AS note FROM kb""", MATCHED)
ev("json_without_nulls", """SELECT event_id, '{"event_id":' || event_id || CASE WHEN event_type <> 'error'
  THEN ',"kind":"' || event_type || '"' ELSE '' END || ',"pod":"' || pod || '"}' AS "row" FROM ev""")
ev("span_pod_columns", "SELECT ns AS time_, pod AS pod_name, namespace FROM ev")
ker("json_lines_sink", """SELECT pid, CASE WHEN event_type = 'signup' THEN 'command_line,pid'
  ELSE 'alert_name,command_line,pid,rule_id' END AS keys FROM ker""")
ev("table_api", """SELECT ns AS time_, pod AS pod_name, event_id AS pid FROM ev
  WHERE namespace = 'webapp' ORDER BY ns DESC LIMIT 50""")
ker("queue_to_merged", """, s AS (SELECT *, last_rule || ':' || dedup_key AS store_key FROM kb
    QUALIFY row_number() OVER (PARTITION BY store_key ORDER BY ns DESC, bundle_id DESC) = 1),
  m AS (SELECT last_rule, f.key FROM s JOIN f USING (pid))
  SELECT last_rule AS group_key, 'process' AS type, count(*) AS n FROM s GROUP BY 1
  UNION ALL SELECT last_rule, 'observed-data', count(*) FROM s GROUP BY 1
  UNION ALL SELECT last_rule, 'relationship', count(*) + count(DISTINCT key) FROM m GROUP BY 1
  UNION ALL SELECT last_rule, 'attack-pattern', count(DISTINCT key) FROM m GROUP BY 1
  UNION ALL SELECT last_rule, 'indicator', count(DISTINCT key) FROM m GROUP BY 1""",
    MATCHED + f", f AS ({hits(FLAT, 'pid')})")

# --- streams ----------------------------------------------------------------------------------------------

ker("stream_dedupe", """SELECT DISTINCT dedup_key, CAST(floor(epoch(ts) / 600) * 600 AS BIGINT) AS period
  FROM ker""")
ker("stream_match", f"""SELECT rule_id AS pattern_id, count(*) AS n FROM ({hits(FLAT, 'pid')})
  JOIN rules USING (key) GROUP BY 1""", f", {RULE_ROWS}")
ev("stream_spans", """SELECT ns AS time_, event_id AS pid, 'raw' AS written FROM ev
  UNION ALL SELECT ns, event_id, 'objects' FROM ev""")
ev("stream_incremental", """SELECT pod AS pod_name, namespace, count(*) AS n, max(sec_text) AS last
  FROM ev GROUP BY 1, 2""")
ev("stream_rate", """SELECT event_type, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS hour,
  count(*) AS n FROM ev GROUP BY 1, 2""")
ORACLES["consolidate_increments"] = ORACLES["consolidate_by_rule"]
ORACLES["stream_profile"] = ORACLES["profile_deviation"]
ev("stream_equilibrium", """SELECT pod, ns // 1000 AS last_us FROM (SELECT pod, ns, lead(ns) OVER (PARTITION BY pod ORDER BY ns) AS next_ns,
    max(ns) OVER () AS newest FROM ev)
  WHERE coalesce(next_ns - ns >= 86400000000000, ns + 86400000000000 <= newest - 600000000000)""")
ORACLES["stream_late"] = ORACLES["stream_rate"]
ev("stream_cooldown", """SELECT namespace, CAST(epoch(time_bucket(INTERVAL 6 HOURS, ts,
    TIMESTAMP '1970-01-01')) AS BIGINT) AS period, count(*) AS n, least(count(*), 3) AS passed
  FROM ev WHERE event_type = 'error' GROUP BY 1, 2""")
ORACLES["stream_observation_and"] = ORACLES["observation_and"]
ev("stream_then_next_batch", """, o AS (SELECT ns AS time_, event_id AS pid, namespace,
    row_number() OVER (ORDER BY ns, event_id) AS n FROM ev),
  w AS (SELECT time_, pid FROM o WHERE namespace = 'webapp' ORDER BY time_ DESC LIMIT 10)
  SELECT CASE WHEN n <= 10 THEN 'first' ELSE 'second' END AS part, time_, pid FROM o WHERE n <= 20
  UNION ALL SELECT 'newest', time_, pid FROM w""")
ev("stream_context", """SELECT a.event_id AS alert_id, b.event_id AS span_id FROM ev a JOIN ev b
  ON a.event_type = 'error' AND b.event_type <> 'error' AND abs(a.ns - b.ns) < 15000000000""")
ev("stream_repeats", """, w AS (SELECT user_id, CAST(epoch(date_trunc('hour', ts)) AS BIGINT)
      - 3600 * d AS window_start FROM ev, (VALUES (0), (1)) t(d) WHERE event_type = 'error')
  SELECT user_id, window_start, count(*) AS repeats FROM w
  GROUP BY 1, 2 HAVING count(*) >= 2""")
ev("stream_followed_by", WITHIN)
