"""Read API and end-to-end pipelines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators import bundles, context, filters, normalize, rules as rule_ops
from ..operators.skew import wide_join
from ..sources import sinks
from ..sources.rules import CORE_RULES, Rule

# Filter keys a table accepts, and the row limit without one.
ALLOWED_FILTERS = {
    "http_events": ["pod_name", "node_name", "namespace", "container_id", "remote_addr"],
    "dns_events": ["pod_name", "node_name", "namespace", "container_id", "remote_addr"],
    "kernel_logs": ["node_name", "type"],
    "http_objects": [],
    "dns_objects": [],
    "kernel_objects": [],
    "alert_logs": ["event", "level", "msg"],
    "alert_objects": [],
}
DEFAULT_LIMIT = 100


def newest(df: DataFrame, order_by: str, limit: int = DEFAULT_LIMIT,
           filters_: dict[str, object] | None = None, allowed: list[str] | None = None,
           tie: list[str] | None = None) -> DataFrame:
    """Newest ``limit`` rows after equality filters. Spark runs this as a top-k
    per task and merges ``limit`` rows of each."""
    kept = filters.equality_filters(df, filters_ or {}, allowed or [])
    order = [F.col(order_by).desc(), *[F.col(t).desc() for t in tie or []]]
    return kept.orderBy(*order).limit(int(limit))


def query_table(spark: SparkSession, root: str, table: str,
                filters_: dict[str, object] | None = None,
                limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Newest rows of one of the eight readable result tables.

    Rows of a newer date come before all rows of an older one, so only as many
    of the newest date partitions are read as hold ``limit`` matching rows.
    """
    if table not in ALLOWED_FILTERS:
        raise KeyError(table)
    df = sinks.read_table(spark, root, table)
    kept = filters.equality_filters(df, filters_ or {}, ALLOWED_FILTERS[table])
    dates = sinks.table_dates(spark, root, table)
    n = 1
    while n < len(dates):
        recent = kept.where(F.col(sinks.DATE) >= dates[n - 1])
        if recent.select(F.lit(1)).limit(int(limit)).count() >= int(limit):
            kept = recent
            break
        n *= 4
    schema, time_column = schemas.RESULT_TABLES[table]
    # Rows of one time are cut by their other columns, so the answer is always the same.
    tie = [f.name for f in schema.fields if f.name != time_column and f.dataType.typeName() not in ("map", "variant")]
    return newest(kept.drop(sinks.DATE), time_column, limit, tie=tie)


def oldest_after(df: DataFrame, time_column: str, mark, limit: int,
                 tie: list[str]) -> DataFrame:
    """The next batch after a high-water mark, in a total order.

    ``mark`` is the (time, tie…) of the last row read, or just a time. With the
    full tuple rows that tie on the time are not lost at the cut.
    """
    keys = [time_column, *tie]
    values = list(mark) if isinstance(mark, (tuple, list)) else [mark]
    later = F.lit(False)
    for i, v in enumerate(values):
        same = filters.all_of([F.col(k) == F.lit(x) for k, x in zip(keys[:i], values[:i])])
        later = later | (same & (F.col(keys[i]) > F.lit(v)))
    return df.where(later).orderBy(*keys).limit(limit)


def preview(df: DataFrame, n: int = 10, columns: list[str] | None = None) -> DataFrame:
    return (df.select(*columns) if columns else df).limit(n)


def run_script(tables: dict[str, DataFrame],
               script: Callable[[dict[str, DataFrame]], dict[str, DataFrame]],
               root: str | None = None) -> dict[str, DataFrame]:
    """Several named outputs of one function over the tables. With ``root`` each
    output is written to a folder of its name and read back, so that all of them
    come from one run of the script."""
    outputs = script(tables)
    if root is None:
        return outputs
    for name, df in outputs.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}")
    return {name: df.sparkSession.read.schema(df.schema).parquet(f"{root}/{name}")
            for name, df in outputs.items()}


def transform(df: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    for step in steps:
        df = df.transform(step)
    return df


def kernel_bundles(kernel: DataFrame, rules: list[Rule] | None = None,
                   layout: str = "nested") -> tuple[DataFrame, DataFrame]:
    """(normalised rows, bundles of the rows that matched) of a kernel log."""
    rules = CORE_RULES if rules is None else rules
    norm = normalize.normalize_kernel(kernel)
    matched = rule_ops.match_rules(norm, rules, layout)
    return norm, bundles.assemble(matched, rules, flat=layout == "flat")


def alert_bundles(alerts: DataFrame, rules: list[Rule] | None = None,
                  layout: str = "flat") -> tuple[DataFrame, DataFrame]:
    """(normalised rows, bundles of the rows that matched) of raw alerts."""
    rules = CORE_RULES if rules is None else rules
    norm = normalize.normalize_alert(alerts)
    return norm, bundles.assemble(rule_ops.match_rules(norm, rules, layout), rules)


def convert_queue(lines: DataFrame, rules: list[Rule] | None = None, layout: str = "flat",
                  column: str = "value") -> DataFrame:
    """A mixed queue of raw lines to stored bundles: dispatch, normalise, match,
    keep the last match per ``rule:fingerprint`` key, and assemble only those."""
    rules = CORE_RULES if rules is None else rules
    norm = normalize.normalize_mixed(lines, column)
    keyed = rule_ops.match_rules(norm, rules, layout).withColumns({
        "store_key": bundles.store_key(rules), "bundle_id": bundles.bundle_id()})
    last = sinks.latest_per_key(keyed, ["store_key"], ["event_ts_ns", "bundle_id"])
    return bundles.assemble(last, rules, flat=True).withColumn("bundle", bundles.bundle_text())


def merge_by_rule(stored: DataFrame, **kw) -> DataFrame:
    """Stored bundles merged per rule id (the part of the key before ``:``)."""
    rule = F.get(F.split("store_key", ":"), F.lit(0))
    return bundles.consolidate_by_rule(
        stored.withColumn("rule_id", rule), ["event_ts_ns"], **kw)


def alerts_with_ns(alerts: DataFrame) -> DataFrame:
    """Process-launch alerts with their time in nanoseconds and the source name
    HTTP spans use (``namespace/pod``)."""
    from ..functions import times

    k8s = F.col("RuntimeK8sDetails")
    return filters.message_contains(alerts).withColumns({
        "time_ns": times.iso_to_ns(F.col("time")),
        "source": F.concat(k8s["podNamespace"], F.lit("/"), k8s["podName"]),
        "pod_name": k8s["podName"], "namespace": k8s["podNamespace"],
    })


def scored_bundle(alerts: DataFrame, kernel: DataFrame, dns: DataFrame, http: DataFrame,
                  pod_dim: DataFrame) -> DataFrame:
    """Alerts scored with their process and the traffic around them.

    Alerts carry no process fields the score needs, so the newest exec of the
    same container and process id is joined in.
    """
    proc = F.col("payload.process")
    execs = kernel.where(F.col("type") == "process_exec").select(
        F.regexp_replace(proc["pod"]["container"]["id"], "^containerd://", "").alias("_con"),
        proc["pid"].alias("_pid"), proc["exec_id"].alias("exec_id"), proc["uid"].alias("uid"),
        proc["auid"].alias("auid"), proc["in_init_tree"].alias("in_init_tree"),
        proc["arguments"].alias("arguments"), F.col("time").alias("_exec_time"))
    execs = sinks.latest_per_key(execs, ["_con", "_pid"], ["_exec_time", "exec_id"]).drop(
        "_exec_time")
    rows = alerts_with_ns(alerts).withColumns({
        "_con": F.col("RuntimeK8sDetails")["containerID"],
        "_pid": F.col("BaseRuntimeMetadata")["infectedPID"]})
    joined = wide_join(rows, execs, ["_con", "_pid"], "left").drop("_con", "_pid")
    endpoints = filters.http_endpoints(
        http.withColumn("pod", F.concat_ws("/", "namespace", "pod_name")), pod_dim)
    scored = context.scored_alerts(
        joined, dns, endpoints, {k: k for k in (
            "exec_id", "uid", "auid", "in_init_tree", "arguments")})
    return scored.select(
        F.col("pod_name").alias("pod"), F.col("BaseRuntimeMetadata")["infectedPID"].alias("pid"),
        F.coalesce("time", F.lit("N/A")).alias("timestamp"), "severity", "reasons", "score")


def next_batch(spark: SparkSession, root: str, table: str, mark=None, limit: int = 10,
               tie: list[str] | None = None) -> DataFrame:
    """The oldest ``limit`` rows after the mark; earlier dates are not read."""
    time_column = schemas.RESULT_TABLES[table][1]
    df = sinks.read_table(spark, root, table)
    if mark is None:
        mark = "1970-01-01T00:00:00Z" if dict(df.dtypes)[time_column] == "string" else 0
    first = mark[0] if isinstance(mark, (tuple, list)) else mark
    df = df.where(F.col(sinks.DATE) >= sinks.date_of(first)).drop(sinks.DATE)
    return oldest_after(df, time_column, mark, limit, tie or [])


__all__ = [
    "newest", "query_table", "oldest_after", "preview", "run_script", "transform",
    "kernel_bundles", "alert_bundles", "convert_queue", "merge_by_rule", "alerts_with_ns",
    "scored_bundle", "next_batch",
]
