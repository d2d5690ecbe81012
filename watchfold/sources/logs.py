"""Readers for the five sensor logs.

Each reader takes a path and gives typed rows. Files are one JSON document per
line. Schemas are explicit: nothing is inferred, so the same reader works on a
stream and reads only the columns a query asks for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..operators.barrier import once

CORRUPT = "_corrupt_record"


def _json_lines(spark: SparkSession, path, schema: T.StructType) -> DataFrame:
    """Typed JSON lines; lines that are not JSON objects are dropped."""
    return parse_or_drop(spark.read.text(path), "value", schema)


def parse_or_drop(df: DataFrame, text: str, schema: T.StructType,
                  observe: str | None = None) -> DataFrame:
    """Parse JSON text in column ``text``; rows that are no JSON object are dropped.

    A document with a field of an unexpected type is kept, with that field null:
    the parser flags it too, so flagged rows are looked at once more.

    With ``observe`` the dropped rows are counted on the way as the metric
    ``dropped`` of an observation of that name: no second pass.
    """
    with_corrupt = T.StructType(schema.fields + [T.StructField(CORRUPT, T.StringType())])
    keep = [c for c in df.columns if c != text]
    parsed = once(
        df, "_doc", F.from_json(text, with_corrupt, {"columnNameOfCorruptRecord": CORRUPT}), keep)
    flagged = F.col(f"_doc.{CORRUPT}")
    broken = ~F.ltrim(flagged).startswith("{") | F.try_parse_json(flagged).isNull()
    bad = F.col("_doc").isNull() | (flagged.isNotNull() & broken)
    if observe:
        parsed = parsed.observe(observe, F.count_if(bad).alias("dropped"),
                                F.count(F.lit(1)).alias("seen"))
    return parsed.where(~bad).select(*keep, *[f"_doc.{f.name}" for f in schema.fields])


def read_kernel_wide(spark: SparkSession, path) -> DataFrame:
    """Kernel-process log as the sensor writes it: one of exec/exit/kprobe set."""
    df = _json_lines(spark, path, schemas.KERNEL_WIDE)
    return promote_args(df)


def promote_args(df: DataFrame) -> DataFrame:
    """Fill kprobe0..4 from the kprobe's arguments where the shipper did not."""
    args = F.col("process_kprobe.args")
    return df.withColumns({
        f"kprobe{i}": F.coalesce(
            F.col(f"kprobe{i}"), F.to_json(F.get(args, F.lit(i))), F.lit("null"))
        for i in range(5)
    })


def wide_to_long(df: DataFrame) -> DataFrame:
    """exec/exit/kprobe columns collapsed to ``type`` and ``payload``.

    A row with none of the three keeps the type ``"1"`` and a null payload
    (text form: ``"empty"``).
    """
    kind = (
        F.when(F.col("process_exec").isNotNull(), "process_exec")
        .when(F.col("process_exit").isNotNull(), "process_exit")
        .when(F.col("process_kprobe").isNotNull(), "process_kprobe")
        .otherwise("1")
    )
    payload = F.coalesce("process_exec", "process_exit", "process_kprobe")
    promoted = [c for c in df.columns if c.startswith("kprobe")]
    return df.select("time", "node_name", kind.alias("type"), payload.alias("payload"), *promoted)


def payload_text(payload: Column) -> Column:
    return F.coalesce(F.to_json(payload), F.lit("empty"))


def read_kernel_long(spark: SparkSession, path) -> DataFrame:
    """Kernel-process log with ``type`` and ``payload``; the init row is dropped."""
    return drop_init(_json_lines(spark, path, schemas.KERNEL_LONG))


def kernel_long_from_text(df: DataFrame) -> DataFrame:
    """Table form, where the payload is JSON text."""
    keep = [c for c in df.columns if c != "payload"]
    return drop_init(once(df, "payload", F.from_json("payload", schemas.KERNEL_PAYLOAD), keep))


def drop_init(df: DataFrame) -> DataFrame:
    """Remove the schema-seeding record that file tails start with."""
    return df.where(~F.coalesce(F.col("payload.init"), F.lit(False)))


def read_alerts(spark: SparkSession, path) -> DataFrame:
    """Runtime alerts; absent and ``"empty"`` cloud metadata both become null."""
    return alerts_from_text(_json_lines(spark, path, schemas.ALERT_TEXT))


ALERT_NESTED = {
    "BaseRuntimeMetadata": schemas.ALERT_BASE,
    "CloudMetadata": schemas.ALERT_CLOUD,
    "RuntimeK8sDetails": schemas.ALERT_K8S,
    "RuntimeProcessDetails": schemas.ALERT_PROCESS,
    "event": schemas.ALERT_EVENT,
}


def alerts_from_text(df: DataFrame) -> DataFrame:
    """Alert table rows (five JSON text columns) to structs, one parse each."""
    parsed = F.struct(*[F.from_json(k, t).alias(k) for k, t in ALERT_NESTED.items()])
    rest = [k for k in schemas.ALERT_ROOT_KEYS if k not in ALERT_NESTED]
    return once(df, "_doc", parsed, rest).select(*[
        F.col(f"_doc.{k}") if k in ALERT_NESTED else F.col(k) for k in schemas.ALERT_ROOT_KEYS
    ])


def alerts_present(df: DataFrame) -> DataFrame:
    """Only lines that are alerts at all."""
    return df.where(F.col("BaseRuntimeMetadata").isNotNull())


def read_syscall_trace(spark: SparkSession, path) -> DataFrame:
    return _json_lines(spark, path, schemas.TRACE)


def read_rule_alerts(spark: SparkSession, path) -> DataFrame:
    """Rule-engine alerts: shipper lines whose ``message`` holds the alert JSON."""
    shell = T.StructType([
        T.StructField("timestamp", T.StringType()), T.StructField("message", T.StringType()),
    ])
    return rule_alerts_from_message(_json_lines(spark, path, shell))


def rule_alerts_from_message(df: DataFrame) -> DataFrame:
    doc = F.from_json("message", schemas.RULE_ALERT_MESSAGE)
    return (
        once(df, "_doc", doc, ["timestamp"])
        .where(F.col("_doc").isNotNull())
        .select(
            "timestamp", F.col("_doc.hostname").alias("hostname"), F.col("_doc.rule").alias("rule"),
            F.col("_doc.source").alias("source"), F.col("_doc.priority").alias("priority"),
            F.col("_doc.tags").alias("tags"), F.col("_doc.output_fields").alias("interesting"),
        )
    )


def load_alert_file(spark: SparkSession, path, fixed_time: str | None = None) -> DataFrame:
    """Bulk load: bad lines skipped, nested documents kept as JSON text, missing
    text fields ``""``, and optionally one time for all rows.

    Without ``fixed_time`` a line that has no time is a bad line.
    """
    df = _json_lines(spark, path, schemas.ALERT_TEXT)
    df = df.withColumn("time", F.lit(fixed_time)) if fixed_time else df.where("time IS NOT NULL")
    text = {c: F.coalesce(c, F.lit("")) for c in ("RuleID", "level", "message", "msg")}
    nested = {c: F.coalesce(c, F.lit("null")) for c in ALERT_NESTED}
    return df.withColumns({**text, **nested}).select(
        "time", "RuleID", "level", "message", "msg", *ALERT_NESTED
    )
