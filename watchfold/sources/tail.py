"""File-tailing streams and path exclusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import times

# Application-log paths that are never shipped.
EXCLUDED_PATHS = [
    "**/kube-system_event-exporter-*/**",
    "**/kube-system_fluentbit-*/**",
    "**/kube-system_pdcsi-*/**",
    "**/kube-system_konnectivity-*/**",
    "**/kube-system_netd-*/**",
    "**/kube-system_anetd-*/**",
    "**/kubeshark_kubeshark-worker*/**",
    "**/kubeshark_kubeshark-hub-*/**",
    "**/gke-managed*/**",
    "**/cert-manager_cert-manager*/**",
    "**/storm*/**",
    "**/honey*/**",
    "**/*Error getting SSL certificate*",
    "**/kube-system_image-package-extractor*/**",
]
RETENTION_HOURS = 4


def glob_regex(glob: str) -> str:
    """``**`` crosses folders, ``*`` stays inside one, the rest is literal."""
    out = ""
    i = 0
    while i < len(glob):
        if glob.startswith("**", i):
            out += ".*"
            i += 2
        elif glob[i] == "*":
            out += "[^/]*"
            i += 1
        else:
            out += ("\\" if glob[i] in r".^$+?{}[]()|\\"[:-1] else "") + glob[i]
            i += 1
    return out


def excluded_path(path_col, globs: list[str] = EXCLUDED_PATHS):
    """One anchored alternation over all globs."""
    return path_col.rlike("^(" + "|".join(glob_regex(g) for g in globs) + ")$")


def drop_excluded(df: DataFrame, globs: list[str] = EXCLUDED_PATHS) -> DataFrame:
    return df.where(~excluded_path(F.col("_metadata.file_path"), globs))


def tail_files(spark: SparkSession, glob: str, schema: T.StructType, time_column: str = "time",
               retention_hours: float | None = RETENTION_HOURS,
               files_per_trigger: int | None = None) -> DataFrame:
    """Stream of JSON-line files with an explicit schema and a retention.

    ``event_ts`` is added and watermarked by the retention, so state held
    downstream is dropped once it is older; rows already outside when read are
    judged by ``within_retention`` against the newest row of their batch.
    """
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    stream = reader.json(glob)
    if "payload" in schema.names:
        payload = schema["payload"].dataType
        if isinstance(payload, T.StructType) and "init" in payload.names:
            stream = stream.where(~F.coalesce(F.col("payload.init"), F.lit(False)))
        else:
            stream = stream.where(
                ~F.coalesce(F.get_json_object("payload", "$.init") == "true", F.lit(False)))
    ns = times.iso_to_ns(F.col(time_column))
    stream = stream.withColumn("event_ts", times.ns_to_ts(ns))
    if retention_hours is not None:
        stream = stream.withWatermark("event_ts", f"{int(retention_hours * 3600)} seconds")
    return stream


def within_retention(df: DataFrame, ts: str = "event_ts",
                     retention_hours: float = RETENTION_HOURS) -> DataFrame:
    """Rows no older than the retention before the newest row (batch form).

    The newest time is one number; it is read first so the filter is a constant
    the scan can use.
    """
    newest = df.agg(F.max(ts)).first()[0]
    if newest is None:
        return df
    bound = F.lit(newest) - F.expr(f"INTERVAL '{int(retention_hours * 3600)}' SECOND")
    return df.where(F.col(ts) > bound)
