"""HTTP and DNS span tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators.skew import salted_join
from . import sinks

LOOK_BACK_NS = 20 * 60 * 1_000_000_000


def read_http_spans(spark: SparkSession, path, **bounds) -> DataFrame:
    df = spark.read.schema(schemas.HTTP_SPAN).parquet(path)
    return select_spans(df, **bounds)


def read_dns_spans(spark: SparkSession, path, **bounds) -> DataFrame:
    df = spark.read.schema(schemas.DNS_SPAN).parquet(path)
    return select_spans(df, **bounds)


def select_spans(df: DataFrame, last_seen_ns: int | None = None, start_ns: int | None = None,
                 pod: str | None = None, namespace: str | None = None,
                 inclusive: bool = True, now_ns: int | None = None) -> DataFrame:
    """Time bound and equality filters, all of which reach the Parquet scan.

    The lower bound is the later of the high-water mark and the user's start.
    With neither it is twenty minutes before ``now_ns`` (callers that have no
    clock pass the newest time in the table).
    """
    bounds = [b for b in (last_seen_ns, start_ns) if b]
    if bounds:
        low = max(bounds)
    elif now_ns is not None:
        low = now_ns - LOOK_BACK_NS
    else:
        low = None
    if low is not None:
        df = df.where(F.col("time_") >= low if inclusive else F.col("time_") > low)
        if sinks.DATE in df.columns:
            df = df.where(F.col(sinks.DATE) >= sinks.date_of(low))
    if namespace:
        df = df.where(F.col("namespace") == namespace)
    if pod:
        df = df.where(F.col("pod_name") == pod)
    return df


def newest_ns(df: DataFrame, column: str = "time_") -> int | None:
    """High-water mark: one number, read from file statistics where possible."""
    return df.agg(F.max(column)).first()[0]


def with_process(df: DataFrame, proc_dim: DataFrame) -> DataFrame:
    """upid -> container id, pid and node. Unknown upids keep nulls, except the
    pid, which the upid itself spells (ASID in the first four bytes, pid in the
    next four)."""
    bare = df.drop("container_id", "pid", "node_name")
    joined = salted_join(bare, proc_dim, ["upid"], "left", ["time_", "latency"])
    return joined.withColumn("pid", F.coalesce("pid", upid_pid(F.col("upid"))))


def upid_pid(upid: Column) -> Column:
    hexa = F.substring(F.regexp_replace(upid, "-", ""), 9, 8)
    return F.conv(hexa, 16, 10).try_cast("bigint")


def with_pod_columns(df: DataFrame, context_pod: str = "context_pod") -> DataFrame:
    """``namespace/pod`` context text to separate columns."""
    parts = F.split(context_pod, "/")
    return df.withColumns({
        "pod_name": F.get(parts, F.lit(1)), "namespace": F.get(parts, F.lit(0)),
    }).drop(context_pod)
