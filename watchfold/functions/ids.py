"""Correlation and object identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN_HOST = "UnknownHost"


def short_md5(c: Column, length: int = 12) -> Column:
    return F.substring(F.md5(c), 1, length)


def zero_fill(c: Column, width: int) -> Column:
    """Left-fill with zeros after the sign; longer text is left alone."""
    sign = F.when(c.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    digits = F.when(c.startswith("-"), F.substring(c, 2, 1 << 20)).otherwise(c)
    filled = F.concat(sign, F.lpad(digits, F.lit(width) - F.length(sign), F.lit("0")))
    return F.when(F.length(c) >= width, c).otherwise(filled)


def _stamp(time_text: Column) -> Column:
    return F.regexp_replace(F.substring(time_text, 3, 20), "[-:.]", "")


def _pid(pid: Column) -> Column:
    return zero_fill(F.coalesce(pid.cast("string"), F.lit("None")), 8)


def kernel_container(container_id: Column) -> Column:
    """Twelve hex digits of a ``containerd://`` id, else the word ``unknown``."""
    hexa = F.regexp_extract(container_id, "^containerd://([0-9a-f]+)", 1)
    return F.when(F.coalesce(hexa, F.lit("")) == "", F.lit("unknown")).otherwise(
        F.substring(hexa, 1, 12)
    )


def corr_id(container_id: Column, pid: Column, host: Column, time_text: Column,
            kernel: bool = False) -> Column:
    """time + container + pid + host, with the host hashed."""
    host12 = F.when(host == UNKNOWN_HOST, F.lpad(F.lit(UNKNOWN_HOST), 12, "0")).otherwise(
        short_md5(host)
    )
    con = kernel_container(container_id) if kernel else F.substring(container_id, 1, 12)
    return F.concat(_stamp(time_text), con, _pid(pid), host12)


def corr_id_v1(container_id: Column, pid: Column, host: Column, time_text: Column,
               kind: str = "other") -> Column:
    """Older form: the host's first 12 characters, not hashed.

    ``kind="kernel"`` takes the hex part (null when the id has another shape);
    ``kind="rule_alert"`` keeps the container id whole.
    """
    if kind == "kernel":
        hexa = F.regexp_extract(container_id, "^containerd://([0-9a-f]+)", 1)
        con = F.when(hexa != "", F.substring(hexa, 1, 12))
    elif kind == "rule_alert":
        con = container_id
    else:
        con = F.substring(container_id, 1, 12)
    host12 = zero_fill(F.substring(host, 1, 12), 12)
    return F.concat(_stamp(time_text), con, _pid(pid), host12)


def process_id(corr: Column) -> Column:
    return F.when(corr != "", F.concat(F.lit("process--"), F.substring(corr, 1, 36)))


def process_id_from_exec(exec_id: Column) -> Column:
    """Last 36 characters of the decoded execution id; null when undecodable."""
    text = F.try_validate_utf8(F.try_to_binary(exec_id, F.lit("base64")).cast("string"))
    return F.when(exec_id != "", F.concat(F.lit("process--"), F.right(text, F.lit(36))))


def object_id(kind: str | Column, *parts: Column) -> Column:
    """``type--uuid`` whose uuid is fixed by the parts, so retries agree."""
    kind_col = F.lit(kind) if isinstance(kind, str) else kind
    h = F.md5(F.concat_ws("|", kind_col, *[p.cast("string") for p in parts]))
    # The hash stands here once: inside a lambda Spark evaluates every copy of an expression.
    uuid = F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-")
    return F.concat(kind_col, F.lit("--"), uuid)
