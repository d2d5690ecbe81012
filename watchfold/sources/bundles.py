"""Bundle files, rule catalogue files and allow-list profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


def read_bundles(spark: SparkSession, path) -> DataFrame:
    """JSON lines, one bundle each, bare or wrapped as ``{"stix_bundle": …}``.

    Objects stay JSON text: their fields differ by type.
    """
    lines = spark.read.text(path)
    return bundles_from_text(lines, "value")


def bundles_from_text(df: DataFrame, column: str) -> DataFrame:
    wrapped = F.get_json_object(column, "$.stix_bundle")
    doc = F.from_json(F.coalesce(wrapped, F.col(column)), schemas.BUNDLE_LINE)
    return (
        df.select(doc.alias("b"))
        .where(F.col("b.type") == "bundle")
        .select("b.type", "b.id", "b.spec_version", "b.objects")
    )


def wrap_bundle(df: DataFrame) -> DataFrame:
    """One ``{"stix_bundle": …}`` text line per bundle row."""
    return df.select(F.concat(
        F.lit('{"stix_bundle":'), bundle_json(), F.lit("}")
    ).alias("value"))


def bundle_json():
    """Text of a bundle row (type, id, spec_version, objects as JSON texts)."""
    return F.concat(
        F.lit('{"type":"bundle","id":"'), F.col("id"),
        F.lit('","spec_version":"2.1","objects":['), F.array_join("objects", ","), F.lit("]}"),
    )


def explode_objects(bundles: DataFrame) -> DataFrame:
    """One row per object: bundle id, position, type, id, JSON text."""
    return bundles.select(
        F.col("id").alias("bundle_id"), F.posexplode("objects").alias("pos", "object")
    ).select(
        "bundle_id", "pos",
        F.get_json_object("object", "$.type").alias("type"),
        F.get_json_object("object", "$.id").alias("object_id"),
        "object",
    )


def read_profiles(spark: SparkSession, path) -> DataFrame:
    """Profiles as tall rows: one allowed behaviour each (see ``PROFILE``)."""
    df = spark.read.schema(schemas.PROFILE).json(path)
    return with_wildcards(df)


def with_wildcards(df: DataFrame) -> DataFrame:
    return df.withColumn("is_wildcard", F.col("entry").contains(WILDCARD))


# Fixed value: stands for exactly one path segment in a profile entry.
WILDCARD = "\u22ef"
PROFILE_KINDS = ["exec", "open", "syscall", "capability", "endpoint"]


def split_profile(df: DataFrame) -> dict[str, DataFrame]:
    """Five frames, one per kind of behaviour."""
    return {kind: df.where(F.col("kind") == kind) for kind in PROFILE_KINDS}


def profile_from_documents(docs: DataFrame) -> DataFrame:
    """Nested profile documents to tall rows.

    ``docs`` has workload_kind, workload, namespace and ``containers``: an array
    of (name, capabilities, endpoints, execs, opens, syscalls).
    """
    one = docs.select("workload_kind", "workload", "namespace", F.explode("containers").alias("c"))

    def entries(kind, array, entry, detail):
        return F.transform(array, lambda x: F.struct(
            F.lit(kind).alias("kind"), entry(x).alias("entry"), detail(x).alias("detail")))

    none = lambda x: F.lit(None).cast("string")
    empty = F.array().cast("array<struct<kind:string,entry:string,detail:string>>")
    behaviours = F.concat(*[
        F.coalesce(part, empty) for part in (
            entries("capability", F.col("c.capabilities"), lambda x: x, none),
            entries("endpoint", F.col("c.endpoints"), lambda x: x["endpoint"],
                    lambda x: F.concat_ws(" ", x["direction"], F.array_join(x["methods"], ","))),
            entries("exec", F.col("c.execs"), lambda x: x["path"],
                    lambda x: F.array_join(x["args"], " ")),
            entries("open", F.col("c.opens"), lambda x: x["path"],
                    lambda x: F.array_join(x["flags"], ",")),
            entries("syscall", F.col("c.syscalls"), lambda x: x, none),
        )
    ])
    tall = one.select(
        "workload_kind", "workload", "namespace", F.col("c.name").alias("container"),
        F.explode(behaviours).alias("b"),
    ).select("workload_kind", "workload", "namespace", "container", "b.kind", "b.entry", "b.detail")
    return with_wildcards(tall)
