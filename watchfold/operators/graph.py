"""Bundles as nodes and edges, and process ancestry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .skew import ROWS_PER_TASK, split_join


def nodes(objects: DataFrame) -> DataFrame:
    """Node rows of object rows (bundle_id, pos, type, object_id, object)."""
    return objects.select("bundle_id", F.col("object_id").alias("node_id"), "type")


def edges(objects: DataFrame) -> DataFrame:
    """References (``object_refs``) and relationships as edge rows, read from
    each object once."""
    doc = F.from_json(
        "object", "object_refs array<string>, source_ref string, target_ref string, "
                  "relationship_type string")
    parsed = objects.select("bundle_id", "object_id", doc.alias("d"))
    refs = F.coalesce(
        F.transform("d.object_refs", lambda r: F.struct(
            F.col("object_id").alias("src"), r.alias("dst"), F.lit("refers").alias("label"))),
        F.array().cast("array<struct<src:string,dst:string,label:string>>"))
    link = F.when(F.col("d.source_ref").isNotNull() & F.col("d.target_ref").isNotNull(), F.array(
        F.struct(F.col("d.source_ref").alias("src"), F.col("d.target_ref").alias("dst"),
                 F.col("d.relationship_type").alias("label")))).otherwise(
        F.array().cast("array<struct<src:string,dst:string,label:string>>"))
    return parsed.select("bundle_id", F.explode(F.concat(refs, link)).alias("e")).select(
        "bundle_id", "e.src", "e.dst", "e.label")


def lineage_of(kernel: DataFrame) -> DataFrame:
    """One row per process: id, parent, binary and pid of its newest log, from
    kernel long-form rows."""
    proc = F.col("payload.process")
    rows = kernel.select(
        proc["exec_id"].alias("id"), F.struct(
            F.col("time"), proc["parent_exec_id"].alias("parent_id"), proc["binary"].alias("binary"),
            proc["pid"].alias("pid")).alias("log"))
    newest = rows.where("id IS NOT NULL").groupBy("id").agg(F.max("log").alias("log"))
    return newest.select("id", "log.parent_id", "log.binary", "log.pid")


def ancestry(lineage: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """(id, ancestor_id, depth) for all ancestors of every process.

    Doubling: what is known up to depth d, joined with itself at depth exactly d,
    gives all up to 2 d, so the deepest process takes log2 of its depth joins.
    Each round is a written table, so plans stay short and a lost executor costs
    one round. A popular ancestor is a hot key on one side only, which is split.
    A process that is its own ancestor is an error.
    """
    known = cut_lineage(lineage.where("parent_id IS NOT NULL").select(
        "id", F.col("parent_id").alias("ancestor_id"), F.lit(1).alias("depth")))
    levels, reach = [known], 1
    while True:
        if not known.where("id = ancestor_id").isEmpty():
            raise ValueError("the lineage has a cycle")
        so_far = levels[0]
        for level in levels[1:]:
            so_far = so_far.unionByName(level)
        further = so_far.select(F.col("id").alias("_via"), F.col("ancestor_id").alias("_up"),
                                F.col("depth").alias("_depth"))
        edge = so_far.where(F.col("depth") == reach).select("id", F.col("ancestor_id").alias("_via"), "depth")
        known = cut_lineage(split_join(edge, further, ["_via"], "inner", ["id"], rows_per_task).select(
            "id", F.col("_up").alias("ancestor_id"), (F.col("depth") + F.col("_depth")).alias("depth")))
        if known.isEmpty():
            return so_far
        levels.append(known)
        reach *= 2


def descendants_of(lineage: DataFrame, is_root: Column,
                   rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Processes that satisfy ``is_root`` or have an ancestor that does.

    Pointer doubling: after round k every process knows about its nearest 2^k
    ancestors, so depth d takes log2(d) joins. Settled rows (a hit, or no
    further ancestor) are not joined again; the one ancestor that most open rows
    soon point to is a hot key, which is split. Rows still open when 2^k exceeds the
    number of processes can only be on a cycle, which is an error.
    """
    state = cut_lineage(lineage.select(
        "id", F.col("parent_id").alias("up"),
        F.coalesce(is_root, F.lit(False)).alias("hit")))
    rounds = state.count().bit_length() + 1
    while True:
        open_rows = state.where("NOT hit AND up IS NOT NULL")
        if open_rows.isEmpty():
            return state.where("hit").select("id")
        if not rounds:
            raise ValueError("the lineage has a cycle")
        rounds -= 1
        table = state.select(F.col("id").alias("_via"), F.col("up").alias("_up"),
                             F.col("hit").alias("_hit"))
        via = open_rows.select("id", F.col("up").alias("_via"))
        moved = split_join(via, table, ["_via"], "left", ["id"], rows_per_task).select(
            "id", F.col("_up").alias("up"), F.coalesce("_hit", F.lit(False)).alias("hit"))
        state = cut_lineage(state.where("hit OR up IS NULL").unionByName(moved))
