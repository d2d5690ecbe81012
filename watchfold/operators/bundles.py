"""Bundles from matched logs, and bundles merged by rule or process."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..functions.fingerprints import with_object_fingerprint
from ..session import cut_lineage
from ..sources.rules import Rule, rule_objects_json
from . import normalize
from .barrier import once
from .rules import rule_lookup
from .skew import chunk_number, first_per_key, split_join, wide_join

SPEC = "2.1"


def objects_lookup(rules: list[Rule]) -> Column:
    """Constant map rule key -> array of object JSON texts."""
    return F.create_map(*[
        x for r in rules
        for x in (F.lit(r.key), F.array(*[F.lit(o) for o in rule_objects_json(r)]))
    ])


def relationship(source_ref: Column, target_ref: Column, kind: str, at: Column,
                 object_id: Column) -> Column:
    return F.to_json(F.struct(
        F.lit("relationship").alias("type"), F.lit(SPEC).alias("spec_version"),
        object_id.alias("id"), at.alias("created"), at.alias("modified"),
        F.lit(kind).alias("relationship_type"), source_ref.alias("source_ref"),
        target_ref.alias("target_ref")))


def bundle_id() -> Column:
    return ids.object_id("bundle", F.col("corr_id"), F.col("time_text"), F.col("dedup_key"))


def assemble(matched: DataFrame, rules: list[Rule], flat: bool = False,
             with_rule_objects: bool = True) -> DataFrame:
    """Matched logs (with ``matches``) to bundles, row by row.

    The rule objects come from a constant map, so nothing is shuffled. Objects:
    process, observed-data (its refs extended by the indicators), one
    relationship per match, then the rules' own objects.
    """
    # Once per row: the links are made in a lambda, where an id would be worked out anew for each.
    df = once(matched, "bundle_id", bundle_id(), [c for c in matched.columns if c != "bundle_id"])
    indicators = F.transform(
        "matches", lambda k: F.element_at(rule_lookup(rules, "indicator_id"), k))
    df = once(df, "indicator_ids", indicators)
    links = F.transform("indicator_ids", lambda i, n: relationship(
        F.col("bundle_id"), i, "indicates", F.col("time_text"),
        ids.object_id("relationship", F.col("bundle_id"), i, n)))
    parts = [
        F.array(normalize.process_object(flat),
                normalize.observed_object(F.col("indicator_ids"), flat)),
        links,
    ]
    if with_rule_objects:
        parts.append(F.flatten(F.transform(
            "matches", lambda k: F.element_at(objects_lookup(rules), k))))
    return df.withColumn("objects", F.concat(*parts))


def bundle_text(extensions: Column | None = None) -> Column:
    head = F.concat(
        F.lit('{"type":"bundle","id":"'), F.col("bundle_id"),
        F.lit(f'","spec_version":"{SPEC}","objects":['), F.array_join("objects", ","), F.lit("]"))
    if extensions is None:
        return F.concat(head, F.lit("}"))
    return F.concat(head, F.lit(',"extensions":{"x-matching-patterns":'), extensions, F.lit("}}"))


def matches_text(rules: list[Rule]) -> Column:
    """JSON list of {indicator_id, pattern_id, attack} for the matches."""
    def one(k):
        return F.concat(
            F.lit('{"indicator_id":"'), F.element_at(rule_lookup(rules, "indicator_id"), k),
            F.lit('","pattern_id":"'), F.element_at(rule_lookup(rules, "rule_id"), k),
            F.lit('","attack":['),
            F.array_join(F.element_at(objects_lookup(rules), k), ","), F.lit("]}"))

    return F.concat(F.lit("["), F.array_join(F.transform("matches", one), ","), F.lit("]"))


def matched_rule_rows(matched: DataFrame, rules: list[Rule], flat: bool = False) -> DataFrame:
    """Rows of the matched-rules table: the two log objects plus the matches as
    an extension, no relationships."""
    df = matched.withColumns({
        "bundle_id": bundle_id(),
        "objects": F.array(normalize.process_object(flat), normalize.observed_object(flat=flat)),
        "_m": matches_text(rules),
    })
    return df.select(F.col("time_text").alias("timestamp"),
                     bundle_text(F.col("_m")).alias("bundle"), F.col("_m").alias("matches"))


def store_key(rules: list[Rule], per_match: bool = False) -> Column:
    """``rule:fingerprint``. One key per log under its last match, or with
    ``per_match`` an array of one key per match."""
    ids_of = F.transform("matches", lambda k: F.element_at(rule_lookup(rules, "rule_id"), k))
    keys = F.transform(ids_of, lambda r: F.concat(r, F.lit(":"), F.col("dedup_key")))
    return keys if per_match else F.element_at(keys, -1)


def append_objects(bundles: DataFrame, more: Column) -> DataFrame:
    return bundles.withColumn("objects", F.concat("objects", more))


# --- merging -------------------------------------------------------------------------

def explode_for_merge(grouped: DataFrame, order: list[str]) -> DataFrame:
    """Object rows with group, bundle, order, position, type and fingerprint."""
    rows = grouped.select(
        "group_key", "bundle_id", *order, F.posexplode("objects").alias("pos", "object"))
    return with_object_fingerprint(rows, "object", "fingerprint", "type")


def consolidate(bundles: DataFrame, group: Column, order: list[str],
                keep_first_whole: bool = False) -> DataFrame:
    """One merged bundle per group, as object rows.

    ``bundles`` has bundle_id, objects (JSON texts) and the ``order`` columns.
    The group's first bundle gives the bundle id; of objects that are equal up
    to id and dates only the first stays. Equality is a hash key, so this is one
    grouping instead of comparing every object with every other, and repeats go
    before the shuffle. Rows stay tall: a rule can own a third of all bundles,
    and no list over a group is ever built (see ``bundle_parts``).

    ``keep_first_whole`` also keeps repeats inside the first bundle.
    """
    grouped = bundles.select(group.alias("group_key"), "bundle_id", *order, "objects")
    # Written, so that no object is fingerprinted twice. The first object of a group's first
    # bundle is always kept, so the kept rows know the group's head.
    kept = consolidate_increment(None, bundles, group, order)
    merged = merged_state(kept, order)
    if not keep_first_whole:
        return merged
    heads = merged.select("group_key", "merged_id").distinct()
    first_rows = wide_join(grouped, heads, ["group_key"], "inner").where(
        F.col("bundle_id") == F.col("merged_id"))
    firsts = explode_for_merge(first_rows, [*order, "merged_id"])
    return firsts.unionByName(merged.where(F.col("bundle_id") != F.col("merged_id")))


def consolidate_increment(state: DataFrame | None, bundles: DataFrame, group: Column, order: list[str]) -> DataFrame:
    """The rows of merged bundles after ``bundles`` were added: a new ``state``.

    A state has the kept objects with their group, type, fingerprint and position, without the
    head. First rows of first rows are first rows, so increments may come in any order; a late
    bundle that turns out the group's first takes the head and replaces later equal objects.
    ``merged_state`` adds the heads. Give as ``state`` the groups that the bundles touch, or all.
    """
    objects = explode_for_merge(bundles.select(group.alias("group_key"), "bundle_id", *order, "objects"), order)
    position = [F.col(c).asc() for c in [*order, "bundle_id", "pos"]]
    new = first_per_key(objects, ["group_key", "type", "fingerprint"], position)
    if state is not None:
        new = first_per_key(state.select(new.columns).unionByName(new), ["group_key", "type", "fingerprint"], position)
    return cut_lineage(new)


def merged_state(state: DataFrame, order: list[str]) -> DataFrame:
    """``consolidate``'s rows from a written state."""
    heads = state.groupBy("group_key").agg(F.min(F.struct(*order, "bundle_id")).alias("_head")).select(
        "group_key", F.col("_head.bundle_id").alias("merged_id"))
    return split_join(state, heads, ["group_key"], "inner", ["fingerprint"])


def consolidate_by_rule(bundles: DataFrame, order: list[str], rule: str = "rule_id",
                        **kw) -> DataFrame:
    return consolidate(bundles, F.col(rule), order, **kw)


def consolidate_by_process(bundles: DataFrame, order: list[str], **kw) -> DataFrame:
    """Grouped by the id of each bundle's first object."""
    first = F.get_json_object(F.get("objects", F.lit(0)), "$.id")
    return consolidate(bundles, first, order, **kw)


def bundle_parts(merged: DataFrame, order: list[str], size: int = 1000) -> DataFrame:
    """Merged bundles as documents of at most ``size`` objects.

    Rows are range-partitioned by group and order, so a large group spans
    several partitions and gives several parts that share its bundle id.
    """
    position = ["group_key", *order, "bundle_id", "pos"]
    ranged = merged.repartitionByRange(*position).sortWithinPartitions(*position)
    parts = (
        ranged.withColumn("part", chunk_number(size))
        .groupBy("group_key", "merged_id", "part")
        .agg(F.sort_array(F.collect_list(F.struct(*order, "bundle_id", "pos", "object")))
             .alias("_rows"))
    )
    docs = parts.select(
        "group_key", F.col("merged_id").alias("bundle_id"), "part",
        F.col("_rows.object").alias("objects"))
    return docs.withColumn("bundle", bundle_text())
