"""Exact duplicates by an extendible-hash index on shared files (DataFrame functions only).

Texts are equal when identical after every run of ASCII white space became one space; null
counts as empty. The index is a table of chains: buckets are leading bits of the key's hash,
a bucket over ``capacity`` distinct keys is split in two, doubling the directory where it must,
and inside a bucket texts of one hash form a chain whose links were told apart by comparing
their bytes (the text is a grouping key). Copies are combined where they are read, so a text
that a third of all rows repeat travels once for each map task.

Nulls: a null id sorts after all others; a null text is empty. Rows repeated with the same id
are different rows: one of them stays. An empty table gives an empty result. Other columns,
whatever their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from watchfold.llm.shared import documents, unused, written

CAPACITY = 65_536  # distinct keys in a bucket; the directory has about one entry for each so many
STEP = 4           # bits by which a count looks ahead of the directory
BITS = 64


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def slot(key: Column, depth: int) -> Column:
    """The key's leading ``depth`` bits."""
    return F.shiftrightunsigned(key, BITS - depth) if depth else F.lit(0).cast("long")


def directory(keys: DataFrame, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """Buckets (prefix, local depth) in key order for a table of distinct ``key`` values.

    Keys are counted by prefix in the cluster; only these counts come here, at most
    ``2 ** STEP`` for every ``capacity`` keys. Cells that are still too full are counted again
    under longer prefixes.
    """
    total = keys.count()
    depth = max(total // capacity, 1).bit_length() - 1 + STEP
    cells = {r["s"]: r["count"] for r in keys.groupBy(slot(F.col("key"), depth).alias("s")).count().collect()}
    buckets: list[tuple[int, int]] = []
    pending: list[tuple[int, int, dict[int, int], int]] = [(0, 0, cells, depth)]
    while pending:
        too_full: list[tuple[int, int]] = []
        for prefix, local, counts, deep in pending:
            stack = [(prefix, local, counts)]
            while stack:
                prefix, local, counts = stack.pop()
                if sum(counts.values()) <= capacity or local == BITS:
                    buckets.append((prefix, local))
                elif local == deep:
                    too_full.append((prefix, local))
                else:  # the directory doubles for this bucket
                    bit = deep - local - 1
                    for half in (0, 1):
                        part = {s: n for s, n in counts.items() if (s >> bit) & 1 == half}
                        stack.append((prefix * 2 + half, local + 1, part))
        pending = []
        if too_full:
            deep = too_full[0][1]
            longer = min(BITS, deep + STEP)
            chosen = keys.where(slot(F.col("key"), deep).isin([p for p, _ in too_full]))
            rows = chosen.groupBy(slot(F.col("key"), longer).alias("s")).count().collect()
            # a slot of all 64 bits is a signed number; buckets are not
            cells = {r["s"] % (1 << BITS): r["count"] for r in rows}
            pending = [(p, d, {s: n for s, n in cells.items() if s >> (longer - deep) == p}, longer)
                       for p, d in too_full]
    return sorted(buckets, key=lambda b: b[0] << (BITS - b[1]))


def bucket_of(spark: SparkSession, rows: DataFrame, buckets: list[tuple[int, int]]) -> DataFrame:
    """``rows`` with the number of the bucket that owns their ``key``.

    The directory is a sorted array of the buckets' first keys, looked up by range.
    """
    depth = min(max(d for _, d in buckets), 20)
    slots = []
    for number, (prefix, local) in enumerate(buckets):
        if local <= depth:
            slots += [str(number)] * (1 << (depth - local))
        elif prefix & ((1 << (local - depth)) - 1) == 0:
            slots.append(str(number))  # buckets deeper than the directory share their first one's owner
    table = F.split(F.lit(",".join(slots)), ",")
    at = F.element_at(table, (slot(F.col("key"), depth) + 1).cast("int"))
    return rows.withColumn("bucket", at.cast("int"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                capacity: int = CAPACITY, hash_of: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row for each row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the smallest id stays. ``hash_of`` may be any function to a
    long; a poor one makes chains longer, not results wrong.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("body"))
    rows = rows.withColumn("key", hash_of(F.col("body")))
    entries = written(rows.select(
        "id", "key", F.unhex(F.sha2("body", 256)).alias("sha"),
        F.monotonically_increasing_id().alias("row")), "dedup-entries")
    buckets = directory(entries.select("key").distinct(), capacity)

    # The bucket that owns a key compares the bytes of its chain's texts and says which id stays.
    owned = bucket_of(spark, rows, buckets)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id")))
    chains = owned.groupBy("bucket", "key", "body").agg(F.count("*").alias("group_size"), first.alias("first"))
    chains = chains.select("bucket", "key", F.unhex(F.sha2("body", 256)).alias("sha"), "group_size",
                           F.col("first.id").alias("keep_id"))
    index = written(chains.repartition("bucket").sortWithinPartitions("bucket", "key"), "dedup-index")
    # Groups of one need no head. Of rows repeated under the id that stays, the first is the head.
    several = index.where("group_size > 1").drop("bucket")
    same = [entries["key"] == several["key"], entries["sha"] == several["sha"], entries["id"].eqNullSafe(several["keep_id"])]
    heads = entries.join(several, same).groupBy(several["key"], several["sha"], "keep_id", "group_size").agg(
        F.min("row").alias("head_row"))
    heads = heads.withColumn("copied", F.lit(True))
    out = entries.join(written(heads, "dedup-heads"), ["key", "sha"], "left")
    alone = F.col("copied").isNull()
    return out.select(
        F.col("id").alias(id_col),
        F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(alone, True).otherwise(F.col("head_row") == F.col("row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that ``exact_dedup`` drops, all columns kept."""
    found = written(exact_dedup(docs, id_col, text_col).where("not kept"), "dedup-dropped")
    same = found[id_col].eqNullSafe(found["keep_id"])
    own_id, sha = unused(docs, "dedup_id", "dedup_sha")
    dropped = [F.col(id_col).alias(own_id), F.col("text_sha256").alias(sha)]
    other, again = found.where(~same).select(dropped).distinct(), found.where(same).select(dropped).distinct()
    keyed = docs.withColumn(sha, F.sha2(normalised(F.col(text_col)), 256)).withColumn(own_id, F.col(id_col))
    on = [keyed[own_id].eqNullSafe(other[own_id]), keyed[sha] == other[sha]]
    left = keyed.join(other.hint("merge"), on, "left_anti")
    if again.isEmpty():
        return left.drop(sha, own_id)
    # Rows given more than once under one id: the first of each stays.
    on = [left[own_id].eqNullSafe(again[own_id]), left[sha] == again[sha]]
    once = left.join(again, on, "left_anti")
    twice = left.join(again, on, "left_semi").dropDuplicates([own_id, sha])
    return once.unionByName(twice).drop(sha, own_id)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


SQL = {"op5_exact_dedup": r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents
), g AS (
  SELECT body, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY body
)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.body) AS text_sha256
FROM n JOIN g ON n.body = g.body"""}
