"""Shards of near equal bytes by a k-d tree over metadata (DataFrame functions only).

Rows of equal text form a group, which is never divided; its metadata are its rows' smallest
values. A node of the tree is split along the dimension in which its groups spread widest, at
the weighted median, until a leaf has the target bytes; ``shards`` leaves ask for halves in
proportion. A dimension's value and a hash of the group make one whole number, so equal values
can be divided and no two groups of different hash are equal; the median is narrowed in counts
of ``BINS`` equal steps, of which at most one row for each node and step comes to the driver.

Nulls: a text that is null is empty; null metadata count as the smallest value, and a text
column is a number by its hash. Repeated rows are of one group. An empty table gives an empty
result. Columns that are not named are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from watchfold.llm.shared import documents, written

BINS = 4096
VALUE_BITS, TIE_BITS = 16, 40
SLOT_ROWS = 10_000  # rows numbered in one group, about
DIMENSIONS = ["source", "lang", "n_chars"]


def size_of(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def _number(docs: DataFrame, name: str) -> Column:
    kind = docs.schema[name].dataType.typeName()
    if kind in ("string", "binary"):
        return F.crc32(F.col(name).cast("binary")).cast("double")
    return F.col(name).cast("double")


def _groups(rows: DataFrame, dims: int) -> DataFrame:
    """One row for each group: key, weight, tie, and its place 0 .. 2**VALUE_BITS - 1 by dimension."""
    groups = rows.groupBy("key").agg(F.sum("size").alias("weight"), *[
        F.min(f"d{i}").alias(f"d{i}") for i in range(dims)])
    groups = written(groups, "shard-groups")
    ends = groups.agg(*[f(f"d{i}").alias(f"{n}{i}") for i in range(dims) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    top = (1 << VALUE_BITS) - 1
    scaled = []
    for i in range(dims):
        lo, hi = ends[f"lo{i}"], ends[f"hi{i}"]
        value = F.lit(0) if lo is None or lo == hi else F.floor((F.col(f"d{i}") - lo) / (hi - lo) * top)
        scaled.append(F.coalesce(value, F.lit(0)).cast("long").alias(f"d{i}"))
    tie = F.shiftrightunsigned(F.xxhash64("key", F.lit(9)), 64 - TIE_BITS).alias("tie")
    return groups.select("key", "weight", tie, *scaled)


def _median(groups: DataFrame, nodes: dict[int, float]) -> dict[int, int]:
    """For each node (given the weight wanted on the left) the first place of its right half.

    ``groups`` has node, place, weight. Every round divides the range that holds the median.
    """
    width = VALUE_BITS + TIE_BITS
    low = {n: 0 for n in nodes}
    step = 1 << width
    left = {n: 0.0 for n in nodes}
    found: dict[int, int] = {}
    while step > 1 and len(found) < len(nodes):
        at = F.lit(None).cast("long")
        for n in nodes:
            if n not in found:
                inside = (F.col("node") == n) & (F.col("place") >= low[n]) & (F.col("place") < low[n] + step)
                at = F.when(inside, F.col("place") - low[n]).otherwise(at)
        step = max(step // BINS, 1)
        bins = groups.withColumn("bin", F.floor(at / step)).where("bin IS NOT NULL")
        rows = bins.groupBy("node", "bin").agg(F.sum("weight").alias("w"), F.count("*").alias("n")).collect()
        for n in nodes:
            if n in found:
                continue
            own = sorted((r["bin"], r["w"], r["n"]) for r in rows if r["node"] == n)
            for bin_, weight, count in own:
                if left[n] + weight >= nodes[n]:
                    if count == 1 or step == 1:  # this group goes to the side it disturbs less
                        over = left[n] + weight - nodes[n]
                        right = over > nodes[n] - left[n]
                        found[n] = low[n] + bin_ * step + (0 if right else step)
                    else:
                        low[n] += bin_ * step
                    break
                left[n] += weight
            else:
                found[n] = low[n] + step * BINS
    return {**low, **found}


def kd_tree(groups: DataFrame, dims: int, shards: int) -> DataFrame:
    """(key, shard) of each group. A level of the tree is a written table."""
    at = groups.withColumn("node", F.lit(1)).withColumn("shard", F.lit(0 if shards == 1 else None).cast("int"))
    leaves = {1: (0, shards)} if shards > 1 else {}  # open nodes: first shard and number of shards
    while leaves:
        open_ = at.where(F.col("node").isin(list(leaves)))
        spread = open_.groupBy("node").agg(F.sum("weight").alias("w"), *[
            (F.max(f"d{i}") - F.min(f"d{i}")).alias(f"r{i}") for i in range(dims)]).collect()
        widest = {r["node"]: max(range(dims), key=lambda i, r=r: (r[f"r{i}"], -i)) for r in spread}
        place = F.lit(None).cast("long")
        for n, i in widest.items():
            place = F.when(F.col("node") == n, F.shiftleft(F.col(f"d{i}"), TIE_BITS) + F.col("tie")).otherwise(place)
        wanted = {r["node"]: r["w"] * (leaves[r["node"]][1] // 2) / leaves[r["node"]][1] for r in spread}
        cuts = _median(open_.select("node", place.alias("place"), "weight"), wanted)
        halves = {}
        for n, (first, count) in leaves.items():
            halves[2 * n], halves[2 * n + 1] = (first, count // 2), (first + count // 2, count - count // 2)
        leaves = {n: half for n, half in halves.items() if half[1] > 1}
        node, shard = F.col("node"), F.col("shard")
        for n, cut in cuts.items():
            node = F.when(F.col("node") == n, F.when(place < cut, 2 * n).otherwise(2 * n + 1)).otherwise(node)
        for n, (first, count) in halves.items():
            if count == 1:
                shard = F.when(F.col("node") == n, first).otherwise(shard)
        at = written(at.withColumn("node", node).withColumn("shard", shard), "shard-level")
    return at.select("key", "shard")


def kd_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dimensions: list[str] | None = None,
              shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """One row for each row of ``docs``: id, size, text_crc32, shard, slot.

    Give the number of shards, or the bytes a leaf should have.
    """
    names = DIMENSIONS if dimensions is None else dimensions
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"), size_of(F.col(text_col)).alias("size"), F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("key"), F.monotonically_increasing_id().alias("row"),
        *[_number(docs, name).alias(f"d{i}") for i, name in enumerate(names)],
        size_of(F.col(text_col)).cast("double").alias(f"d{len(names)}"))
    rows, dims = written(rows, "shard-rows"), len(names) + 1
    total, count = rows.agg(F.sum("size"), F.count("*")).first()
    if shards is None:
        shards = max(1, -(-(total or 0) // target_bytes))
    groups = _groups(rows, dims)
    placed = kd_tree(groups, dims, shards)
    out = rows.select("id", "size", "text_crc32", "key", "row").join(placed, "key")
    # Numbered in parts of a shard, each part after those before it.
    parts = max(1, -(-count // (shards * SLOT_ROWS)))
    out = out.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int"))
    out = written(out.select("id", "size", "text_crc32", "row", "shard", "part"), "shard-placed")
    order = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = out.groupBy("shard", "part").count().withColumn("before", F.coalesce(F.sum("count").over(order), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("shard", "part").orderBy("id", "row"))
    out = out.withColumn("_n", within).join(before.select("shard", "part", "before"), ["shard", "part"])
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", "shard",
                      (F.col("before") + F.col("_n") - 1).cast("long").alias("slot"))


def op9_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = kd_shards(documents(spark, sf_dir), shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))
