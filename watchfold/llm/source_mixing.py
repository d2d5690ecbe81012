"""Documents mixed to weights of their sources, by hash thresholds instead of a sort.

Every document has a fixed 60-bit hash. A source's budget of words is met by the documents whose
hash is below a threshold; a second copy has a budget and a threshold of its own, below the
first, so the choices are nested. Words are summed by source and leading bits of the hash, the
running sum shows the bucket in which a budget ends, and only that bucket's documents are summed
again by further bits, until it holds one hash. One last pass compares each document's hash
with its source's thresholds; the document at the threshold is taken if that comes nearer.

Shares: sources in order of code points, null last, have the given weights in turn, repeating.
They share ``share`` of all words by weight; none gets more than ``most`` times its own, and what
that leaves goes to the others by weight.

Nulls: a null source is a source; a null text has no words; a null id hashes as the empty text.
Rows repeated with one id and text have one hash: at a threshold as many of them are taken as
come nearest, which are alike. Sources without words have the target 0, and so has all of an
empty table, whose result is empty. A text may be of any length; the error of a source is at
most half of the document at its threshold. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from watchfold.llm.shared import documents, written
from watchfold.operators.skew import split_join

WEIGHTS = (5, 2, 1)
SHARE = 1.5
BITS, STEP = 60, 12       # of the hash; known after each pass
BROADCAST_SOURCES = 100_000
RANKED = 100_000          # sources ranked in one task, about
NUMBERED = 100_000        # alike rows numbered in one task, about
WORD = r"[^\x20\x09-\x0D]+"


def document_hash(id_: Column, text: Column) -> Column:
    """60 bits of the MD5 of id and text."""
    digest = F.md5(F.concat_ws(" ", F.coalesce(id_.cast("string"), F.lit("")), F.coalesce(text, F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("long")


def _of_source(rows: DataFrame, table: DataFrame, count: int, salt_by: list[str]) -> DataFrame:
    """``rows`` with their source's row of ``table``, which has at most ``count`` rows for every key."""
    if count <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(table), "key")
    return split_join(rows, table, ["key"], "inner", salt_by)


def ranked(sources: DataFrame, rows: int = RANKED) -> DataFrame:
    """``sources`` with ``rank`` from 0 in order of ``source``, nulls last, in ranges of sources."""
    parts = max(1, -(-sources.count() // rows))
    cut = sources.repartitionByRange(parts, F.asc_nulls_last("source")).withColumn("part", F.spark_partition_id())
    cut = written(cut, "mix-sources")
    before = cut.groupBy("part").count().withColumn("before", F.sum("count").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))  # a row for each range
    own = F.row_number().over(Window.partitionBy("part").orderBy(F.asc_nulls_last("source"))) - 1
    return cut.withColumn("rank", own).join(F.broadcast(before.select("part", "before")), "part").withColumn(
        "rank", F.col("rank") + F.coalesce("before", F.lit(0))).drop("part", "before")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = 2) -> DataFrame:
    """``sources`` (key, source, source_size) with ``target``.

    A round adds up the sources that the present price of a weight would fill; it ends when no
    source is added. Only sums come to the driver.
    """
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights)).cast("int") + 1)
    table = written(ranked(sources).withColumn("weight", weight), "mix-weights")
    words, all_weight = table.agg(F.sum("source_size"), F.sum("weight")).first()
    price, full = (words * share / all_weight if words else 0.0), 0
    cap = most * F.col("source_size")
    while True:
        over = F.col("weight") * F.lit(price) > cap
        n, capped, heavy = table.agg(
            F.count_if(over), F.sum(F.when(over, cap)), F.sum(F.when(~over, F.col("weight")))).first()
        if n == full or not heavy:
            break
        full, price = n, (words * share - capped) / heavy
    return table.select("key", "source_size", F.least(cap.cast("double"), F.col("weight") * F.lit(price)).alias("target"))


def _boundary(sums: DataFrame, bits: int) -> DataFrame:
    """For each (key, copy) the bucket of ``sums`` (key, copy, bucket, words, rest) in which ``rest``
    ends, and what of it is left there."""
    order = Window.partitionBy("key", "copy").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    upto = sums.withColumn("upto", F.sum("words").over(order)).where("upto > rest AND upto - words <= rest")
    return upto.select("key", "copy", "bucket", (F.col("rest") - (F.col("upto") - F.col("words"))).alias("rest"))


def thresholds(rows: DataFrame, wanted: DataFrame, sources: int, most: int) -> DataFrame:
    """(key, copy, cut, take, alike): hashes below ``cut`` are taken, and ``take`` of the ``alike``
    rows at it. ``rows`` (key, u, size) is a written table, ``wanted`` has key, source_size, target."""
    copies = wanted.select("key", "source_size", "target", F.explode(F.sequence(F.lit(1), F.lit(most))).alias("copy"))
    rest = F.col("target") - (F.col("copy") - 1) * F.col("source_size")
    copies = written(copies.select("key", "copy", rest.alias("rest"), F.when(rest >= F.col("source_size"), "all").when(
        rest <= 0, "none").otherwise("part").alias("kind")), "mix-copies")
    whole = copies.where("kind <> 'part'").select(
        "key", "copy", F.when(F.col("kind") == "all", F.lit(1 << BITS)).otherwise(F.lit(-1)).cast("long").alias("cut"),
        F.lit(0).cast("long").alias("take"), F.lit(0).cast("long").alias("alike"))
    bits = STEP
    sums = rows.groupBy("key", F.shiftright("u", BITS - bits).alias("bucket")).agg(F.sum("size").alias("words"))
    at = _boundary(sums.join(copies.where("kind = 'part'").drop("kind"), "key"), bits)
    at = written(at, "mix-buckets")
    near = _of_source(rows, at, sources * most, ["u"]).where(F.shiftright("u", BITS - bits) == F.col("bucket"))
    near = written(near.groupBy("key", "copy", "u", "rest").agg(
        F.sum("size").alias("words"), F.count(F.lit(1)).alias("alike")).where("words > 0"), "mix-near")
    while bits < BITS:
        several = near.groupBy("key", "copy").agg(F.min("u").alias("a"), F.max("u").alias("b")).where("a < b")
        if several.isEmpty():
            break
        bits += STEP
        bucket = F.shiftright("u", BITS - bits).alias("bucket")
        sums = near.groupBy("key", "copy", "rest", bucket).agg(F.sum("words").alias("words"))
        at = _boundary(sums, bits)
        near = near.drop("rest").withColumn("bucket", bucket).join(at, ["key", "copy", "bucket"]).drop("bucket")
        near = written(near, "mix-near")
    take = F.floor(F.col("rest") * F.col("alike") / F.col("words") + F.lit(0.5)).cast("long")
    return written(whole.unionByName(near.select("key", "copy", F.col("u").alias("cut"), take.alias("take"), "alike")), "mix-cuts")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
          weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = 2) -> DataFrame:
    """One row for each row of ``docs``: id, size, source_size, target, taken; ``taken`` is
    ``size`` times the copies that the mix has of it, 0 to ``most``."""
    if not 0 < share <= most:
        raise ValueError("a share is above 0 and not above the copies allowed")
    source = F.col(source_col).cast("string")
    rows = written(docs.select(
        F.col(id_col).alias("id"), source.alias("source"),
        F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("key"),
        document_hash(F.col(id_col), F.col(text_col)).alias("u"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.monotonically_increasing_id().alias("row")), "mix-rows")
    sources = rows.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    sources = written(sources, "mix-sources")
    count = sources.count()
    wanted = written(targets(sources, weights, share, most), "mix-targets")
    cuts = thresholds(rows.select("key", "u", "size"), wanted, count, most)
    by_copy = [F.max(F.when(F.col("copy") == j, F.struct("cut", "take", "alike"))).alias(f"c{j}") for j in range(1, most + 1)]
    table = wanted.join(cuts.groupBy("key").agg(*by_copy), "key")
    joined = _of_source(rows.select("id", "key", "u", "size", "row"), table, count, ["u"])

    def copies(number: Column | None) -> Column:
        """Copies taken of a row, the ``number``-th of those alike."""
        out = F.lit(0)
        for j in range(1, most + 1):
            c = F.col(f"c{j}")
            at = (c["take"] >= c["alike"]) if number is None else (number <= c["take"])
            out = out + F.when((F.col("u") < c["cut"]) | ((F.col("u") == c["cut"]) & at), 1).otherwise(0)
        return out

    def result(df: DataFrame, number: Column | None = None) -> DataFrame:
        return df.select(F.col("id").alias(id_col), "size", "source_size", "target",
                         (F.col("size") * copies(number)).cast("long").alias("taken"))

    if cuts.where("take > 0 AND take < alike").isEmpty():
        return result(joined)
    divided = F.lit(False)
    for j in range(1, most + 1):
        c = F.col(f"c{j}")
        divided = divided | ((F.col("u") == c["cut"]) & (c["take"] > 0) & (c["take"] < c["alike"]))
    alike = written(joined.where(divided), "mix-alike")
    parts = max(1, -(-alike.count() // NUMBERED))
    alike = alike.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)))
    before = alike.groupBy("key", "u", "part").count().withColumn("before", F.sum("count").over(
        Window.partitionBy("key", "u").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    own = F.row_number().over(Window.partitionBy("key", "u", "part").orderBy("row"))
    numbered = alike.withColumn("number", own).join(before.drop("count"), ["key", "u", "part"])
    number = F.col("number") + F.coalesce("before", F.lit(0))
    return result(joined.where(~divided)).unionByName(result(numbered, number))


def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(documents(spark, sf_dir))


SQL = {"op12_source_mixing": r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ' ' || coalesce(text, '')), 1, 15))::BIGINT AS u FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    CASE (row_number() OVER (ORDER BY source COLLATE "binary" NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM d GROUP BY source
), f AS (
  SELECT *, sum(source_size) OVER ()::DOUBLE * 1.5 - coalesce(sum(2 * source_size) OVER o, 0) AS words,
    sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS weight
  FROM s WINDOW o AS (ORDER BY source_size / w, w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), p AS (
  SELECT words / weight AS price FROM f WHERE w * (words / weight) <= 2 * source_size
  ORDER BY source_size / w, w, source NULLS LAST LIMIT 1
), t AS (
  SELECT source, source_size, least((2 * source_size)::DOUBLE, w * price) AS target FROM s, p
), c AS (
  SELECT d.source, u, sum(size) AS words, count(*) AS alike,
    sum(sum(size)) OVER (PARTITION BY d.source ORDER BY u) - sum(size) AS before FROM d GROUP BY d.source, u
), r AS (
  SELECT doc_id, source, size, u, row_number() OVER (PARTITION BY source, u) AS n FROM d
)
SELECT r.doc_id, r.size, t.source_size, t.target, (r.size * (
  (CASE WHEN t.target >= t.source_size OR before + words <= t.target THEN 1
     WHEN before > t.target THEN 0 WHEN n <= floor((t.target - before) * alike / words + 0.5) THEN 1 ELSE 0 END) +
  (CASE WHEN t.target - t.source_size >= t.source_size OR before + words <= t.target - t.source_size THEN 1
     WHEN t.target <= t.source_size OR before > t.target - t.source_size THEN 0
     WHEN n <= floor((t.target - t.source_size - before) * alike / words + 0.5) THEN 1 ELSE 0 END)))::BIGINT AS taken
FROM r JOIN t ON t.source IS NOT DISTINCT FROM r.source JOIN c ON c.source IS NOT DISTINCT FROM r.source AND c.u = r.u"""}
