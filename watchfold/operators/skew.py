"""Joins and groupings that stay even when one key holds much of the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 8
SPREAD = 32


def salted_join(left: DataFrame, right: DataFrame, on: list[str], how: str,
                salt_by: list[str], salts: int = SALTS) -> DataFrame:
    """Equi-join whose left side may have hot keys.

    Left rows of one key are spread over ``salts`` tasks by a hash of
    ``salt_by`` (columns that differ inside a key, such as time or id); the
    right side, which must be the small or pre-aggregated one, is repeated once
    per salt. The salt comes from the row's content, so a task that is run
    again sends its rows to the same places. When the right side turns out
    small at run time AQE broadcasts it and the salt costs nothing.
    """
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(*salt_by), F.lit(salts)).cast("int"))
    copies = F.explode(F.array(*[F.lit(i) for i in range(salts)]))
    repeated = right.withColumn("_salt", copies)
    return salted.join(repeated, [*on, "_salt"], how).drop("_salt")


def wide_join(left: DataFrame, right: DataFrame, on: list[str], how: str) -> DataFrame:
    """Equi-join whose right side grows with the data.

    Spark takes a table for as large as its compressed files times the share of the columns kept,
    whatever an ``explode`` or a built text adds, and on that guess collects it on the driver for
    a broadcast. Merging reads both sides by task; of a hot key the adaptive skew split takes care.
    """
    return left.join(right.hint("merge"), on, how)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt in turn to ``SPREAD`` tasks, or three a core, but no more than a shuffle has.

    At most one task reads a row group of a file, so a narrow table gives work to few tasks, however
    much is done for each of its rows. Spark sorts a task's rows before it deals them, so one that
    runs again sends its rows to the same places. More tasks would only make smaller output files.
    """
    spark = df.sparkSession
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(min(most, max(SPREAD, 3 * spark.sparkContext.defaultParallelism)))


ROWS_PER_TASK = 4_000_000
PAIRS_PER_TASK = 50_000_000


def split_join(left: DataFrame, right: DataFrame, on: list[str], how: str, salt_by: list[str],
               rows_per_task: int = ROWS_PER_TASK, pairs_per_task: int | None = None,
               counted: DataFrame | None = None) -> DataFrame:
    """Equi-join (inner, left, left_semi, left_anti) that splits the left side's hot keys.

    Keys are counted first (partial counts per task). One with more than
    ``rows_per_task`` rows is dealt to as many salts as it needs, and only such
    keys' right rows are repeated. There are at most rows / ``rows_per_task`` of
    them, which bounds the table of salts that is broadcast. ``left`` is read
    twice, so it should be a table or a cheap scan. With ``pairs_per_task`` a key whose rows of
    both sides make more pairs than that is split as well, for right sides that repeat keys.
    ``counted`` has the most rows, ``_rows``, of each value of some of ``on``, where that is known
    without reading ``left``.
    """
    tasks = F.col("_rows") / rows_per_task
    sizes = counted if counted is not None else left.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows"))
    by = [c for c in on if c in sizes.columns]
    if pairs_per_task:
        sizes = sizes.join(right.groupBy(*by).agg(F.count(F.lit(1)).alias("_others")).hint("merge"), by, "left")
        pairs = F.col("_rows") * F.coalesce("_others", F.lit(1)) / pairs_per_task
        tasks = F.greatest(tasks, F.least(pairs, F.col("_rows")))
    sizes = sizes.select(*by, F.ceil(tasks).cast("int").alias("_salts")).where("_salts > 1")
    sizes = F.broadcast(sizes)
    salts = F.coalesce("_salts", F.lit(1))
    dealt = left.join(sizes, by, "left").withColumn(
        "_salt", F.pmod(F.xxhash64(*salt_by), salts).cast("int")).drop("_salts")
    copied = right.join(sizes, by, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return wide_join(dealt, copied, [*on, "_salt"], how).drop("_salt")


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row per key in ``order``.

    The filter on ``row_number`` makes Spark keep one row per key in every map
    task before the shuffle, so a hot key is reduced where it is read.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def first_n_per_key(df: DataFrame, keys: list[Column], order: list[Column], n: int,
                    rank: str = "rank_in_key") -> DataFrame:
    """First ``n`` rows per key, pre-limited on the map side like above."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def chunk_number(size: int) -> Column:
    """A number shared by at most ``size`` neighbouring rows of a partition.

    Grouping by (key, chunk) bounds every collected list by ``size`` however
    many rows the key has.
    """
    row = F.monotonically_increasing_id()
    index = row.bitwiseAND(F.lit((1 << 33) - 1))
    return row - F.pmod(index, F.lit(size))
