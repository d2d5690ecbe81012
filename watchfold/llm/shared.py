"""What the operators of this package share: scratch tables, streams of whole keys, components."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: list[str] = []


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, which driver and executors share.

    Only a session on one machine may leave the setting out (tests); a cluster must name it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="watchfold-llm-"))
        base = _LOCAL[0]
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def written(df: DataFrame, purpose: str, codec: str = "zstd") -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends here, a lost executor
    costs a re-read, and the next plan knows the size."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores added until no column of ``df`` has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def whole_keys(batches: Iterator[pa.RecordBatch], keys: int = 1) -> Iterator[tuple[pa.Table, list[int]]]:
    """Tables that hold only whole runs of equal leading columns, with the runs' bounds.

    The partition must be sorted by its first ``keys`` columns. No more than one batch and one
    unfinished run is held at a time.
    """
    held: list[pa.Table] = []
    last = None

    def bounds(table: pa.Table) -> list[int]:
        change = None
        for i in range(keys):
            column = table.column(i).combine_chunks()
            step = pc.not_equal(column.slice(1), column.slice(0, len(column) - 1))
            step = step.to_numpy(zero_copy_only=False).astype(bool)
            change = step if change is None else change | step
        return [0, *(change.nonzero()[0] + 1).tolist(), table.num_rows]

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        first = tuple(table.column(i)[0].as_py() for i in range(keys))
        if held and first != last:
            whole = pa.concat_tables(held)
            yield whole, bounds(whole)
            held = []
        cut = bounds(table)[-2]
        last = tuple(table.column(i)[-1].as_py() for i in range(keys))
        if cut:
            whole = pa.concat_tables([*held, table.slice(0, cut)])
            yield whole, bounds(whole)
            held = [table.slice(cut)]
        else:
            held.append(table)
    if held:
        whole = pa.concat_tables(held)
        yield whole, bounds(whole)


def in_blocks(rows: DataFrame, sizes: DataFrame, key: str, id_col: str) -> DataFrame:
    """Rows of each key dealt to block pairs, for work that compares all rows of a key.

    ``sizes`` has (key, blocks) for every key to keep. A key of one block is one task's run; a
    key of n blocks becomes n (n + 1) / 2 runs, each of two blocks (or one with itself), so no
    run grows with the key and every two rows meet. Columns ``run`` and ``side`` are added.
    """
    joined = rows.join(sizes, key)
    own = F.pmod(F.xxhash64(id_col), F.col("blocks")).cast("int")
    other = F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)
    joined = joined.withColumn("_own", own).withColumn("_other", F.explode(other))
    lo, hi = F.least("_own", "_other"), F.greatest("_own", "_other")
    side = F.when(F.col("_own") <= F.col("_other"), 0).otherwise(1)
    return (joined.withColumn("run", F.xxhash64(key, lo, hi)).withColumn("side", side)
            .withColumn("same", lo == hi).drop("_own", "_other"))


def components(edges: DataFrame, purpose: str = "components") -> DataFrame:
    """Connected components of ``edges`` (a, b): rows (node, root), root the least node.

    Large-star and small-star rounds until nothing changes; nodes that are a root themselves
    or have no edge give no row. Every round is a written table; minima are taken with map-side
    combining, so a hub costs one row per task there, and the join beside it is a plain
    equi-join, which Spark may split.
    """
    def state(table: DataFrame) -> tuple:
        row = table.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return row[0], row[1]

    at = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now = written(at.distinct(), purpose)
    before = state(now)
    while before[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(
            F.col("u").alias("v"), F.least("u", "m").alias("m"))
        large = now.join(least, "v").select("u", F.col("m").alias("v")).distinct()
        large = written(large, purpose)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(small.union(least.select("u", F.col("m").alias("v"))).distinct(), purpose)
        after = state(now)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


BATCH_ROWS = 500


def short_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Hold the session's Arrow batches to ``rows`` rows, if they are longer. Documents are long,
    and a batch of them exists several times over, on both sides of the pipe to Python."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


_SHIPPED: set[str] = set()
_WORKER: dict = {}


def ship(spark: SparkSession) -> None:
    """Give the executors this package, where their PYTHONPATH does not hold it already."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    place = os.path.join(tempfile.mkdtemp(prefix="watchfold-py-"), "watchfold_package.zip")
    with zipfile.ZipFile(place, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(top)))
    context.addPyFile(place)
    _SHIPPED.add(context.applicationId)


def in_worker(key: tuple, make: Callable[[], object]) -> object:
    """``make()`` once in each Python worker process, whichever tasks it serves."""
    if key not in _WORKER:
        if len(_WORKER) > 4:
            _WORKER.clear()
        _WORKER[key] = make()
    return _WORKER[key]
