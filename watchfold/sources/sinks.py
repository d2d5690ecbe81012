"""Result tables, JSON lines and keyed stores."""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions import times

DATE, BATCH = "dt", "batch"


def event_date(df: DataFrame, time_column: str) -> Column:
    """Partition value: the event's date, from ISO text or epoch nanoseconds."""
    c = F.col(time_column)
    if dict(df.dtypes)[time_column] == "string":
        return F.substring(c, 1, 10)
    return F.date_format(times.ns_to_ts(c), "yyyy-MM-dd")


def date_of(value) -> str:
    """The partition a time belongs to: ISO text or epoch nanoseconds."""
    if isinstance(value, str):
        return value[:10]
    day = datetime.fromtimestamp(int(value) // 1_000_000_000, timezone.utc)
    return day.strftime("%Y-%m-%d")


def append_table(df: DataFrame, root: str, table: str, cluster: bool = True) -> None:
    """Append rows to a result table: its columns only, partitioned by event
    date, sorted by time inside each file so row groups prune. Below its date a
    table is partitioned by batch; rows appended this way are batch ``load``.

    ``cluster`` cuts the rows into even time ranges first: each task then writes
    one or two dates, files do not overlap in time, and a date that holds most
    of the rows is still written by many tasks. Small batches can skip it.
    """
    rows, time_column = _dated(df, table, "load")
    if cluster:
        rows = rows.repartitionByRange(DATE, time_column)
    (rows.sortWithinPartitions(DATE, time_column)
     .write.mode("append").partitionBy(DATE, BATCH).parquet(f"{root}/{table}"))


def _dated(df: DataFrame, table: str, batch: str) -> tuple[DataFrame, str]:
    schema, time_column = schemas.RESULT_TABLES[table]
    rows = df.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])
    rows = rows.withColumn(DATE, event_date(rows, time_column)).withColumn(BATCH, F.lit(batch))
    return rows, time_column


def read_table(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A result table with its date; all batches of batch loads and streams."""
    schema, _ = schemas.RESULT_TABLES[table]
    parts = [T.StructField(DATE, T.StringType()), T.StructField(BATCH, T.StringType())]
    with_date = T.StructType(schema.fields + parts)
    df = spark.read.schema(with_date).parquet(f"{root}/{table}")
    return df.where(_uncovered(_marks(spark, root, table))).drop(BATCH)


def table_dates(spark: SparkSession, root: str, table: str) -> list[str]:
    """Dates the table has, newest first: one folder listing, no data read."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{table}")
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted((n[len(DATE) + 1:] for n in names if n.startswith(DATE + "=")), reverse=True)


def append_batch(df: DataFrame, root: str, table: str, batch_id: int) -> None:
    """Idempotent form for ``foreachBatch``, in the same layout: a retried batch
    overwrites its own folders, one for each date, instead of adding rows twice."""
    rows, time_column = _dated(df, table, f"s{batch_id}")
    (rows.sortWithinPartitions(DATE, time_column)
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(DATE, BATCH).parquet(f"{root}/{table}"))


def append_json_lines(df: DataFrame, path: str) -> None:
    """JSON lines with null fields left out."""
    df.write.mode("append").option("ignoreNullFields", "true").json(path)


def strip_nulls(row: Column) -> Column:
    """JSON text of a struct without its null fields."""
    return F.to_json(row, {"ignoreNullFields": "true"})


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last write per key.

    ``row_number() = 1`` lets Spark keep one row per key on the map side
    (WindowGroupLimit) before anything is shuffled, so a key that holds a third
    of the rows costs one row per map task.
    """
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


ROWS_PER_SLOT = 4_000_000


def upsert(spark: SparkSession, path: str, updates: DataFrame, keys: list[str],
           order: list[str], buckets: int = 64, rows_per_slot: int = ROWS_PER_SLOT) -> None:
    """Keyed last-write-wins store in hash-partitioned Parquet.

    Only the hash partitions (slots) that received an update are read, and their new content is
    written to a folder of its own. The last step puts one small file into the store's log: it
    names the folder that each changed slot now has, and until it is there nothing has changed.
    Files are never overwritten, so readers keep what they began with, and a run that dies or
    loses against another writer leaves the store as it was. Each slot is written by one task;
    when one holds over ``rows_per_slot`` rows, the next upsert deals the whole store to twice as
    many, as often as needed. ``buckets`` counts when the store is made.
    """
    state = _state(spark, path)
    old, grown = None, buckets
    if state:
        grown = state["buckets"]
        while state["most"] * state["buckets"] > rows_per_slot * grown:
            grown *= 2
    slot = F.pmod(F.xxhash64(*keys), F.lit(grown)).cast("int")
    fresh = latest_per_key(updates, keys, order).withColumn("slot", slot)
    if state:
        from ..session import cut_lineage

        fresh = cut_lineage(fresh)
        touched = None
        if grown == state["buckets"]:
            touched = {r[0] for r in fresh.select("slot").distinct().collect()}  # <= buckets values
        old = _live(spark, path, state, touched)
    if old is not None:
        fresh = latest_per_key(old.withColumn("slot", slot).select(fresh.columns).unionByName(fresh), keys, order)
    folder = f"{uuid.uuid4().hex}"
    # A number of tasks of its own: small slots would be put together into one task, which then makes
    # all their folders. Nobody reads the folder before the log names it, so tasks move files there.
    tasks = min(grown, int(spark.conf.get("spark.sql.shuffle.partitions")))
    (fresh.repartition(tasks, "slot").write.partitionBy("slot")
     .option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(f"{path}/data/{folder}"))
    sizes = spark.read.schema(fresh.schema).parquet(f"{path}/data/{folder}").groupBy("slot").count().collect()
    slots = {} if not state or grown != state["buckets"] else dict(state["slots"])
    slots.update({str(r["slot"]): [folder, r["count"]] for r in sizes})
    version = state["version"] + 1 if state else 1
    entry = {"version": version, "buckets": grown, "slots": slots, "most": max((n for _, n in slots.values()), default=0)}
    _put(spark, f"{path}/log/{version:010d}.json", json.dumps(entry))


def read_store(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The store's rows, as they are or as they were at a version that ``vacuum`` has kept."""
    return _live(spark, path, _state(spark, path, version), None)


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> None:
    """Removes the files and log entries that none of the newest ``keep`` versions needs."""
    entries = _names(spark, f"{path}/log")
    kept, gone = entries[-keep:], entries[:-keep]
    needed: dict[str, set[str]] = {}
    for name in kept:
        for slot, (folder, _) in _state(spark, path, int(name[:-5]))["slots"].items():
            needed.setdefault(folder, set()).add(f"slot={slot}")
    # Entries first: what they alone name can no longer be asked for.
    for name in gone:
        _remove(spark, f"{path}/log/{name}")
    newest = set() if not kept else set(needed)
    for folder in _names(spark, f"{path}/data"):
        if folder not in newest:
            _remove(spark, f"{path}/data/{folder}")
        else:
            for slot in _names(spark, f"{path}/data/{folder}"):
                if slot.startswith("slot=") and slot not in needed[folder]:
                    _remove(spark, f"{path}/data/{folder}/{slot}")


def store_files(spark: SparkSession, path: str) -> int:
    """Folders of slots that the store takes up, live or not."""
    return sum(len([s for s in _names(spark, f"{path}/data/{f}") if s.startswith("slot=")]) for f in _names(spark, f"{path}/data"))


def _state(spark: SparkSession, path: str, version: int | None = None) -> dict | None:
    """The newest entry of the log, or that of a version; one line per slot."""
    names = _names(spark, f"{path}/log")
    if version is not None:
        names = [n for n in names if n == f"{version:010d}.json"]
    if not names:
        return None
    return json.loads("".join(r[0] for r in spark.read.text(f"{path}/log/{names[-1]}").collect()))


def _live(spark: SparkSession, path: str, state: dict, slots: set[int] | None) -> DataFrame | None:
    """Rows of the store's slots (of these, or all): their folders are read and nothing else."""
    paths = [f"{path}/data/{folder}/slot={slot}" for slot, (folder, _) in sorted(state["slots"].items())
             if slots is None or int(slot) in slots]
    if not paths and slots is not None:
        return None
    if not paths:
        return spark.read.parquet(f"{path}/data").drop("slot").limit(0)
    return spark.read.parquet(*paths)


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, in order; none if it is not there."""
    fs, p = _file_system(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(n for n in names if not n.startswith((".", "_")))


def _put(spark: SparkSession, path: str, text: str) -> None:
    """A new small file; fails if it is there, so of two writers one is told."""
    fs, p = _file_system(spark, path)
    out = fs.create(p, False)
    out.write(bytearray(text.encode()))
    out.close()


def _remove(spark: SparkSession, path: str) -> None:
    fs, p = _file_system(spark, path)
    fs.delete(p, True)


# --- compaction of result tables ------------------------------------------------------------

COMPACTED = "_compacted"
ROWS_PER_FILE = 4_000_000


def compact_table(spark: SparkSession, root: str, table: str, before: str, rows_per_file: int = ROWS_PER_FILE) -> list[str]:
    """Rewrites every date before ``before`` that has several batches into time-sorted files; the
    dates done.

    A date's rows go to a batch of their own, ``c<n>``. Then one small file says that it stands for
    the batches up to a number, and from then on readers take it for these; before, they do not see
    it. The old batches stay for those who are reading them, until ``remove_compacted``. A stream
    batch among them that is run again rewrites a folder that nobody reads; one that comes later
    for an old date is read beside the compacted rows and joins them the next time.
    """
    time_column = schemas.RESULT_TABLES[table][1]
    marks, due = _marks(spark, root, table), {}
    for date in [d for d in table_dates(spark, root, table) if d < before]:
        mark = marks.get(date)
        live = [n[len(BATCH) + 1:] for n in _names(spark, f"{root}/{table}/{DATE}={date}") if n.startswith(BATCH + "=")]
        new = [n for n in live if not n.startswith("c") and not (mark and _covered(n, mark))]
        if not new or (len(new) == 1 and not mark):
            continue
        upto = max([mark["upto"] if mark else -1, *[int(n[1:]) for n in live if n.startswith("s")]])
        due[date] = {"date": date, "n": mark["n"] + 1 if mark else 1, "upto": upto,
                     "load": bool(mark and mark["load"]) or "load" in live}
    if not due:
        return []
    # All dates in one job: each (date, part of the day) is one task's file.
    rows = read_table(spark, root, table).where(F.col(DATE).isin(list(due)))
    counts = {r[DATE]: r["count"] for r in rows.groupBy(DATE).count().collect()}
    of_date = {d: (f"c{m['n']}", max(1, -(-counts.get(d, 0) // rows_per_file))) for d, m in due.items()}
    names = F.create_map(*[x for d, (name, _) in of_date.items() for x in (F.lit(d), F.lit(name))])
    files = F.create_map(*[x for d, (_, n) in of_date.items() for x in (F.lit(d), F.lit(n))])
    rows = rows.withColumn(BATCH, F.element_at(names, F.col(DATE))).withColumn(
        "_part", F.floor(_share_of_day(rows, time_column) * F.element_at(files, F.col(DATE))))
    (rows.repartition(DATE, "_part").sortWithinPartitions(DATE, time_column).drop("_part")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DATE, BATCH).parquet(f"{root}/{table}"))
    for date, mark in due.items():
        _put(spark, f"{root}/{table}/{COMPACTED}/{date}-{mark['n']:06d}.json", json.dumps(mark))
    return list(due)


def _share_of_day(df: DataFrame, time_column: str) -> Column:
    c = F.col(time_column)
    ts = F.try_to_timestamp(c) if dict(df.dtypes)[time_column] == "string" else times.ns_to_ts(c)
    return F.coalesce(F.pmod(F.unix_seconds(ts), F.lit(86_400)) / 86_400, F.lit(0.0))


def remove_compacted(spark: SparkSession, root: str, table: str) -> None:
    """Removes the batches that compacted ones stand for. Not while older readers are at work."""
    for date, mark in _marks(spark, root, table).items():
        folder = f"{root}/{table}/{DATE}={date}"
        for name in _names(spark, folder):
            batch = name[len(BATCH) + 1:]
            if _covered(batch, mark) or (batch.startswith("c") and int(batch[1:]) < mark["n"]):
                _remove(spark, f"{folder}/{name}")


def _covered(batch: str, mark: dict) -> bool:
    return (batch == "load" and mark["load"]) or (batch.startswith("s") and int(batch[1:]) <= mark["upto"])


def _marks(spark: SparkSession, root: str, table: str) -> dict[str, dict]:
    """Date -> its newest compaction; one small file each."""
    path = f"{root}/{table}/{COMPACTED}"
    names = _names(spark, path)
    newest = {n[:10]: n for n in names}  # in order, so the last of a date stays
    if not newest:
        return {}
    lines = spark.read.text([f"{path}/{n}" for n in newest.values()]).collect()
    return {m["date"]: m for m in (json.loads(r[0]) for r in lines)}


def _uncovered(marks: dict[str, dict]) -> Column:
    """Which (date, batch) rows count: a condition on folders, so the others are not even listed."""
    plain = ~F.col(BATCH).startswith("c")
    if not marks:
        return plain
    mark = F.create_map(*[x for d, m in marks.items() for x in (
        F.lit(d), F.struct(F.lit(m["n"]).alias("n"), F.lit(m["upto"]).alias("upto"), F.lit(m["load"]).alias("load")))])
    own = F.try_element_at(mark, F.col(DATE))
    number = F.substring(BATCH, 2, 20).try_cast("bigint")
    compacted = F.col(BATCH) == F.concat(F.lit("c"), own["n"].cast("string"))
    later = F.when(F.col(BATCH) == "load", ~own["load"]).otherwise(F.col(BATCH).startswith("s") & (number > own["upto"]))
    return F.when(own.isNull(), plain).otherwise(compacted | later)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
