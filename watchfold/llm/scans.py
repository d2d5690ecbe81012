"""A running count and hash over sorted runs of a key, where one key may fill many partitions.

Rows are range-partitioned by their whole order, so a key with most of the rows lies in many
partitions. Every partition first scans its own rows as if each key began there; what a key
carries over from the partitions before is then one short record for each partition, worked
out from their last rows and joined to the rows of the key that a partition began with.

The hash of a run of elements is a polynomial modulo the prime 2**127 - 1, so those of two
neighbouring stretches combine into that of both. Elements are 120-bit digests: two different
sequences of n elements have one hash with a chance of about n in 2**127.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchfold.llm.shared import ship, written

PRIME = (1 << 127) - 1
BASE = 0x5851F42D4C957F2D14057B7EF767814F % PRIME  # any fixed number
ROWS = 1_000_000   # rows of a partition, about
PATH_BYTES = 64    # of the sort path: two bytes of each of the first 32 elements
OUT_ROWS = 20_000

SCANNED = ("key {key}, element binary, words long, n long, hash binary, before binary, path binary, "
           "part int, at long, opening boolean, tail boolean, last boolean")


def combined(count: int, value: int, path: bytes, own_count: int, own: int, own_path: bytes) -> tuple[int, int, bytes]:
    """(count, hash, path) of a stretch and the one after it."""
    return count + own_count, (value * pow(BASE, own_count, PRIME) + own) % PRIME, (path + own_path)[:PATH_BYTES]


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each partition by itself; a row is held back until it is known what follows it."""
    part = TaskContext.get().partitionId()
    out: list[tuple] = []
    names = schema = held = None
    first = key = None
    n, value, path, at = 0, 0, b"", 0
    for batch in batches:
        if schema is None:
            kind = batch.schema.field("key").type
            names = ["key", "element", "words", "n", "hash", "before", "path", "part", "at", "opening", "tail", "last"]
            schema = pa.schema(list(zip(names, [
                kind, pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int32(),
                pa.int64(), pa.bool_(), pa.bool_(), pa.bool_()], strict=True)))
        columns = [batch.column(i).to_pylist() for i in range(3)]
        for own, element, words in zip(*columns, strict=True):
            if at == 0:
                first = own
            if at == 0 or own != key:
                key, n, value, path = own, 0, 0, b""
            before, n = value, n + 1
            value = (value * BASE + int.from_bytes(element) + 1) % PRIME
            if len(path) < PATH_BYTES:
                path += element[:2]
            if held is not None:
                out.append((*held, False, held[0] != own))
            held = (own, element, words, n, value.to_bytes(16), before.to_bytes(16), path, part, at, own == first)
            at += 1
            if len(out) >= OUT_ROWS:
                yield _batch(out, schema)
                out = []
    if held is not None:
        out.append((*held, True, True))
        yield _batch(out, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def _carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds what the partitions before carry over to a key's count, hashes and path."""
    for batch in batches:
        table = batch.to_pydict()
        done: list[tuple] = []
        for n, value, before, path, c_n, c_value, c_path in zip(
                *[table[name] for name in ("n", "hash", "before", "path", "c_n", "c_hash", "c_path")], strict=True):
            c = (c_n, int.from_bytes(c_value), c_path)
            total, both, whole = combined(*c, n, int.from_bytes(value), path)
            _, earlier, _ = combined(*c, n - 1, int.from_bytes(before), b"")
            done.append((total, both.to_bytes(16), earlier.to_bytes(16), whole))
        if done:
            n, value, before, path = (pa.array(c) for c in zip(*done, strict=True))
            arrays = {"n": n, "hash": value, "before": before, "path": path}
            names = [name for name in batch.schema.names if not name.startswith("c_")]
            yield pa.RecordBatch.from_arrays([arrays.get(name, batch.column(name)) for name in names], names=names)


def partitions(df: DataFrame, rows: int = ROWS) -> int:
    """Partitions for a written table: the session's number, more where they would be long."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows))


def running(rows: DataFrame, order: list[Column], purpose: str, rows_per_part: int = ROWS) -> DataFrame:
    """``rows`` (key, element of 15 bytes, words, and what ``order`` needs after the key) with
    ``n``, its number inside the key from 1, ``hash`` of the elements up to it, ``before``, the
    hash without it, ``path``, two bytes of each leading element, and ``last``."""
    spark = rows.sparkSession
    ship(spark)
    kind = rows.schema["key"].dataType.simpleString()
    schema = SCANNED.format(key=kind)
    ordered = rows.repartitionByRange(partitions(rows, rows_per_part), "key", *order).sortWithinPartitions("key", *order)
    local = written(ordered.select("key", "element", "words").mapInArrow(_local, schema), purpose)
    # One record for each partition: what it began and ended with.
    tails = local.where("tail").orderBy("part").select("part", "key", "n", "hash", "path", "opening").collect()
    firsts = {r["part"]: r["key"] for r in local.where("at = 0").select("part", "key").collect()}
    carry, found = None, []
    for i, tail in enumerate(tails):
        part = tail["part"]
        come = carry if carry and carry[0] == firsts[part] else None
        ends = i + 1 == len(tails) or firsts[tails[i + 1]["part"]] != tail["key"]
        found.append((part, come and come[1], come and come[2].to_bytes(16), come and come[3], ends))
        own = (tail["n"], int.from_bytes(tail["hash"]), bytes(tail["path"]))
        if come and tail["opening"]:
            own = combined(*come[1:], *own)
        carry = (tail["key"], *own)
    parts = spark.createDataFrame(found, "part int, c_n long, c_hash binary, c_path binary, c_ends boolean")
    joined = local.join(F.broadcast(parts), "part")  # as many rows as partitions
    joined = joined.withColumn("last", F.when(F.col("tail"), F.col("c_ends")).otherwise(F.col("last")))
    keep = ["key", "element", "words", "n", "hash", "before", "path", "last"]
    plain = joined.where("NOT (opening AND c_n IS NOT NULL)").select(keep)
    if all(row[1] is None for row in found):
        return plain
    later = joined.where("opening AND c_n IS NOT NULL").select(*keep, "c_n", "c_hash", "c_path")
    return plain.unionByName(later.mapInArrow(_carried, plain.schema))
