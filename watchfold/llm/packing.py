"""Best-fit packing of token pieces into sequences, by rounds over a tree of partitions.

A document is its ids and an end id; longer ones than a sequence are cut so that the first piece
takes the remainder. The pieces are dealt to partitions by a hash of their place in the table, so
each has a like mix of sizes however the table is clustered, and every partition packs its own by
best fit, largest first. Bins that no other open bin, of any partition, fits into are final; the
others are items of the next round, in which ``FAN`` neighbouring partitions pack them together,
until one is left. After best fit no two bins of a partition fit together, so at most one of them
is up to half full: what a round has to look at is small, whatever the tables hold.

Null texts are empty: one piece, the end id. Null or repeated ids are carried along, every row
is packed. An empty table gives an empty result. Columns not named are not looked at.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchfold.llm.shared import documents, in_worker, ship, unused, whole_keys, written
from watchfold.llm.tokens import byte_level

CAPACITY = 2048
END_ID = 0
FAN = 16
PIECES = 20_000  # of a partition, about
ROUND_BIT, GROUP_BIT = 58, 32  # a bin's number: round, group, place in the group


def cut(n: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, piece, start, length) of texts of ``n`` ids; only a text's first piece is short."""
    pieces = -(-n // capacity)
    of = np.repeat(np.arange(len(n)), pieces)
    piece = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first = (n - (pieces - 1) * capacity)[of]
    start = np.where(piece == 0, 0, first + (piece - 1) * capacity)
    return of, piece, start, np.where(piece == 0, first, capacity)


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
                 end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of every document: id, piece, start, length, ids_crc32, and on demand ``ids``
    (little-endian unsigned 32-bit numbers)."""
    ship(docs.sparkSession)

    def pieces(batches):
        encoder = in_worker(("byte-level",), byte_level)
        for batch in batches:
            for at, to, ids, each in encoder.batches(batch.column(1)):
                n = each + 1
                whole = np.full(len(ids) + len(each), end_id, "<u4")
                inside = np.ones(len(whole), bool)
                inside[np.cumsum(n) - 1] = False
                whole[inside] = ids
                of, piece, start, length = cut(n, capacity)
                begin = (np.cumsum(n) - n)[of] + start
                raw = memoryview(whole.tobytes())
                bounds = list(zip((begin * 4).tolist(), ((begin + length) * 4).tolist(), strict=True))
                columns = [batch.column(0).slice(at, to - at).take(pa.array(of)), pa.array(piece.astype(np.int32)),
                           pa.array(start), pa.array(length), pa.array([zlib.crc32(raw[a:b]) for a, b in bounds], pa.int64())]
                names = [id_col, "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([raw[a:b].tobytes() for a, b in bounds], pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(id_col, text_col).mapInArrow(pieces, schema)


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit, largest first: (bin of each item, offset there, fill of each bin)."""
    order = np.argsort(-sizes, kind="stable")
    bin_of, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by free space
    free_sizes = 0  # bit f: some bin has f free
    fill: list[int] = []
    for item, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        fits = free_sizes >> size
        if fits:
            free = (fits & -fits).bit_length() - 1 + size
            at = open_bins[free].pop()
            if not open_bins[free]:
                free_sizes ^= 1 << free
        else:
            at, free = len(fill), capacity
            fill.append(0)
        bin_of[item], offset[item] = at, fill[at]
        fill[at] += size
        free -= size
        open_bins[free].append(at)
        free_sizes |= 1 << free
    return bin_of, offset, np.array(fill, np.int64)


def pack(items: DataFrame, size_col: str = "length", capacity: int = CAPACITY, fan: int = FAN) -> DataFrame:
    """``items``, which must be a written table, with ``sequence_id`` and ``offset`` (replaced if
    they are there).

    A partition's items are held by one task as narrow rows; sizes are 1 to ``capacity``.
    """
    ship(items.sparkSession)
    items = items.drop("sequence_id", "offset")
    bin_, offset_, fill_, into_, shift_ = unused(items, "bin", "bin_offset", "bin_fill", "bin_into", "bin_shift")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema)

    def local(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        part = TaskContext.get().partitionId()
        bin_of, offset, fill = best_fit(table.column(size_col).to_numpy(), capacity)
        table = table.append_column(bin_, pa.array((part << GROUP_BIT) + bin_of))
        table = table.append_column(offset_, pa.array(offset)).append_column(fill_, pa.array(fill[bin_of]))
        yield from table.to_batches(max_chunksize=100_000)

    # Places in a written table are the same each time it is read.
    parts = -(-items.count() // PIECES) or 1
    dealt = items.repartition(parts, F.xxhash64(F.monotonically_increasing_id()))
    placed = written(dealt.mapInArrow(local, f"{schema}, `{bin_}` long, `{offset_}` long, `{fill_}` long"), "pack-local")
    bins = placed.where(F.col(offset_) == 0).select(F.col(bin_).alias("bin"), F.col(fill_).alias("fill"),
                                                   F.shiftright(bin_, GROUP_BIT).alias("part"))
    turn = 0
    while True:
        least, groups = bins.agg(F.min("fill"), F.max("part")).first()
        # A bin without room for the smallest is final.
        bins = bins.where(F.col("fill") + (least or 0) <= capacity)
        if not groups:
            break
        turn += 1

        def merge(batches, turn=turn):
            for table, bounds in whole_keys(batches):
                group, number = table.column("group").to_numpy(), table.column("bin").to_numpy()
                fill = table.column("fill").to_numpy()
                for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                    bin_of, offset, total = best_fit(fill[a:b], capacity)
                    into = (turn << ROUND_BIT) + (int(group[a]) << GROUP_BIT) + bin_of
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(number[a:b]), pa.array(into), pa.array(offset), pa.array(total[bin_of]), pa.array(group[a:b])],
                        names=["bin", "into", "shift", "fill", "part"])

        grouped = bins.select(F.floor(F.col("part") / fan).alias("group"), "bin", "fill")
        merged = grouped.repartition("group").sortWithinPartitions("group", "bin").mapInArrow(
            merge, "bin long, into long, shift long, fill long, part long")
        merged = written(merged, "pack-round")
        moves = merged.select(F.col("bin").alias(bin_), F.col("into").alias(into_), F.col("shift").alias(shift_))
        placed = placed.join(moves, bin_, "left").withColumns({
            bin_: F.coalesce(into_, bin_), offset_: F.col(offset_) + F.coalesce(shift_, F.lit(0)),
        }).drop(into_, shift_)
        bins = merged.where("shift = 0").select(F.col("into").alias("bin"), "fill", "part")
    return placed.withColumnsRenamed({bin_: "sequence_id", offset_: "offset"}).drop(fill_)


def assembled(placed: DataFrame) -> DataFrame:
    """Sequences (sequence_id, ids) of packed pieces with ``ids``; a group is one sequence."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda whole, part: F.concat(whole, part["ids"]))
    return placed.groupBy("sequence_id").agg(joined.alias("ids"))


def packed_documents(docs: DataFrame) -> DataFrame:
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return pack(written(token_pieces(docs), "pack-pieces")).select(columns)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(documents(spark, sf_dir))
