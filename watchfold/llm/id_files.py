"""Token ids in files of canonical length-limited Huffman codes.

A code is made from the counts of all ids: lengths up to ``MOST_BITS`` by package-merge, codes in
the order of (length, id). A file is a table of blocks, in ascending document order. A block is
one binary value that is decoded on its own:

    8 bytes  magic ``WFIDS01\\0``
    u32      documents, u32 tokens, u32 bits of the stream, u32 tokens between checkpoints
    u32[]    tokens of each document
    u32[]    bit offset of every checkpoint
    u8[]     the stream, codes from each byte's highest bit on, padded with 8 bytes

All numbers are little-endian. The code itself, id and length in code order, is a small table of
its own beside the blocks. The decoder looks up ``MOST_BITS`` bits at a time and advances all
checkpoints of a block together.

Null texts are empty: they hold the end id only. Null ids of documents come first; repeated ids
keep any order among themselves. An empty table gives no block. Other columns are not looked at.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchfold.llm.shared import documents, in_worker, shared_folder, ship, short_batches, written
from watchfold.llm.tokens import lower_case

END_ID = 1
MOST_BITS = 20
EVERY = 64                # tokens between checkpoints
BLOCK_TOKENS = 1 << 18    # a block is closed after so many
MAGIC = b"WFIDS01\0"


def code_lengths(counts: np.ndarray, most: int = MOST_BITS) -> np.ndarray:
    """Lengths of an optimal prefix code of at most ``most`` bits (package-merge)."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.int64)
    if n > 1 << most:
        raise ValueError(f"{n} ids do not fit codes of {most} bits")
    order = np.argsort(counts, kind="stable")
    weight = counts[order].astype(np.float64)
    # By level, for each package in weight order: whether it is a leaf.
    levels, packages = [], np.zeros(0)
    for _ in range(most):
        merged = np.concatenate([weight, packages])
        rank = np.argsort(merged, kind="stable")
        levels.append(rank < n)
        merged = merged[rank]
        half = len(merged) // 2
        packages = merged[:2 * half:2] + merged[1:2 * half:2]
    lengths = np.zeros(n, np.int64)
    take = 2 * n - 2
    for leaf in reversed(levels):
        leaves = int(leaf[:take].sum())
        lengths[:leaves] += 1
        take = 2 * (take - leaves)
    out = np.zeros(n, np.int64)
    out[order] = lengths
    return out


class Code:
    """A canonical code: ids in code order with their lengths."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        order = np.lexsort((ids, lengths))
        self.ids, self.lengths = ids[order].astype(np.uint32), lengths[order].astype(np.int64)
        step = np.left_shift(np.int64(1), MOST_BITS - self.lengths)
        first = np.cumsum(step) - step
        size = int(self.ids.max()) + 1 if len(ids) else 0
        self.code_of, self.length_of = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        self.code_of[self.ids] = (first >> (MOST_BITS - self.lengths)).astype(np.uint64)
        self.length_of[self.ids] = self.lengths
        # All MOST_BITS-bit words, the first bits of which are a code.
        self.word_id = np.zeros(1 << MOST_BITS, np.uint32)
        self.word_length = np.zeros(1 << MOST_BITS, np.uint8)
        used = int(step.sum())
        self.word_id[:used] = np.repeat(self.ids, step)
        self.word_length[:used] = np.repeat(self.lengths, step)

    def encode(self, ids: np.ndarray, sizes: np.ndarray) -> bytes:
        """One block of the ids of documents of ``sizes`` ids."""
        length = self.length_of[ids]
        end = np.cumsum(length)
        begin = end - length
        bits = int(end[-1]) if len(end) else 0
        words = np.zeros(bits // 64 + 2, np.uint64)
        if len(ids):
            at, shift = begin >> 6, begin & 63
            code = self.code_of[ids]
            room = 64 - shift - length  # below 0: the code goes on in the next word
            inside = room >= 0
            high = np.where(inside, code << np.maximum(room, 0).astype(np.uint64),
                            code >> np.maximum(-room, 0).astype(np.uint64))
            first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            words[at[first]] = np.bitwise_or.reduceat(high, first)
            over = np.flatnonzero(~inside)
            words[at[over] + 1] |= code[over] << (64 + room[over]).astype(np.uint64)
        head = np.array([len(sizes), len(ids), bits, EVERY], "<u4").tobytes()
        stream = words.astype(">u8").tobytes()[:(bits + 7) // 8] + bytes(8)
        return b"".join([MAGIC, head, sizes.astype("<u4").tobytes(), begin[::EVERY].astype("<u4").tobytes(), stream])

    def decode(self, block: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each document) of a block."""
        if block[:8] != MAGIC:
            raise ValueError("not a block of ids")
        n_docs, n, _, every = np.frombuffer(block, "<u4", 4, 8).tolist()
        sizes = np.frombuffer(block, "<u4", n_docs, 24).astype(np.int64)
        marks = -(-n // every)
        at = np.frombuffer(block, "<u4", marks, 24 + 4 * n_docs).astype(np.int64)
        raw = np.frombuffer(block, np.uint8, offset=24 + 4 * n_docs + 4 * marks)
        # Four bytes from each byte on, as one number: any word of up to 25 bits is in one.
        wide = raw.astype(np.uint32)
        quad = (wide[:-3] << np.uint32(24)) | (wide[1:-2] << np.uint32(16)) | (wide[2:-1] << np.uint32(8)) | wide[3:]
        out = np.zeros((marks, every), np.uint32)
        for k in range(every):
            if k == n - (marks - 1) * every:  # the last stretch is over
                at = at[:-1]
            word = (quad[at >> 3] >> (32 - MOST_BITS - (at & 7)).astype(np.uint32)) & np.uint32((1 << MOST_BITS) - 1)
            out[:len(at), k] = self.word_id[word]
            at = at + self.word_length[word]
        return out.reshape(-1)[:n], sizes


def encode_texts(docs: DataFrame, id_col: str, text_col: str, end_id: int) -> DataFrame:
    """(id, ids): every document's ids with the end id, little-endian unsigned 16 or 32 bits."""
    ship(docs.sparkSession)
    short_batches(docs.sparkSession)

    def encode(batches):
        encoder = in_worker(("lower-case",), lower_case)
        for batch in batches:
            for at, to, ids, each in encoder.batches(batch.column(1)):
                whole = np.full(len(ids) + len(each), end_id, encoder.kind)
                ends = np.cumsum(each + 1)
                inside = np.ones(len(whole), bool)
                inside[ends - 1] = False
                whole[inside] = ids
                width = encoder.kind.itemsize
                offsets = np.concatenate([[0], ends * width]).astype(np.int32)
                binary = pa.Array.from_buffers(pa.binary(), to - at, [None, pa.py_buffer(offsets), pa.py_buffer(whole)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), binary], names=["id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(encode, f"id {kind}, ids binary")


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a binary column of 16-bit ids in a row, and how many each value has."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    return data.view("<u2"), np.diff(offsets).astype(np.int64) // 2


def count_ids(tokens: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(ids, counts) of all ids; at most one row for each id of the vocabulary."""
    def count(batches):
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            if batch.num_rows:
                total += np.bincount(_flat(batch.column(0))[0], minlength=1 << 16)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["token", "n"])

    rows = tokens.select("ids").mapInArrow(count, "token int, n long").groupBy("token").agg(F.sum("n").alias("n")).toArrow()
    order = np.argsort(rows.column("token").to_numpy())
    return rows.column("token").to_numpy()[order].astype(np.uint32), rows.column("n").to_numpy()[order]


def _list_of(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


BLOCK = "part int, place int, tokens_before long, tokens long, block binary"


def write_id_files(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID,
                   block_tokens: int = BLOCK_TOKENS) -> None:
    """Write ``path``/blocks, ``path``/documents (id, part, place, number) and ``path``/code."""
    spark = docs.sparkSession
    tokens = written(encode_texts(docs, id_col, text_col, end_id), "id-tokens")
    ids, counts = count_ids(tokens)
    lengths = code_lengths(counts)
    table = pa.table({"token": pa.array(ids.astype(np.int32)), "bits": pa.array(lengths.astype(np.int32))})
    spark.createDataFrame(table.to_pandas(), "token int, bits int").coalesce(1).write.parquet(f"{path}/code")
    shared = spark.sparkContext.broadcast((ids, lengths))  # at most one entry for each id

    def blocks(batches):
        code = Code(*shared.value)
        part, place, before = TaskContext.get().partitionId(), 0, 0
        names, held, sizes, total = [], [], [], 0

        def close():
            block = code.encode(np.concatenate(held), np.concatenate(sizes))
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([place], pa.int32()), pa.array([before]), pa.array([total]),
                 pa.array([block], pa.binary()), _list_of(pa.concat_arrays(names))],
                names=["part", "place", "tokens_before", "tokens", "block", "ids"])

        for batch in batches:
            if not batch.num_rows:
                continue
            flat, each = _flat(batch.column(1))
            ends = np.cumsum(each)
            at = 0
            while at < len(each):
                done = ends[at - 1] if at else 0
                to = min(int(np.searchsorted(ends, done + block_tokens - total, "left")) + 1, len(each))
                names.append(batch.column(0).slice(at, to - at))
                held.append(flat[done:ends[to - 1]])
                sizes.append(each[at:to])
                total += int(ends[to - 1] - done)
                at = to
                if total >= block_tokens:
                    yield close()
                    names, held, sizes = [], [], []
                    place, before, total = place + 1, before + total, 0
        if total:
            yield close()

    kind = docs.schema[id_col].dataType.simpleString()
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    ordered = tokens.repartitionByRange(int(parts), "id").sortWithinPartitions("id")
    ordered.mapInArrow(blocks, f"{BLOCK}, ids array<{kind}>").write.option("compression", "none").parquet(f"{path}/blocks")


def read_id_files(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """Documents of the files: id, start (ids before it), n_tokens, ids (little-endian unsigned
    32-bit numbers)."""
    ship(spark)
    table = spark.read.parquet(f"{path}/code").toArrow()
    shared = spark.sparkContext.broadcast((table.column("token").to_numpy().astype(np.uint32),
                                           table.column("bits").to_numpy().astype(np.int64)))
    stored = spark.read.parquet(f"{path}/blocks")
    # Ids before each partition: one row for each partition that wrote.
    totals = stored.groupBy("part").agg(F.sum("tokens").alias("n"))
    before = totals.withColumn("part_start", F.expr(
        "sum(n) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"))
    before = before.select("part", F.coalesce("part_start", F.lit(0)).alias("part_start"))
    kind = stored.schema["ids"].dataType.elementType.simpleString()

    def unpack(batches):
        code = Code(*shared.value)
        for batch in batches:
            for i in range(batch.num_rows):
                ids, sizes = code.decode(batch.column(1)[i].as_py())
                ends = np.cumsum(sizes)
                start = batch.column(0)[i].as_py() + ends - sizes
                offsets = np.concatenate([[0], ends * 4]).astype(np.int32)
                binary = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype("<u4"))])
                yield pa.RecordBatch.from_arrays([batch.column(2)[i].values, pa.array(start), pa.array(sizes), binary],
                                                 names=[id_col, "start", "n_tokens", "ids"])

    placed = stored.join(before, "part").select((F.col("part_start") + F.col("tokens_before")).alias("start"), "block", "ids")
    return placed.mapInArrow(unpack, f"`{id_col}` {kind}, start long, n_tokens long, ids binary")


def op7_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "id-files")
    write_id_files(documents(spark, sf_dir), path)
    read = read_id_files(spark, path)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
