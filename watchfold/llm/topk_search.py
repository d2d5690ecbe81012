"""Exact top-k by integer inner product, pruned by segment statistics from coarse to fine.

A vector becomes floor(scale * x) in whole numbers. A vector is cut into segments; from their
means and the lengths of what is left around the means follows, by Cauchy-Schwarz, the most that
an inner product can be (equally, the least that a distance can be). Blocks of queries meet blocks of
candidates; a candidate is looked at in finer segments, and at last exactly, only while its
bound reaches the k-th best score found so far. Bounds are rounded up, so nothing is lost.

Vectors that are null or hold null or non-finite components take no part, nor do rows without an
id. Vectors of different lengths are not compared. The same vector under the same id counts
once; an id with several vectors asks with each, and their scores are ranked together; a query's own
id is no candidate. Ties go to the smaller id. With fewer than k candidates
all are returned; an empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from watchfold.llm.shared import ship, whole_keys, written

SCALE, K = 1024, 10
SEGMENTS = (1, 4, 16)
CANDIDATES, QUERIES = 4096, 1024  # vectors of a block
AT_ONCE = 1024                    # candidates multiplied with all queries of a block
TRIED = 8                         # times k candidates scored at each level for something to prune by
GROUP_BLOCKS = 8                  # candidate blocks that a run of one query block goes through


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, dim, q): usable vectors as little-endian 64-bit whole numbers."""
    x = F.col(vector_col)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & x.isNotNull()).where(finite & (F.size(x) > 0)).select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))

    def convert(batches):
        for batch in batches:
            lists = batch.column(1)
            values = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False)).astype("<i8")
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            offsets = np.concatenate([[0], ends * 8]).astype(np.int32)
            q = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(offsets), pa.py_buffer(values)])
            yield pa.RecordBatch.from_arrays([batch.column(0), q], names=["vec_id", "q"])

    return rows.mapInArrow(convert, "vec_id long, q binary").withColumn(
        "dim", (F.octet_length("q") / 8).cast("int"))


def blocks(vectors: DataFrame, most: int) -> DataFrame:
    """(dim, block, ids, data): vectors of one length in blocks of at most ``most``."""
    def gather(batches):
        part, number = TaskContext.get().partitionId(), 0
        held: dict[int, list] = {}

        def close(dim):
            nonlocal number
            rows = held.pop(dim)
            number += 1
            return pa.RecordBatch.from_arrays([
                pa.array([dim], pa.int32()), pa.array([(part << 32) + number]),
                pa.array([np.array([r[0] for r in rows], "<i8").tobytes()], pa.binary()),
                pa.array([b"".join(r[1] for r in rows)], pa.binary())], names=["dim", "block", "ids", "data"])

        for batch in batches:
            for vec_id, q in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = held.setdefault(len(q) // 8, [])
                rows.append((vec_id, q))
                if len(rows) == most:
                    yield close(len(q) // 8)
                elif len(held) > 64:  # vectors of many lengths: no need to hold them all
                    yield close(next(iter(held)))
        for dim in list(held):
            yield close(dim)

    return vectors.select("vec_id", "q").mapInArrow(gather, "dim int, block long, ids binary, data binary")


class Block:
    def __init__(self, ids: bytes, data: bytes, dim: int):
        self.ids = np.frombuffer(ids, "<i8")
        self.rows = np.frombuffer(data, "<i8").reshape(-1, dim)
        self.largest = float(np.abs(self.rows.astype(np.float64)).max())
        self.real = self.rows.astype(np.float64)
        self.means, self.rests = [], []
        for n in SEGMENTS:
            at = np.unique(np.linspace(0, dim, min(n, dim) + 1).astype(int))
            size = np.diff(at)
            mean = np.add.reduceat(self.real, at[:-1], axis=1) / size
            around = self.real - np.repeat(mean, size, axis=1)
            self.means.append(mean * np.sqrt(size))
            self.rests.append(np.sqrt(np.add.reduceat(around * around, at[:-1], axis=1)))


def bound(a: Block, b: Block, level: int, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """The most that the inner products can be."""
    most = a.means[level][rows] @ b.means[level][columns].T + a.rests[level][rows] @ b.rests[level][columns].T
    # Rounding errors are far below a millionth of the product of the lengths.
    return most + 1e-6 * (1 + a.largest * b.largest * a.rows.shape[1])


def products(a: Block, b: Block, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """All inner products of rows and columns in whole numbers."""
    if a.largest * b.largest * a.rows.shape[1] < 2.0 ** 53:
        return (a.real[rows] @ b.real[columns].T).astype(np.int64)
    return a.rows[rows] @ b.rows[columns].T


class Best:
    """The k best (score, id) of each query of a block so far."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), np.iinfo(np.int64).min)
        self.ids = np.full((n, k), np.iinfo(np.int64).max)

    def add(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        if not len(rows):
            return
        order = np.lexsort((ids, -scores.astype(np.float64), rows))
        order = order[np.lexsort((ids[order], ~scores[order], rows[order]))]
        rows, ids, scores = rows[order], ids[order], scores[order]
        first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(rows)], strict=True):
            q = rows[a]
            score = np.concatenate([self.score[q], scores[a:b][:self.k]])
            own = np.concatenate([self.ids[q], ids[a:b][:self.k]])
            best = np.lexsort((own, ~score))[:self.k]
            self.score[q], self.ids[q] = score[best], own[best]


def compare(queries: Block, block: Block, best: Best) -> dict[int, int]:
    """Take what ``block`` adds to the best of every query; how many pairs each level looked at.

    The coarsest bound is worked out for all pairs, a finer one only for the queries and candidates
    that a bound before has left, and the inner product for the pairs that all bounds leave. At
    every level the pairs of the highest bounds are scored at once, to have more to prune by.
    """
    floor = best.score[:, -1].astype(np.float64)
    floor[best.score[:, -1] == np.iinfo(np.int64).min] = -np.inf
    rows, columns = np.arange(len(queries.ids)), np.arange(len(block.ids))
    mask = np.ones((len(rows), len(columns)), bool)
    looked = {}
    for level in range(len(SEGMENTS)):
        looked[level] = len(rows) * len(columns)
        most = bound(queries, block, level, rows, columns)
        most[~mask] = -np.inf
        floor[rows] = np.maximum(floor[rows], _reached(queries, block, rows, columns, most, best.k))
        mask = most >= np.maximum(floor[rows], -1e300)[:, None]
        left, right = mask.any(axis=1), mask.any(axis=0)
        rows, columns, mask = rows[left], columns[right], mask[np.ix_(left, right)]
        if not len(rows):
            return looked
    looked[len(SEGMENTS)] = int(mask.sum())
    for begin in range(0, len(columns), AT_ONCE):
        part = slice(begin, begin + AT_ONCE)
        score, own = products(queries, block, rows, columns[part]), mask[:, part]
        own = own & (queries.ids[rows][:, None] != block.ids[columns[part]][None, :])
        # Of each query only what can be among its best goes on: ties with the k-th included.
        if own.shape[1] > best.k:
            kth = np.partition(np.where(own, score, np.iinfo(np.int64).min), -best.k, axis=1)[:, -best.k]
            own &= score >= np.maximum(kth, best.score[rows, -1])[:, None]
        r, c = np.nonzero(own)
        best.add(rows[r], block.ids[columns[part]][c], score[r, c])
    return looked


def _reached(queries: Block, block: Block, rows: np.ndarray, columns: np.ndarray, most: np.ndarray, k: int) -> np.ndarray:
    """For each query the k-th best score among its candidates of the highest bounds."""
    n = min(TRIED * (k + 1), len(columns))
    at = np.argpartition(-most, n - 1, axis=1)[:, :n]
    i, c = np.repeat(rows, n), columns[at.ravel()]
    if queries.largest * block.largest * queries.rows.shape[1] < 2.0 ** 53:
        score = np.einsum("ij,ij->i", queries.real[i], block.real[c])
    else:
        score = np.nextafter(np.einsum("ij,ij->i", queries.rows[i], block.rows[c]).astype(np.float64), -np.inf)
    score[(queries.ids[i] == block.ids[c]) | np.isneginf(np.take_along_axis(most, at, 1)).ravel()] = -np.inf
    score = -np.sort(-score.reshape(len(rows), n), axis=1)
    return score[:, k - 1] if n >= k else np.full(len(rows), -np.inf)


def top_k(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding",
          k: int = K, scale: int = SCALE, block_rows: int = CANDIDATES, query_rows: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` best candidates of each row where ``is_query``
    holds; it is a condition on ``vec_id``."""
    ship(vectors.sparkSession)
    rows = written(quantised(vectors, id_col, vector_col, scale).dropDuplicates(["vec_id", "q"]), "search-vectors")
    candidates = written(blocks(rows, block_rows), "search-candidates")
    asked = written(blocks(rows.where(is_query), query_rows), "search-queries")
    groups = max(1, -(-candidates.count() // GROUP_BLOCKS))
    dealt = asked.select("dim", F.col("block").alias("query"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"),
                         F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
    held = candidates.withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int"))
    met = dealt.join(held, ["dim", "group"]).withColumn("run", F.xxhash64("query", "group", "dim"))
    met = met.select("run", "block", "dim", "q_ids", "q_data", "ids", "data")

    def search(batches):
        for table, bounds in whole_keys(small(batches)):
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                dim = table.column("dim")[a].as_py()
                queries = Block(table.column("q_ids")[a].as_py(), table.column("q_data")[a].as_py(), dim)
                best = Best(len(queries.ids), k)
                for i in range(a, b):
                    compare(queries, Block(table.column("ids")[i].as_py(), table.column("data")[i].as_py(), dim), best)
                q, place = np.nonzero(best.ids != np.iinfo(np.int64).max)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(queries.ids[q]), pa.array(best.ids[q, place]), pa.array(best.score[q, place])],
                    names=["query_id", "vec_id", "score"])

    found = met.sortWithinPartitions("run", "block") if groups == 1 else met.repartition("run").sortWithinPartitions("run", "block")
    found = written(found.mapInArrow(search, "query_id long, vec_id long, score long"), "search-found")
    ranked = found.withColumn("rank", F.expr("row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def small(batches):
    """Batches of a few rows: a row here is two blocks of vectors."""
    for batch in batches:
        for at in range(0, batch.num_rows, 4):
            yield batch.slice(at, 4)


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


SQL = {"op10_topk_search": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id,
         CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
  WHERE a.vec_id % 100 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 10"""}
