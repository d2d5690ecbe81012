"""The trie of conversation prefixes, with subtree totals by time-forward processing.

A node is a sequence of turns (role, text) that some conversation begins with; it is known by
its depth and a 127-bit hash (see ``scans``). Nodes are laid out in shards by range of their path,
near enough depth first that most have their parent in the same shard, and no shard grows with
a popular prefix. Inside a shard nodes are sorted by reverse level order and each passes its
totals to its parent through a priority queue, whose content beyond a limit is spilled as sorted
runs. What is addressed to a parent in another shard leaves as one sum for each (shard, outside
parent): these are the nodes of a smaller tree over the shards' roots, solved in the same
way, and its totals are put into the queues of a last pass over the shards.

Order: turns of a conversation by turn number, null first; equal numbers by the SHA-256 of role
and text. A repeated row is a turn of its own. Nulls: rows without a conversation id are in no
conversation; a null role or text is empty. An empty table gives no nodes, not even a root. Very
long texts are digested where they are read and go no further. Other columns are not looked at.

The queues' spilled runs are anonymous files of the task that reads them again, gone with it; all
that one task leaves to another is in the shared folder.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from watchfold.llm import scans
from watchfold.llm.shared import ship, written
from watchfold.operators.skew import split_join

SHARD_ROWS = 1_000_000   # nodes of a shard, about
QUEUE_ROWS = 200_000     # messages a queue holds in memory
RUN_BLOCK = 2_000        # messages read back at once from a spilled run
IDS = 10_000             # conversation ids joined into one piece of text
ROOT = bytes(16)
#: One turn's own words, as in every other token count of this package.
WORD = r"[^\x20\x09-\x0D]+"


class SpillingQueue:
    """Messages (level, node, kids, leaves, saved), least (level, node) first."""

    def __init__(self, limit: int = QUEUE_ROWS):
        self.limit, self.heap, self.runs, self.spilled = limit, [], [], 0

    def push(self, message: tuple) -> None:
        heapq.heappush(self.heap, message)
        if len(self.heap) > self.limit:
            run = self._run(sorted(self.heap))
            self.heap, self.spilled = [], self.spilled + 1
            heapq.heappush(self.runs, (next(run), self.spilled, run))

    @staticmethod
    def _run(messages: list[tuple]) -> Iterator[tuple]:
        file = tempfile.TemporaryFile()  # this task's own; nameless
        for i in range(0, len(messages), RUN_BLOCK):
            pickle.dump(messages[i:i + RUN_BLOCK], file)
        blocks = -(-len(messages) // RUN_BLOCK)
        messages.clear()
        file.seek(0)

        def read() -> Iterator[tuple]:
            with file:
                for _ in range(blocks):
                    yield from pickle.load(file)
        return read()

    def least(self) -> tuple | None:
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            return self.runs[0][0]
        return self.heap[0] if self.heap else None

    def pop(self) -> tuple:
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            message, number, run = self.runs[0]
            following = next(run, None)
            if following is None:
                heapq.heappop(self.runs)
            else:
                heapq.heapreplace(self.runs, (following, number, run))
            return message
        return heapq.heappop(self.heap)


UP = "outside boolean, shard int, level long, node binary, kids long, leaves long, saved long"
DOWN = "shard int, level long, node binary, top binary, top_level long"
_UP_TYPES = [pa.bool_(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
_DOWN_TYPES = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64()]


def _emitted(rows: Iterator[tuple], names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    schema, held = pa.schema(list(zip(names, types, strict=True))), []
    for row in rows:
        held.append(row)
        if len(held) >= scans.OUT_ROWS:
            yield scans._batch(held, schema)
            held = []
    if held:
        yield scans._batch(held, schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)


def _upward(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Totals of each node over what the shard holds of its subtree, and sums for outside parents.

    Rows (shard, level, node, up, parent, kids, leaves, saved), a shard's deepest level first.
    """
    def outside(shard: int, queue: SpillingQueue, until: tuple | None) -> Iterator[tuple]:
        while (m := queue.least()) is not None and (until is None or m[:2] < until):
            at, kids, leaves, saved = m[:2], 0, 0, 0
            while m is not None and m[:2] == at:
                queue.pop()
                kids, leaves, saved = kids + m[2], leaves + m[3], saved + m[4]
                m = queue.least()
            yield True, shard, -at[0], at[1], kids, leaves, saved

    def process() -> Iterator[tuple]:
        now, queue = None, SpillingQueue(limit)
        for shard, level, node, up, parent, kids, leaves, saved in _rows(batches):
            if shard != now:
                if now is not None:
                    yield from outside(now, queue, None)
                now = shard
            here = (-level, node)
            yield from outside(shard, queue, here)
            while (m := queue.least()) is not None and m[:2] == here:
                queue.pop()
                kids, leaves, saved = kids + m[2], leaves + m[3], saved + m[4]
            yield False, shard, level, node, kids, leaves, saved
            if parent is not None:
                queue.push((-up, parent, 1, leaves, saved))
        if now is not None:
            yield from outside(now, queue, None)

    return _emitted(process(), ["outside", "shard", "level", "node", "kids", "leaves", "saved"], _UP_TYPES)


def _downward(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """For each node the nearest ancestor outside its shard. Rows (shard, up, parent, level, node),
    the highest parents first; a node leaves word of its top under its own (level, node)."""
    def process() -> Iterator[tuple]:
        now, queue = None, SpillingQueue(limit)
        for shard, up, parent, level, node in _rows(batches):
            if shard != now:
                now, queue = shard, SpillingQueue(limit)
            top, top_level = parent, up
            if parent is not None:
                while (m := queue.least()) is not None and m[:2] < (up, parent):
                    queue.pop()
                if m is not None and m[:2] == (up, parent):  # stays: brothers read it too
                    top, top_level = m[2] or None, m[3]
            yield shard, level, node, top, top_level
            queue.push((level, node, top or b"", top_level))

    return _emitted(process(), ["shard", "level", "node", "top", "top_level"], _DOWN_TYPES)


def _up(placed: DataFrame, limit: int) -> DataFrame:
    rows = placed.select("shard", "level", "node", "up", "parent", "kids", "leaves", "saved").repartition("shard")
    rows = rows.sortWithinPartitions("shard", F.desc("level"), "node")
    return rows.mapInArrow(lambda batches: _upward(batches, limit), UP)


def _down(placed: DataFrame, limit: int) -> DataFrame:
    rows = placed.select("shard", "up", "parent", "level", "node").repartition("shard")
    rows = rows.sortWithinPartitions("shard", F.asc_nulls_first("up"), "parent", "level")
    return rows.mapInArrow(lambda batches: _downward(batches, limit), DOWN)


def subtree_totals(tree: DataFrame, shard_rows: int = SHARD_ROWS, queue_rows: int = QUEUE_ROWS,
                   least_shards: int | None = None, one_shard: bool = False) -> DataFrame:
    """Rows (node, kids, leaves, saved), each summed over the node's subtree but for ``kids``, its
    direct children.

    ``tree`` is a written table (node, level, parent, up, path, leaves, saved): ``up`` is the
    parent's level, less than the node's; the root's parent is null.
    """
    ship(tree.sparkSession)
    count = tree.count()
    if least_shards is None:
        least_shards = int(tree.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = 1 if one_shard else max(least_shards, -(-count // shard_rows))
    tree = tree.withColumn("kids", F.lit(0).cast("long"))
    if shards == 1:
        alone = tree.withColumn("shard", F.lit(0))
        return written(_up(alone, queue_rows).where("NOT outside"), "trie-totals").select("node", "kids", "leaves", "saved")
    placed = tree.repartitionByRange(shards, "path", "level", "node").withColumn("shard", F.spark_partition_id())
    placed = written(placed, "trie-shards")
    sums = written(_up(placed, queue_rows), "trie-up")
    outside = sums.where("outside").select(
        F.col("shard").alias("from"), F.col("node").alias("p"), F.col("level").alias("p_level"), "kids", "leaves", "saved")
    left = outside.count()
    if not left:
        return sums.where("NOT outside").select("node", "kids", "leaves", "saved")
    # The tree over shard roots: one node for each (shard, outside parent).
    wanted = outside.select(F.col("p").alias("node")).distinct()
    tops = _down(placed, queue_rows).join(wanted, "node", "left_semi").select(
        F.col("node").alias("p"), F.col("shard").alias("p_shard"), "top", "top_level")
    paths = placed.join(wanted, "node", "left_semi").select(F.col("node").alias("p"), "path")

    def named(shard: str, node: str) -> Column:
        return F.concat(F.unhex(F.lpad(F.hex(F.col(shard)), 8, "0")), F.col(node))

    upper = outside.join(tops, "p").join(paths, "p").select(
        named("from", "p").alias("node"), (F.col("p_level") + 1).alias("level"), named("p_shard", "top").alias("parent"),
        F.when(F.col("top").isNotNull(), F.col("top_level") + 1).alias("up"), "path", "leaves", "saved")
    upper = written(upper, "trie-roots")
    # A tree that does not shrink any more is one shard's; its queue spills.
    totals = subtree_totals(upper, shard_rows, queue_rows, 1, one_shard=2 * left > count)
    come = outside.select(named("from", "p").alias("node"), "p", F.col("kids").alias("k")).join(
        totals.select("node", "leaves", "saved"), "node")
    come = come.groupBy(F.col("p").alias("node")).agg(
        F.sum("k").alias("k"), F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
    zero = F.lit(0)
    full = placed.join(come, "node", "left").withColumns({
        "kids": F.coalesce("k", zero), "leaves": F.col("leaves") + F.coalesce("l", zero),
        "saved": F.col("saved") + F.coalesce("s", zero)})
    done = written(_up(full, queue_rows).where("NOT outside"), "trie-totals")
    return done.select("node", "kids", "leaves", "saved")


def digested(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
             text_col: str = "text") -> DataFrame:
    """(key, turn, element, words): a turn as a digest of its role and text and its word count."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    body = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).alias("key"), F.col(turn_col).alias("turn"),
        F.unhex(F.substring(F.sha2(body, 256), 1, 30)).alias("element"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))


def prefix_trie(rows: DataFrame, order: list[Column], members: DataFrame, shard_rows: int = SHARD_ROWS,
                queue_rows: int = QUEUE_ROWS, least_shards: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and ends of the trie over ``rows`` (key, element, words, and ``order``'s columns).

    ``members`` has one row for each ``key``, those without turns included. Nodes: node, depth,
    conv_id (smallest member), parent_conv_id, n_convs, n_children, n_leaves, saved_tokens. Ends:
    (node, conv_id) of each conversation's last node.
    """
    turns = written(scans.running(rows, order, "trie-turns", shard_rows), "trie-turns")
    silent = members.join(turns.where("n = 1").select("key"), "key", "left_anti")
    ends = turns.where("last").select(F.col("hash").alias("node"), F.col("key").alias("conv_id")).unionByName(
        silent.select(F.lit(ROOT).alias("node"), F.col("key").alias("conv_id")))
    # Parent and path follow from the node; as grouping keys they need no sorting aggregate.
    nodes = turns.groupBy(F.col("n").alias("level"), F.col("hash").alias("node"), F.col("before").alias("parent"), "path").agg(
        F.min("key").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("words").alias("words"),
        F.count_if("last").alias("n_ends"))
    root = members.agg(F.min("key").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0").select(
        F.lit(0).cast("long").alias("level"), F.lit(ROOT).alias("node"), "conv_id", "n_convs",
        F.lit(0).cast("long").alias("words"), F.lit(None).cast("binary").alias("parent"), F.lit(b"").alias("path"),
        F.lit(-1).cast("long").alias("n_ends"))
    nodes = written(nodes.unionByName(root), "trie-nodes")
    leaf = (F.col("n_ends") == F.col("n_convs")).cast("long")
    if turns.isEmpty():  # the root alone
        leaf = F.lit(1).cast("long")
    tree = nodes.select("node", "level", "parent", F.when(F.col("parent").isNotNull(), F.col("level") - 1).alias("up"),
                        "path", leaf.alias("leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    totals = subtree_totals(tree, shard_rows, queue_rows, least_shards)
    above = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = split_join(nodes, above, ["parent"], "left", ["node"]).join(totals, "node")
    out = out.select("node", F.col("level").alias("depth"), "conv_id", "parent_conv_id", "n_convs",
                     F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    return out, ends


def conversation_trie(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                      text_col: str = "text", **sizes: int) -> tuple[DataFrame, DataFrame]:
    """``prefix_trie`` of a table of turns."""
    rows = written(digested(turns, conv_col, turn_col, role_col, text_col), "trie-rows")
    members = rows.groupBy("key").agg(F.lit(1)).select("key")
    return prefix_trie(rows, [F.asc_nulls_first("turn"), F.col("element")], members, **sizes)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces (node, first, ids) of at most ``IDS`` ids from rows sorted by (node, conv_id)."""
    def process() -> Iterator[tuple]:
        now, ids = None, []
        for node, conv in _rows(batches):
            if ids and (node != now or len(ids) >= IDS):
                yield now, ids[0], ",".join(map(str, ids))
                ids = []
            now = node
            ids.append(conv)
        if ids:
            yield now, ids[0], ",".join(map(str, ids))
    return _emitted(process(), ["node", "first", "ids"], [pa.binary(), pa.int64(), pa.string()])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's pieces in order, one piece at a time."""
    def process() -> Iterator[tuple]:
        now = state = None
        for node, _, ids in _rows(batches):
            if node != now:
                if now is not None:
                    yield now, state.hexdigest()
                now, state = node, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        if now is not None:
            yield now, state.hexdigest()
    return _emitted(process(), ["node", "ends_sha256"], [pa.binary(), pa.string()])


def ends_digest(ends: DataFrame) -> DataFrame:
    """(node, SHA-256 of its conversation ids, ascending and joined by commas).

    The ids of one node may lie in many partitions, each of which joins its own; the digest then
    reads the pieces in order, as a hash over one text must, holding one at a time.
    """
    ends = written(ends.withColumn("conv_id", F.col("conv_id").cast("long")), "trie-ends")
    ship(ends.sparkSession)
    ordered = ends.repartitionByRange(scans.partitions(ends), "node", "conv_id").sortWithinPartitions("node", "conv_id")
    pieces = written(ordered.mapInArrow(_joined, "node binary, first long, ids string"), "trie-ids")
    pieces = pieces.repartition("node").sortWithinPartitions("node", "first")
    return pieces.mapInArrow(_hashed, "node binary, ends_sha256 string")


def rebuilt(rows: DataFrame, share: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Digested turns after conversation c took the first h turns of c - c % ``share`` in place of
    its own first h, h = crc32(c) % ``most``; and all conversations."""
    numbered = written(scans.running(rows, [F.asc_nulls_first("turn"), F.col("element")], "trie-numbered"), "trie-numbered")
    taken = F.crc32(F.col("key").cast("string").cast("binary")) % most
    first = numbered.where("n = 1").select("key", taken.alias("h"), (F.col("key") - F.col("key") % share).alias("base"))
    heads = numbered.where((F.col("n") < most) & (F.col("key") % share == 0)).select(
        F.col("key").alias("base"), "element", "words", "n")
    heads = first.join(heads, "base").where("n <= h").select("key", F.lit(0).alias("own"), "n", "element", "words")
    own = numbered.where(F.col("n") > taken).select("key", F.lit(1).alias("own"), "n", "element", "words")
    return written(heads.unionByName(own), "trie-rebuilt"), first.select("key")


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(digested(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "trie-rows")
    turns, members = rebuilt(rows)
    nodes, ends = prefix_trie(turns, [F.col("own"), F.col("n")], members)
    out = nodes.join(ends_digest(ends), "node", "left")
    return out.select(
        F.col("conv_id").cast("long").alias("conv_id"), "depth", F.col("parent_conv_id").cast("long").alias("parent_conv_id"),
        "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))


SQL = {"op11_conversation_trie": r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (
    PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS n
  FROM conversations WHERE conv_id IS NOT NULL
), bytes AS (
  SELECT DISTINCT conv_id, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ord(c)::BIGINT) AS b FROM t
), c AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, xor(list_reduce(b, lambda crc, byte:
    list_reduce(range(8), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, xor(crc, byte)),
    4294967295::BIGINT), 4294967295) % 4 AS h FROM bytes
), r AS (
  SELECT c.conv_id, 0 AS own, t.n, t.role, t.text FROM c JOIN t ON t.conv_id = c.base WHERE t.n <= c.h
  UNION ALL SELECT c.conv_id, 1, t.n, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id WHERE t.n > c.h
), d AS (
  SELECT conv_id, row_number() OVER w AS depth, count(*) OVER (PARTITION BY conv_id) AS turns,
    len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
    string_agg(sha256(strlen(role) || ':' || role || text), '') OVER w AS path
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY own, n ROWS UNBOUNDED PRECEDING)
), m AS (
  SELECT conv_id, depth, turns, words, path, substr(path, 1, (64 * (depth - 1))::BIGINT) AS above FROM d
  UNION ALL SELECT c.conv_id, 0, coalesce(max(d.turns), 0), 0, '', NULL FROM c LEFT JOIN d ON d.conv_id = c.conv_id GROUP BY c.conv_id
), node AS (
  SELECT path, min(above) AS above, min(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, min(words) AS words,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE turns = depth), '')) AS ends_sha256
  FROM m GROUP BY path
), kids AS (
  SELECT above, count(*) AS n FROM node GROUP BY above
), anc AS (
  SELECT DISTINCT n.path, n.n_convs, n.words, (k.n IS NULL) AS leaf, substr(n.path, 1, (64 * i.i)::BIGINT) AS top
  FROM (SELECT node.*, unnest(range(depth + 1)) AS i FROM node) i JOIN node n ON n.path = i.path LEFT JOIN kids k ON k.above = n.path
), total AS (
  SELECT top, sum(leaf::BIGINT)::BIGINT AS n_leaves, sum((n_convs - 1) * words)::BIGINT AS saved_tokens FROM anc GROUP BY top
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, t.n_leaves, t.saved_tokens, n.ends_sha256
FROM node n JOIN total t ON t.top = n.path LEFT JOIN node p ON p.path = n.above LEFT JOIN kids k ON k.above = n.path"""}
