"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

A word is a run of ASCII letters, digits and characters beyond ASCII of the lower-cased text; a
shingle is five words in a row (all words of a text that has one to four). Texts of equal
shingle sets are one class of copies, spoken for by its smallest id.

* Signatures: one minimum for each of ``TREES * DEPTH`` hash functions.
* Forest: in each tree the minima are a string; texts that share a prefix of it are candidates.
  The matched prefix is shortened from ``DEPTH`` until a pair at the threshold is found with
  probability ``recall``. In a bucket (tree, prefix) texts are taken in trie order, and joined
  where their signatures agree as those of similar texts do. Only joins are passed on, fewer
  than the bucket has rows, so a bucket of many near copies makes no pairs.
* Verification: for each connected group of candidates all similarities are computed exactly,
  in blocks of bounded size. Groups may hold any number of texts: larger ones are dealt to block
  pairs. Only counts of links and a spanning forest leave a task.

A pair is linked when its Jaccard similarity is at least ``threshold``; classes are the
connected groups of links, named by their smallest id.

Texts without a word and null texts have no shingles and no links: each is its own class. Rows
with the same id count as one document. A row without an id takes no part: its class is null.
An empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchfold.llm.shared import components, documents, in_blocks, ship, short_batches, unused, whole_keys, written

WORDS = 5
THRESHOLD = (4, 5)   # as a fraction
RECALL = 0.9995      # of a pair at the threshold to meet in the forest
TREES, DEPTH = 16, 6
AGREE = 0.6          # share of equal minima below which a pair is no candidate; nearly five
                     # standard deviations under the threshold for TREES * DEPTH minima
BLOCK_ROWS = 50_000      # signatures compared in one task
BLOCK_SHINGLES = 1 << 20  # shingles of a block, and
BLOCK_TEXTS = 2_000       # its texts; two blocks are compared in one run
CHUNK = 1 << 21          # bytes of text in work at a time

_WORD = np.zeros(256, bool)
_WORD[ord("0"):ord("9") + 1] = _WORD[ord("a"):ord("z") + 1] = _WORD[128:] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
HASH_BITS = 48


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & _MASK, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Shingler:
    """Distinct shingle hashes of many texts at once."""

    def __init__(self, words: int = WORDS):
        self.words = words
        self.up = _powers(_BASE, 1 << 12)
        self.down = _powers(pow(_BASE, -1, 1 << 64), 1 << 12)
        self.place = mix(np.arange(1, words + 1, dtype=np.uint64)) | np.uint64(1)

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            n = 1 << int(n - 1).bit_length()
            self.up, self.down = _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)

    def chunk(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text number, hash) pairs, distinct and sorted, of lower-cased UTF-8 texts."""
        data = data[offsets[0]:offsets[-1]]
        offsets = offsets - offsets[0]
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        self._grow(len(data) + 1)
        mask = _WORD[data]
        before, after = np.empty_like(mask), np.empty_like(mask)
        before[1:], after[:-1] = mask[:-1], mask[1:]
        edges = offsets[:-1][offsets[:-1] < len(data)]
        before[edges] = False
        edges = offsets[1:][offsets[1:] > 0] - 1
        after[edges] = False
        start, end = np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1
        if not len(start):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[:len(data)], out=total[1:])
        word = mix((total[end] - total[start]) * self.down[start])
        of = np.searchsorted(offsets, start, "right") - 1
        n = np.bincount(of, minlength=len(offsets) - 1)
        k = self.words
        hashes, owner = [], []
        if len(word) >= k:
            full = of[:len(of) - k + 1] == of[k - 1:]
            value = np.zeros(len(word) - k + 1, np.uint64)
            for j in range(k):
                value += word[j:len(word) - k + 1 + j] * self.place[j]
            hashes.append(value[full])
            owner.append(of[:len(of) - k + 1][full])
        few = np.flatnonzero((n > 0) & (n < k))
        if len(few):
            inside = np.flatnonzero((n[of] < k))
            first = np.concatenate([[0], np.cumsum(n)])[of[inside]]
            part = word[inside] * self.place[inside - first]
            value = np.zeros(len(n), np.uint64)
            np.add.at(value, of[inside], part)
            hashes.append(value[few] + n[few].astype(np.uint64))
            owner.append(few)
        value, of = mix(np.concatenate(hashes)), np.concatenate(owner)
        # One sort gives both: the text's number above the hash.
        both = (of.astype(np.uint64) << np.uint64(HASH_BITS)) | (value >> np.uint64(64 - HASH_BITS))
        both.sort()
        keep = np.ones(len(both), bool)
        keep[1:] = both[1:] != both[:-1]
        both = both[keep]
        return (both >> np.uint64(HASH_BITS)).astype(np.int64), both & np.uint64((1 << HASH_BITS) - 1)

    def batches(self, texts: pa.Array):
        """(first text, last text, text numbers, hashes) for chunks of whole texts."""
        low = pc.utf8_lower(pc.fill_null(texts, ""))
        if isinstance(low, pa.ChunkedArray):
            low = low.combine_chunks()
        if not len(low):
            return
        kind = np.int64 if pa.types.is_large_string(low.type) else np.int32
        offsets = np.frombuffer(low.buffers()[1], kind)[low.offset:low.offset + len(low) + 1].astype(np.int64)
        data = low.buffers()[2]
        data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
        at = 0
        while at < len(low):
            to = int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1
            to = min(max(to, at + 1), at + 60_000, len(low))
            of, value = self.chunk(data, offsets[at:to + 1])
            yield at, to, of, value
            at = to


def _functions() -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * TREES * DEPTH + 1, dtype=np.uint64))
    return (seeds[::2] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (seeds[1::2] >> np.uint64(32)).astype(np.uint32)


def minima(of: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """(n, TREES * DEPTH) minima; texts without shingles get the largest number."""
    out = np.full((n, TREES * DEPTH), 0xFFFFFFFF, np.uint32)
    if not len(of):
        return out
    first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    some = of[first]
    folded = (value ^ (value >> np.uint64(16))).astype(np.uint32)
    for i, (a, b) in enumerate(zip(*_functions(), strict=True)):
        hashed = folded * a + b
        hashed ^= hashed >> np.uint32(15)
        hashed *= np.uint32(0x2C1B3C6D)
        out[some, i] = np.minimum.reduceat(hashed, first)
    return out


SIGNATURE = "id long, text_key long, n int, set_key binary, minima binary"


def sign(batches):
    """(id, text_key, text) to ``SIGNATURE`` rows."""
    shingler = Shingler()
    for batch in batches:
        for at, to, of, value in shingler.batches(batch.column(2)):
            n = np.bincount(of, minlength=to - at)
            sums = np.zeros((to - at, 2), np.uint64)
            if len(of):
                first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
                spread = mix(value + np.uint64(1))
                sums[of[first], 0] = np.add.reduceat(spread, first)
                sums[of[first], 1] = np.add.reduceat(mix(spread), first)
            least = minima(of, value, to - at)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(at, to - at), batch.column(1).slice(at, to - at),
                pa.array(n.astype(np.int32)),
                pa.array([r.tobytes() for r in sums], pa.binary()),
                pa.array([r.tobytes() for r in least], pa.binary())],
                names=["id", "text_key", "n", "set_key", "minima"])


def matched_depth(recall: float = RECALL, threshold: float = THRESHOLD[0] / THRESHOLD[1]) -> int:
    """The longest prefix at which the forest still has the recall."""
    depth = DEPTH
    while depth > 1 and 1 - (1 - threshold ** depth) ** TREES < recall:
        depth -= 1
    return depth


def _join_similar(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> np.ndarray:
    """Least row of each row's group, where ``near(row, rows)`` tells which rows join a row.

    Rows that have found a group are not compared again, so many near copies cost one pass.
    """
    root = np.arange(n)
    left = np.arange(n)
    for i in range(n):
        if not len(left):
            break
        if left[0] != i:
            continue
        queue, left = [i], left[1:]
        while queue and len(left):
            found = near(queue.pop(), left)
            if found.any():
                hit = left[found]
                root[hit] = i
                queue.extend(hit.tolist())
                left = left[~found]
    return root


def candidates(batches):
    """Rows (run, rest, id, low) in trie order (``rest`` continues the run's prefix) to the joins
    (a, b) found in each run."""
    least = int(np.ceil(AGREE * TREES * DEPTH))
    for table, bounds in whole_keys(batches):
        ids = table.column("id").to_numpy()
        low = table.column("low").combine_chunks()
        width = TREES * DEPTH
        rows = np.frombuffer(b"".join(low.to_pylist()), np.uint8).reshape(-1, width)
        a, b = [], []
        for at, to in zip(bounds[:-1], bounds[1:], strict=True):
            if to - at == 2:
                if ids[at] != ids[at + 1] and (rows[at] == rows[at + 1]).sum() >= least:
                    a.append(ids[at:at + 1])
                    b.append(ids[at + 1:at + 2])
                continue
            if to - at < 2:
                continue
            part, own = rows[at:to], ids[at:to]
            root = _join_similar(to - at, lambda i, left, part=part: (part[left] == part[i]).sum(axis=1) >= least)
            moved = np.flatnonzero(root != np.arange(len(root)))
            a.append(own[moved])
            b.append(own[root[moved]])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])


def common(of: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """(n, n) numbers of shared hashes. Hashes of many texts go through a matrix product,
    hashes of few through their pairs."""
    order = np.argsort(value, kind="stable")
    value, of = value[order], of[order]
    first = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
    size = np.diff(np.append(first, len(value)))
    out = np.zeros((n, n), np.float32)
    flat = out.reshape(-1)
    many = 32 if n > 64 else 2
    for d in np.unique(size[(size > 1) & (size < many)]).tolist():
        member = of[first[size == d][:, None] + np.arange(d)]
        for i in range(d):
            for j in range(i + 1, d):
                # Equal pairs are counted before they are added.
                pair, times = np.unique(member[:, i] * n + member[:, j], return_counts=True)
                flat[pair] += times
    big = np.flatnonzero(size >= many)
    out += out.T
    for begin in range(0, len(big), 2048):
        columns = big[begin:begin + 2048]
        matrix = np.zeros((len(columns), n), np.float32)
        at = np.repeat(np.arange(len(columns)), size[columns])
        entry = np.repeat(first[columns] - np.concatenate([[0], np.cumsum(size[columns])[:-1]]), size[columns])
        matrix[at, of[entry + np.arange(len(at))]] = 1
        out += matrix.T @ matrix
    return out


def verify(batches):
    """Rows (run, side, same, id, text) sorted by run to (id, links, root): exact links."""
    p, q = THRESHOLD
    shingler = Shingler()
    for table, bounds in whole_keys(batches):
        for at, to in zip(bounds[:-1], bounds[1:], strict=True):
            part = table.slice(at, to - at)
            ids, one = np.unique(part.column("id").to_numpy(), return_index=True)
            part = part.take(one)
            side, same = part.column("side").to_numpy(), part.column("same")[0].as_py()
            ofs, values = [], []
            for first, _, of, value in shingler.batches(part.column("text")):
                ofs.append(of + first)
                values.append(value)
            of, value = np.concatenate(ofs), np.concatenate(values)
            n = np.bincount(of, minlength=len(ids))
            shared = common(of, value, len(ids))
            linked = (p + q) * shared.astype(np.int64) >= p * (n[:, None] + n[None, :])
            np.fill_diagonal(linked, False)
            # Between two blocks only pairs across them are new.
            counted = linked if same else linked & (side[:, None] != side[None, :])
            links = counted.sum(axis=1)
            root = _join_similar(len(ids), lambda i, left, linked=linked: linked[i, left])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links.astype(np.int64)), pa.array(ids[root])],
                                             names=["id", "links", "root"])


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", recall: float = RECALL,
                 block_rows: int = BLOCK_ROWS, block_shingles: int = BLOCK_SHINGLES,
                 block_texts: int = BLOCK_TEXTS) -> DataFrame:
    """One row for each row of ``docs``: id, class_id, n_links (linked texts with another
    shingle set), n_copies (rows with the same shingle set), n_shingles."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_key"),
                       F.col(text_col).alias("text"))
    signed = written(rows.mapInArrow(sign, SIGNATURE), "near-signatures")
    usable = signed.where("n > 0 AND id IS NOT NULL")
    speaker = F.min(F.struct("id", "text_key")).alias("speaker")
    classes = usable.groupBy("set_key").agg(speaker, F.count("*").alias("n_copies"), F.first("n").alias("n"))
    classes = written(classes.select("set_key", F.col("speaker.id").alias("rep"),
                                     F.col("speaker.text_key").alias("text_key"), "n_copies", "n"), "near-classes")
    speakers = usable.join(classes.select(F.col("rep").alias("id"), "text_key", "set_key"),
                           ["id", "text_key", "set_key"], "left_semi").dropDuplicates(["id", "text_key"])
    # The low bytes of all minima are enough to compare two signatures.
    low = F.concat(*[F.substring("minima", 4 * i + 1, 1) for i in range(TREES * DEPTH)])
    speakers = written(speakers.select("id", "minima", low.alias("low")), "near-speakers")

    depth = matched_depth(recall)
    branch = F.explode(F.array(*[F.struct(
        F.xxhash64(F.lit(t), F.substring("minima", 4 * DEPTH * t + 1, 4 * depth)).alias("bucket"),
        F.substring("minima", 4 * (DEPTH * t + depth) + 1, 4 * (DEPTH - depth)).alias("rest"))
        for t in range(TREES)]))
    forest = speakers.select("id", branch.alias("branch")).select("id", "branch.bucket", "branch.rest")
    blocks = F.ceil(F.col("rows") / block_rows).cast("int").alias("blocks")
    shared = written(forest.groupBy("bucket").agg(F.count("*").alias("rows")).where("rows > 1")
                     .select("bucket", blocks), "near-buckets")
    met = in_blocks(forest, shared, "bucket", "id").select("run", "rest", "id")
    met = met.join(speakers.select("id", "low"), "id").select("run", "rest", "id", "low")
    pairs = met.repartition("run").sortWithinPartitions("run", "rest", "id").mapInArrow(candidates, "a long, b long")
    group = written(components(pairs), "near-groups")
    roots = group.select("root").distinct().select(F.col("root").alias("node"), "root")
    group = group.union(roots)

    sized = group.join(classes.select(F.col("rep").alias("node"), "text_key", "n"), "node")
    sized = written(sized, "near-members")
    blocks = F.ceil(F.greatest(F.sum("n") / block_shingles, F.count("*") / block_texts)).cast("int")
    sizes = sized.groupBy("root").agg(blocks.alias("blocks"))
    dealt = in_blocks(sized.select("root", F.col("node").alias("id"), "text_key"), sizes, "root", "id")
    dealt = dealt.select("run", "side", "same", "id", "text_key")
    # By merging at every size: the texts are the larger side, and the other grows with them.
    texts = rows.join(dealt.hint("merge"), ["id", "text_key"]).select("run", "side", "same", "id", "text")
    links = texts.repartition("run").sortWithinPartitions("run", "id").mapInArrow(
        verify, "id long, links long, root long")
    links = written(links, "near-links")
    final = components(links.select(F.col("id").alias("a"), F.col("root").alias("b")))
    counts = links.groupBy("id").agg(F.sum("links").alias("n_links"))
    named = counts.join(final.withColumnRenamed("node", "id"), "id", "left")
    named = classes.join(named.withColumnRenamed("id", "rep"), "rep", "left").select(
        "set_key", F.coalesce("root", "rep").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "n_copies")
    out = signed.select("id", "n", F.when(F.col("id").isNotNull(), F.col("set_key")).alias("set_key"))
    out = out.join(written(named, "near-named"), "set_key", "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("class_id", "id").alias("class_id"),
                      F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"),
                      F.col("n").cast("long").alias("n_shingles"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the smallest id of each class only, all columns kept."""
    short_batches(docs.sparkSession)
    found = jaccard_join(docs, id_col, text_col).where(F.col("class_id") != F.col(id_col))
    own_id, = unused(docs, "near_id")
    gone = written(found.select(F.col(id_col).cast("long").alias(own_id)).distinct(), "near-dropped")
    keyed = docs.withColumn(own_id, F.col(id_col).cast("long"))
    return keyed.join(gone.hint("merge"), own_id, "left_anti").drop(own_id)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(documents(spark, sf_dir))
