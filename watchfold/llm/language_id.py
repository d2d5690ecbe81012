"""Language identification by prediction by partial matching over bytes.

For every language a context tree of order ``ORDER`` is counted on a bounded sample of labelled
rows and then frozen. A byte costs ``-log2 n(c, s) / (T(c) + D(c))`` bits under the longest known
context c that has seen it; every longer context that has not pays its escape
``-log2 D(c) / (T(c) + D(c))`` first (T: bytes seen after c, D: different ones); below order 0
all 256 bytes are equal. A text's code length is the sum over its whole bytes, in units of
2**-16 bit and whole numbers, so it does not depend on how rows are batched. The language with
the shortest code wins, ties to the smaller name; the score is its posterior under equal priors.

Null texts and texts without a letter are ``und`` with score 0 and no code length. Null
languages are not learned from. An empty table, or one without labels, predicts ``und`` for all.
Other columns are carried along or ignored, whatever their names.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from watchfold.llm.shared import documents, in_worker, ship, short_batches, unused

ORDER = 3
UNIT = 1 << 16              # parts of a bit
ROWS_PER_LANGUAGE = 2_000   # labelled rows that a language is learned from, at most
MOST_LANGUAGES = 1_000      # more end the job: each has a column of costs in every worker
CUT_BITS = 14               # of the hash by which rows are counted first
PAD = "\0" * ORDER          # context of a text's first bytes
STEP = 1 << 18              # positions scored at a time
UNKNOWN = "und"


def padded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one byte array, each after ``ORDER`` zero bytes, and where each begins."""
    joined = pc.binary_join_element_wise(pa.scalar(PAD), pc.fill_null(texts, ""), "")
    if isinstance(joined, pa.ChunkedArray):
        joined = joined.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(joined.type) else np.int32
    offsets = np.frombuffer(joined.buffers()[1], kind)[joined.offset:joined.offset + len(joined) + 1]
    data = joined.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data, offsets.astype(np.int64)


def grams(data: np.ndarray, begin: int, end: int) -> np.ndarray:
    """Code of the bytes at i - ORDER .. i for every i in [begin, end), begin >= ORDER."""
    code = data[begin - ORDER:end - ORDER].astype(np.uint32)
    for k in range(ORDER - 1, -1, -1):
        code = (code << np.uint32(8)) | data[begin - k:end - k]
    return code


def counted(batches):
    """(lang, gram, n) of each batch of (lang, text) rows."""
    for batch in batches:
        langs, texts = batch.column(0), batch.column(1)
        for lang in pc.unique(langs).to_pylist():
            data, offsets = padded(texts.filter(pc.equal(langs, lang)))
            if len(data) <= ORDER:
                continue
            inside = np.ones(len(data), bool)
            for k in range(ORDER):
                inside[offsets[:-1] + k] = False
            code, n = np.unique(grams(data, ORDER, len(data))[inside[ORDER:]], return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(code), pa.string()), pa.array(code.astype(np.int64)),
                 pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])


def learn(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          rows_per_language: int = ROWS_PER_LANGUAGE) -> dict:
    """The frozen statistics: language names and their counts of ``ORDER + 1`` bytes.

    The sample of a language is its first ``rows_per_language`` rows in the order of a hash of
    the id. The ids' cut is found on hashes alone, so no text moves for it. All counts of that
    sample come to the driver: a text adds at most one for each of its bytes, and far fewer when
    the language's usual ones are known.
    """
    ship(rows.sparkSession)
    labelled = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"),
                           F.xxhash64(id_col).alias("h")).where("lang IS NOT NULL AND text IS NOT NULL")
    # The bucket of hashes that the cut lies in, from counts; only rows up to it are ranked.
    upto = Window.partitionBy("lang").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bucket = F.shiftright("h", 64 - CUT_BITS)
    buckets = labelled.groupBy("lang", bucket.alias("bucket")).count().withColumn(
        "before", F.coalesce(F.sum("count").over(upto), F.lit(0)))
    last = buckets.where(F.col("before") < rows_per_language).groupBy("lang").agg(F.max("bucket").alias("bucket"))
    last = last.limit(MOST_LANGUAGES + 1).collect()
    if len(last) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages; is {lang_col} a language?")
    near = F.lit(False)
    for r in last:
        near = near | ((F.col("lang") == r["lang"]) & (bucket <= r["bucket"]))
    ranked = labelled.where(near).select("lang", "h").withColumn("_rn", F.expr(
        "row_number() OVER (PARTITION BY lang ORDER BY h)")).where(F.col("_rn") <= rows_per_language)
    cuts = ranked.groupBy("lang").agg(F.max("h").alias("cut")).collect()
    names = sorted(r["lang"] for r in cuts)
    if not names:
        return {"names": [], "gram": np.zeros(0, np.uint32), "n": np.zeros((0, 0), np.int64)}
    chosen = F.lit(False)
    for r in cuts:
        chosen = chosen | ((F.col("lang") == r["lang"]) & (F.col("h") <= r["cut"]))
    counts = labelled.where(chosen).select("lang", "text").mapInArrow(counted, "lang string, gram long, n long")
    table = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    gram = table.column("gram").to_numpy().astype(np.uint32)
    lang = np.searchsorted(np.array(names), np.array(table.column("lang").to_pylist()))
    code, at = np.unique(gram, return_inverse=True)
    n = np.zeros((len(code), len(names)), np.int64)
    n[at, lang] = table.column("n").to_numpy()
    return {"names": names, "gram": code, "n": n}


class Table:
    """Rows of sorted 32-bit codes, found by open addressing."""

    def __init__(self, codes: np.ndarray):
        self.bits = max(8, int(len(codes) * 4).bit_length())
        self.rows = np.full(1 << self.bits, -1, np.int32)
        self.keys = np.zeros(1 << self.bits, np.uint32)
        left, at = np.arange(len(codes)), self._home(codes)
        while len(left):
            free = self.rows[at] < 0
            place, first = np.unique(np.where(free, at, -1), return_index=True)
            first = first[place >= 0]
            self.rows[at[first]] = left[first]
            self.keys[at[first]] = codes[left[first]]
            rest = np.ones(len(left), bool)
            rest[first] = False
            left, at = left[rest], (at[rest] + 1) & ((1 << self.bits) - 1)

    def _home(self, codes: np.ndarray) -> np.ndarray:
        mixed = (codes ^ (codes >> np.uint32(15))) * np.uint32(0x9E3779B1)
        return (mixed >> np.uint32(32 - self.bits)).astype(np.int64)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Row of each code, -1 where unknown."""
        at = self._home(codes)
        rows = self.rows[at]
        open_ = np.flatnonzero((self.keys[at] != codes) & (rows >= 0))
        rows[(self.keys[at] != codes)] = -1
        at = at[open_]
        while len(open_):
            at = (at + 1) & ((1 << self.bits) - 1)
            found, same = self.rows[at], self.keys[at] == codes[open_]
            hit = same & (found >= 0)
            rows[open_[hit]] = found[hit]
            go = (found >= 0) & ~same
            open_, at = open_[go], at[go]
        return rows


class Coder:
    """Code lengths of bytes under every language, from the frozen counts."""

    def __init__(self, model: dict):
        self.names = model["names"]
        width = len(self.names)
        self.levels: list[tuple[Table, np.ndarray]] = []   # by order: gram -> cost
        self.escapes: list[tuple[Table, np.ndarray]] = []  # by order: context -> escape cost
        self.floor = np.full(width, 8 * UNIT, np.int64)
        gram, n = model["gram"], model["n"]
        below = None
        for order in range(ORDER + 1):
            code, at = np.unique(gram & np.uint32((1 << (8 * (order + 1))) - 1), return_inverse=True)
            count = np.zeros((len(code), width), np.int64)
            np.add.at(count, at, n)
            context, of = np.unique(code >> np.uint32(8) if order else np.zeros_like(code), return_inverse=True)
            total = np.zeros((len(context), width), np.int64)
            different = np.zeros((len(context), width), np.int64)
            np.add.at(total, of, count)
            np.add.at(different, of, (count > 0).astype(np.int64))
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(different / (total + different)), 0)
                own = -np.log2(count / (total + different)[of])
            escape = np.rint(escape * UNIT).astype(np.int64)
            shorter = self.floor if below is None else below(code & np.uint32((1 << (8 * order)) - 1))
            cost = np.where(count > 0, np.rint(np.where(count > 0, own, 0) * UNIT), escape[of] + shorter)
            self.levels.append((Table(code), cost.astype(np.int32)))
            self.escapes.append((Table(context), escape))
            below = lambda codes, order=order: self.cost(codes, order)

    def cost(self, codes: np.ndarray, order: int = ORDER) -> np.ndarray:
        """(len(codes), languages) costs; codes hold ``order + 1`` bytes."""
        if order < 0:
            return np.broadcast_to(self.floor, (len(codes), len(self.names)))
        table, costs = self.levels[order]
        if not len(costs):
            return self.cost(codes & np.uint32((1 << (8 * order)) - 1), order - 1)
        rows = table.find(codes)
        out = costs[rows]
        unknown = np.flatnonzero(rows < 0)
        if len(unknown):
            left = codes[unknown]
            contexts, escapes = self.escapes[order]
            rows = contexts.find(left >> np.uint32(8) if order else np.zeros_like(left))
            paid = np.where((rows >= 0)[:, None], escapes[rows], 0)
            shorter = left & np.uint32((1 << (8 * order)) - 1)
            out[unknown] = paid + self.cost(shorter, order - 1)
        return out

    def lengths(self, texts: pa.Array) -> np.ndarray:
        """(texts, languages) code lengths in units of 1 / UNIT bit."""
        data, offsets = padded(texts)
        out = np.zeros((len(texts), len(self.names)), np.int64)
        for begin in range(ORDER, len(data), STEP):
            end = min(begin + STEP, len(data))
            cost = self.cost(grams(data, begin, end))
            first = int(np.searchsorted(offsets, begin, "right")) - 1
            last = int(np.searchsorted(offsets, end, "left"))
            # A text's own bytes begin after its padding.
            starts = np.clip(offsets[first:last] + ORDER, begin, end) - begin
            stops = np.clip(offsets[first + 1:last + 1], begin, end) - begin
            total = np.concatenate([np.zeros((1, cost.shape[1]), np.int64), np.cumsum(cost, axis=0, dtype=np.int64)])
            out[first:last] += np.where((stops > starts)[:, None], total[stops] - total[starts], 0)
        return out


RESULT = "struct<lang_pred: string, score: double, bits: double, lettered: boolean>"


def predictor(spark: SparkSession, model: dict):
    """A function from a text column to ``RESULT``. The model is broadcast; its size is bounded
    by the parameters of ``learn``."""
    ship(spark)
    shared, key = spark.sparkContext.broadcast(model), ("ppm", uuid.uuid4().hex)

    def predict(texts: pa.Array) -> pa.Array:
        coder = in_worker(key, lambda: Coder(shared.value))
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        letters = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
        if not coder.names:
            none = pa.nulls(len(texts), pa.float64())
            return pa.StructArray.from_arrays(
                [pa.array([UNKNOWN] * len(texts), pa.string()), pa.array(np.zeros(len(texts))), none,
                 pa.array(letters)], names=["lang_pred", "score", "bits", "lettered"])
        length = coder.lengths(texts) / UNIT
        best = length.argmin(axis=1)
        least = length.min(axis=1)
        score = 1 / np.exp2(np.maximum(least[:, None] - length, -1000)).sum(axis=1)
        names = np.array([*coder.names, UNKNOWN], object)
        return pa.StructArray.from_arrays(
            [pa.array(names[np.where(letters, best, len(coder.names))], pa.string()),
             pa.array(np.where(letters, score, 0.0)),
             pa.array(least, mask=~letters), pa.array(letters)],
            names=["lang_pred", "score", "bits", "lettered"])

    return F.arrow_udf(predict, RESULT)


def held_out(id_col: str) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(3)) == 1, F.lit(False))


def identify(docs: DataFrame, model: dict, text_col: str = "text", into: str = "language") -> DataFrame:
    """``docs`` with a struct column ``into`` (replaced if it is there): lang_pred, score, bits of
    the best code, lettered (whether the text has a letter)."""
    return docs.withColumn(into, predictor(docs.sparkSession, model)(F.col(text_col)))


def accepted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that ``identify`` calls ``und``: null texts and texts without a
    letter. The same rows go at every size and with any labels. How many bits a byte a text costs
    decides nothing: rare clean words cost more under these models than a foreign language does.
    """
    short_batches(docs.sparkSession)
    model = learn(docs.where(~held_out("doc_id")), "doc_id", text_col)
    into, = unused(docs, "language")
    return identify(docs, model, text_col, into).where(F.col(f"{into}.lettered")).drop(into)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = learn(docs.where(~held_out("doc_id")))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "language.lang_pred",
                        "language.score", "language.bits")
