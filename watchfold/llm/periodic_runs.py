"""Runs of periodically repeated words, by an enhanced suffix array and branching tandem repeats.

The words of some documents at a time become whole numbers and their suffixes are sorted by prefix
doubling, every document's among themselves. An LCP interval is a range of the suffix array with
its common prefix length d; no tree is built. A square of period d that no word to its right
continues is a pair of suffixes i and i + d in different children of an interval of length d,
so for every suffix of the smaller of two neighbouring parts it is asked whether the inverse
suffix array has i + d or i - d in the other: n log n questions. Each such square is moved left
word by word (in steps of powers of two, by the ranks of the doubling), which gives the whole run;
a run found by several multiples of its period is kept with the least.

A run is a stretch with smallest period q and at least ``max(least, 2 q)`` words that cannot be
made longer. ``collapsed`` is the text without what repeats: a word goes if any run has it after
that run's first q words; what stays is joined by one space.

Nulls: a null id stays; a null text, like an empty one, has no words, no runs and an empty collapsed
text. A text may be of any length: one over ``WORDS`` words is handled alone, in memory of about
(4 log2 of its longest repeat + 80) bytes a word. Repeated rows give repeated rows, an empty table
none. Other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from watchfold.llm.shared import documents, ship

WORDS = 200_000      # words whose suffixes are sorted together, about
QUESTIONS = 1 << 21  # asked at once
LEAST = 12
JUMPS = 48


class Numbers(dict):
    """A number for every word, given when it is first asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def ranks_and_suffixes(keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Suffix array of ``keys``, in which no key is found in two documents, and ranks by the first
    2**k words for each k: equal where, and only where, these words are equal."""
    n = len(keys)
    order = np.argsort(keys, kind="stable")
    sorted_keys = keys[order]
    new = np.empty(n, bool)
    new[:1] = True
    np.not_equal(sorted_keys[1:], sorted_keys[:-1], out=new[1:])
    heads = np.flatnonzero(new)
    size = np.diff(heads, append=n)
    first = np.repeat(heads, size)
    rank = np.full(n + 1, -1, np.int32)  # a rank is the first place of its group
    rank[order] = first
    suffixes = order.astype(np.int32)
    levels, width = [rank], 1
    open_ = np.repeat(size > 1, size)
    active, group = order[open_], first[open_]
    while len(active):
        after = active + width
        second = np.where(after < n, rank[np.minimum(after, n)], -1).astype(np.int64)
        by = np.argsort(group.astype(np.int64) * (n + 2) + second + 1)
        active, group, second = active[by], group[by], second[by]
        count = len(active)
        of_group = np.empty(count, bool)
        of_group[0] = True
        np.not_equal(group[1:], group[:-1], out=of_group[1:])
        of_part = of_group.copy()
        of_part[1:] |= second[1:] != second[:-1]
        begin = np.flatnonzero(of_group)
        at = np.arange(count)
        inside = at - np.repeat(begin, np.diff(begin, append=count))
        suffixes[group + inside] = active
        parts = np.flatnonzero(of_part)
        size = np.diff(parts, append=count)
        first = np.repeat((group + inside)[parts], size)
        rank = rank.copy()
        rank[active] = first
        levels.append(rank)
        open_ = np.repeat(size > 1, size)
        active, group, width = active[open_], first[open_], 2 * width
    return levels, suffixes


def common_prefixes(levels: list[np.ndarray], suffixes: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each suffix in the array and the one before it."""
    out = np.zeros(len(suffixes), np.int32)
    at = np.flatnonzero(levels[0][suffixes[1:]] == levels[0][suffixes[:-1]]) + 1
    a, b = suffixes[at - 1].astype(np.int64), suffixes[at].astype(np.int64)
    end = len(suffixes)
    for k in range(len(levels) - 1, -1, -1):
        same = (levels[k][np.minimum(a, end)] == levels[k][np.minimum(b, end)]) & (a < end) & (b < end)
        a[same] += 1 << k
        b[same] += 1 << k
    out[at] = b - suffixes[at]
    return out


def _smaller(lcp: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For the places ``at`` (ascending, the value above 0) the nearest place before with a smaller value."""
    left = np.arange(-1, len(lcp) - 1)
    active = at
    for _ in range(JUMPS):
        active = active[lcp[left[active]] >= lcp[active]]
        if not len(active):
            return left[at]
        left[active] = left[left[active]]
    # Long chains of rising values: one pass with a stack.
    values, stack, found = lcp.tolist(), [], left.tolist()
    for i, value in enumerate(values):
        while stack and values[stack[-1]] >= value:
            stack.pop()
        if value:
            found[i] = stack[-1] if stack else -1
        stack.append(i)
    return np.asarray(found)[at]


def squares(lcp: np.ndarray, suffixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of each square that the word to its right does not continue."""
    n = len(suffixes)
    at = np.flatnonzero(lcp)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    depth = lcp[at].astype(np.int64)
    low = _smaller(lcp, at)
    high = n - 1 - _smaller(lcp[::-1], (n - 1 - at)[::-1])[::-1]
    # Boundaries of one interval share their low end and depth: a part begins at the one before.
    by = np.lexsort((at, depth, low))
    brother = np.zeros(len(at), bool)
    brother[1:] = (low[by][1:] == low[by][:-1]) & (depth[by][1:] == depth[by][:-1])
    begin = low.copy()
    begin[by[brother]] = at[by[np.flatnonzero(brother) - 1]]
    left_small = at - begin <= high - at
    small = np.where(left_small, begin, at)
    size = np.where(left_small, at - begin, high - at)
    other_low, other_high = np.where(left_small, at, begin), np.where(left_small, high, at)
    place = np.empty(n, np.int64)
    place[suffixes] = np.arange(n)
    starts, periods = [], []
    upto = np.cumsum(size)
    cut = 0
    while cut < len(at):
        done = upto[cut - 1] if cut else 0
        end = max(cut + 1, int(np.searchsorted(upto, done + QUESTIONS, side="right")))
        part = slice(cut, end)
        of = np.repeat(np.arange(cut, end), size[part])
        i = suffixes[small[of] + np.arange(len(of)) - np.repeat(upto[part] - size[part] - done, size[part])].astype(np.int64)
        d, lo, hi = depth[of], other_low[of], other_high[of]
        for step, start in ((d, i), (-d, i - d)):
            j = i + step
            known = (j >= 0) & (j < n)
            where = place[np.where(known, j, 0)]
            found = known & (where >= lo) & (where < hi)
            starts.append(start[found])
            periods.append(d[found])
        cut = end
    return np.concatenate(starts), np.concatenate(periods)


def find_runs(keys: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of the runs, by start, then period."""
    levels, suffixes = ranks_and_suffixes(keys)
    start, period = squares(common_prefixes(levels, suffixes), suffixes)
    end = start + 2 * period
    for k in range(len(levels) - 1, -1, -1):  # rotate to the left as far as words agree
        back = start - (1 << k)
        safe = np.maximum(back, 0)
        same = (back >= 0) & (levels[k][safe] == levels[k][safe + period])
        start = np.where(same, back, start)
    long = end - start >= least
    start, end, period = start[long], end[long], period[long]
    by = np.lexsort((period, end, start))
    start, end, period = start[by], end[by], period[by]
    once = np.ones(len(start), bool)
    once[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[once], end[once], period[once]
    by = np.lexsort((period, start))
    return start[by], (end - start)[by], period[by]


def _of_texts(texts: list[list[bytes]], least: int) -> Iterator[tuple[list[tuple[int, int, int]], str]]:
    """(runs, collapsed text) of each list of words."""
    sizes = np.array([len(words) for words in texts], np.int64)
    first = np.concatenate([[0], np.cumsum(sizes)])
    numbers = Numbers()
    ids = np.fromiter((numbers[w] for words in texts for w in words), np.int64, int(first[-1]))
    ids += np.repeat(np.arange(len(texts)), sizes) * max(len(numbers), 1)
    start, length, period = find_runs(ids, least)
    of = np.searchsorted(first, start, side="right") - 1
    cuts = np.searchsorted(of, np.arange(len(texts) + 1))
    for t, words in enumerate(texts):
        own = slice(cuts[t], cuts[t + 1])
        runs = list(zip((start[own] - first[t]).tolist(), length[own].tolist(), period[own].tolist(), strict=True))
        if runs:
            drop = np.zeros(len(words) + 1, np.int64)
            np.add.at(drop, [s + q for s, _, q in runs], 1)
            np.add.at(drop, [s + size for s, size, _ in runs], -1)
            words = [words[i] for i in np.flatnonzero(np.cumsum(drop[:-1]) == 0).tolist()]
        yield runs, b" ".join(words).decode()


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _processed(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        def done(begin: int, texts: list[list[bytes]], batch: pa.RecordBatch = batch) -> pa.RecordBatch:
            runs, collapsed = zip(*_of_texts(texts, least), strict=True)
            names = ("start", "length", "period")
            runs = pa.array([[dict(zip(names, r, strict=True)) for r in rs] for rs in runs], _RUNS)
            ids = batch.column(0).slice(begin, len(texts))
            return pa.RecordBatch.from_arrays([ids, runs, pa.array(collapsed, pa.string())], names=["id", "runs", "collapsed"])

        begin, held, words = 0, [], 0
        for i, text in enumerate(batch.column(1)):
            own = (text.as_py() or "").encode().split()  # ASCII white space, as bytes.split has it
            if held and words + len(own) > WORDS:
                yield done(begin, held)
                begin, held, words = i, [], 0
            held.append(own)
            words += len(own)
        if held:
            yield done(begin, held)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """One row for each row of ``docs``: id, ``runs`` (array of start, length, period) and ``collapsed``."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    run = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
    schema = T.StructType([rows.schema["id"], T.StructField("runs", T.ArrayType(run)), T.StructField("collapsed", T.StringType())])
    return rows.mapInArrow(lambda batches: _processed(batches, least), schema).withColumnRenamed("id", id_col)


@F.pandas_udf(T.StringType())
def repeating(ids: pd.Series, texts: pd.Series) -> pd.Series:
    """Texts whose words from the a-th on repeat the first p of them, a and p drawn by the id."""
    def change(id_: str | None, text: str | None) -> str | None:
        words = (text or "").encode().split()
        if not words:
            return text
        g, n = zlib.crc32((id_ or "").encode()) // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        return b" ".join([*words[:a], *(words[a + (i - a) % p] for i in range(a, n))]).decode()

    return pd.Series([change(i, t) for i, t in zip(ids, texts, strict=True)], dtype=object)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of the documents, a tenth of which are made to repeat first; the decimal of a null id is empty."""
    ship(spark)
    decimal = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    chosen = F.crc32(decimal.cast("binary")) % 10 == 0
    docs = documents(spark, sf_dir).select("doc_id", "text")
    docs = docs.withColumn("text", F.coalesce(repeating(decimal, F.when(chosen, F.col("text"))), F.col("text")))
    found = periodic_runs(docs)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("l"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","),
                                                   r["period"].cast("string"), F.lit("\n")))
    found = found.withColumns({"best": best, "lines": F.array_join(lines, "")})
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.s")).alias("start"), F.col("best.l").alias("length"),
        (-F.col("best.p")).alias("period"),
        F.when(F.col("best").isNotNull(), F.expr("1000 * best.l DIV -best.p")).alias("exponent_milli"),
        F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
