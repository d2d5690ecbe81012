import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from watchfold.llm import topk_search as S


def brute(rows, k, every):
    usable = {(i, tuple(math.floor(1024 * x) for x in v)) for i, v in rows
              if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q in {i for i, _ in usable if i % every == 0}:
        found = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for own, a in usable if own == q
                       for i, b in usable if i != q and len(a) == len(b))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found[:k])]
    return sorted(out)


def vectors(seed, n, dim):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dim))
    rows = [(i, (centres[i % 5] + 0.3 * rng.normal(size=dim)).astype(np.float32).tolist()) for i in range(n)]
    return rows + [(n, None), (n + 1, [None] * dim), (n + 2, [math.nan] * dim), (n + 3, [math.inf] + [0.0] * (dim - 1)),
                   (None, [1.0] * dim), (n + 4, rows[0][1]), (n + 4, rows[0][1]), (n + 5, [0.0] * dim), (n + 6, [])]


@pytest.mark.parametrize("dim", [3, 20])
def test_like_all_pairs(spark, dim):
    rows = vectors(dim, 300, dim)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("q", F.lit(1)).repartition(3)
    got = S.top_k(df, F.col("vec_id") % 10 == 0, block_rows=40, query_rows=7)
    assert sorted(map(tuple, got.collect())) == brute(rows, 10, 10)


def test_few_candidates_and_other_lengths(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0]), (2, [3.0, 1.0]), (100, [2.0])]
    got = S.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0)
    assert sorted(map(tuple, got.collect())) == brute(rows, 10, 100)
    assert S.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0).count() == 0


def test_large_numbers_are_exact(spark):
    rows = [(0, [3e5] * 64), (1, [3e5] * 63 + [3e5 + 1 / 1024]), (2, [3e5] * 64)]
    got = S.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0)
    assert sorted(map(tuple, got.collect())) == [r for r in brute(rows, 10, 100)]


def test_bounds_hold():
    rng = np.random.default_rng(0)
    rows = rng.integers(-1000, 1000, (50, 33))
    block = S.Block(np.arange(50).astype("<i8").tobytes(), rows.astype("<i8").tobytes(), 33)
    every = np.arange(50)
    for level in range(len(S.SEGMENTS)):
        assert (S.bound(block, block, level, every, every) >= rows @ rows.T).all()


def test_an_id_with_two_vectors_asks_with_both(spark):
    rng = np.random.default_rng(7)
    rows = [(i % 40, rng.normal(size=6).tolist()) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = S.top_k(df, F.col("vec_id") % 10 == 0, block_rows=16, query_rows=3)
    assert sorted(map(tuple, got.collect())) == brute(rows, 10, 10)


def test_finer_bounds_only_for_what_coarser_ones_leave():
    """Vectors of very different lengths: one segment tells most candidates off, more segments more."""
    rng = np.random.default_rng(3)
    rows = rng.integers(-1000, 1000, (2000, 48)) // (1 + np.arange(2000)[:, None] // 100)
    rows[:, :12] += rng.integers(-400, 400, (2000, 1)) // (1 + np.arange(2000)[:, None] // 100)

    def block(part, ids):
        return S.Block(ids.astype("<i8").tobytes(), part.astype("<i8").tobytes(), 48)

    best = S.Best(20, 10)
    looked = S.compare(block(rows[:20], np.arange(20)), block(rows[20:], np.arange(20, 2000)), best)
    assert looked[0] == 20 * 1980 and looked[0] > 1.5 * looked[1] and looked[1] > looked[2] > looked[3]
    scores = rows[:20] @ rows[20:].T
    assert (np.sort(best.score, axis=1) == np.sort(scores, axis=1)[:, -10:]).all()


def test_many_copies_of_one_vector(spark):
    rng = np.random.default_rng(5)
    one = rng.normal(size=8).tolist()
    rows = [(i, one if i % 3 else rng.normal(size=8).tolist()) for i in range(200)] + [(300, [-x for x in one])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = S.top_k(df, F.col("vec_id") % 50 == 0, block_rows=7, query_rows=2)
    assert sorted(map(tuple, got.collect())) == brute(rows, 10, 50)
    best = S.Best(1, 3)
    best.add(np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0, np.int64))
    assert (best.ids == np.iinfo(np.int64).max).all()
