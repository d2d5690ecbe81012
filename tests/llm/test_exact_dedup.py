import hashlib
import re

import pytest
from pyspark.sql import functions as F

from watchfold.llm.exact_dedup import directory, drop_copies, exact_dedup

TEXTS = ["a  b", "a b", "a\n\tb", "A b", None, "", " ", "\x0b", "x" * 100_000, "x" * 100_000, "é b", "a b"]


def expected(pairs):
    groups = {}
    for i, t in pairs:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    return sorted((i, min(ids), len(ids), i == min(ids), hashlib.sha256(t.encode()).hexdigest())
                  for t, ids in groups.items() for i in ids)


NAMES = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def test_equal_after_white_space(make):
    got = sorted(tuple(r) for r in exact_dedup(make(TEXTS, "key row bucket id")).select(NAMES).collect())
    assert got == expected(list(enumerate(TEXTS)))


def test_poor_hash_makes_chains_not_errors(make):
    got = sorted(tuple(r) for r in exact_dedup(make(TEXTS), hash_of=lambda c: F.length(c).cast("long")).select(NAMES).collect())
    assert got == expected(list(enumerate(TEXTS)))


def test_buckets_split_until_they_hold_the_capacity(spark):
    keys = spark.range(3000).select(F.xxhash64("id").alias("key"))
    buckets = directory(keys, 100)
    assert sum(2.0 ** -depth for _, depth in buckets) == 1
    values = [r[0] % (1 << 64) for r in keys.collect()]
    for prefix, depth in buckets:
        assert sum(v >> (64 - depth) == prefix for v in values) <= 100


def test_close_keys_are_split_deep(spark):
    keys = spark.range(40).select(F.col("id").alias("key"))
    assert max(d for _, d in directory(keys, 4)) >= 62


def test_repeated_rows_and_null_ids(make):
    docs = make([(5, "t"), (5, "t"), (7, "t"), (None, "t"), (None, "u")], "dedup_id dedup_sha _id")
    out = exact_dedup(docs).collect()
    assert sum(r.kept for r in out) == 2 and len(out) == 5
    assert {r.keep_id for r in out if r.group_size == 4} == {5}
    left = drop_copies(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in left.collect()) == [(0, "u"), (5, "t")]


@pytest.mark.parametrize("n", [0, 1])
def test_small_tables(make, n):
    docs = make(["only"][:n])
    assert exact_dedup(docs).count() == n and drop_copies(docs).count() == n
