import random
import zlib
from collections import Counter

import pytest

from watchfold.llm import kd_shards as K


def check(rows, texts, shards):
    assert sorted((r.doc_id if r.doc_id is not None else -1) for r in rows) == sorted(i if i is not None else -1 for i, _ in texts)
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and set(by) <= set(range(shards))
    text = dict(texts)
    where = {}
    load = Counter()
    for r in rows:
        raw = (text[r.doc_id] or "").encode()
        assert r.size == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw)
        assert where.setdefault(raw, r.shard) == r.shard
        load[r.shard] += r.size
    return load


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_near_equal_bytes(make, shards):
    rng = random.Random(shards)
    texts = [(i, rng.choice(["x", "é", "word "]) * rng.randint(0, 300) + str(i)) for i in range(600)]
    texts += [(1000 + i, "same text") for i in range(100)] + [(2000, None), (2001, "")]
    load = check(K.kd_shards(make(texts, "key row node shard"), shards=shards).collect(), texts, shards)
    mean = sum(load.values()) / shards
    assert len(load) == shards and max(load.values()) - min(load.values()) < 0.05 * mean + 1600


def test_target_bytes_and_equal_metadata(make):
    texts = [(i, f"{i:05d}") for i in range(400)]
    docs = make(texts).selectExpr("doc_id", "text", "'a' AS lang", "NULL AS source", "1L AS n_chars")
    load = check(K.kd_shards(docs, target_bytes=300).collect(), texts, 8)
    assert len(load) == 8 and max(load.values()) - min(load.values()) <= 12


def test_a_group_is_not_divided_and_small_tables(make):
    texts = [(i, "one big group") for i in range(50)] + [(99, "other")]
    check(K.kd_shards(make(texts), shards=4).collect(), texts, 4)
    assert K.kd_shards(make([]), shards=8).count() == 0
    assert K.kd_shards(make([(None, None), (3, "a"), (3, "a")]), shards=2).count() == 3
