import random
import zlib

import numpy as np
import pytest

from watchfold.llm import packing as P
from watchfold.llm.shared import written
from watchfold.llm.tokens import vocabulary


def check(placed, capacity):
    spans = {}
    for r in placed:
        spans.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in spans.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(spans)


@pytest.mark.parametrize("seed", range(3))
def test_pack_is_tight_and_gapless(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.choice([1, 5, 30, 51, 60, 99, 100]) for _ in range(2000)] + [100]
    items = spark.createDataFrame([(i, s, "k") for i, s in enumerate(sizes)], "item long, length long, bin string").repartition(40)
    items = items.selectExpr("*", "1 AS sequence_id", "2 AS offset")
    out = P.pack(written(items, "test"), capacity=100, fan=4).collect()
    assert sorted(r.item for r in out) == list(range(len(sizes))) and out[0].bin == "k"
    assert check(out, 100) <= 1.02 * len(P.best_fit(np.array(sizes), 100)[2])


def test_nothing_is_left_half_empty_twice(spark):
    items = spark.createDataFrame([(i, 10) for i in range(40)], "item long, length long").repartition(40)
    assert check(P.pack(written(items, "test"), capacity=100, fan=4).collect(), 100) <= 5


def test_best_fit_takes_the_least_room():
    bin_of, offset, fill = P.best_fit(np.array([60, 70, 30, 40]), 100)
    assert fill.tolist() == [100, 100] and bin_of.tolist() == [1, 0, 0, 1] and offset.tolist() == [0, 0, 70, 60]


def test_pieces_of_documents(make):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    texts = ["a b", None, "", "word " * 5000, "<|endoftext|> x", "é\n\n z", "a b"]
    out = P.token_pieces(make(texts, "ids piece"), with_ids=True).collect()
    for i, text in enumerate(texts):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        own = sorted((r for r in out if r.doc_id == i), key=lambda r: r.piece)
        assert b"".join(r.ids for r in own) == np.array(ids, "<u4").tobytes()
        assert [r.piece for r in own] == list(range(-(-len(ids) // 2048)))
        assert all(r.length == 2048 for r in own[1:]) and own[0].start == 0
        assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in own)


def test_assembled_sequences(make):
    pieces = written(P.token_pieces(make(["a b c", "d", "e f"] * 20), with_ids=True), "test")
    placed = P.pack(pieces)
    whole = {r.sequence_id: bytes(r.ids) for r in P.assembled(placed).collect()}
    for r in placed.collect():
        assert whole[r.sequence_id][4 * r.offset:4 * (r.offset + r.length)] == bytes(r.ids)


def test_empty_table(make):
    assert P.packed_documents(make([])).count() == 0


def test_clustered_sizes_are_mixed(spark, monkeypatch):
    monkeypatch.setattr(P, "PIECES", 500, raising=False)
    rng = random.Random(5)
    sizes = [rng.randint(55, 75) for _ in range(2000)] + [rng.randint(1, 20) for _ in range(4000)]
    items = spark.createDataFrame(list(enumerate(sizes)), "item long, length long").repartitionByRange(12, "item")
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")  # a file is a partition
    try:
        out = P.pack(written(items, "test"), capacity=100, fan=4).collect()
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(r.item for r in out) == list(range(len(sizes)))
    assert check(out, 100) <= 1.02 * len(P.best_fit(np.array(sizes), 100)[2])
