import zlib
from itertools import accumulate

import numpy as np
import pytest
from tokenizers import Tokenizer

from watchfold.llm import id_files as H
from watchfold.llm.shared import shared_folder
from watchfold.llm.tokens import vocabulary


@pytest.mark.parametrize("seed", range(4))
def test_lengths_are_a_full_short_code(seed):
    rng = np.random.default_rng(seed)
    counts = rng.zipf(1.3, 500).clip(1, 10 ** 9)
    free, short = H.code_lengths(counts, 40), H.code_lengths(counts, 10)
    for lengths, most in ((free, 40), (short, 10)):
        assert lengths.max() <= most and (0.5 ** lengths).sum() == 1
    # Without a limit the cost is Huffman's.
    heap, cost = sorted(counts.tolist()), 0
    while len(heap) > 1:
        a, b, *heap = heap
        cost += a + b
        heap = sorted([*heap, a + b])
    assert (free * counts).sum() == cost <= (short * counts).sum()


def test_few_ids():
    assert H.code_lengths(np.array([5])).tolist() == [1]
    assert H.code_lengths(np.zeros(0)).tolist() == []
    with pytest.raises(ValueError):
        H.code_lengths(np.ones(5), 2)


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 5000])
def test_block_round_trip(n):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.2, n) % 3000).astype(np.uint32)
    some, counts = np.unique(np.append(ids, 7), return_counts=True)
    code = H.Code(some, H.code_lengths(counts, 13))
    sizes = np.array([n // 3, 0, n - n // 3])
    got, each = code.decode(code.encode(ids, sizes))
    assert got.tolist() == ids.tolist() and each.tolist() == sizes.tolist()


def test_codes_are_canonical():
    code = H.Code(np.array([3, 1, 2]), np.array([2, 2, 1]))
    assert [int(code.code_of[i]) for i in (2, 1, 3)] == [0b0, 0b10, 0b11]


def expected(pairs):
    tokenizer = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    pairs = sorted(pairs)
    ids = [np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for _, t in pairs]
    starts = [0, *accumulate(map(len, ids))]
    return [(i, s, len(x), x.tobytes()) for (i, _), s, x in zip(pairs, starts, ids, strict=False)]


def test_files_give_the_ids_back(spark, make):
    texts = ["A b c", None, "", "word " * 3000, "é — ü", "A b c", "<|endoftext|>"] * 5
    path = shared_folder(spark, "test")
    H.write_id_files(make(texts, "id ids part block"), path, block_tokens=1000)
    out = H.read_id_files(spark, path).orderBy("doc_id").collect()
    assert [(r.doc_id, r.start, r.n_tokens, bytes(r.ids)) for r in out] == expected(list(enumerate(texts)))
    assert spark.read.parquet(f"{path}/blocks").count() > 3


def test_null_and_repeated_ids(spark, make):
    path = shared_folder(spark, "test")
    H.write_id_files(make([(None, "x"), (2, "y"), (2, "y")]), path)
    out = H.read_id_files(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in out] == [None, 2, 2] and out[0].start == 0


def test_empty_table(spark, make):
    path = shared_folder(spark, "test")
    H.write_id_files(make([]), path)
    assert H.read_id_files(spark, path).count() == 0


def test_query(spark, testdata):
    docs = spark.read.parquet(f"{testdata}/documents.parquet")
    out = H.op7_huffman_ids(spark, testdata).orderBy("doc_id").collect()
    wanted = expected([(r.doc_id, r.text) for r in docs.collect()])
    assert [tuple(r) for r in out] == [(i, s, n, zlib.crc32(x)) for i, s, n, x in wanted]
