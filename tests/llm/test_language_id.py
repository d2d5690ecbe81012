import math
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from watchfold.llm import language_id as L


def brute(samples, text):
    """Code length of ``text`` in bits under the counts of ``samples``, byte by byte."""
    seen = defaultdict(Counter)
    for s in samples:
        raw = bytes(L.ORDER) + s.encode()
        for i in range(L.ORDER, len(raw)):
            for k in range(L.ORDER + 1):
                seen[raw[i - k:i]][raw[i]] += 1

    def cost(context, byte):
        c = seen.get(context)
        if c:
            total, kinds = sum(c.values()), len(c)
            if byte in c:
                return -math.log2(c[byte] / (total + kinds))
            escape = -math.log2(kinds / (total + kinds))
        else:
            escape = 0
        return escape + (cost(context[1:], byte) if context else 8)

    raw = bytes(L.ORDER) + text.encode()
    return sum(cost(raw[i - L.ORDER:i], raw[i]) for i in range(L.ORDER, len(raw)))


EN = ["the cat sat on the mat", "then there was a thing"]
DE = ["der hund und die katze", "über den wolken"]


@pytest.fixture(scope="module")
def model(make):
    docs = make(EN + DE + [None], langs={0: "en", 1: "en", 2: "de", 3: "de", 4: "en"})
    return L.learn(docs)


def test_code_lengths_are_exact(model):
    coder = L.Coder(model)
    texts = [*EN, *DE, "", "qqq ÿ zz", "the hund", "中", "t" * 5000, "a\0b"]
    got = coder.lengths(pa.array(texts)) / L.UNIT
    for i, text in enumerate(texts):
        for j, own in enumerate([DE, EN]):
            assert got[i, j] == pytest.approx(brute(own, text), abs=1e-4 * max(1, len(text)))


def test_table_finds_what_it_holds():
    import numpy as np

    codes = np.unique(np.random.default_rng(1).integers(0, 2 ** 32, 5000, dtype=np.uint64).astype(np.uint32))
    table = L.Table(codes[::2])
    assert (table.find(codes[::2]) == np.arange(len(codes[::2]))).all() and (table.find(codes[1::2]) == -1).all()


def test_predictions_and_unknown(make, model):
    out = L.identify(make(["the thing", "die wolken", None, "", "123 !?", "é"], "language"), model).orderBy("doc_id").collect()
    assert [r.language.lang_pred for r in out] == ["en", "de", "und", "und", "und", "de"]
    assert all(0 <= r.language.score <= 1 for r in out) and out[2].language.score == 0


def test_without_labels(make):
    model = L.learn(make(["a", None]))
    assert [r.language.lang_pred for r in L.identify(make(["a", None]), model).collect()] == ["und", "und"]
    assert L.identify(make([]), model).count() == 0


PROBES = ["Quixotic zephyrs vex.", "for (int i = 0; i < n; ++i) x[i] ^= 0x5f;", "Съешь ещё этих мягких булок", None, "12 34 -- 5"]


@pytest.mark.parametrize("copies, labelled", [(1, True), (400, True), (1, False)])
def test_the_same_texts_are_accepted_at_every_size(make, copies, labelled):
    texts = [f"{t} " * 20 for t in (EN + DE) * copies]
    langs = {i: "en" if i % 4 < 2 else "de" for i in range(len(texts))} if labelled else {}
    docs = make(texts + PROBES, "language", langs)
    kept = L.accepted(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(range(len(texts) + 3))


def test_accepted_of_an_empty_table(make):
    assert L.accepted(make([])).count() == 0


def test_all_counts_of_the_sample_are_learned(make):
    text = "".join(chr(0x4E00 + i) for i in range(20_000))
    model = L.learn(make([text] * 4, langs={i: "zh" for i in range(4)}))
    raw = bytes(L.ORDER) + text.encode()
    assert len(model["gram"]) == len({raw[i - L.ORDER:i + 1] for i in range(L.ORDER, len(raw))})


def test_repeated_rows_and_very_long_texts(make, model):
    long = "the cat " * 400_000
    out = L.identify(make([(1, "the cat"), (1, "the cat"), (2, long)]), model).collect()
    assert [r.language.lang_pred for r in out] == ["en"] * 3


def test_held_out_accuracy(spark, testdata):
    docs = spark.read.parquet(f"{testdata}/documents.parquet")
    out = L.op3_language_id(spark, testdata).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert out.where("lang_pred = lang").count() >= 0.95 * out.count()
