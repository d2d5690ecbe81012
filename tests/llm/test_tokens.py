import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from watchfold.llm.tokens import byte_level, lower_case

PARTS = ["a", "B", "é", "É", "'s", "'", "t", ",", ".", "  ", " ", "\n", "\t", "19", "«", "́", " ", "\x1c", "İ",
         "Σ", "😀", "<|endoftext|>", "<|startoftext|>", "<", "|", "the", "-", "中", "　", "\0", "'ll", "re", "ß", "\x85"]


def ids_of(encoder, texts):
    out = []
    for _, _, ids, each in encoder.batches(pa.array(texts, pa.string())):
        out += [x.tolist() for x in np.split(ids, np.cumsum(each)[:-1])]
    return out


@pytest.fixture(scope="module", params=[byte_level, lower_case])
def encoder(request):
    return request.param()


def same(encoder, texts):
    wanted = [e.ids for e in encoder.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert ids_of(encoder, texts) == wanted


def test_odd_texts(encoder):
    rng = random.Random(5)
    same(encoder, ["".join(rng.choices(PARTS, k=rng.randint(0, 12))) for _ in range(3000)] + [None, "", "x" * 70_000])


def test_all_characters_of_one_byte_leads(encoder):
    same(encoder, [f"a{chr(c)}b {chr(c)}{chr(c)} {chr(c)}1 {chr(c)}" for c in range(0x250)])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=4))
def test_any_text(encoder, texts):
    same(encoder, [t.encode("utf-8", "ignore").decode() for t in texts])


def test_documents(encoder, spark, testdata):
    same(encoder, [r.text for r in spark.read.parquet(f"{testdata}/documents.parquet").select("text").collect()])


def test_full_table_starts_anew(encoder, monkeypatch):
    monkeypatch.setattr("watchfold.llm.tokens.MOST_KEPT", 3)
    same(encoder, ["one two three", "four five", "one two"])
