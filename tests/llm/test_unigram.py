"""Token counts and samples against the SentencePiece library and full enumeration."""
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from watchfold.llm import segment_sampling as S
from watchfold.llm import token_counts as T
from watchfold.llm import unigram
from watchfold.llm.near_dedup import mix
from watchfold.llm.tokens import strings, vocabulary

PARTS = ["a", "B", "é", "'", "s", "t", ",", ".", "  ", " ", "\n", "\t", "1", "9", "«", "́", " ", "Σ", "😀", "the",
         "-", "中", "　", "▁", "ing", "er", "\0"]


@pytest.fixture(scope="module")
def path():
    return vocabulary("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library(path):
    return sentencepiece.SentencePieceProcessor(model_proto=unigram.library_model(path))


def odd_texts(n, seed=4):
    rng = random.Random(seed)
    return ["".join(rng.choices(PARTS, k=rng.randint(0, 14))) for _ in range(n)] + ["x" * 3000, "ab" * 2000]


def score_of(library, ids):
    return sum(library.get_score(i) for i in ids)


def test_counts_are_the_librarys(path, library, make, spark, testdata):
    texts = odd_texts(3000) + [r.text for r in spark.read.parquet(f"{testdata}/documents.parquet").select("text").collect()]
    out = T.counts(make(texts), into="n").select("doc_id", "n.n_tokens", "n.score").collect()
    for r in out:
        proto = library.encode(texts[r.doc_id], return_type="proto")
        assert r.n_tokens == len(proto.pieces)


def test_scores_are_the_librarys(path, library, make):
    texts = ["the thing.", "hello (world) 'tis", "a  b"]
    for r in T.counts(make(texts)).collect():
        assert r.tokens.score == pytest.approx(score_of(library, library.encode(texts[r.doc_id])))


def test_counts_of_nothing(make):
    out = T.counts(make([None, ""], "score n_tokens tokens")).orderBy("doc_id").collect()
    assert [(r.tokens.n_tokens, r.tokens.score) for r in out] == [(0, 0.0), (0, 0.0)]
    assert T.counts(make([])).count() == 0


def all_segmentations(model, text):
    """{ids: log-probability} of every segmentation of a space and ``text``."""
    whole = (" " + text).replace(" ", unigram.SPACE)

    def ways(at):
        if at == len(whole):
            yield (), 0.0
        for end in range(at + 1, len(whole) + 1):
            i = model.pieces.get(whole[at:end])
            if i is not None:
                head, score = (i,), int(model.scores[i]) / unigram.UNIT
            elif end == at + 1:
                head, score = tuple(model.byte_ids[b] for b in whole[at].encode()), model.unknown / unigram.UNIT
            else:
                continue
            for rest, more in ways(end):
                yield head + rest, score + more

    found = dict(ways(0))
    total = math.log(sum(math.exp(s) for s in found.values()))
    return {ids: s - total for ids, s in found.items()}


@pytest.fixture(scope="module")
def sampler(path):
    return S.Sampler(unigram.load(path), 1.0, 0)


def draws(sampler, text, n, k, first=0):
    data, offsets = strings(pa.array([text] * n))
    part, bounds = unigram.spaced(data, offsets)
    _, paths, threshold = sampler.chunk(part, bounds, mix(np.arange(first, first + n).astype(np.uint64)), k)
    out = []
    for p in paths:
        ids, cuts = sampler.ids(p.edges, p.bounds)
        out.append(([tuple(x.tolist()) for x in np.split(ids, cuts[1:-1])], p))
    return out, threshold


@pytest.mark.parametrize("text", ["then", "é,x", "a b"])
def test_draws_follow_the_distribution(sampler, text):
    exact = all_segmentations(sampler.lattices.model, text)
    n = 20_000
    (first, p1), (second, p2) = draws(sampler, text, n, 2)[0]
    for ids, logp in zip(first, p1.log_prob, strict=True):
        assert logp == pytest.approx(exact[ids], abs=1e-4)
    for ids, count in Counter(first).items():
        p = math.exp(exact[ids])
        assert abs(count / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-4
    for (a, b), count in Counter(zip(first, second, strict=True)).items():
        assert a != b
        p = math.exp(exact[a]) * math.exp(exact[b]) / (1 - math.exp(exact[a]))
        assert abs(count / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 2e-4


def test_all_are_found_in_falling_order(sampler):
    exact = all_segmentations(sampler.lattices.model, "abc")
    found, threshold = draws(sampler, "abc", 50, len(exact) + 3)
    for t in range(50):
        own = [(ids[list(p.texts).index(t)], p.value[list(p.texts).index(t)]) for ids, p in found if t in p.texts]
        assert {ids for ids, _ in own} == set(exact) and len(own) == len(exact)
        assert [v for _, v in own] == sorted((v for _, v in own), reverse=True)
    assert np.isneginf(threshold).all()


def test_inclusion_scores_are_unbiased(sampler):
    found, threshold = draws(sampler, "thinking", 5000, 4)
    total = np.zeros(5000)
    for _, p in found:
        total[p.texts] += np.exp(p.log_prob) / -np.expm1(-np.exp(p.log_prob - threshold[p.texts]))
    assert total.mean() == pytest.approx(1, abs=0.02)


def test_samples_depend_on_the_row_alone(make):
    texts = odd_texts(150) + ["the same text here", None, ""]
    names = ["doc_id", "rank", "ids", "log_prob", "perturbed", "log_inclusion", "round_trip"]
    one = S.sample(make(texts, "rank ids _key"), samples=3).select(names).collect()
    other = S.sample(make(list(enumerate(texts))[::-1]).coalesce(1), samples=3).select(names).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, other))
    assert all(r.round_trip for r in one)
    by_doc = {}
    for r in one:
        by_doc.setdefault(r.doc_id, []).append(bytes(r.ids))
    assert set(by_doc) == set(range(len(texts))) and all(len(set(v)) == len(v) for v in by_doc.values())
    different = S.sample(make(texts), samples=3, seed=1).select(names).collect()
    assert sorted(map(tuple, one)) != sorted(map(tuple, different))


def test_decoding_gives_the_texts(make, library):
    texts = [t.replace("▁", " ") for t in odd_texts(100)] + [None]
    decoded = S.decode(S.sample(make(texts)), into="back").collect()
    assert all(r.back == (texts[r.doc_id] or "") for r in decoded)
    for r in decoded[:50]:
        ids = np.frombuffer(bytes(r.ids), "<u2").tolist()
        assert library.decode(ids) == r.back
    assert S.sample(make([])).count() == 0
