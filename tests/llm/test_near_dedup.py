import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from watchfold.llm import near_dedup as N


def shingles(text):
    words = re.findall("[0-9a-z\x80-\U0010ffff]+", (text or "").lower())
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(pairs):
    sets = {i: shingles(t) for i, t in pairs}
    kinds = {}
    for i, s in sets.items():
        if s:
            kinds.setdefault(s, []).append(i)
    root = {i: i for i in sets}
    links = Counter()

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for s in kinds:
        for t in kinds:
            if s != t and 5 * len(s & t) >= 4 * len(s | t):
                links[s] += 1
                a, b = sorted((top(min(kinds[s])), top(min(kinds[t]))))
                root[b] = a
    out = {i: (i, 0, 1, 0) for i in sets}
    for s, ids in kinds.items():
        for i in ids:
            out[i] = (top(min(ids)), links[s], len(ids), len(s))
    return out


def corpus(seed, n=120):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["über", "don't"]
    texts = []
    for _ in range(n):
        base = rng.choices(words, k=rng.choice([1, 3, 5, 6, 30, 80, 200]))
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 4])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 5])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(rng.choice([" ", "\n", ", "]).join(copy).title())
    return texts + [None, "", "!!!", "w1", "W1", "w1 w2 w3 w4", "a " * 20_000]


def result(df):
    return {r.doc_id: (r.class_id, r.n_links, r.n_copies, r.n_shingles) for r in df.collect()}


@pytest.mark.parametrize("limits", [{}, {"block_rows": 3, "block_shingles": 500, "block_texts": 4}])
def test_like_all_pairs(make, limits):
    texts = corpus(1)
    docs = make(texts, "run side set_key near_id")
    assert result(N.jaccard_join(docs, **limits)) == brute(list(enumerate(texts)))
    kept = N.one_of_each(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, v in brute(list(enumerate(texts))).items() if v[0] == i}


def test_a_large_group_makes_no_pairs(make):
    rng = random.Random(3)
    base = [f"v{i}" for i in range(300)]
    texts = []
    for i in range(300):
        copy = list(base)
        copy[rng.randrange(300)] = f"x{i}"
        texts.append(" ".join(copy))
    assert result(N.jaccard_join(make(texts))) == brute(list(enumerate(texts)))


def test_null_and_repeated_ids(make):
    text = " ".join(f"w{i}" for i in range(20))
    out = N.jaccard_join(make([(1, text), (1, text), (4, text), (None, text), (None, None)])).collect()
    assert sorted((r.doc_id or 0, r.class_id or 0) for r in out) == [(0, 0), (0, 0), (1, 1), (1, 1), (4, 1)]
    assert N.jaccard_join(make([])).count() == 0


def test_shingles_are_the_sets(make):
    texts = corpus(2, 30)
    shingler = N.Shingler()
    sizes, seen = [], {}
    for at, to, of, value in shingler.batches(pa.array(texts)):
        sizes += np.bincount(of, minlength=to - at).tolist()
        for o, v in zip(of.tolist(), value.tolist(), strict=True):
            seen.setdefault(at + o, set()).add(v)
    sets = [shingles(t) for t in texts]
    assert sizes == [len(s) for s in sets]
    for i in range(0, len(texts), 7):
        for j in range(0, len(texts), 5):
            assert len(seen.get(i, set()) & seen.get(j, set())) == len(sets[i] & sets[j])


def test_depth_reaches_the_recall():
    depth = N.matched_depth(0.9995)
    assert 1 - (1 - 0.8 ** depth) ** N.TREES >= 0.9995 > 1 - (1 - 0.8 ** (depth + 1)) ** N.TREES
