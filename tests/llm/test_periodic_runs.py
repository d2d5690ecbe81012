import hashlib
import random
import zlib

import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from watchfold.llm import periodic_runs as P


def brute(words, least=12):
    """For every period, the stretches in which words that far apart are equal."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q) and j > i:
                found.setdefault((i, j - i + q), q)  # the least period comes first
            i = max(j, i + 1)
    return sorted((s, size, q) for (s, size), q in found.items())


def collapsed(words, runs):
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    return " ".join(w.decode() for i, w in enumerate(words) if i not in gone)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=40), min_size=1, max_size=4), st.sampled_from([2, 5, 12]))
def test_like_every_period(texts, least):
    got = list(P._of_texts(texts, least))
    assert [r for r, _ in got] == [brute(t, least) for t in texts]
    assert [c for _, c in got] == [collapsed(t, r) for t, (r, _) in zip(texts, got, strict=True)]


@pytest.mark.parametrize("jumps, questions", [(1, 3), (48, 1 << 21)])
def test_repeated_passages(monkeypatch, jumps, questions):
    monkeypatch.setattr(P, "JUMPS", jumps)
    monkeypatch.setattr(P, "QUESTIONS", questions)
    rng = random.Random(jumps)
    for _ in range(60):
        texts = []
        for _ in range(3):
            words = [b"%d" % rng.randrange(rng.choice([2, 50])) for _ in range(rng.randint(1, 120))]
            a = rng.randrange(len(words))
            p = 1 + (len(words) - a) // rng.randint(2, 9)
            texts.append(words[:a] + [words[a + (i - a) % p] for i in range(a, len(words))])
        assert [r for r, _ in P._of_texts(texts, 6)] == [brute(t, 6) for t in texts]


def test_long_and_odd_texts(make):
    long = "x y z " * 70_000
    texts = [None, "", " \t\n", "a", "a " * 11, "a " * 12, long, "a b " * 6 + "c" + " a b" * 6,
             " a  " * 20, "tab\tand\nline " * 7, "tab\tand\nline " * 7, (None, "a " * 30), (3, "p q r s " * 4)]
    rows = P.periodic_runs(make(texts, "id runs start")).collect()
    assert len(rows) == len(texts)
    got = sorted(((r.doc_id if r.doc_id is not None else -1), [tuple(x) for x in r.runs], r.collapsed) for r in rows)
    pairs = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    want = []
    for i, t in pairs:
        words = (t or "").encode().split()
        runs = [(0, 210_000, 3)] if t is long else brute(words)
        want.append((i if i is not None else -1, runs, collapsed(words, runs)))
    assert got == sorted(want)
    assert P.periodic_runs(make([])).count() == 0


def test_query_like_brute_force(spark, testdata):
    got = {r.doc_id: r for r in P.op13_periodic_runs(spark, testdata).collect()}
    table = pq.read_table(f"{testdata}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    assert len(got) == len(table)
    changed = 0
    for row in table:
        words, h = (row["text"] or "").encode().split(), zlib.crc32(str(row["doc_id"]).encode())
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            changed += 1
        runs = brute(words)
        r = got[row["doc_id"]]
        best = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else None
        assert r.n_runs == len(runs)
        assert (r.start, r.length, r.period, r.exponent_milli) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        assert r.runs_sha256 == hashlib.sha256("".join("%d,%d,%d\n" % x for x in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()
    assert changed > 5
