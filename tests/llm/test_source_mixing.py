import hashlib
import random
from collections import defaultdict

import pytest

import oracle
from watchfold.llm import source_mixing as M

DOCS = "doc_id long, text string, source string, size int, u int, key int, row int"


def targets(sizes, weights, share, most):
    """Words of each source, the excess handed on until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, open_, words = dict.fromkeys(names, 0.0), set(names), share * sum(sizes.values())
    while open_:
        price = words / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * price > most * sizes[s]}
        if not over:
            out.update({s: weight[s] * price for s in open_})
            break
        for s in over:
            out[s] = float(most * sizes[s])
        words, open_ = words - sum(most * sizes[s] for s in over), open_ - over
    return out


def brute(docs, weights=M.WEIGHTS, share=M.SHARE, most=2):
    """Sorts each source by hash and takes documents while they fit."""
    rows = [(i, len((t or "").encode().split()), s, int(hashlib.md5(f"{'' if i is None else i} {t or ''}".encode()).hexdigest()[:15], 16))
            for i, t, s in docs]
    sizes = defaultdict(int)
    for _, n, s, _ in rows:
        sizes[s] += n
    goal = targets(sizes, weights, share, most)
    out = []
    for s in sizes:
        own = sorted((u, n, i) for i, n, s2, u in rows if s2 == s)
        for copy in range(most):
            budget, before = goal[s] - copy * sizes[s], 0
            for u, n, i in own:
                alike = [r for r in own if r[0] == u]
                if own.index((u, n, i)) == own.index(alike[0]):
                    seen = 0
                start = before - seen * n
                if budget >= sizes[s] or start + n * len(alike) <= budget:
                    take = True
                elif budget <= 0 or start > budget:
                    take = False
                else:
                    take = seen + 1 <= int((budget - start) * len(alike) / (n * len(alike)) + 0.5)
                out.append((i, n, sizes[s], goal[s], n * take, copy))
                seen, before = seen + 1, before + n
    return sizes, goal, out


def check(spark, docs, **options):
    df = spark.createDataFrame([(i, t, s, 1, 1, 1, 1) for i, t, s in docs], DOCS)
    got = M.mixed(df.repartition(3) if docs else df, **options).collect()
    sizes, goal, want = brute(docs, **options)
    assert len(got) == len(docs)
    by_copy = defaultdict(list)
    for i, n, size, target, taken, copy in want:
        by_copy[copy].append((i if i is not None else -1, n, size, round(target, 6), taken))
    # Rows are alike in all but the words taken, so the sums of each kind of row decide.
    def sums(rows):
        out = defaultdict(int)
        for *kind, taken in rows:
            out[tuple(kind)] += taken
        return out

    whole = [r for rows in by_copy.values() for r in rows]
    assert sums((r.doc_id if r.doc_id is not None else -1, r.size, r.source_size, round(r.target, 6), r.taken) for r in got) == sums(whole)
    return got, sizes, goal


def test_like_sorting_and_near_the_targets(spark):
    rng = random.Random(2)
    sources = ["a", "B", "é", "z", None, "hot"]
    docs = [(i, "w " * rng.randint(0, 40), rng.choice(sources[:5]) if i % 3 else "hot") for i in range(900)]
    got, sizes, goal = check(spark, docs)
    taken = defaultdict(int)
    for r, s in ((r, dict((d[0], d[2]) for d in docs)[r.doc_id]) for r in got):
        assert 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - goal[s]) <= 20 for s in sizes)


def test_rows_alike_at_a_threshold(spark):
    docs = [(1, "one two three", "a")] * 200 + [(2, "x", "b")] * 20 + [(None, None, "b"), (None, "", None), (None, "q r", None)]
    for share in (0.3, 0.9, 1.5):
        check(spark, docs, share=share)


def test_options_and_small_tables(spark):
    docs = [(i, "w " * (i % 7), f"s{i % 4}") for i in range(200)]
    check(spark, docs, weights=(1,), share=2.5, most=3)
    check(spark, docs, weights=(1, 9), share=0.2, most=1)
    check(spark, [(1, "word " * 300_000, "a"), (2, "b", "a"), (3, "c", "b")])
    check(spark, [(1, None, None), (2, "", "a")])
    check(spark, [])
    with pytest.raises(ValueError):
        M.mixed(spark.createDataFrame([], DOCS), share=3.0)


def test_many_sources_without_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(M, "BROADCAST_SOURCES", 3)
    monkeypatch.setattr(M, "RANKED", 7)
    monkeypatch.setattr(M, "NUMBERED", 4)
    check(spark, [(i, "w " * (i % 11 + 1), f"s{i % 50}") for i in range(300)] + [(7, "same text", "s7")] * 30)


def test_reruns_and_other_partitions_agree(spark):
    rows = [(i % 50, "w " * (i % 5 + 1), f"s{i % 3}", 1, 1, 1, 1) for i in range(300)]
    a = M.mixed(spark.createDataFrame(rows, DOCS).repartition(2)).collect()
    b = M.mixed(spark.createDataFrame(rows[::-1], DOCS).repartition(5)).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


@pytest.mark.parametrize("name", ["op12_source_mixing", "op11_conversation_trie"])
def test_query_equals_sql(spark, testdata, name):
    from watchfold.llm import catalogue

    con = oracle.connect(testdata)
    assert oracle.compare(spark, con, testdata, catalogue.QUERIES[name], catalogue.ORACLES[name]) is None
