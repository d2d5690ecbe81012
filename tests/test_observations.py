"""Observation trees against the definition: every stretch of every combination of logs."""

import random

import pytest
from pyspark.sql import functions as F

from watchfold.operators import observations as O
from watchfold.operators.observations import Observed

S = O.NS


def stretches(tree, logs):
    """All (first, last) of the tree's matches; logs is a list of (time, kinds)."""
    if not tree.of:
        out = [(t, t) for t, kinds in logs if tree.observation in kinds]
    else:
        parts = [stretches(o, logs) for o in tree.of]
        out = parts[0]
        for part in parts[1:]:
            if tree.combine == "FOLLOWEDBY":
                out = [(a, d) for a, b in out for c, d in part if b < c]
            elif tree.combine == "AND":
                out = [(min(a, c), max(b, d)) for a, b in out for c, d in part]
            else:
                out = out + part
            if tree.combine != "OR":
                out = sorted(set(out))
    if tree.repeats > 1:
        inner = sorted(m for m in out if not any(a >= m[0] and b <= m[1] and (a, b) != m for a, b in out))
        if tree.of:
            inner = sorted(set(inner))
        inner.sort(key=lambda m: m[1])
        out = [(inner[i - tree.repeats + 1][0], inner[i][1]) for i in range(tree.repeats - 1, len(inner))]
    if tree.within is not None:
        out = [m for m in out if m[1] - m[0] <= tree.within * S]
    return [m for m in out if (tree.start is None or m[0] >= tree.start) and (tree.stop is None or m[1] < tree.stop)]


def brute(trees, rows):
    out = set()
    for rule, tree in trees.items():
        for key in {r[0] for r in rows}:
            best = {}
            for first, last in stretches(tree, [(t, kinds) for k, t, kinds in rows if k == key]):
                best[last] = max(first, best.get(last, first))
            out |= {(rule, key, last, first) for last, first in best.items()}
    return out


def evaluated(spark, trees, rows, bucket):
    df = spark.createDataFrame([(k, t, list(kinds)) for k, t, kinds in rows], "k string, ns long, kinds array<int>")
    numbers = sorted({i for t in trees.values() for i in leaves(t)})
    seen = O.hits(df, {str(i): F.array_contains("kinds", i) for i in numbers}, ["k"], "ns")
    all_rules = seen.crossJoin(F.broadcast(spark.createDataFrame([(r,) for r in trees], "rule string")))
    all_rules = all_rules.select("rule", F.col("seen").cast("int").alias("observation"), "k", "ns", "n")
    return {tuple(r) for r in O.matches(all_rules, trees, ["k"], bucket).collect()}


def leaves(tree):
    return [i for o in tree.of for i in leaves(o)] if tree.of else [tree.observation]


def random_tree(rng, depth):
    qualifiers = {"within": rng.choice([None, None, 3, 8, 20.5]), "repeats": rng.choice([1, 1, 1, 2, 3])}
    if rng.random() < 0.2:
        qualifiers.update(start=rng.randint(0, 10) * S, stop=rng.randint(15, 40) * S)
    if depth == 0 or rng.random() < 0.2:
        return Observed(rng.randrange(3), **qualifiers)
    n = rng.choice([1, 2, 2, 3])
    return Observed(combine=rng.choice(O.COMBINE), of=tuple(random_tree(rng, depth - 1) for _ in range(n)), **qualifiers)


@pytest.mark.parametrize("seed, bucket", [(1, 0.5), (2, 7), (3, 1000)])
def test_like_the_definition(spark, seed, bucket):
    rng = random.Random(seed)
    trees = {f"r{i}": random_tree(rng, i % 4) for i in range(16)}
    rows = [(rng.choice("xxxy"), rng.randint(0, 50) * S, tuple({rng.randrange(4) for _ in range(2)})) for _ in range(26)]
    rows += [(None, 3 * S, (0, 1, 2))]
    want = {r for r in brute(trees, rows)}
    assert evaluated(spark, trees, rows, bucket) == want and len(want) > 50


def test_a_pair_across_the_edge_of_an_hour(spark):
    rows = [("k", 3599 * S, (0,)), ("k", 3601 * S, (1,)), ("k", 9000 * S, (0,)), ("k", 12601 * S, (1,))]
    trees = {"and": Observed(combine="AND", of=(Observed(0), Observed(1)), within=3600)}
    assert evaluated(spark, trees, rows, 3600) == {("and", "k", 3601 * S, 3599 * S)}


def test_steps_under_one_span(spark):
    rows = [("k", t * S, (i,)) for t, i in ((1, 0), (5, 0), (7, 1), (9, 2), (14, 2), (15, 3), (30, 3))]
    steps = tuple(Observed(i) for i in range(4))
    trees = {"near": Observed(combine="FOLLOWEDBY", of=steps, within=10), "any": Observed(combine="FOLLOWEDBY", of=steps)}
    assert evaluated(spark, trees, rows, 2) == {
        ("near", "k", 15 * S, 5 * S), ("any", "k", 15 * S, 5 * S), ("any", "k", 30 * S, 5 * S)}


def test_trees_survive_text_and_have_spans():
    tree = Observed(combine="AND", within=5.5, start=1, stop=9, of=(
        Observed(2, repeats=3), Observed(combine="OR", of=(Observed(0), Observed(1, within=2)))))
    assert O.from_text(tree.text()) == tree
    assert tree.span() == 5.5 and tree.of[0].span() is None and tree.of[1].span() == 2
    with pytest.raises(ValueError):
        O.compiled({"r": Observed(of=(Observed(0), Observed(1)))})


def test_a_busy_key_is_split_by_time(spark):
    """Nine tenths of the rows in one key: no task of the running maximum holds more than a bucket."""
    df = spark.range(20_000).select(
        F.when(F.col("id") % 10 < 9, "hot").otherwise(F.col("id").cast("string")).alias("k"),
        (F.col("id") * S).alias("ns"), (F.col("id") % 7).alias("kind"))
    found = O.together(df, ["k"], "ns", [F.col("kind") == i for i in range(3)], 100, "FOLLOWEDBY")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and "_bucket" in plan
    rows = [("hot", i * S, (i % 7,)) for i in range(3000) if i % 10 < 9]
    want = {(last, first) for _, _, last, first in brute_chain(rows, 100)}
    got = {(r.ns, r.first_ns) for r in found.where("k = 'hot'").where(F.col("ns") < 3000 * S).collect()}
    assert got == want and len(got) > 100


def brute_chain(rows, within):
    """Latest start of 0, 1, 2 in order for each time of a 2."""
    start0 = start1 = None
    out = []
    for key, t, (kind,) in rows:
        if kind == 2 and start1 is not None and t - start1 <= within * S:
            out.append((0, key, t, start1))
        if kind == 1:
            start1 = start0 if start1 is None else max(start0, start1)
        if kind == 0:
            start0 = t
    return out
