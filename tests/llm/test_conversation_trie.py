import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from watchfold.llm import conversation_trie as T
from watchfold.llm import scans

TURNS = "conv_id long, turn long, role string, text string"


def brute(rows, share=20, most=4):
    """Every prefix as a tuple of turns."""
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn, role or "", text or ""))

    def order(t):
        return t[0] is not None, t[0] or 0, hashlib.sha256(f"{len(t[1].encode())}:{t[1]}{t[2]}".encode()).hexdigest()[:30]

    original = {c: [t[1:] for t in sorted(v, key=order)] for c, v in convs.items()}
    members, ends = {}, {}
    for c, own in original.items():
        h = zlib.crc32(str(c).encode()) % most if share else 0
        base = c - (c % share if c >= 0 else -(-c % share)) if share else c
        seq = original.get(base, [])[:h] + own[h:]
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append(c)
        ends.setdefault(tuple(seq), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        under = kids.get(p, [])
        leaves[p] = sum(leaves[q] for q in under) if under else 1
        saved[p] = sum(saved[q] for q in under) + ((len(members[p]) - 1) * len(p[-1][1].encode().split()) if p else 0)
    return {(min(m), len(p)): (
        min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), leaves[p], saved[p],
        hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()) for p, m in members.items()}


def result(spark, rows, share=20, **sizes):
    turns = spark.createDataFrame(rows, TURNS).withColumn("node", F.lit("x")).withColumn("key", F.lit(1))
    slim = T.written(T.digested(turns.repartition(3) if rows else turns), "t")
    if share:
        built, members = T.rebuilt(slim, share)
        nodes, ends = T.prefix_trie(built, [F.col("own"), F.col("n")], members, **sizes)
    else:
        nodes, ends = T.conversation_trie(turns, **sizes)
    out = nodes.join(T.ends_digest(ends), "node", "left").collect()
    empty = hashlib.sha256(b"").hexdigest()
    found = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens,
                                    r.ends_sha256 or empty) for r in out}
    assert len(found) == len(out)
    return found


def conversations(seed, count, words, most_turns):
    rng = random.Random(seed)
    return [(c, t, rng.choice(["user", None, "assistant"]), " ".join(rng.choices(words, k=rng.randint(0, 3))))
            for c in rng.sample(range(-30, 3 * count), count) for t in range(rng.randint(1, most_turns))]


@pytest.mark.parametrize("share", [20, 0])
def test_like_all_prefixes(spark, share):
    rows = conversations(share, 120, ["a", "b"], 7)
    rows += rows[:15]                                                   # repeated rows
    rows += [(5, None, "user", "first"), (7, 2, None, None), (None, 1, "user", "nowhere")]
    rows += [(301, t, "user", "" if t % 2 else "same words") for t in range(400)]  # a third of all rows
    rows += [(302, t, "user", "" if t % 2 else "same words") for t in range(400)]
    rows += [(9, 3, "user", "word " * 100_000), (10, 1, "user", "tie"), (10, 1, "user", "tie2")]
    # Small shards and queues: trees over shard roots, spilled runs, keys over many partitions.
    assert result(spark, rows, share, shard_rows=40, queue_rows=5) == brute(rows, share)


def test_small_tables(spark):
    assert result(spark, []) == {}
    assert result(spark, [(None, 0, "user", "a")]) == {}
    one = [(3, None, None, None)]
    assert result(spark, one) == brute(one)
    short = [(c, 0, "user", "a") for c in range(21, 40)]                # no base: many keep no turn
    assert result(spark, short) == brute(short)
    silent = [(c, 0, "user", "a") for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4]
    assert result(spark, silent) == brute(silent) and len(brute(silent)) == 1


def test_a_queue_spills_and_keeps_its_order():
    rng, queue, kept = random.Random(1), T.SpillingQueue(10), []
    for _ in range(500):
        message = (rng.randint(0, 50), bytes([rng.randint(0, 9)]), 1, 1, rng.randint(0, 9))
        queue.push(message)
        kept.append(message)
        if rng.random() < 0.3:
            assert queue.least() == min(kept)
            assert queue.pop() == min(kept)
            kept.remove(min(kept))
    assert queue.spilled > 10
    assert [queue.pop() for _ in range(len(kept))] == sorted(kept) and queue.least() is None


def test_totals_across_many_shards(spark):
    rng = random.Random(4)
    parent = {i: rng.randrange(max(0, i - 30), i) for i in range(1, 1500)}
    level = {0: 0}
    for i in range(1, 1500):
        level[i] = level[parent[i]] + 1
    name = {i: i.to_bytes(2) for i in level}
    weight = {i: (rng.randint(0, 3), rng.randint(0, 9)) for i in level}
    rows = [(name[i], level[i], name[parent[i]] if i else None, level[parent[i]] if i else None, name[rng.randrange(1500)],
             *weight[i]) for i in level]
    tree = T.written(spark.createDataFrame(
        rows, "node binary, level long, parent binary, up long, path binary, leaves long, saved long"), "t")
    want = {i: [0, *weight[i]] for i in level}
    for i in range(1499, 0, -1):
        want[parent[i]][0] += 1
        want[parent[i]][1] += want[i][1]
        want[parent[i]][2] += want[i][2]
    got = T.subtree_totals(tree, shard_rows=100, queue_rows=20, least_shards=2).collect()
    assert {int.from_bytes(r.node): [r.kids, r.leaves, r.saved] for r in got} == want


def test_hash_of_neighbouring_stretches():
    def of(elements):
        value = 0
        for e in elements:
            value = (value * scans.BASE + e) % scans.PRIME
        return value

    a, b = [5, 7, 9], [1, 2]
    assert scans.combined(3, of(a), b"ab", 2, of(b), b"c") == (5, of(a + b), b"abc")
