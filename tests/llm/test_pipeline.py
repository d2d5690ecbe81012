import re
import unicodedata
import zlib
from collections import Counter

import numpy as np

import corpus_pipeline
from watchfold.llm import exact_dedup, language_id, near_dedup
from watchfold.llm.shared import components


def test_stages_take_effect(spark, testdata):
    docs = spark.read.parquet(f"{testdata}/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, testdata)
        assert kept.columns == docs.columns
        assert kept.join(before, "doc_id", "left_anti").count() == 0
    packed = corpus_pipeline.run(spark, testdata)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in kept.select("doc_id").collect()}
    # Nothing of a group is left beside another, and every group has one left.
    texts = kept.select("doc_id", "text")
    assert exact_dedup.exact_dedup(texts).where("not kept").count() == 0
    assert near_dedup.jaccard_join(texts).where("class_id <> doc_id").count() == 0
    whole = near_dedup.jaccard_join(language_id.accepted(docs))
    assert {r.class_id for r in whole.collect()} == {r.doc_id for r in kept.select("doc_id").collect()}


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 105), (105, 103), (7, 7), (200, 201), (201, 200)]
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.root for r in got} == {i: 0 for i in range(1, 41)} | {103: 100, 105: 100, 201: 200}


def test_any_documents(spark, make):
    docs = make(["a b c d e f", "a b c d e f", None, "", "12", "x " * 30_000, (7, "twice"), (7, "twice"), (None, "none")])
    for table in (docs, make([])):
        kept = table
        for _, stage in corpus_pipeline.STAGES:
            kept = stage(spark, kept, "")
        assert {r.doc_id for r in kept.collect()} <= {r.doc_id for r in table.collect()}
    assert kept.count() == 0


def brute_kept(rows):
    """Ids left of (id, text): letters, equal texts, then groups of similar shingle sets."""
    left = {i: t for i, t in rows if t and any(unicodedata.category(c)[0] == "L" for c in t)}
    first = {}
    for i, t in sorted(left.items()):
        first.setdefault(re.sub("[ \t-\r]+", " ", t), i)
    left = {i: left[i] for i in first.values()}
    sets = {}
    for i, t in left.items():
        words = re.findall("[0-9a-z\x80-\U0010ffff]+", t.lower())
        sets[i] = {tuple(words[k:k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())
    group = {i: i for i in sets}
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both) and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = {i: low if g == high else g for i, g in group.items()}
    return {i: left[i] for i in ids if group[i] == i}


def test_like_brute_force(spark, testdata):
    import public_tokenizers
    from tokenizers import Tokenizer

    rows = [tuple(r) for r in spark.read.parquet(f"{testdata}/documents.parquet").select("doc_id", "text").collect()]
    kept = brute_kept(rows)
    assert len(kept) < len(rows)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = {}
    for r in corpus_pipeline.run(spark, testdata).collect():
        pieces.setdefault(r.doc_id, []).append(r)
    assert set(pieces) == set(kept)
    filled = Counter()
    for i, text in kept.items():
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.piece):
            part = np.array(ids[at:at + r.length], "<u4")
            assert (r.start, r.length) == (at, len(part)) and r.ids_crc32 == zlib.crc32(part.tobytes())
            at += r.length
            filled[r.sequence_id] += r.length
        assert at == len(ids)
    assert max(filled.values()) <= 2048
    least = -(-sum(filled.values()) // 2048)
    assert len(filled) <= least + max(1, least // 20)
    for s in filled:
        own = sorted((r.offset, r.length) for p in pieces.values() for r in p if r.sequence_id == s)
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))]
