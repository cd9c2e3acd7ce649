"""The pipeline's near-duplicate stage against brute force on both sides of 0.8."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from lanewise.llm import neardup


def shingles(text):
    tokens = (text or "").encode().lower().split()
    return {b" ".join(tokens[k : k + 5]) for k in range(max(1, len(tokens) - 4))} if tokens else set()


def brute_components(texts):
    """{doc_id: smallest doc_id reachable over pairs of Jaccard 0.8 or more}, and all pairs' similarities."""
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in sets}
    near = {}
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            common = len(sets[a] & sets[b])
            union = len(sets[a] | sets[b])
            if 5 * common >= 4 * union:
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
            near[a, b] = common / union if union else 1.0
    return root, near


def near_texts():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    passage = [word() for _ in range(40)]
    texts = []
    for size in (5, 8, 9, 12, 24, 49, 104, 400):
        for _ in range(6):
            base = [word() for _ in range(size)]
            texts.append(" ".join(base))
            shingle_count = size - 4
            for lost in sorted({shingle_count // 5, shingle_count // 5 + 1, shingle_count // 9}):
                texts.append(" ".join(base[: size - lost]))  # drops exactly that many shingles
                changed = [*base[: size - lost], *(word() for _ in range(lost))]
                texts.append(" ".join(changed))
    texts += [" ".join([word() for _ in range(20)] + passage + [word() for _ in range(20)]) for _ in range(30)]
    texts += ["ab " * 400, "ab " * 300, " ".join(["x y z v w"] * 60 + ["q"]), "", None, " ", "one", "One"]
    rng.shuffle(texts)
    return dict(enumerate(texts))


def test_near_dedup_keeps_exactly_the_right_documents(spark):
    texts = near_texts()
    want, near = brute_components(texts)
    values = list(near.values())
    assert sum(v == 0.8 for v in values) > 5 and sum(0.8 < v < 0.9 for v in values) > 20 and sum(0.7 <= v < 0.8 for v in values) > 20
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, source string").repartition(3)
    for block, cluster_block in ((2_048, 256), (5, 3)):
        got = {r.doc_id: r.component_id for r in neardup.near_groups(docs, 5, block, cluster_block).collect()}
        assert got == want
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in want.items() if i == r}
    assert neardup.near_groups(docs.limit(0), 5).count() == 0
    odd = docs.select("doc_id", "text").unionByName(docs.select(F.lit(None).cast("long").alias("doc_id"), "text")).unionByName(docs.select("doc_id", "text"))
    assert {r.doc_id: r.component_id for r in neardup.near_groups(odd, 5).collect()} == want


def test_prefixes_of_similar_sets_meet():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        pool = np.unique(rng.integers(0, 2**63, 3 * n + 5, dtype=np.uint64))
        a = np.sort(rng.choice(pool, n, replace=False))
        common = rng.choice(pool, len(pool) // 3, replace=False)
        b = np.union1d(np.sort(rng.choice(a, int(rng.integers(0, n + 1)), replace=False)), rng.choice(pool, int(rng.integers(0, 4)), replace=False))
        if len(b) and 5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b)):
            assert neardup.similar(a, b) and len(np.intersect1d(neardup.prefix(a, common), neardup.prefix(b, common)))


def test_fingerprints_of_similar_sets_meet_by_their_bits():
    """Large sets at exactly 0.8 share a SimHash group, in tables for few and for many documents, and their other bits are near."""
    rng = np.random.default_rng(8)
    pool = rng.integers(0, 2**63, 90_000, dtype=np.uint64)
    sets = [pool[90 * k : 90 * k + n] for k in range(1_000) for n in (80, 64)]  # 64 of 80
    fps = neardup.as_words(pa.array([neardup.fingerprint(s, neardup.WORDS) for s in sets]), len(sets))
    for count in (1_000, 50_000, 10_000_000):
        plan = neardup.table_plan(count)
        keys = neardup.table_keys(fps, plan)
        assert (keys[::2] == keys[1::2]).any(axis=1).all()
        assert (keys[::2] == np.roll(keys[1::2], 1, axis=0)).sum() < 3 * len(plan) * 1_000 / 2 ** plan.shape[1] + 20
    rest = fps[:, neardup.KEY_BITS // 64 :]
    assert (np.bitwise_count(rest[::2] ^ rest[1::2]).sum(axis=1) <= neardup.RADIUS).all()


def test_pivots_discard_and_lose_no_pair():
    """Near copies of a few texts among strangers in one group: as all pairs counted one by one."""
    rng = np.random.default_rng(4)
    bases = rng.integers(0, 2**64, (3, 2), dtype=np.uint64)
    flips = np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (90, 2, 6), dtype=np.uint64), axis=2)
    sketch = np.concatenate([bases[np.arange(90) % 3] ^ flips, rng.integers(0, 2**64, (60, 2), dtype=np.uint64)])[rng.permutation(150)]
    for blocks in (1, 2):
        columns = {"unit": np.zeros(150, np.int64), "size": np.full(150, 9, np.int32), "own": np.zeros(150, np.int32), "other": np.full(150, blocks - 1, np.int32), "blk": np.arange(150, dtype=np.int32) % blocks}
        whole = pa.table(columns | {"low": sketch[:, 0].view(np.int64), "high": sketch[:, 1].view(np.int64)})
        a, b = neardup.candidate_pairs(whole)
        far = np.bitwise_count(sketch[:, None] ^ sketch[None]).sum(axis=2) > neardup.RADIUS
        assert not far[a, b].any()
        x, y = np.nonzero(~far & ((columns["blk"][:, None] != columns["blk"][None]) | (blocks == 1)))
        found, want = (neardup.local_components(150, p, q) for p, q in ((a, b), (x, y)))
        assert (found[x] == found[y]).all() and (blocks == 2 or np.array_equal(found, want))


def test_simhash_finds_the_pairs_that_shingles_would(spark):
    """Sets of more than a few shingles have no keys but SimHash's."""
    rng = random.Random(3)
    words = [["".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(204)] for _ in range(40)]
    texts = dict(enumerate(" ".join(w[:n]) for w in words for n in (204, 164)))  # 160 of 200 shingles
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    few = neardup.prints(docs, 5).select(F.max(F.size("few"))).first()[0]
    assert few == 0
    want, near = brute_components(texts)
    assert sum(v == 0.8 for v in near.values()) == 40
    assert {r.doc_id: r.component_id for r in neardup.near_groups(docs, 5).collect()} == want
