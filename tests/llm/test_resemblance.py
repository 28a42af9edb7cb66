from __future__ import annotations

import random

import numpy as np
import pandas as pd
from cases import DOC_SCHEMA, edge_rows

import corpus_pipeline as cp
from ruzi.llm import resemblance as rs
from ruzi.llm import simhash as sh


def plain_set(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute_first(rows):
    """The rows that stay: all pairs compared, the first by doc_id of each group, without ids last."""
    sets = [plain_set(text) for _, text, *_ in rows]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root[top(i)] = top(j)
    groups = {}
    for i, row in enumerate(rows):
        groups.setdefault(top(i), []).append(row)
    return [min(group, key=lambda r: (r[0] is None, r[0] or 0)) for group in groups.values()]


def varied_rows(seed=5):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = [rng.choice(words) for _ in range(60)]
    rows = edge_rows()
    for i in range(80):
        base = [rng.choice(words) for _ in range(rng.randint(5, 90))] + (passage if i % 3 == 0 else [])
        for k in range(4):
            copy = list(base)
            for _ in range(k * rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = f"changed{rng.random()}"
            rows.append((1000 + i * 10 + k, " ".join(copy), "en", "s", 1))
    return rows


def test_stage_equals_all_pairs(spark):
    rows = varied_rows()
    docs = spark.createDataFrame([(*r, 7) for r in rows], DOC_SCHEMA + ", key int")
    kept = cp.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    got = sorted((r.doc_id for r in kept.collect()), key=str)
    assert got == sorted((r[0] for r in brute_first(rows)), key=str)
    assert len(got) < len(rows) - 60
    assert cp.near_duplicates(spark, docs.where("false"), "").count() == 0


def test_similar_texts_far_apart_as_fingerprints_are_one(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(500)]
    base = [rng.choice(words) for _ in range(200)]
    texts = []
    while not texts:
        copy = list(base)
        for at in rng.sample(range(200), 4):
            copy[at] = f"new{rng.random()}"
        a, b = " ".join(base), " ".join(copy)
        if (sh.fingerprint(a) ^ sh.fingerprint(b)).bit_count() > 2 and len(plain_set(a) & plain_set(b)) / len(plain_set(a) | plain_set(b)) >= 0.8:
            texts = [a, b]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOC_SCHEMA)
    assert [r.doc_id for r in cp.near_duplicates(spark, docs, "").collect()] == [0]


def test_bounds_keep_similar_pairs():
    rng = np.random.default_rng(1)
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for size in (1, 2, 4, 5, 6, 9, 10, 11, 40, 400):
        for _ in range(50):
            a = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
            b = np.unique(np.concatenate([rng.permutation(a)[: -(-9 * size // 10)], rng.integers(0, 1 << 63, size // 10).astype(np.uint64)]))
            shared = len(np.intersect1d(a, b))
            if rs.are_similar(shared, len(a), len(b)):
                half = np.sort(a[::2]), np.arange(len(a[::2]))
                for common in (none, half):
                    assert set(rs.first_of(a, *common).tolist()) & set(rs.first_of(b, *common).tolist())
                assert rs.least_apart(rs.parity_of(a), rs.parity_of(b)) <= len(a) + len(b) - 2 * shared


def test_pairs_of_blocks_lose_no_similar_pair():
    """Cells of one block and of two give every similar pair of a bucket, united groups left out."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(40) > 0.06], rng.integers(0, 1 << 63, int(rng.integers(0, 4))).astype(np.uint64)])) for _ in range(60)]
    rows = []
    for key, found in enumerate(sets):
        block = key % 3
        for other in range(3):
            rows.append((7, min(block, other), max(block, other), block, key, len(found), 0, key // 2, rs.parity_of(found, rs.SKETCH)))
    frame = pd.DataFrame(rows, columns=["bucket", "lo", "hi", "block", "key", "size", "place", "group", "sketch"])
    got = set(zip(*(part.tolist() for part in rs.pairs_of(frame))))
    want = {
        (a, b) for a in range(60) for b in range(a + 1, 60)
        if a // 2 != b // 2 and rs.are_similar(len(np.intersect1d(sets[a], sets[b])), len(sets[a]), len(sets[b]))
    }
    assert want and want <= got


def test_blocks_of_a_large_bucket(spark, monkeypatch):
    monkeypatch.setattr(rs, "BLOCK_ROWS", 8)
    monkeypatch.setattr(rs, "SHARD_ROWS", 50)
    rng = random.Random(6)
    words = [f"w{i}" for i in range(60)]
    base = [rng.choice(words) for _ in range(40)]
    rows = []
    for i in range(120):
        copy = list(base)
        for at in rng.sample(range(40), rng.randint(0, 3)):
            copy[at] = f"new{rng.random()}"
        rows.append((i, " ".join(copy), "en", "s", 1))
    got = cp.near_duplicates(spark, spark.createDataFrame(rows, DOC_SCHEMA), "")
    assert sorted(r.doc_id for r in got.collect()) == sorted(r[0] for r in brute_first(rows))
