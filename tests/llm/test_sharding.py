from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
from cases import DOC_SCHEMA, edge_rows

from ruzi.llm import sharding


def plain(rows, shards=16):
    """Shard and slot by one sort and one running sum."""
    digest = lambda b: int(hashlib.md5(b).hexdigest()[:15], 16)
    keyed = []
    for doc_id, text, *_ in rows:
        raw = (text or "").encode()
        keyed.append((digest(raw), digest(str(doc_id).encode() if doc_id is not None else b""), doc_id or 0, len(raw) + 1, zlib.crc32(raw), doc_id))
    keyed.sort(key=lambda k: k[:3])
    total, at, ends, out, slots = sum(k[3] for k in keyed), 0, [], [], {}
    for i, key in enumerate(keyed):
        at += key[3]
        ends.append((at, i + 1 == len(keyed) or keyed[i + 1][0] != key[0]))
    largest, cuts = max((k[3] for k in keyed), default=0), []
    for k in range(1, shards):
        wanted = k * total // shards
        near = [(not group, abs(end - wanted), end) for end, group in ends if abs(end - wanted) <= largest]
        cuts.append(min(near)[2] if near else wanted)
    for (*_, size, crc, doc_id), (end, _) in zip(keyed, ends):
        number = sum(end > cut for cut in cuts)
        slots[number] = slots.get(number, -1) + 1
        out.append((doc_id, size, crc, number, slots[number]))
    return out


def check(spark, rows):
    docs = spark.createDataFrame([(*r, "x") for r in rows], DOC_SCHEMA + ", size string")
    got = [(r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in sharding.shard(docs).collect()]
    assert sorted(got, key=str) == sorted(plain(rows), key=str)
    return got


def test_shards_equal_one_sort(spark):
    rng = random.Random(8)
    rows = [(i, "w" * rng.randint(0, 3000), "en", "s", 1) for i in range(600)]
    got = check(spark, rows)
    sums = np.zeros(16)
    for _, size, _, number, _ in got:
        sums[number] += size
    assert sums.max() - sums.min() <= 2 * 3001


def test_small_groups_of_copies_stay_whole(spark):
    rows = [(i, f"text {i // 5} " * 40, "en", "s", 1) for i in range(1000)] + [(5000, "x" * 3000, "en", "s", 1)]
    got = check(spark, rows)
    shards = {}
    for doc_id, _, crc, number, _ in got:
        shards.setdefault(crc, set()).add(number)
    assert max(map(len, shards.values())) == 1


def test_a_hot_text_is_divided(spark):
    rows = [(i, "the same text" if i % 3 else f"own text {i}", "en", "s", 1) for i in range(3000)]
    check(spark, rows)


def test_awkward_rows(spark):
    check(spark, edge_rows())
    assert sharding.shard(spark.createDataFrame([], DOC_SCHEMA)).count() == 0


def test_range_numbers():
    rng = np.random.default_rng(2)
    keys, bounds = rng.integers(0, 4, (200, 3)), np.unique(rng.integers(0, 4, (10, 3)), axis=0)
    want = [sum(tuple(b) <= tuple(k) for b in bounds.tolist()) for k in keys.tolist()]
    assert sharding.range_numbers(keys, bounds).tolist() == want


def test_overfull_ranges_are_subdivided(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RANGE_BYTES", 1 << 10)
    rows = [(i, "hot" * 50 if i % 2 else f"{i}" * 20, "en", "s", 1) for i in range(4000)]
    found = sharding.written(sharding.records(spark.createDataFrame(rows, DOC_SCHEMA)))
    by_range, sums, _ = sharding.split_ranges(found)
    total = sum(size for size, _ in sums.values())
    ranges = -(-total // (1 << 10))
    assert by_range.count() == 4000 == sum(count for _, count in sums.values())
    assert max(size for size, _ in sums.values()) <= 3 * total / ranges
