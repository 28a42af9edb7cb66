from __future__ import annotations

import random
import re

import numpy as np
import xxhash
from cases import DOC_SCHEMA, EDGE_TEXTS, edge_rows

from ruzi.llm import simhash as sh


def plain_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def roots_by_all_pairs(found, home=None, radius=2):
    root = list(range(len(found)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(found)):
        near = np.nonzero(np.bitwise_count(found[i + 1 :] ^ found[i]) <= radius)[0] + i + 1
        for j in near:
            if home is None or home[i] or home[j]:
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return [top(x) for x in range(len(found))]


def clustered(rng, centres, each, flips):
    found = set()
    for _ in range(centres):
        centre = rng.getrandbits(64)
        found.add(centre)
        for _ in range(each):
            value = centre
            for _ in range(rng.randint(1, flips)):
                value ^= 1 << rng.randrange(64)
            found.add(value)
    return np.array(sorted(found), np.uint64)


def test_fingerprints():
    for text in EDGE_TEXTS + ["a b c", "A  b\tC", "x y z w", "ß É ÀB"]:
        assert sh.fingerprint(text or "") == plain_fingerprint(text or "")


def test_shards_lose_no_pair():
    rng = random.Random(9)
    for found in (clustered(rng, 300, 3, 5), clustered(rng, 1, 900, 4), clustered(rng, 5, 200, 3), np.arange(1000, dtype=np.uint64)):
        want = roots_by_all_pairs(found)
        assert sh.shard_groups(found, np.ones(len(found), bool), block=16).tolist() == want
        tree = sh.Tree(found[:: 3], 12)
        index, shard, home = tree.assign(found)
        assert np.array_equal(np.sort(index[home.astype(bool)]), np.arange(len(found)))
        groups = sh.Groups(len(found))
        for number in set(shard.tolist()):
            rows = np.sort(index[shard == number])
            at_home = np.isin(rows, index[(shard == number) & home.astype(bool)])
            groups.unite(rows, rows[sh.shard_groups(found[rows], at_home, block=16)])
        assert groups.roots(np.arange(len(found))).tolist() == want


def test_trees_over_parts_lose_no_pair_and_visits_stay_flat():
    rng = random.Random(10)
    for radius, parts in ((2, 3), (2, 2), (3, 2), (5, 3)):
        found = np.concatenate([clustered(rng, 300, 3, radius + 2), clustered(rng, 1, 400, 3)])
        found = np.unique(found)
        want = roots_by_all_pairs(found, radius=radius)
        groups = sh.Groups(len(found))
        for mask in sh.masks(parts):
            index, shard, home = sh.Tree(found[::3], 12, radius // parts, mask).assign(found)
            assert radius >= parts or len(index) == len(found)
            for number in set(shard.tolist()):
                rows = np.sort(index[shard == number])
                at_home = np.isin(rows, index[(shard == number) & home.astype(bool)])
                groups.unite(rows, rows[sh.shard_groups(found[rows], at_home, radius, block=16)])
        assert groups.roots(np.arange(len(found))).tolist() == want
    assert sum(map(int, sh.masks(3))) == 2**64 - 1


def test_majority_equals_the_fingerprint():
    hashes = [xxhash.xxh64(f"{i} {i + 1} {i + 2}".encode(), seed=42).intdigest() for i in range(90)]
    assert sh.majority(np.array(hashes, np.uint64)) == sh.fingerprint(" ".join(map(str, range(92))))


def brute_components(rows):
    ids = [(row[0], plain_fingerprint(row[1] or "")) for row in rows]
    found = np.array([fp for _, fp in ids], np.uint64)
    roots = roots_by_all_pairs(found)
    least = {}
    for (doc_id, _), root in zip(ids, roots):
        if doc_id is not None:
            least[root] = min(doc_id, least.get(root, doc_id))
    return [(doc_id, f"{fp:016x}", least.get(root)) for (doc_id, fp), root in zip(ids, roots)]


def sorted_rows(rows):
    return sorted(rows, key=str)


def test_query_equals_all_pairs(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(500)]
    rows = edge_rows()
    for i in range(200, 260):
        base = [rng.choice(words) for _ in range(120)]
        for k in range(4):
            copy = list(base)
            if k:
                copy[rng.randrange(120)] = "changed"
            rows.append((i * 10 + k, " ".join(copy), "en", "s", 1))
    docs = spark.createDataFrame([(*r, 7) for r in rows], DOC_SCHEMA + ", fp int")
    got = sh.near_duplicates(docs)
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in got.select("doc_id", sh.hex_of(got.fp).alias("fingerprint"), "component_id").collect()]
    want = brute_components(rows)
    assert sorted_rows(got) == sorted_rows(want)
    assert len({r[2] for r in want}) < len(rows) - 30  # there are groups
    kept = sh.deduplicated(docs)
    assert kept.columns == docs.columns
    with_id = [r.doc_id for r in kept.collect() if r.doc_id is not None]
    assert sorted(with_id) == sorted({doc_id for doc_id, _, component in want if doc_id is not None and doc_id == component})


def test_empty_table(spark):
    docs = spark.createDataFrame([], DOC_SCHEMA)
    assert sh.near_duplicates(docs).count() == 0
    assert sh.deduplicated(docs).count() == 0


def test_rows_are_dropped_by_row_and_not_by_id(spark):
    texts = ["a clean text that comes twice", "another text altogether of its own", "third words that nobody else has"]
    rows = [(1, texts[0]), (2, texts[0]), (2, texts[1]), (3, texts[2]), (3, "fourth of the texts, same id as third"), (None, texts[1]), (None, "x y z"), (None, "x y z")]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], DOC_SCHEMA)
    got = [(r.doc_id, r.text) for r in sh.deduplicated(docs).collect()]
    assert sorted_rows(got) == sorted_rows([rows[0], rows[2], rows[3], rows[4], rows[6]])
