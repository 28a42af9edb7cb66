"""Near-duplicates by SimHash and vantage-point trees.

A document's fingerprint is the bitwise majority of the XXH64 values of its
three-word shingles.  Fingerprints within ``radius`` bits are linked, and the
groups are the connected components of the links.

* Equal fingerprints collapse first, so copies cost one row per task.
* Vantage-point trees over a bounded sample of fingerprints split the Hamming
  space into shards, one tree for each of ``PARTS`` runs of bits.  Of two fingerprints
  within ``radius`` bits some run differs in ``radius // PARTS`` at most, so that is the
  bound of the triangle by which a tree prunes.  A fingerprint has one home shard in each tree;
  it also visits each shard across a boundary that may hold a partner, and only from
  the outer to the inner side, so that a pair meets once.  With ``PARTS`` above the radius
  the bound is 0 and nobody visits: rows shuffled per fingerprint stay ``PARTS`` at any size,
  where one tree over all bits takes more as the corpus grows (README has the figures).
* Each shard goes on splitting by vantage points over all bits in memory, where boundaries overlap by
  the radius, down to blocks that are compared exactly.  Pairs are united at once: a shard
  returns an edge to its group's least member per linked fingerprint and never
  the pairs of a group.
* Distributed rounds join the shards' groups.

Scale: texts are read once and not shuffled; fingerprints (16 bytes a document)
are written to the shared folder.  The sample has at most ``MAX_SAMPLE`` rows
whatever the input, drawn below a threshold of the fingerprint's digest; beyond
``MAX_SAMPLE / SAMPLE_PER_SHARD`` shards their size grows with the corpus.  No link,
component or fingerprint of the corpus is collected.

Defined results: a null, empty or blank text has fingerprint zero and is linked
like any other; a group of documents without an id has a null component; repeated
rows are linked to each other; an empty table gives an empty result; other
columns don't matter.
"""

from __future__ import annotations

from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruzi.llm.common import bounded_sample, discard, even, first_rows, keyed, map_batches, written
from ruzi.llm.components import components

SHINGLE, SEED, RADIUS = 3, 42, 2
#: Runs of bits with a tree each.
PARTS, BITS = 3, 64
#: Fingerprints that a shard is meant to be home to.
SHARD_SIZE = 4096
#: Sampled fingerprints per shard, and at most.
SAMPLE_PER_SHARD, MAX_SAMPLE = 16, 1 << 20
#: Fingerprints compared as one block in a shard.
BLOCK = 128
CHUNK = 1 << 16


def fingerprint(text: str, size: int = SHINGLE) -> int:
    """Unsigned; zero without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda a, b: a + b + 1))
    starts = [0, *(end + 1 for end in ends[:-1])]
    last = ends[size - 1 :] or ends[-1:]
    digest, counts, total = xxhash.xxh64_digest, np.zeros(64, np.int64), len(last)
    for low in range(0, total, CHUNK):
        hashes = b"".join([digest(joined[a:b], seed=SEED) for a, b in zip(starts[low : low + CHUNK], last[low : low + CHUNK])])
        counts += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > total).tobytes(), "big")


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of unsigned 64-bit hashes that are there already."""
    counts = np.zeros(BITS, np.int64)
    for low in range(0, len(hashes), CHUNK):
        counts += np.unpackbits(hashes[low : low + CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp, a signed long, of each row."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = np.array([fingerprint(value.as_py() or "") for value in batch.column(1)], np.uint64)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

        return work

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), make, "doc_id long, fp long")


EVERY = np.uint64(2**BITS - 1)


def masks(parts: int) -> list[np.uint64]:
    """The bits of each part, runs of nearly equal length."""
    edges = [i * BITS // parts for i in range(parts + 1)]
    return [np.uint64((1 << high) - (1 << low)) for low, high in zip(edges, edges[1:])]


class Split(NamedTuple):
    """Inner side: distance to ``point`` within the ``mask`` at most ``bound``."""

    point: np.uint64
    bound: int
    mask: np.uint64 = EVERY

    def distance(self, found: np.ndarray) -> np.ndarray:
        return np.bitwise_count((found ^ self.point) & self.mask).astype(np.int64)


def choose_split(found: np.ndarray, radius: int, mask: np.uint64 = EVERY, tries: int = 6) -> Split | None:
    """Of some vantage points and bounds, those with the fewest boundary rows for their evenness; None if no bound divides."""
    best, least = None, np.inf
    for i in np.linspace(0, len(found) - 1, tries).astype(int):
        counts = np.bincount(np.bitwise_count((found ^ found[i]) & mask), minlength=65 + radius)
        inner = counts.cumsum()[:64] / len(found)
        crossing = np.array([counts[b + 1 : b + 1 + radius].sum() for b in range(64)]) / len(found)
        even = -(inner * np.log2(np.maximum(inner, 1e-12)) + (1 - inner) * np.log2(np.maximum(1 - inner, 1e-12)))
        cost = np.where((inner >= 0.15) & (inner <= 0.85), (crossing + 0.01) / np.maximum(even, 1e-12), np.inf)
        b = int(cost.argmin())
        if cost[b] < least:
            best, least = Split(found[i], b, mask), cost[b]
    return best


def divide(found: np.ndarray, home: np.ndarray, split: Split, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Who goes on to the inner and to the outer side, as masks."""
    far = split.distance(found)
    inner = (far <= split.bound) | (far <= split.bound + radius)
    outer = (far > split.bound) | (~home & (far > split.bound - radius))
    return inner, outer


class Tree:
    """The shards: a vantage-point tree over a sample, by the distances within a mask."""

    def __init__(self, sample: np.ndarray, shards: int, radius: int = RADIUS, mask: np.uint64 = EVERY):
        self.radius, self.mask = radius, mask
        self.splits: list[tuple[Split, int, int] | None] = []
        self._grow(sample, max(1, len(sample) // max(1, shards)))

    def _grow(self, found: np.ndarray, least: int) -> int:
        at = len(self.splits)
        self.splits.append(None)
        split = choose_split(found, self.radius, self.mask) if len(found) >= 2 * least and len(found) > 2 else None
        if split is not None:
            inner = split.distance(found) <= split.bound
            self.splits[at] = (split, self._grow(found[inner], least), self._grow(found[~inner], least))
        return at

    def assign(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows (index, shard, home): each index once at home and once for each visit."""
        out, todo = [], [(0, np.arange(len(found)), np.ones(len(found), bool))]
        while todo:
            at, rows, home = todo.pop()
            if not len(rows):
                continue
            if self.splits[at] is None:
                out.append((rows, np.full(len(rows), at), home))
                continue
            split, left, right = self.splits[at]
            inner, outer = divide(found[rows], home, split, self.radius)
            at_home_in = home & (split.distance(found[rows]) <= split.bound)
            todo.append((left, rows[inner], at_home_in[inner]))
            todo.append((right, rows[outer], (home & ~at_home_in)[outer]))
        return tuple(np.concatenate(part) for part in zip(*out)) if out else (np.zeros(0, int),) * 3


class Groups:
    """Union-find over indices in whole-array steps; a root is its group's least index."""

    def __init__(self, size: int):
        self.parent = np.arange(size)

    def roots(self, of: np.ndarray) -> np.ndarray:
        found = self.parent[of]
        while True:
            up = self.parent[found]
            if np.array_equal(up, found):
                return found
            found = up

    def unite(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.roots(a), self.roots(b)
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))


def shard_groups(found: np.ndarray, home: np.ndarray, radius: int = RADIUS, block: int = BLOCK) -> np.ndarray:
    """The least linked index of each index, over all pairs within ``radius`` of which one at least is at home."""
    groups = Groups(len(found))
    todo = [np.arange(len(found))]
    homes = [home]
    while todo:
        rows, at_home = todo.pop(), homes.pop()
        own = rows[at_home]
        if not len(own):
            continue
        split = choose_split(found[own], radius) if len(own) > block else None
        if split is not None:
            inner, outer = divide(found[rows], at_home, split, radius)
            # Where nearly all cross the boundary, splitting makes more work than it saves.
            if inner.sum() + outer.sum() <= 1.8 * len(rows):
                home_in = at_home & (split.distance(found[rows]) <= split.bound)
                todo += [rows[inner], rows[outer]]
                homes += [home_in[inner], (at_home & ~home_in)[outer]]
                continue
        for i in range(0, len(own), 256):
            part = own[i : i + 256]
            for j in range(0, len(rows), 4096):
                other = rows[j : j + 4096]
                a, b = np.nonzero(np.bitwise_count(found[part][:, None] ^ found[other][None, :]) <= radius)
                groups.unite(part[a], other[b])
    return groups.roots(np.arange(len(found)))


def links(distinct: DataFrame, count: int, radius: int = RADIUS, shard_size: int = SHARD_SIZE, parts: int = PARTS) -> DataFrame:
    """u and v: for each linked fingerprint of column fp, one edge per shard to its group's least there."""
    shards = max(1, -(-count // shard_size))
    size = min(MAX_SAMPLE, SAMPLE_PER_SHARD * shards)
    sample = bounded_sample(distinct.select("fp"), even("fp"), size, size / max(1, count)).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    trees = [Tree(sample, shards, radius // parts, mask) for mask in masks(parts)]

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            found, out = batch.column(0).to_numpy().view(np.uint64), []
            for i, tree in enumerate(trees):
                rows, shard, home = tree.assign(found)
                out.append((shard * len(trees) + i, found[rows].view(np.int64), home))
            shard, fp, home = (np.concatenate(column) for column in zip(*out))
            columns = [shard.astype(np.int64), fp, home.astype(bool)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["shard", "fp", "home"])

        return work

    def group(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("fp", ignore_index=True)
        found = rows["fp"].to_numpy(np.int64)
        root = shard_groups(found.view(np.uint64), rows["home"].to_numpy(bool), radius)
        linked = root != np.arange(len(found))
        return pd.DataFrame({"u": found[linked], "v": found[root[linked]]})

    return map_batches(distinct.select("fp"), make, "shard long, fp long, home boolean").groupBy("shard").applyInPandas(group, "u long, v long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp and component_id of each row; component_id is the least doc_id that links reach."""
    marked = written(fingerprints(docs))
    distinct = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    edges = written(links(distinct, distinct.count(), radius))
    labels = components(edges)
    linked = distinct.join(labels, F.col("fp") == F.col("node")).select("fp", "first_id", "component")
    least = linked.groupBy("component").agg(F.min("first_id").alias("least_id"))
    named = written(linked.join(least, "component").select(F.col("fp").alias("linked_fp"), "least_id"))
    names = written(distinct.join(named, F.col("fp") == F.col("linked_fp"), "left").select(
        F.col("fp").alias("name_fp"),
        F.when(F.col("linked_fp").isNull(), F.col("first_id")).otherwise(F.col("least_id")).alias("component_id"),
    ))
    discard(distinct, edges, labels, named)
    return marked.join(names, F.col("fp") == F.col("name_fp")).select("doc_id", "fp", "component_id")


def hex_of(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def deduplicated(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The documents less all but the first row of each group, with their columns.

    First is by doc_id, rows without one last, then by the text's hash.
    """
    kept = keyed(docs)
    rows = kept.select("key", F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.text").alias("text"))
    groups = near_duplicates(rows.select(F.col("key").alias("doc_id"), "text"), radius).select(F.col("doc_id").alias("key"), "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.xxhash64("text").alias("tie"), "key")
    named = rows.select("key", order.alias("first_row")).join(groups, "key")
    first = named.groupBy("component_id").agg(F.min("first_row").alias("first_row"))
    return first_rows(kept, first.select("first_row.key"))
