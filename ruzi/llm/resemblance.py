"""The exact side of near-duplicate removal: Jaccard similarity of five-word shingles.

Two documents are linked if they share at least ``SIMILAR`` of the shingles that
either has; the groups are the connected components of the links.  No pair is
left to chance:

* Texts of equal shingle sets collapse first.
* :mod:`ruzi.llm.simhash` finds partners by its vantage-point trees over the
  fingerprints of the same shingles, and the rows nearest by size in a shared bucket
  (below) are tried, too.  What the exact check confirms is united.
* Trees prune only within a few bits, and similar texts may be 12 apart, so the rest
  comes another way.  Shingles have one order for all documents, rare ones first.  Of
  ``n`` shingles two linked documents share one of the first ``n // 5 + 1``, so they
  meet in the buckets of those.  Buckets whose rows are united by now are done; in
  the others, places in that order, sizes and the parities of the shingles' bits
  bound from above what a pair can share, and what stays is compared shingle by
  shingle.

The order comes from counts within batches of rows, which bear upon the number of pairs to compare
and never on which are linked.

Scale: the rows are written once with a key, and shuffled once when the kept ones
are taken.  Buckets shuffle 32 bytes before compression for a fifth of the words, and
a bucket of many groups is compared block by block, so that no task gets all of it.
Shingle sets are made for documents of pairs within all bounds only.  ``MAX_COMMON``
shingles and a bitmap of ``SLOTS`` bits are collected, whatever the input.
Intermediate tables are deleted once they have been used.

Defined results: case and white space don't matter; a text of less than five words
is one shingle, and so are null, empty and blank texts, which are equal; an empty
table gives an empty result.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ruzi.llm import simhash
from ruzi.llm.common import discard, first_rows, keyed, map_batches, written
from ruzi.llm.components import components

#: Similar: shared / all >= SIMILAR, as a fraction of whole numbers.
SHINGLE, SEED, SIMILAR = 5, 42, (4, 5)
#: Documents counted together for the order, and how many common shingles it puts last.
COUNTED, MAX_COMMON = 4096, 1 << 17
#: Rows that a shard of buckets is meant to hold, rows of a bucket compared as one block, and slots by which texts to read again are chosen.
SHARD_ROWS, BLOCK_ROWS, SLOTS = 200_000, 4096, 1 << 22
#: Bits of the parities by which pairs of a bucket are told apart, and neighbours tried at first.
SKETCH, NEAR = 512, 2


def shingles(text: str, size: int = SHINGLE) -> np.ndarray:
    """XXH64 values, each once, ascending."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda a, b: a + b + 1))
    starts = [0, *(end + 1 for end in ends[:-1])]
    last = ends[size - 1 :] or ends[-1:] or [0]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], seed=SEED) for a, b in zip(starts, last)], np.uint64))


def are_similar(shared: np.ndarray | int, size_a: np.ndarray | int, size_b: np.ndarray | int) -> np.ndarray | bool:
    part, whole = SIMILAR
    return (part + whole) * shared >= part * (size_a + size_b)


def first_of(found: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The shingles of which a similar set has one at least, in the common order; ``common`` ascends."""
    part, whole = SIMILAR
    many = len(found) - -(-part * len(found) // whole) + 1
    at = np.searchsorted(common, found)
    known = np.zeros(len(found), bool)
    known[at < len(common)] = common[at[at < len(common)]] == found[at < len(common)]
    rare = found[~known]
    if len(rare) >= many:
        return rare[:many]
    frequent, often = found[known], counts[at[known]]
    return np.concatenate([rare, frequent[np.lexsort((frequent, often))]])[:many]


def parity_of(found: np.ndarray, bits: int | None = None) -> bytes:
    """For each value of the shingles' low bits, whether an odd number of them has it; as many bits as shingles or more."""
    bits = bits or max(64, 1 << (len(found) - 1).bit_length())
    return np.packbits(np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).tobytes()


def least_apart(a: bytes, b: bytes) -> int:
    """How many shingles two sets don't share, at least, from their parities."""
    x, y = (np.frombuffer(each, np.uint64) for each in sorted((a, b), key=len))
    # One low bit less adds the parities of the upper half to the lower.
    return int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)))).sum())


def common_shingles(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that come twice or more in some of the batches of rows (column text), ascending, and their counts there."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for low in range(0, batch.num_rows, COUNTED):
                found = [shingles(value.as_py() or "") for value in batch.column(0).slice(low, COUNTED)]
                found = np.sort(np.concatenate(found))
                starts = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
                times = np.diff(starts, append=len(found))
                out.append((found[starts[times > 1]].view(np.int64), times[times > 1]))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(part)) for part in zip(*out)], names=["shingle", "n"])

        return work

    counted = written(map_batches(rows.select("text"), make, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("count")))
    # The counts down to which there are no more than MAX_COMMON: a row for each count that occurs, most of them rare.
    least, room = 1 << 62, MAX_COMMON
    for row in counted.groupBy("count").agg(F.count(F.lit(1)).alias("shingles")).orderBy(F.desc("count")).limit(MAX_COMMON).toLocalIterator():
        room -= row.shingles
        if room < 0:
            break
        least = row["count"]
    found = counted.where(F.col("count") >= least).toPandas()
    discard(counted)
    values = found["shingle"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(values)
    return values[order], found["count"].to_numpy(np.int64)[order]


SIGNS = "key long, doc_id long, tie long, node long, size int, fp long, parity binary, sketch binary, first array<long>"


def signatures(rows: DataFrame) -> DataFrame:
    """key, doc_id, tie (a text's hash), node (of equal sets), size, fingerprint, parity, sketch and first shingles of each row."""
    common, counts = common_shingles(rows)

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            nodes, sizes, prints, parities, sketches, first = [], [], [], [], [], []
            for value in batch.column(3):
                found = shingles(value.as_py() or "")
                nodes.append(xxhash.xxh3_64_intdigest(found.tobytes()))
                sizes.append(len(found))
                prints.append(simhash.majority(found))
                parities.append(parity_of(found))
                sketches.append(parity_of(found, SKETCH))
                first.append(first_of(found, common, counts).view(np.int64))
            columns = [
                *(batch.column(i) for i in range(3)),
                pa.array(np.array(nodes, np.uint64).view(np.int64)),
                pa.array(sizes, pa.int32()),
                pa.array(np.array(prints, np.uint64).view(np.int64)),
                pa.array(parities, pa.binary()),
                pa.array(sketches, pa.binary()),
                pa.array(first, pa.list_(pa.int64())),
            ]
            return pa.RecordBatch.from_arrays(columns, names=[field.split()[0] for field in SIGNS.split(", ")])

        return work

    narrow = rows.select("key", "doc_id", F.xxhash64("text").alias("tie"), "text")
    return map_batches(narrow, make, SIGNS)


def shared_buckets(reps: DataFrame) -> DataFrame:
    """bucket, key, size and place of the first shingles that two rows at least have."""
    each = reps.select("size", "key", F.posexplode("first").alias("place", "bucket")).select("bucket", "key", "size", "place")
    return each.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("bucket"))).where("n > 1").drop("n")


def may_share(size_a, place_a, size_b, place_b):
    """Whether rows that meet at those places of their orders can be similar; for columns as for arrays."""
    least = F.least if isinstance(size_a, F.Column) else np.minimum
    return are_similar(least(size_a - place_a, size_b - place_b), size_a, size_b)


def neighbours(buckets: DataFrame, steps: int = NEAR) -> DataFrame:
    """u and v: rows that are next to each other by size in a bucket, up to ``steps`` apart."""
    in_order = Window.partitionBy("bucket").orderBy("size", "key")
    this = F.struct("key", "size", "place")
    pairs = buckets.select(this.alias("a"), F.array(*[F.lead(this, i).over(in_order) for i in range(1, steps + 1)]).alias("next"))
    pairs = pairs.select("a", F.explode("next").alias("b"))
    pairs = pairs.where(may_share(F.col("a.size"), F.col("a.place"), F.col("b.size"), F.col("b.place")))
    return pairs.select(F.least("a.key", "b.key").alias("u"), F.greatest("a.key", "b.key").alias("v"))


def by_fingerprint(reps: DataFrame) -> DataFrame:
    """u and v: rows whose fingerprints the vantage-point trees link, each to the first row of its partner."""
    prints = written(reps.groupBy("fp").agg(F.min("key").alias("first_key")))
    linked = written(simhash.links(prints.select("fp"), prints.count()))
    same = reps.select("key", "fp").join(prints, "fp").where(F.col("key") != F.col("first_key")).select("key", "first_key")
    ends = prints.select(F.col("fp").alias("u"), F.col("first_key").alias("a")), prints.select(F.col("fp").alias("v"), F.col("first_key").alias("b"))
    apart = linked.distinct().join(ends[0], "u").join(ends[1], "v").select("a", "b")
    return same.union(apart).select(F.least("key", "first_key").alias("u"), F.greatest("key", "first_key").alias("v"))


def pairs_of(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Keys of rows of one cell (columns cell, lo, hi, block, key, size, place, group, sketch) that all bounds let be similar.

    Rows of different blocks are paired if the cell is for two blocks, and all rows if it is for one.
    """
    rows = rows.sort_values(["bucket", "lo", "hi", "size", "key"], ignore_index=True)
    cell = rows.groupby(["bucket", "lo", "hi"], sort=False).ngroup().to_numpy()
    key, size, place, group, block = (rows[name].to_numpy(np.int64) for name in ("key", "size", "place", "group", "block"))
    crossed = (rows["lo"] != rows["hi"]).to_numpy()
    sketch = np.frombuffer(b"".join(rows["sketch"]), np.uint64).reshape(len(rows), -1)
    left, right, at, step = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.arange(len(rows)), 1
    while len(at):
        at = at[at + step < len(rows)]
        at = at[cell[at] == cell[at + step]]
        # Sizes ascend, so whoever is too small for this one is for all after it.
        at = at[are_similar(size[at], size[at], size[at + step])]
        a = at[(group[at] != group[at + step]) & (~crossed[at] | (block[at] != block[at + step]))]
        b = a + step
        may = may_share(size[a], place[a], size[b], place[b])
        a, b = a[may], b[may]
        both = size[a] + size[b]
        apart = np.bitwise_count(sketch[a] ^ sketch[b]).sum(1, dtype=np.int64)
        may = are_similar((both - apart) / 2, both, 0)
        left.append(key[a[may]])
        right.append(key[b[may]])
        step += 1
    left, right = np.concatenate(left), np.concatenate(right)
    return np.minimum(left, right), np.maximum(left, right)


def rest_of_buckets(buckets: DataFrame, signs: DataFrame) -> DataFrame:
    """u and v: pairs of rows of different groups (column group) that share a bucket and may be similar."""
    whole = Window.partitionBy("bucket")
    mixed = buckets.withColumns({
        "low": F.min("group").over(whole), "high": F.max("group").over(whole), "n": F.count(F.lit(1)).over(whole),
    }).where("low < high").drop("low", "high")
    mixed = written(mixed.join(signs.select("key", "sketch"), "key"))
    blocks = F.ceil(F.col("n") / BLOCK_ROWS)
    cells = mixed.withColumn("block", F.pmod(F.xxhash64("key"), blocks.cast("long")))
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), (blocks - 1).cast("long"))))
    cells = cells.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})
    shards = max(1, -(-mixed.count() // SHARD_ROWS))
    shard = F.pmod(F.xxhash64("bucket", "lo", "hi"), F.lit(shards)).cast("int").alias("shard")

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        u, v = pairs_of(rows)
        return pd.DataFrame({"u": u, "v": v}).drop_duplicates()

    narrow = cells.select(shard, "bucket", "lo", "hi", "block", "key", "size", "place", "group", "sketch")
    return narrow.groupBy("shard").applyInPandas(work, "u long, v long").distinct()


def with_both(pairs: DataFrame, of: DataFrame, names: list[str]) -> DataFrame:
    """The pairs with the named columns of both their rows."""
    for end in ("u", "v"):
        side = of.select(F.col("key").alias(f"key_{end}"), *[F.col(name).alias(f"{name}_{end}") for name in names])
        pairs = pairs.join(side, F.col(end) == F.col(f"key_{end}")).drop(f"key_{end}")
    return pairs


def similar(pairs: DataFrame, signs: DataFrame, rows: DataFrame) -> DataFrame:
    """Those of the pairs that are similar."""

    def bounded():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            size_a, a, size_b, b = (batch.column(i) for i in range(2, 6))
            size = size_a.to_numpy().astype(np.int64) + size_b.to_numpy()
            apart = np.array([least_apart(x.as_py(), y.as_py()) for x, y in zip(a, b)], np.int64)
            may = are_similar((size - apart) / 2, size, 0)
            return batch.select([0, 1]).filter(pa.array(may))

        return work

    def sets():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            batch = batch.filter(pa.array(chosen[batch.column(2).to_numpy()]))
            found = [shingles(value.as_py() or "").tobytes() for value in batch.column(1)]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["key", "found"])

        return work

    def compared():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            same = []
            for a, b in zip(batch.column(2), batch.column(3)):
                a, b = np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64)
                same.append(bool(are_similar(len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b))))
            return batch.select([0, 1]).filter(pa.array(same, pa.bool_()))

        return work

    may = written(map_batches(with_both(pairs, signs, ["size", "parity"]), bounded, "u long, v long"))
    # Texts aren't shuffled: whose slot is an end's gets its set, and the join drops those that came by chance.
    slot = F.pmod(F.xxhash64("key"), F.lit(SLOTS)).cast("int")
    ends = may.select(F.col("u").alias("key")).union(may.select("v")).select((slot + 1).alias("bit"))
    maps = ends.groupBy(F.bitmap_bucket_number("bit").alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    chosen = np.zeros(SLOTS, bool)
    for at, bits in maps.collect():
        found = np.unpackbits(np.frombuffer(bytes(bits), np.uint8), bitorder="little").astype(bool)
        chosen[(at - 1) * len(found) : at * len(found)] = found
    found = written(map_batches(rows.select("key", "text", slot.alias("slot")), sets, "key long, found binary"))
    same = written(map_batches(with_both(may, found, ["found"]), compared, "u long, v long"))
    discard(may, found)
    return same


def links(reps: DataFrame, signs: DataFrame, rows: DataFrame) -> DataFrame:
    """u and v, keys, with the components of all similar pairs of ``reps`` (key, size, fp and first shingles of different sets)."""
    buckets = written(shared_buckets(reps))
    near = written(by_fingerprint(reps).union(neighbours(buckets)).distinct())
    linked = similar(near, signs, rows)
    labels = components(linked)
    joined = buckets.join(labels, F.col("key") == F.col("node"), "left").withColumn("group", F.coalesce("component", "key"))
    rest = written(rest_of_buckets(joined.drop("node", "component"), signs).join(near, ["u", "v"], "left_anti"))
    discard(buckets, near, labels)
    more = similar(rest, signs, rows)
    discard(rest)
    return linked.union(more)


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents less all but the first row of each group, with their columns.

    First is by doc_id, rows without one last, then by the text's hash.
    """
    kept = keyed(docs)
    rows = kept.select("key", F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.text").alias("text"))
    signs = written(signatures(rows))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tie", "key")
    nodes = written(signs.groupBy("node").agg(F.min(order).alias("first_row")))
    names = nodes.select(F.col("first_row.key").alias("rep"))
    reps = signs.select("key", "size", "fp", "first").join(names, F.col("key") == F.col("rep"), "left_semi")
    labels = components(links(reps, signs, rows)).withColumnRenamed("node", "linked")
    groups = nodes.join(labels, F.col("first_row.key") == F.col("linked"), "left")
    first = groups.groupBy(F.coalesce("component", "first_row.key")).agg(F.min("first_row").alias("first_row"))
    kept = first_rows(kept, first.select("first_row.key"))
    discard(signs, nodes)
    return kept
