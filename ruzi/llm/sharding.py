"""Shards of nearly equal bytes by sampled splitters.

Keys are drawn with a chance proportional to their record's size, quantiles of
the draw become boundaries, and records are range-partitioned by them.  Ranges
that turn out overfull are subdivided at quantiles of a new draw from inside
them.  A shard is a run of whole ranges but for the one that holds its end: there the cut
is made at the record nearest an equal share of all bytes, or at the end of a group of
equal texts if one is no further from it than the largest record is long.

The key begins with a digest of the text, so equal texts are neighbours and stay
in one shard unless a cut falls among so many that their end is too far; then comes a digest of the id,
by which a group of copies can be divided, then the id and the row's number.

Scale: texts are read once, to digest them; what is shuffled are 50 bytes a
record.  The draw is at most ``PER_RANGE`` keys for each of at most ``MAX_RANGES``
ranges, taken below a threshold of its clocks, and the driver holds one row per range.  A range with
a third of all records is subdivided until it has a range's share.  Only the ranges around
cuts are looked into to place them.

Defined results: a null text has size 1 and the checksum of no bytes; a null id
digests as empty; repeated rows get a slot each; the empty table has no rows; with
fewer records than shards some shards stay empty; other columns don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruzi.llm.common import bounded_sample, discard, map_batches, written

SHARDS = 16
#: Bytes that a range is meant to hold, and how many ranges there are at least and at most.
RANGE_BYTES, MIN_RANGES, MAX_RANGES = 4 << 20, 64, 1 << 16
PER_RANGE = 16
#: A range with more than so many times its share is subdivided, in so many rounds at most.
OVERFULL, ROUNDS = 2.0, 4

KEY = ("text_key", "id_key", "row_key")


def records(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the key's columns."""
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = lambda c: F.conv(F.substring(F.md5(c), 1, 15), 16, 10).cast("long")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        digest(text.cast("binary")).alias("text_key"),
        digest(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("id_key"),
        F.monotonically_increasing_id().alias("row_key"),
    )


def draw(rows: DataFrame, count: int, total: int) -> np.ndarray:
    """At most ``count`` keys without replacement, likelier by size: the first in a race of exponential clocks.

    ``total`` is the rows' bytes: by the time ``count / total`` at most ``count`` clocks have run out, give or take.
    """
    chance = (F.pmod(F.xxhash64(*KEY), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    found = bounded_sample(rows.select(*KEY, "size"), -F.log(chance) / F.col("size"), count, count / max(1, total))
    return found.select(*KEY).toPandas().to_numpy(np.int64).reshape(-1, 3)


def quantiles(keys: np.ndarray, count: int) -> np.ndarray:
    """At most ``count`` distinct boundaries at even steps of the sorted keys."""
    keys = np.unique(keys, axis=0)
    at = np.linspace(0, len(keys), count + 2)[1:-1].astype(int) if len(keys) else []
    return np.unique(keys[np.unique(at)], axis=0) if len(keys) else keys


def range_numbers(keys: np.ndarray, boundaries: np.ndarray) -> np.ndarray:
    """For each key the number of boundaries at or below it."""
    both = np.concatenate([boundaries, keys])
    is_key = np.repeat([0, 1], [len(boundaries), len(keys)])
    order = np.lexsort((is_key, both[:, 2], both[:, 1], both[:, 0]))
    below = np.cumsum(is_key[order] == 0)
    out = np.empty(len(both), np.int64)
    out[order] = below
    return out[len(boundaries) :]


def ranged(rows: DataFrame, boundaries: np.ndarray) -> DataFrame:
    """The records with their range's number."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            keys = np.stack([batch.column(name).to_numpy() for name in KEY], axis=1)
            number = pa.array(range_numbers(keys, boundaries))
            return pa.RecordBatch.from_arrays([*batch.columns, number], names=[*batch.schema.names, "range_no"])

        return work

    fields = ", ".join(f"{name} long" for name in ("doc_id", "size", "text_crc32", *KEY, "range_no"))
    return map_batches(rows, make, fields)


def range_sums(rows: DataFrame) -> dict[int, tuple[int, int]]:
    """Bytes and rows by range; one row per range reaches the driver."""
    found = rows.groupBy("range_no").agg(F.sum("size"), F.count("*")).collect()
    return {r[0]: (r[1], r[2]) for r in found}


def split_ranges(rows: DataFrame) -> tuple[DataFrame, dict[int, tuple[int, int]], np.ndarray]:
    """The records by range, none of them overfull if keys can divide it, the ranges' sums and their boundaries."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    ranges = int(min(MAX_RANGES, max(MIN_RANGES, -(-total // RANGE_BYTES))))
    boundaries = quantiles(draw(rows, ranges * PER_RANGE, total), ranges - 1)
    for _ in range(ROUNDS):
        by_range = ranged(rows, boundaries)
        sums = range_sums(by_range)
        full = sorted(n for n, (size, count) in sums.items() if size > OVERFULL * total / ranges and count > 1)
        if not full or len(boundaries) >= 2 * MAX_RANGES:
            break
        parts = sum(-(-sums[n][0] * ranges // total) for n in full)
        # Few and large: a list of the overfull is short, as their sizes add up to the total at most.
        inside = by_range.where(F.col("range_no").isin(full))
        more = quantiles(draw(inside, 4 * PER_RANGE * parts, sum(sums[n][0] for n in full)), 4 * parts)
        added = np.unique(np.concatenate([boundaries, more]), axis=0)
        if len(added) == len(boundaries):
            break
        boundaries = added
    else:
        by_range = ranged(rows, boundaries)
        sums = range_sums(by_range)
    return by_range, sums, boundaries


def cuts_of(placed: DataFrame, spans: list[tuple[int, int, int]], total: int, largest: int, shards: int) -> list[int]:
    """Where shards end, in bytes before them: near equal shares, at a record's end or, if one is near enough, a group's.

    ``spans`` are number, first byte and end of the ranges; those that can hold an end within ``largest`` of a share are looked into.
    """
    wanted = [k * total // shards for k in range(1, shards)]
    near = [number for number, low, high in spans if any(low - largest <= at <= high + largest for at in wanted)]
    ends = placed.where(F.col("range_no").isin(near)).select("upto", "group_end")
    close = F.filter(F.array(*[F.lit(at).cast("long") for at in wanted]), lambda at: F.abs(F.col("upto") - at) <= largest)
    each = ends.select("upto", "group_end", F.explode(close).alias("wanted"))
    # One row per cut and kind of end.
    best = each.groupBy("wanted", "group_end").agg(F.min(F.struct(F.abs(F.col("upto") - F.col("wanted")).alias("off"), "upto")).alias("best"))
    found: dict[int, dict[bool, int]] = {}
    for at, is_group, (_, upto) in best.collect():
        found.setdefault(at, {})[is_group] = upto
    return [kinds.get(True, kinds.get(False)) if (kinds := found.get(at)) else at for at in wanted]


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of each document."""
    rows = written(records(docs))
    by_range, sums, boundaries = split_ranges(rows)
    total = sum(size for size, _ in sums.values())
    at = rows_before = 0
    bases, spans = [], []
    for number in sorted(sums):
        # A range begins with the key that is its boundary.
        bases.append((number, at, rows_before, int(boundaries[number, 0]) if number < len(boundaries) else None))
        spans.append((number, at, at + sums[number][0]))
        at, rows_before = at + sums[number][0], rows_before + sums[number][1]
    spark = docs.sparkSession
    base = spark.createDataFrame(bases or [(0, 0, 0, None)], "base_no long, bytes_before long, rows_before long, next_text long")
    # At most 3 * MAX_RANGES rows of four numbers.
    placed = by_range.join(F.broadcast(base), F.col("range_no") == F.col("base_no"))
    order = "PARTITION BY range_no ORDER BY text_key, id_key, doc_id, row_key"
    placed = written(placed.select(
        "doc_id", "size", "text_crc32", "range_no",
        F.expr(f"bytes_before + sum(size) OVER ({order})").alias("upto"),
        F.expr(f"rows_before + row_number() OVER ({order}) - 1").alias("place"),
        F.expr(f"coalesce(text_key != coalesce(lead(text_key) OVER ({order}), next_text), true)").alias("group_end"),
    ))
    largest = placed.agg(F.max("size")).first()[0] or 0
    cuts = cuts_of(placed, spans, total, largest, shards) if total else []
    number = sum(((F.col("upto") > cut).cast("int") for cut in cuts), F.lit(0))
    placed = placed.withColumn("shard", number)
    first = placed.groupBy("shard").agg(F.min("place").alias("first_place")).withColumnRenamed("shard", "first_shard")
    # One row per shard.
    joined = placed.join(F.broadcast(first), F.col("shard") == F.col("first_shard"))
    discard(rows)
    return joined.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("place") - F.col("first_place")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


#: DuckDB SQL for the rows of ``shard``: one sort by the key, one running sum, and cuts at the ends near equal shares.
SQL = r"""
WITH t AS (
  SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS steps
), d AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), b AS (
  SELECT doc_id, text, octet_length(encode(text)) + 1 AS size,
         list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS bytes,
         CAST('0x' || substr(md5(text), 1, 15) AS BIGINT) AS text_key,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS id_key
  FROM d
), c AS (
  SELECT doc_id, CAST(size AS BIGINT) AS size, text_key, id_key,
         xor(list_reduce(bytes, lambda c, x: xor(c >> 8, steps[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) AS text_crc32
  FROM b, t
), p AS (
  SELECT *, row_number() OVER w - 1 AS place, CAST(sum(size) OVER w AS BIGINT) AS upto, lead(text_key) OVER v IS DISTINCT FROM text_key AS group_end
  FROM c WINDOW w AS (ORDER BY text_key, id_key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), v AS (ORDER BY text_key, id_key, doc_id)
), n AS (
  SELECT CAST(sum(size) AS BIGINT) AS total, max(size) AS largest FROM c
), e AS (
  SELECT k, k * total // 16 AS wanted, largest, min({'off': abs(upto - k * total // 16), 'upto': upto}) FILTER (group_end AND abs(upto - k * total // 16) <= largest) AS groups,
         min({'off': abs(upto - k * total // 16), 'upto': upto}) FILTER (NOT group_end AND abs(upto - k * total // 16) <= largest) AS inside
  FROM p, n, range(1, 16) AS r(k) GROUP BY ALL
), t2 AS (
  SELECT list(coalesce(groups.upto, inside.upto, wanted)) AS cuts FROM e
), s AS (
  SELECT p.*, CAST(len(list_filter(cuts, lambda x: x < upto)) AS INTEGER) AS shard FROM p, t2
)
SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, shard,
       CAST(place - min(place) OVER (PARTITION BY shard) AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM s
"""
