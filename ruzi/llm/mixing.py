"""Mixing sources to target weights along a time-varying curriculum.

Targets: sources in code point order (null last) get weights in turn; all words
are shared out by weight, no source above ``multiple`` times its own words, the
excess reshared among the others.

Taking: a source's documents stand in the order of a digest of their ids and texts and are
gone through again and again until the target's words are taken.  The document
that crosses the target gives its leading words only, so a source's words come to
its target rounded.

Positions: each source has a weight schedule over training time 0 to 1, linear
between knots.  Its integral, normalised, is the source's cumulative demand; a
copy that starts after a share q of its source's words belongs at the time when
demand reaches q.  Copies are range-sorted by that time.

DataFrame functions only.  Scale: running sums go by ``BUCKETS`` digest ranges
per source, so a source with a third of all documents is spread over thousands of
tasks; only sums per bucket, and one row per source, pass through windows that
span a source or all sources.  Those windows are as long as there are buckets or
sources.  Rows without an id, or of one id, are spread by their texts' digests, and rows without
words stay out of the sums; what a bucket does hold together are rows equal in id and text.
``mixture`` moves a text twice: to its running sum, and to its place in the order; the narrow
way (sums by key, then a join) would write all rows once more before it.

Defined results: a null or empty text has no words and is never taken; null is a
source of its own; rows equal in id and size are interchangeable; without words
every target is zero; an empty table gives an empty result; columns of any name
pass through ``mixture``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ruzi.llm.common import WORD, discard, even, written

WEIGHTS = (1, 2, 3)
MULTIPLE = 3
#: Hex digits of the digest that name a bucket.
BUCKET_DIGITS = 3

Knots = tuple[tuple[float, float], ...]
#: Knots (time, weight) for the sources in turn: early, even, late.
SCHEDULES: tuple[Knots, ...] = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)))


def inverse_demand(share: Column, knots: Knots) -> Column:
    """The time at which the normalised integral of the schedule reaches ``share``."""
    pieces = [(t0, t1, w0, w1) for (t0, w0), (t1, w1) in zip(knots, knots[1:]) if t1 > t0 and w0 + w1 > 0]
    area = sum((t1 - t0) * (w0 + w1) / 2 for t0, t1, w0, w1 in pieces)
    done, out = 0.0, None
    for t0, t1, w0, w1 in pieces:
        grown = (t1 - t0) * (w0 + w1) / 2
        rest = (share - F.lit(done)) * F.lit(area)
        root = F.sqrt(F.lit(w0 * w0) + F.lit(2 * (w1 - w0) / (t1 - t0)) * rest)
        time = F.lit(t0) + F.when(rest <= 0, 0.0).otherwise(F.lit(2.0) * rest / (F.lit(w0) + root))
        done += grown / area
        out = F.when(share <= done, time) if out is None else out.when(share <= done, time)
    return F.least(out.otherwise(F.lit(pieces[-1][1])), F.lit(pieces[-1][1]))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def digest_of(text: Column) -> Column:
    """A number that tells rows of one id apart by their texts."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def source_targets(totals: DataFrame, weights: tuple[int, ...], multiple: int, kinds: int) -> DataFrame:
    """One row per source: _mix_key, _mix_total, _mix_target and _mix_kind (its turn among schedules)."""
    by_name = Window.orderBy(F.col("_mix_source").asc_nulls_last())
    turn = F.row_number().over(by_name) - 1
    weight = F.lit(weights[-1])
    for i, value in enumerate(weights):
        weight = F.when(turn % len(weights) == i, F.lit(value)).otherwise(weight)
    sources = totals.groupBy("_mix_key", "_mix_source").agg(F.sum("_mix_words").alias("_mix_total"))
    sources = sources.withColumns({"_mix_kind": turn % kinds, "_mix_weight": weight})
    sources = sources.withColumn("_mix_cap", multiple * F.col("_mix_total"))
    sources = sources.withColumn("_mix_ratio", F.col("_mix_cap") / F.col("_mix_weight"))
    ordered = Window.orderBy("_mix_ratio", "_mix_key")
    every = Window.partitionBy()
    capped = F.coalesce(F.sum("_mix_cap").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    below = F.coalesce(F.sum("_mix_weight").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    level = (F.sum("_mix_total").over(every) - capped) / (F.sum("_mix_weight").over(every) - below)
    sources = sources.withColumn("_mix_level", level)
    # The first source in order of cap by weight that its level doesn't fill sets the level of all after it.
    fits = F.when(F.col("_mix_level") <= F.col("_mix_ratio"), F.col("_mix_level"))
    common = F.max(fits).over(every)
    target = F.least(F.col("_mix_cap").cast("double"), common * F.col("_mix_weight"))
    return sources.select("_mix_key", "_mix_total", "_mix_kind", target.alias("_mix_target"))


def planned(docs: DataFrame, size: Column, digest: Column, weights: tuple[int, ...] = WEIGHTS, multiple: int = MULTIPLE, kinds: int = len(SCHEDULES)) -> tuple[DataFrame, DataFrame]:
    """Documents with words and those without, as a struct _mix_row with _mix_size, _mix_total, _mix_target, _mix_kind and _mix_before (words of their source before them).

    What the columns of ``docs`` are called doesn't matter, as none stands beside the names used here.
    ``digest`` is a number of each text's, by which rows of one id differ.
    """
    source, doc_id = docs["source"].cast("string"), docs["doc_id"].cast("string")
    rows = docs.select(
        F.struct(*[docs[f"`{name}`"] for name in docs.columns]).alias("_mix_row"),
        size.alias("_mix_size"),
        source.alias("_mix_source"),
        F.when(source.isNull(), "n").otherwise(F.concat(F.lit("s"), source)).alias("_mix_key"),
        docs["doc_id"].alias("_mix_id"),
        F.md5(F.concat_ws(":", F.coalesce(doc_id, F.lit("")), digest.cast("string")).cast("binary")).alias("_mix_order"),
    )
    rows = rows.withColumn("_mix_bucket", F.substring("_mix_order", 1, BUCKET_DIGITS))
    totals = written(rows.groupBy("_mix_key", "_mix_source", "_mix_bucket").agg(F.sum("_mix_size").alias("_mix_words")))
    earlier = Window.partitionBy("_mix_key").orderBy("_mix_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.withColumn("_mix_base", F.coalesce(F.sum("_mix_words").over(earlier), F.lit(0)))
    targets = source_targets(totals, weights, multiple, kinds)
    targets = written(targets)
    base = written(base.select("_mix_key", "_mix_bucket", "_mix_base").join(targets, "_mix_key"))
    discard(totals)
    # Rows without words take none, wherever they stand, and however many a source has of them.
    idle = rows.where("_mix_size = 0").join(targets, "_mix_key").withColumn("_mix_before", F.lit(0).cast("long"))
    inside = Window.partitionBy("_mix_key", "_mix_bucket").orderBy("_mix_order", F.col("_mix_id").asc_nulls_first(), "_mix_size")
    before = F.coalesce(F.sum("_mix_size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    busy = rows.where("_mix_size > 0").withColumn("_mix_inner", before).join(base, ["_mix_key", "_mix_bucket"])
    busy = busy.withColumn("_mix_before", F.col("_mix_base") + F.col("_mix_inner"))
    kept = ["_mix_row", "_mix_size", "_mix_order", "_mix_total", "_mix_kind", "_mix_target", "_mix_before"]
    return busy.select(*kept), idle.select(*kept)


def copy_words(copy: Column | int) -> Column:
    """Words that the mix takes of a document the ``copy``-th time, counted from 0."""
    quota = F.round("_mix_target").cast("long")
    return F.greatest(F.lit(0), F.least(F.col("_mix_size"), quota - copy * F.col("_mix_total") - F.col("_mix_before")))


def position(copy: Column | int, schedules: tuple[Knots, ...] = SCHEDULES) -> Column:
    """Training time from 0 to 1 at which that copy starts."""
    share = (copy * F.col("_mix_total") + F.col("_mix_before")) / F.round("_mix_target")
    out = None
    for i, knots in enumerate(schedules):
        when = F.col("_mix_kind") == i
        out = F.when(when, inverse_demand(share, knots)) if out is None else out.when(when, inverse_demand(share, knots))
    return out


def report(docs: DataFrame, multiple: int = MULTIPLE, schedules: tuple[Knots, ...] = SCHEDULES) -> DataFrame:
    """doc_id, size, source_size, target, taken and position (of the first copy, null where none is taken) by position."""
    narrow = written(docs.select(F.col("doc_id").cast("long"), "source", word_count(F.col("text")).alias("words"), digest_of(F.col("text")).alias("digest")))
    busy, idle = planned(narrow, F.col("words"), F.col("digest"), multiple=multiple, kinds=len(schedules))
    taken = sum((copy_words(copy) for copy in range(1, multiple)), copy_words(0))
    found = busy.unionByName(idle).select(
        F.col("_mix_row.doc_id").alias("doc_id"), F.col("_mix_size").alias("size"), F.col("_mix_total").alias("source_size"), F.col("_mix_target").alias("target"),
        taken.alias("taken"), F.when(copy_words(0) > 0, position(0, schedules)).alias("position"), "_mix_order",
    )
    # What isn't taken follows, spread by digests, or it would be one range.
    rest = 1 + even("_mix_order", F.monotonically_increasing_id())
    return found.orderBy(F.coalesce("position", rest), "doc_id").drop("_mix_order")


def leading_words(text: Column, count: Column) -> Column:
    """The text up to the end of its ``count``-th word."""
    parts = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])", -1)
    return F.array_join(F.slice(parts, F.lit(1), count.cast("int")), "")


def mixture(docs: DataFrame, multiple: int = MULTIPLE, schedules: tuple[Knots, ...] = SCHEDULES) -> DataFrame:
    """The documents as the mix takes them, a row per copy, range-sorted by training time, with the columns of ``docs``.

    A copy that is taken in part has the leading words, and n_chars to match.
    """
    rows, _ = planned(docs, word_count(docs["text"]), digest_of(docs["text"]), multiple=multiple, kinds=len(schedules))
    rows = rows.withColumn("_mix_copy", F.explode(F.array(*[F.lit(i) for i in range(multiple)])))
    rows = rows.withColumn("_mix_take", copy_words(F.col("_mix_copy"))).where(F.col("_mix_take") > 0)
    rows = rows.withColumn("_mix_time", position(F.col("_mix_copy"), schedules))
    part = F.col("_mix_take") < F.col("_mix_size")
    text = F.when(part, leading_words(F.col("_mix_row.text"), F.col("_mix_take"))).otherwise(F.col("_mix_row.text"))
    rows = rows.withColumn("_mix_text", text).orderBy("_mix_time", "_mix_row.doc_id")
    out = {"text": F.col("_mix_text")}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(part, F.length("_mix_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_mix_row.n_chars"))
    return rows.select(*[out.get(name, F.col(f"_mix_row.`{name}`")).alias(name) for name in docs.columns])


#: DuckDB SQL for the rows of ``report`` with the values above.
SQL = r"""
WITH steps AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps
), d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || xor(list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(c >> 8, steps[(xor(c, x) & 255) + 1])), 4294967295)) AS o
  FROM (SELECT *, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS bytes FROM documents), steps
), p AS (
  SELECT *, CAST(sum(size) OVER (PARTITION BY source ORDER BY o, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS c FROM d
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS z, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source
), w AS (
  SELECT *, k % 3 + 1 AS weight, CAST(3 * z AS DOUBLE) / (k % 3 + 1) AS ratio FROM s
), v AS (
  SELECT *, CAST(sum(z) OVER () - coalesce(sum(3 * z) OVER (ORDER BY ratio, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
            / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY ratio, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS level
  FROM w
), t AS (
  SELECT source, z, k % 3 AS kind, least(CAST(3 * z AS DOUBLE), max(CASE WHEN level <= ratio THEN level END) OVER () * weight) AS target FROM v
), j AS (
  SELECT doc_id, size, z AS source_size, target, kind, c, CAST(round(target) AS BIGINT) AS quota, CAST(c AS DOUBLE) / round(target) AS q
  FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  greatest(0, least(size, quota - c)) + greatest(0, least(size, quota - source_size - c))
    + greatest(0, least(size, quota - 2 * source_size - c)) AS taken,
  CASE WHEN least(size, quota - c) > 0 THEN CASE
    WHEN q <= 0 THEN 0.0
    WHEN kind = 0 THEN 2.0 * q / (1.5 + sqrt(2.25 - 2.0 * q))
    WHEN kind = 1 THEN 2.0 * q / (1.0 + sqrt(1.0 + 0.0 * q))
    ELSE 2.0 * q / (0.5 + sqrt(0.25 + 2.0 * q)) END END AS position
FROM j
"""
