"""Secret scans with multipart credential linking.

Base kinds, leftmost non-overlapping, failing matches dropped:

* assign: a keyword, ``:`` or ``=``, and a value of 6 or more characters
* access: ``AKIA`` and capitals or digits, 20 or more characters
* hex: 24 or more of ``[0-9a-f]``

The method adds weak candidates: ``id`` (a value assigned to a user, client or
key id), ``key`` (40 characters of mixed base64) and ``endpoint`` (an address with
a service's scheme).  Alone they mean nothing.  An interval join sweeps the parts
of a scope by position and reports a candidate only where a complementary part
lies within ``SCOPE`` characters: an id or endpoint beside a secret, a secret
beside an id or endpoint.  Base assignments and access keys count as parts too;
a run of hex digits by itself doesn't, as most are checksums and commits.

A scope ends at an empty line, at a section's heading in brackets on a line of its
own and at a line of three or more dashes, so the parts of two accounts or hosts
that stand in blocks of their own aren't linked.

DataFrame functions only.  Matches and the text between them are exploded, and
running sums over a text's matches give their offsets, so the work grows with the
matches and not with their square.  Scale: texts are read once and never
shuffled; what is shuffled are the matches, by row, so copies don't gather.  The
sweep is two sorted windows over the parts of one scope.

Defined results: a null or empty text has no spans; offsets count code points;
repeated rows get equal spans; an empty table gives an empty result; other
columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ruzi.llm.common import written

#: Runs of 24 or 20 and more are what the open-ended patterns find, less what is too short.
PATTERNS = {
    "assign": r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
    "id": r"""(?i:(client_?id|access_?key_?id|key_?id|user_?name|user|login))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@-]{4,})""",
    "key": r"(?<![A-Za-z0-9+/=])(?=[A-Za-z+/]*[0-9])(?=[0-9a-z+/]*[A-Z])(?=[0-9A-Z+/]*[a-z])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])",
    "endpoint": r"""(?i:https?|jdbc:[a-z]{1,20}|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqps?|s3)://[^\x20\x09-\x0D"'<>]+""",
}
BASE, WEAK = ("assign", "access", "hex"), ("id", "key", "endpoint")
KINDS = (*BASE, *WEAK)
ROLE = {"assign": "secret", "key": "secret", "access": "id", "id": "id", "endpoint": "endpoint"}
#: What ends a scope; looked for only in texts with weak candidates.
BREAK = r"\n[\x20\t\r]*(?=\n)|(?m:^\[[^\]\n]+\][\x20\t\r]*$)|(?m:^-{3,}[\x20\t\r]*$)"
#: Cheap tests that a text with a match must pass.
HINT = {
    "assign": r"(?i:password|passwd|secret|token|api_?key)",
    "id": r"(?i:client_?id|key_?id|user|login)",
    "endpoint": r"://",
}
LEAST_VALUE = 6
SCOPE = 200

SPAN = "struct<start:int,rank:int,end:int,kind:string>"
#: A match by kind and place: the characters before it since the last, its own and its value's.
MATCH = "struct<rank:int,place:int,gap:int,hit:int,value:int>"
NO_MATCHES, NO_SPANS = f"CAST(array() AS array<{MATCH}>)", f"CAST(array() AS array<{SPAN}>)"
BREAK_RANK = len(KINDS)


def matches(text: Column, rank: int, pattern: str, worth: Column) -> Column:
    """An array of MATCH, in the text's order; none where it isn't ``worth`` a look."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if KINDS[rank : rank + 1] == ("assign",) else hits
    parts = F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits)).alias("gap"), hits.alias("hit"), values.alias("value"))
    found = F.transform(parts, lambda part, i: F.struct(
        F.lit(rank).alias("rank"), i.cast("int").alias("place"),
        *[F.length(part[name]).alias(name) for name in ("gap", "hit", "value")],
    ))
    return F.when(worth, found).otherwise(F.expr(NO_MATCHES))


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, row_key and the matches of all kinds and, where a part of the method's is among them, of breaks."""
    text = F.col("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    base, weak = (
        F.concat(*[matches(text, KINDS.index(kind), PATTERNS[kind], text.rlike(HINT.get(kind, PATTERNS[kind]))) for kind in kinds])
        for kinds in (BASE, WEAK)
    )
    rows = rows.select("doc_id", "text", base.alias("base"), weak.alias("weak"))
    breaks = matches(text, BREAK_RANK, BREAK, F.size("weak") > 0)
    return rows.select("doc_id", F.monotonically_increasing_id().alias("row_key"), F.concat("base", "weak", breaks).alias("matches"))


def spans_of(rows: DataFrame) -> DataFrame:
    """doc_id, row_key, rank, start and end of each match, breaks included, and whether it counts."""
    each = rows.where(F.size("matches") > 0).select("doc_id", "row_key", F.explode("matches").alias("m")).select("doc_id", "row_key", "m.*")
    # All that follows goes by row, so the rows are dealt once.
    in_order = Window.partitionBy("row_key", "rank").orderBy("place")
    ends = F.sum(F.col("gap") + F.col("hit")).over(in_order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    spans = each.repartition("row_key").withColumn("end", ends).withColumn("start", F.col("end") - F.col("hit"))
    counts = (F.col("rank") < BREAK_RANK) & ((F.col("rank") != BASE.index("assign")) | (F.col("value") >= LEAST_VALUE))
    return spans.select("doc_id", "row_key", "rank", "start", "end", counts.alias("counts"))


def linked(spans: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``kept`` for each match: base ones that count, and weak ones with a complementary part within ``scope``."""
    so_far = Window.partitionBy("row_key").orderBy("start", F.desc("rank"), "end").rowsBetween(Window.unboundedPreceding, 0)
    parts = spans.withColumn("scope_no", F.sum((F.col("rank") == BREAK_RANK).cast("int")).over(so_far))
    role = F.create_map(*[F.lit(x) for kind, of in ROLE.items() for x in (KINDS.index(kind), of)])[F.col("rank")]
    parts = parts.withColumn("role", F.when(F.col("counts"), role))
    forth = Window.partitionBy("row_key", "scope_no").orderBy("start", "rank", "end").rowsBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy("row_key", "scope_no").orderBy(F.desc("start"), F.desc("rank"), F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    near = {}
    for of in ("secret", "id", "endpoint"):
        ended = F.max(F.when(F.col("role") == of, F.col("end"))).over(forth)
        begins = F.min(F.when(F.col("role") == of, F.col("start"))).over(back)
        near[of] = F.coalesce(F.col("start") - ended <= scope, F.lit(False)) | F.coalesce(begins - F.col("end") <= scope, F.lit(False))
    parts = parts.withColumns({f"near_{of}": close for of, close in near.items()})
    beside = F.when(F.col("role") == "secret", F.col("near_id") | F.col("near_endpoint")).otherwise(F.col("near_secret"))
    kept = F.col("counts") & ((F.col("rank") < len(BASE)) | beside)
    return parts.select("doc_id", "row_key", "rank", "start", "end", kept.alias("kept"))


def joined(spans: Column) -> Column:
    texts = F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(texts, ",")


def find(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, a count for each base kind, base_sha256, spans and n_linked for each document."""
    rows = written(scanned(docs))
    kind = F.element_at(F.array(*[F.lit(kind) for kind in KINDS]), F.col("rank") + 1)
    span = F.struct("start", "rank", "end", kind.alias("kind"))
    with_spans = linked(spans_of(rows), scope).groupBy("row_key").agg(
        F.first("doc_id").alias("doc_id"),
        F.collect_list(F.when(F.col("kept") & (F.col("rank") < len(BASE)), span)).alias("base"),
        F.collect_list(F.when(F.col("kept"), span)).alias("every"),
    )
    quiet = rows.where(F.size("matches") == 0).select("doc_id", F.expr(NO_SPANS).alias("base"), F.expr(NO_SPANS).alias("every"))
    found = quiet.unionByName(with_spans.select("doc_id", "base", "every"))
    counts = [F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}") for kind in BASE]
    return found.select(
        "doc_id", *counts, F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("every")).alias("spans"), (F.size("every") - F.size("base")).cast("long").alias("n_linked"),
    )
