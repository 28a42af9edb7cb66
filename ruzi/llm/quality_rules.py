"""Host-level quality rules.

Each document is measured once.  The failures of each rule are summed by host,
the hosts' rates are shrunk towards the corpus with a beta prior whose moments
come from the hosts themselves, and the verdict on a host goes back to its
documents.  A host is refused for a rule that its documents pass at most half as often
as all documents do, going by its shrunk rate; a rule that no document passes refuses no host.
A host of few documents is judged by the corpus more than by them; a large one by its own record.

Scale: the text is read once and only counts leave the Python workers.  The
sums by host are combined before the shuffle, so a host with a third of all
documents costs one row per task.  The table of refused hosts is what is joined
back, and Spark splits or broadcasts it by its measured size.

Defined results: a null or empty text has zero words and fails ``short``; a null
host is a host of its own; repeated rows count each time and get equal answers;
an empty table gives an empty result; extra columns of the input are ignored.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruzi.llm.common import map_batches, written

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: A host is refused for a rule that its documents pass at most so much as often as all documents.
PASSING = 0.5

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more, the first occurrence included."""
    if len(words) <= window:
        return 0
    joined = b" ".join(words)
    starts, ends, at = [], [], 0
    for word in words:
        starts.append(at)
        at += len(word)
        ends.append(at)
        at += 1
    windows = [joined[a:b] for a, b in zip(starts, ends[window - 1 :])]
    seen = Counter(windows)
    if len(seen) == len(windows):
        return 0
    covered = until = 0
    for i, found in enumerate(windows):
        if seen[found] > 1:
            covered += i + window - max(i, until)
            until = i + window
    return covered


def measure(text: str) -> tuple[int, ...]:
    """The counts of one text, in the order of COUNTS; lines without a word don't count."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    chars = len(b"".join(words).decode("utf-8", "surrogatepass"))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [line for line in raw.split(b"\n") if line and not line.isspace()]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words), len(lines)


def document_counts(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host and COUNTS for each row."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [measure(value.as_py() or "") for value in batch.column(2)]
            counts = [pa.array(column, pa.int64()) for column in zip(*rows)]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *counts], names=["doc_id", "host", *COUNTS])

        return work

    narrow = docs.select(F.col("doc_id").cast("long"), F.col(host).cast("string").alias("host"), "text")
    return map_batches(narrow, make, "doc_id long, host string, " + ", ".join(f"{name} long" for name in COUNTS))


def rules() -> dict[str, Column]:
    """Each rule by name, true where a document fails it."""
    n = F.col("n_words")
    return {
        "short": n < MIN_WORDS,
        "repeats": 100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * n,
        "symbols": 10 * F.col("n_symbols") > 3 * F.col("word_chars"),
        "lines": 2 * F.col("n_dup_lines") > F.col("n_lines"),
    }


def refused_hosts(counts: DataFrame, passing: float = PASSING) -> DataFrame:
    """host and refused_for, the rules whose shrunk rate is too high, of hosts that have such."""
    names = list(rules())
    failed = [F.sum(test.cast("long")).alias(name) for name, test in rules().items()]
    hosts = counts.groupBy("host").agg(F.count("*").alias("n"), *failed)
    # One row whatever the number of hosts: the moments of the rates.
    moments = hosts.agg(
        F.count("*").alias("hosts"),
        F.sum("n").alias("n"),
        *[F.sum(name).alias(name) for name in names],
        *[F.sum(F.col(name) * F.col(name) / F.col("n")).alias(f"{name}_sq") for name in names],
    ).first()
    bad = []
    for name in names:
        documents, failed = moments["n"] or 0, moments[name] or 0
        alpha, beta = beta_prior(moments["hosts"], documents, failed, moments[f"{name}_sq"] or 0.0)
        shrunk = (F.col(name) + F.lit(alpha)) / (F.col("n") + F.lit(alpha + beta))
        if failed < documents:
            bad.append(F.when(shrunk >= F.lit(1 - passing * (1 - failed / documents)), F.lit(name)))
    return hosts.select("host", F.array_compact(F.array(*(bad or [F.lit(None).cast("string")]))).alias("refused_for")).where(F.size("refused_for") > 0)


def beta_prior(hosts: int, n: int, failed: int, squares: float) -> tuple[float, float]:
    """Alpha and beta by moments from sums over hosts: of documents, failures, failures squared by documents.

    The spread of the rates less what sampling alone would give is the spread
    between hosts; with none left the prior is strong, up to a million documents.
    """
    if not n or not 0 < failed < n:
        rate = failed / n if n else 0.0
        return rate, 1.0 - rate
    mean = failed / n
    noise = mean * (1 - mean)
    between = squares / n - mean * mean - noise * hosts / n
    strength = min(max(noise / between - 1, 1.0), 1e6) if between > 0 else 1e6
    return mean * strength, (1 - mean) * strength


def judge(docs: DataFrame, host: str = "source", passing: float = PASSING) -> DataFrame:
    """doc_id, host, COUNTS, base_failed and kept for each document."""
    counts = written(document_counts(docs, host))
    refused = refused_hosts(counts, passing).select(F.col("host").alias("refused_host"), F.lit(True).alias("refused"))
    base = rules()["short"] | rules()["repeats"]
    joined = counts.join(refused, F.col("host").eqNullSafe(F.col("refused_host")), "left")
    return joined.select(
        "doc_id", "host", *COUNTS, base.alias("base_failed"), (~base & F.col("refused").isNull()).alias("kept")
    )


#: DuckDB SQL for the query's rows.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, source, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM d
), c AS (
  SELECT k, doc_id, source, CAST(len(words) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(len(lines) AS BIGINT) AS n_lines
  FROM w
), u AS (
  SELECT k, unnest(words) AS word, unnest(range(len(words))) AS i FROM w
), g AS (
  SELECT k, i, word || ' ' || lead(word, 1) OVER q || ' ' || lead(word, 2) OVER q || ' ' || lead(word, 3) OVER q
               || ' ' || lead(word, 4) OVER q AS five
  FROM u WINDOW q AS (PARTITION BY k ORDER BY i)
), r AS (
  SELECT k, i FROM g WHERE five IS NOT NULL QUALIFY count(*) OVER (PARTITION BY k, five) > 1
), n AS (
  SELECT k, CAST(count(DISTINCT i + o) AS BIGINT) AS n_repeat_words FROM r, range(5) AS t(o) GROUP BY k
), m AS (
  SELECT c.*, coalesce(n.n_repeat_words, 0) AS n_repeat_words FROM c LEFT JOIN n USING (k)
), f AS (
  SELECT *, n_words < 10 AS short, 100 * n_repeat_words > 20 * n_words AS repeats,
         10 * n_symbols > 3 * word_chars AS symbols, 2 * n_dup_lines > n_lines AS lines
  FROM m
), h AS (
  SELECT source, count(*) AS n, unnest(['short', 'repeats', 'symbols', 'lines']) AS rule,
         unnest([count(*) FILTER (short), count(*) FILTER (repeats), count(*) FILTER (symbols), count(*) FILTER (lines)]) AS bad
  FROM f GROUP BY source
), p AS (
  SELECT rule, count(*) AS hosts, sum(n) AS docs, sum(bad) AS bad, sum(bad * bad / n) AS squares,
         sum(bad) / sum(n) AS mean FROM h GROUP BY rule
), s AS (
  SELECT rule, mean, mean * (1 - mean) AS noise, squares / docs - mean * mean - mean * (1 - mean) * hosts / docs AS between_hosts FROM p
), b AS (
  SELECT rule, mean, CASE WHEN noise = 0 THEN 1.0 WHEN between_hosts > 0
           THEN least(greatest(noise / between_hosts - 1, 1.0), 1e6) ELSE 1e6 END AS strength FROM s
), refused AS (
  SELECT DISTINCT source FROM h JOIN b USING (rule) WHERE (bad + mean * strength) / (n + strength) >= 1 - 0.5 * (1 - mean) AND mean < 1
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, short OR repeats AS base_failed,
       NOT (short OR repeats) AND NOT EXISTS (SELECT 1 FROM refused WHERE refused.source IS NOT DISTINCT FROM f.source) AS kept
FROM f
"""
