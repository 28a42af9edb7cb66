"""From raw documents to packed training windows: five stages, each on all that the one before kept.

1. quality: documents that the tree classifier scores below its threshold go.
2. near_duplicates: one row of each group of similar texts stays (five-word shingles, Jaccard 0.8 or more): the
   vantage-point trees' links are checked exactly, and what they can't reach within their radius is found by shingles.
3. pii: personal data in the texts is replaced by its kind.
4. mixing: sources are taken to their target words, copies in curriculum order.
5. packing: texts become pieces of windows of 2048 tokens.

Every stage takes any documents, none included; rows without an id or a text are
treated as its operator's docstring says.  Stages 1 to 4 return the columns of
what they were given, whatever else is called as they call things.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruzi.llm import mixing, packing, pii, quality_model, resemblance
from ruzi.llm.common import discard, table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored at the threshold or above, by a model of these documents' labels."""
    forest = quality_model.train(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality_model.scored(F.col("text"), forest) >= quality_model.THRESHOLD)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first row of each group of texts that share four fifths or more of their five-word shingles."""
    return resemblance.deduplicated(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without personal data, and n_chars to match where the table has it."""
    clean = docs.withColumn("text", pii.redacted(F.col("text")))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per copy that the mix takes."""
    return mixing.mixture(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("pii", personal_data),
    ("mixing", mix),
    ("packing", pack),
]

#: Trees, shingle hashes and tokens are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each one's rows are written as Parquet and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, written(stage(spark, docs, sf_dir))
        if i:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
