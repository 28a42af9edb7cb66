"""Helpers that several operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What all operators call a word: a run of bytes other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


#: How the names of intermediate tables begin.
SCRATCH = "ruzi-scratch-"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One input table; read by Spark alone, so any file system will do."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="ruzi-shared-")
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """Write a DataFrame once into the shared folder and read it back.

    Cuts the lineage: what made the rows isn't run again, and a lost executor
    costs a read of the files and no more.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{SCRATCH}{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._scratch_path = path
    return back


def discard(*frames: DataFrame) -> None:
    """Delete the files of DataFrames that ``written`` gave, once all that is read from them has been written itself.

    Spark's cleaner then drops the shuffle files behind them, too, as soon as the driver's garbage is collected.
    """
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
    frames[0].sparkSession._jvm.System.gc()


def bounded_sample(df: DataFrame, order: Column, count: int, share: float) -> DataFrame:
    """The ``count`` least rows by ``order``, numbers spread evenly from 0 to 1 (or clocks), of which about ``share`` holds them.

    Rows beyond a margin over that share are dropped where they are read, so that what reaches
    the driver is bounded by ``count`` and not by ``count`` for each partition.
    """
    margin = share * (1 + 6 / max(count, 1) ** 0.5)
    return df.where(order <= margin).orderBy(order, *df.columns).limit(count)


def even(*columns: Column | str) -> Column:
    """A digest of columns as a number spread evenly from 0 to 1."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 52)) / float(1 << 52)


def keyed(df: DataFrame) -> DataFrame:
    """row, a struct of all columns, and key, a number of the row's own; written once, so that keys stay."""
    return written(df.select(F.struct(*[df[f"`{name}`"] for name in df.columns]).alias("row"), F.monotonically_increasing_id().alias("key")))


def first_rows(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The columns of the rows of ``keyed`` that ``keys`` (column key, each once) names.

    The same plan at every size: the rows are shuffled once by key, and no list of keys is broadcast.
    """
    return rows.join(written(keys).hint("merge"), "key", "left_semi").select("row.*")


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str) -> DataFrame:
    """mapInArrow with one call of ``make`` for each task and one of its result for each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            if batch.num_rows and (out := work(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)
