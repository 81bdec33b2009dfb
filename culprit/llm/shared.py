"""Helpers that several corpus operators share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# A word is a maximal run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

# Tables of up to this many rows of a few plain columns (some 40 MB) may be broadcast.
BROADCAST_ROWS = 500_000


Task = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]

# Rows that a task of Python code works on at once; batches that arrive may be larger.
AT_ONCE = 256


def slices(batches: Iterator[pa.RecordBatch], rows: int = AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The batches in pieces, so that what is made of them stays small beside them."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


def tidied(task: Task) -> Task:
    """The task, which at its end gives freed memory back to the machine.

    Python workers are used again for hours, and an idle one would keep its largest
    batch's memory beside that of the next stage.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from task(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return run


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: what spark.checkpoint.dir names.

    Only a local session without that setting gets a temporary folder, for tests.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="culprit-llm-"))
    return context.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """Rows written once to the shared folder.

    Spark deletes them with the frame where spark.cleaner.referenceTracking.cleanCheckpoints
    is set; else they stay below spark.checkpoint.dir, as what `stored` writes does, until
    whoever owns that folder empties it.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Rows written once as Parquet in the shared folder, for frames read by column."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A settled frame, marked for broadcast if its counted rows are few.

    For frames of a few plain columns.  Larger ones stay as they are and meet the other
    side by shuffle, which gives the same rows.
    """
    return F.broadcast(df) if df.count() <= rows else df


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_interval(*parts: Column) -> Column:
    """A number in (0, 1) that depends on the given columns only; any engine can make it."""
    told = F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    top = F.conv(F.substring(F.md5(told), 1, 13), 16, 10)
    return (top.cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def running_sum(
    df: DataFrame, within: list[str], order: list[Column], bin_of: Column, value: Column, name: str
) -> DataFrame:
    """`name`: the sum of `value` over the rows before each row of its group, by `order`.

    `bin_of` is an integer that does not fall along `order`.  Values are summed by bin and
    the bins' sums run on; only rows of one bin are sorted together.  A group that holds
    most rows is so spread over as many tasks as it has bins.
    """
    binned = df.withColumns({"_bin": bin_of, "_value": value})
    sums = binned.groupBy(*within, "_bin").agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(*within).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    sums = settled(sums.select(*within, "_bin", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base")))
    inside = Window.partitionBy(*within, "_bin").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        binned.withColumn("_inside", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
        .join(small(sums), [*within, "_bin"])
        .withColumn(name, F.col("_base") + F.col("_inside"))
        .drop("_bin", "_value", "_base", "_inside")
    )


def bins_for(n: int) -> int:
    """Bins for a running sum over n rows: as many bins as rows in each."""
    return max(1, round(n**0.5))
