"""Exact duplicates by a tree of merges over sorted digest runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from culprit.llm.shared import settled

# Texts are equal when identical without these characters.
IGNORED = r"[\x20\x09-\x0D]+"

# Runs that one merge takes in.
FAN_IN = 16


def normal_text(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), IGNORED, "")


def merge_runs(runs: DataFrame, level: int, fan_in: int = FAN_IN) -> DataFrame:
    """Merge each `fan_in` neighbouring runs into one.

    A run has one row per verified digest.  Rows of equal digest meet only if the second
    checksum and the length agree too; the smallest keeper stays and sizes add up.  The
    aggregate over a struct sorts both sides, so that this is a merge of sorted runs,
    and the digest is part of the shuffle key, so that no task gets a whole run.
    """
    keys = ["digest", "check", "length"]
    up = F.floor(F.col("run") / fan_in).cast("int").alias("run")
    return (
        runs.select(up, *keys, "keeper", "size")
        .groupBy("run", *keys)
        .agg(F.min("keeper").alias("keeper"), F.sum("size").alias("size"))
        .withColumn("level", F.lit(level))
    )


def exact_dedup(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, keep_id, group_size, kept, text_sha256.

    Every partition of the input makes a run of digests.  Runs meet in rounds, each of
    which merges `FAN_IN` runs into one, until one run is left; each level keeps the
    smallest identifier of every verified digest.  A digest held by a third of all rows
    enters each merge once per run.

    The row with the most code points in its original text stays, then the smallest key
    (nulls last).  A null text is an empty one, and empty texts are equal.  Of rows that
    repeat key and text exactly one is kept.  An empty table gives an empty result; other
    columns are ignored, whatever their names.
    """
    source = F.coalesce(F.col(text), F.lit(""))
    normal = normal_text(F.col(text))
    entries = settled(
        df.select(
            F.col(key).alias("id"),
            F.length(source).alias("points"),
            normal.alias("normal"),
        ).select(
            "id",
            "points",
            F.unhex(F.sha2("normal", 256)).alias("digest"),
            F.xxhash64("normal").alias("check"),
            F.octet_length("normal").alias("length"),
            F.spark_partition_id().alias("run"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    runs = entries.select(
        "run",
        "digest",
        "check",
        "length",
        F.struct((-F.col("points")).alias("points"), F.col("id").isNull().alias("none"), "id", "row").alias(
            "keeper"
        ),
        F.lit(1).cast("long").alias("size"),
    )
    last = entries.agg(F.max("run")).first()[0] or 0
    merged = merge_runs(runs, 0, 1)
    level = 0
    while last > 0:
        level += 1
        last //= FAN_IN
        merged = merge_runs(merged, level)
    groups = settled(merged.where("size > 1").select("digest", "check", "length", "keeper", "size"))
    return entries.join(groups, ["digest", "check", "length"], "left").select(
        F.col("id").alias(key),
        F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("keeper.id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("size").isNull() | (F.col("row") == F.col("keeper.row"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
