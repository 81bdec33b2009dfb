"""Shards that each hold the sources in the proportions of the whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from culprit.llm.shared import bins_for, running_sum, settled, small


def interleave(
    df: DataFrame,
    shards: int,
    key: str = "doc_id",
    source: str = "source",
    tie: str | None = None,
    seed: int = 7,
) -> DataFrame:
    """The rows of `df` with `shard` and `slot`.

    Rows are shuffled by a seeded hash of key (and `tie`, a column that tells rows of one
    key apart) and ranked within their source.  The fractional rank, (rank + 1/2) / rows
    of the source, orders all rows; the sequence is cut into `shards` stretches whose
    lengths differ by one at most, so that every shard has each source's share to within
    a row or two.  `slot` is the place within the shard, from 0 without gaps.

    Equal rows are interchangeable.  Null keys and null sources are values of their own.
    With fewer rows than shards some shards stay empty; an empty table gives an empty
    result.  Columns named shard or slot are replaced; names that begin with an
    underscore are the operator's own.
    """
    n = df.count()
    bins = bins_for(n)
    tied = [F.col(tie)] if tie else []
    hashed = F.xxhash64(F.lit(seed), F.col(key), F.col(source), *tied)
    kept = [c for c in df.columns if c not in ("shard", "slot")]
    dealt = df.select(
        *kept,
        F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("")).alias("_group"),
        hashed.alias("_hash"),
    )
    totals = dealt.groupBy("_group").agg(F.count("*").alias("_rows"))
    # A signed 64-bit hash falls evenly into the bins between its two ends.
    even = F.floor((F.col("_hash").cast("double") / F.lit(2.0**64) + F.lit(0.5)) * bins)
    order = [F.col("_hash"), F.col(key), *tied]
    one = F.lit(1).cast("long")
    placed = running_sum(dealt, ["_group"], order, even.cast("long"), one, "_rank")
    placed = placed.join(small(settled(totals)), "_group").withColumn(
        "_part", (F.col("_rank") + F.lit(0.5)) / F.col("_rows")
    )
    placed = running_sum(
        placed,
        [],
        [F.col("_part"), F.col("_group"), F.col("_rank")],
        F.floor(F.col("_part") * bins).cast("long"),
        one,
        "_place",
    )
    # Shard s holds the places p with floor(p * shards / n) = s; it begins at the least.
    shard = F.expr(f"cast(_place * {shards} div {max(n, 1)} as int)")
    first = F.expr(f"(cast(shard as bigint) * {n} + {shards} - 1) div {shards}")
    return (
        placed.withColumn("shard", shard)
        .withColumn("slot", (F.col("_place") - first).cast("long"))
        .select(*kept, "shard", "slot")
    )


def write_shards(dealt: DataFrame, path: str) -> None:
    """One folder per shard; within it files sorted by slot."""
    dealt.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy(
        "shard"
    ).parquet(path)


def checked(df: DataFrame, text: str = "text") -> tuple[Column, Column]:
    """Size (UTF-8 bytes and 8 for the length) and unsigned CRC-32 of a text."""
    body = F.coalesce(F.col(text), F.lit(""))
    return (
        (F.octet_length(body) + 8).cast("long"),
        F.crc32(F.encode(body, "UTF-8")).cast("long"),
    )
