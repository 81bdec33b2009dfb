"""Repairs that match the suggested fixes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def repair_nulls(df: DataFrame, column: str, fill: object | None = None) -> DataFrame:
    """Drop rows with a null in the blamed column, or fill them."""
    if fill is None:
        return df.filter(F.col(column).isNotNull())
    return df.withColumn(column, F.coalesce(F.col(column), F.lit(fill)))


def repair_duplicates(
    df: DataFrame, keys: Sequence[str], order: Sequence[tuple[str | Column, bool]]
) -> DataFrame:
    """One row per key: the first by `order`, then by all columns, so reruns agree.

    `order` holds (column, ascending) pairs of any orderable type; nulls come last either
    way.  Spark pushes the filter on the rank below the shuffle as a limit per task and
    key, so a key with a third of all rows sends one row per task.
    """
    parts = [(F.col(c) if isinstance(c, str) else c, up) for c, up in order]
    ranked = [c.asc_nulls_last() if up else c.desc_nulls_last() for c, up in parts]
    window = Window.partitionBy(*keys).orderBy(*ranked, *df.columns)
    first = df.withColumn("_rank", F.row_number().over(window)).filter("_rank = 1")
    return first.select(*df.columns)


def repair_orphans(
    child: DataFrame, fk: str, parent: DataFrame, pk: str, fallback: object | None = None
) -> DataFrame:
    """Drop rows whose key has no parent, or point them at a fallback member.

    Rows with a null key are not orphans and stay; they take no part in the joins, where all
    of them would meet in one task.  Parent keys go in as they are: both joins stop at the
    first match and read the same shuffle.
    """
    known = parent.select(F.col(pk).alias(fk)).filter(F.col(fk).isNotNull())
    keyed = child.filter(F.col(fk).isNotNull())
    kept = keyed.join(known, fk, "left_semi").select(*child.columns)
    kept = kept.unionByName(child.filter(F.col(fk).isNull()))
    if fallback is None:
        return kept
    lost = keyed.join(known, fk, "left_anti").withColumn(fk, F.lit(fallback))
    return kept.unionByName(lost.select(*child.columns))
