"""Probes: facts about one table, all taken in as few scans as possible.

Every probe accepts `by`, the columns that tell apart several loads, feeds or
trials held in one table.  With `by` the same plan answers for a whole fleet.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from culprit.functions.dtypes import is_numeric, is_text
from culprit.functions.keys import joined_text, ntz

# --- fixed values: what counts as a number written as text -----------------------
INTEGER_TEXT = r"^[+-]?[0-9]+$"
FLOAT_TEXT = r"^[+-]?[0-9]*\.?[0-9]+([eE][+-]?[0-9]+)?$"
# ---------------------------------------------------------------------------------


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0.0 where there is nothing to divide."""
    return F.when(whole > 0, part / whole).otherwise(0.0)


def require_columns(df: DataFrame, columns: Sequence[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"no such column: {', '.join(missing)}")


def row_count(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("row_count"))


def column_dtypes(df: DataFrame, table: str) -> list[tuple[str, str, str]]:
    """(table, column, type) from the schema; no data is read."""
    return [(table, f.name, f.dataType.simpleString()) for f in df.schema]


def adjusted_skew(value: Column) -> Column:
    """Sample-adjusted skewness: Spark's is the population form."""
    n = F.count(value)
    factor = F.sqrt(n * (n - 1)) / (n - 2)
    return F.coalesce(F.nanvl(F.when(n > 2, F.skewness(value) * factor), F.lit(0.0)), F.lit(0.0))


FACTS = ("null_count", "distinct_count", "int_ratio", "float_ratio", "mean", "stddev", "skew")


def column_facts(
    df: DataFrame, column: str, wanted: Sequence[str] = FACTS
) -> dict[str, Column]:
    """Aggregates for one column; the caller puts those of many columns into one agg.

    What is not `wanted` is not computed: a distinct count costs an Expand copy.
    """
    dtype = df.schema[column].dataType
    col = F.col(column)
    filled = F.count(col)
    zero = F.lit(0.0)
    facts = {
        "null_count": F.count_if(col.isNull()),
        "distinct_count": F.count_distinct(col),
        "int_ratio": zero,
        "float_ratio": zero,
        "mean": zero,
        "stddev": zero,
        "skew": zero,
    }
    if is_text(dtype):
        facts["int_ratio"] = share(F.count_if(col.rlike(INTEGER_TEXT)), filled)
        facts["float_ratio"] = share(F.count_if(col.rlike(FLOAT_TEXT)), filled)
    if is_numeric(dtype):
        value = col.cast("double")
        facts["mean"] = F.coalesce(F.avg(value), zero)
        facts["stddev"] = F.coalesce(F.stddev_samp(value), zero)
        facts["skew"] = adjusted_skew(value)
    return {name: fact for name, fact in facts.items() if name in wanted}


def profile_columns(
    df: DataFrame,
    columns: Sequence[str],
    table: str,
    *,
    by: Sequence[str] = (),
    wanted: Sequence[str] = FACTS,
) -> DataFrame:
    """One scan for all columns, then one row per (group, column).

    Only `by` and the asked columns reach the scan.  Exact distinct counts cost one
    Expand copy per column, pre-aggregated map-side; without them in `wanted` their
    column and the ratio made of them are left out.
    """
    require_columns(df, [*by, *columns])
    aggs = [F.count(F.lit(1)).alias("rows")]
    slots = []
    for i, name in enumerate(columns):
        facts = column_facts(df, name, {*wanted, "null_count"})
        aggs += [agg.alias(f"f{i}_{fact}") for fact, agg in facts.items()]
        slots.append(
            F.struct(
                F.lit(table).alias("table_name"),
                F.lit(name).alias("column_name"),
                F.lit(df.schema[name].dataType.simpleString()).alias("dtype"),
                *[F.col(f"f{i}_{fact}").alias(fact) for fact in facts],
            )
        )
    wide = df.groupBy(*by).agg(*aggs)
    long = wide.select(*by, "rows", F.inline(F.array(*slots)))
    filled = F.col("rows") - F.col("null_count")
    counts = ["null_count", *(["distinct_count"] if "distinct_count" in wanted else [])]
    ratios = [share(F.col("null_count"), F.col("rows")).alias("null_rate")]
    if "distinct_count" in wanted:
        ratios.append(share(F.col("distinct_count"), filled).alias("cardinality_ratio"))
    return long.select(
        *by,
        "table_name",
        "column_name",
        "dtype",
        F.col("rows").alias("row_count"),
        *counts,
        *ratios,
        *[name for name in FACTS if name in wanted and name not in counts],
    )


def dupe_keys(
    df: DataFrame, keys: Sequence[str], *, by: Sequence[str] = (), limit: int | None = None
) -> DataFrame:
    """Key values seen more than once, null keys included as a group.

    The count is combined map-side, so a key that owns a third of the table reaches
    the shuffle as one row per task.  `limit` keeps the most frequent ones (a top-k
    report, planned as TakeOrderedAndProject); ties fall to the smaller key.
    """
    if not keys:
        raise ValueError("at least one key column is needed")
    require_columns(df, keys)
    repeated = (
        df.groupBy(*by, *keys).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") > 1)
    )
    if limit is not None:
        repeated = repeated.orderBy(F.desc("n_rows"), *keys).limit(limit)
    return repeated.select(*by, joined_text(list(keys)).alias("key_text"), "n_rows")


def dupe_extra_rows(
    df: DataFrame,
    keys: Sequence[str],
    *,
    by: Sequence[str] = (),
) -> DataFrame:
    """Rows beyond the first of each key, over all keys."""
    if not keys:
        raise ValueError("at least one key column is needed")
    require_columns(df, keys)
    named = [F.col(k).alias(f"key_{k}") for k in keys]
    counted = df.groupBy(*by, *named).agg(F.count(F.lit(1)).alias("n_rows"))
    repeated = counted.filter(F.col("n_rows") > 1)
    return repeated.groupBy(*by).agg(
        F.coalesce(F.sum(F.col("n_rows") - 1), F.lit(0)).alias("extra_rows"),
        F.count(F.lit(1)).alias("dupe_keys"),
    )


def lag_seconds(latest: Column, observed_at: datetime | str) -> Column:
    return F.timestamp_diff("MICROSECOND", latest, ntz(observed_at)) / 1e6


def freshness(
    df: DataFrame, ts_col: str, observed_at: datetime | str, *, by: Sequence[str] = ()
) -> DataFrame:
    """Latest timestamp and its lag; dates count as midnight, an empty table gives nulls."""
    require_columns(df, [ts_col])
    latest = df.groupBy(*by).agg(F.max(ts_col).cast("timestamp_ntz").alias("max_ts"))
    return latest.withColumn("lag_seconds", lag_seconds(F.col("max_ts"), observed_at))


def key_rows(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, key, n): how many rows hold each value of a column, a null one included."""
    return df.groupBy(*by, F.col(column).alias("key")).agg(F.count(F.lit(1)).alias("n"))


def orphan_keys(
    child: DataFrame,
    fk: str,
    parent: DataFrame,
    pk: str,
    *,
    by: Sequence[str] = (),
    groups: Sequence[str] | None = None,
) -> DataFrame:
    """Foreign keys without a parent, with the number of child rows that carry them.

    Both sides shrink to distinct keys (map-side) before they meet, so a hot key is
    one row in the join however many child rows hold it.  `by` may sit on either
    side; a parent split by a single `by` column meets an unsplit child once per
    value in `groups`.
    """
    child_by = [c for c in by if c in child.columns]
    parent_by = [c for c in by if c in parent.columns]
    wanted = key_rows(child.filter(F.col(fk).isNotNull()), fk, child_by).select(
        *child_by, F.col("key").alias("fk"), F.col("n").alias("child_rows")
    )
    if parent_by and not child_by:
        if groups is None:
            raise ValueError("groups are needed when only the parent is split")
        wanted = wanted.withColumn(
            parent_by[0], F.explode(F.array(*[F.lit(g) for g in groups]))
        )
    present = parent.filter(F.col(pk).isNotNull()).select(*parent_by, F.col(pk).alias("fk"))
    return wanted.join(present.distinct(), [*parent_by, "fk"], "left_anti")


def null_keys_in_parent(parent: DataFrame, pk: str) -> Column:
    """True if the parent holds a null key (as a scalar subquery)."""
    return parent.agg(F.coalesce(F.max(F.col(pk).isNull()), F.lit(False))).scalar()


def orphan_count(
    child: DataFrame,
    fk: str,
    parent: DataFrame,
    pk: str,
    *,
    ignore_null_parents: bool = False,
) -> DataFrame:
    """Child rows whose key is NOT IN the parent's.

    NOT IN is never true once the parent holds a null, so by default the count is 0
    then.  Spark runs a NOT IN subquery as a broadcast of the whole parent; here the
    null test is a scalar and the rest an ordinary anti join, which scales.
    """
    orphans = orphan_keys(child, fk, parent, pk)
    if not ignore_null_parents:
        orphans = orphans.filter(~null_keys_in_parent(parent, pk))
    return orphans.agg(F.coalesce(F.sum("child_rows"), F.lit(0)).alias("orphan_fk_count"))
