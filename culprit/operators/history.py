"""Against what was before: trends, schema snapshots, expired versions, unit shifts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TREND_DAYS = 30

# Factors that a change of unit or a lost decimal point leaves behind.
UNIT_FACTORS = (10.0, 100.0, 1000.0, 0.1, 0.01, 0.001)


def null_rate_trend(
    df: DataFrame, column: str, moment: str, *, by: Sequence[str] = (), days: int = TREND_DAYS
) -> DataFrame:
    """Null rate of each day with the median of the days before it and its z-score.

    One row per day and group is left before the window, which holds at most `days` rates
    a row.  The z-score is 0 where the days before do not vary.
    """
    daily = df.groupBy(*by, F.to_date(moment).alias("day")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        (F.count_if(F.col(column).isNull()) / F.count(F.lit(1))).alias("null_rate"),
    )
    order = F.datediff("day", F.lit("1970-01-01"))
    before = Window.partitionBy(*by).orderBy(order).rangeBetween(-days, -1)
    rates = F.array_sort("_rates")
    n = F.size("_rates")
    middle = (F.get(rates, ((n - 1) / 2).cast("int")) + F.get(rates, (n / 2).cast("int"))) / 2
    z = F.when(F.col("_spread") > 0, (F.col("null_rate") - F.col("_mean")) / F.col("_spread"))
    trend = daily.filter(F.col("day").isNotNull()).withColumns(
        {
            "_rates": F.collect_list("null_rate").over(before),
            "_mean": F.avg("null_rate").over(before),
            "_spread": F.stddev_samp("null_rate").over(before),
        }
    )
    return trend.select(
        *by,
        "day",
        "n_rows",
        "null_rate",
        F.when(n > 0, middle).alias("null_rate_p50"),
        F.coalesce(z, F.lit(0.0)).alias("null_rate_z"),
    )


def schema_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Columns added, dropped or retyped between two (table_name, column_name, dtype) frames."""
    on = ["table_name", "column_name"]
    old = before.select(*on, F.col("dtype").alias("old_dtype"))
    new = after.select(*on, F.col("dtype").alias("new_dtype"))
    change = (
        F.when(F.col("old_dtype").isNull(), "added")
        .when(F.col("new_dtype").isNull(), "dropped")
        .otherwise("retyped")
    )
    met = old.join(new, on, "full").filter(~F.col("old_dtype").eqNullSafe(F.col("new_dtype")))
    return met.withColumn("change", change)


def expired_references(
    facts: DataFrame,
    key: str,
    moment: str,
    versions: DataFrame,
    dim_key: str,
    valid_to: str,
    *,
    by: Sequence[str] = (),
) -> DataFrame:
    """Rows, and rows that refer to a member whose last version ended before them.

    Versions shrink to one row per member first, so the join is on the key alone and AQE
    may split a hot one; an open end (null) never expires.  Members unknown to the
    dimension are orphans, not expired.
    """
    last = versions.groupBy(F.col(dim_key).alias("_member")).agg(
        F.max(valid_to).alias("_ends"), F.max(F.col(valid_to).isNull()).alias("_open")
    )
    met = facts.join(last, facts[key] == last["_member"], "left")
    expired = ~F.col("_open") & (F.col("_ends") < F.col(moment))
    return met.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(expired).alias("n_expired")
    )


def interval_references(
    facts: DataFrame,
    key: str,
    moment: str,
    versions: DataFrame,
    dim_key: str,
    valid_from: str,
    valid_to: str,
    *,
    by: Sequence[str] = (),
    unit: str = "month",
) -> DataFrame:
    """n_rows, n_early, n_expired, n_unknown: how rows stand to the versions of their member.

    A row is covered if a version began at its moment or before and ends at it or later; an
    open end (null) never comes, and versions may overlap.  Without one, it is early if no
    version has begun, and expired if all that have begun are over, be it before the first
    gap or after the last end.  Members without versions are unknown; rows without key or
    moment count as rows only.  A version that begins at null has always been there.

    Rows and versions of a member are put in order of time and the latest end so far is
    carried along.  A member's time is cut into pieces of one `unit` (a piece gets the latest
    end of all before it from sums per piece), so that a member with most rows is sorted in
    as many tasks as it has pieces.
    """
    start = F.date_trunc(unit, F.col("_at"))
    never = F.lit("9999-12-31 00:00:00").cast("timestamp_ntz")
    always = F.lit("0001-01-01 00:00:00").cast("timestamp_ntz")
    ends = versions.filter(F.col(dim_key).isNotNull()).select(
        F.col(dim_key).alias("_member"),
        F.coalesce(F.col(valid_from).cast("timestamp_ntz"), always).alias("_at"),
        F.coalesce(F.col(valid_to).cast("timestamp_ntz"), never).alias("_end"),
    )
    asked = facts.select(
        *by, F.col(key).alias("_member"), F.col(moment).cast("timestamp_ntz").alias("_at")
    )
    told = asked.filter(F.col("_member").isNotNull() & F.col("_at").isNotNull())
    # Versions sort before the rows of their moment.
    blank = [F.lit(None).cast(asked.schema[c].dataType).alias(c) for c in by]
    both = told.withColumns({"_end": F.lit(None).cast("timestamp_ntz"), "_row": F.lit(1)}).unionByName(
        ends.select("*", *blank, F.lit(0).alias("_row"))
    ).withColumn("_piece", start)
    pieces = both.groupBy("_member", "_piece").agg(F.max("_end").alias("_piece_end"))
    earlier = Window.partitionBy("_member").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("_member")
    pieces = pieces.select(
        "_member",
        "_piece",
        F.max("_piece_end").over(earlier).alias("_before"),
        F.max("_piece_end").over(whole).isNotNull().alias("_known"),
    )
    so_far = Window.partitionBy("_member", "_piece").orderBy("_at", "_row").rowsBetween(Window.unboundedPreceding, 0)
    placed = both.withColumn("_inside", F.max("_end").over(so_far)).filter("_row = 1").join(
        pieces, ["_member", "_piece"]
    )
    end = F.greatest("_before", "_inside")
    counted = placed.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_told"),
        F.count_if(F.col("_known") & end.isNull()).alias("n_early"),
        F.count_if(end < F.col("_at")).alias("n_expired"),
        F.count_if(~F.col("_known")).alias("n_unknown"),
    )
    # Rows without key or moment have no place in time.
    rest = asked.filter(F.col("_member").isNull() | F.col("_at").isNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_told"), *[F.lit(0).cast("bigint").alias(n) for n in ("n_early", "n_expired", "n_unknown")]
    )
    sums = {n: F.coalesce(F.sum(n), F.lit(0)) for n in ("n_early", "n_expired", "n_unknown")}
    return counted.unionByName(rest).groupBy(*by).agg(
        F.coalesce(F.sum("n_told"), F.lit(0)).alias("n_rows"), *[s.alias(n) for n, s in sums.items()]
    )


def unit_factor(now: Column, before: Column, tolerance: float = 0.05) -> Column:
    """The clean factor between two means, or null: 10, 100, 1000 or one over these."""
    found: Column = F.lit(None).cast("double")
    for factor in UNIT_FACTORS:
        near = F.abs(now / before / factor - 1) <= tolerance
        found = F.when((before != 0) & near, factor).otherwise(found)
    return found


def hash_split(df: DataFrame, key: Column, shares: Mapping[str, int]) -> DataFrame:
    """`part`: named parts in percent, by the hash of the key, the same on every run."""
    if sum(shares.values()) != 100:
        raise ValueError("shares must add up to 100")
    spot = F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("bigint") % 100
    part: Column = F.lit(None).cast("string")
    upto = 100
    for name, share in reversed(list(shares.items())):
        part = F.when(spot < upto, name).otherwise(part)
        upto -= share
    return df.withColumn("part", part)


def poisson_times(key: Column, draw: Column) -> Column:
    """How often a draw takes all rows of a key: Poisson of mean 1, decided by both hashed."""
    u = F.conv(
        F.substring(F.md5(F.concat(key.cast("string"), F.lit("#"), draw)), 1, 8), 16, 10
    ).cast("double") / F.lit(2.0**32)
    times, chance, term = F.lit(0), 0.0, 0.36787944117144233
    for k in range(1, 9):
        chance += term
        term /= k
        times = times + (u >= chance).cast("int")
    return times


def bootstrap_interval(
    df: DataFrame, key: str, hit: Column, draws: int = 200, level: float = 0.95
) -> DataFrame:
    """Mean of `hit` and its bootstrap interval (low, high).

    In each draw a row counts as often as a Poisson variable of mean 1 says, which its key
    and the number of the draw decide: draws need no second pass and reruns agree.  Sums
    by draw are combined before the shuffle.
    """
    rows = df.select(
        key, hit.cast("double").alias("hit"), F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw")
    ).withColumn("times", poisson_times(F.col(key), F.col("draw")))
    means = rows.groupBy("draw").agg((F.sum(F.col("hit") * F.col("times")) / F.sum("times")).alias("mean"))
    tail = (1 - level) / 2
    ends = means.agg(
        F.percentile("mean", F.lit(tail)).alias("low"), F.percentile("mean", F.lit(1 - tail)).alias("high")
    )
    # One row of totals beside one row of ends.
    return ends.withColumn("mean", df.agg(F.avg(hit.cast("double"))).scalar())
