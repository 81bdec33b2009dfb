"""Mixtures of sources at target weights, by weighted sampling without replacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from culprit.llm.shared import bins_for, running_sum, settled, small, unit_interval, word_count

# Weights that the sources take in turn, by name.
TURN = (5.0, 2.0, 1.0)

# Quality weights are held between these, so that every document can be drawn.
LEAST_WEIGHT, MOST_WEIGHT = 0.05, 1.0


def prose_weight(text: Column) -> Column:
    """A quality weight: one less the markup symbols per word."""
    symbols = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[#*$%&|<>]"))
    return F.lit(1.0) - symbols / F.greatest(word_count(text), F.lit(1))


def source_targets(
    sources: DataFrame, turn: tuple[float, ...] = TURN, share: float = 1.5, most: float = 2.0
) -> DataFrame:
    """(source, source_size, target) for each row of (source, source_size).

    Sources in code-point order, null last, take the weights of `turn` again and again
    and share `share` times all sizes.  No target passes `most` times its source's size;
    what is above goes to the others by weight until none is above.

    That is a level: each target is the lesser of its cap and level times weight.  If the
    sources that stop were the first k by cap per weight, the level would be what the caps
    before k leave, over the weights from k on.  No choice of k gives more than the true
    level and the right one gives it, so it is the greatest of these running quotients.
    One row per source goes through one task here, never a document.
    """
    if most < share:
        raise ValueError("the sources cannot hold that much")
    name = [F.col("source").isNull(), F.col("source")]
    place = F.pmod(F.row_number().over(Window.orderBy(*name)) - 1, F.lit(len(turn)))
    rows = sources.select(
        "source",
        "source_size",
        F.get(F.array(*(F.lit(float(w)) for w in turn)), place.cast("int")).alias("weight"),
        (F.lit(float(most)) * F.col("source_size")).alias("cap"),
    )
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), *name)
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    since = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.orderBy(F.lit(0)).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    left = F.lit(float(share)) * F.sum("source_size").over(whole) - F.coalesce(
        F.sum("cap").over(before), F.lit(0.0)
    )
    level = F.max(F.col("left") / F.col("weights")).over(whole)
    return (
        rows.withColumns({"left": left, "weights": F.sum("weight").over(since)})
        .withColumn("level", level)
        .select(
            "source",
            "source_size",
            F.least("cap", F.col("level") * F.col("weight")).alias("target"),
        )
    )


def mix(
    df: DataFrame,
    weight: Column,
    size: Column,
    key: str = "doc_id",
    source: str = "source",
    turn: tuple[float, ...] = TURN,
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 11,
) -> DataFrame:
    """The rows of `df` with size, source_size, target, copies and taken.

    Every source is taken as often as it fits whole into its target.  What remains is
    drawn without replacement: each row gets an exponential key, scaled by its quality
    weight, and rows are taken in key order while their running size stays within the
    rest; the row at the border is taken if that comes nearer.  So a source misses its
    target by half of one document at most.  Keys depend on key, size and seed alone:
    reruns agree.

    `copies` says how often the row is in the mix, `taken` is copies times size.  Weights
    are held within [0.05, 1]; a null weight counts as the least.  Null sizes are 0; rows
    of size 0 are copied with their source but take nothing.  Null and repeated keys are
    rows like others, a null source is a source of its own, an empty table gives an empty
    result.  Columns named like the new ones are replaced; names that begin with an
    underscore are the operator's own.
    """
    added = ("size", "source_size", "target", "copies", "taken")
    held = F.greatest(
        F.least(F.coalesce(F.nanvl(weight, F.lit(None)), F.lit(LEAST_WEIGHT)), F.lit(MOST_WEIGHT)),
        F.lit(LEAST_WEIGHT),
    )
    rows = df.select(
        *(c for c in df.columns if c not in added),
        F.coalesce(size, F.lit(0)).cast("long").alias("size"),
        held.alias("_weight"),
        F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("")).alias("_group"),
    )
    sizes = settled(
        rows.groupBy("_group", F.col(source).alias("source")).agg(
            F.sum("size").alias("source_size"), F.count("*").alias("rows")
        )
    )
    n = sizes.agg(F.sum("rows")).first()[0] or 0
    targets = settled(
        source_targets(sizes.select("source", "source_size"), turn, share, most).select(
            F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("")).alias("_group"),
            "source_size",
            "target",
        )
    )
    drawn = -F.log(unit_interval(F.lit(seed), F.col(key), F.col("size"))) / F.col("_weight")
    # With weights up to MOST_WEIGHT no stretch of the keys of length 1/bins has more than
    # that part of a source, wherever it lies.
    keyed = rows.withColumn("_key", drawn)
    ahead = running_sum(
        keyed,
        ["_group"],
        [F.col("_key"), F.col(key), F.col("size")],
        F.floor(F.col("_key") * (bins_for(n) * MOST_WEIGHT)).cast("long"),
        F.col("size"),
        "_ahead",
    )
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.col("target") - F.col("_whole") * F.col("source_size")
    last = (F.col("_ahead") + F.col("size") / 2 <= rest) & (rest > 0)
    return (
        ahead.join(small(targets), "_group")
        .withColumn("_whole", whole.cast("long"))
        .withColumn("copies", F.col("_whole") + last.cast("long"))
        .withColumn("taken", F.col("copies") * F.col("size"))
        .select(*(c for c in df.columns if c not in added), *added)
    )


def drawn_rows(mixed: DataFrame) -> DataFrame:
    """The mix itself: each row as often as it was taken."""
    return mixed.where("copies > 0").withColumn(
        "copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    )
