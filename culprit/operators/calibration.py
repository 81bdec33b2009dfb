"""Isotonic calibration of raw scores."""

from __future__ import annotations

from collections.abc import Callable, Mapping

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from culprit.operators.history import hash_split, poisson_times
from culprit.schemas import FLAG, REAL, TEXT, WHOLE, record
from culprit.sources.constants import constant_frame

# Scores are fitted and looked up on this grid over [0, 1].
GRID = 1000
# Equal bins of a histogram curve, and of the calibration error.
BINS = 10
# What may be chosen, the first of equally good ones.
METHODS = ("raw", "prior", "bins", "isotonic")
PARTS = {"fit": 60, "tune": 20, "test": 20}


def score_bin(score: Column) -> Column:
    """The grid point of a score; a null one has none."""
    point = F.greatest(F.lit(0), F.least(F.lit(GRID), F.round(score * GRID).cast("int")))
    return F.when(score.isNotNull(), point)


def score_groups(pairs: DataFrame) -> DataFrame:
    """(score, correct) pairs as one weighted row per grid point.

    The fit then sees 1001 rows at most, however many incidents were labelled and however
    their scores differ.  Pairs without score or label are left out.
    """
    return pairs.dropna(subset=["score", "correct"]).groupBy((score_bin(F.col("score").cast("double")) / GRID).alias("score")).agg(
        F.avg(F.col("correct").cast("double")).alias("label"),
        F.count(F.lit(1)).cast("double").alias("weight"),
    )


def fit_calibration(pairs: DataFrame) -> IsotonicRegressionModel | None:
    """None when there is nothing to fit, which leaves scores as they are."""
    return _fit_groups(score_groups(pairs))


def _fit_groups(groups: DataFrame) -> IsotonicRegressionModel | None:
    """The groups come to the driver, 1001 rows at most, so what they come from runs once."""
    told = groups.select("score", "label", "weight").collect()
    if not told:
        return None
    frame = constant_frame(
        groups.sparkSession, [tuple(g) for g in told], record(score=REAL, label=REAL, weight=REAL)
    )
    features = VectorAssembler(inputCols=["score"], outputCol="features").transform(frame)
    return IsotonicRegression(
        featuresCol="features", labelCol="label", weightCol="weight", isotonic=True
    ).fit(features)


def calibration_points(model: IsotonicRegressionModel) -> list[tuple[float, float]]:
    return list(zip(model.boundaries.toArray().tolist(), model.predictions.toArray().tolist()))


def levels(points: list[tuple[float, float]]) -> list[float]:
    """The curve at every grid point: linear between its points, flat outside them."""
    xs, ys = zip(*points)
    return np.clip(np.interp(np.arange(GRID + 1) / GRID, xs, ys), 0.0, 1.0).tolist()


def calibrator(model: IsotonicRegressionModel | None) -> Callable[[Column], Column]:
    """The fitted curve as a column expression: one look-up by the score's grid point."""
    if model is None:
        return lambda score: score
    told = ", ".join(f"{y!r}D" for y in levels(calibration_points(model)))
    return lambda score: F.get(F.expr(f"array({told})"), score_bin(score))


def apply_calibration(
    df: DataFrame, model: IsotonicRegressionModel | None, score: str = "score"
) -> DataFrame:
    return df.withColumn("calibrated", calibrator(model)(F.col(score)))


def _bin(value: Column) -> Column:
    return F.least(F.floor(score_bin(value) * BINS / GRID), F.lit(BINS - 1)).cast("int")


def curves(groups: DataFrame) -> dict[str, Callable[[Column], Column]]:
    """Each method's curve, fitted to `score_groups`: score column in, probability out.

    `raw` leaves scores alone, `prior` gives every score the share of correct ones, `bins`
    the share within its tenth (with one more pair of the prior's worth, so that a thin bin
    does not say 0 or 1), `isotonic` the monotone fit.  The groups come to the driver, 1001
    rows at most.  Without any, all methods leave scores alone.
    """
    told = groups.select("score", "label", "weight").collect()
    if not told:
        return {name: (lambda score: score) for name in METHODS}
    prior = sum(g["label"] * g["weight"] for g in told) / sum(g["weight"] for g in told)
    hits, sizes = [0.0] * BINS, [0.0] * BINS
    for g in told:
        at = min(round(g["score"] * GRID) * BINS // GRID, BINS - 1)
        hits[at] += g["label"] * g["weight"]
        sizes[at] += g["weight"]
    shares = F.array(*[F.lit((h + prior) / (n + 1)) for h, n in zip(hits, sizes)])
    schema = record(score=REAL, label=REAL, weight=REAL)
    fitted = _fit_groups(constant_frame(groups.sparkSession, [tuple(g) for g in told], schema))
    return {
        "raw": lambda score: score,
        "prior": lambda score: F.lit(prior),
        "bins": lambda score: F.get(shares, _bin(score)),
        "isotonic": calibrator(fitted),
    }


def held_out(
    pairs: DataFrame,
    group: Column,
    *,
    shares: Mapping[str, int] = PARTS,
    draws: int = 200,
    level: float = 0.95,
) -> DataFrame:
    """Curves fitted on one part, chosen on a second and scored on a third: a row per method.

    Parts go by the hash of `group`, so what belongs together (incidents of one run, say) is
    never on two sides.  `brier` is the mean squared gap between said and correct on the
    second part, and the smallest is `chosen` (ties by the order of METHODS; none without
    such pairs).  `ece` is the calibration error on the third: the gap per tenth of what is
    said, weighted by size; `ece_low` and `ece_high` bound it over draws in which a group
    counts as often as a Poisson variable says.  Figures of an empty part are null.  Pairs
    without score, label or group belong to no part; scores are taken on the grid.

    Pairs are summed once per group and grid point, groups are summed per draw and tenth
    before they move, and no figure needs more than the grid or a row per method here.
    """
    score = F.col("score").cast("double")
    known = pairs.select(
        (score_bin(score) / GRID).alias("score"),
        F.col("correct").cast("double").alias("correct"),
        group.cast("string").alias("_group"),
    ).dropna()
    summed = known.groupBy("_group", "score").agg(
        F.sum("correct").alias("hits"), F.count(F.lit(1)).cast("double").alias("n")
    )
    parts = hash_split(summed, F.col("_group"), shares).persist()
    try:
        return _held_out(parts, draws, (1 - level) / 2)
    finally:
        parts.unpersist()


def _held_out(parts: DataFrame, draws: int, tail: float) -> DataFrame:
    fit, tune, test = (parts.filter(F.col("part") == name) for name in ("fit", "tune", "test"))
    fitted = curves(
        fit.groupBy("score").agg(
            (F.sum("hits") / F.sum("n")).alias("label"), F.sum("n").alias("weight")
        )
    )
    said = {m: fitted[m](F.col("score")) for m in METHODS}

    def loss(p: Column) -> Column:
        hits, n = F.col("hits"), F.col("n")
        return F.sum(hits * (1 - p) * (1 - p) + (n - hits) * p * p) / F.sum("n")

    tuned = tune.agg(F.sum("n").alias("n"), *[loss(p).alias(m) for m, p in said.items()]).first()
    chosen = min(METHODS, key=lambda m: tuned[m]) if tuned["n"] else None

    both = F.array(*[F.struct(F.lit(m).alias("method"), p.alias("said")) for m, p in said.items()])
    gaps = (
        test.select("_group", "hits", "n", F.explode(both).alias("m"))
        .select("_group", "m.method", _bin(F.col("m.said")).alias("bin"), "n",
                (F.col("hits") - F.col("n") * F.col("m.said")).alias("gap"))
        .groupBy("_group", "method", "bin")
        .agg(F.sum("gap").alias("gap"), F.sum("n").alias("n"))
    )
    # Draw 0 is the part as it is.
    drawn = gaps.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws))))
    times = F.when(F.col("draw") == 0, 1).otherwise(poisson_times(F.col("_group"), F.col("draw")))
    errors = (
        drawn.withColumn("times", times)
        .groupBy("method", "draw", "bin")
        .agg(F.sum(F.col("times") * F.col("gap")).alias("gap"), F.sum(F.col("times") * F.col("n")).alias("n"))
        .groupBy("method", "draw")
        .agg((F.sum(F.abs("gap")) / F.nullif(F.sum("n"), F.lit(0.0))).alias("ece"), F.sum("n").alias("n"))
    )
    again = F.when(F.col("draw") > 0, F.col("ece"))
    tested = errors.groupBy("method").agg(
        F.max(F.when(F.col("draw") == 0, F.col("n"))).alias("n"),
        F.max(F.when(F.col("draw") == 0, F.col("ece"))).alias("ece"),
        F.percentile(again, F.lit(tail)).alias("low"),
        F.percentile(again, F.lit(1 - tail)).alias("high"),
    )
    found = {r["method"]: r for r in tested.collect()}
    nothing = dict.fromkeys(("n", "ece", "low", "high"))
    rows = []
    for m in METHODS:
        r = found.get(m, nothing)
        rows.append(
            (m, int(tuned["n"] or 0), tuned[m], m == chosen, int(r["n"] or 0), r["ece"], r["low"], r["high"])
        )
    return constant_frame(
        parts.sparkSession,
        rows,
        record(method=TEXT, n_tune=WHOLE, brier=REAL, chosen=FLAG, n_test=WHOLE, ece=REAL,
               ece_low=REAL, ece_high=REAL),
    )
