"""Scores of predictions against labels.

Key sets stay long: (incident_key, pk) rows from both sides are unioned and counted,
so an incident with billions of keys is only a larger group of small partial counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from culprit.functions.wording import fixed

N_BINS = 10

METRICS = (
    "n_incidents",
    "top1_table_acc",
    "top3_table_acc",
    "column_acc_given_table",
    "row_recall",
    "row_precision",
    "row_f1",
    "macro_class_f1",
    "ece",
    "median_latency_s",
)


def predictions_from_incidents(incidents: DataFrame, key: Column) -> DataFrame:
    """Scoring view: blamed table first, then other hypotheses' tables."""
    models = F.transform("hypotheses", lambda h: h["blame_model"])
    best = F.coalesce("final_verdict", F.get("hypotheses", F.lit(0)))
    return incidents.select(
        key.alias("incident_key"),
        F.array_distinct(F.concat(F.array("blame_location.model"), models)).alias(
            "candidate_tables"
        ),
        F.col("blame_location.column").alias("blame_column"),
        best["cause_class"].alias("cause_class"),
        best["confidence_calibrated"].alias("confidence"),
        F.col("time_to_verdict_seconds").alias("latency_seconds"),
    )


def pair(predictions: DataFrame, truths: DataFrame, order: str | None = None) -> DataFrame:
    """Labels with their prediction; of several with one key the last counts.

    The last is the greatest by `order`; without it, or with ties, by all other columns,
    so a key never pairs twice.
    """
    rest = [c for c in predictions.columns if c != "incident_key"]
    rank = F.struct(*([order] if order is not None else []), *rest)
    last = predictions.groupBy("incident_key").agg(F.max_by(F.struct(*rest), rank).alias("p"))
    predictions = last.select("incident_key", "p.*")
    if order is not None:
        predictions = predictions.drop(order)
    labels = truths.select(
        "incident_key",
        F.col("cause_class").alias("true_class"),
        "source_table",
        "source_column",
    )
    return predictions.join(labels, "incident_key")


def _mean(hit: Column) -> Column:
    return F.coalesce(F.avg(hit.cast("double")), F.lit(0.0))


def top_k_hit(k: int) -> Column:
    return F.array_contains(F.slice("candidate_tables", 1, k), F.col("source_table"))


def column_hit() -> Column:
    """True / false where the top table is right, null elsewhere."""
    right_table = F.get("candidate_tables", F.lit(0)) == F.col("source_table")
    same = F.coalesce(F.col("blame_column") == F.col("source_column"), F.lit(False))
    return F.when(right_table, same)


def class_hit() -> Column:
    return F.col("cause_class") == F.col("true_class")


def _table_aggs() -> dict[str, Column]:
    return {
        "n_incidents": F.count(F.lit(1)),
        "top1_table_acc": _mean(top_k_hit(1)),
        "top3_table_acc": _mean(top_k_hit(3)),
        "column_acc_given_table": _mean(column_hit()),
        "median_latency_s": F.coalesce(F.median("latency_seconds"), F.lit(0.0)),
    }


def table_and_latency(pairs: DataFrame) -> DataFrame:
    return pairs.agg(*[c.alias(n) for n, c in _table_aggs().items()])


def row_overlap(prediction_rows: DataFrame, truth_rows: DataFrame) -> DataFrame:
    """Per incident: size of the predicted, the true and the common key set."""
    said = prediction_rows.select("incident_key", "pk", F.lit(1).alias("p"), F.lit(0).alias("t"))
    true = truth_rows.select("incident_key", "pk", F.lit(0).alias("p"), F.lit(1).alias("t"))
    keys = (
        said.unionByName(true)
        .groupBy("incident_key", "pk")
        .agg(F.max("p").alias("p"), F.max("t").alias("t"))
    )
    return keys.groupBy("incident_key").agg(
        F.sum("p").alias("n_predicted"),
        F.sum("t").alias("n_true"),
        F.sum(F.col("p") * F.col("t")).alias("n_common"),
    )


def _row_aggs() -> dict[str, Column]:
    """Recall and precision are means over the incidents that have such a set."""

    def mean_share(whole: str) -> Column:
        return _mean(F.when(F.col(whole) > 0, F.col("n_common") / F.col(whole)))

    return {"row_recall": mean_share("n_true"), "row_precision": mean_share("n_predicted")}


def with_row_f1(means: DataFrame) -> DataFrame:
    """The harmonic mean of the two means."""
    both = F.col("row_recall") + F.col("row_precision")
    f1 = F.when(both > 0, 2 * F.col("row_recall") * F.col("row_precision") / both)
    return means.withColumn("row_f1", F.coalesce(f1, F.lit(0.0)))


def row_scores(overlap: DataFrame, pairs: DataFrame) -> DataFrame:
    met = pairs.select("incident_key").join(overlap, "incident_key", "left")
    return with_row_f1(met.agg(*[c.alias(n) for n, c in _row_aggs().items()]))


def per_class(pairs: DataFrame) -> DataFrame:
    """Accuracy of each true class."""
    return pairs.groupBy(F.col("true_class").alias("class")).agg(
        _mean(class_hit()).alias("accuracy"), F.count(F.lit(1)).alias("n")
    )


def blame_outside(incidents: DataFrame, nodes: DataFrame) -> DataFrame:
    """How many incidents blame a model that the node table does not know."""
    known = nodes.select(F.col("name").alias("blame_model")).distinct().withColumn("known", F.lit(True))
    blamed = incidents.select(F.col("blame_location.model").alias("blame_model"))
    return blamed.join(known, "blame_model", "left").agg(
        F.count(F.lit(1)).alias("n_incidents"), F.count_if(F.col("known").isNull()).alias("n_outside")
    )


def confusion(pairs: DataFrame) -> DataFrame:
    """How often each true class got each predicted class; no prediction is its own class."""
    said = F.coalesce("cause_class", F.lit("none"))
    return pairs.groupBy("true_class", said.alias("cause_class")).agg(F.count(F.lit(1)).alias("n"))


def class_f1(pairs: DataFrame) -> DataFrame:
    """F1 of each class that occurs among the labels."""
    said = pairs.select(
        F.col("cause_class").alias("class"), F.lit(0).alias("true"), F.lit(1).alias("said"),
        F.lit(0).alias("both"),
    )
    true = pairs.select(
        F.col("true_class").alias("class"), F.lit(1).alias("true"), F.lit(0).alias("said"),
        class_hit().cast("int").alias("both"),
    )
    sums = (
        said.unionByName(true)
        .groupBy("class")
        .agg(F.sum("true").alias("n"), F.sum("said").alias("said"), F.sum("both").alias("both"))
    )
    # 2tp / (2tp + fp + fn), the usual form of the harmonic mean of precision and recall.
    return sums.filter("n > 0").select(
        "class", (2 * F.col("both") / (F.col("n") + F.col("said"))).alias("f1")
    )


def macro_f1(pairs: DataFrame) -> DataFrame:
    return class_f1(pairs).agg(_mean(F.col("f1")).alias("macro_class_f1"))


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def _sure() -> Column:
    """A confidence within [0, 1]; none is no confidence."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.0))))


def _bin(n_bins: int) -> Column:
    return F.least(F.floor(_sure() * n_bins), F.lit(n_bins - 1))


def calibration_bins(pairs: DataFrame, n_bins: int = N_BINS) -> DataFrame:
    """Size, accuracy and mean confidence of each filled bin."""
    binned = pairs.select(
        _bin(n_bins).alias("bin"), _sure().alias("c"), class_hit().cast("double").alias("hit")
    )
    return binned.groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("hit").alias("accuracy"),
        F.avg("c").alias("confidence"),
    )


def calibration_error(pairs: DataFrame, n_bins: int = N_BINS) -> DataFrame:
    """Gap between confidence and accuracy over equal bins, weighted by bin size."""
    gap = F.abs(F.col("accuracy") - F.col("confidence"))
    bins = calibration_bins(pairs, n_bins)
    return bins.agg(
        F.coalesce(F.sum(F.col("n") * gap) / F.sum("n"), F.lit(0.0)).alias("ece")
    )


def _ece_agg(n_bins: int = N_BINS) -> Column:
    """The same inside a larger aggregation: one sum of (hit - confidence) per bin."""
    gap = class_hit().cast("double") - _sure()
    gaps = [
        F.abs(F.sum(F.when(_bin(n_bins) == b, gap).otherwise(0.0))) for b in range(n_bins)
    ]
    return _ratio(reduce(Column.__add__, gaps), F.count(F.lit(1)))


def evaluate(pairs: DataFrame, prediction_rows: DataFrame, truth_rows: DataFrame) -> DataFrame:
    """All metrics in one row, from one pass over the pairs; the F1 is that of whatever classes occur."""
    met = pairs.join(row_overlap(prediction_rows, truth_rows), "incident_key", "left")
    aggs = {
        **_table_aggs(),
        **_row_aggs(),
        "ece": _ece_agg(),
        "hits": F.count_if(class_hit()),
        "size": F.count(F.lit(1)),
        "level": F.grouping_id("true_class", "cause_class"),
    }
    # One pass: everything, by true class and by predicted class (levels 3, 1 and 2).
    true, said = F.col("true_class"), F.col("cause_class")
    rolled = met.groupingSets([[], [true], [said]], true, said).agg(*[c.alias(n) for n, c in aggs.items()])
    whole, by_true, by_said = (F.col("level") == i for i in (3, 1, 2))
    classes = rolled.groupBy(whole.alias("whole"), F.coalesce("true_class", "cause_class").alias("class")).agg(
        *[F.max(F.when(whole, F.col(n))).alias(n) for n in aggs if n not in ("hits", "size", "level")],
        F.sum(F.when(by_true, F.col("size"))).alias("n"),
        F.coalesce(F.sum(F.when(by_said, F.col("size"))), F.lit(0)).alias("said"),
        F.sum(F.when(by_true, F.col("hits"))).alias("both"),
    )
    f1 = F.when(F.col("class").isNotNull() & (F.col("n") > 0), 2 * F.col("both") / (F.col("n") + F.col("said")))
    # Without pairs there is no row for the whole either.
    none = {"n_incidents": F.lit(0).cast("bigint")}
    means = classes.agg(
        *[
            F.coalesce(F.max(n), none.get(n, F.lit(0.0))).alias(n)
            for n in aggs
            if n not in ("hits", "size", "level")
        ],
        _mean(f1).alias("macro_class_f1"),
    )
    return with_row_f1(means).select(*METRICS)


def report_line(system: str) -> Column:
    """The report's table row."""

    def percent(name: str) -> Column:
        return F.concat(fixed(F.col(name) * 100, 1), F.lit("%"))

    cells = [
        F.lit(system),
        percent("top1_table_acc"),
        percent("top3_table_acc"),
        percent("column_acc_given_table"),
        fixed(F.col("row_recall"), 2),
        fixed(F.col("row_f1"), 2),
        fixed(F.col("macro_class_f1"), 2),
        F.concat(fixed(F.col("median_latency_s"), 1), F.lit("s")),
        fixed(F.col("ece"), 3),
    ]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
