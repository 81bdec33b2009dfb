"""Ten cause detectors as column expressions over one evidence row.

Each builder returns a struct<cause_class, score, evidence_keys> column that is
null where the detector stays silent.  Everything is built in, so a million
incidents are scored inside one projection without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: thresholds and weights of the published rules -----------------
NULL_FLOOR = 0.001  # null rates up to this are noise
NULL_SLOPE = 10.0  # full score at 10 % nulls
NULL_DOMINATES = 0.05  # from here nulls explain orphans
SHARED_DAMPING = 0.5
DUPE_BASE, DUPE_SLOPE = 0.7, 30.0
ORPHAN_BASE, ORPHAN_SLOPE, ORPHAN_WITH_NULLS = 0.6, 20.0, 0.3
LAG_LIMIT, LAG_BASE, LAG_SLOPE = 1.0, 0.7, 0.2
COERCION_SHARE = 0.95
SCHEMA_SCORE, FANOUT_SCORE, STALE_SCORE = 1.0, 0.9, 0.9
DRIFT_LIMIT, DRIFT_BASE, DRIFT_SLOPE = 3.0, 0.7, 0.05
SKEW_LIMIT, SKEW_BASE, SKEW_SLOPE = 2.0, 0.5, 0.1
SILENT_SCORE = 0.5
LOW_CONFIDENCE, CLOSE_RACE = 0.7, 0.1
AUTO_SCORE, AUTO_GAP, CANDIDATE_SCORE = 0.85, 0.15, 0.6
# ---------------------------------------------------------------------------------

Detector = Callable[[], Column]


def class_score(cause: str, score: Column, *evidence: str) -> Column:
    keys = F.array(*[F.lit(e) for e in evidence]) if evidence else F.array().cast("array<string>")
    return F.struct(
        F.lit(cause).alias("cause_class"),
        score.cast("double").alias("score"),
        keys.alias("evidence_keys"),
    )


def _capped(score: Column) -> Column:
    return F.least(F.lit(1.0), score)


def _per_row(count: str) -> Column:
    """A count as a share of the blamed table's rows."""
    return F.col(count) / F.greatest(F.col("blame_row_count"), F.lit(1))


def null_spike() -> Column:
    rate = F.col("blame_null_rate")
    shared = (F.col("orphan_fk_count") > 0) & (rate < NULL_DOMINATES)
    damping = F.when(shared, SHARED_DAMPING).otherwise(1.0)
    score = _capped(rate * NULL_SLOPE) * damping
    return F.when(
        rate > NULL_FLOOR, class_score("upstream_null_spike", score, "blame_null_rate")
    )


def duplicate_ingestion() -> Column:
    score = _capped(DUPE_BASE + _per_row("blame_pk_dupe_count") * DUPE_SLOPE)
    return F.when(
        F.col("blame_pk_dupe_count") > 0,
        class_score("duplicate_ingestion", score, "blame_pk_dupe_count"),
    )


def join_dropout() -> Column:
    score = _capped(ORPHAN_BASE + _per_row("orphan_fk_count") * ORPHAN_SLOPE)
    orphans = F.col("orphan_fk_count") > 0
    by_nulls = class_score(
        "broken_join_dropout", F.lit(ORPHAN_WITH_NULLS), "orphan_fk_count", "blame_null_rate"
    )
    return F.when(orphans & (F.col("blame_null_rate") >= NULL_DOMINATES), by_nulls).when(
        orphans, class_score("broken_join_dropout", score, "orphan_fk_count")
    )


def late_arriving() -> Column:
    lag = F.col("blame_lag_ratio")
    score = _capped(LAG_BASE + (lag - LAG_LIMIT) * LAG_SLOPE)
    return F.when(lag > LAG_LIMIT, class_score("late_arriving", score, "blame_lag_ratio"))


def type_coercion() -> Column:
    fields = ("blame_integer_compatible_ratio", "blame_float_compatible_ratio")
    share = F.greatest(*fields)
    return F.when(share >= COERCION_SHARE, class_score("type_coercion", share, *fields))


def schema_change() -> Column:
    return F.when(
        F.col("blame_dtype_mismatch"),
        class_score("source_schema_change", F.lit(SCHEMA_SCORE), "blame_dtype_mismatch"),
    )


def join_fanout() -> Column:
    return F.when(
        F.col("blame_join_fanout_risk"),
        class_score("broken_join_fanout", F.lit(FANOUT_SCORE), "blame_join_fanout_risk"),
    )


def unit_drift() -> Column:
    z = F.col("blame_value_drift_z")
    score = _capped(DRIFT_BASE + (z - DRIFT_LIMIT) * DRIFT_SLOPE)
    return F.when(
        z > DRIFT_LIMIT, class_score("unit_encoding_drift", score, "blame_value_drift_z")
    )


def stale_dimension() -> Column:
    return F.when(
        F.col("blame_stale_dimension"),
        class_score("stale_dimension", F.lit(STALE_SCORE), "blame_stale_dimension"),
    )


def value_skew() -> Column:
    skew = F.col("blame_anomaly_score")
    score = _capped(SKEW_BASE + (skew - SKEW_LIMIT) * SKEW_SLOPE)
    return F.when(skew > SKEW_LIMIT, class_score("unknown", score, "blame_anomaly_score"))


# Order decides ties between equal scores.
DETECTORS: tuple[Detector, ...] = (
    null_spike,
    duplicate_ingestion,
    join_dropout,
    late_arriving,
    type_coercion,
    schema_change,
    join_fanout,
    unit_drift,
    stale_dimension,
    value_skew,
)


def ranked_scores(detectors: Sequence[Detector] = DETECTORS) -> Column:
    """Fired detectors, best first; one 'unknown' entry if none fired.

    The rank is an in-row array sort, not a window: the candidate list is as short
    as the detector list, so there is nothing to shuffle.
    """
    slots = [
        F.struct(F.lit(i).alias("slot"), detector().alias("hit"))
        for i, detector in enumerate(detectors)
    ]
    fired = F.filter(F.array(*slots), lambda s: s["hit"].isNotNull())
    ordered = F.array_sort(
        F.transform(fired, lambda s: F.struct(-s["hit"]["score"], s["slot"], s["hit"].alias("hit")))
    )
    ranked = F.transform(ordered, lambda s: s["hit"])
    silent = F.array(class_score("unknown", F.lit(SILENT_SCORE)))
    return F.when(F.size(ranked) > 0, ranked).otherwise(silent)


def _score_at(scores: Column, position: int) -> Column:
    return F.get(scores, F.lit(position))["score"]


def is_uncertain(scores: Column) -> Column:
    top, second = _score_at(scores, 0), _score_at(scores, 1)
    close = F.coalesce((top - second) < CLOSE_RACE, F.lit(False))
    return (F.size(scores) == 0) | F.coalesce(top < LOW_CONFIDENCE, F.lit(True)) | close


def verdict(scores: Column) -> Column:
    top = F.coalesce(_score_at(scores, 0), F.lit(0.0))
    gap = top - F.coalesce(_score_at(scores, 1), F.lit(0.0))
    return (
        F.when((top >= AUTO_SCORE) & (gap >= AUTO_GAP), "auto")
        .when(top >= CANDIDATE_SCORE, "two_candidate")
        .otherwise("triage_only")
    )
