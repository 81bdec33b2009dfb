"""From evidence to ranked causes, verdicts, incidents and messages."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from culprit.functions import wording
from culprit.functions.detectors import (
    DETECTORS,
    Detector,
    is_uncertain,
    ranked_scores,
    verdict,
)
from culprit.functions.keys import incident_id
from culprit.schemas import BLAME, HYPOTHESIS, INCIDENT

Tiebreaker = Callable[[DataFrame], DataFrame]


def classify(
    evidence: DataFrame,
    detectors: Sequence[Detector] = DETECTORS,
    tiebreaker: Tiebreaker | None = None,
) -> DataFrame:
    """Adds `class_scores` (best first) and `is_uncertain`.

    A tiebreaker gets the uncertain rows only and returns them with new scores.
    """
    # Exploding a one-element array pins the value: a later filter on a verdict would
    # otherwise be pushed below this step with the whole ranking copied into it for
    # every mention of a score, and planning would take minutes.
    pinned = F.explode(F.array(ranked_scores(detectors)))
    scored = evidence.withColumn("class_scores", pinned)
    scored = scored.withColumn("is_uncertain", is_uncertain(F.col("class_scores")))
    if tiebreaker is None:
        return scored
    unsure = tiebreaker(scored.filter("is_uncertain"))
    return scored.filter(~F.col("is_uncertain")).unionByName(unsure)


def ranked_causes(classified: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per (incident, rank)."""
    entry = F.posexplode("class_scores").alias("position", "entry")
    return classified.select(*keys, entry).select(
        *keys,
        (F.col("position") + 1).alias("rank"),
        F.col("entry.cause_class").alias("cause_class"),
        F.col("entry.score").alias("score"),
    )


def choose_test(
    failing: DataFrame,
    by: Sequence[str],
    name: str | Column | None = None,
    *,
    strict: bool = False,
) -> DataFrame:
    """One failing test per run: the named one, else staging models first.

    A test of exactly that name goes before those whose names begin with it, which are
    taken in the order of the artifact if it is known (`position`).  `strict` gives no
    row for a run in which no name fits, instead of another test.  The rank filter turns
    into a per-task group limit before the shuffle.
    """
    fit = F.lit(2)
    if name is not None:
        asked = F.lit(name) if isinstance(name, str) else name
        fit = F.when(F.col("test_name") == asked, 0).when(F.col("test_name").startswith(asked), 1)
        fit = fit.otherwise(2)
        if strict:
            failing = failing.filter(fit < 2)
    place = F.col("position") if "position" in failing.columns else F.lit(0)
    order = Window.partitionBy(*by).orderBy(
        fit,
        F.when(fit == 1, place),
        F.when(F.col("model").startswith("stg_"), 0).otherwise(1),
        "model",
        "test_name",
    )
    return failing.withColumn("choice", F.row_number().over(order)).filter("choice = 1").drop(
        "choice"
    )


def build_incidents(
    classified: DataFrame,
    *,
    identity: Sequence[str],
    created_at: Column,
    calibrate: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Incident records from classified evidence.

    Expects test_name, failing_row_count, certainty, hit_agg_boundary and walk_path
    beside the evidence fields.  `identity` names the columns an incident id stands for.
    """
    top = F.get("class_scores", F.lit(0))
    cause, score = top["cause_class"], top["score"]
    model, column = F.col("blame_model"), F.col("blame_column")
    guess = F.struct(
        cause.alias("cause_class"),
        model.alias("blame_model"),
        column.alias("blame_column"),
        F.array().cast("array<string>").alias("blame_rows_sample"),
        score.alias("confidence"),
        (calibrate(score) if calibrate else score).alias("confidence_calibrated"),
        wording.evidence_summary(cause, score).alias("evidence_summary"),
        wording.suggested_fix(cause, model, column).alias("suggested_one_line_fix"),
    ).cast(HYPOTHESIS)
    place = F.struct(
        model.alias("model"),
        column.alias("column"),
        F.col("certainty").alias("certainty"),
        F.col("walk_path").alias("walk_path"),
        F.col("hit_agg_boundary").alias("hit_agg_boundary"),
    ).cast(BLAME)
    rows = classified.withColumns(
        {"_guess": guess, "_verdict": verdict(F.col("class_scores")), "_place": place}
    )
    no_samples = F.array().cast("array<string>")
    fields = {
        "incident_id": incident_id(*[F.col(c) for c in identity]),
        "created_at": created_at.cast("timestamp"),
        "failing_test_name": F.col("test_name"),
        "failing_model": F.col("failing_model"),
        "failing_column": F.col("failing_column"),
        "failing_row_count": F.col("failing_row_count"),
        "failing_rows_sample": no_samples,
        "blame_location": F.col("_place"),
        "upstream_stats": no_samples,
        "class_scores": F.col("class_scores"),
        "hypotheses": F.array("_guess"),
        "verdict_type": F.col("_verdict"),
        "final_verdict": F.when(F.col("_verdict") != "triage_only", F.col("_guess")),
        "human_label": F.lit(None),
        "time_to_verdict_seconds": F.lit(0.0),
        "token_cost_usd": F.lit(0.0),
    }
    return rows.select(
        *[fields[f.name].cast(f.dataType).alias(f.name) for f in INCIDENT.fields]
    )


def incident_rows(incidents: DataFrame) -> DataFrame:
    """Typed store columns plus the whole record as JSON; no verdict, no final class."""
    payload = F.to_json(
        F.struct(*[f.name for f in INCIDENT.fields]), {"ignoreNullFields": "false"}
    )
    return incidents.select(
        "incident_id",
        "created_at",
        "failing_test_name",
        "failing_model",
        "failing_column",
        "failing_row_count",
        F.col("blame_location.model").alias("blame_model"),
        F.col("blame_location.column").alias("blame_column"),
        F.col("blame_location.certainty").alias("blame_certainty"),
        F.col("blame_location.hit_agg_boundary").alias("blame_hit_agg_boundary"),
        "verdict_type",
        F.col("final_verdict.cause_class").alias("final_cause_class"),
        F.col("final_verdict.confidence_calibrated").alias("confidence"),
        F.col("time_to_verdict_seconds").alias("time_to_verdict_s"),
        "token_cost_usd",
        "human_label",
        payload.alias("payload"),
    )


def from_payload(rows: DataFrame) -> DataFrame:
    """Incidents back from their JSON payload."""
    return rows.select(F.from_json("payload", INCIDENT).alias("incident")).select("incident.*")


def likely_cause(default: str = "-") -> Column:
    """The verdict's class, else the best score's, else a mark."""
    return F.coalesce(
        F.col("final_verdict.cause_class"),
        F.get("class_scores", F.lit(0))["cause_class"],
        F.lit(default),
    )


def incident_summary(incidents: DataFrame) -> DataFrame:
    return incidents.select(
        "incident_id", "created_at", "failing_model", "verdict_type", likely_cause().alias("cause")
    )


def incidents_by_place(incidents: DataFrame) -> DataFrame:
    """Incidents grouped by what they blame, with their span and surest cause."""
    place = incidents.select(
        F.col("blame_location.model").alias("blame_model"),
        F.col("blame_location.column").alias("blame_column"),
        "created_at",
        likely_cause().alias("cause"),
    )
    return place.groupBy("blame_model", "blame_column", "cause").agg(
        F.count(F.lit(1)).alias("n_incidents"),
        F.min("created_at").alias("first_seen"),
        F.max("created_at").alias("last_seen"),
    )


def narrate(incidents: DataFrame) -> DataFrame:
    """Headline, story, fix, chat payload and review comment for each incident."""
    flat = incidents.select(
        "incident_id",
        "failing_test_name",
        "failing_model",
        "failing_column",
        "verdict_type",
        F.col("blame_location.model").alias("blame_model"),
        F.col("blame_location.column").alias("blame_column"),
        likely_cause("unknown").alias("cause"),
        F.coalesce("final_verdict.suggested_one_line_fix", F.lit(wording.FALLBACK_FIX)).alias(
            "one_line_fix"
        ),
    )
    failing, blamed = wording.or_star(F.col("failing_column")), wording.or_star(F.col("blame_column"))
    told = flat.withColumns(
        {
            "headline": F.format_string(wording.HEADLINE, "failing_test_name"),
            "narrative": F.format_string(
                wording.STORY, F.col("failing_model"), failing, F.col("blame_model"), blamed,
                F.col("cause"),
            ),
        }
    )
    return told.withColumns(
        {
            "chat_blocks": wording.chat_blocks(
                F.col("headline"), F.col("narrative"), F.col("one_line_fix")
            ),
            "review_body": F.format_string(
                wording.REVIEW_BODY,
                F.col("headline"),
                F.col("incident_id"),
                F.col("failing_test_name"),
                F.col("failing_model"),
                failing,
                F.col("blame_model"),
                blamed,
                F.col("narrative"),
                F.col("one_line_fix"),
            ),
        }
    )
