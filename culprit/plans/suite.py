"""The labelled benchmark: inject every fault, triage every trial, score the answers.

Facts are counted once over the clean tables.  A trial is the few rows that it changes,
and its tests, evidence and failing keys are the clean ones plus what these rows add.
Tests that cannot see the changed table are left out of that family's plan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from types import ModuleType

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from culprit.operators.deltas import SIGN
from culprit.operators.faults import (
    DROPOUT,
    DUPES,
    NULLS,
    FaultTarget,
    Trial,
    ground_truths,
    change,
    trial_frame,
    trials_for,
)
from culprit.operators.probes import FACTS
from culprit.operators.metrics import evaluate, pair, per_class
from culprit.plans import retail
from culprit.plans.triage import Attribution, Project, Triage, attribute, triage

KEY = "incident_key"


@dataclass(frozen=True)
class SuiteRun:
    trials: DataFrame
    truths: DataFrame
    truth_rows: DataFrame
    failing: DataFrame  # (incident_key, test_name, failures): every broken test
    classified: DataFrame  # the chosen test of each trial with evidence and causes
    predictions: DataFrame
    prediction_rows: DataFrame
    held: tuple[DataFrame, ...] = ()  # what was persisted for the run

    def release(self) -> None:
        for df in self.held:
            df.unpersist()

    def pairs(self) -> DataFrame:
        return pair(self.predictions, self.truths)

    def report(self) -> DataFrame:
        return evaluate(self.pairs(), self.prediction_rows, self.truth_rows)

    def per_class(self) -> DataFrame:
        return per_class(self.pairs())

    def stealth(self) -> DataFrame:
        """Trials whose fault broke no test."""
        return self.trials.join(self.failing.select(KEY).distinct(), KEY, "left_anti")

    def counters(self) -> DataFrame:
        """Trials, predictions, stealth faults and failed attributions."""
        broke = self.failing.select(KEY).distinct().withColumn("broke", F.lit(True))
        said = self.predictions.select(KEY).withColumn("said", F.lit(True))
        met = self.trials.select(KEY).join(broke, KEY, "left").join(said, KEY, "left")
        broke_c, said_c = F.coalesce("broke", F.lit(False)), F.coalesce("said", F.lit(False))
        return met.agg(
            F.count(F.lit(1)).alias("trials"),
            F.count_if(said_c).alias("predictions"),
            F.count_if(~broke_c).alias("stealth"),
            F.count_if(broke_c & ~said_c).alias("no_attribution"),
        )

    def diagnostics(self) -> DataFrame:
        top = F.get("class_scores", F.lit(0))
        seen = self.classified.select(
            KEY,
            F.col("test_name").alias("chosen_test"),
            F.col("failing_row_count").alias("n_failing_pks"),
            top["cause_class"].alias("predicted_class"),
            F.round(top["score"], 3).alias("predicted_score"),
            F.round("blame_null_rate", 4).alias("evidence_null_rate"),
            F.col("blame_pk_dupe_count").alias("evidence_dupe_count"),
            F.col("orphan_fk_count").alias("evidence_orphan_fk_count"),
        )
        trials = self.trials.select(
            KEY, "seed", "pattern_id", F.col("cause_class").alias("true_class")
        )
        return trials.join(seen, KEY)


def project(spark: SparkSession, plan: ModuleType = retail) -> Project:
    return Project(plan.TESTS, plan.edges(spark), plan.nodes(spark), plan.PK_MAP)


def affected(
    found: Sequence[Attribution], target: FaultTarget, family: str, staging: Sequence[str]
) -> list[Attribution]:
    """Staging tests that the fault can break.

    A fault touches one column of one table, so only tests traced to that column, as
    child or as parent, can see it; repeating parent rows orphans nobody.
    """
    hit = []
    for a in found:
        t = a.target
        spots = [(t.blame_model, t.blame_column)]
        if family != DUPES:
            spots.append((t.parent_table, t.parent_pk_column))
        if a.test.model in staging and (target.table, target.column) in spots:
            hit.append(a)
    return hit


def run_family(
    spark: SparkSession,
    raw: Mapping[str, DataFrame],
    plan: Project,
    found: Sequence[Attribution],
    family: str,
    trials: Sequence[Trial],
    created_at: Column,
    models: ModuleType = retail,
) -> tuple[Triage, DataFrame, DataFrame]:
    dataset, target = models.DATASET, models.TARGETS[family]
    seen = affected(found, target, family, models.STAGING_NAMES)
    fault = change(raw, target, trials, dataset)
    # Read by each fact of the family and by its labels; what was chosen is a few times its
    # table at most, and is kept once, not with each sign.
    chosen = fault.chosen.persist()
    changed = {target.table: fault.change}
    answer = triage(
        spark,
        raw,
        models.staging(raw),
        plan,
        by=[KEY],
        groups=[t.key(dataset) for t in trials],
        tests=[a.test for a in seen],
        attributions=seen,
        expected_test=target.expected_test,
        one_per_group=True,
        created_at=created_at,
        wanted=[f for f in FACTS if f != "distinct_count"],  # no detector reads it
        changes={**changed, **models.staging(changed, [KEY, SIGN])},
        losing=[target.table] if fault.loses else [],
    )
    return answer, fault.truth, chosen


def run_suite(
    spark: SparkSession,
    raw: Mapping[str, DataFrame],
    suite: str = "smoke",
    *,
    families: Sequence[str] = (NULLS, DUPES, DROPOUT),
    at: Column | None = None,
    latency: Column | None = None,
    models: ModuleType = retail,
) -> SuiteRun:
    """All trials of a suite over the project in `models`, a module like `plans.retail`.

    `latency` gives each prediction its clock reading.
    """
    at = at if at is not None else F.current_timestamp()
    latency = latency if latency is not None else F.lit(0.0)
    plan = project(spark, models)
    found = attribute(spark, plan, [t for t in plan.tests if t.model in models.STAGING_NAMES])
    trials = trials_for(suite, families)

    def answer_family(family: str) -> tuple[Triage, DataFrame, DataFrame]:
        own = [t for t in trials if t.pattern.family == family]
        return run_family(spark, raw, plan, found, family, own, at, models)

    # Families share nothing; their short jobs (cuts, test results) overlap on the cluster.
    with ThreadPoolExecutor(max_workers=len(families)) as pool:
        answers, truth_rows, chosen = zip(*pool.map(answer_family, families))

    def union(frames: Sequence[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, frames)

    # A row per trial, which predictions, diagnostics and scores all read.
    classified = union([a.classified for a in answers]).persist()
    top = F.get("class_scores", F.lit(0))
    predictions = classified.select(
        KEY,
        F.array("blame_model").alias("candidate_tables"),
        "blame_column",
        top["cause_class"].alias("cause_class"),
        top["score"].alias("confidence"),
        latency.cast("double").alias("latency_seconds"),
    )
    failing = union([a.results.filter("status = 'fail'") for a in answers])
    return SuiteRun(
        trial_frame(spark, trials, models.DATASET),
        ground_truths(spark, models.TARGETS, trials, models.DATASET, at),
        union(truth_rows),
        failing.select(KEY, "test_name", "failures"),
        classified,
        predictions,
        union([a.blame_rows.select(KEY, "pk") for a in answers]),
        (classified, *chosen, *[a.results for a in answers]),
    )
