"""The whole path for many failing tests at once: where, what, verdict, incident."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from culprit.functions.detectors import DETECTORS, Detector
from culprit.operators.datatests import DataTest, failing_keys, run_tests
from culprit.operators.deltas import facts_changed, failing_keys_changed, run_tests_changed
from culprit.operators.evidence import Target, assemble_evidence, from_facts
from culprit.operators.incidents import Tiebreaker, build_incidents, choose_test, classify
from culprit.operators.lineage import DEFAULT_KEY, walk_lineage
from culprit.operators.probes import FACTS
from culprit.schemas import FLAG, REAL, TEXT, WALK_STEP, record
from culprit.sources.constants import constant_frame

WALK_ROW = record(
    test_name=TEXT,
    kind=TEXT,
    model=TEXT,
    column=TEXT,
    certainty=REAL,
    hit_agg_boundary=FLAG,
    walk_path=T.ArrayType(WALK_STEP),
)


@dataclass(frozen=True)
class Project:
    """What is known about the models before any data is read."""

    tests: tuple[DataTest, ...]
    edges: DataFrame
    nodes: DataFrame | None
    pk_map: Mapping[str, str]

    def pk(self, model: str) -> str:
        return self.pk_map.get(model, DEFAULT_KEY)


@dataclass(frozen=True)
class Attribution:
    """A test with the place it was traced to and what to probe there."""

    test: DataTest
    target: Target
    certainty: float
    hit_agg_boundary: bool
    walk_path: list


def attribute(
    spark: SparkSession, project: Project, tests: Sequence[DataTest]
) -> list[Attribution]:
    """Walk lineage for the tests and, in the same walk, for their parents.

    The result has one entry per test.  Only model metadata is involved, so bringing
    it to the driver is bounded by the project's size; it decides which tables the
    evidence plan has to scan.
    """
    if not tests:
        return []
    starts = {(t.model, t.column) for t in tests}
    starts |= {(t.parent_model, t.parent_column) for t in tests if t.parent_model}
    frame = constant_frame(spark, sorted(starts), record(model=TEXT, column=TEXT))
    walked = {
        (w["model"], w["column"]): w
        for w in walk_lineage(frame, project.edges, project.nodes).collect()
    }
    found = []
    for t in tests:
        w = walked[(t.model, t.column)]
        parent_table = parent_pk = None
        if t.parent_model:
            p = walked[(t.parent_model, t.parent_column)]
            parent_table = p["blame_model"]
            parent_pk = p["blame_column"] or project.pk(parent_table)
        target = Target(
            t.name, t.kind, t.model, t.column, w["blame_model"], w["blame_column"],
            project.pk(w["blame_model"]), parent_table, parent_pk,
        )
        found.append(
            Attribution(t, target, w["certainty"], w["hit_agg_boundary"], w["walk_path"])
        )
    return found


def walk_frame(spark: SparkSession, found: Sequence[Attribution]) -> DataFrame:
    rows = [
        (a.test.name, a.test.kind, a.test.model, a.test.column, a.certainty,
         a.hit_agg_boundary, [s.asDict() for s in a.walk_path])
        for a in found
    ]
    return constant_frame(spark, rows, WALK_ROW)


@dataclass(frozen=True)
class Triage:
    results: DataFrame  # (by, test_name, failures, status) of every test; persisted
    classified: DataFrame  # failing tests with evidence and ranked causes
    incidents: DataFrame
    blame_rows: DataFrame  # (by, test_name, pk): failing keys carried to the source

    def release(self) -> None:
        self.results.unpersist()


def triage(
    spark: SparkSession,
    raw: Mapping[str, DataFrame],
    models: Mapping[str, DataFrame],
    project: Project,
    *,
    by: Sequence[str] = (),
    groups: Sequence[str] | None = None,
    tests: Sequence[DataTest] | None = None,
    attributions: Sequence[Attribution] | None = None,
    expected_test: str | None = None,
    one_per_group: bool = False,
    created_at: Column | None = None,
    observed_at: datetime | str | None = None,
    baselines: DataFrame | None = None,
    detectors: Sequence[Detector] = DETECTORS,
    tiebreaker: Tiebreaker | None = None,
    calibrate: Callable[[Column], Column] | None = None,
    changes: Mapping[str, DataFrame] | None = None,
    losing: Sequence[str] = (),
    **options: object,
) -> Triage:
    """Run tests, trace failures, probe the blamed tables and rank causes.

    The tests run first (their result table is small and kept); the names of those that
    failed decide which tables the rest of the plan touches.  Everything after that is
    lazy.  With `by`, one table may hold many runs (trials, loads, feeds) and each gets
    its own incidents.  `one_per_group` keeps the test closest to the source per run.
    `detectors` replaces the rules, `tiebreaker` scores the uncertain cases again, and
    `calibrate` (say, a fitted curve) turns raw confidences into calibrated ones.

    With `changes` the tables are clean ones, and each run is what its signed rows, given by
    table or model name, make of them (`operators.deltas`); `losing` names the tables of
    which rows go for good.
    """
    deltas = changes is not None
    tests = list(tests if tests is not None else project.tests)
    if attributions is None:
        attributions = attribute(spark, project, tests)
    place = {a.test.name: a for a in attributions}
    if deltas:
        results = run_tests_changed(models, changes, tests, by=by, groups=groups).persist()
    else:
        results = run_tests(models, tests, by=by, groups=groups).persist()
    broken = results.filter("status = 'fail'").select("test_name").distinct()
    failed = {row["test_name"] for row in broken.collect()}
    tests = [t for t in tests if t.name in failed]
    found = [place[t.name] for t in tests]
    # One row per failed test, the length of the list above.
    walks = F.broadcast(walk_frame(spark, found))
    failing = results.filter("status = 'fail'").join(walks, "test_name")
    if one_per_group:
        failing = choose_test(failing, by, expected_test)
    targets, tables = [a.target for a in found], {**models, **raw}
    if deltas and targets:
        wanted = options.pop("wanted", FACTS)
        facts = facts_changed(targets, tables, changes, by=by, groups=groups, losing=losing, wanted=wanted)
        evidence = from_facts(facts, targets, tables, by=by, observed_at=observed_at, baselines=baselines, **options)
    else:
        evidence = assemble_evidence(
            targets, tables, by=by, groups=groups, observed_at=observed_at, baselines=baselines, **options
        )
    evidence = evidence.withColumnRenamed("target", "test_name")
    met = failing.drop("model", "column", "kind").join(evidence, [*by, "test_name"])
    handled = F.col("failing_test_kind").isin("not_null", "unique", "relationships")
    met = met.withColumn(
        "failing_row_count", F.when(handled, F.col("failures")).otherwise(F.lit(0))
    )
    classified = classify(met, detectors, tiebreaker)
    incidents = build_incidents(
        classified,
        identity=[*by, "test_name"],
        created_at=created_at if created_at is not None else F.current_timestamp(),
        calibrate=calibrate,
    )
    def keys_of(a: Attribution) -> DataFrame:
        pk = project.pk(a.test.model)
        if deltas:
            return failing_keys_changed(models, changes, a.test, pk, by=by, groups=groups)
        return failing_keys(models, a.test, pk, by=by, groups=groups)

    keys = [keys_of(a) for a in found if not a.hit_agg_boundary]
    nothing = record(**dict.fromkeys([*by, "test_name", "pk"], TEXT))
    rows = reduce(DataFrame.unionByName, keys, constant_frame(spark, [], nothing))
    if one_per_group:
        rows = rows.join(failing.select(*by, "test_name"), [*by, "test_name"], "left_semi")
    return Triage(results, classified, incidents, rows)
