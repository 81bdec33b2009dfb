import pytest
from pyspark.sql import functions as F

from culprit.functions import detectors as d
from culprit.operators.incidents import choose_test, classify, ranked_causes
from culprit.schemas import EVIDENCE_DEFAULTS, bound_violations

BASE = {**EVIDENCE_DEFAULTS, "blame_row_count": 1000}


def evidence(spark, *changes):
    frames = [
        spark.range(1).select(
            F.lit(i).alias("n"), *[F.lit(v).alias(k) for k, v in {**BASE, **c}.items()]
        )
        for i, c in enumerate(changes)
    ]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


CASES = [
    (d.null_spike, {"blame_null_rate": 0.0005}, None),
    (d.null_spike, {"blame_null_rate": 0.05}, 0.5),
    (d.null_spike, {"blame_null_rate": 0.5}, 1.0),
    (d.null_spike, {"blame_null_rate": 0.02, "orphan_fk_count": 10}, 0.1),
    (d.null_spike, {"blame_null_rate": 0.20, "orphan_fk_count": 10}, 1.0),
    (d.duplicate_ingestion, {}, None),
    (d.duplicate_ingestion, {"blame_pk_dupe_count": 1}, 0.73),
    (d.join_dropout, {}, None),
    (d.join_dropout, {"orphan_fk_count": 5}, 0.7),
    (d.join_dropout, {"orphan_fk_count": 5, "blame_null_rate": 0.30}, 0.3),
    (d.late_arriving, {"blame_lag_ratio": 0.8}, None),
    (d.late_arriving, {"blame_lag_ratio": 1.5}, 0.8),
    (d.type_coercion, {"blame_integer_compatible_ratio": 0.4,
                       "blame_float_compatible_ratio": 0.5}, None),
    (d.type_coercion, {"blame_integer_compatible_ratio": 0.98,
                       "blame_float_compatible_ratio": 0.2}, 0.98),
    (d.type_coercion, {"blame_integer_compatible_ratio": 0.1,
                       "blame_float_compatible_ratio": 0.96}, 0.96),
    (d.schema_change, {}, None),
    (d.schema_change, {"blame_dtype_mismatch": True}, 1.0),
    (d.join_fanout, {}, None),
    (d.join_fanout, {"blame_join_fanout_risk": True}, 0.9),
    (d.unit_drift, {"blame_value_drift_z": 2.5}, None),
    (d.unit_drift, {"blame_value_drift_z": 5.0}, 0.8),
    (d.stale_dimension, {}, None),
    (d.stale_dimension, {"blame_stale_dimension": True}, 0.9),
    (d.value_skew, {"blame_anomaly_score": 1.5}, None),
    (d.value_skew, {"blame_anomaly_score": 4.0}, 0.7),
]


def test_golden_scores(spark):
    frame = evidence(spark, *[c for _, c, _ in CASES])
    hits = [F.when(F.col("n") == i, det()["score"]) for i, (det, _, _) in enumerate(CASES)]
    got = {r.n: r.s for r in frame.select("n", F.coalesce(*hits).alias("s")).collect()}
    for i, (det, change, want) in enumerate(CASES):
        assert got[i] == (None if want is None else pytest.approx(want)), (det.__name__, change)


def test_ranking_and_silence(spark):
    busy = {"blame_null_rate": 0.10, "blame_pk_dupe_count": 5, "orphan_fk_count": 2}
    scored = classify(evidence(spark, {}, busy))
    got = {r.n: [s.cause_class for s in r.class_scores] for r in scored.collect()}
    assert got[0] == ["unknown"]
    assert got[1][0] == "upstream_null_spike"
    assert set(got[1]) == {"upstream_null_spike", "duplicate_ingestion", "broken_join_dropout"}
    ranks = [(r.n, r.rank) for r in ranked_causes(scored, ["n"]).orderBy("n", "rank").collect()]
    assert ranks == [(0, 1), (1, 1), (1, 2), (1, 3)]


def test_ties_follow_detector_order(spark):
    tie = {"blame_join_fanout_risk": True, "blame_stale_dimension": True}
    got = classify(evidence(spark, tie)).first().class_scores
    assert [s.cause_class for s in got] == ["broken_join_fanout", "stale_dimension"]


def test_tiebreaker_sees_only_uncertain_rows(spark):
    def flip(rows):
        return rows.withColumn("class_scores", F.reverse("class_scores"))

    sure = {"blame_null_rate": 0.5}
    close = {"blame_join_fanout_risk": True, "blame_stale_dimension": True}
    got = {r.n: r.class_scores[0].cause_class
           for r in classify(evidence(spark, sure, close), tiebreaker=flip).collect()}
    assert got == {0: "upstream_null_spike", 1: "stale_dimension"}


def test_own_detectors(spark):
    def always():
        return d.class_score("late_arriving", F.lit(0.4))

    got = classify(evidence(spark, {}), detectors=[always]).first().class_scores
    assert [(s.cause_class, s.score) for s in got] == [("late_arriving", 0.4)]


@pytest.mark.parametrize(
    "scores, want",
    [([0.95, 0.20], "auto"), ([0.90, 0.85], "two_candidate"), ([0.4], "triage_only"),
     ([], "triage_only")],
)
def test_verdicts(spark, scores, want):
    entries = F.array(*[d.class_score("unknown", F.lit(s)) for s in scores])
    if not scores:
        entries = F.filter(F.array(d.class_score("unknown", F.lit(0.0))), lambda s: F.lit(False))
    assert spark.range(1).select(d.verdict(entries)).first()[0] == want


def test_choice_of_test(spark):
    failing = spark.sql(
        """SELECT * FROM VALUES (1,'b_mart','orders'),(1,'z_stg','stg_orders'),
        (1,'a_stg','stg_orders'),(2,'x','customers') t(run, test_name, model)"""
    )
    pick = {r.run: r.test_name for r in choose_test(failing, ["run"]).collect()}
    assert pick == {1: "a_stg", 2: "x"}
    named = {r.run: r.test_name for r in choose_test(failing, ["run"], "b_m").collect()}
    assert named == {1: "b_mart", 2: "x"}


def test_bounds(spark):
    df = spark.sql("SELECT * FROM VALUES (0.5D,'auto'),(1.5D,'auto'),(0.1D,'maybe') t(s, v)")
    assert bound_violations(df, ["s"], v=("auto", "triage_only")).count() == 2
