"""End to end: labelled faults, the stream, calibration, repairs and the SQL twins."""

import sys
from pathlib import Path

import duckdb
import pytest
from conftest import rows
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from culprit.catalog import fixtures as fx
from culprit.catalog.oracles import ORACLES
from culprit.catalog.queries import QUERIES
from culprit.functions.detectors import DETECTORS
from culprit.operators import calibration, repair
from culprit.operators.incidents import build_incidents
from culprit.plans import retail
from culprit.plans.suite import project, run_suite
from culprit.plans.triage import triage
from culprit.sources.store import IncidentStore
from culprit.streaming.triage_stream import triage_stream, write_artifacts

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))
import check  # noqa: E402


def test_labelled_suite_is_solved(spark, folder):
    run = run_suite(spark, retail.sources(spark, folder), "full", at=F.lit("2026-01-01"))
    got = run.report().first()
    assert (got.n_incidents, got.top1_table_acc, got.column_acc_given_table) == (45, 1.0, 1.0)
    assert (got.row_recall, got.row_precision, got.macro_class_f1) == (1.0, 1.0, 1.0)
    assert tuple(run.counters().first()) == (45, 45, 0, 0)
    assert run.stealth().isEmpty()


def test_nothing_fails_nothing_found(spark, folder):
    raw = retail.sources(spark, folder)
    tests = [t for t in retail.TESTS if t.kind == "not_null" and t.model in retail.STAGING_NAMES]
    answer = triage(spark, raw, retail.staging(raw), project(spark), tests=tests)
    assert answer.incidents.isEmpty() and answer.blame_rows.isEmpty()
    answer.release()


def test_stream_twice_is_stream_once(spark, folder, tmp_path):
    runs, manifests = fx.artifacts(spark, folder)
    write_artifacts(runs, manifests, str(tmp_path / "in"))
    evidence = fx.line_classified(spark, folder).withColumn(
        "run_id", F.concat(F.lit("run_"), F.col("feed_id").cast("string"))
    )

    def respond(failing):
        met = failing.select("run_id", "test_name").join(evidence, ["run_id", "test_name"])
        return build_incidents(met, identity=["feed_id", "test_name"],
                               created_at=F.lit("2026-01-01"))

    kept = IncidentStore(spark, str(tmp_path / "store"))
    for progress in ("a", "b"):  # a lost checkpoint replays every file
        triage_stream(spark, str(tmp_path / "in"), respond, kept, str(tmp_path / progress))
        found = rows(kept.current(), "incident_id")
        assert len(found) == len(set(found)) > 0
    once = found
    write_artifacts(runs.limit(0), manifests, str(tmp_path / "in"))
    triage_stream(spark, str(tmp_path / "in"), respond, kept, str(tmp_path / "b"))
    assert rows(kept.current(), "incident_id") == once


def test_calibration(spark):
    pairs = spark.sql(
        "SELECT * FROM VALUES (0.5D,false),(0.5D,true),(0.7D,false),(0.9D,true) t(score, correct)"
    )
    model = calibration.fit_calibration(pairs)
    asked = spark.sql("SELECT * FROM VALUES (0.1D),(0.5D),(0.7D),(0.8D),(1.0D) t(score)")
    got = dict(rows(calibration.apply_calibration(asked, model)))
    third = pytest.approx(1 / 3)
    assert got == {0.1: third, 0.5: third, 0.7: third, 0.8: pytest.approx(2 / 3), 1.0: 1.0}
    assert calibration.fit_calibration(pairs.filter("false")) is None
    same = calibration.apply_calibration(asked, None)
    assert all(r.score == r.calibrated for r in same.collect())


def test_held_out_calibration(spark):
    """Scores that say 0.9 and are right in a quarter of cases; groups of three rows."""
    pairs = spark.range(3000).select(
        F.lit(0.9).alias("score"), (F.col("id") % 4 == 0).alias("correct"),
        F.floor(F.col("id") / 3).alias("run"),
    )
    got = {r.method: r for r in calibration.held_out(pairs, F.col("run")).collect()}
    assert list(got) == list(calibration.METHODS)
    assert [m for m, r in got.items() if r.chosen] == [min(got, key=lambda m: got[m].brier)] != ["raw"]
    assert got["raw"].ece == pytest.approx(0.65, abs=0.05) and got["isotonic"].ece < 0.05
    for r in got.values():
        assert r.ece_low <= r.ece_high and r.n_test % 3 == r.n_tune % 3 == 0
    lost = pairs.unionByName(pairs.withColumn("score", F.lit(None).cast("double")))
    assert {r.method: r for r in calibration.held_out(lost, F.col("run")).collect()} == got
    nowhere = calibration.apply_calibration(lost.filter("score IS NULL"), calibration.fit_calibration(lost))
    assert nowhere.filter("calibrated IS NOT NULL").isEmpty()
    none = calibration.held_out(pairs.filter("false"), F.col("run")).collect()
    assert len(none) == 4 and not any(r.chosen or r.brier is not None or r.ece is not None for r in none)


def test_calibrated_triage_with_own_rules(spark, folder):
    raw, _ = fx.one_fault(spark, folder, "null_spike.heavy_30pct")
    plan = project(spark)
    tests = [t for t in retail.TESTS if t.name == "not_null_stg_orders_customer_id"]
    pairs = spark.sql("SELECT * FROM VALUES (0.2D,false),(0.9D,true),(1.0D,false) t(score, correct)")
    curve = calibration.calibrator(calibration.fit_calibration(pairs))

    def run(**options):
        answer = triage(spark, raw, retail.staging(raw), plan, tests=tests, **options)
        found = answer.incidents.first().hypotheses[0]
        answer.release()
        return found

    plain = run()
    assert plain.confidence == plain.confidence_calibrated == 1.0
    fitted = run(calibrate=curve)
    assert (fitted.confidence, fitted.confidence_calibrated) == (1.0, 0.5)
    none = run(detectors=DETECTORS[1:2])
    assert none.cause_class == "unknown"

    def tiebreaker(unsure):
        late = lambda s: s.withField("cause_class", F.lit("late_arriving"))
        return unsure.withColumn("class_scores", F.transform("class_scores", late))

    assert run(detectors=DETECTORS[1:2], tiebreaker=tiebreaker).cause_class == "late_arriving"


def test_repairs(spark):
    df = spark.sql("SELECT * FROM VALUES (1,NULL),(1,5),(2,7),(2,7),(3,8) t(id, v)")
    assert repair.repair_nulls(df, "v").count() == 4
    assert rows(repair.repair_nulls(df, "v", 0).filter("v = 0")) == [(1, 0)]
    best = repair.repair_duplicates(df, ["id"], [("v", False)])
    assert rows(best) == [(1, 5), (2, 7), (3, 8)]
    parent = spark.sql("SELECT * FROM VALUES (5),(7) t(pk)")
    assert rows(repair.repair_orphans(df, "v", parent, "pk")) == [(1, 5), (1, None), (2, 7), (2, 7)]
    moved = repair.repair_orphans(df, "v", parent, "pk", fallback=-1)
    assert moved.filter("v = -1").count() == 1 and moved.columns == ["id", "v"]


def test_entry(spark):
    got = entry_module.entry(spark)
    assert got.count() > 0 and "payload" in got.columns


def test_every_query_has_its_sql():
    assert set(ORACLES) == set(QUERIES)
    assert set(QUERIES) <= set(entry_module.queries())


TWINS = [
    "failing_tests", "test_suite_results", "mart_customers", "probe_column_stats",
    "dupe_extra_rows", "evidence", "evidence_fleet", "lineage_walk", "blame_rows",
    "classify_rank", "incidents", "incident_upsert", "message_payload", "fault_drop_tail",
    "fault_supply_targets", "trial_diagnostics", "metrics_report_fleet", "repair_duplicates",
]


@pytest.mark.parametrize("name", TWINS)
def test_query_equals_sql(spark, folder, name):
    con = duckdb.connect()
    for table in check.NAMES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    df = QUERIES[name](spark, folder)
    got = check.table(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(entry_module.oracle_sql()[name])
    want = check.table([d[0] for d in cursor.description], cursor.fetchall())
    assert got == want
