"""What keeps the cost of a step in line with its input, read off plans and counters."""

import re

import pytest
from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from culprit.catalog import fixtures as fx
from culprit.operators import calibration, repair
from culprit.operators.datatests import DataTest, run_tests
from culprit.operators.evidence import Target, assemble_evidence
from culprit.operators.faults import DROPOUT, DUPES, NULLS, FaultTarget, change, inject, trials_for


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_evidence_moves_no_row_per_fact(spark):
    lines = spark.sql(
        "SELECT * FROM VALUES (1, 1, 7), (1, 1, 7), (1, 2, 8), (1, 3, NULL), (2, 4, NULL), (2, NULL, NULL), (2, NULL, NULL)"
        " t(feed, id, ref)"
    )
    parents = spark.sql("SELECT * FROM VALUES (7), (7), (9) t(id)")
    target = Target("t", "relationships", "m", "ref", "lines", "ref", "id", "parents", "id")
    found = assemble_evidence([target], {"lines": lines, "parents": parents}, by=["feed"])
    assert "Expand" not in plan_of(found)
    fields = ("blame_row_count", "blame_pk_dupe_count", "blame_null_rate", "blame_cardinality_ratio", "orphan_fk_count")
    assert rows(found, "feed", *fields) == [(1, 4, 1, 0.25, pytest.approx(2 / 3), 1), (2, 3, 1, 1.0, 0.0, 0)]


def test_evidence_of_an_empty_table(spark):
    nothing = spark.createDataFrame([], "id int, ref int")
    target = Target("t", "unique", "m", "id", "lines", "id", "id")
    found = assemble_evidence([target], {"lines": nothing}).first()
    assert (found.blame_row_count, found.blame_pk_dupe_count, found.blame_cardinality_ratio) == (0, 0, 0.0)


def test_feed_evidence_is_kept(spark, folder):
    assert fx.line_evidence(spark, folder).storageLevel.useMemory


def test_fit_reads_its_pairs_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def look(value):
        seen.add(1)
        return value

    scores = spark.range(50).select((F.udf(look, T.LongType()).asNondeterministic()("id") / 50).alias("score"), (F.col("id") > 20).alias("correct"))
    assert calibration.fit_calibration(scores) is not None
    assert seen.value == 50


ORDERS = "SELECT id AS o, id % 40 AS c, IF(id % 3 = 0, 'P', 'F') AS s FROM range(400)"
TARGETS = {
    NULLS: FaultTarget("orders", "c", "o", "", "s = 'P'"),
    DUPES: FaultTarget("orders", "o", "o", ""),
    DROPOUT: FaultTarget("customers", "c", "c", "", child_table="orders", child_fk="c", child_pk="o"),
}


@pytest.mark.parametrize("family", TARGETS)
def test_labels_come_from_the_kept_rows(spark, family):
    tables = {"orders": spark.sql(ORDERS), "customers": spark.sql("SELECT id AS c FROM range(50)")}
    trials = trials_for("full", [family])
    made = change(tables, TARGETS[family], trials, "d")
    _, truth = inject(tables, TARGETS[family], trials, "d")
    assert rows(made.truth) == rows(truth)
    kept = made.chosen.persist()
    try:
        for frame in (made.truth, made.change):
            assert "InMemoryTableScan" in plan_of(frame.select("*"))
    finally:
        kept.unpersist()


def test_keys_are_hashed_once_per_seed(spark):
    trials = trials_for("full", [NULLS])
    seeds = {t.seed for t in trials}
    faulted, truth = inject({"orders": spark.sql(ORDERS)}, TARGETS[NULLS], trials, "d")
    for frame in (faulted, truth):
        assert plan_of(frame).count("md5(") == len(seeds)


def test_orphan_repair_joins_no_null_keys(spark):
    child = spark.sql("SELECT id, IF(id % 4 = 0, NULL, id % 7) AS ref FROM range(28)")
    parent = spark.sql("SELECT * FROM VALUES (1L), (1L), (2L), (NULL) t(k)")
    kept = repair.repair_orphans(child, "ref", parent, "k")
    moved = repair.repair_orphans(child, "ref", parent, "k", fallback=-1)
    told = [(i, None if i % 4 == 0 else i % 7) for i in range(28)]
    assert rows(kept) == sorted((t for t in told if t[1] in (None, 1, 2)), key=repr)
    assert rows(moved) == sorted(((i, r if r in (None, 1, 2) else -1) for i, r in told), key=repr)
    assert "LeftOuter" not in plan_of(moved) and "Aggregate" not in plan_of(moved)


def test_a_column_is_counted_once_for_all_that_is_asked(spark):
    rows_of = "SELECT * FROM VALUES (1, 'a'), (1, 'a'), (2, NULL), (NULL, 'b'), (NULL, 'b') t(id, word)"
    lines = spark.sql(rows_of)
    one = assemble_evidence([Target("t", "unique", "m", "id", "lines", "id", "id")], {"lines": lines})
    assert "Expand" not in plan_of(one)
    fields = ("blame_row_count", "blame_pk_dupe_count", "blame_null_rate", "blame_cardinality_ratio")
    assert rows(one, *fields) == [(5, 2, 0.4, pytest.approx(2 / 3))]
    two = [Target("a", "unique", "m", "id", "lines", "id", "id"), Target("b", "not_null", "m", "word", "lines", "word", "id")]
    found = assemble_evidence(two, {"lines": lines})
    assert rows(found, "target", *fields) == [
        ("a", 5, 2, 0.4, pytest.approx(2 / 3)), ("b", 5, 2, 0.2, 0.5),
    ]
    # Two columns, two copies, though the first is asked for both roles.
    copies = re.search(r"Expand (\[\[.*?\]\])", plan_of(found)).group(1)
    assert copies.count("[") == 4  # the list, two copies and one of what is not distinct


def test_suite_keys_stay_numbers_and_cost_no_lambda(spark):
    models = {
        "c": spark.sql("SELECT * FROM VALUES (1, 7, 'x'), (1, 8L, NULL), (NULL, NULL, 'y'), (3, 9, 'y') t(id, ref, st)"),
        "p": spark.sql("SELECT * FROM VALUES (7), (7), (NULL) t(id)"),
        "w": spark.sql("SELECT id, coalesce(n, 0) AS n FROM (SELECT * FROM VALUES (1), (2) t(id)) "
                       "LEFT JOIN (SELECT k AS id, count(*) AS n FROM VALUES (1), (1) t(k) GROUP BY k) USING (id)"),
    }
    tests = (
        DataTest("unique", "c", "id"), DataTest("not_null", "c", "ref"), DataTest("relationships", "c", "ref", "p", "id"),
        DataTest("accepted_values", "c", "st", accepted=("x",)), DataTest("accepted_values", "c", "ref", accepted=(7,)),
        DataTest("unique", "c", "st"), DataTest("not_null", "w", "n"), DataTest("unique", "w", "id"), DataTest("unique", "p", "id"),
    )
    found = run_tests(models, tests)
    assert dict(rows(found, "test_name", "failures")) == dict(zip((t.name for t in tests), (1, 1, 2, 1, 2, 1, 0, 0, 1)))
    plan = plan_of(found)
    assert "lambda" not in plan and "as string" not in plan
    assert "Join" not in plan  # the only thing that needs it is a column that is never null
