"""What runs change, against the same runs as whole tables."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from culprit.operators import deltas, faults
from culprit.operators.datatests import DataTest, failing_keys, run_tests
from culprit.operators.evidence import Target, assemble_evidence, from_facts
from culprit.plans import retail, supply
from culprit.plans.suite import run_suite

BY, GROUPS = ["incident_key"], ["a", "b", "c", "d"]
CHILD = "id int, fk int, kind string, amount double, at date"
PARENT = "pk int, name string, seen date"

TESTS = [
    DataTest("not_null", "child", "fk"),
    DataTest("unique", "child", "id"),
    DataTest("unique", "parent", "pk"),
    DataTest("not_null", "parent", "pk"),
    DataTest("accepted_values", "child", "kind", accepted=("x", "1")),
    DataTest("relationships", "child", "fk", "parent", "pk"),
]


def some_rows(draw, n):
    day = lambda: f"2024-01-{draw.randrange(1, 9):02d}"
    child = [
        (
            draw.choice([None, *range(n)]),
            draw.choice([None, *range(12)]),
            draw.choice([None, "x", "y", "1", "2.5", "zz"]),
            draw.choice([None, 1.5, 2.0, -7.25, 1e3]),
            day() if draw.random() < 0.9 else None,
        )
        for _ in range(n)
    ]
    parent = [(draw.choice([None, *range(10)]) if i % 7 == 0 else i % 11, draw.choice("pq"), day()) for i in range(14)]
    return child, parent


def frame(spark, data, schema):
    text = schema.replace("date", "string")
    df = spark.createDataFrame(data, text)
    return df.withColumns({n: F.col(n).cast("date") for n in ("at", "seen") if n in df.columns})


def world(spark, seed):
    """Clean tables, each run's signed rows, and each run as whole tables."""
    draw = random.Random(seed)
    clean = dict(zip(("child", "parent"), some_rows(draw, 40), strict=True))
    if seed == 3:
        clean["parent"] = [(None, "p", "2024-01-08"), *clean["parent"]]
    schemas = {"child": CHILD, "parent": PARENT}
    changed, whole = {n: [] for n in clean}, {n: [] for n in clean}
    for group in GROUPS:
        more = dict(zip(("child", "parent"), some_rows(draw, 15), strict=True))
        for name, data in clean.items():
            gone = [] if group == "a" else draw.sample(data, draw.randrange(0, len(data) // 2))
            if group == "d":  # everything goes
                gone = list(data)
            new = [] if group == "a" else draw.sample(more[name], 5)
            left = list(data)
            for r in gone:
                left.remove(r)
            whole[name] += [(*r, group) for r in left + new]
            changed[name] += [(*r, group, -1) for r in gone] + [(*r, group, 1) for r in new]
    make = lambda data, name, more: frame(spark, data, f"{schemas[name]}{more}")
    return (
        {n: make(d, n, "") for n, d in clean.items()},
        {n: make(d, n, ", incident_key string, sign int") for n, d in changed.items()},
        {n: make(d, n, ", incident_key string") for n, d in whole.items()},
    )


def only(changes, names):
    return {n: c for n, c in changes.items() if n in names}


def made(clean, whole, names):
    """Tables of which only the named ones differ by run."""
    spread = {n: deltas.to_groups(df, BY, GROUPS) for n, df in clean.items()}
    return {n: whole[n] if n in names else spread[n] for n in clean}


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("names", [("child",), ("parent",), ("child", "parent"), ()])
def test_results_and_keys_of_changed_runs(spark, seed, names):
    clean, changes, whole = world(spark, seed)
    tables = made(clean, whole, names)
    got = deltas.run_tests_changed(clean, only(changes, names), TESTS, by=BY, groups=GROUPS)
    want = run_tests(tables, TESTS, by=BY, groups=GROUPS)
    both = ("incident_key", "test_name", "failures", "status")
    # A run whose table is empty has no row of results as a whole table, and no failures.
    found = {r[:2]: r[2:] for r in rows(want, *both)}
    assert {r[:2]: r[2:] for r in rows(got, *both)} == {
        (g, t.name): found.get((g, t.name), (0, "pass")) for g in GROUPS for t in TESTS
    }
    for t in TESTS:
        pk = "id" if t.model == "child" else "pk"
        keys = deltas.failing_keys_changed(clean, only(changes, names), t, pk, by=BY, groups=GROUPS)
        plain = failing_keys(tables, t, pk, by=BY, groups=GROUPS).distinct()
        assert rows(keys, *BY, "pk") == rows(plain, *BY, "pk"), t.name


TARGETS = [
    Target("amounts", "not_null", "child", "amount", "child", "amount", "id"),
    Target("kinds", "not_null", "child", "kind", "child", "kind", "id", expected_mean=1.0, expected_stddev=2.0),
    Target("links", "relationships", "child", "fk", "child", "fk", "id", "parent", "pk"),
    Target("lost", "not_null", "gone", "x", "gone", "x", "id"),
    Target("no column", "not_null", "child", "zz", "child", "zz", "id"),
]


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("names", [("child",), ("parent",), ("child", "parent")])
def test_evidence_of_changed_runs(spark, seed, names):
    clean, changes, whole = world(spark, seed)
    facts = deltas.facts_changed(
        TARGETS, clean, only(changes, names), by=BY, groups=GROUPS, losing=names
    )
    got = from_facts(facts, TARGETS, clean, by=BY, observed_at="2024-01-10")
    want = assemble_evidence(
        TARGETS, made(clean, whole, names), by=BY, groups=GROUPS, observed_at="2024-01-10"
    )
    assert got.columns == want.columns
    for one, two in zip(rows(got.orderBy(*BY, "target")), rows(want.orderBy(*BY, "target")), strict=True):
        for name, x, y in zip(got.columns, one, two, strict=True):
            same = x == pytest.approx(y, rel=1e-9, abs=1e-9) if isinstance(y, float) else x == y
            assert same, (one[:2], name, x, y)


def test_hot_and_null_keys_are_single_rows(spark):
    """A key that owns most rows is one row of every count that runs look up."""
    clean = spark.createDataFrame([(None if i % 3 else 7,) for i in range(300)], "k int")
    assert rows(deltas.counted(clean, "k")) == [((7,), 100), ((None,), 200)]
    change = spark.createDataFrame([(None, "a", -1)] * 200 + [(7, "a", 1)], "k int, incident_key string, sign int")
    assert rows(deltas.met_counts(clean, change, "k", BY), "key", "n", "d") == [((7,), 100, 1), ((None,), 200, -200)]


@pytest.mark.parametrize("family", [faults.NULLS, faults.DUPES, faults.DROPOUT])
def test_changes_are_the_injected_tables(spark, folder, family):
    raw, target = retail.sources(spark, folder), retail.TARGETS[family]
    trials = faults.trials_for("smoke", [family])
    fault = faults.change(raw, target, trials, "shop")
    faulted, truth = faults.inject(dict(raw), target, trials, "shop")
    columns = raw[target.table].columns
    clean = deltas.to_groups(raw[target.table], BY, [t.key("shop") for t in trials]).withColumn("sign", F.lit(1))
    summed = fault.change.unionByName(clean).groupBy(*BY, *columns).agg(F.sum("sign").alias("n")).filter("n <> 0")
    whole = faulted.groupBy(*BY, *columns).agg(F.count("*").alias("n"))
    assert summed.exceptAll(whole).isEmpty() and whole.exceptAll(summed).isEmpty()
    assert rows(fault.truth) == rows(truth)


def test_no_plan_of_the_suite_copies_its_source(spark, folder):
    """Rows that leave a source are those that trials have chosen, not one a trial."""
    raw, target = retail.sources(spark, folder), retail.TARGETS[faults.NULLS]
    trials = faults.trials_for("full", [faults.NULLS])
    fault = faults.change(raw, target, trials, "shop")
    n = raw[target.table].count()
    share = sum(t.pattern.fraction for t in trials if not t.pattern.conditional)
    assert fault.change.count() <= 2 * n * (share + 0.5 * 5)
    run = run_suite(spark, raw, "smoke", at=F.lit("2026-01-01"))
    assert tuple(run.counters().first()) == (18, 18, 0, 0)
    run.release()




def test_supply_faults_are_found_in_their_places(spark, folder):
    """All places and rows; causes suffer where lines are named by an order that repeats."""
    run = run_suite(spark, supply.sources(spark, folder), "smoke", at=F.lit("2026-01-01"), models=supply)
    got = run.report().first()
    assert (got.n_incidents, got.top1_table_acc, got.column_acc_given_table) == (18, 1.0, 1.0)
    assert (got.row_recall, got.row_precision) == (1.0, 1.0)
    assert dict(rows(run.per_class(), "class", "accuracy"))["duplicate_ingestion"] == 1.0
    run.release()
