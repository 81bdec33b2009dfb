import pytest
from pyspark.sql import functions as F

from culprit.operators.evidence import Target, assemble_evidence, fingerprint

ORDERS = "SELECT * FROM VALUES (1,1,'open'),(2,2,'open'),(3,3,'shipped'),(4,4,'returned') t(id, user_id, status)"
CUSTOMERS = "SELECT * FROM VALUES (1,'a'),(2,'b'),(3,'c'),(4,'d') t(id, name)"


def look(spark, orders, customers, kind, column="user_id", **options):
    target = Target("t", kind, "stg_orders", "customer_id", "raw_orders", column, "id",
                    "raw_customers", "id")
    tables = {"raw_orders": orders, "raw_customers": customers}
    return assemble_evidence([target], tables, **options).first()


@pytest.fixture(scope="module")
def orders(spark):
    return spark.sql(ORDERS)


@pytest.fixture(scope="module")
def customers(spark):
    return spark.sql(CUSTOMERS)


def test_clean(spark, orders, customers):
    e = look(spark, orders, customers, "not_null")
    assert (e.blame_row_count, e.blame_null_rate, e.blame_pk_dupe_count, e.orphan_fk_count) == (4, 0, 0, 0)
    assert e.parent_row_count is None and not e.blame_join_fanout_risk


def test_null(spark, orders, customers):
    holed = orders.withColumn("user_id", F.when(F.col("id") != 1, F.col("user_id")))
    assert look(spark, holed, customers, "not_null").blame_null_rate == 0.25


def test_duplicates(spark, orders, customers):
    more = orders.union(spark.sql("SELECT * FROM VALUES (2,99,'x'),(2,100,'y')"))
    e = look(spark, more, customers, "unique")
    assert e.blame_pk_dupe_count == 2 and e.blame_join_fanout_risk
    parent_only = look(spark, more, customers, "unique", fanout_parent_only=True)
    assert not parent_only.blame_join_fanout_risk


def test_orphans(spark, orders, customers):
    e = look(spark, orders, customers.filter("id <> 1"), "relationships")
    assert (e.orphan_fk_count, e.parent_row_count) == (1, 3)
    holed = customers.filter("id <> 1").union(spark.sql("SELECT CAST(NULL AS INT), 'x'"))
    assert look(spark, orders, holed, "relationships").orphan_fk_count == 0
    kept = look(spark, orders, holed, "relationships", ignore_null_parents=True)
    assert kept.orphan_fk_count == 1


def test_missing_column(spark, orders, customers):
    e = look(spark, orders, customers, "not_null", column="does_not_exist")
    assert (e.blame_null_rate, e.blame_row_count) == (0.0, 4)


def test_limited_duplicates(spark, customers):
    many = spark.range(120).select((F.col("id") % 60).cast("int").alias("id"),
                                   F.lit(1).alias("user_id"), F.lit("x").alias("status"))
    assert look(spark, many, customers, "unique").blame_pk_dupe_count == 60


def test_clock_and_baselines(spark):
    facts = spark.sql("SELECT 1 AS id, 1 AS fk, 20.0D AS v, TIMESTAMP_NTZ '2026-01-10 11:00:00' AS ts")
    dims = spark.sql("SELECT 1 AS id, DATE '2026-01-01' AS loaded")
    target = Target("t", "relationships", "m", "v", "facts", "v", "id", "dims", "id",
                    expected_dtype="varchar", expected_mean=10.0, expected_stddev=2.0)
    tables = {"facts": facts, "dims": dims}
    silent = assemble_evidence([target], tables).first()
    assert silent.blame_lag_ratio == 0 and not silent.blame_stale_dimension
    e = assemble_evidence([target], tables, observed_at="2026-01-10 12:00:00").first()
    assert e.blame_lag_ratio == pytest.approx(1 / 24)
    assert e.blame_stale_dimension and e.blame_dtype_mismatch
    assert e.blame_value_drift_z == 5.0
    base = spark.sql("SELECT 't' AS target, 18.0D AS expected_mean, 4.0D AS expected_stddev")
    moved = assemble_evidence([target], tables, baselines=base).first()
    assert moved.blame_value_drift_z == 0.5


def test_many_targets_share_a_scan(spark, orders, customers):
    targets = [
        Target(c, "not_null", "m", c, "raw_orders", c, "id") for c in ("user_id", "status")
    ]
    found = assemble_evidence(targets, {"raw_orders": orders, "raw_customers": customers})
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert {r.target: r.blame_cardinality_ratio for r in found.collect()} == {
        "user_id": 1.0, "status": 0.75}
    assert plan.count("Expand") == 1


def test_fingerprint(spark, orders, customers):
    target = Target("t", "not_null", "m", "c", "raw_orders", "user_id", "id")
    tables = {"raw_orders": orders, "raw_customers": customers}
    found = assemble_evidence([target], tables)
    same = found.select(fingerprint()).first()[0]
    assert same == assemble_evidence([target], tables).select(fingerprint()).first()[0]
    other = found.withColumn("orphan_fk_count", F.lit(9)).select(fingerprint()).first()[0]
    assert len(same) == 64 and same != other
