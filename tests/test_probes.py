import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from culprit.operators import probes


@pytest.fixture(scope="module")
def users(spark):
    return spark.sql(
        """SELECT * FROM VALUES
        (1, 'a@x.com', TIMESTAMP_NTZ '2026-01-01'), (2, 'b@x.com', TIMESTAMP_NTZ '2026-01-02'),
        (3, NULL, TIMESTAMP_NTZ '2026-01-03'), (4, 'a@x.com', TIMESTAMP_NTZ '2026-01-04')
        t(id, email, created_at)"""
    )


def test_column_profile(users):
    got = probes.profile_columns(users, ["email"], "users").first()
    assert (got.row_count, got.null_count, got.distinct_count) == (4, 1, 2)
    assert got.null_rate == 0.25
    assert got.cardinality_ratio == pytest.approx(2 / 3)


def test_duplicate_keys(users):
    assert rows(probes.dupe_keys(users, ["email"])) == [("a@x.com", 2)]
    assert rows(probes.dupe_keys(users, ["id"])) == []
    with pytest.raises(ValueError):
        probes.dupe_keys(users, [])


def test_composite_and_null_keys(spark):
    df = spark.sql("SELECT * FROM VALUES (1,'d1'),(1,'d1'),(2,'d2'),(3,NULL),(3,NULL) t(u, d)")
    assert rows(probes.dupe_keys(df, ["u", "d"])) == [("1|d1", 2), ("None", 2)]
    assert probes.dupe_extra_rows(df, ["u", "d"]).first().extra_rows == 2


def test_long_texts_count_whole(spark):
    """Texts that differ only at their end, and a short text that looks like a digest."""
    df = spark.sql(
        "SELECT concat(repeat('x', 5000), v) AS t FROM VALUES ('a'),('b'),('b') s(v) "
        "UNION ALL SELECT sha2(concat(repeat('x', 5000), 'a'), 256) UNION ALL SELECT NULL "
        "UNION ALL SELECT NULL"
    )
    got = probes.profile_columns(df, ["t"], "t").first()
    assert (got.distinct_count, got.null_count) == (3, 2)
    assert probes.dupe_extra_rows(df, ["t"]).first().extra_rows == 2


def test_limit_keeps_the_most_frequent(spark):
    df = spark.range(10).select((F.col("id") % 4).alias("k"))
    assert rows(probes.dupe_keys(df, ["k"], limit=2)) == [("0", 3), ("1", 3)]


def test_freshness(users, spark):
    got = probes.freshness(users, "created_at", "2026-01-05").first()
    assert got.lag_seconds == 86400
    dates = spark.sql("SELECT DATE '2026-01-04' AS d")
    assert probes.freshness(dates, "d", "2026-01-05").first().lag_seconds == 86400
    empty = probes.freshness(users.limit(0), "created_at", "2026-01-05").first()
    assert empty.max_ts is None and empty.lag_seconds is None


def test_empty_and_all_null(spark):
    empty = spark.sql("SELECT CAST(1 AS INT) AS x WHERE FALSE")
    got = probes.profile_columns(empty, ["x"], "t").first()
    assert (got.row_count, got.null_rate, got.cardinality_ratio, got.mean, got.skew) == (0,) * 5
    nulls = spark.sql("SELECT CAST(NULL AS INT) AS x FROM range(3)")
    got = probes.profile_columns(nulls, ["x"], "t").first()
    assert (got.null_rate, got.cardinality_ratio) == (1.0, 0.0)


def test_missing_column(users):
    with pytest.raises(ValueError, match="nope"):
        probes.profile_columns(users, ["nope"], "users")


def test_numbers_as_text(spark):
    df = spark.sql("SELECT * FROM VALUES ('1'),('+2'),('1.5'),('1e3'),('x'),(NULL) t(v)")
    got = probes.profile_columns(df, ["v"], "t").first()
    assert got.int_ratio == pytest.approx(0.4)
    assert got.float_ratio == pytest.approx(0.8)


def test_moments_and_adjusted_skew(spark):
    df = spark.sql("SELECT * FROM VALUES (1),(2),(9) t(v)")
    got = probes.profile_columns(df, ["v"], "t").first()
    assert got.mean == 4 and got.stddev == pytest.approx(4.358899)
    assert got.skew == pytest.approx(1.630059, abs=1e-6)
    same = probes.profile_columns(spark.sql("SELECT 5 AS v FROM range(4)"), ["v"], "t").first()
    assert same.skew == 0.0


def test_one_plan_for_all_columns_of_many_feeds(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("feed"), "id")
    got = probes.profile_columns(df, ["id"], "t", by=["feed"])
    assert rows(got, "feed", "row_count", "distinct_count") == [(0, 34, 34), (1, 33, 33), (2, 33, 33)]


def test_orphans_and_null_parents(spark):
    child = spark.sql("SELECT * FROM VALUES (1),(2),(2),(5),(NULL) t(fk)")
    parent = spark.sql("SELECT * FROM VALUES (1),(3) t(pk)")
    holed = spark.sql("SELECT * FROM VALUES (1),(NULL) t(pk)")
    assert probes.orphan_count(child, "fk", parent, "pk").first()[0] == 3
    assert probes.orphan_count(child, "fk", holed, "pk").first()[0] == 0
    assert probes.orphan_count(child, "fk", holed, "pk", ignore_null_parents=True).first()[0] == 3


def test_orphans_with_a_hot_key_and_a_split_parent(spark):
    child = spark.range(3000).select(F.when(F.col("id") < 1000, 7).otherwise(F.col("id")).alias("fk"))
    parent = spark.range(3000).select("id").crossJoin(spark.sql("SELECT * FROM VALUES ('a'),('b') t(g)"))
    parent = parent.filter("NOT (g = 'a' AND id = 7)")
    got = probes.orphan_keys(child, "fk", parent, "id", by=["g"], groups=["a", "b"])
    assert rows(got, "g", "fk", "child_rows") == [("a", 7, 1000)]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.integers(-3, 3)), min_size=1, max_size=12))
def test_ratios_stay_in_bounds(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v int")
    got = probes.profile_columns(df, ["v"], "t").first()
    assert 0 <= got.null_rate <= 1 and 0 <= got.cardinality_ratio <= 1
    extra = probes.dupe_extra_rows(df, ["v"]).first()[0]
    assert extra == len(values) - len(set(values))
