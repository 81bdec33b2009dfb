import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from culprit.operators import history


def test_null_rate_trend(spark):
    df = spark.sql(
        "SELECT DATE '2026-01-01' + CAST(d AS INT) AS ts, CASE WHEN i >= k THEN 1 END AS v "
        "FROM (SELECT explode(array(0, 1, 2, 3, 40)) AS d), (SELECT explode(sequence(0, 9)) AS i) "
        "JOIN (SELECT * FROM VALUES (0,1),(1,3),(2,2),(3,9),(40,5) t(e, k)) ON d = e"
    )
    got = {str(r.day): r for r in history.null_rate_trend(df, "v", "ts").collect()}
    assert got["2026-01-01"].null_rate_p50 is None and got["2026-01-01"].null_rate_z == 0.0
    late = got["2026-01-04"]
    assert late.null_rate == 0.9 and late.null_rate_p50 == pytest.approx(0.2)
    assert late.null_rate_z == pytest.approx(7.0)
    assert got["2026-02-10"].null_rate_p50 is None


def test_schema_diff(spark):
    old = spark.sql("SELECT * FROM VALUES ('t','a','INT'),('t','b','INT'),('t','c','INT') x(table_name,column_name,dtype)")
    new = spark.sql("SELECT * FROM VALUES ('t','b','STRING'),('t','c','INT'),('t','d','INT') x(table_name,column_name,dtype)")
    got = rows(history.schema_diff(old, new), "column_name", "change")
    assert got == [("a", "dropped"), ("b", "retyped"), ("d", "added")]


def test_expired_references(spark):
    facts = spark.sql("SELECT * FROM VALUES (1,5),(1,11),(2,99),(3,1),(NULL,1) t(k, at)")
    versions = spark.sql("SELECT * FROM VALUES (1,3),(1,10),(2,7),(2,NULL) t(k, ends)")
    got = history.expired_references(facts, "k", "at", versions, "k", "ends").first()
    assert (got.n_rows, got.n_expired) == (5, 1)


def covered(versions, member, at):
    """Plain standing of a row: early, expired, unknown or fine."""
    own = [(a, b) for k, a, b in versions if k == member]
    if member is None or at is None:
        return None
    if not own:
        return "unknown"
    begun = [(a, b) for a, b in own if a is None or a <= at]
    if not begun:
        return "early"
    return None if any(b is None or b >= at for _, b in begun) else "expired"


@pytest.mark.parametrize("unit", ["month", "day", "year"])
@pytest.mark.parametrize("seed", [1, 2])
def test_interval_references(spark, unit, seed):
    draw = random.Random(seed)
    day = lambda n: f"2024-{n // 28 + 1:02d}-{n % 28 + 1:02d} 00:00:00"
    # Gaps, overlaps, open ends and beginnings; one member holds most rows.
    versions = [
        (draw.choice([1, 1, 2, 3]), a if draw.random() < 0.95 else None, a + draw.randrange(0, 25) if draw.random() < 0.9 else None)
        for a in (draw.randrange(20, 250) for _ in range(25))
    ]
    facts = [(draw.choice([1, 1, 1, 1, 2, 3, 4, None]), draw.choice([None, *range(0, 300)]), draw.choice("xy")) for _ in range(400)]
    as_day = lambda n: None if n is None else day(n)
    df = spark.createDataFrame([(k, as_day(a), g) for k, a, g in facts], "k int, at string, g string")
    vs = spark.createDataFrame([(k, as_day(a), as_day(b)) for k, a, b in versions], "m int, a string, b string")
    got = history.interval_references(df, "k", "at", vs, "m", "a", "b", by=["g"], unit=unit)
    told = {r["g"]: tuple(r[n] for n in ("n_rows", "n_early", "n_expired", "n_unknown")) for r in got.collect()}
    for g in "xy":
        stands = [covered(versions, k, a) for k, a, h in facts if h == g]
        assert told[g] == (len(stands), *(stands.count(w) for w in ("early", "expired", "unknown")))


def test_event_between_two_versions_has_expired(spark):
    facts = spark.sql("SELECT 1 AS k, TIMESTAMP_NTZ '2024-02-15' AS at")
    versions = spark.sql(
        "SELECT * FROM VALUES (1, DATE '2024-01-01', DATE '2024-01-31'), (1, DATE '2024-03-01', NULL) t(k, a, b)"
    )
    got = history.interval_references(facts, "k", "at", versions, "k", "a", "b").first()
    assert got.asDict() == {"n_rows": 1, "n_early": 0, "n_expired": 1, "n_unknown": 0}


def test_unit_factor(spark):
    df = spark.sql("SELECT * FROM VALUES (100D,1D),(1D,100D),(1.2D,1D),(1D,0D),(NULL,1D),(1010D,1D) t(a,b)")
    got = [r[0] for r in df.select(history.unit_factor(F.col("a"), F.col("b"))).collect()]
    assert got == [100.0, 0.01, None, None, None, 1000.0]


def test_hash_split_and_interval(spark):
    df = spark.range(4000)
    parts = dict(rows(history.hash_split(df, F.col("id"), {"fit": 60, "test": 40}).groupBy("part").count()))
    assert abs(parts["fit"] - 2400) < 120 and parts["fit"] + parts["test"] == 4000
    with pytest.raises(ValueError):
        history.hash_split(df, F.col("id"), {"fit": 60})
    got = history.bootstrap_interval(df, "id", F.col("id") % 4 == 0).first()
    assert got.mean == 0.25 and got.low < 0.25 < got.high and got.high - got.low < 0.04
