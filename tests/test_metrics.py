import pytest
from conftest import rows
from pyspark.sql import functions as F

from culprit.operators import baselines, metrics


def pairs(spark, *entries):
    base = ("t", ["t"], "c", "c", "unknown", "unknown", 1.0, 1.0)
    data = []
    for i, change in enumerate(entries):
        names = ("source_table", "candidate_tables", "blame_column", "source_column", "cause_class",
                 "true_class", "confidence", "latency_seconds")
        data.append((str(i), *{**dict(zip(names, base)), **change}.values()))
    return spark.createDataFrame(
        data,
        "incident_key string, source_table string, candidate_tables array<string>, "
        "blame_column string, source_column string, cause_class string, true_class string, "
        "confidence double, latency_seconds double",
    )


def keys(spark, *groups):
    return spark.createDataFrame(
        [(str(i), k) for i, g in enumerate(groups) for k in g], "incident_key string, pk string"
    )


def test_top_k_and_column(spark):
    df = pairs(spark, {"candidate_tables": ["w1", "w2", "t"]}, {"blame_column": None}, {})
    got = metrics.table_and_latency(df).first()
    assert got.top1_table_acc == pytest.approx(2 / 3) and got.top3_table_acc == 1.0
    assert got.column_acc_given_table == 0.5


def test_row_scores(spark):
    p = pairs(spark, {}, {}, {})
    truth = keys(spark, "123", "1", "")
    said = keys(spark, "1", ["1", "99", "100"], "5")
    got = metrics.row_scores(metrics.row_overlap(said, truth), p).first()
    assert got.row_recall == pytest.approx((1 / 3 + 1) / 2)
    assert got.row_precision == pytest.approx((1 + 1 / 3 + 0) / 3)
    assert got.row_f1 == pytest.approx(2 * got.row_recall * got.row_precision
                                       / (got.row_recall + got.row_precision))


@pytest.mark.parametrize("right, want", [(True, 0.0), (False, 1.0)])
def test_calibration_error(spark, right, want):
    true = "unknown" if right else "late_arriving"
    df = pairs(spark, *[{"true_class": true} for _ in range(10)])
    assert metrics.calibration_error(df).first().ece == want


def test_latency(spark):
    three = pairs(spark, *[{"latency_seconds": float(x)} for x in (1, 3, 2)])
    four = pairs(spark, *[{"latency_seconds": float(x)} for x in (1, 3, 2, 4)])
    assert metrics.table_and_latency(three).first().median_latency_s == 2.0
    assert metrics.table_and_latency(four).first().median_latency_s == 2.5


def test_macro_f1_and_per_class(spark):
    df = pairs(
        spark,
        {"true_class": "unknown"},
        {"true_class": "unknown", "cause_class": "late_arriving"},
        {"true_class": "late_arriving", "cause_class": "late_arriving"},
        {"true_class": "late_arriving", "cause_class": "stale_dimension"},
    )
    f1 = dict(rows(metrics.class_f1(df)))
    assert f1 == {"unknown": pytest.approx(2 / 3), "late_arriving": 0.5}
    assert rows(metrics.per_class(df)) == [("late_arriving", 0.5, 2), ("unknown", 0.5, 2)]


def test_report_equals_its_parts(spark):
    df = pairs(spark, {"confidence": 0.33}, {"true_class": "late_arriving", "confidence": 0.37},
               {"candidate_tables": ["x"], "confidence": 1.7}, {"cause_class": "type_coercion"})
    said, true = keys(spark, "12", "3", "", "9"), keys(spark, "1", "34", "5", "9")
    report = metrics.evaluate(df, said, true).first()
    assert report.macro_class_f1 == pytest.approx(metrics.macro_f1(df).first()[0])
    assert report.ece == pytest.approx(metrics.calibration_error(df).first()[0])
    alone = metrics.row_scores(metrics.row_overlap(said, true), df).first()
    assert report.row_recall == pytest.approx(alone.row_recall)
    assert report.n_incidents == 4


def test_nothing_to_score(spark):
    empty = pairs(spark, {}).filter("false")
    got = metrics.evaluate(empty, keys(spark), keys(spark)).first()
    assert tuple(got) == (0,) * len(metrics.METRICS)


def test_last_prediction_counts(spark):
    said = spark.sql("SELECT 'k' AS incident_key, c AS cause_class, n FROM VALUES ('a',1),('b',2) t(c, n)")
    truth = spark.sql("SELECT 'k' AS incident_key, 'b' AS cause_class, 't' AS source_table, 'c' AS source_column")
    assert metrics.pair(said, truth, order="n").first().cause_class == "b"


def test_report_line(spark):
    row = spark.sql("SELECT 1D top1_table_acc, 1D top3_table_acc, 0.125D column_acc_given_table, "
                    "1D row_recall, 0.5D row_f1, 1D macro_class_f1, 3.14D median_latency_s, 0.0634D ece")
    assert row.select(metrics.report_line("me")).first()[0] == (
        "| me | 100.0% | 100.0% | 12.5% | 1.00 | 0.50 | 1.00 | 3.1s | 0.063 |")


def test_baselines(spark):
    failing = spark.sql(
        """SELECT * FROM VALUES ('k1','unique_orders_id','unique','orders','id'),
        ('k2','not_null_customers_x','not_null','customers','x'),
        ('k3','odd','unknown','m',NULL) t(incident_key, test_name, kind, model, column)"""
    )
    named = {r.incident_key: r for r in baselines.by_test_name(failing).collect()}
    assert named["k1"].cause_class == "duplicate_ingestion" and named["k1"].confidence == 1.0
    assert named["k3"].cause_class == "unknown"
    guess = baselines.by_name_heuristic(failing, "customer", "raw_customers", "raw_orders")
    assert [r.candidate_tables for r in guess.orderBy("incident_key").collect()] == [
        ["raw_orders"], ["raw_customers"], ["raw_orders"]]
    tables = ("raw_customers", "raw_orders", "raw_payments")
    draw = rows(baselines.by_chance(failing, tables))
    assert draw == rows(baselines.by_chance(failing, tables))
    assert all(r[1][0] in tables and r[4] == 0.33 for r in draw)
    key = spark.range(1).select(baselines.baseline_key(F.lit("p.x"), F.lit(3))).first()[0]
    assert key == "p.x_3"
