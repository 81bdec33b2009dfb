import pytest
from conftest import rows

from culprit.operators.datatests import (
    DataTest,
    accepted_values_failures,
    failing_keys,
    failures_table,
    keys_from_failures,
    not_null_failures,
    relationship_failures,
    run_tests,
    unique_failures,
)


@pytest.fixture(scope="module")
def models(spark):
    return {
        "stg_orders": spark.sql(
            "SELECT * FROM VALUES (1,1,'a'),(2,NULL,'b'),(2,9,'c'),(4,9,NULL) t(id, cust, st)"
        ),
        "stg_customers": spark.sql("SELECT * FROM VALUES (1),(2) t(id)"),
    }


TESTS = (
    DataTest("not_null", "stg_orders", "cust"),
    DataTest("unique", "stg_orders", "id"),
    DataTest("relationships", "stg_orders", "cust", "stg_customers", "id"),
    DataTest("accepted_values", "stg_orders", "st", accepted=("a", "b")),
    DataTest("not_null", "stg_customers", "id"),
)


def test_single_tests(models):
    orders, customers = models["stg_orders"], models["stg_customers"]
    assert rows(not_null_failures(orders, "cust")) == [(2, None, "b")]
    assert rows(unique_failures(orders, "id")) == [(2, 2)]
    assert rows(relationship_failures(orders, "cust", customers, "id")) == [(9,), (9,)]
    assert rows(accepted_values_failures(orders, "st", ("a", "b"))) == [("c", 1)]


def test_suite(models):
    got = {r.test_name: (r.failures, r.status) for r in run_tests(models, TESTS).collect()}
    assert got == {
        "not_null_stg_orders_cust": (1, "fail"),
        "unique_stg_orders_id": (1, "fail"),
        "relationships_stg_orders_cust__id__ref_stg_customers_": (2, "fail"),
        "accepted_values_stg_orders_st__a__b": (1, "fail"),
        "not_null_stg_customers_id": (0, "pass"),
    }


def test_keys_by_shape(models):
    want = [["2"], ["2"], ["2", "4"], [], []]
    for test, keys in zip(TESTS, want):
        got = [pk for _, pk in rows(failing_keys(models, test, "id"))]
        assert got == keys, test.name


def test_keys_from_stored_failures(spark, models):
    orders = models["stg_orders"]
    want = [["2"], ["2"], ["2", "4"], []]
    for test, keys in zip(TESTS, want):
        stored = failures_table(models, test)
        got = [pk for (pk,) in rows(keys_from_failures(stored, orders, "id", test.column))]
        assert got == keys, test.name
    tested_column = spark.sql("SELECT 9 AS cust")
    assert keys_from_failures(tested_column, orders, "id", "cust").count() == 2
    assert keys_from_failures(failures_table(models, TESTS[2]), orders, "id", None).count() == 0


def test_groups_on_either_side(spark, models):
    child = models["stg_orders"].crossJoin(spark.sql("SELECT * FROM VALUES ('x'),('y') t(g)"))
    split_child = run_tests({**models, "stg_orders": child}, TESTS[:3], by=["g"])
    assert rows(split_child.filter("failures > 0"), "g").count(("x",)) == 3
    parent = spark.sql("SELECT * FROM VALUES ('x',1),('x',9),('y',1) t(g, id)")
    both = {**models, "stg_customers": parent}
    split_parent = run_tests(both, TESTS[2:3], by=["g"], groups=["x", "y"])
    assert rows(split_parent, "g", "failures") == [("x", 0), ("y", 2)]
    keys = failing_keys(both, TESTS[2], "id", by=["g"], groups=["x", "y"])
    assert rows(keys, "g", "pk") == [("y", "2"), ("y", "4")]
