"""Rows carried through joins, groups and windows, against plain walks."""

import pytest
from conftest import rows

from culprit.operators.carry import AGG, CAST, DIRECT, JOIN_KEY, OPAQUE, WINDOW, CarryEdge, carried, carry_rows

PKS = {"mart": "id", "mid": "id", "dim": "k", "raw": "id"}


@pytest.fixture(scope="module")
def tables(spark):
    def made(values, schema):
        return spark.createDataFrame(values, schema)

    return {
        "mart": made([(1, "a"), (2, "b"), (3, None)], "id int, g string"),
        "mid": made([(10, "a", 7), (11, "a", None), (12, "b", 8), (13, None, 9), (14, "c", 7)], "id int, g string, f int"),
        "dim": made([(7, "x"), (8, "y"), (None, "z")], "k int, n string"),
        "raw": made([(i, i % 3) for i in range(10, 16)], "id int, v int"),
    }


def keys(spark, *pks):
    return spark.createDataFrame([(p,) for p in pks], "pk string")


def told(spark, tables, edges, model, column, *pks):
    return rows(carried(carry_rows(tables, edges, PKS, model, column, keys(spark, *pks))))


def test_groups_take_nulls_along_and_end_the_branch(spark, tables):
    edges = [CarryEdge("mart", "x", "mid", "f", AGG, (("g", "g"),)), CarryEdge("mid", "f", "raw", "v")]
    got = told(spark, tables, edges, "mart", "x", "1", "3", "3")
    assert got == [("mid", "f", pk, 0.7, "agg_boundary", 1) for pk in ("10", "11", "13")]


def test_joins_never_match_nulls(spark, tables):
    edges = [CarryEdge("mid", "n", "dim", "n", JOIN_KEY, (("f", "k"),))]
    assert told(spark, tables, edges, "mid", "n", "10", "11", "14") == [("dim", "n", "7", 0.85, "source", 1)]


def test_windows_and_casts_multiply(spark, tables):
    edges = [
        CarryEdge("mid", "r", "mid2", "f", WINDOW, (("g", "g"),)),
        CarryEdge("mid2", "f", "raw", "v", CAST),
    ]
    more = {**tables, "mid2": tables["mid"]}
    got = rows(carried(carry_rows(more, edges, {**PKS, "mid2": "id"}, "mid", "r", keys(spark, "10"))))
    assert got == [("raw", "v", pk, pytest.approx(0.76), "source", 2) for pk in ("10", "11")]


def test_branches_stop_when_unsure_in_circles_and_at_functions(spark, tables):
    on = (("id", "id"),)
    edges = [CarryEdge("raw", f"c{i}", "raw", f"c{i + 1}", JOIN_KEY, on) for i in range(9)]
    # 0.85 to the fifth is the first power below a half.
    assert [(r[1], r[4], r[5]) for r in told(spark, tables, edges, "raw", "c0", "12")] == [("c5", "unsure", 5)]
    circle = [CarryEdge("raw", "a", "raw", "b", DIRECT), CarryEdge("raw", "b", "raw", "a", DIRECT)]
    assert [(r[1], r[4], r[5]) for r in told(spark, tables, circle, "raw", "a", "12")] == [("b", "circle", 1)]
    opaque = [CarryEdge("raw", "a", "raw", "b", OPAQUE)]
    assert told(spark, tables, opaque, "raw", "a", "12") == [("raw", "a", "12", 1.0, "udf", 0)]


def test_branches_meet_by_the_surest(spark, tables):
    edges = [
        CarryEdge("mart", "x", "mid", "f", WINDOW, (("g", "g"),)),
        CarryEdge("mart", "x", "mid", "f", JOIN_KEY, (("g", "g"),)),
    ]
    got = told(spark, tables, edges, "mart", "x", "1", "3")
    assert got == [("mid", "f", "10", 0.85, "source", 1), ("mid", "f", "11", 0.85, "source", 1), ("mid", "f", "13", 0.8, "source", 1)]


def test_no_rows_and_missing_columns(spark, tables):
    edges = [CarryEdge("mart", "x", "mid", "f", AGG, (("g", "g"),))]
    assert told(spark, tables, edges, "mart", "x") == []
    with pytest.raises(ValueError):
        told(spark, tables, [CarryEdge("mart", "x", "mid", "f", AGG)], "mart", "x", "1")
