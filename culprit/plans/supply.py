"""A second project: order lines, orders and suppliers, each staged as it comes.

The same names as in `retail`, so that the suite takes either.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from culprit.operators.datatests import DataTest
from culprit.operators.lineage import edge_frame
from culprit.plans.retail import SUPPLY_TARGETS
from culprit.schemas import NODE
from culprit.sources.constants import constant_frame

DATASET = "supply"
TARGETS = SUPPLY_TARGETS

COLUMNS = {
    "lineitem": ("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag"),
    "orders": ("o_orderkey", "o_custkey"),
    "supplier": ("s_suppkey", "s_nationkey"),
}

TESTS = (
    DataTest("not_null", "stg_lineitem", "l_partkey"),
    DataTest("not_null", "stg_lineitem", "l_suppkey"),
    DataTest("relationships", "stg_lineitem", "l_suppkey", "stg_supplier", "s_suppkey"),
    DataTest("unique", "stg_orders", "o_orderkey"),
    DataTest("not_null", "stg_orders", "o_orderkey"),
    DataTest("unique", "stg_supplier", "s_suppkey"),
    DataTest("not_null", "stg_supplier", "s_suppkey"),
)

# Lines are named by their order, as the target set has it.
PK_MAP = {
    "lineitem": "l_orderkey",
    "stg_lineitem": "l_orderkey",
    "orders": "o_orderkey",
    "stg_orders": "o_orderkey",
    "supplier": "s_suppkey",
    "stg_supplier": "s_suppkey",
}

STAGING_NAMES = tuple(f"stg_{t}" for t in COLUMNS)


def sources(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{folder}/{t}.parquet").select(*columns) for t, columns in COLUMNS.items()}


def staging(raw: Mapping[str, DataFrame], by: Sequence[str] = ()) -> dict[str, DataFrame]:
    return {
        f"stg_{t}": raw[t].select(*[c for c in by if c in raw[t].columns], *columns)
        for t, columns in COLUMNS.items()
        if t in raw
    }


def edges(spark: SparkSession) -> DataFrame:
    rows = [(f"stg_{t}", c, t, c, False, False, False) for t, columns in COLUMNS.items() for c in columns]
    return edge_frame(spark, rows)


def nodes(spark: SparkSession) -> DataFrame:
    rows = [(f"source.{DATASET}.{t}", t, "main", t, DATASET, "source") for t in COLUMNS]
    rows += [(f"model.{DATASET}.{n}", n, "main_staging", n, DATASET, "model") for n in STAGING_NAMES]
    return constant_frame(spark, rows, NODE)
