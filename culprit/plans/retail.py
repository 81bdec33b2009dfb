"""A two-layer retail project: sources, staging models, marts, tests and lineage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from culprit.operators.carry import AGG, CAST, DIRECT, JOIN_KEY, WINDOW, CarryEdge
from culprit.operators.datatests import DataTest
from culprit.operators.faults import DROPOUT, DUPES, NULLS, FaultTarget
from culprit.operators.lineage import KeyedEdge, edge_frame
from culprit.schemas import NODE
from culprit.sources.constants import constant_frame

DATASET = "retail"
CENTS = 100.0


def sources(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Raw tables with the columns the project uses; everything else is never read."""
    read = spark.read.parquet
    return {
        "raw_customers": read(f"{folder}/customer.parquet").select("c_custkey", "c_name"),
        "raw_orders": read(f"{folder}/orders.parquet").select(
            "o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus"
        ),
        "raw_payments": read(f"{folder}/lineitem.parquet").select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("payment_key"),
            "l_orderkey",
            "l_returnflag",
            "l_extendedprice",
        ),
    }


def stg_customers(raw: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return raw.select(
        *[c for c in by if c in raw.columns],
        F.col("c_custkey").alias("customer_id"),
        F.col("c_name").alias("customer_name"),
    )


def stg_orders(raw: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return raw.select(
        *[c for c in by if c in raw.columns],
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderdate").alias("order_date"),
        F.col("o_orderstatus").alias("status"),
    )


def stg_payments(raw: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return raw.select(
        *[c for c in by if c in raw.columns],
        F.col("payment_key").alias("payment_id"),
        F.col("l_orderkey").alias("order_id"),
        F.col("l_returnflag").alias("payment_method"),
        (F.col("l_extendedprice") / CENTS).alias("amount"),
    )


def mart_orders(orders: DataFrame, payments: DataFrame) -> DataFrame:
    paid = payments.groupBy("order_id").agg(F.sum("amount").alias("amount"))
    joined = orders.join(paid, "order_id", "left")
    return joined.select(
        "order_id",
        "customer_id",
        "order_date",
        "status",
        F.coalesce("amount", F.lit(0.0)).alias("amount"),
    )


def mart_customers(customers: DataFrame, orders: DataFrame) -> DataFrame:
    history = orders.groupBy("customer_id").agg(
        F.min("order_date").alias("first_order"),
        F.max("order_date").alias("most_recent_order"),
        F.count("order_id").alias("number_of_orders"),
        F.sum("amount").alias("customer_lifetime_value"),
    )
    joined = customers.join(history, "customer_id", "left")
    return joined.select(
        "customer_id",
        "customer_name",
        "first_order",
        "most_recent_order",
        F.coalesce("number_of_orders", F.lit(0)).alias("number_of_orders"),
        F.coalesce("customer_lifetime_value", F.lit(0.0)).alias("customer_lifetime_value"),
    )


def order_ranks(orders: DataFrame) -> DataFrame:
    """Each customer's orders in the order of their dates."""
    by_date = Window.partitionBy("customer_id").orderBy("order_date", "order_id")
    return orders.select("order_id", "customer_id", F.row_number().over(by_date).alias("order_rank"))


def staging(raw: Mapping[str, DataFrame], by: Sequence[str] = ()) -> dict[str, DataFrame]:
    builders = {
        "stg_customers": (stg_customers, "raw_customers"),
        "stg_orders": (stg_orders, "raw_orders"),
        "stg_payments": (stg_payments, "raw_payments"),
    }
    return {name: build(raw[src], by) for name, (build, src) in builders.items() if src in raw}


def models(raw: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """All five models, lazily: a test that needs no payments plans no join with them."""
    out = staging(raw)
    out["orders"] = mart_orders(out["stg_orders"], out["stg_payments"])
    out["customers"] = mart_customers(out["stg_customers"], out["orders"])
    return out


TESTS = (
    DataTest("unique", "stg_customers", "customer_id"),
    DataTest("not_null", "stg_customers", "customer_id"),
    DataTest("unique", "stg_orders", "order_id"),
    DataTest("not_null", "stg_orders", "order_id"),
    DataTest("not_null", "stg_orders", "customer_id"),
    DataTest("relationships", "stg_orders", "customer_id", "stg_customers", "customer_id"),
    DataTest("accepted_values", "stg_orders", "status", accepted=("F", "O")),
    DataTest("unique", "stg_payments", "payment_id"),
    DataTest("not_null", "stg_payments", "payment_id"),
    DataTest("not_null", "stg_payments", "order_id"),
    DataTest("relationships", "stg_payments", "order_id", "stg_orders", "order_id"),
    DataTest("accepted_values", "stg_payments", "payment_method", accepted=("A", "N", "R")),
    DataTest("unique", "orders", "order_id"),
    DataTest("not_null", "orders", "order_id"),
    DataTest("not_null", "orders", "customer_id"),
    DataTest("relationships", "orders", "customer_id", "customers", "customer_id"),
    DataTest("not_null", "orders", "amount"),
    DataTest("unique", "customers", "customer_id"),
    DataTest("not_null", "customers", "customer_id"),
    DataTest("not_null", "customers", "number_of_orders"),
)

PK_MAP = {
    "stg_customers": "customer_id",
    "stg_orders": "order_id",
    "stg_payments": "payment_id",
    "customers": "customer_id",
    "orders": "order_id",
    "order_ranks": "order_id",
    "raw_customers": "c_custkey",
    "raw_orders": "o_orderkey",
    "raw_payments": "payment_key",
}

# downstream model, column, upstream model, column, aggregates, windows, casts
EDGES = (
    ("stg_customers", "customer_id", "raw_customers", "c_custkey", False, False, False),
    ("stg_customers", "customer_name", "raw_customers", "c_name", False, False, False),
    ("stg_orders", "order_id", "raw_orders", "o_orderkey", False, False, False),
    ("stg_orders", "customer_id", "raw_orders", "o_custkey", False, False, False),
    ("stg_orders", "order_date", "raw_orders", "o_orderdate", False, False, False),
    ("stg_orders", "status", "raw_orders", "o_orderstatus", False, False, False),
    ("stg_payments", "payment_id", "raw_payments", "payment_key", False, False, False),
    ("stg_payments", "order_id", "raw_payments", "l_orderkey", False, False, False),
    ("stg_payments", "payment_method", "raw_payments", "l_returnflag", False, False, False),
    ("stg_payments", "amount", "raw_payments", "l_extendedprice", False, False, False),
    ("orders", "order_id", "stg_orders", "order_id", False, False, False),
    ("orders", "customer_id", "stg_orders", "customer_id", False, False, False),
    ("orders", "order_date", "stg_orders", "order_date", False, False, False),
    ("orders", "status", "stg_orders", "status", False, False, False),
    ("orders", "amount", "stg_payments", "amount", True, False, False),
    ("customers", "customer_id", "stg_customers", "customer_id", False, False, False),
    ("customers", "customer_name", "stg_customers", "customer_name", False, False, False),
    ("customers", "first_order", "orders", "order_date", True, False, False),
    ("customers", "most_recent_order", "orders", "order_date", True, False, False),
    ("customers", "number_of_orders", "orders", "order_id", True, False, False),
    ("customers", "customer_lifetime_value", "orders", "amount", True, False, False),
)

KEYED_EDGES = tuple(
    KeyedEdge(down, column, up, up_column, PK_MAP[down], PK_MAP[up])
    for down, column, up, up_column, agg, _, _ in EDGES
    if not agg
)

# The same lineage with the columns that joins, groups and windows match rows with.
CARRY_EDGES = tuple(
    CarryEdge(down, column, up, up_column, CAST if cast else DIRECT)
    for down, column, up, up_column, agg, _, cast in EDGES
    if not agg
) + (
    CarryEdge("orders", "amount", "stg_payments", "amount", AGG, (("order_id", "order_id"),)),
    CarryEdge("customers", "first_order", "orders", "order_date", AGG, (("customer_id", "customer_id"),)),
    CarryEdge("customers", "most_recent_order", "orders", "order_date", AGG, (("customer_id", "customer_id"),)),
    CarryEdge("customers", "number_of_orders", "orders", "order_id", AGG, (("customer_id", "customer_id"),)),
    CarryEdge("customers", "customer_lifetime_value", "orders", "amount", AGG, (("customer_id", "customer_id"),)),
    CarryEdge("orders", "customer_id", "stg_customers", "customer_id", JOIN_KEY, (("customer_id", "customer_id"),)),
    CarryEdge("order_ranks", "order_rank", "stg_orders", "order_date", WINDOW, (("customer_id", "customer_id"),)),
)

SOURCE_NAMES = ("raw_customers", "raw_orders", "raw_payments")
STAGING_NAMES = ("stg_customers", "stg_orders", "stg_payments")
MART_NAMES = ("orders", "customers")


def edges(spark: SparkSession) -> DataFrame:
    return edge_frame(spark, EDGES)


def nodes(spark: SparkSession) -> DataFrame:
    rows = [(f"seed.{DATASET}.{n}", n, "main", n, DATASET, "seed") for n in SOURCE_NAMES]
    layers = (("main_staging", STAGING_NAMES), ("main_marts", MART_NAMES))
    rows += [
        (f"model.{DATASET}.{n}", n, schema, n, DATASET, "model")
        for schema, names in layers
        for n in names
    ]
    return constant_frame(spark, rows, NODE)


TARGETS = {
    NULLS: FaultTarget(
        "raw_orders", "o_custkey", "o_orderkey", "not_null_stg_orders_customer_id",
        condition="o_orderstatus = 'P'",
    ),
    DUPES: FaultTarget(
        "raw_orders", "o_orderkey", "o_orderkey", "unique_stg_orders_order_id"
    ),
    DROPOUT: FaultTarget(
        "raw_customers", "c_custkey", "c_custkey", "relationships_stg_orders_customer_id",
        child_table="raw_orders", child_fk="o_custkey", child_pk="o_orderkey",
    ),
}

# Fixed values, the second published target set: parts nulled, orders repeated, suppliers
# deleted.
SUPPLY_TARGETS = {
    NULLS: FaultTarget(
        "lineitem", "l_partkey", "l_orderkey", "not_null_stg_lineitem_l_partkey",
        condition="l_returnflag = 'R'",
    ),
    DUPES: FaultTarget("orders", "o_orderkey", "o_orderkey", "unique_stg_orders_o_orderkey"),
    DROPOUT: FaultTarget(
        "supplier", "s_suppkey", "s_suppkey", "relationships_stg_lineitem_l_suppkey",
        child_table="lineitem", child_fk="l_suppkey", child_pk="l_orderkey",
    ),
}
