"""Readers that give the warehouse tables as DataFrames."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def seed_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A seed file with a given schema; inferring one would read the file twice."""
    return spark.read.schema(schema).csv(path, header=True, mode="FAILFAST")


def jdbc_table(
    spark: SparkSession,
    url: str,
    table: str,
    *,
    partition_column: str,
    lower: int,
    upper: int,
    partitions: int,
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """A database table in parallel slices of a numeric or date column."""
    reader = spark.read.format("jdbc").options(
        url=url,
        dbtable=table,
        partitionColumn=partition_column,
        lowerBound=str(lower),
        upperBound=str(upper),
        numPartitions=str(partitions),
    )
    return reader.options(**(options or {})).load()


def materialise(df: DataFrame, layer: str, name: str) -> None:
    """Staging models are views, marts are tables."""
    if layer == "staging":
        df.createOrReplaceTempView(name)
    else:
        df.write.mode("overwrite").saveAsTable(name)
