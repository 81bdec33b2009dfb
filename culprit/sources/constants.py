"""Small metadata as DataFrames that Spark knows the size of."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_SIMPLE = {
    T.StringType: pa.string(),
    T.IntegerType: pa.int32(),
    T.LongType: pa.int64(),
    T.DoubleType: pa.float64(),
    T.BooleanType: pa.bool_(),
}


def _arrow(dtype: T.DataType) -> pa.DataType:
    if isinstance(dtype, T.ArrayType):
        return pa.list_(_arrow(dtype.elementType))
    if isinstance(dtype, T.StructType):
        return pa.struct([(f.name, _arrow(f.dataType)) for f in dtype])
    return _SIMPLE[type(dtype)]


def constant_frame(spark: SparkSession, rows: Sequence[tuple], schema: T.StructType) -> DataFrame:
    """Rows as a local relation.

    Unlike a frame from a list of tuples it carries its size, so the planner sees that
    it may be broadcast, and it needs no Python worker.
    """
    columns = list(zip(*rows)) or [()] * len(schema.fields)
    arrays = [
        pa.array(list(column), type=_arrow(f.dataType))
        for f, column in zip(schema.fields, columns)
    ]
    table = pa.Table.from_arrays(arrays, names=schema.names)
    return spark.createDataFrame(table, schema)
