"""Type families, decided on Spark types rather than on type names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.CharType, T.VarcharType))


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_temporal(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType))


def first_temporal(schema: T.StructType) -> str | None:
    return next((f.name for f in schema if is_temporal(f.dataType)), None)


def norm_dtype(name: Column) -> Column:
    """STRING / INT / FLOAT / the upper-cased type name itself."""
    upper = F.upper(name)
    return (
        F.when(upper.rlike("CHAR|TEXT|STRING"), "STRING")
        .when(upper.rlike("INT|LONG"), "INT")
        .when(upper.rlike("FLOAT|DOUBLE|DECIMAL|NUMERIC"), "FLOAT")
        .otherwise(upper)
    )
