"""Value clean-up expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdure.functions.codes import SENTINELS

_FLOATS = (T.DoubleType, T.FloatType)


def finite(value: Column) -> Column:
    """Null for NaN and both infinities; Spark would carry them through every average."""
    return F.when(F.isnan(value) | (F.abs(value) == F.lit(float("inf"))), None).otherwise(value)


def no_sentinel(value: Column) -> Column:
    """Null for the texts that stand for a missing value."""
    return F.when(value.isin(*SENTINELS), None).otherwise(value)


def sanitize(df: DataFrame, *columns: str) -> DataFrame:
    """Applies the clean-up fitting the type of each column (all columns by default)."""
    changes = {}
    for field in df.schema:
        if columns and field.name not in columns:
            continue
        if isinstance(field.dataType, _FLOATS):
            changes[field.name] = finite(F.col(field.name))
        elif isinstance(field.dataType, T.StringType):
            changes[field.name] = no_sentinel(F.col(field.name))
    return df.withColumns(changes) if changes else df
