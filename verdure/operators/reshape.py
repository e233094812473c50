"""Wide to long, long to wide, and nested to flat."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdure.operators.joins import lookup_join, spread_join


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str] | None, name: str, value: str) -> DataFrame:
    """One row per id and value column; nulls stay. All other columns are melted by default."""
    columns = list(values) if values is not None else [c for c in df.columns if c not in ids]
    return df.unpivot(list(ids), columns, name, value)


def keep_valid_series(long: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Rows of series that hold at least one number anywhere."""
    good = long.where(F.col(value).try_cast("double").isNotNull()).select(*keys).distinct()
    return lookup_join(long, good, keys, "left_semi", derived=True)


def valid_series(long: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Rows and numeric values per series, with the verdict whether the series is usable."""
    number = F.col(value).try_cast("double")
    return long.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(number).alias("n_values"),
        (F.count(number) > 0).alias("is_valid"),
    )


def join_drivers(flow: DataFrame, env: DataFrame, on: Sequence[str], target: str, **size) -> DataFrame:
    """Inner join of long flow readings with weather; rows without a target are dropped first."""
    return spread_join(flow.where(F.col(target).isNotNull()), env, on, "inner", **size)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of all frames matched by column name, absent columns null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def flatten(df: DataFrame, nested: str, keep: Sequence[str] = ()) -> DataFrame:
    """Fields of a struct column as columns of their own."""
    return df.select(*keep, f"{nested}.*")


def split_list(df: DataFrame, column: str, out: str = "members", separator: str = ",") -> DataFrame:
    """Comma-separated list as an array of trimmed texts with its first entry as ``primary``."""
    members = F.transform(F.split(column, separator), lambda x: F.trim(x))
    return df.withColumn(out, members).withColumn("primary", F.element_at(out, 1))


def pivot_mean(df: DataFrame, row: str, column: str, values: Sequence, value: str, prefix: str) -> DataFrame:
    """Mean of ``value`` with one output column per listed entry of ``column``."""
    picks = [F.avg(F.when(F.col(column) == v, F.col(value))).alias(f"{prefix}{v}") for v in values]
    return df.groupBy(row).agg(*picks)


def pivot_count(df: DataFrame, row: str, column: str, values: Sequence, prefix: str) -> DataFrame:
    """Row counts with one output column per listed entry, 0 where there are none, and their total."""
    picks = [F.count_if(F.col(column) == v).alias(f"{prefix}{v}") for v in values]
    return df.groupBy(row).agg(*picks, F.count(F.lit(1)).alias("total"))
