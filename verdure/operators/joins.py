"""Joins that hold up when a few keys own most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdure.operators.ordered import hot_keys, null_safe
from verdure.session import materialize

SALTS = 64
# Broadcast only tables counted to be at most this long and of at most so many bytes by their columns' widths.
MAX_BROADCAST_ROWS = 200_000
MAX_BROADCAST_BYTES = 64 << 20


def _bytes_of(column: Column, kind: T.DataType) -> Column:
    """About how many bytes a value takes; texts, lists and structs by what is in them."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 8
    if isinstance(kind, T.StructType):
        return sum((_bytes_of(column[f.name], f.dataType) for f in kind), F.lit(8))
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return F.coalesce(F.octet_length(F.to_json(column)), F.lit(0)) + 8
    return F.lit(8)


def is_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES) -> bool:
    """Whether ``df`` has few rows and few bytes. No more rows are looked at than may be broadcast."""
    width = sum((_bytes_of(F.col(f"`{f.name}`"), f.dataType) for f in df.schema), F.lit(0))
    size = df.select(width.alias("_w")).limit(max_rows + 1).agg(F.count(F.lit(1)).alias("n"), F.sum("_w").alias("w")).first()
    return size["n"] <= max_rows and (size["w"] or 0) <= max_bytes


def spread_join(
    facts: DataFrame,
    other: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    max_rows: int | None = None,
    salts: int = SALTS,
    count_from: DataFrame | None = None,
) -> DataFrame:
    """Equi-join of ``facts`` with ``other`` (inner, left, left_semi or left_anti).

    Large keys are left to the adaptive skew join, which finds them in the shuffle. Where that is not enough, as when
    the result must stay partitioned by the key, ``max_rows`` has keys with more fact rows counted and salted: their
    fact rows are dealt over ``salts`` tasks and the matching rows of ``other`` are repeated once per task.
    ``count_from`` is a cheaper table holding at least the rows of ``facts`` to find such keys in.
    """
    if how not in {"inner", "left", "left_semi", "left_anti"}:
        raise ValueError(f"unsupported join type {how}")
    if max_rows is None:
        return facts.join(other, list(on), how)
    hot, _rows = hot_keys(facts if count_from is None else count_from, on, max_rows)
    if hot is None:
        return facts.join(other, list(on), how)
    marked = F.broadcast(hot.withColumn("_is_hot", F.lit(True)))
    # null keys match nothing in the join itself, but there may be many of them to spread
    same = null_safe(facts, marked, [(k, f"_hot_{k}") for k in on])
    names = [f"_hot_{k}" for k in on]
    # the task number spreads equal rows; both parts are the same again when a task is rerun
    deal = F.pmod(F.xxhash64(*facts.columns) + F.spark_partition_id(), F.lit(salts)).cast("int")
    dealt = facts.withColumn("_deal", deal).join(marked, same, "left").drop(*names)
    dealt = dealt.withColumn("_salt", F.when(F.col("_is_hot"), F.col("_deal")).otherwise(0)).drop("_deal", "_is_hot")
    every = F.sequence(F.lit(0), F.lit(salts - 1))
    again = null_safe(other, marked, [(k, f"_hot_{k}") for k in on])
    repeated = other.join(marked, again, "left").drop(*names).withColumn(
        "_salt", F.explode(F.when(F.col("_is_hot"), every).otherwise(F.array(F.lit(0))))
    )
    return dealt.join(repeated.drop("_is_hot"), [*on, "_salt"], how).drop("_salt")


def lookup_join(
    facts: DataFrame,
    table: DataFrame,
    on: Sequence[str],
    how: str = "left",
    derived: bool = False,
    max_broadcast: int = MAX_BROADCAST_ROWS,
    max_rows: int | None = None,
) -> DataFrame:
    """Join with a lookup table: broadcast when it is counted to be small, else a spread join.

    A ``derived`` table comes out of an aggregation over large data; it is written once, so that
    counting it and joining it do not repeat that work.
    """
    if derived:
        table = materialize(table, "lookup")
    if is_small(table, max_broadcast):
        return facts.join(F.broadcast(table), list(on), how)
    return spread_join(facts, table, on, how, max_rows)
