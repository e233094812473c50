"""Order-dependent operators that stay balanced when one series holds most of the rows.

A window partitioned by the series key puts a whole series into one task. That is the best plan
while every series fits a task, so it is used whenever the largest series is at most ``max_rows``.
Longer series take a second way, with the same result:

1. their rows are range-partitioned and sorted on (key, order), which cuts a long series into
   even pieces, and written once together with their position;
2. piece sizes (one row per piece and series) give each piece its offset;
3. windows run on blocks of consecutive positions, each preceded by a copy of the rows it needs
   to look back at.

The order columns must identify a row within its series; ties have no defined position.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdure.session import materialize

# Rows one task may sort for a single series; above this a series is cut into blocks.
MAX_SERIES_ROWS = 20_000_000
BLOCK_ROWS = 2_000_000
# Tasks of the range partitioning; beyond this many the pieces grow instead, and their sort spills.
MAX_PIECES = 20_000
# monotonically_increasing_id keeps the partition number above the low 33 bits.
_POSITION_BITS = 33


def null_safe(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]]) -> Column:
    return reduce(lambda a, b: a & b, [left[a].eqNullSafe(right[b]) for a, b in pairs])


def hot_keys(df: DataFrame, keys: Sequence[str], max_rows: int) -> tuple[DataFrame | None, int]:
    """Keys owning more than ``max_rows`` rows and the rows they own; ``(None, 0)`` if there are none.

    There are fewer than ``rows / max_rows`` such keys, so the returned table is safe to broadcast.
    Only the key columns are read and the count is combined map-side.
    """
    hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > max_rows)
    rows = hot.agg(F.sum("_rows")).first()[0]
    if not rows:
        return None, 0
    if not keys:
        return hot, rows
    return materialize(hot.select(*[F.col(k).alias(f"_hot_{k}") for k in keys]), "hot-keys"), rows


def split_hot(df: DataFrame, keys: Sequence[str], hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``df`` without and with only the rows of the hot keys."""
    on = null_safe(df, hot, [(k, f"_hot_{k}") for k in keys])
    small = F.broadcast(hot)
    return df.join(small, on, "left_anti"), df.join(small, on, "left_semi")


def _positions(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int, block_rows: int) -> DataFrame:
    """Rows sorted over (keys, order) with ``_pos`` rising along that order and ``_piece`` = its task."""
    pieces = min(max(2, math.ceil(rows / block_rows)), MAX_PIECES)
    # the source task is the last sort column, so that equal rows can still be cut apart
    by = [*keys, *order, "_source"]
    tagged = df.withColumn("_source", F.spark_partition_id())
    ranged = tagged.repartitionByRange(pieces, *by).sortWithinPartitions(*by)
    placed = ranged.drop("_source").withColumn("_pos", F.monotonically_increasing_id())
    return materialize(placed.withColumn("_piece", F.shiftright("_pos", _POSITION_BITS)), "positions")


def _rank_hot(df, keys, order, rows, block_rows, out, total):
    placed = _positions(df, keys, order, rows, block_rows)
    sizes = placed.groupBy(*keys, "_piece").agg(F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(
        *[F.col(k).alias(f"_off_{k}") for k in keys],
        F.col("_piece").alias("_off_piece"),
        "_first",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"),
        F.sum("_rows").over(Window.partitionBy(*keys)).alias("_total"),
    )
    # at most one row per piece and hot key, see hot_keys
    on = null_safe(placed, sizes, [*[(k, f"_off_{k}") for k in keys], ("_piece", "_off_piece")])
    joined = placed.join(F.broadcast(sizes), on)
    columns = [*df.columns, (F.col("_pos") - F.col("_first") + F.col("_before") + 1).cast("bigint").alias(out)]
    if total:
        columns.append(F.col("_total").cast("bigint").alias(total))
    return joined.select(*columns)


def _rank_plain(df, keys, order, out, total):
    ranked = df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint"))
    if total:
        ranked = ranked.withColumn(total, F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    return ranked


def ranked(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    out: str = "rn",
    total: str | None = None,
    max_rows: int = MAX_SERIES_ROWS,
    block_rows: int = BLOCK_ROWS,
    count_from: DataFrame | None = None,
) -> DataFrame:
    """Adds the 1-based position of each row in its series and, if named, the series length.

    ``count_from`` is a cheaper table holding at least the rows of ``df`` to find long series in.
    """
    hot, rows = hot_keys(df if count_from is None else count_from, keys, max_rows)
    if hot is None:
        return _rank_plain(df, keys, order, out, total)
    if not keys:
        return _rank_hot(df, keys, order, rows, block_rows, out, total)
    cold_rows, hot_rows = split_hot(df, keys, hot)
    return _rank_plain(cold_rows, keys, order, out, total).unionByName(
        _rank_hot(hot_rows, keys, order, rows, block_rows, out, total)
    )


class Over:
    """SQL text of a window over one series in order, optionally only its last rows.

    Feature tables have hundreds of window columns; as texts they reach Spark in a few calls.
    """

    def __init__(self, keys: Sequence[str], order: Sequence[str]):
        parts = ", ".join(f"`{k}`" for k in keys)
        self._body = (f"PARTITION BY {parts} " if keys else "") + "ORDER BY " + ", ".join(f"`{o}`" for o in order)

    def __str__(self) -> str:
        return f"OVER ({self._body})"

    def last(self, rows: int) -> str:
        return f"OVER ({self._body} ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)"


def windowed(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    apply: Callable[[DataFrame, Over], DataFrame],
    look_back: int,
    max_rows: int = MAX_SERIES_ROWS,
    block_rows: int = BLOCK_ROWS,
    count_from: DataFrame | None = None,
) -> DataFrame:
    """Adds columns with ``apply(rows, over)``, where ``over`` is the window of one series in order.

    ``apply`` may look at most ``look_back`` rows back and never ahead, and keeps all rows. Window
    columns it adds in several steps share one exchange and one sort. ``count_from`` is a cheaper
    table holding at least the rows of ``df`` to find long series in.
    """

    def plain(rows: DataFrame) -> DataFrame:
        return apply(rows, Over(keys, order))

    hot, n = hot_keys(df if count_from is None else count_from, keys, max_rows)
    if hot is None:
        return plain(df)
    cold_rows, hot_rows = split_hot(df, keys, hot)
    placed = _rank_hot(hot_rows, keys, order, n, block_rows, "_rank", None)
    size = max(block_rows, look_back, 1)
    offset = (F.col("_rank") - 1) % size
    placed = placed.withColumn("_own", ((F.col("_rank") - 1 - offset) / size).cast("bigint"))
    # the last rows of a block are also handed to the next block, where they are only looked at
    copies = F.when(offset >= size - look_back, F.array(F.col("_own"), F.col("_own") + 1)).otherwise(
        F.array(F.col("_own"))
    )
    copied = placed.withColumn("_block", F.explode(copies))
    done = apply(copied, Over([*keys, "_block"], ["_rank"])).where(F.col("_block") == F.col("_own"))
    return plain(cold_rows).unionByName(done.drop("_rank", "_own", "_block"))


def cumulative(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    out: str,
    total: str,
    rows: int | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Adds the running total of ``value`` in each series and its sum over the whole series.

    ``rows`` is the row count when some series is too long for one task, ``None`` when all fit.
    """
    upto = lambda spec: spec.rowsBetween(Window.unboundedPreceding, 0)
    if rows is None:
        series = Window.partitionBy(*keys)
        return df.select(
            "*",
            F.sum(value).over(upto(series.orderBy(*order))).alias(out),
            F.sum(value).over(series).alias(total),
        )
    placed = _positions(df, keys, order, rows, block_rows)
    sums = placed.groupBy(*keys, "_piece").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        *[F.col(k).alias(f"_off_{k}") for k in keys],
        F.col("_piece").alias("_off_piece"),
        F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"),
        F.sum("_sum").over(Window.partitionBy(*keys)).alias(total),
    )
    on = null_safe(placed, sums, [*[(k, f"_off_{k}") for k in keys], ("_piece", "_off_piece")])
    local = F.sum(value).over(upto(Window.partitionBy(*keys, "_piece").orderBy("_pos")))
    return placed.withColumn("_local", local).join(sums, on).select(
        *df.columns, (F.col("_local") + F.col("_before")).alias(out), total
    )


def values_at(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    positions: dict[str, Callable[[Column], Column]],
    max_rows: int = MAX_SERIES_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The order tuple found at given positions of each series, one row per series.

    ``positions`` maps a result name to a function of the series length giving a 1-based position.
    Only keys and order columns are sorted, so wide rows never move to be split by position.
    """
    narrow = df.select(*keys, *order)
    placed = ranked(narrow, keys, order, "_rn", "_n", max_rows, block_rows)
    point = F.struct(*order)
    picks = [
        F.max(F.when(F.col("_rn") == position(F.col("_n")), point)).alias(name)
        for name, position in positions.items()
    ]
    return placed.groupBy(*keys).agg(F.max("_n").alias("series_rows"), *picks)
