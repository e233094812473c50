"""Exact statistics that never hold a whole group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdure.operators.ordered import BLOCK_ROWS, MAX_SERIES_ROWS, cumulative


def _label(p: float) -> str:
    return "q" + f"{p * 100:g}".replace(".", "_")


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: Sequence[float],
    by: Sequence[str] = (),
    names: Sequence[str] | None = None,
    max_rows: int = MAX_SERIES_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per group.

    Built-in ``percentile`` keeps every distinct value of a group in one task. Here equal values
    are counted first, running counts give their ranks, and the rows at the wanted ranks are picked.
    Groups with very many distinct values are ranked in pieces.
    """
    names = list(names or [_label(p) for p in probs])
    by = list(by)
    present = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"))
    distinct = present.groupBy(*by).agg(F.approx_count_distinct("_v", 0.05).alias("_d"))
    largest, overall = distinct.agg(F.max("_d"), F.sum("_d")).first()
    counts = present.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_n"))
    long = largest is not None and largest * 1.2 > max_rows
    ranks = cumulative(counts, by, ["_v"], "_n", "_upto", "_size", int(overall * 1.2) if long else None, block_rows)
    picks, out = [], []
    for p, name in zip(probs, names):
        # Exact positions: p is a fraction of small integers for every quantile used here.
        at = (F.col("_size") - 1) * F.lit(float(p))
        for part, position in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            hit = (F.col("_upto") - F.col("_n") <= position) & (position < F.col("_upto"))
            picks.append(F.max(F.when(hit, F.col("_v"))).alias(f"_{part}_{name}"))
        picks.append(F.max(at - F.floor(at)).alias(f"_f_{name}"))
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((low + (high - low) * F.col(f"_f_{name}")).alias(name))
    return ranks.groupBy(*by).agg(*picks).select(*by, *out)


def value_range(df: DataFrame, value: str) -> Column:
    """Least and greatest value as one scalar subquery with fields ``lo`` and ``hi``."""
    return df.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi")).alias("ends")).scalar()


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Counts over equal-width bins between the least and greatest value; the last bin is closed."""
    present = df.where(F.col(value).isNotNull()).select(F.col(value).alias("_v"), value_range(df, value).alias("_e"))
    placed = present.select("_v", "_e.*")
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    raw = F.floor(F.try_divide(F.col("_v") - F.col("lo"), width)).cast("int") + 1
    return (
        placed.withColumn("bin", F.least(F.coalesce(raw, F.lit(1)), F.lit(bins)))
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"), F.max(F.col("lo") + (F.col("bin") - 1) * width).alias("bin_start"))
    )


def equal_width_cut(df: DataFrame, value: str, bins: int, out: str = "bin") -> DataFrame:
    """Right-closed equal-width bin number 1..bins; the lowest edge also takes the least value.

    Adds ``<out>_mid``, the midpoint of the bin, whose lowest edge is moved down by 0.1 % of the span.
    """
    placed = df.withColumn("_e", value_range(df, value)).select(
        *df.columns, F.col("_e.lo").alias("_lo"), F.col("_e.hi").alias("_hi")
    )
    width = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    number = F.greatest(F.lit(1), F.ceil(F.try_divide(F.col(value) - F.col("_lo"), width)).cast("int"))
    number = F.when(F.col(value).isNotNull(), F.least(number, F.lit(bins)))
    lowest = F.when(number == 1, (F.col("_hi") - F.col("_lo")) * F.lit(0.001)).otherwise(F.lit(0.0))
    left = F.col("_lo") + (number - 1) * width - lowest
    right = F.col("_lo") + number * width
    return placed.select(*df.columns, number.alias(out), ((left + right) / 2).alias(f"{out}_mid"))


def top_k(df: DataFrame, score: str, k: int, tie: str, ascending: bool = False) -> DataFrame:
    """First ``k`` rows by score, ties by ``tie``; Spark keeps k rows per task and merges them."""
    order = F.col(score).asc_nulls_last() if ascending else F.col(score).desc_nulls_last()
    return df.orderBy(order, F.col(tie).asc()).limit(k)
