"""Quality flags: filtering readings by them and auditing how often they occur.

Flag tables are long: one row per site, time and data column, the flag null for a cell without one.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdure.functions.codes import BAD_FLAGS
from verdure.operators.joins import lookup_join, spread_join
from verdure.operators.ordered import MAX_SERIES_ROWS, cumulative
from verdure.operators.stats import exact_quantiles, top_k
from verdure.session import materialize


def is_bad(flag: Column, bad: Sequence[str] = BAD_FLAGS) -> Column:
    return F.coalesce(flag.isin(*bad), F.lit(False))


def any_bad(flag_columns: Sequence[str], bad: Sequence[str] = BAD_FLAGS) -> Column:
    """Whether any column of a wide flag row holds a bad flag."""
    return reduce(lambda a, b: a | b, [is_bad(F.col(c), bad) for c in flag_columns])


def drop_flagged_rows(
    data: DataFrame,
    flags: DataFrame,
    on: Sequence[str] = ("site", "ts"),
    flag: str = "flag",
    bad: Sequence[str] = BAD_FLAGS,
    require_flags: bool = False,
    **size,
) -> DataFrame:
    """Drops every reading whose key carries a bad flag in any column.

    ``require_flags`` also drops readings without a flag row, as an inner join with the flags does.
    """
    flagged = flags.where(is_bad(F.col(flag), bad)).select(*on).distinct()
    kept = spread_join(data, flagged, on, "left_anti", **size)
    if require_flags:
        size.setdefault("count_from", data)
        kept = spread_join(kept, flags.select(*on).distinct(), on, "left_semi", **size)
    return kept


def drop_flagged_cells(
    data: DataFrame,
    flags: DataFrame,
    on: Sequence[str] = ("site", "ts", "col_name"),
    flag: str = "flag",
    bad: Sequence[str] = BAD_FLAGS,
    **size,
) -> DataFrame:
    """Drops only the long-format readings that are flagged themselves."""
    flagged = flags.where(is_bad(F.col(flag), bad)).select(*on).distinct()
    return spread_join(data, flagged, on, "left_anti", **size)


def _percent(part: Column, whole: Column) -> Column:
    """Share in percent, 0 where there is nothing to share."""
    return F.coalesce(F.try_divide(part * F.lit(100.0), whole), F.lit(0.0))


def _counts(flag: str, kind: str, bad: Sequence[str]) -> list[Column]:
    out = []
    for k in ("env", "sapf"):
        here = F.col(kind) == k
        out.append(F.count_if(here & is_bad(F.col(flag), bad)).alias(f"{k}_warn"))
        out.append(F.count_if(here & F.col(flag).isNotNull()).alias(f"{k}_total"))
    return out


def _with_shares(counts: DataFrame) -> DataFrame:
    warn, total = F.col("env_warn") + F.col("sapf_warn"), F.col("env_total") + F.col("sapf_total")
    return counts.select(
        "*",
        warn.alias("total_warn"),
        total.alias("total_data"),
        _percent(F.col("env_warn"), F.col("env_total")).alias("env_flag_percent"),
        _percent(F.col("sapf_warn"), F.col("sapf_total")).alias("sapf_flag_percent"),
        _percent(warn, total).alias("overall_flag_percent"),
    )


def site_audit(
    flags: DataFrame, site: str = "site", kind: str = "kind", flag: str = "flag", bad: Sequence[str] = BAD_FLAGS
) -> DataFrame:
    """Flag counts and shares per site; the share is of cells that carry any flag."""
    return _with_shares(flags.groupBy(site).agg(*_counts(flag, kind, bad)))


def site_rollup(
    flags: DataFrame, site: str = "site", kind: str = "kind", flag: str = "flag", bad: Sequence[str] = BAD_FLAGS
) -> DataFrame:
    """The audit with a grand-total row beside the site rows (``is_total`` = 1, site null)."""
    counts = flags.rollup(site).agg(F.grouping(site).cast("int").alias("is_total"), *_counts(flag, kind, bad))
    return _with_shares(counts)


def column_rate(
    flags: DataFrame, by: Sequence[str] = ("col_name",), flag: str = "flag", bad: Sequence[str] = BAD_FLAGS
) -> DataFrame:
    """Flag share per data column."""
    return (
        flags.groupBy(*by)
        .agg(F.count_if(is_bad(F.col(flag), bad)).alias("warn"), F.count(flag).alias("total"))
        .withColumn("flag_percent", _percent(F.col("warn"), F.col("total")))
    )


def site_presence(audit: DataFrame) -> DataFrame:
    """How many sites have flags at all."""
    n, have = F.count(F.lit(1)), F.count_if(F.col("total_warn") > 0)
    none = F.count_if(F.col("total_warn") == 0)
    return audit.agg(
        n.alias("sites"),
        have.alias("sites_with_flags"),
        none.alias("sites_without_flags"),
        _percent(have, n).alias("with_percent"),
        _percent(none, n).alias("without_percent"),
    )


# Names and upper limits of the flag-count tiers.
FLAG_TIERS = (("low", 1_000), ("medium", 10_000), ("high", 50_000))


def tiers(audit: DataFrame, limits: Sequence[tuple[str, int]] = FLAG_TIERS, above: str = "very_high") -> DataFrame:
    """Number of sites and flags per tier of flag counts."""
    tier = F.lit(above)
    for name, upper in reversed(list(limits)):
        tier = F.when(F.col("total_warn") <= upper, name).otherwise(tier)
    return audit.groupBy(tier.alias("tier")).agg(
        F.count(F.lit(1)).alias("sites"), F.sum("total_warn").alias("flags")
    )


def concentration(audit: DataFrame) -> DataFrame:
    """Mean, median, sample deviation and coefficient of variation of flags per site."""
    audit = materialize(audit.select("total_warn"), "audit")  # one row per site, read several times
    median = exact_quantiles(audit, "total_warn", [0.5], names=["median_flags"])
    mean, std = F.avg("total_warn"), F.stddev_samp("total_warn")
    return audit.agg(
        mean.alias("mean_flags"),
        std.alias("std_flags"),
        F.try_divide(std, mean).alias("variation"),
    ).withColumn("median_flags", median.select("median_flags").scalar())


def pareto(audit: DataFrame, shares: Sequence[int] = (50, 80, 90), site: str = "site") -> DataFrame:
    """Running share of flags over sites in falling order, and sites inside each given share."""
    sites = materialize(audit.select(site, "total_warn", (-F.col("total_warn")).alias("_falling")), "pareto")
    rows = sites.count()
    long = rows if rows > MAX_SERIES_ROWS else None
    placed = cumulative(sites, [], ["_falling", site], "total_warn", "_running", "_total", long)
    return placed.agg(
        F.count(F.lit(1)).alias("sites"),
        *[
            F.count_if(F.col("_running") <= F.col("_total") * F.lit(s / 100.0)).alias(f"sites_within_{s}pct")
            for s in shares
        ],
    )


def top_by_count(audit: DataFrame, k: int = 10, site: str = "site") -> DataFrame:
    return top_k(audit.select(site, "total_warn", "overall_flag_percent"), "total_warn", k, site)


def top_by_rate(audit: DataFrame, k: int = 10, more_than: int = 1000, site: str = "site") -> DataFrame:
    enough = audit.where(F.col("total_data") > more_than)
    return top_k(enough.select(site, "total_warn", "overall_flag_percent"), "overall_flag_percent", k, site)


def exclude_sites(
    df: DataFrame,
    tier_table: DataFrame,
    include: Sequence[str] = (),
    site: str = "site",
    tier: str = "tier",
    always: str = "no_data",
    excluded: Sequence[str] = ("extreme", "high"),
    warned: Sequence[str] = ("moderate",),
) -> DataFrame:
    """Keeps sites by quality tier and marks the ones to be used with care.

    Sites of tier ``always`` never pass; sites of the ``excluded`` tiers pass only if that tier is
    named in ``include``. A site listed in several tiers is dropped by any of them. ``quality_warning``
    is true for kept sites of a warned tier.
    """
    out = [always, *[t for t in excluded if t not in include]]
    per_site = tier_table.groupBy(site).agg(
        F.max(F.col(tier).isin(*out)).alias("_out"), F.max(F.col(tier).isin(*warned)).alias("_warned")
    )
    joined = lookup_join(df, per_site, [site], "left", derived=True)
    return joined.where(~F.coalesce("_out", F.lit(False))).select(
        *df.columns, F.coalesce("_warned", F.lit(False)).alias("quality_warning")
    )


def mean_above(value: str, limit: str) -> Column:
    """Whether the mean of a double column, an aggregate, lies above ``limit``, a decimal number as text.

    Values of up to six decimals are added as decimals, so that a mean at the limit is never above it, in whatever order
    the rows come. Groups with values that are no such decimals are judged by their mean in doubles.
    """
    exact = F.col(value).try_cast("decimal(24,6)")
    same = F.count_if(exact.cast("double") == F.col(value)) == F.count(value)
    return F.when(same, F.sum(exact) > F.lit(Decimal(limit)) * F.count(value)).otherwise(F.avg(value) > float(limit))


def tier_union(*tier_tables: DataFrame, site: str = "site") -> DataFrame:
    """Distinct sites listed in any of the tier tables."""
    return reduce(lambda a, b: a.union(b), [t.select(site) for t in tier_tables]).distinct()
