"""Training and test labels. A split is a label column or a cut, never a set of copied tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdure.functions import calendar
from verdure.operators.joins import lookup_join
from verdure.operators.ordered import null_safe, ranked, values_at
from verdure.session import materialize

SEED_TEXT = ""
# Hex digits of the hash used to narrow the cut down before rows are sorted.
_PREFIX = 5


def _attach(df: DataFrame, cuts: DataFrame, group: Sequence[str]) -> DataFrame:
    """``df`` with the cuts of its group, null being a group too; one row of cuts per group.

    The cuts are written first, so that Spark knows their size and broadcasts them where they are small.
    """
    cuts = materialize(cuts.withColumnsRenamed({g: f"_of_{g}" for g in group}), "cuts")
    if not group:
        return df.join(F.broadcast(cuts))  # one row
    return df.join(cuts, null_safe(df, cuts, [(g, f"_of_{g}") for g in group]))


def hash_of(*key: str, seed: str = SEED_TEXT) -> Column:
    """Reproducible 32-digit hash of a row key; a seed text gives a different draw."""
    parts = [F.col(k).cast("string") for k in key]
    if seed:
        parts.insert(0, F.lit(seed))
    return F.md5(F.concat_ws("|", *parts))


def random_split_hash(df: DataFrame, key: Sequence[str], train_percent: int = 80, seed: str = SEED_TEXT) -> DataFrame:
    """Row label ``split`` by key hash: sizes are approximate, nothing is shuffled."""
    bucket = F.pmod(F.conv(F.substring(hash_of(*key, seed=seed), 1, 8), 16, 10).cast("bigint"), F.lit(100))
    return df.withColumn("split", F.when(bucket < train_percent, "train").otherwise("test"))


def _hash_cut(df: DataFrame, keys: Sequence[str], wanted: Column) -> DataFrame:
    """Greatest hash among the ``wanted`` least hashes of each group, from column ``_hash``.

    Hashes are counted by their first digits, the running counts name the one prefix in which the
    cut lies, and only the rows of that prefix (about a millionth of the group) are put in order.
    Equal hashes are counted together, so copies of a key do not pile up in one task.
    """
    prefix = F.substring("_hash", 1, _PREFIX)
    counts = df.groupBy(*keys, prefix.alias("_prefix")).agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*keys)
    upto = group.orderBy("_prefix").rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.select("*", F.sum("_n").over(upto).alias("_upto"), F.sum("_n").over(group).alias("_size"))
    placed = placed.withColumn("_wanted", wanted)
    edge = placed.where((F.col("_upto") - F.col("_n") < F.col("_wanted")) & (F.col("_wanted") <= F.col("_upto")))
    edge = edge.select(*keys, "_prefix", (F.col("_wanted") - F.col("_upto") + F.col("_n")).alias("_rest"))
    edge = materialize(edge, "hash-edge")  # one row per group
    inside = df.withColumn("_prefix", prefix).join(edge, [*keys, "_prefix"])
    same = inside.groupBy(*keys, "_prefix", "_hash", "_rest").agg(F.count(F.lit(1)).alias("_n"))
    within = Window.partitionBy(*keys, "_prefix").orderBy("_hash").rowsBetween(Window.unboundedPreceding, 0)
    reached = same.withColumn("_upto", F.sum("_n").over(within)).where(F.col("_upto") >= F.col("_rest"))
    return reached.groupBy(*keys).agg(F.min("_hash").alias("_cut"))


def random_split_exact(
    df: DataFrame, key: Sequence[str], ratio: float = 0.8, seed: str = SEED_TEXT
) -> DataFrame:
    """Row label ``split`` with exactly ``int(n * ratio)`` training rows, drawn by key hash.

    The key must identify a row; rows sharing a key go to the same side.
    """
    hashed = df.withColumn("_hash", hash_of(*key, seed=seed))
    wanted = F.floor(F.col("_size") * F.lit(ratio)).cast("bigint")
    cut = _hash_cut(hashed.select("_hash"), [], wanted).agg(F.max("_cut").alias("_cut")).select("_cut").scalar()
    label = F.when(F.col("_hash") <= cut, "train").otherwise("test")
    return hashed.withColumn("split", label).drop("_hash")


def capped_sample(
    df: DataFrame,
    group: Sequence[str],
    key: Sequence[str],
    per_group: int = 50_000,
    overall: int | None = 500_000,
    seed: str = SEED_TEXT,
) -> DataFrame:
    """At most ``per_group`` rows of each group and ``overall`` rows in all, drawn by key hash. Null is a group too."""
    hashed = df.withColumn("_hash", hash_of(*key, seed=seed))
    # a struct as the one key: null columns in a struct match each other
    narrow = hashed.select(F.struct(*group).alias("_group"), "_hash") if group else hashed.select("_hash")
    on = ["_group"] if group else []
    cuts = _hash_cut(narrow, on, F.least(F.lit(per_group), F.col("_size")))
    kept = _attach(hashed, cuts.select("_cut", *[F.col(f"_group.{g}").alias(g) for g in group]), group)
    kept = kept.where(F.col("_hash") <= F.col("_cut")).select(*df.columns, "_hash")
    if overall is not None:
        kept = materialize(kept, "sample")  # already at most per_group rows of each group
        limit = F.least(F.lit(overall), F.col("_size"))
        cut = _hash_cut(kept.select("_hash"), [], limit).agg(F.max("_cut").alias("_cut")).select("_cut").scalar()
        kept = kept.where(F.col("_hash") <= cut)
    return kept.drop("_hash")


def _cuts(df: DataFrame, group: Sequence[str], order: Sequence[str], positions: dict, **size) -> DataFrame:
    """``values_at`` over a written index of group and order columns, so that the rows themselves are computed once
    for the index and once to be labelled, whatever looks for long groups and ranks them."""
    index = materialize(df.select(*group, *order), "split-index")
    return values_at(index, list(group), list(order), positions, **size)


def temporal_holdout(
    df: DataFrame, group: Sequence[str], order: Sequence[str], ratio: float = 0.8, **size
) -> DataFrame:
    """Row label ``split``: the first ``max(1, int(n * ratio))`` rows of each group train.

    Only the cut row of each group is searched; the rows themselves are labelled by comparison. Null is a group too.
    """
    at = {"_cut": lambda n: F.greatest(F.lit(1), F.floor(n * F.lit(ratio)).cast("bigint"))}
    cuts = _cuts(df, group, order, at, **size).drop("series_rows")
    joined = _attach(df, cuts, group)
    label = F.when(F.struct(*order) <= F.col("_cut"), "train").otherwise("test")
    return joined.select(*df.columns, label.alias("split"))


def temporal_blocks(
    df: DataFrame, group: Sequence[str], order: Sequence[str], folds: int = 5, **size
) -> DataFrame:
    """Row label ``block``: consecutive blocks of ``n // folds`` rows per group, numbered from 0.

    Fold f trains on blocks below f and tests on block f, so block 0 is never tested. Rows after the
    last full block get null, groups shorter than ``folds`` rows are left out. Null is a group too.
    """
    ends = {f"_end{f}": (lambda n, f=f: F.floor(n / folds) * (f + 1)) for f in range(folds)}
    cuts = _cuts(df, group, order, ends, **size).where(F.col("series_rows") >= folds)
    joined = _attach(df, cuts.drop("series_rows"), group)
    here = F.struct(*order)
    block = F.lit(None).cast("int")
    for f in reversed(range(folds)):
        block = F.when(here <= F.col(f"_end{f}"), f).otherwise(block)
    return joined.select(*df.columns, block.cast("int").alias("block"))


def fold_sizes(blocks: DataFrame, folds: int = 5) -> DataFrame:
    """Training and test rows of each fold that has both; block sizes are counted once."""
    sizes = blocks.where(F.col("block").isNotNull()).groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    # one row per fold
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = sizes.select(
        F.col("block").alias("fold"), F.sum("n").over(before).alias("train_rows"), F.col("n").alias("test_rows")
    )
    return placed.where(F.col("train_rows") > 0)


def fixed_test_blocks(
    df: DataFrame, group: Sequence[str], order: Sequence[str], folds: int = 5, share: float = 0.2, **size
) -> DataFrame:
    """Row label ``fold``: the last rows of each group in ``folds`` test sets of ``int(n * share)`` rows.

    Fold f (from 1) tests on its own rows and trains on all rows with a lower label; rows before the
    first test set have label 0. Groups too short for a test row are left out. Null is a group too.
    """

    def end(f: int):
        return lambda n: n - (folds - f) * F.floor(n * F.lit(share)).cast("bigint")

    cuts = _cuts(df, group, order, {f"_end{f}": end(f) for f in range(folds)}, **size)
    cuts = cuts.where(F.floor(F.col("series_rows") * F.lit(share)) > 0).drop("series_rows")
    joined = _attach(df, cuts, group)
    # an end before the first row has no order tuple and never holds
    fold = F.lit(folds)
    for f in reversed(range(folds)):
        fold = F.when(F.struct(*order) <= F.col(f"_end{f}"), f).otherwise(fold)
    return joined.select(*df.columns, fold.cast("int").alias("fold"))


def supported_sites(df: DataFrame, site: str = "site", min_rows: int = 100, max_sites: int | None = None) -> DataFrame:
    """Sites with at least ``min_rows`` rows and their row counts; with ``max_sites`` the first by name.

    As many sites as asked for are taken by name first, and the small ones are dropped from those.
    """
    counts = df.groupBy(site).agg(F.count(F.lit(1)).alias("n"))
    if max_sites is not None:
        counts = counts.orderBy(site).limit(max_sites)
    return counts.where(F.col("n") >= min_rows)


def leave_one_site_out(
    df: DataFrame, site: str = "site", min_rows: int = 100, max_sites: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Rows of the supported sites, and one row per fold with its held-out site and sizes.

    The fold of a row is its site: a fold tests on the rows of one site and trains on the others, so
    the rows are kept once however many folds there are.
    """
    sites = materialize(supported_sites(df, site, min_rows, max_sites), "sites")
    rows = lookup_join(df, sites.select(site), [site], "left_semi")
    total = sites.agg(F.sum("n").alias("t")).select("t").scalar()
    folds = sites.select(F.col(site).alias("test_site"), (total - F.col("n")).alias("train_rows"), F.col("n").alias("test_rows"))
    return rows, folds


def site_groups(sites: DataFrame, site: str, groups: int) -> DataFrame:
    """Adds ``fold`` from 1: sites by name are dealt out to ``groups`` folds, each alone if there are no more than that."""
    placed = ranked(sites, [], [site], "_rn")
    return placed.withColumn("fold", (F.pmod(F.col("_rn") - 1, F.lit(groups)) + 1).cast("int")).drop("_rn")


def rolling_origin(
    df: DataFrame, ts: str, train_days: int = 30, test_days: int = 7, windows: int = 12
) -> DataFrame:
    """Row labels ``window`` (from 1) and ``part`` for windows moving over the whole time range.

    Windows start ``max((days - train - test) // (windows - 1), train + test)`` days apart, so they
    never overlap and the window of a row follows from its time alone. A window whose test range
    would end after the last time is not used; rows between windows are left out.
    """
    day = 86_400_000_000
    span = train_days + test_days
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    ends = df.agg(F.min(ts).alias("lo"), F.max(ts).alias("hi")).select(
        micros("lo").alias("lo"), (micros("hi") - micros("lo")).alias("length")
    )
    days = F.floor(F.col("length") / F.lit(day))
    gap = F.floor((days - span) / F.lit(windows - 1)) if windows > 1 else F.lit(0)
    spacing = (F.greatest(gap, F.lit(span)) * F.lit(day)).cast("bigint")
    # the layout of the windows is one small row, found by a subquery
    fitting = F.when(days <= span, 0).otherwise(F.least(F.floor((F.col("length") - span * day) / spacing) + 1, F.lit(windows)))
    layout = ends.select(F.struct("lo", spacing.alias("spacing"), fitting.cast("bigint").alias("windows")).alias("s"))
    placed = df.withColumn("_s", layout.scalar()).withColumn("_since", micros(ts) - F.col("_s.lo"))
    offset = F.pmod(F.col("_since"), F.col("_s.spacing"))
    index = ((F.col("_since") - offset) / F.col("_s.spacing")).cast("bigint")
    return placed.where((index < F.col("_s.windows")) & (offset < span * day)).select(
        *df.columns,
        (index + 1).cast("int").alias("window"),
        F.when(offset < train_days * day, "train").otherwise("test").alias("part"),
    )


def window_profile(
    labelled: DataFrame, ts: str, min_train: int = 100, min_test: int = 10
) -> DataFrame:
    """One row per window: sizes, most frequent season and month of both parts, season change.

    Rows are counted by window, part and month first; the mode is the smallest of equally frequent
    values. Windows with too few rows are left out.
    """
    counts = labelled.groupBy("window", "part", F.month(ts).alias("month")).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("season", calendar.season(F.col("month")))
    seasons = counts.groupBy("window", "part", "season").agg(F.sum("n").alias("n"))

    def mode(source: DataFrame, column: str) -> DataFrame:
        score = F.struct(F.col("n"), -F.col(column))
        picks = [
            F.max_by(F.when(F.col("part") == part, F.col(column)), F.when(F.col("part") == part, score)).alias(
                f"{part}_{column}"
            )
            for part in ("train", "test")
        ]
        return source.groupBy("window").agg(
            *picks,
            *[F.coalesce(F.sum(F.when(F.col("part") == p, F.col("n"))), F.lit(0)).alias(f"{p}_rows_{column}") for p in ("train", "test")],
        )

    by_season, by_month = mode(seasons, "season"), mode(counts, "month")
    joined = by_season.join(by_month, "window")
    enough = (F.col("train_rows_month") >= min_train) & (F.col("test_rows_month") >= min_test)
    return joined.where(enough).select(
        "window",
        F.col("train_rows_month").alias("train_rows"),
        F.col("test_rows_month").alias("test_rows"),
        "train_season",
        "test_season",
        "train_month",
        "test_month",
        (F.col("train_season") != F.col("test_season")).alias("is_seasonal_transition"),
    )


def season_coverage(profile: DataFrame) -> DataFrame:
    """Windows per test season and how many of them change season."""
    return profile.groupBy("test_season").agg(
        F.count(F.lit(1)).alias("windows"),
        F.count_if("is_seasonal_transition").alias("transitions"),
    )
