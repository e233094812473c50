"""Prediction metrics, fold roll-ups and simple reference forecasts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdure.operators.joins import lookup_join
from verdure.operators.stats import exact_quantiles, top_k

SCORES = ("rmse", "mae", "r2")


def _scores(actual: Column, predicted: Column, prefix: str = "") -> list[Column]:
    both = actual.isNotNull() & predicted.isNotNull()
    a = F.when(both, actual)
    error = predicted - actual
    n = F.count_if(both)
    spread = F.var_pop(a) * n
    return [
        F.sqrt(F.avg(error * error)).alias(f"{prefix}rmse"),
        F.avg(F.abs(error)).alias(f"{prefix}mae"),
        (F.lit(1.0) - F.try_divide(F.sum(error * error), spread)).alias(f"{prefix}r2"),
        n.alias(f"{prefix}samples"),
    ]


def metrics(
    df: DataFrame, by: Sequence[str] = (), actual: str = "actual", predicted: str = "predicted"
) -> DataFrame:
    """RMSE, MAE, R² and squared correlation of predictions, over all rows or per group."""
    a, p = F.col(actual), F.col(predicted)
    both = a.isNotNull() & p.isNotNull()
    # written out, since the built-in correlation fails on a constant column
    spread = F.var_pop(F.when(both, a)) * F.var_pop(F.when(both, p))
    squared = F.try_divide(F.pow(F.covar_pop(a, p), 2), spread)
    return df.groupBy(*by).agg(*_scores(a, p), squared.alias("corr_squared"))


def residuals(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    return df.withColumn("residual", F.col(predicted) - F.col(actual))


def fold_metrics(
    df: DataFrame, fold: str = "fold", part: str = "part", actual: str = "actual", predicted: str = "predicted"
) -> DataFrame:
    """One row per fold with the scores of its training and test rows side by side."""
    picks = []
    for name in ("train", "test"):
        here = F.col(part) == name
        picks += _scores(F.when(here, F.col(actual)), F.when(here, F.col(predicted)), f"{name}_")
    return df.groupBy(fold).agg(*picks)


def fold_rollup(folds: DataFrame) -> DataFrame:
    """Mean and population deviation of the six scores over folds."""
    columns = [f"{part}_{score}" for part in ("train", "test") for score in SCORES]
    picks = [F.count(F.lit(1)).alias("folds")]
    for c in columns:
        picks += [F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std")]
    return folds.agg(*picks)


def score_by(windows: DataFrame, group: str, score: str = "test_r2") -> DataFrame:
    """Mean, sample deviation and number of windows per season or transition mark."""
    return windows.groupBy(group).agg(
        F.avg(score).alias("mean_score"), F.stddev_samp(score).alias("std_score"), F.count(score).alias("windows")
    )


def best_fold(folds: DataFrame, fold: str = "fold", score: str = "test_r2") -> DataFrame:
    """Fold with the greatest score, the first of equals."""
    scored = folds.where(F.col(score).isNotNull())
    return scored.agg(
        F.max_by(fold, F.struct(F.col(score), -F.col(fold))).alias("best_fold"), F.max(score).alias("best_score")
    )


def best_and_worst(sites: DataFrame, k: int = 5, site: str = "site", score: str = "r2") -> DataFrame:
    """The k best and k worst sites; each side keeps k rows per task before merging."""
    scored = sites.where(F.col(score).isNotNull())
    best = top_k(scored, score, k, site).withColumn("side", F.lit("best"))
    worst = top_k(scored, score, k, site, ascending=True).withColumn("side", F.lit("worst"))
    return best.unionByName(worst)


def importance_rollup(importances: DataFrame, folds: int, k: int | None = None) -> DataFrame:
    """Mean importance per feature over all folds; a feature absent from a fold counts as 0 there."""
    mean = importances.groupBy("feature").agg((F.sum("importance") / F.lit(float(folds))).alias("importance"))
    return mean if k is None else top_k(mean, "importance", k, "feature")


def climatology(
    train: DataFrame, test: DataFrame, by: Sequence[str], target: str, out: str = "predicted"
) -> DataFrame:
    """Forecast by the training mean of the row's group, or the overall training mean if unseen."""
    means = train.groupBy(*by).agg(F.avg(target).alias("_mean"))
    overall = train.agg(F.avg(target).alias("m")).select("m").scalar()
    joined = lookup_join(test, means, by, "left", derived=True)
    return joined.withColumn(out, F.coalesce("_mean", overall)).drop("_mean")


def fold_climatology(
    blocks: DataFrame, by: Sequence[str], target: str, folds: int, block: str = "block"
) -> DataFrame:
    """Training and test predictions of every fold of an expanding split by group means.

    Group sums are taken once per block and added up along the folds. A row is repeated once per
    fold it takes part in, at most ``folds`` times.
    """
    used = blocks.where(F.col(block).isNotNull())
    per_block = used.groupBy(*by, block).agg(F.sum(target).alias("_s"), F.count(target).alias("_n"))
    later = F.explode(F.sequence(F.col(block) + 1, F.lit(folds)))  # the last entry is no fold
    means = (
        per_block.withColumn("fold", later)
        .where(F.col("fold") < folds)
        .groupBy(*by, "fold")
        .agg(F.try_divide(F.sum("_s"), F.sum("_n")).alias("predicted"))
    )
    rows = used.withColumn("fold", F.explode(F.sequence(F.col(block), F.lit(folds - 1)))).where(F.col("fold") > 0)
    part = F.when(F.col(block) == F.col("fold"), "test").otherwise("train")
    return lookup_join(rows.withColumn("part", part), means, [*by, "fold"], "inner", derived=True)


def left_out_climatology(df: DataFrame, site: str, by: Sequence[str], target: str) -> DataFrame:
    """Forecast of every row by the group mean over all other sites.

    The mean without a site is the group total less the site's own share, so no row is repeated.
    """
    own = df.groupBy(*by, site).agg(F.sum(target).alias("_s"), F.count(target).alias("_n"))
    every = own.groupBy(*by).agg(F.sum("_s").alias("_all_s"), F.sum("_n").alias("_all_n"))
    others = own.join(every, list(by)).select(
        *by, site, F.try_divide(F.col("_all_s") - F.col("_s"), F.col("_all_n") - F.col("_n")).alias("predicted")
    )
    return lookup_join(df, others, [*by, site], "inner", derived=True)


def blend(
    df: DataFrame,
    overall: str,
    local: str,
    rows: str,
    more_than: int = 1000,
    local_weight: float = 0.7,
    out: str = "predicted",
) -> DataFrame:
    """Weighted mix of an overall and a per-site prediction for sites with enough training rows."""
    mixed = F.col(local) * F.lit(local_weight) + F.col(overall) * F.lit(1.0 - local_weight)
    enough = (F.col(rows) > more_than) & F.col(local).isNotNull()
    return df.withColumn(out, F.when(enough, mixed).otherwise(F.col(overall)))


def prediction_intervals(
    train: DataFrame,
    test: DataFrame,
    by: Sequence[str],
    low: float = 0.05,
    high: float = 0.95,
    actual: str = "actual",
    predicted: str = "predicted",
) -> DataFrame:
    """Test rows with an interval around the prediction from the training residuals of their group."""
    spread = residuals(train, predicted, actual).withColumnRenamed("residual", "_r")
    edges = exact_quantiles(spread, "_r", [low, high], by=by, names=["_low", "_high"])
    joined = lookup_join(test, edges, list(by), "inner", derived=True)
    lower, upper = F.col(predicted) + F.col("_low"), F.col(predicted) + F.col("_high")
    return joined.select(
        *test.columns,
        lower.alias("lower"),
        upper.alias("upper"),
        F.col(actual).between(lower, upper).alias("in_interval"),
    )


def interval_coverage(intervals: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return intervals.groupBy(*by).agg(
        F.count("in_interval").alias("n"),
        F.avg(F.col("in_interval").cast("double")).alias("coverage"),
        F.avg(F.col("upper") - F.col("lower")).alias("mean_width"),
    )


# Limits of the traffic light and of the deployment rule.
GREEN, YELLOW, SPATIAL = 0.70, 0.50, 0.60


def traffic_light(r2: Column) -> Column:
    return F.when(r2 > GREEN, "green").when(r2 >= YELLOW, "yellow").when(r2 < YELLOW, "red")


def deployment(rolling_r2: Column, spatial_r2: Column) -> Column:
    """Use allowed by the scores of the rolling and the site-wise validation."""
    return (
        F.when(rolling_r2 <= GREEN, "research_only")
        .when((rolling_r2 > GREEN) & (spatial_r2 > SPATIAL), "operational")
        .when(rolling_r2 > GREEN, "site_specific")
    )
