"""Training and scoring under the five validation schemes.

Every scheme labels the rows once and describes its folds as conditions on the label, so that no
fold copies the table. Only fold numbers come to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdure.operators import evaluate, splits
from verdure.operators.joins import lookup_join
from verdure.plans import models

SCHEMES = ("random", "temporal", "kfold", "spatial", "rolling")
Fold = tuple[int, Column, Column]


@dataclass(frozen=True)
class Labelled:
    """Rows with their labels, the folds over them, and a table describing the folds if there is one."""

    rows: DataFrame
    folds: list[Fold]
    about: DataFrame | None = None


def _two_sided() -> list[Fold]:
    return [(1, F.col("split") == "train", F.col("split") == "test")]


def label(
    df: DataFrame,
    scheme: str,
    key: Sequence[str],
    site: str = "site",
    ts: str = "ts",
    order: Sequence[str] | None = None,
    folds: int = 5,
    max_sites: int | None = None,
    min_rows: int = 100,
    max_models: int = 20,
    windows: int = 12,
    train_days: int = 30,
    test_days: int = 7,
    **size,
) -> Labelled:
    """Labels the rows for one scheme. ``key`` identifies a row, ``order`` orders the rows of a site.

    The spatial scheme holds out one site at a time; with more than ``max_models`` sites it holds out as many groups of
    sites instead, dealt out by name. Every site is tested once either way.
    """
    order = list(order or [ts, *[k for k in key if k not in (ts, site)]])
    if scheme == "random":
        return Labelled(splits.random_split_exact(df, key), _two_sided())
    if scheme == "temporal":
        return Labelled(splits.temporal_holdout(df, [site], order, **size), _two_sided())
    if scheme == "kfold":
        rows = splits.temporal_blocks(df, [site], order, folds, **size)
        here = F.col("block")
        return Labelled(rows, [(f, here < f, here == f) for f in range(1, folds)])
    if scheme == "spatial":
        rows, sites = splits.leave_one_site_out(df, site, min_rows, max_sites)
        grouped = splits.site_groups(sites, "test_site", max_models)
        numbers = range(1, 1 + min(max_models, sites.count()))
        names = grouped.select(F.col("test_site").alias(site), "fold")
        rows = lookup_join(rows, names, [site], "inner", derived=True).withColumnRenamed("fold", "_fold")
        return Labelled(rows, [(f, F.col("_fold") != f, F.col("_fold") == f) for f in numbers], grouped)
    if scheme == "rolling":
        rows = splits.rolling_origin(df, ts, train_days, test_days, windows)
        about = splits.window_profile(rows, ts)
        numbers = sorted(r["window"] for r in about.select("window").collect())
        here, side = F.col("window"), F.col("side")
        folds_ = [(w, (here == w) & (side == "train"), (here == w) & (side == "test")) for w in numbers]
        return Labelled(rows.withColumnRenamed("part", "side"), folds_, about)
    raise ValueError(f"unknown scheme {scheme}, expected one of {SCHEMES}")


def validate(
    df: DataFrame,
    scheme: str,
    features: Sequence[str],
    target: str,
    key: Sequence[str],
    site: str = "site",
    ts: str = "ts",
    settings: models.BoostSettings | None = None,
    **options,
) -> dict[str, DataFrame]:
    """Trains and scores one scheme; returns its result tables by name."""
    made = label(df.where(F.col(target).isNotNull()), scheme, key, site, ts, **options)
    if not made.folds:
        raise ValueError(f"no fold has enough rows for the {scheme} scheme")
    settings = settings or (models.ROLLING if scheme == "rolling" else models.TEMPORAL)
    done = models.cross_validate(made.rows, features, target, key, made.folds, settings, keep=[site, ts])
    predictions, gains = done.predictions, done.importances
    scores = evaluate.fold_metrics(predictions)
    out = {
        "predictions": predictions,
        "fold_metrics": scores,
        "rollup": evaluate.fold_rollup(scores),
        "best_fold": evaluate.best_fold(scores),
        "importance": evaluate.importance_rollup(gains, len(made.folds), 15),
        "curves": done.curves,
    }
    if scheme == "spatial":
        by_site = evaluate.metrics(predictions.where("part = 'test'"), [site])
        out["sites"] = by_site
        out["best_worst_sites"] = evaluate.best_and_worst(by_site, 5, site)
    if scheme == "rolling":
        seasonal = scores.join(F.broadcast(made.about.withColumnRenamed("window", "fold")), "fold")  # one row per window
        out["windows"] = seasonal
        out["seasons"] = evaluate.score_by(seasonal, "test_season")
        out["transitions"] = evaluate.score_by(seasonal, "is_seasonal_transition")
    return out


def save(results: dict[str, DataFrame], path: str, mode: str = "error") -> None:
    """Writes each result table below ``path``; predictions are split by fold."""
    for name, table in results.items():
        out = table.write.mode(mode)
        (out.partitionBy("fold") if name == "predictions" else out).parquet(f"{path}/{name}")
