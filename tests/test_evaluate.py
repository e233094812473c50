from __future__ import annotations

import math

import pytest
from conftest import values
from pyspark.sql import functions as F

from verdure.operators import evaluate, splits
from verdure.plans import models


def test_scores_by_hand(frame):
    df = frame([(1.0, 2.0), (2.0, 2.0), (3.0, 5.0), (None, 1.0), (4.0, None)], "actual double, predicted double")
    row = evaluate.metrics(df).first()
    assert row.samples == 3
    assert row.rmse == pytest.approx(math.sqrt(5 / 3)) and row.mae == pytest.approx(1.0)
    assert row.r2 == pytest.approx(1 - 5 / 2)


def test_constant_target_has_no_r2(frame):
    assert evaluate.metrics(frame([(1.0, 2.0), (1.0, 1.0)], "actual double, predicted double")).first().r2 is None


def test_fold_deviation_is_of_the_population(frame):
    df = frame([(1, 0.5), (2, 0.7)], "fold int, test_r2 double")
    for c in ("train_rmse", "train_mae", "train_r2", "test_rmse", "test_mae"):
        df = df.withColumn(c, F.lit(1.0))
    assert evaluate.fold_rollup(df).first().test_r2_std == pytest.approx(0.1)
    row = evaluate.score_by(df.withColumn("season", F.lit(1)), "season").first()
    assert row.std_score == pytest.approx(0.141421, abs=1e-6) and row.windows == 2
    best = evaluate.best_fold(df).first()
    assert (best.best_fold, best.best_score) == (2, 0.7)


def test_best_and_worst(frame):
    df = frame([(f"s{i}", float(i)) for i in range(8)] + [("none", None)], "site string, r2 double")
    out = evaluate.best_and_worst(df, 2)
    assert values(out, "side", "site") == [("best", "s6"), ("best", "s7"), ("worst", "s0"), ("worst", "s1")]


def test_absent_importance_counts_as_zero(frame):
    df = frame([(1, "a", 0.6), (2, "a", 0.4), (1, "b", 0.4)], "fold int, feature string, importance double")
    assert values(evaluate.importance_rollup(df, 2), "feature", "importance") == [("a", 0.5), ("b", 0.2)]


def test_decisions(frame):
    df = frame([(0.7, 0.9), (0.71, 0.6), (0.71, 0.61), (0.49, 0.1), (0.5, 0.1)], "r double, s double")
    out = df.select(evaluate.traffic_light(F.col("r")), evaluate.deployment(F.col("r"), F.col("s"))).collect()
    assert [tuple(r) for r in out] == [
        ("yellow", "research_only"), ("green", "site_specific"), ("green", "operational"), ("red", "research_only"),
        ("yellow", "research_only"),
    ]


def test_climatology_falls_back_to_the_overall_mean(frame):
    train = frame([("a", 1.0), ("a", 3.0), ("b", 8.0)], "g string, y double")
    test = frame([("a", 0.0), ("z", 0.0)], "g string, y double")
    assert values(evaluate.climatology(train, test, ["g"], "y"), "g", "predicted") == [("a", 2.0), ("z", 4.0)]


def test_fold_climatology_matches_training_each_fold(frame):
    rows = [("g", b, float(10 * b + i)) for b in range(3) for i in range(2)] + [("g", None, 99.0)]
    df = frame(rows, "g string, block int, y double")
    out = evaluate.fold_climatology(df, ["g"], "y", 3)
    got = {(r.fold, r.part): (r.n, r.p) for r in out.groupBy("fold", "part").agg(F.count("y").alias("n"), F.max("predicted").alias("p")).collect()}
    assert got == {(1, "train"): (2, 0.5), (1, "test"): (2, 0.5), (2, "train"): (4, 5.5), (2, "test"): (2, 5.5)}


def test_left_out_site_is_not_in_its_mean(frame):
    df = frame([("a", 1, 1.0), ("b", 1, 3.0), ("c", 1, 5.0)], "site string, m int, y double")
    out = evaluate.left_out_climatology(df, "site", ["m"], "y")
    assert values(out, "site", "predicted") == [("a", 4.0), ("b", 3.0), ("c", 2.0)]


def test_blend_needs_enough_rows(frame):
    df = frame([(10.0, 20.0, 1001), (10.0, 20.0, 1000), (10.0, None, 5000)], "o double, l double, n int")
    out = [r.predicted for r in evaluate.blend(df, "o", "l", "n").collect()]
    assert out == [pytest.approx(17.0), 10.0, 10.0]


def test_intervals_cover_the_training_share(spark):
    df = spark.range(1000).select(F.lit("s").alias("g"), (F.col("id") % 101).cast("double").alias("actual"), F.lit(50.0).alias("predicted"))
    out = evaluate.prediction_intervals(df, df, ["g"])
    row = evaluate.interval_coverage(out, ["g"]).first()
    assert row.coverage >= 0.9 and row.mean_width == pytest.approx(90.0, abs=1.0)


def test_boosting_learns_and_keeps_ids(spark):
    df = spark.range(600).select(
        "id",
        (F.col("id") % 10).cast("double").alias("x"),
        (F.col("id") % 10 * 3 + F.col("id") % 2).cast("double").alias("y"),
        (F.col("id") % 3).cast("int").alias("block"),
    )
    folds = [(f, F.col("block") < f, F.col("block") == f) for f in (1, 2)]
    settings = models.BoostSettings(rounds=8, bins=16, depth=3)
    out = models.cross_validate(df, ["x", "absent"], "y", ["id"], folds, settings, keep=["id"])
    done, gains = out.predictions, out.importances
    scores = {r.fold: r for r in models.score(done).collect()}
    assert scores[1].test_samples == 200 and scores[2].train_samples == 400
    # a third of the target's sign bit is not in the features
    assert all(r.test_r2 > 0.5 for r in scores.values())
    mean = dict(values(evaluate.importance_rollup(gains, 2), "feature", "importance"))
    assert mean["x"] == pytest.approx(1.0) and mean["absent"] == 0.0
    assert "id" in done.columns


def test_folds_share_no_rows(spark):
    df = spark.range(100).select(F.lit("s").alias("g"), "id")
    blocks = splits.temporal_blocks(df, ["g"], ["id"], 5)
    for f in range(1, 5):
        train, test = blocks.where(F.col("block") < f), blocks.where(F.col("block") == f)
        assert train.agg(F.max("id")).first()[0] < test.agg(F.min("id")).first()[0]
