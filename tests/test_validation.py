from __future__ import annotations

import threading
import time
from datetime import datetime

import pytest
from conftest import values
from pyspark.sql import functions as F

from verdure.plans import models, validation

SETTINGS = models.BoostSettings(rounds=3, bins=16, depth=3)


@pytest.fixture(scope="module")
def hourly(spark):
    """Four sites, a hundred days each, one row every two hours."""
    start = F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz")
    rows = spark.range(4 * 1200).select(
        "id", F.concat(F.lit("s"), F.col("id") % 4).alias("site"), (F.col("id") / 4).cast("int").alias("step")
    )
    return rows.select(
        "id", "site", (start + F.make_dt_interval(hours=F.col("step") * 2)).alias("ts"),
        (F.col("step") % 12).cast("double").alias("x"), (F.col("step") % 12 * 2.0 + F.col("id") % 2).alias("y"),
    ).persist()


@pytest.mark.parametrize(("scheme", "folds"), [("random", 1), ("temporal", 1), ("kfold", 4), ("spatial", 3), ("rolling", 2)])
def test_schemes(hourly, scheme, folds):
    out = validation.validate(hourly, scheme, ["x"], "y", ["id"], settings=SETTINGS, max_sites=3)
    scores = out["fold_metrics"].collect()
    assert len(scores) == folds
    assert all(r.test_samples > 0 and r.train_samples > 0 and r.test_r2 > 0.3 for r in scores)
    assert out["importance"].first().feature == "x"
    assert {"site", "ts", "fold", "part", "actual", "predicted"} <= set(out["predictions"].columns)
    if scheme == "spatial":
        assert values(out["sites"], "site") == [("s0",), ("s1",), ("s2",)]
    if scheme == "rolling":
        assert out["windows"].count() == 2 and out["seasons"].count() >= 1


def test_no_row_is_on_both_sides(hourly):
    for scheme in validation.SCHEMES:
        made = validation.label(hourly, scheme, ["id"], max_sites=3)
        for _, train, test in made.folds:
            assert made.rows.where(train & test).count() == 0, scheme


def test_random_and_temporal_keep_every_row(hourly):
    for scheme in ("random", "temporal"):
        made = validation.label(hourly, scheme, ["id"])
        _, train, test = made.folds[0]
        assert made.rows.where(train | test).count() == hourly.count()


def test_saved_results(hourly, tmp_path, spark):
    out = validation.validate(hourly, "temporal", ["x"], "y", ["id"], settings=SETTINGS)
    validation.save(out, str(tmp_path / "run"))
    saved = spark.read.parquet(str(tmp_path / "run" / "predictions"))
    assert saved.count() == out["predictions"].count()


@pytest.mark.parametrize(
    ("curve", "patience", "kept"),
    [([5.0, 4.0, 3.0], 2, 3), ([5.0, 4.0, 4.5, 4.6, 1.0], 2, 2), ([5.0, 4.0, 4.5, 4.6, 1.0], 3, 5), ([2.0, 2.0, 2.0], 1, 1), ([1.0], 5, 1)],
)
def test_patience_keeps_the_rounds_up_to_the_best(curve, patience, kept):
    assert models.patient_rounds(curve, patience) == kept


def test_all_rounds_are_trained_and_the_model_is_cut(spark):
    noisy = spark.range(3000).select(
        "id", (F.col("id") % 17).cast("double").alias("x"), F.rand(1).alias("z"), ((F.col("id") % 17) * 2 + F.rand(2) * 10).alias("y")
    ).persist()
    settings = models.BoostSettings(rounds=12, patience=2, bins=16)
    ready = models.prepare(noisy, ["x", "z"], "y", ["id"], settings)
    cut = models.fit(ready, "y", settings)
    assert len(cut.curve) == 12 and cut.trees == models.patient_rounds(cut.curve, 2)
    # a model trained for just as many rounds says the same
    same = models.fit(ready, "y", models.BoostSettings(rounds=cut.trees, patience=99, bins=16))
    a, b = (models.predict(m.model, ready).orderBy("id").select("predicted").collect() for m in (cut, same))
    assert a == b
    two = models.first_trees(cut.model, 1)
    assert two.getNumTrees == 1
    gains = models.importances(two, ["x", "z", "never"], spark, 1).collect()
    assert [g.feature for g in gains] == ["x", "z", "never"] and sum(g.importance for g in gains) == pytest.approx(1)


def test_without_held_out_rows_all_trees_stay(hourly):
    settings = models.BoostSettings(rounds=2, bins=16, validation_percent=0)
    fitted = models.fit(models.prepare(hourly, ["x"], "y", ["id"], settings), "y", settings)
    assert fitted.trees == 2 and fitted.curve == ()


def test_more_sites_than_models_are_held_out_in_groups(hourly):
    made = validation.label(hourly, "spatial", ["id"], max_models=3)
    assert values(made.about, "test_site", "fold") == [("s0", 1), ("s1", 2), ("s2", 3), ("s3", 1)]
    tested = [made.rows.where(test).select("site").distinct().count() for _, _, test in made.folds]
    assert tested == [2, 1, 1] and made.rows.count() == hourly.count()


def test_curves_of_every_fold(hourly):
    out = validation.validate(hourly, "kfold", ["x"], "y", ["id"], settings=SETTINGS)
    assert values(out["curves"].groupBy("fold").count(), "fold", "count") == [(f, 3) for f in range(1, 5)]


def test_unknown_scheme(hourly):
    with pytest.raises(ValueError, match="unknown scheme"):
        validation.label(hourly, "other", ["id"])


def test_folds_train_side_by_side_only_if_memory_holds_them(spark, hourly, monkeypatch):
    room = models.trainings_at_once(spark, 1, 10**12) * models.ROW_BYTES
    rows = room // models.ROW_BYTES
    assert [models.trainings_at_once(spark, n, 4) for n in (0, rows // 5, rows // 3, rows, 100 * rows)] == [4, 4, 3, 1, 1]

    running, most, lock, fit = [0], [0], threading.Lock(), models.fit

    def watched(*args):
        with lock:
            running[0] += 1
            most[0] = max(most[0], running[0])
        time.sleep(0.5)
        try:
            return fit(*args)
        finally:
            with lock:
                running[0] -= 1

    monkeypatch.setattr(models, "fit", watched)
    labelled = hourly.withColumn("block", (F.col("id") / 1600).cast("int"))
    folds = [(f, F.col("block") < f, F.col("block") == f) for f in (1, 2)]
    found = []
    # all rows as small as they are, and so large that no two folds fit
    for size, at_once in ((models.ROW_BYTES, 2), (room // 1000, 1)):
        monkeypatch.setattr(models, "ROW_BYTES", size)
        most[0] = 0
        done = models.cross_validate(labelled, ["x"], "y", ["id"], folds, SETTINGS, keep=["id"])
        found.append(values(done.predictions, "fold", "id", "part", "actual", "predicted"))
        assert most[0] == at_once
    assert found[0] == found[1] and len(found[0]) == (1 + 1 + 2 + 1) * 1600
