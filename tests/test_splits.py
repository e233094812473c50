from __future__ import annotations

import hashlib
from datetime import datetime, timedelta

import pytest
from conftest import values
from pyspark.sql import functions as F

from verdure.operators import splits


def dated(frame, n, site="s"):
    start = datetime(2024, 1, 1)
    return frame([(site, start + timedelta(hours=i), i) for i in range(n)], "site string, ts timestamp_ntz, id int")


@pytest.mark.parametrize(("n", "train"), [(1, 1), (6, 4), (10, 8)])
def test_holdout_sizes(frame, n, train):
    out = splits.temporal_holdout(dated(frame, n), ["site"], ["ts", "id"])
    labels = [r[1] for r in values(out, "id", "split")]
    assert labels == ["train"] * train + ["test"] * (n - train)


def test_holdout_is_in_time_order_per_site(frame):
    df = dated(frame, 30).unionByName(dated(frame, 7, "t"))
    out = splits.temporal_holdout(df, ["site"], ["ts", "id"])
    ends = out.groupBy("site").agg(
        F.max(F.when(F.col("split") == "train", F.col("ts"))).alias("a"), F.min(F.when(F.col("split") == "test", F.col("ts"))).alias("b")
    )
    assert all(r.a < r.b for r in ends.collect()) and out.count() == 37


def test_kfold_remainder_is_never_tested(frame):
    out = splits.temporal_blocks(dated(frame, 11), ["site"], ["ts", "id"], 5)
    assert [r[1] for r in values(out, "id", "block")] == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4, None]
    sizes = splits.fold_sizes(out, 5)
    assert values(sizes, "fold", "train_rows", "test_rows") == [(1, 2, 2), (2, 4, 2), (3, 6, 2), (4, 8, 2)]


def test_kfold_leaves_out_short_groups(frame):
    df = dated(frame, 10).unionByName(dated(frame, 4, "short"))
    out = splits.temporal_blocks(df, ["site"], ["ts", "id"], 5)
    assert {r.site for r in out.collect()} == {"s"}


def test_fixed_test_sets(frame):
    out = splits.fixed_test_blocks(dated(frame, 23), ["site"], ["ts", "id"], folds=3, share=0.2)
    labels = [r[1] for r in values(out, "id", "fold")]
    assert labels == [0] * 11 + [1] * 4 + [2] * 4 + [3] * 4


def test_exact_random_split(spark):
    for n in (1, 9, 1000):
        df = spark.range(n)
        out = splits.random_split_exact(df, ["id"], 0.8)
        train = {r.id for r in out.where("split = 'train'").collect()}
        order = sorted(range(n), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
        assert train == set(order[: int(n * 0.8)]) and out.count() == n


def test_seed_changes_the_draw(spark):
    df = spark.range(500)
    a, b = (splits.random_split_exact(df, ["id"], 0.5, seed).where("split = 'train'") for seed in ("a", "b"))
    assert a.count() == b.count() == 250 and a.exceptAll(b).count() > 50


def test_hash_split_is_disjoint_and_reproducible(spark):
    df = spark.range(5000)
    one, two = (splits.random_split_hash(df, ["id"]) for _ in range(2))
    assert one.exceptAll(two).count() == 0
    share = one.where("split = 'train'").count() / 5000
    assert 0.77 < share < 0.83


def test_capped_sample(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "small").otherwise("large").alias("site"))
    df = df.where("site = 'large' OR id < 90")
    out = splits.capped_sample(df, ["site"], ["id"], per_group=100, overall=None)
    assert values(out.groupBy("site").count(), "site", "count") == [("large", 100), ("small", 30)]
    assert splits.capped_sample(df, ["site"], ["id"], per_group=100, overall=50).count() == 50


def test_copies_of_a_key_stay_together(spark):
    # a third of all rows share one key
    df = spark.range(900).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("id"))
    out = splits.random_split_exact(df, ["id"], 0.5)
    assert out.where("id = -1").select("split").distinct().count() == 1
    assert out.count() == 900


def test_leave_one_site_out(frame):
    rows = [(s, i) for s, n in (("a", 5), ("b", 3), ("c", 1), ("d", 9)) for i in range(n)]
    kept, folds = splits.leave_one_site_out(frame(rows, "site string, v int"), min_rows=2, max_sites=3)
    assert {r.site for r in kept.collect()} == {"a", "b"}
    assert values(folds, "test_site", "train_rows", "test_rows") == [("a", 3, 5), ("b", 5, 3)]


def test_rolling_origin_spacing(frame):
    start = datetime(2024, 1, 1)
    df = frame([(start + timedelta(days=d), d) for d in range(101)], "ts timestamp_ntz, d int")
    out = splits.rolling_origin(df, "ts", 30, 7, 12)
    got = out.groupBy("window", "part").agg(F.min("d").alias("a"), F.max("d").alias("b"))
    want = [(1, "test", 30, 36), (1, "train", 0, 29), (2, "test", 67, 73), (2, "train", 37, 66)]
    assert values(got, "window", "part", "a", "b") == want


def test_rolling_origin_needs_enough_days(frame):
    start = datetime(2024, 1, 1)
    df = frame([(start + timedelta(days=d),) for d in range(37)], "ts timestamp_ntz")
    assert splits.rolling_origin(df, "ts").count() == 0


def test_rolling_origin_stops_at_the_number_of_windows(frame):
    start = datetime(2024, 1, 1)
    df = frame([(start + timedelta(days=d),) for d in range(1000)], "ts timestamp_ntz")
    got = {r.window for r in splits.rolling_origin(df, "ts", 30, 7, 4).select("window").distinct().collect()}
    assert got == {1, 2, 3, 4}


def test_window_mode_takes_the_smallest_of_equals(frame):
    days = [datetime(2024, m, 5) for m in (4, 1, 1, 4)]
    rows = [(1, "train", d) for d in days] + [(1, "test", datetime(2024, 6, 1))]
    df = frame(rows, "window int, part string, ts timestamp_ntz")
    row = splits.window_profile(df, "ts", min_train=4, min_test=1).first()
    assert (row.train_season, row.train_month, row.test_season, row.is_seasonal_transition) == (1, 1, 3, True)
    assert splits.window_profile(df, "ts", min_train=5, min_test=1).count() == 0


@pytest.mark.parametrize("size", [{}, {"max_rows": 3, "block_rows": 4}])
def test_rows_of_a_null_group_are_split_like_others(frame, size):
    df = dated(frame, 10).unionByName(dated(frame, 10, None))
    held = splits.temporal_holdout(df, ["site"], ["ts", "id"], **size)
    blocks = splits.temporal_blocks(df, ["site"], ["ts", "id"], **size)
    tests = splits.fixed_test_blocks(df, ["site"], ["ts", "id"], **size)
    for out, label in ((held, "split"), (blocks, "block"), (tests, "fold")):
        rows = sorted((r.id, r.site is None, r[label]) for r in out.collect())
        assert len(rows) == 20
        assert [r[2] for r in rows if r[1]] == [r[2] for r in rows if not r[1]]


def test_a_null_group_is_sampled(frame):
    df = dated(frame, 10).unionByName(dated(frame, 10, None))
    out = splits.capped_sample(df, ["site"], ["id"], per_group=4, overall=None)
    assert out.columns == df.columns
    assert sorted(r.site or "" for r in out.collect()) == [""] * 4 + ["s"] * 4
