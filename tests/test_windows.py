"""Ordered operators: literal answers, and the way for long series against the plain way."""

from __future__ import annotations

import math
import random
import statistics
from datetime import datetime, timedelta

import pytest
from conftest import values
from pyspark.sql import functions as F

from verdure.operators import features, joins, ordered, splits, stats

SMALL = {"max_rows": 50, "block_rows": 40}


def readings(n=900, seed=1):
    """Series of very uneven length: one holds two thirds of the rows."""
    rng = random.Random(seed)
    start = datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        plant = "big" if rng.random() < 0.66 else rng.choice(["a", "b", "c", None])
        value = None if rng.random() < 0.1 else round(rng.uniform(0, 50), 2)
        rows.append(("s", plant, start + timedelta(minutes=17 * rng.randrange(n)), i, value))
    return rows


SCHEMA = "site string, plant_id string, ts timestamp_ntz, id int, ta double"


def test_lag_stops_at_tree_border(frame):
    df = frame([("a", 1, 1.0), ("a", 2, 2.0), ("a", 3, 3.0), ("b", 1, 10.0), ("b", 2, 20.0)], "p string, t int, ta double")
    out = features.lag_features(df, ["p"], ["t"], drivers=("ta",), lags=(1,))
    assert values(out, "p", "t", "ta_lag_1h") == [("a", 1, None), ("a", 2, 1.0), ("a", 3, 2.0), ("b", 1, None), ("b", 2, 10.0)]


def test_lag_set_shrinks_and_absent_driver_is_null(frame):
    df = frame([("a", 1, 1.0)], "p string, t int, ta double")
    out = features.lag_features(df, ["p"], ["t"], drivers=("ta", "rh"), lags=(1, 6, 24), max_lag=6)
    assert [c for c in out.columns if "lag" in c] == ["ta_lag_1h", "ta_lag_6h", "rh_lag_1h", "rh_lag_6h"]
    assert dict(out.dtypes)["rh_lag_6h"] == "double"


def test_rolling_skips_nulls(frame):
    df = frame([("a", i, v) for i, v in enumerate([1.0, None, 3.0, 5.0])], "p string, t int, ta double")
    out = features.rolling_features(df, ["p"], ["t"], drivers=("ta",), widths=(3,))
    got = values(out, "t", "ta_mean_3h", "ta_std_3h")
    assert [g[1] for g in got] == [1.0, 1.0, 2.0, 4.0]
    assert got[0][2] is None and got[1][2] is None
    assert got[2][2] == pytest.approx(math.sqrt(2)) and got[3][2] == pytest.approx(math.sqrt(2))


@pytest.mark.parametrize("sizes", [SMALL, {"max_rows": 5, "block_rows": 3}])
def test_long_series_give_the_plain_answer(frame, sizes):
    df = frame(readings(), SCHEMA)
    keys, order = ["site", "plant_id"], ["ts", "id"]
    plain = features.series_features(df, keys, order, ("ta",), ("ta",), lags=(1, 6, 24), widths=(3, 72))
    cut = features.series_features(df, keys, order, ("ta",), ("ta",), lags=(1, 6, 24), widths=(3, 72), **sizes)
    columns = [c for c in plain.columns if c not in ("site", "plant_id", "ts")]
    a, b = values(plain, *columns, order=["id"]), values(cut, *columns, order=["id"])
    assert len(a) == 900
    for x, y in zip(a, b, strict=True):
        assert x == pytest.approx(y, nan_ok=True)


def test_long_series_use_blocks(frame):
    df = frame(readings(), SCHEMA)
    out = features.lag_features(df, ["plant_id"], ["ts", "id"], drivers=("ta",), lags=(1,), **SMALL)
    plan = out._jdf.queryExecution().toString()
    assert "_block" in plan


def test_rank_of_long_series(frame):
    df = frame(readings(), SCHEMA)
    for keys in (["plant_id"], []):
        plain = ordered.ranked(df, keys, ["ts", "id"], "rn", "n")
        cut = ordered.ranked(df, keys, ["ts", "id"], "rn", "n", **SMALL)
        assert values(plain, "id", "rn", "n") == values(cut, "id", "rn", "n")


def test_pieces_of_a_hot_series_are_even(frame):
    df = frame([("hot", 7, i) for i in range(2000)], "p string, t int, id int")
    placed = ordered._positions(df, ["p"], ["t", "id"], 2000, 250)
    sizes = [r["count"] for r in placed.groupBy("_piece").count().collect()]
    assert max(sizes) <= 2 * 250 and sum(sizes) == 2000


def test_equal_rows_can_be_cut_apart(spark):
    # every row is a copy: only the source task tells them apart
    df = spark.range(0, 4000, 1, 16).select(F.lit("x").alias("p"), F.lit(1).alias("t"))
    placed = ordered._positions(df, ["p"], ["t"], 4000, 500)
    sizes = [r["count"] for r in placed.groupBy("_piece").count().collect()]
    assert max(sizes) < 2000 and sum(sizes) == 4000
    ranks = ordered.ranked(df, ["p"], ["t"], "rn", max_rows=100, block_rows=500)
    assert sorted(r.rn for r in ranks.collect()) == list(range(1, 4001))


def test_hot_rank_survives_a_second_evaluation(frame):
    df = frame(readings(), SCHEMA)
    out = ordered.ranked(df, ["plant_id"], ["ts", "id"], "rn", **SMALL)
    assert values(out, "id", "rn") == values(out, "id", "rn")


def test_slope_matches_least_squares(frame):
    df = frame([("a", i, v) for i, v in enumerate([1.0, 3.0, None, 8.0, 2.0])], "p string, t int, ta double")
    out = values(features.rolling_slope(df, ["p"], ["t"], "ta", 3), "t", "ta_slope_3h")
    assert out[0][1] is None
    assert [round(v, 6) if v is not None else None for _, v in out[1:]] == [2.0, 2.0, 2.5, -6.0]


def test_time_window_counts_hours_not_rows(frame):
    start = datetime(2024, 1, 1)
    hours = [0, 1, 5, 5, 6, 200]
    rows = [("a", start + timedelta(hours=h), float(i)) for i, h in enumerate(hours)]
    out = features.rolling_mean_time(frame(rows, "p string, ts timestamp_ntz, ta double"), ["p"], "ts", ["ta"], [2, 6])
    got = [(ts, m2, m6) for ts, m2, m6 in values(out, "ts", "ta_mean_2h", "ta_mean_6h")]
    # the window is open at its old end: hour 0 is 6 hours before hour 6 and no longer counts
    assert [g[1] for g in got] == [0.0, 0.5, 2.5, 3.0, 5.0]
    assert [g[2] for g in got] == [0.0, 0.5, 1.5, 2.5, 5.0]


def test_clock_features_of_a_gappy_series(frame):
    """Against all pairs of rows, with repeated times, nulls, gaps over several spans and values far from zero."""
    start = datetime(2024, 1, 1)
    hours = [0, 1, 1, 2, 5, 6, 30, 31, 32, 33, 200, 201, 206, 207]
    rows = [(p, start + timedelta(hours=h), None if h in (31, 206) else 1e9 + (h * 7 + i) % 11) for p in ("a", None) for i, h in enumerate(hours)]
    df = frame(rows, "p string, ts timestamp_ntz, ta double")
    out = features.time_features(df, ["p"], "ts", ["ta", "none"], hours=(2, 6), lags=(1, 5))
    got = {(r.p, r.ts): r for r in out.collect()}
    assert set(got) == {(p, t) for p, t, _ in rows}
    for (p, t), r in got.items():
        own = [(u, v) for q, u, v in rows if q == p and v is not None]
        for k in (1, 5):
            at = [v for u, v in own if u == t - timedelta(hours=k)]
            assert r[f"ta_lag_{k}h"] == (pytest.approx(sum(at) / len(at), rel=1e-15) if at else None)
        for h in (2, 6):
            near = [v for u, v in own if t - timedelta(hours=h) < u <= t]
            assert r[f"ta_mean_{h}h"] == (pytest.approx(sum(near) / len(near), rel=1e-15) if near else None)
            assert r[f"ta_std_{h}h"] == (pytest.approx(statistics.stdev(near), rel=1e-6, abs=1e-6) if len(near) > 1 else None)
        assert r.none_lag_1h is None and r.none_std_2h is None
    week = features.time_features(df, ["p"], "ts", ["ta"], hours=(6,), lags=(5,), since=start + timedelta(hours=5), until=start + timedelta(hours=200))
    for r in week.collect():
        assert start + timedelta(hours=5) <= r.ts < start + timedelta(hours=200)
        whole = got[(r.p, r.ts)]
        assert r.ta_lag_5h == whole.ta_lag_5h
        assert r.ta_std_6h == (None if whole.ta_std_6h is None else pytest.approx(whole.ta_std_6h, rel=1e-6))


def test_quantiles_match_percentile(frame):
    df = frame(readings(), SCHEMA)
    probs = [0.05, 0.25, 0.5, 0.75]
    want = df.groupBy("plant_id").agg(*[F.percentile("ta", p).alias(f"q{i}") for i, p in enumerate(probs)])
    names = [f"q{i}" for i in range(4)]
    for size in ({}, {"max_rows": 20, "block_rows": 30}):
        got = stats.exact_quantiles(df, "ta", probs, by=["plant_id"], names=names, **size)
        for a, b in zip(values(want, "plant_id", *names), values(got, "plant_id", *names), strict=True):
            assert a[0] == b[0] and a[1:] == pytest.approx(b[1:])
    overall = stats.exact_quantiles(df, "ta", [0.5], max_rows=20, block_rows=30).first()[0]
    assert overall == pytest.approx(df.agg(F.median("ta")).first()[0])


def test_quantile_of_copies(spark):
    df = spark.range(0, 3000, 1, 8).select(F.when(F.col("id") % 3 == 0, F.col("id").cast("double")).otherwise(5.0).alias("v"))
    assert stats.exact_quantiles(df, "v", [0.5]).first()[0] == 5.0


def test_salted_join_equals_plain_join(frame):
    left = frame([("hot" if i % 3 else f"k{i % 9}", i) for i in range(300)] + [(None, 999)], "k string, v int")
    right = frame([("hot", 1), ("hot", 2), ("k0", 3), ("k3", 4), (None, 5)], "k string, w int")
    for how in ("inner", "left", "left_semi", "left_anti"):
        plain = joins.spread_join(left, right, ["k"], how)
        salted = joins.spread_join(left, right, ["k"], how, max_rows=50, salts=4)
        assert sorted(map(str, plain.collect())) == sorted(map(str, salted.collect())), how


def test_salting_spreads_equal_rows(spark):
    df = spark.range(0, 8000, 1, 16).select(F.lit("x").alias("k"))
    table = spark.createDataFrame([("x", 1)], "k string, w int")
    joined = joins.spread_join(df, table, ["k"], "inner", max_rows=100, salts=8)
    assert joined.count() == 8000
    assert "_salt" in joined._jdf.queryExecution().toString()


def test_lookup_join_does_not_broadcast_a_large_table(spark):
    facts = spark.range(100).withColumnRenamed("id", "k")
    table = spark.range(1000).select(F.col("id").alias("k"), F.lit(1).alias("w"))
    small = joins.lookup_join(facts, table, ["k"], "left")
    large = joins.lookup_join(facts, table, ["k"], "left", max_broadcast=10)
    hint = "ResolvedHint (strategy=broadcast)"
    assert hint in small._jdf.queryExecution().analyzed().toString()
    assert hint not in large._jdf.queryExecution().analyzed().toString()
    assert small.count() == large.count() == 100


def test_long_groups_split_like_short_ones(frame):
    df = frame(readings(), SCHEMA)
    for make in (
        lambda **s: splits.temporal_holdout(df, ["plant_id"], ["ts", "id"], **s).withColumnRenamed("split", "label"),
        lambda **s: splits.temporal_blocks(df, ["plant_id"], ["ts", "id"], 5, **s).withColumnRenamed("block", "label"),
        lambda **s: splits.fixed_test_blocks(df, ["plant_id"], ["ts", "id"], 3, 0.2, **s).withColumnRenamed("fold", "label"),
    ):
        assert values(make(), "id", "label") == values(make(**SMALL), "id", "label")


def test_chain_covers_any_widths():
    assert features._chain((3, 6, 12, 24, 48, 72)) == [(3, [1, 1, 1]), (6, [3, 3]), (12, [6, 6]), (24, [12, 12]), (48, [24, 24]), (72, [48, 24])]
    for widths in ((168,), (5, 7, 100), (1,), (2,), (1000, 3)):
        ready = {1}
        for width, parts in features._chain(widths):
            assert sum(parts) == width and set(parts) <= ready and len(parts) <= width.bit_length() + 1
            ready.add(width)
        assert set(widths) <= ready


@pytest.mark.parametrize("widths", [(1, 2, 5), (7, 40), (3, 6, 12, 24, 48, 72)])
def test_rolling_equals_sliding_frames(frame, widths):
    from pyspark.sql import Window

    df = frame(readings(400), SCHEMA)
    got = features.rolling_features(df, ["plant_id"], ["ts", "id"], ("ta",), widths, ("mean", "std", "sum"))
    spec = Window.partitionBy("plant_id").orderBy("ts", "id")
    want = df
    for w in widths:
        at = spec.rowsBetween(1 - w, 0)
        want = want.withColumns(
            {f"ta_mean_{w}h": F.avg("ta").over(at), f"ta_std_{w}h": F.stddev_samp("ta").over(at), f"ta_sum_{w}h": F.sum("ta").over(at)}
        )
    columns = [c for c in want.columns if c.endswith("h")]
    for a, b in zip(values(got, *columns, order=["id"]), values(want, *columns, order=["id"]), strict=True):
        assert a == pytest.approx(b, abs=1e-9)


def test_rolling_does_not_lose_digits_behind_large_values(frame):
    rows = [("a", i, 1e12 if i < 50 else 1.0 + (i % 2) * 1e-3) for i in range(100)]
    out = features.rolling_features(frame(rows, "p string, t int, ta double"), ["p"], ["t"], ("ta",), (6,))
    last = values(out, "t", "ta_mean_6h", "ta_std_6h")[-1]
    assert last[1] == pytest.approx(1.0005, abs=1e-12) and last[2] == pytest.approx(1e-3 * math.sqrt(0.3), rel=1e-9)
