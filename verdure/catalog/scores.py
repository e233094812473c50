"""Queries over forecasts and their scores."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdure.catalog.registry import query, rounded
from verdure.operators import evaluate as ops
from verdure.operators import features, splits
from verdure.operators.joins import lookup_join
from verdure.operators.metadata import add_columns
from verdure.plans import bindings as b
from verdure.plans import models
from verdure.session import materialize, scratch_path
from verdure.sources import stations

_R2 = "1 - sum((predicted - actual) ** 2) / nullif(var_pop(actual) * count(*), 0)"
_SCORES = f"""round(sqrt(avg((predicted - actual) ** 2)), 6) AS rmse, round(avg(abs(predicted - actual)), 6) AS mae,
    round({_R2}, 6) AS r2, count(*) AS samples, round(corr(actual, predicted) ** 2, 6) AS corr_squared"""
_NAMES = ("rmse", "mae", "r2", "corr_squared")


@query("prediction_metrics", b.with_cte(f"SELECT site, {_SCORES} FROM predictions GROUP BY site", "predictions"))
def prediction_metrics(spark, sf_dir):
    return rounded(ops.metrics(b.predictions(spark, sf_dir), ["site"]), *_NAMES)


@query("prediction_metrics_overall", b.with_cte(f"SELECT {_SCORES} FROM predictions", "predictions"))
def prediction_metrics_overall(spark, sf_dir):
    return rounded(ops.metrics(b.predictions(spark, sf_dir)), *_NAMES)


@query(
    "residuals",
    b.with_cte("SELECT site, ts, actual, predicted, round(predicted - actual, 6) AS residual FROM predictions", "predictions"),
)
def residuals(spark, sf_dir):
    return rounded(ops.residuals(b.predictions(spark, sf_dir)), "residual")


# temporal holdout of the events by site, and the training mean by site and hour as forecast
_HOLD = """SELECT *, CASE WHEN row_number() OVER (PARTITION BY site ORDER BY ts, event_id)
    <= greatest(1, CAST(floor(count(*) OVER (PARTITION BY site) * 0.8) AS BIGINT)) THEN 'train' ELSE 'test' END AS split FROM series"""
_CLIMATE = """SELECT h.site, h.ts, h.event_id, h.ta AS actual, coalesce(m.v, (SELECT avg(ta) FROM hold WHERE split = 'train')) AS predicted
    FROM hold h LEFT JOIN (SELECT site, month(ts) AS mo, hour(ts) AS ho, avg(ta) AS v FROM hold WHERE split = 'train' GROUP BY 1, 2, 3) m
    ON h.site = m.site AND month(h.ts) = m.mo AND hour(h.ts) = m.ho WHERE h.split = 'test'"""
_FORECAST = {"hold": _HOLD, "forecast": _CLIMATE}


def _forecast(spark, sf_dir):
    rows = b.series(spark, sf_dir).withColumns({"month": F.month("ts"), "hour": F.hour("ts")})
    labelled = splits.temporal_holdout(rows, ["site"], b.ORDER)
    train, test = (labelled.where(F.col("split") == s) for s in ("train", "test"))
    out = ops.climatology(train, test, ["site", "month", "hour"], "ta")
    return out.select("site", "ts", "event_id", F.col("ta").alias("actual"), "predicted")


@query(
    "climatology_forecast",
    b.with_cte("SELECT site, ts, event_id, actual, round(predicted, 6) AS predicted FROM forecast", "series", extra=_FORECAST),
)
def climatology_forecast(spark, sf_dir):
    return rounded(_forecast(spark, sf_dir), "predicted")


@query(
    "predictions_table",
    b.with_cte(f"SELECT site, min(ts) AS first_ts, max(ts) AS last_ts, {_SCORES} FROM forecast GROUP BY site", "series", extra=_FORECAST),
)
def predictions_table(spark, sf_dir):
    path = scratch_path(spark, "predictions")
    _forecast(spark, sf_dir).write.partitionBy("site").parquet(path)
    saved = spark.read.parquet(path)
    scores = ops.metrics(saved, ["site"])
    ends = saved.groupBy("site").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return rounded(ends.join(scores, "site"), *_NAMES)


@query(
    "model_comparison",
    b.with_cte(
        f"SELECT site AS model_type, round({_R2}, 6) AS test_r2, round(sqrt(avg((predicted - actual) ** 2)), 6) AS test_rmse FROM forecast GROUP BY site",
        "series",
        extra=_FORECAST,
    ),
)
def model_comparison(spark, sf_dir):
    path = scratch_path(spark, "summaries")
    scores = ops.metrics(_forecast(spark, sf_dir), ["site"])
    scores.select(
        F.col("site").alias("model_type"), F.struct(F.col("r2").alias("test_r2"), F.col("rmse").alias("test_rmse")).alias("metrics")
    ).write.json(path)
    return rounded(stations.read_summaries(spark, path), "test_r2", "test_rmse")


# expanding folds over the orders of each nation with the mean by nation and month as forecast
_BLOCKS = """SELECT *, CAST((rn - 1) // (n // 5) AS INTEGER) AS block FROM
    (SELECT o_orderkey, c_nationkey AS site, month(o_orderdate) AS mo, o_totalprice AS value,
     row_number() OVER (PARTITION BY c_nationkey ORDER BY o_orderdate, o_orderkey) AS rn, count(*) OVER (PARTITION BY c_nationkey) AS n
     FROM orders JOIN customer ON o_custkey = c_custkey) r WHERE n >= 5 AND (rn - 1) // (n // 5) < 5"""
_FOLDED = """SELECT f.fold, CASE WHEN bl.block = f.fold THEN 'test' ELSE 'train' END AS part, bl.value AS actual, m.predicted
    FROM blocks bl JOIN (SELECT unnest(range(1, 5)) AS fold) f ON bl.block <= f.fold
    JOIN (SELECT g.fold, site, mo, avg(value) AS predicted FROM blocks JOIN (SELECT unnest(range(1, 5)) AS fold) g ON block < g.fold
          GROUP BY 1, 2, 3) m ON m.fold = f.fold AND m.site = bl.site AND m.mo = bl.mo"""
_SIDE = ", ".join(
    f"""sqrt(avg((predicted - actual) ** 2) FILTER (WHERE part = '{p}')) AS {p}_rmse,
    avg(abs(predicted - actual)) FILTER (WHERE part = '{p}') AS {p}_mae,
    1 - sum((predicted - actual) ** 2) FILTER (WHERE part = '{p}')
      / (var_pop(actual) FILTER (WHERE part = '{p}') * count(*) FILTER (WHERE part = '{p}')) AS {p}_r2,
    count(*) FILTER (WHERE part = '{p}') AS {p}_samples"""
    for p in ("train", "test")
)
_FOLDS = {"blocks": _BLOCKS, "folded": _FOLDED, "folds": f"SELECT CAST(fold AS INTEGER) AS fold, {_SIDE} FROM folded GROUP BY 1"}
_SIX = [f"{p}_{s}" for p in ("train", "test") for s in ops.SCORES]


def _national_orders(spark, sf_dir):
    customers = b.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("site"))
    orders = b.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", F.col("o_totalprice").alias("value"))
    return orders.join(customers, "o_custkey").drop("o_custkey").withColumn("mo", F.month("o_orderdate"))


def _folds(spark, sf_dir):
    blocks = splits.temporal_blocks(_national_orders(spark, sf_dir), ["site"], ["o_orderdate", "o_orderkey"], 5)
    done = ops.fold_climatology(blocks, ["site", "mo"], "value", 5)
    return ops.fold_metrics(done.withColumnRenamed("value", "actual"))


@query(
    "fold_metrics",
    b.with_cte(
        "SELECT fold, train_samples, test_samples, " + ", ".join(f"round({c}, 5) AS {c}" for c in _SIX) + " FROM folds", extra=_FOLDS
    ),
)
def fold_metrics(spark, sf_dir):
    return rounded(_folds(spark, sf_dir), *_SIX, digits=5)


@query(
    "fold_metric_rollup",
    b.with_cte(
        "SELECT count(*) AS folds, "
        + ", ".join(f"round(avg({c}), 5) AS {c}_mean, round(stddev_pop({c}), 5) AS {c}_std" for c in _SIX)
        + " FROM folds",
        extra=_FOLDS,
    ),
)
def fold_metric_rollup(spark, sf_dir):
    out = ops.fold_rollup(_folds(spark, sf_dir))
    return rounded(out, *[c for c in out.columns if c != "folds"], digits=5)


@query(
    "best_fold",
    b.with_cte(
        "SELECT arg_max(fold, test_r2) AS best_fold, round(max(test_r2), 6) AS best_score FROM folds", extra=_FOLDS
    ),
)
def best_fold(spark, sf_dir):
    return rounded(ops.best_fold(_folds(spark, sf_dir)), "best_score")


# leave-one-site-out: each site forecast by the month means of all other sites
_OUT = """SELECT s.site, s.value AS actual, (t.s - o.s) / (t.n - o.n) AS predicted FROM nat s
    JOIN (SELECT mo, sum(value) AS s, count(*) AS n FROM nat GROUP BY 1) t ON s.mo = t.mo
    JOIN (SELECT mo, site, sum(value) AS s, count(*) AS n FROM nat GROUP BY 1, 2) o ON s.mo = o.mo AND s.site = o.site"""
_LOSO = {
    "nat": """SELECT c_nationkey AS site, month(o_orderdate) AS mo, o_totalprice AS value
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "loso": _OUT,
    "by_site": f"SELECT site, {_R2} AS r2, count(*) AS samples FROM loso GROUP BY site",
}


def _site_scores(spark, sf_dir):
    done = ops.left_out_climatology(_national_orders(spark, sf_dir), "site", ["mo"], "value")
    return ops.metrics(done.withColumnRenamed("value", "actual"), ["site"])


@query(
    "best_worst_sites",
    b.with_cte(
        """SELECT * FROM (SELECT site, round(r2, 6) AS r2, samples, 'best' AS side FROM by_site ORDER BY by_site.r2 DESC, site LIMIT 5) x
        UNION ALL SELECT * FROM (SELECT site, round(r2, 6), samples, 'worst' FROM by_site ORDER BY by_site.r2, site LIMIT 5) y""",
        extra=_LOSO,
    ),
)
def best_worst_sites(spark, sf_dir):
    out = ops.best_and_worst(_site_scores(spark, sf_dir).select("site", "r2", "samples"))
    return rounded(out, "r2")


# rolling windows over the lines of each ship month, forecast by the training mean per quantity
_WINDOWS = {
    "rows": "SELECT l_shipdate AS ts, l_quantity AS x, l_extendedprice AS value FROM lineitem",
    "origin": """SELECT *, date_diff('day', lo, ts) AS since, date_diff('day', lo, hi) AS length,
        greatest((date_diff('day', lo, hi) - 37) // 11, 37) AS spacing FROM (SELECT *, min(ts) OVER () AS lo, max(ts) OVER () AS hi FROM rows) r""",
    "placed": """SELECT *, CAST(since // spacing + 1 AS INTEGER) AS w, CASE WHEN since % spacing < 30 THEN 'train' ELSE 'test' END AS part
        FROM origin WHERE since // spacing < 12 AND since // spacing * spacing + 37 <= length AND since % spacing < 37""",
    "fitted": """SELECT p.w, p.ts, p.part, p.value AS actual, m.v AS predicted FROM placed p
        JOIN (SELECT w, x, avg(value) AS v FROM placed WHERE part = 'train' GROUP BY 1, 2) m ON p.w = m.w AND p.x = m.x""",
    "seasons": """SELECT w, max(v) FILTER (WHERE part = 'train') AS train_season, max(v) FILTER (WHERE part = 'test') AS test_season FROM
        (SELECT w, part, v, row_number() OVER (PARTITION BY w, part ORDER BY count(*) DESC, v) AS rn FROM
         (SELECT w, part, CAST((month(ts) % 12) // 3 + 1 AS INTEGER) AS v FROM placed) a GROUP BY 1, 2, 3) c WHERE rn = 1 GROUP BY 1""",
    "windows": f"""SELECT w, test_season, train_season <> test_season AS is_transition, test_r2 FROM seasons
        JOIN (SELECT w, {_R2} AS test_r2 FROM fitted WHERE part = 'test' GROUP BY w) s USING (w)
        WHERE w IN (SELECT w FROM placed GROUP BY w HAVING count(*) FILTER (WHERE part = 'train') >= 100
                    AND count(*) FILTER (WHERE part = 'test') >= 10)""",
}


def _window_scores(spark, sf_dir):
    lines = b.table(spark, sf_dir, "lineitem").select(
        F.col("l_shipdate").alias("ts"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("value")
    )
    placed = splits.rolling_origin(lines, "ts")
    means = placed.where("part = 'train'").groupBy("window", "x").agg(F.avg("value").alias("predicted"))
    test = lookup_join(placed.where("part = 'test'"), means, ["window", "x"], "inner", derived=True)
    test = test.withColumnRenamed("value", "actual")
    scores = ops.metrics(test, ["window"]).select("window", F.col("r2").alias("test_r2"))
    profile = splits.window_profile(placed, "ts").select(
        "window", "test_season", F.col("is_seasonal_transition").alias("is_transition")
    )
    return profile.join(scores, "window")


_BY = "round(avg(test_r2), 6) AS mean_score, round(stddev_samp(test_r2), 6) AS std_score, count(test_r2) AS windows"


@query("season_metric_rollup", b.with_cte(f"SELECT test_season, {_BY} FROM windows GROUP BY 1", extra=_WINDOWS))
def season_metric_rollup(spark, sf_dir):
    return rounded(ops.score_by(_window_scores(spark, sf_dir), "test_season"), "mean_score", "std_score")


@query("transition_rollup", b.with_cte(f"SELECT is_transition, {_BY} FROM windows GROUP BY 1", extra=_WINDOWS))
def transition_rollup(spark, sf_dir):
    return rounded(ops.score_by(_window_scores(spark, sf_dir), "is_transition"), "mean_score", "std_score")


@query(
    "deployment_decision",
    b.with_cte(
        """SELECT test_season, CASE WHEN r > 0.7 THEN 'green' WHEN r >= 0.5 THEN 'yellow' ELSE 'red' END AS light,
        CASE WHEN r <= 0.7 THEN 'research_only' WHEN s > 0.6 THEN 'operational' ELSE 'site_specific' END AS decision
        FROM (SELECT test_season, avg(test_r2) AS r, (SELECT avg(r2) FROM by_site) AS s FROM windows GROUP BY 1) d""",
        extra={**_WINDOWS, **_LOSO},
    ),
)
def deployment_decision(spark, sf_dir):
    seasons = ops.score_by(_window_scores(spark, sf_dir), "test_season")
    spatial = _site_scores(spark, sf_dir).agg(F.avg("r2").alias("s")).select("s").scalar()
    rolling = F.col("mean_score")
    return seasons.select(
        "test_season", ops.traffic_light(rolling).alias("light"), ops.deployment(rolling, spatial).alias("decision")
    )


@query(
    "importance_rollup",
    b.with_cte(
        """SELECT feature, round(sum(abs(c)) / 7, 6) AS importance FROM
        (SELECT l_linenumber, 'quantity' AS feature, corr(l_quantity, l_extendedprice) AS c FROM lineitem GROUP BY 1
         UNION ALL SELECT l_linenumber, 'tax', corr(l_tax, l_extendedprice) FROM lineitem WHERE l_linenumber <> 3 GROUP BY 1
         UNION ALL SELECT l_linenumber, 'discount', corr(l_discount, l_extendedprice) FROM lineitem GROUP BY 1) x
        GROUP BY feature ORDER BY importance DESC, feature LIMIT 15""",
    ),
)
def importance_rollup(spark, sf_dir):
    # seven folds by line number; strength of association stands for the gain of a feature
    lines = b.table(spark, sf_dir, "lineitem")
    wide = lines.groupBy("l_linenumber").agg(
        *[F.abs(F.corr(f"l_{c}", "l_extendedprice")).alias(c) for c in ("quantity", "tax", "discount")]
    )
    long = wide.unpivot(["l_linenumber"], ["quantity", "tax", "discount"], "feature", "importance")
    kept = long.where(~((F.col("feature") == "tax") & (F.col("l_linenumber") == 3)))
    return rounded(ops.importance_rollup(kept, 7, 15), "importance")


@query(
    "model_blend",
    b.with_cte(
        """SELECT site, event_id, round(CASE WHEN n > 1450 THEN 0.7 * loc + 0.3 * every ELSE every END, 6) AS predicted FROM
        (SELECT h.site, h.event_id, coalesce(g.v, m) AS every, coalesce(l.v, m) AS loc, c.n FROM hold h
         JOIN (SELECT avg(ta) AS m FROM hold WHERE split = 'train') o ON true
         LEFT JOIN (SELECT hour(ts) AS ho, avg(ta) AS v FROM hold WHERE split = 'train' GROUP BY 1) g ON hour(h.ts) = g.ho
         LEFT JOIN (SELECT site, hour(ts) AS ho, avg(ta) AS v FROM hold WHERE split = 'train' GROUP BY 1, 2) l ON l.site = h.site AND hour(h.ts) = l.ho
         JOIN (SELECT site, count(*) AS n FROM hold WHERE split = 'train' GROUP BY 1) c ON c.site = h.site WHERE h.split = 'test') x""",
        "series",
        extra={"hold": _HOLD},
    ),
)
def model_blend(spark, sf_dir):
    rows = b.series(spark, sf_dir).withColumn("hour", F.hour("ts"))
    labelled = splits.temporal_holdout(rows, ["site"], b.ORDER)
    train, test = (labelled.where(F.col("split") == s) for s in ("train", "test"))
    both = ops.climatology(train, test, ["hour"], "ta", "overall")
    both = ops.climatology(train, both, ["site", "hour"], "ta", "local")
    sizes = train.groupBy("site").agg(F.count(F.lit(1)).alias("train_rows"))
    out = ops.blend(lookup_join(both, sizes, ["site"], "inner", derived=True), "overall", "local", "train_rows", more_than=1450)
    return rounded(out.select("site", "event_id", "predicted"), "predicted")


_FIT = """SELECT h.site, h.event_id, h.split, h.ta AS actual, m.v AS predicted FROM hold h
    JOIN (SELECT site, avg(ta) AS v FROM hold WHERE split = 'train' GROUP BY 1) m ON h.site = m.site"""


@query(
    "prediction_intervals",
    b.with_cte(
        """SELECT site, count(*) AS n, round(avg(CAST(actual BETWEEN predicted + lo AND predicted + hi AS INTEGER)), 6) AS coverage,
        round(avg(hi - lo), 5) AS mean_width FROM fit JOIN (SELECT site, quantile_cont(actual - predicted, 0.05) AS lo,
        quantile_cont(actual - predicted, 0.95) AS hi FROM fit WHERE split = 'train' GROUP BY 1) q USING (site) WHERE split = 'test' GROUP BY site""",
        "series",
        extra={"hold": _HOLD, "fit": _FIT},
    ),
)
def prediction_intervals(spark, sf_dir):
    labelled = splits.temporal_holdout(b.series(spark, sf_dir), ["site"], b.ORDER)
    train = labelled.where("split = 'train'")
    fitted = ops.climatology(train, labelled, ["site"], "ta").withColumnRenamed("ta", "actual")
    made = ops.prediction_intervals(fitted.where("split = 'train'"), fitted.where("split = 'test'"), ["site"])
    return rounded(rounded(ops.interval_coverage(made, ["site"]), "coverage"), "mean_width", digits=5)


# The mean of a reading and the two before it: the readings before tell two thirds of it, the calendar nothing.
_TARGET = "ta_mean_3h"
_FEATURES = ("ta_lag_1h", "ta_lag_2h", "ta_lag_3h", "hour", "weekday", "minute")


def _learning_rows(spark, sf_dir):
    rows = features.lag_features(b.series(spark, sf_dir), b.SERIES, b.ORDER, drivers=("ta",), lags=(1, 2, 3))
    rows = features.rolling_features(rows, b.SERIES, b.ORDER, drivers=("ta",), widths=(3,), stats=("mean",))
    return add_columns(rows, {"hour": F.hour("ts"), "weekday": F.weekday("ts"), "minute": F.minute("ts")})


_LEARNING = """SELECT *, row_number() OVER (PARTITION BY site ORDER BY ts, event_id) AS rn, count(*) OVER (PARTITION BY site) AS n,
    avg(ta) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS y, coalesce(lag(ta, 1) OVER w, 0) AS ta_lag_1h,
    coalesce(lag(ta, 2) OVER w, 0) AS ta_lag_2h, coalesce(lag(ta, 3) OVER w, 0) AS ta_lag_3h, hour(ts) AS hour,
    isodow(ts) - 1 AS weekday, minute(ts) AS minute FROM series WINDOW w AS (PARTITION BY site, plant_id ORDER BY ts, event_id)"""


def _mean_forecast(predictions):
    """Beside the scores of each fold the error of the training mean as the only forecast."""
    actual = lambda part: F.when(F.col("part") == part, F.col("actual"))
    by_fold = predictions.groupBy("fold").agg(
        F.avg(actual("train")).alias("m"), F.avg(actual("test")).alias("a"), F.var_pop(actual("test")).alias("v")
    )
    off = F.col("a") - F.col("m")
    return by_fold.select("fold", F.sqrt(F.col("v") + off * off).alias("mean_rmse"))


def _cut_by_patience(curves, patience):
    """Whether the last round kept has the lowest error so far and none of the next ``patience`` rounds has a lower one."""
    cuts = curves.groupBy("fold").agg(F.count_if("kept").alias("cut"), F.count(F.lit(1)).alias("rounds"))
    best = curves.join(cuts, "fold").groupBy("fold", "cut", "rounds").agg(
        F.min(F.when(F.col("round") <= F.col("cut"), F.col("rmse"))).alias("before"),
        F.max(F.when(F.col("round") == F.col("cut"), F.col("rmse"))).alias("at"),
        F.min(F.when((F.col("round") > F.col("cut")) & (F.col("round") <= F.col("cut") + patience), F.col("rmse"))).alias("after"),
    )
    right = (F.col("at") == F.col("before")) & (F.col("after").isNull() | (F.col("after") >= F.col("at")))
    return best.select("fold", "rounds", right.alias("cut_by_patience"))


def _judged(done, patience):
    scores = models.score(done.predictions)
    joined = scores.join(_mean_forecast(done.predictions), "fold").join(_cut_by_patience(done.curves, patience), "fold")
    return joined.select(
        "fold",
        F.col("train_samples").alias("train_rows"),
        F.col("test_samples").alias("test_rows"),
        F.round("mean_rmse", 5).alias("mean_rmse"),
        ((F.col("test_rmse") < F.col("mean_rmse")) & (F.col("train_r2") > 0)).alias("beats_mean"),
        F.col("rounds").cast("int").alias("rounds"),
        "cut_by_patience",
    )


@query(
    "gbt_cv",
    b.with_cte(
        """SELECT fold, count(*) FILTER (WHERE block < fold) AS train_rows, count(*) FILTER (WHERE block = fold) AS test_rows,
        round(sqrt(var_pop(y) FILTER (WHERE block = fold) + (avg(y) FILTER (WHERE block = fold) - avg(y) FILTER (WHERE block < fold)) ** 2), 5)
        AS mean_rmse, true AS beats_mean, 150 AS rounds, true AS cut_by_patience
        FROM (SELECT y, (rn - 1) // (n // 5) AS block FROM learning WHERE n >= 5) b, (SELECT unnest([1, 2, 3, 4]) AS fold) f GROUP BY fold""",
        "series",
        extra={"learning": _LEARNING},
    ),
)
def gbt_cv(spark, sf_dir):
    rows = splits.temporal_blocks(_learning_rows(spark, sf_dir), ["site"], b.ORDER, 5)
    folds = [(f, F.col("block") < f, F.col("block") == f) for f in range(1, 5)]
    done = models.cross_validate(rows, _FEATURES, _TARGET, ["event_id"], folds, models.TEMPORAL)
    return _judged(done, models.TEMPORAL.patience)


def _held_out():
    return [(1, F.col("split") == "train", F.col("split") == "test")]


@query(
    "gbt_importance",
    b.with_cte(
        """SELECT feature, abs(r) > 0.2 AS is_signal FROM
        (SELECT corr(ta_lag_1h, y) AS ta_lag_1h, corr(ta_lag_2h, y) AS ta_lag_2h, corr(ta_lag_3h, y) AS ta_lag_3h, corr(hour, y) AS hour,
        corr(weekday, y) AS weekday, corr(minute, y) AS minute FROM learning WHERE rn <= floor(n * 0.8)) c
        UNPIVOT (r FOR feature IN (ta_lag_1h, ta_lag_2h, ta_lag_3h, hour, weekday, minute))""",
        "series",
        extra={"learning": _LEARNING},
    ),
)
def gbt_importance(spark, sf_dir):
    rows = splits.temporal_holdout(_learning_rows(spark, sf_dir), ["site"], b.ORDER)
    done = models.cross_validate(rows, _FEATURES, _TARGET, ["event_id"], _held_out(), models.TEMPORAL)
    gains = ops.importance_rollup(done.importances, 1, 15)
    return gains.select("feature", (F.col("importance") > 0.2).alias("is_signal"))


_VARIANTS = {"rolling": models.ROLLING, "large": models.LARGE, "small": models.SMALL}


@query(
    "gbt_variants",
    b.with_cte(
        """SELECT variant, rounds, train_rows, test_rows, mean_rmse, true AS beats_mean, true AS cut_by_patience FROM
        (SELECT count(*) FILTER (WHERE rn <= cut) AS train_rows, count(*) FILTER (WHERE rn > cut) AS test_rows,
         round(sqrt(var_pop(y) FILTER (WHERE rn > cut) + (avg(y) FILTER (WHERE rn > cut) - avg(y) FILTER (WHERE rn <= cut)) ** 2), 5)
         AS mean_rmse FROM (SELECT *, floor(n * 0.8) AS cut FROM learning) l) s,
        (VALUES ('rolling', 100), ('large', 200), ('small', 100)) v(variant, rounds)""",
        "series",
        extra={"learning": _LEARNING},
    ),
)
def gbt_variants(spark, sf_dir):
    rows = materialize(splits.temporal_holdout(_learning_rows(spark, sf_dir), ["site"], b.ORDER), "learning")

    def run(name):
        done = models.cross_validate(rows, _FEATURES, _TARGET, ["event_id"], _held_out(), _VARIANTS[name])
        return _judged(done, _VARIANTS[name].patience).select(F.lit(name).alias("variant"), "*").drop("fold")

    trained = rows.where("split = 'train'").count()
    with ThreadPoolExecutor(models.trainings_at_once(spark, trained, len(_VARIANTS))) as pool:
        return reduce(DataFrame.unionByName, pool.map(run, _VARIANTS))
