"""Queries over training and test labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdure.catalog.registry import query
from verdure.operators import splits as ops
from verdure.plans import bindings as b

_HASH = "md5(CAST(o_orderkey AS VARCHAR))"
# order totals as a series per customer, ordered by date and key
_ORDERS = "SELECT o_orderkey, o_custkey AS site, o_orderdate AS ts, o_totalprice AS value FROM orders"


def _orders(spark, sf_dir):
    return b.table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("site"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("value")
    )


@query(
    "random_split_hash",
    f"""SELECT o_orderkey, CASE WHEN CAST('0x' || substr({_HASH}, 1, 8) AS BIGINT) % 100 < 80 THEN 'train' ELSE 'test' END AS split
        FROM orders""",
)
def random_split_hash(spark, sf_dir):
    return ops.random_split_hash(b.table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"])


@query(
    "random_split_exact",
    f"""SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY {_HASH}) <= CAST(floor(count(*) OVER () * 0.8) AS BIGINT)
        THEN 'train' ELSE 'test' END AS split FROM orders""",
)
def random_split_exact(spark, sf_dir):
    return ops.random_split_exact(b.table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"])


@query(
    "capped_sample",
    """SELECT event_id, site FROM (SELECT *, row_number() OVER (ORDER BY h) AS rn FROM
       (SELECT *, row_number() OVER (PARTITION BY site ORDER BY h) AS rs FROM
        (SELECT event_id, event_type AS site, md5(CAST(event_id AS VARCHAR)) AS h FROM events) a) c WHERE rs <= 1500) d
       WHERE rn <= 7000""",
)
def capped_sample(spark, sf_dir):
    rows = b.table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("site"))
    return ops.capped_sample(rows, ["site"], ["event_id"], per_group=1500, overall=7000)


@query(
    "temporal_holdout_split",
    b.with_cte(
        """SELECT site, ts, event_id, CASE WHEN row_number() OVER (PARTITION BY site ORDER BY ts, event_id)
        <= greatest(1, CAST(floor(count(*) OVER (PARTITION BY site) * 0.8) AS BIGINT)) THEN 'train' ELSE 'test' END AS split
        FROM series""",
        "series",
    ),
)
def temporal_holdout_split(spark, sf_dir):
    rows = b.series(spark, sf_dir).select("site", "ts", "event_id")
    return ops.temporal_holdout(rows, ["site"], b.ORDER)


@query(
    "temporal_kfold_split",
    b.with_cte(
        """SELECT o_orderkey, site, CAST(CASE WHEN (rn - 1) // (n // 5) < 5 THEN (rn - 1) // (n // 5) END AS INTEGER) AS block
        FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY ts, o_orderkey) AS rn,
              count(*) OVER (PARTITION BY site) AS n FROM rows) r WHERE n >= 5""",
        extra={"rows": _ORDERS},
    ),
)
def temporal_kfold_split(spark, sf_dir):
    rows = _orders(spark, sf_dir)
    return ops.temporal_blocks(rows, ["site"], ["ts", "o_orderkey"], 5).select("o_orderkey", "site", "block")


@query(
    "temporal_kfold_sizes",
    b.with_cte(
        """SELECT fold, CAST(train_rows AS BIGINT) AS train_rows, test_rows FROM
        (SELECT block AS fold, sum(count(*)) OVER (ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS train_rows,
                count(*) AS test_rows FROM
         (SELECT CAST((rn - 1) // (n // 5) AS INTEGER) AS block FROM
          (SELECT row_number() OVER (PARTITION BY site ORDER BY ts, o_orderkey) AS rn, count(*) OVER (PARTITION BY site) AS n FROM rows) r
          WHERE n >= 5) q WHERE block < 5 GROUP BY block) f WHERE train_rows > 0""",
        extra={"rows": _ORDERS},
    ),
)
def temporal_kfold_sizes(spark, sf_dir):
    return ops.fold_sizes(ops.temporal_blocks(_orders(spark, sf_dir), ["site"], ["ts", "o_orderkey"], 5), 5)


@query(
    "fixed_test_split",
    b.with_cte(
        """SELECT o_orderkey, site, CAST(greatest(0, 3 - (n - rn) // t) AS INTEGER) AS fold FROM
        (SELECT *, CAST(floor(n * 0.2) AS BIGINT) AS t FROM
         (SELECT *, row_number() OVER (PARTITION BY site ORDER BY ts, o_orderkey) AS rn,
                 count(*) OVER (PARTITION BY site) AS n FROM rows) r) s WHERE t > 0""",
        extra={"rows": _ORDERS},
    ),
)
def fixed_test_split(spark, sf_dir):
    out = ops.fixed_test_blocks(_orders(spark, sf_dir), ["site"], ["ts", "o_orderkey"], folds=3, share=0.2)
    return out.select("o_orderkey", "site", "fold")


@query(
    "loso_split",
    """SELECT l_suppkey AS test_site, CAST(sum(n) OVER () AS BIGINT) - n AS train_rows, n AS test_rows FROM
       (SELECT l_suppkey, count(*) AS n FROM lineitem
        GROUP BY 1 HAVING count(*) >= 580) s""",
)
def loso_split(spark, sf_dir):
    rows = b.table(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity")
    return ops.leave_one_site_out(rows, "l_suppkey", min_rows=580)[1]


_ORIGIN = """SELECT *, date_diff('microsecond', lo, ts) AS since, date_diff('microsecond', lo, hi) AS length,
    greatest((date_diff('microsecond', lo, hi) // 86400000000 - 37) // 11, 37) AS spacing FROM
    (SELECT *, min(ts) OVER () AS lo, max(ts) OVER () AS hi FROM rows) r"""
_WINDOWS = """SELECT *, CAST(w + 1 AS INTEGER) AS "window", CASE WHEN since - w * spacing * 86400000000 < 30 * 86400000000
    THEN 'train' ELSE 'test' END AS part FROM (SELECT *, since // (spacing * 86400000000) AS w FROM origin) o
    WHERE w < 12 AND (w * spacing + 37) * 86400000000 <= length AND since - w * spacing * 86400000000 < 37 * 86400000000"""


@query(
    "rolling_origin_split",
    b.with_cte(
        'SELECT o_orderkey, site, "window", part FROM placed', extra={"rows": _ORDERS, "origin": _ORIGIN, "placed": _WINDOWS}
    ),
)
def rolling_origin_split(spark, sf_dir):
    return ops.rolling_origin(_orders(spark, sf_dir), "ts").select("o_orderkey", "site", "window", "part")


_MODES = """SELECT "window", train_rows, test_rows, CAST(train_season AS INTEGER) AS train_season, CAST(test_season AS INTEGER) AS test_season,
    CAST(train_month AS INTEGER) AS train_month, CAST(test_month AS INTEGER) AS test_month, train_season <> test_season AS is_seasonal_transition
    FROM (SELECT "window", count(*) FILTER (WHERE part = 'train') AS train_rows, count(*) FILTER (WHERE part = 'test') AS test_rows
          FROM placed GROUP BY 1) n
    JOIN (SELECT "window", max(v) FILTER (WHERE part = 'train') AS train_season, max(v) FILTER (WHERE part = 'test') AS test_season FROM
          (SELECT "window", part, v, row_number() OVER (PARTITION BY "window", part ORDER BY count(*) DESC, v) AS rn FROM
           (SELECT "window", part, (month(ts) % 12) // 3 + 1 AS v FROM placed) a GROUP BY 1, 2, 3) c WHERE rn = 1 GROUP BY 1) s USING ("window")
    JOIN (SELECT "window", max(v) FILTER (WHERE part = 'train') AS train_month, max(v) FILTER (WHERE part = 'test') AS test_month FROM
          (SELECT "window", part, v, row_number() OVER (PARTITION BY "window", part ORDER BY count(*) DESC, v) AS rn FROM
           (SELECT "window", part, month(ts) AS v FROM placed) a GROUP BY 1, 2, 3) c WHERE rn = 1 GROUP BY 1) m USING ("window")
    WHERE train_rows >= 100 AND test_rows >= 10"""
_PLACED = {"rows": _ORDERS, "origin": _ORIGIN, "placed": _WINDOWS, "modes": _MODES}


def _profile(spark, sf_dir):
    return ops.window_profile(ops.rolling_origin(_orders(spark, sf_dir), "ts"), "ts")


@query("window_season_mode", b.with_cte("SELECT * FROM modes", extra=_PLACED))
def window_season_mode(spark, sf_dir):
    return _profile(spark, sf_dir)


@query(
    "window_season_coverage",
    b.with_cte(
        """SELECT test_season, count(*) AS windows, count(*) FILTER (WHERE is_seasonal_transition) AS transitions
        FROM modes GROUP BY 1""",
        extra=_PLACED,
    ),
)
def window_season_coverage(spark, sf_dir):
    return ops.season_coverage(_profile(spark, sf_dir))
