"""Queries run as incremental jobs; their tables are compared with the batch answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdure.catalog.registry import query, rounded
from verdure.plans import bindings as b
from verdure.plans.feature_table import add_time_features
from verdure.session import scratch_path
from verdure.streaming import jobs


def _arriving(spark, sf_dir):
    schema = b.table(spark, sf_dir, "events").schema
    return jobs.read_stream(spark, sf_dir, schema, files="events.parquet")


@query(
    "stream_features",
    b.with_cte(
        """SELECT site, s.event_id, s.plant_id, s.ts_raw AS ts, s.flow AS sap_flow, round(e.ta, 6) AS ta, e.sw_in,
        CAST(hour(s.ts_raw) AS INTEGER) AS hour, CAST(hour(s.ts_raw) BETWEEN 6 AND 18 AS INTEGER) AS is_daylight
        FROM (SELECT event_type AS site, event_id, user_id AS plant_id, ts AS ts_raw, date_trunc('hour', ts) AS ts, value AS flow FROM events) s
        JOIN env e USING (site, ts)""",
        "env",
    ),
)
def stream_features(spark, sf_dir):
    flow = _arriving(spark, sf_dir).select(
        F.col("event_type").alias("site"),
        "event_id",
        F.col("user_id").alias("plant_id"),
        "ts",
        b.hour_of("ts").alias("weather_hour"),
        F.col("value").alias("sap_flow"),
    )
    env = b.env(spark, sf_dir).select("site", F.col("ts").alias("weather_hour"), "ta", "sw_in")
    out, on = scratch_path(spark, "stream-features"), ("site", "weather_hour")
    # the weather of later days comes after the readings
    early = env.where(F.col("weather_hour") < F.lit("2024-01-12").cast("timestamp_ntz"))
    jobs.append_features(flow, early, out, scratch_path(spark, "progress"), add_time_features, on).awaitTermination()
    jobs.retry_waiting(env, out, add_time_features, on)
    saved = jobs.read_features(spark, out)
    return rounded(
        saved.select("site", "event_id", "plant_id", "ts", "sap_flow", "ta", "sw_in", "hour", "is_daylight"), "ta"
    )


@query(
    "stream_flag_rate",
    b.with_cte(
        """SELECT site, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, count(flag) AS total,
        count(*) FILTER (WHERE flag IN ('OUT_WARN', 'RANGE_WARN')) AS warn FROM flags GROUP BY 1, 2""",
        "flags",
    ),
)
def stream_flag_rate(spark, sf_dir):
    value = F.col("value")
    flags = _arriving(spark, sf_dir).select(
        F.col("event_type").alias("site"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(value > 100, "OUT_WARN").when(value < 1, "RANGE_WARN").when(F.col("event_id") % 4 == 0, "OK").alias("flag"),
    )
    out = scratch_path(spark, "stream-flags")
    jobs.daily_flag_counts(flags, out, scratch_path(spark, "progress")).awaitTermination()
    return jobs.latest_flag_counts(spark, out).withColumn("day", F.col("day").cast("timestamp_ntz"))
