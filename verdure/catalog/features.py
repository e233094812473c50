"""Queries over the lag, rolling and window features."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from verdure.catalog.registry import query, rounded
from verdure.functions import calendar, derived
from verdure.functions.clean import sanitize
from verdure.operators import align
from verdure.operators import features as ops
from verdure.operators.metadata import (
    add_columns,
    attach_plant_metadata,
    attach_site_metadata,
    auto_encode,
    derive_metadata,
    encode_known,
    first_per_key,
)
from verdure.plans import bindings as b
from verdure.plans.feature_table import add_time_features

_W = "PARTITION BY site, plant_id ORDER BY ts, event_id"


@query(
    "lag_features",
    b.with_cte(
        "SELECT site, plant_id, ts, event_id, ta, "
        + ", ".join(f"lag(ta, {k}) OVER w AS ta_lag_{k}h" for k in ops.LAGS)
        + ", "
        + ", ".join(f"CAST(NULL AS DOUBLE) AS rh_lag_{k}h" for k in ops.LAGS)
        + f" FROM series WINDOW w AS ({_W})",
        "series",
    ),
)
def lag_features(spark, sf_dir):
    return ops.lag_features(b.series(spark, sf_dir), b.SERIES, b.ORDER, drivers=("ta", "rh"))


def _rolling(function: str, stat: str) -> str:
    columns = ", ".join(
        f"round({function}(ta) OVER (w ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW), 6) AS ta_{stat}_{k}h"
        for k in ops.ROLLING_WIDTHS
    )
    return b.with_cte(f"SELECT site, plant_id, ts, event_id, ta, {columns} FROM series WINDOW w AS ({_W})", "series")


@query("rolling_mean", _rolling("avg", "mean"))
def rolling_mean(spark, sf_dir):
    out = ops.rolling_features(b.series(spark, sf_dir), b.SERIES, b.ORDER, drivers=("ta",), stats=("mean",))
    return rounded(out, *[f"ta_mean_{k}h" for k in ops.ROLLING_WIDTHS])


@query("rolling_std", _rolling("stddev_samp", "std"))
def rolling_std(spark, sf_dir):
    out = ops.rolling_features(b.series(spark, sf_dir), b.SERIES, b.ORDER, drivers=("ta",), stats=("std",))
    return rounded(out, *[f"ta_std_{k}h" for k in ops.ROLLING_WIDTHS])


_HOURS = (1, 6, 24)


@query(
    "rolling_mean_time",
    b.with_cte(
        "SELECT DISTINCT site, plant_id, ts, "
        + ", ".join(
            f"round(avg(ta) OVER (PARTITION BY site, plant_id ORDER BY ts RANGE BETWEEN INTERVAL {h * 3_600_000_000 - 1} "
            f"MICROSECONDS PRECEDING AND CURRENT ROW), 6) AS ta_mean_{h}h"
            for h in _HOURS
        )
        + " FROM series",
        "series",
    ),
)
def rolling_mean_time(spark, sf_dir):
    out = ops.rolling_mean_time(b.series(spark, sf_dir), b.SERIES, "ts", ["ta"], _HOURS)
    return rounded(out, *[f"ta_mean_{h}h" for h in _HOURS])


@query(
    "rolling_mean_time_range",
    b.with_cte(
        """SELECT * FROM (SELECT DISTINCT site, plant_id, ts, round(avg(ta) OVER (PARTITION BY site, plant_id ORDER BY ts RANGE
        BETWEEN INTERVAL 172799999999 MICROSECONDS PRECEDING AND CURRENT ROW), 6) AS ta_mean_48h FROM series) r
        WHERE ts >= TIMESTAMP '2024-01-11' AND ts < TIMESTAMP '2024-01-18'""",
        "series",
    ),
)
def rolling_mean_time_range(spark, sf_dir):
    week = {"since": datetime(2024, 1, 11), "until": datetime(2024, 1, 18)}
    return rounded(ops.rolling_mean_time(b.series(spark, sf_dir), b.SERIES, "ts", ["ta"], [48], **week), "ta_mean_48h")


@query(
    "rolling_std_time",
    b.with_cte(
        "SELECT DISTINCT site, plant_id, ts, "
        + ", ".join(
            f"round(stddev_samp(ta) OVER (PARTITION BY site, plant_id ORDER BY ts RANGE BETWEEN INTERVAL {h * 3_600_000_000 - 1} "
            f"MICROSECONDS PRECEDING AND CURRENT ROW), 6) AS ta_std_{h}h"
            for h in _HOURS
        )
        + " FROM series",
        "series",
    ),
)
def rolling_std_time(spark, sf_dir):
    out = ops.rolling_std_time(b.series(spark, sf_dir), b.SERIES, "ts", ["ta"], _HOURS)
    return rounded(out, *[f"ta_std_{h}h" for h in _HOURS])


@query(
    "lag_time",
    b.with_cte(
        "SELECT e.site, e.ts, "
        + ", ".join(f"round(l{k}.ta, 6) AS ta_lag_{k}h, l{k}.precip AS precip_lag_{k}h" for k in ops.LAGS)
        + ", CAST(NULL AS DOUBLE) AS rh_lag_1h FROM env e "
        + " ".join(f"LEFT JOIN env l{k} ON l{k}.site = e.site AND l{k}.ts = e.ts - INTERVAL {k} HOUR" for k in ops.LAGS),
        "env",
    ),
)
def lag_time(spark, sf_dir):
    out = ops.lag_time(b.env(spark, sf_dir), ["site"], "ts", ["ta", "precip", "rh"])
    lags = [f"{d}_lag_{k}h" for d in ("ta", "precip") for k in ops.LAGS]
    return rounded(out.select("site", "ts", *lags, "rh_lag_1h"), *lags)


@query(
    "rolling_slope",
    b.with_cte(
        """SELECT site, plant_id, ts, event_id, round(CASE WHEN count(ta) OVER f > 1 THEN regr_slope(ta, rn) OVER f END, 6)
        AS ta_slope_6h FROM (SELECT *, CAST(row_number() OVER (PARTITION BY site, plant_id ORDER BY ts, event_id) AS DOUBLE)
        AS rn FROM series) r
        WINDOW f AS (PARTITION BY site, plant_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)""",
        "series",
    ),
)
def rolling_slope(spark, sf_dir):
    out = ops.rolling_slope(b.series(spark, sf_dir), b.SERIES, b.ORDER, "ta", 6)
    return rounded(out.select("site", "plant_id", "ts", "event_id", "ta_slope_6h"), "ta_slope_6h")


@query(
    "long_lag_features",
    b.with_cte(
        f"""SELECT site, plant_id, ts, event_id, lag(ta, 48) OVER w AS ta_lag_48h, lag(ta, 72) OVER w AS ta_lag_72h,
        round(avg(ta) OVER (w ROWS BETWEEN 167 PRECEDING AND CURRENT ROW), 6) AS ta_mean_168h,
        round(stddev_samp(ta) OVER (w ROWS BETWEEN 167 PRECEDING AND CURRENT ROW), 6) AS ta_std_168h
        FROM series WINDOW w AS ({_W})""",
        "series",
    ),
)
def long_lag_features(spark, sf_dir):
    out = ops.series_features(
        b.series(spark, sf_dir), b.SERIES, b.ORDER, ("ta",), ("ta",), lags=(48, 72), widths=(168,)
    )
    return rounded(out.drop("ta"), "ta_mean_168h", "ta_std_168h")


_STEP = "PARTITION BY site ORDER BY ts"


@query(
    "precip_window",
    b.with_cte(
        f"""SELECT site, ts, precip, coalesce(lag(precip, 1) OVER ({_STEP}), 0) AS recent_precip_1h,
        sum(precip) OVER ({_STEP} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS recent_precip_6h,
        sum(precip) OVER ({_STEP} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS recent_precip_24h,
        round(precip / (sum(precip) OVER ({_STEP} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) + 1e-6), 6) AS precip_intensity
        FROM env""",
        "env",
    ),
)
def precip_window(spark, sf_dir):
    rain = b.env(spark, sf_dir).select("site", "ts", "precip")
    return rounded(ops.precipitation_features(rain, ["site"], ["ts"]), "precip_intensity")


@query(
    "relative_to_max",
    b.with_cte(
        """SELECT site, plant_id, ts, event_id, round(ta / (max(ta) OVER (PARTITION BY site) + 1e-6), 6) AS wind_stress
        FROM series""",
        "series",
    ),
)
def relative_to_max(spark, sf_dir):
    out = ops.relative_to_max(b.series(spark, sf_dir), ["site"], "ta", "wind_stress")
    return rounded(out.drop("ta"), "wind_stress")


@query(
    "temporal_features",
    """SELECT event_id, CAST(hour(ts) AS INTEGER) AS hour, CAST(dayofyear(ts) AS INTEGER) AS day_of_year,
       CAST(month(ts) AS INTEGER) AS month, CAST(year(ts) AS INTEGER) AS year,
       CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week,
       CAST(hour(ts) BETWEEN 6 AND 18 AS INTEGER) AS is_daylight,
       CAST(hour(ts) BETWEEN 10 AND 16 AS INTEGER) AS is_peak_sunlight,
       CAST(isodow(ts) >= 6 AS INTEGER) AS is_weekend FROM events""",
)
def temporal_features(spark, sf_dir):
    return add_time_features(b.table(spark, sf_dir, "events").select("event_id", "ts")).drop("ts")


_SOLAR = ("solar_hour_sin", "solar_hour_cos", "solar_day_sin", "solar_day_cos")


@query(
    "solar_cyclic",
    """SELECT event_id, CAST(hour(s) AS INTEGER) AS solar_hour, CAST(dayofyear(s) AS INTEGER) AS solar_day_of_year,
       round(sin(2 * pi() * hour(s) / 24), 6) AS solar_hour_sin, round(cos(2 * pi() * hour(s) / 24), 6) AS solar_hour_cos,
       round(sin(2 * pi() * dayofyear(s) / 365), 6) AS solar_day_sin, round(cos(2 * pi() * dayofyear(s) / 365), 6) AS solar_day_cos
       FROM (SELECT event_id, ts - INTERVAL 37 MINUTES AS s FROM events) e""",
)
def solar_cyclic(spark, sf_dir):
    rows = b.table(spark, sf_dir, "events").select(
        "event_id", (F.col("ts") - F.expr("INTERVAL 37 MINUTES")).alias("solar_ts")
    )
    return rounded(add_columns(rows, calendar.solar(F.col("solar_ts"))).drop("solar_ts"), *_SOLAR)


@query(
    "civil_cyclic",
    """SELECT event_id, round(sin(2 * pi() * hour(ts) / 24), 6) AS hour_sin, round(cos(2 * pi() * hour(ts) / 24), 6) AS hour_cos,
       round(sin(2 * pi() * dayofyear(ts) / 365), 6) AS day_sin, round(cos(2 * pi() * dayofyear(ts) / 365), 6) AS day_cos FROM events""",
)
def civil_cyclic(spark, sf_dir):
    rows = b.table(spark, sf_dir, "events").select("event_id", "ts")
    made = calendar.civil_cycles(F.col("ts"))
    return rounded(add_columns(rows, made).drop("ts"), *made)


@query(
    "season_of_month",
    """SELECT o_orderkey, CAST(CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 1 WHEN month(o_orderdate) IN (3, 4, 5) THEN 2
       WHEN month(o_orderdate) IN (6, 7, 8) THEN 3 ELSE 4 END AS INTEGER) AS season FROM orders""",
)
def season_of_month(spark, sf_dir):
    return b.table(spark, sf_dir, "orders").select("o_orderkey", calendar.season(F.month("o_orderdate")).alias("season"))


_LINE = "l_orderkey, l_linenumber, l_partkey"
_PLANT_JOIN = "FROM lineitem LEFT JOIN plant_md ON l_partkey = pl_code"


def _line_plants(spark, sf_dir, *extra):
    lines = b.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *extra)
    return attach_plant_metadata(lines, b.plant_md(spark, sf_dir), plant_id="l_partkey")


@query(
    "domain_features",
    b.with_cte(
        f"""SELECT {_LINE}, abs(l_quantity - 25) AS temp_deviation, round(ln(pl_dbh + 1), 6) AS tree_size_factor,
        round(pl_sapw_area / (pl_leaf_area + 1e-6), 3) AS sapwood_leaf_ratio,
        round(pl_sapw_area * l_discount / (l_tax + 1e-6), 3) AS transpiration_capacity {_PLANT_JOIN}""",
        "plant_md",
    ),
)
def domain_features(spark, sf_dir):
    drivers = (F.col("l_quantity").alias("ta"), F.col("l_tax").alias("vpd"), F.col("l_discount").alias("ppfd_in"))
    rows = _line_plants(spark, sf_dir, *drivers)
    out = add_columns(rows, derived.domain(rows.columns))
    out = rounded(out, "tree_size_factor")
    out = rounded(out, "sapwood_leaf_ratio", "transpiration_capacity", digits=3)
    return out.select(
        "l_orderkey", "l_linenumber", "l_partkey", "temp_deviation", "tree_size_factor", "sapwood_leaf_ratio",
        "transpiration_capacity",
    )


@query(
    "interaction_features",
    """SELECT l_orderkey, l_linenumber, round(vpd * ppfd_in, 6) AS vpd_ppfd_interaction,
       round(ta / (vpd + 1e-6), 3) AS temp_humidity_ratio, round(swc_shallow / (vpd + 1e-6), 3) AS water_stress_index,
       round(ppfd_in / (sw_in + 1e-6), 6) AS ppfd_efficiency, round(ppfd_in / (vpd + 1e-6), 3) AS stomatal_conductance_proxy,
       round(vpd * ppfd_in * ext_rad, 6) AS stomatal_control_index, round(ws * vpd, 6) AS wind_vpd_interaction,
       round(ppfd_in / (ext_rad + 1e-6), 6) AS light_efficiency
       FROM (SELECT l_orderkey, l_linenumber, l_quantity AS ta, l_tax AS vpd, l_discount AS ppfd_in,
             CAST(l_suppkey AS DOUBLE) + 1 AS sw_in, CAST(l_linenumber AS DOUBLE) AS ws, l_extendedprice AS ext_rad,
             CAST(l_partkey AS DOUBLE) AS swc_shallow FROM lineitem) d""",
)
def interaction_features(spark, sf_dir):
    c = F.col
    rows = b.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", c("l_quantity").alias("ta"), c("l_tax").alias("vpd"),
        c("l_discount").alias("ppfd_in"), (c("l_suppkey").cast("double") + 1).alias("sw_in"),
        c("l_linenumber").cast("double").alias("ws"), c("l_extendedprice").alias("ext_rad"),
        c("l_partkey").cast("double").alias("swc_shallow"),
    )
    made = derived.interactions(rows.columns)
    coarse = ("temp_humidity_ratio", "water_stress_index", "stomatal_conductance_proxy")
    out = add_columns(rows, made).select("l_orderkey", "l_linenumber", *made)
    return rounded(rounded(out, *[m for m in made if m not in coarse]), *coarse, digits=3)


@query(
    "size_age_class",
    b.with_cte(
        f"""SELECT {_LINE}, CASE WHEN pl_dbh <= 0 THEN NULL WHEN pl_dbh <= 10 THEN 'Sapling' WHEN pl_dbh <= 30 THEN 'Small'
        WHEN pl_dbh <= 50 THEN 'Medium' WHEN pl_dbh <= 100 THEN 'Large' WHEN pl_dbh <= 1000 THEN 'Very Large' END AS tree_size_class,
        CASE WHEN pl_age <= 0 THEN NULL WHEN pl_age <= 20 THEN 'Young' WHEN pl_age <= 50 THEN 'Mature' WHEN pl_age <= 100 THEN 'Old'
        WHEN pl_age <= 200 THEN 'Very Old' WHEN pl_age <= 1000 THEN 'Ancient' END AS tree_age_class {_PLANT_JOIN}""",
        "plant_md",
    ),
)
def size_age_class(spark, sf_dir):
    rows = _line_plants(spark, sf_dir)
    classes = derived.plant_classes(F.col("pl_dbh"), F.col("pl_age"))
    return add_columns(rows, classes).select("l_orderkey", "l_linenumber", "l_partkey", *classes)


@query(
    "attach_plant_metadata",
    b.with_cte(
        f"""SELECT {_LINE}, pl_age, pl_dbh, pl_height, pl_leaf_area, pl_social, pl_species, pl_sapw_area
        FROM lineitem LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pl_code ORDER BY pl_dbh DESC) AS rn FROM
          (SELECT * FROM plant_md UNION ALL SELECT pl_code, pl_dbh + 1 + pl_code % 3, pl_age, pl_height, pl_sapw_area,
           pl_leaf_area, pl_social, 'copy', pl_name FROM plant_md WHERE pl_code % 4 = 0) d) r WHERE rn = 1) p ON l_partkey = pl_code""",
        "plant_md",
    ),
)
def attach_plant(spark, sf_dir):
    plants = b.plant_md(spark, sf_dir)
    again = plants.where("pl_code % 4 = 0").withColumns(
        {"pl_dbh": F.col("pl_dbh") + 1 + F.col("pl_code") % 3, "pl_species": F.lit("copy")}
    )
    lines = b.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return attach_plant_metadata(lines, plants.unionByName(again), plant_id="l_partkey", order=["pl_dbh"])


_MD = "FROM stations LEFT JOIN site_md USING (site)"


@query(
    "attach_site_metadata",
    b.with_cte(
        f"""SELECT station, site, si_lat AS latitude, si_long AS longitude, si_mat AS mean_annual_temp,
        si_map AS mean_annual_precip, si_igbp AS igbp_class, env_time_zone AS timezone, env_timestep AS measurement_timestep {_MD}""",
        "stations",
        "site_md",
    ),
)
def attach_site(spark, sf_dir):
    return attach_site_metadata(b.stations(spark, sf_dir), b.site_md(spark, sf_dir))


_ZONE = "CASE WHEN si_lat <= -90 THEN NULL WHEN si_lat <= -23.5 THEN {} WHEN si_lat <= 23.5 THEN {} WHEN si_lat <= 90 THEN {} END"


@query(
    "climate_zone",
    b.with_cte(
        "SELECT station, site, "
        + _ZONE.format("'Temperate_South'", "'Tropical'", "'Temperate_North'")
        + " AS climate_zone, "
        + _ZONE.format("0e0", "1e0", "2e0")
        + f" AS climate_zone_code, abs(si_lat) AS latitude_abs {_MD}",
        "stations",
        "site_md",
    ),
)
def climate_zone(spark, sf_dir):
    rows = attach_site(spark, sf_dir)
    zones = derived.climate(F.col("latitude"))
    return add_columns(rows, zones).select("station", "site", *zones)


@query(
    "timezone_offset",
    b.with_cte(
        f"""SELECT station, CAST(nullif(regexp_extract(env_time_zone, '([+-]\\d{{2}})', 1), '') AS DOUBLE) AS timezone_offset {_MD}""",
        "stations",
        "site_md",
    ),
)
def timezone_offset(spark, sf_dir):
    rows = attach_site(spark, sf_dir)
    return rows.select("station", derived.utc_offset(F.col("timezone")).alias("timezone_offset"))


_IGBP = "CASE si_igbp WHEN 'SAV' THEN 9e0 WHEN 'DBF' THEN 4e0 WHEN 'EBF' THEN 2e0 WHEN 'ENF' THEN 1e0 END"
_SOCIAL = """CASE pl_social WHEN 'dominant' THEN 3e0 WHEN 'codominant' THEN 2e0 WHEN 'intermediate' THEN 1e0
    WHEN 'suppressed' THEN 0e0 END"""
_BOTH = """FROM lineitem LEFT JOIN plant_md ON l_partkey = pl_code JOIN supplier ON l_suppkey = s_suppkey
    JOIN nation ON s_nationkey = n_nationkey LEFT JOIN site_md ON site = n_name"""


def _described_lines(spark, sf_dir):
    rows = _line_plants(spark, sf_dir, "l_suppkey")
    suppliers = b.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    nations = b.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("site"))
    return attach_site_metadata(rows.join(suppliers.join(nations, "s_nationkey"), "l_suppkey"), b.site_md(spark, sf_dir))


@query(
    "derived_metadata",
    b.with_cte(
        f"""SELECT {_LINE}, round(si_map / nullif(si_mat + 10, 0), 6) AS aridity_index, {_IGBP} AS igbp_code,
        {_SOCIAL} AS social_status_code, round(pl_sapw_area / (pl_leaf_area + 1e-6), 3) AS sapwood_leaf_ratio,
        round(pl_dbh * pl_dbh * pl_height, 6) AS tree_volume_index, 60e0 / nullif(env_timestep, 0) AS measurement_frequency
        {_BOTH}""",
        "plant_md",
        "site_md",
    ),
)
def derived_metadata(spark, sf_dir):
    out = derive_metadata(_described_lines(spark, sf_dir)).select(
        "l_orderkey", "l_linenumber", "l_partkey", "aridity_index", "igbp_code", "social_status_code",
        "sapwood_leaf_ratio", "tree_volume_index", "measurement_frequency",
    )
    return rounded(rounded(out, "aridity_index", "tree_volume_index"), "sapwood_leaf_ratio", digits=3)


@query(
    "encode_dictionary",
    b.with_cte(
        f"SELECT {_LINE}, {_IGBP} AS igbp_class_code, {_SOCIAL} AS pl_social_code {_BOTH}", "plant_md", "site_md"
    ),
)
def encode_dictionary(spark, sf_dir):
    rows = _described_lines(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "igbp_class", "pl_social")
    return encode_known(rows)


@query(
    "auto_encode",
    b.with_cte(
        """SELECT o_orderkey, s.code AS o_orderstatus_code, p.code AS o_orderpriority_code, c.code AS clerk_code,
        CAST(o_custkey % 90 AS DOUBLE) AS shelf, q.code AS client_code, r.code AS ref_code, try_cast(ref AS DOUBLE) AS amount
        FROM texts t JOIN status s ON s.v = t.o_orderstatus JOIN priority p ON p.v = t.o_orderpriority
        JOIN clerks c ON c.v IS NOT DISTINCT FROM t.clerk JOIN clients q ON q.v IS NOT DISTINCT FROM t.client JOIN refs r ON r.v = t.ref""",
        extra={
            "texts": """SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority,
                CASE WHEN o_custkey % 61 > 0 THEN 'clerk ' || (o_custkey % 61) END AS clerk,
                CASE WHEN o_custkey % 101 > 0 THEN 'client ' || (o_custkey % 101) END AS client,
                CASE WHEN o_orderkey % 3 = 0 THEN 'x' || o_orderkey ELSE '' || o_orderkey END AS ref FROM orders""",
            **{
                name: f"""SELECT v, CAST(dense_rank() OVER (ORDER BY v NULLS LAST) - 1 AS DOUBLE) AS code
                    FROM (SELECT DISTINCT {column} AS v FROM texts) d"""
                for name, column in (
                    ("status", "o_orderstatus"), ("priority", "o_orderpriority"), ("clerks", "clerk"), ("clients", "client"), ("refs", "ref")
                )
            },
        },
    ),
)
def auto_encode_orders(spark, sf_dir):
    cust, key = F.col("o_custkey"), F.col("o_orderkey")
    rows = b.table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderstatus", "o_orderpriority",
        F.when(cust % 61 > 0, F.concat(F.lit("clerk "), (cust % 61).cast("string"))).alias("clerk"),
        (cust % 90).cast("string").alias("shelf"),
        F.when(cust % 101 > 0, F.concat(F.lit("client "), (cust % 101).cast("string"))).alias("client"),
        F.when(key % 3 == 0, F.concat(F.lit("x"), key.cast("string"))).otherwise(key.cast("string")).alias("ref"),
    )
    return auto_encode(rows.withColumn("amount", F.col("ref")), treat={"amount": "number"})


@query(
    "sanitize_values",
    """SELECT event_id, CASE WHEN event_id % 7 IN (0, 1) THEN NULL ELSE value END AS value,
       CASE WHEN event_id % 5 IN (1, 2, 3, 4) THEN NULL ELSE event_type END AS label FROM events""",
)
def sanitize_values(spark, sf_dir):
    key = F.col("event_id")
    rows = b.table(spark, sf_dir, "events").select(
        "event_id",
        F.when(key % 7 == 0, float("inf")).when(key % 7 == 1, float("-inf")).otherwise(F.col("value")).alias("value"),
        F.when(key % 5 == 1, "").when(key % 5 == 2, "nan").when(key % 5 == 3, "None").when(key % 5 == 4, "NULL")
        .otherwise(F.col("event_type")).alias("label"),
    )
    return sanitize(rows)


_KNOWN = {"ta": "value", "soil_depth": "CASE WHEN event_id % 2 = 0 THEN value END"}


@query(
    "align_schema",
    "SELECT event_id, event_type AS site, CAST(user_id AS DOUBLE) AS plant, "
    + ", ".join(f"{_KNOWN.get(c, 'CAST(NULL AS DOUBLE)')} AS {c}" for c in (*align.EXPECTED, *align.SPARSE))
    + " FROM events",
)
def align_schema(spark, sf_dir):
    rows = b.table(spark, sf_dir, "events").select(
        "event_id", F.col("event_type").alias("site"), F.col("user_id").cast("string").alias("plant"),
        F.col("value").alias("ta"), F.col("value").alias("netrad"), F.col("props").alias("pl_name"),
        F.when(F.col("event_id") % 2 == 0, F.col("value")).otherwise(float("inf")).alias("soil_depth"),
    )
    return align.align_schema(align.to_numbers(rows, ["plant"]))


@query(
    "feature_list",
    """SELECT 'ta' AS feature, count(l_quantity) AS n, round(avg(l_quantity), 6) AS mean FROM lineitem
       UNION ALL SELECT 'vpd', count(l_tax), round(avg(l_tax), 6) FROM lineitem
       UNION ALL SELECT 'stand_age', count(l_discount), round(avg(l_discount), 6) FROM lineitem""",
)
def feature_list(spark, sf_dir):
    c = F.col
    rows = b.table(spark, sf_dir, "lineitem").select(
        c("l_suppkey").alias("site"), c("l_shipdate").alias("TIMESTAMP"), c("l_extendedprice").alias("sap_flow"),
        c("l_quantity").alias("ta"), c("l_tax").alias("vpd"), c("l_discount").alias("stand_age"),
        c("l_linenumber").cast("double").alias("depth"), c("l_returnflag").alias("ta_flags"), c("l_linestatus").alias("env_md"),
    )
    chosen = align.priority_features(rows.columns, "sap_flow", above=3, cap=3)
    long = rows.select(*chosen).unpivot([], chosen, "feature", "value")
    return rounded(long.groupBy("feature").agg(F.count("value").alias("n"), F.avg("value").alias("mean")), "mean")


@query(
    "first_row_per_key",
    """SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM (SELECT *, row_number() OVER
       (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) r WHERE rn = 1""",
)
def first_row_per_key(spark, sf_dir):
    rows = b.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return first_per_key(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"])
