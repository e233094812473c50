"""The given tables seen as the domain tables the operators work on.

Each binding exists twice: as a DataFrame for Spark and as the body of a common table expression
for the reference answer in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ORDER = ("ts", "event_id")
SERIES = ("site", "plant_id")


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; its schema is read from the footers once and then remembered."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def hour_of(ts: str | Column) -> Column:
    return F.date_trunc("hour", ts).cast("timestamp_ntz")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sensor series per site and plant."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("site"),
        F.col("user_id").alias("plant_id"),
        "ts",
        "event_id",
        F.col("value").alias("ta"),
    )


def flow_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly wide flow table with two trees per site."""
    tree = F.col("user_id") % 2
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.col("event_type").alias("site"), hour_of("ts").alias("ts"))
        .agg(
            F.avg(F.when(tree == 0, F.col("value"))).alias("tree_1"),
            F.avg(F.when(tree == 1, F.col("value"))).alias("tree_2"),
        )
    )


def env(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly weather per site."""
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.col("event_type").alias("site"), hour_of("ts").alias("ts"))
        .agg(
            F.avg("value").alias("ta"),
            F.max("value").alias("sw_in"),
            F.min("value").alias("vpd"),
            F.count(F.lit(1)).cast("double").alias("precip"),
        )
    )


def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long flag table, null for cells without a flag."""
    value = F.col("value")
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("site"),
        F.when(F.col("user_id") % 3 == 0, "env").otherwise("sapf").alias("kind"),
        hour_of("ts").alias("ts"),
        F.when(F.col("user_id") % 2 == 0, "tree_1").otherwise("tree_2").alias("col_name"),
        F.when(value > 100, "OUT_WARN")
        .when(value < 1, "RANGE_WARN")
        .when(F.col("event_id") % 4 == 0, "OK")
        .alias("flag"),
    )


def site_md(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Site metadata, one row per nation."""
    key = F.col("n_nationkey")
    igbp = (
        F.when(F.col("n_regionkey") == 0, "SAV")
        .when(F.col("n_regionkey") == 1, "DBF")
        .when(F.col("n_regionkey") == 2, "EBF")
        .when(F.col("n_regionkey") == 3, "ENF")
    )
    return table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("site"),
        (key * 7.0 - 84.0).alias("si_lat"),
        (key * 14.0 - 170.0).alias("si_long"),
        F.when(key % 6 != 0, key * 1.0 - 10.0).alias("si_mat"),
        (key * 90.0).alias("si_map"),
        igbp.alias("si_igbp"),
        F.when(key % 2 == 0, "1UTC+01:00").otherwise("5UTC-05:00").alias("env_time_zone"),
        F.when(key % 5 == 0, 0).otherwise(30).alias("env_timestep"),
    )


def plant_md(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plant metadata, one row per part."""
    size = F.col("p_size")
    social = (
        F.when(size % 5 == 0, "dominant")
        .when(size % 5 == 1, "codominant")
        .when(size % 5 == 2, "intermediate")
        .when(size % 5 == 3, "suppressed")
    )
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("pl_code"),
        (size * 2.5).alias("pl_dbh"),
        ((F.col("p_retailprice") - 900.0) * 3).alias("pl_age"),
        (size * 0.6).alias("pl_height"),
        (size * 1.5).alias("pl_sapw_area"),
        F.when(size % 7 == 0, 0.0).otherwise(size * 0.9).alias("pl_leaf_area"),
        social.alias("pl_social"),
        F.col("p_brand").alias("pl_species"),
        F.col("p_type").alias("pl_name"),
    )


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One station per customer, standing in the site of its nation."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("station"), "c_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("site"))
    return customers.join(nations, customers.c_nationkey == nations.n_nationkey).select("station", "site")


def ndvi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scene table: near infrared = discount, red = tax."""
    lines = table(spark, sf_dir, "lineitem")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    nir, red = F.col("l_discount"), F.col("l_tax")
    flag = F.col("l_returnflag")
    collection = (
        F.when(flag == "A", "LANDSAT/LT05/C02/T1_L2")
        .when(flag == "N", "LANDSAT/LE07/C02/T1_L2")
        .otherwise("LANDSAT/LC08/C02/T1_L2")
    )
    sites = suppliers.join(nations, suppliers.s_nationkey == nations.n_nationkey)
    return lines.join(sites, lines.l_suppkey == sites.s_suppkey).select(
        F.col("n_name").alias("site"),
        F.col("l_shipdate").cast("date").alias("date"),
        F.try_divide(nir - red, nir + red).alias("ndvi"),
        collection.alias("collection"),
        F.col("l_quantity").alias("cloud_cover"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persistence forecast of the sensor series: the value of the row before."""
    from verdure.operators.features import lag_features

    lagged = lag_features(series(spark, sf_dir), SERIES, ORDER, drivers=("ta",), lags=(1,))
    return lagged.where(F.col("ta_lag_1h").isNotNull()).select(
        "site", "ts", F.col("ta").alias("actual"), F.col("ta_lag_1h").alias("predicted")
    )


# The same bindings as common table expressions.
CTE = {
    "series": "SELECT event_type AS site, user_id AS plant_id, ts, event_id, value AS ta FROM events",
    "flow_wide": """SELECT event_type AS site, date_trunc('hour', ts) AS ts,
        avg(CASE WHEN user_id % 2 = 0 THEN value END) AS tree_1,
        avg(CASE WHEN user_id % 2 = 1 THEN value END) AS tree_2
        FROM events GROUP BY event_type, date_trunc('hour', ts)""",
    "env": """SELECT event_type AS site, date_trunc('hour', ts) AS ts, avg(value) AS ta,
        max(value) AS sw_in, min(value) AS vpd, CAST(count(*) AS DOUBLE) AS precip
        FROM events GROUP BY event_type, date_trunc('hour', ts)""",
    "flags": """SELECT event_type AS site, CASE WHEN user_id % 3 = 0 THEN 'env' ELSE 'sapf' END AS kind,
        date_trunc('hour', ts) AS ts, CASE WHEN user_id % 2 = 0 THEN 'tree_1' ELSE 'tree_2' END AS col_name,
        CASE WHEN value > 100 THEN 'OUT_WARN' WHEN value < 1 THEN 'RANGE_WARN'
             WHEN event_id % 4 = 0 THEN 'OK' END AS flag
        FROM events""",
    "site_md": """SELECT n_name AS site, n_nationkey * 7.0e0 - 84.0e0 AS si_lat, n_nationkey * 14.0e0 - 170.0e0 AS si_long,
        CASE WHEN n_nationkey % 6 <> 0 THEN n_nationkey * 1.0e0 - 10.0e0 END AS si_mat,
        n_nationkey * 90.0e0 AS si_map,
        CASE n_regionkey WHEN 0 THEN 'SAV' WHEN 1 THEN 'DBF' WHEN 2 THEN 'EBF' WHEN 3 THEN 'ENF' END AS si_igbp,
        CASE WHEN n_nationkey % 2 = 0 THEN '1UTC+01:00' ELSE '5UTC-05:00' END AS env_time_zone,
        CASE WHEN n_nationkey % 5 = 0 THEN 0 ELSE 30 END AS env_timestep
        FROM nation""",
    "plant_md": """SELECT p_partkey AS pl_code, p_size * 2.5e0 AS pl_dbh, (p_retailprice - 900.0e0) * 3 AS pl_age,
        p_size * 0.6e0 AS pl_height, p_size * 1.5e0 AS pl_sapw_area,
        CASE WHEN p_size % 7 = 0 THEN 0.0e0 ELSE p_size * 0.9e0 END AS pl_leaf_area,
        CASE p_size % 5 WHEN 0 THEN 'dominant' WHEN 1 THEN 'codominant' WHEN 2 THEN 'intermediate'
                        WHEN 3 THEN 'suppressed' END AS pl_social,
        p_brand AS pl_species, p_type AS pl_name FROM part""",
    "stations": """SELECT c_custkey AS station, n_name AS site
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "ndvi": """SELECT n_name AS site, CAST(l_shipdate AS DATE) AS date,
        (l_discount - l_tax) / NULLIF(l_discount + l_tax, 0) AS ndvi,
        CASE l_returnflag WHEN 'A' THEN 'LANDSAT/LT05/C02/T1_L2' WHEN 'N' THEN 'LANDSAT/LE07/C02/T1_L2'
                          ELSE 'LANDSAT/LC08/C02/T1_L2' END AS collection,
        l_quantity AS cloud_cover
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey""",
    "predictions": """SELECT * FROM (
        SELECT site, ts, ta AS actual,
               lag(ta, 1) OVER (PARTITION BY site, plant_id ORDER BY ts, event_id) AS predicted
        FROM (SELECT event_type AS site, user_id AS plant_id, ts, event_id, value AS ta FROM events) s) p
        WHERE predicted IS NOT NULL""",
}


def with_cte(body: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """``body`` preceded by the named bindings and any further expressions, in order."""
    parts = [f"{n} AS ({CTE[n]})" for n in names]
    parts += [f"{n} AS ({sql})" for n, sql in (extra or {}).items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body
