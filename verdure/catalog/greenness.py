"""Queries over the vegetation index table."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdure.catalog.registry import query, rounded
from verdure.functions.greenness import mission_code
from verdure.operators import greenness as ops
from verdure.operators import reshape
from verdure.operators.splits import supported_sites
from verdure.operators.stats import histogram
from verdure.plans import bindings as b
from verdure.session import scratch_path
from verdure.sources.stations import read_greenness

_STATS = "round(avg(ndvi), 6) AS ndvi_mean, round(stddev_samp(ndvi), 6) AS ndvi_std, count(ndvi) AS ndvi_count"


def _sql(body: str, *more: str, **extra: str) -> str:
    return b.with_cte(body, "ndvi", *more, extra=extra)


def _stats(df):
    return rounded(df, "ndvi_mean", "ndvi_std")


def _locations(spark, sf_dir):
    return b.site_md(spark, sf_dir).select("site", F.col("si_lat").alias("latitude"), F.col("si_long").alias("longitude"))


@query(
    "ndvi_prepare",
    _sql(
        """SELECT site, date, round(ndvi, 6) AS ndvi, collection, cloud_cover, CAST(year(date) AS INTEGER) AS year,
        CAST(month(date) AS INTEGER) AS month, CAST(dayofyear(date) AS INTEGER) AS day_of_year FROM ndvi"""
    ),
)
def ndvi_prepare(spark, sf_dir):
    path = scratch_path(spark, "ndvi-csv")
    b.ndvi(spark, sf_dir).write.option("header", "true").csv(path)
    return rounded(read_greenness(spark, path), "ndvi")


@query(
    "ndvi_global_stats",
    _sql(
        """SELECT round(avg(ndvi), 6) AS ndvi_mean, round(min(ndvi), 6) AS ndvi_min, round(max(ndvi), 6) AS ndvi_max,
        round(stddev_samp(ndvi), 6) AS ndvi_std, round(avg(cloud_cover), 6) AS cloud_mean, max(cloud_cover) AS cloud_max,
        round(quantile_cont(ndvi, 0.5), 6) AS ndvi_median, round(quantile_cont(cloud_cover, 0.5), 6) AS cloud_median FROM ndvi"""
    ),
)
def ndvi_global_stats(spark, sf_dir):
    out = ops.global_stats(b.ndvi(spark, sf_dir))
    return rounded(out, *[c for c in out.columns if c != "cloud_max"])


@query(
    "ndvi_overview",
    _sql(
        """SELECT count(*) AS records, count(DISTINCT site) AS sites, min(date) AS first_date, max(date) AS last_date,
        count(DISTINCT collection) AS missions, count(DISTINCT year(date)) AS years, count(DISTINCT month(date)) AS months,
        round(count(*) / count(DISTINCT site), 6) AS records_per_site FROM ndvi"""
    ),
)
def ndvi_overview(spark, sf_dir):
    return rounded(ops.overview(b.ndvi(spark, sf_dir)), "records_per_site")


@query(
    "site_ndvi_summary",
    _sql(
        """SELECT site, count(ndvi) AS ndvi_count, round_even(avg(ndvi), 3) AS ndvi_mean, round_even(stddev_samp(ndvi), 3) AS ndvi_std,
        round_even(min(ndvi), 3) AS ndvi_min, round_even(max(ndvi), 3) AS ndvi_max,
        round_even(avg(cloud_cover), 3) AS cloud_cover_mean, min(date) AS date_min, max(date) AS date_max FROM ndvi GROUP BY site"""
    ),
)
def site_ndvi_summary(spark, sf_dir):
    return ops.site_summary(b.ndvi(spark, sf_dir))


@query(
    "site_support_rollup",
    """SELECT count(*) AS sites, round(avg(n), 6) AS mean_rows, min(n) AS min_rows, max(n) AS max_rows,
       count(*) FILTER (WHERE n > 10) AS sites_over_10, count(*) FILTER (WHERE n > 30) AS sites_over_30
       FROM (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey) c""",
)
def site_support_rollup(spark, sf_dir):
    counts = b.table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))
    return rounded(ops.support_rollup(counts, "n", (10, 30)), "mean_rows")


@query(
    "min_support",
    "SELECT l_partkey AS site, count(*) AS n FROM lineitem GROUP BY l_partkey HAVING count(*) >= 32",
)
def min_support(spark, sf_dir):
    rows = b.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("site"))
    return supported_sites(rows, min_rows=32)


@query("monthly_stats", _sql(f"SELECT CAST(month(date) AS INTEGER) AS month, {_STATS} FROM ndvi GROUP BY 1"))
def monthly_stats(spark, sf_dir):
    return _stats(ops.grouped_stats(b.ndvi(spark, sf_dir), [F.month("date").alias("month")]))


@query("annual_stats", _sql(f"SELECT CAST(year(date) AS INTEGER) AS year, {_STATS} FROM ndvi GROUP BY 1"))
def annual_stats(spark, sf_dir):
    return _stats(ops.grouped_stats(b.ndvi(spark, sf_dir), [F.year("date").alias("year")]))


@query(
    "busiest_year",
    _sql(
        """SELECT count(*) AS years, CAST(arg_max(year, n * 10000 - year) AS INTEGER) AS busiest_year, max(n) AS records
        FROM (SELECT year(date) AS year, count(*) AS n FROM ndvi GROUP BY 1) y"""
    ),
)
def busiest_year(spark, sf_dir):
    return ops.busiest_year(b.ndvi(spark, sf_dir))


_QUALITY = {
    "negative": "ndvi < 0",
    "cloudy": "cloud_cover > 50",
    "clear": "cloud_cover < 10",
    "missing": "ndvi IS NULL",
}


@query(
    "ndvi_quality_counts",
    _sql(
        "SELECT count(*) AS records, "
        + ", ".join(
            f"count(*) FILTER (WHERE {c}) AS {n}_count, round(count(*) FILTER (WHERE {c}) * 100.0e0 / count(*), 6) AS {n}_percent"
            for n, c in _QUALITY.items()
        )
        + " FROM ndvi"
    ),
)
def ndvi_quality_counts(spark, sf_dir):
    return rounded(ops.quality_counts(b.ndvi(spark, sf_dir)), *[f"{n}_percent" for n in _QUALITY])


def _classes(case: str) -> str:
    return _sql(
        f"""SELECT veg_class, count(*) AS n, round(count(*) * 100.0e0 / max(total), 6) AS percent
        FROM (SELECT CASE {case} END AS veg_class, count(*) OVER () AS total FROM ndvi) c
        WHERE veg_class IS NOT NULL GROUP BY veg_class"""
    )


@query(
    "veg_classes",
    _classes(
        "WHEN ndvi < 0.1 THEN 'Water/Bare' WHEN ndvi < 0.3 THEN 'Sparse' WHEN ndvi < 0.5 THEN 'Dense' WHEN ndvi >= 0.5 THEN 'Very Dense'"
    ),
)
def veg_classes(spark, sf_dir):
    return rounded(ops.class_counts(b.ndvi(spark, sf_dir)), "percent")


@query(
    "veg_classes_report",
    _classes(
        "WHEN ndvi < 0.1 THEN 'bare' WHEN ndvi < 0.3 THEN 'sparse' WHEN ndvi <= 0.5 THEN 'moderate' WHEN ndvi > 0.5 THEN 'dense'"
    ),
)
def veg_classes_report(spark, sf_dir):
    return rounded(ops.class_counts(b.ndvi(spark, sf_dir), report=True), "percent")


@query("top_sites", "SELECT l_partkey AS site, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, site LIMIT 10")
def top_sites(spark, sf_dir):
    return ops.top_sites(b.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("site")), 10)


@query(
    "top_site_series",
    _sql(
        """SELECT site, date, round(ndvi, 6) AS ndvi FROM ndvi WHERE site IN
        (SELECT site FROM ndvi GROUP BY site ORDER BY count(*) DESC, site LIMIT 5)"""
    ),
)
def top_site_series(spark, sf_dir):
    rows = ops.rows_of_top_sites(b.ndvi(spark, sf_dir), 5)
    return rounded(rows.select("site", "date", "ndvi"), "ndvi").orderBy("site", "date")


@query(
    "mission_stats",
    _sql(
        f"""SELECT nullif(regexp_extract(collection, '(L[ECT]\\d+)', 1), '') AS mission, {_STATS}, count(*) AS records
        FROM ndvi WHERE contains(collection, 'C02/T1') GROUP BY 1"""
    ),
)
def mission_stats(spark, sf_dir):
    return _stats(ops.mission_stats(b.ndvi(spark, sf_dir), contains="C02/T1"))


@query(
    "cloud_bins",
    _sql(
        f"""SELECT * FROM (SELECT CASE WHEN cloud_cover <= 0 THEN NULL WHEN cloud_cover <= 5 THEN '0-5%' WHEN cloud_cover <= 10 THEN '5-10%'
        WHEN cloud_cover <= 20 THEN '10-20%' WHEN cloud_cover <= 50 THEN '20-50%' WHEN cloud_cover <= 100 THEN '50-100%' END AS cloud_bin,
        {_STATS} FROM ndvi GROUP BY 1) c WHERE cloud_bin IS NOT NULL"""
    ),
)
def cloud_bins(spark, sf_dir):
    return _stats(ops.cloud_bins(b.ndvi(spark, sf_dir)))


@query(
    "cloud_trend",
    _sql(
        """SELECT round(regr_slope(ndvi, cloud_cover), 9) AS slope, round(regr_intercept(ndvi, cloud_cover), 6) AS intercept
        FROM ndvi"""
    ),
)
def cloud_trend(spark, sf_dir):
    return rounded(rounded(ops.cloud_trend(b.ndvi(spark, sf_dir)), "intercept"), "slope", digits=9)


@query(
    "ndvi_histogram",
    """SELECT bin, count(*) AS n, round(max(lo + (bin - 1) * (hi - lo) / 50), 6) AS bin_start
       FROM (SELECT lo, hi, CAST(least(floor((v - lo) / ((hi - lo) / 50.0)) + 1, 50) AS INTEGER) AS bin
             FROM (SELECT l_extendedprice AS v, min(l_extendedprice) OVER () AS lo, max(l_extendedprice) OVER () AS hi
                   FROM lineitem) x) y GROUP BY bin""",
)
def ndvi_histogram(spark, sf_dir):
    # prices instead of the index, whose few distinct values lie on bin edges
    return rounded(histogram(b.table(spark, sf_dir, "lineitem"), "l_extendedprice", 50), "bin_start")


@query(
    "monthly_boxplot",
    """SELECT month, n, q1, median, q3, whisker_low, whisker_high, outliers FROM (
       SELECT m AS month, count(*) AS n, round(max(a), 6) AS q1, round(max(c), 6) AS median, round(max(d), 6) AS q3,
       min(v) FILTER (WHERE v BETWEEN a - 1.5 * (d - a) AND d + 1.5 * (d - a)) AS whisker_low,
       max(v) FILTER (WHERE v BETWEEN a - 1.5 * (d - a) AND d + 1.5 * (d - a)) AS whisker_high,
       count(*) FILTER (WHERE NOT v BETWEEN a - 1.5 * (d - a) AND d + 1.5 * (d - a)) AS outliers
       FROM (SELECT CAST(month(l_shipdate) AS INTEGER) AS m, l_extendedprice AS v FROM lineitem) r
       JOIN (SELECT CAST(month(l_shipdate) AS INTEGER) AS m, quantile_cont(l_extendedprice, 0.25) AS a,
             quantile_cont(l_extendedprice, 0.5) AS c, quantile_cont(l_extendedprice, 0.75) AS d FROM lineitem GROUP BY 1) q USING (m)
       GROUP BY m) z""",
)
def monthly_boxplot(spark, sf_dir):
    rows = b.table(spark, sf_dir, "lineitem").select(F.month("l_shipdate").alias("month"), F.col("l_extendedprice").alias("v"))
    return rounded(ops.boxplot(rows, "month", "v"), "q1", "median", "q3")


_LOCATED = "SELECT site, si_lat AS latitude, si_long AS longitude, s.* EXCLUDE (site) FROM site_md LEFT JOIN s USING (site)"
_SUMMARY = f"SELECT site, {_STATS} FROM ndvi WHERE site <> 'NATION_3' GROUP BY site"


def _summary(spark, sf_dir):
    rows = b.ndvi(spark, sf_dir).where("site <> 'NATION_3'")
    return _stats(ops.grouped_stats(rows, ["site"]))


@query("ndvi_geo_join", _sql(_LOCATED, "site_md", s=_SUMMARY))
def ndvi_geo_join(spark, sf_dir):
    return ops.attach_locations(_summary(spark, sf_dir), _locations(spark, sf_dir))


@query(
    "ndvi_geo_join_inner",
    _sql(_LOCATED.replace("LEFT JOIN", "JOIN"), "site_md", s=_SUMMARY),
)
def ndvi_geo_join_inner(spark, sf_dir):
    return ops.attach_locations(_summary(spark, sf_dir), _locations(spark, sf_dir), "inner")


_AT = """SELECT c_custkey AS station, c_acctbal / 120 AS latitude, c_acctbal / 60 - 5 AS longitude FROM customer"""


def _station_locations(spark, sf_dir):
    """Stations with coordinates of their own, taken from account balances."""
    money = F.col("c_acctbal")
    return b.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("station"), (money / 120).alias("latitude"), (money / 60 - 5).alias("longitude")
    )


@query(
    "lat_bins",
    b.with_cte(
        """SELECT lat_bin, round(max((lo + (lat_bin - 1) * w - CASE WHEN lat_bin = 1 THEN (hi - lo) * 0.001 ELSE 0 END + lo + lat_bin * w) / 2), 6)
        AS lat_mid, round(avg(longitude), 6) AS longitude_mean, round(stddev_samp(longitude), 6) AS longitude_std, count(longitude) AS longitude_count
        FROM (SELECT *, CAST(least(greatest(ceil((latitude - lo) / w), 1), 10) AS INTEGER) AS lat_bin FROM
          (SELECT *, (hi - lo) / 10.0 AS w FROM (SELECT *, min(latitude) OVER () AS lo, max(latitude) OVER () AS hi FROM spots) a) c) d
        GROUP BY lat_bin""",
        extra={"spots": _AT},
    ),
)
def lat_bins(spark, sf_dir):
    out = ops.latitude_bins(_station_locations(spark, sf_dir), "longitude")
    return rounded(out, "lat_mid", "longitude_mean", "longitude_std")


@query(
    "hemisphere_monthly",
    _sql(
        """SELECT CASE WHEN si_lat > 0 THEN 'Northern' ELSE 'Southern' END AS hemisphere, CAST(month(date) AS INTEGER) AS month,
        round(avg(ndvi), 6) AS ndvi_mean FROM ndvi JOIN site_md USING (site) GROUP BY 1, 2""",
        "site_md",
    ),
)
def hemisphere_monthly(spark, sf_dir):
    return rounded(ops.hemisphere_monthly(b.ndvi(spark, sf_dir), _locations(spark, sf_dir)), "ndvi_mean")


@query(
    "geo_extent",
    b.with_cte(
        """SELECT count(*) AS sites, round(min(latitude), 6) AS lat_min, round(max(latitude), 6) AS lat_max,
        round(min(longitude), 6) AS lon_min, round(max(longitude), 6) AS lon_max,
        count(*) FILTER (WHERE latitude > 0) AS northern, count(*) FILTER (WHERE latitude <= 0) AS southern,
        round(count(*) FILTER (WHERE latitude > 0) * 100.0e0 / count(*), 6) AS northern_percent,
        round(count(*) FILTER (WHERE latitude <= 0) * 100.0e0 / count(*), 6) AS southern_percent FROM spots""",
        extra={"spots": _AT},
    ),
)
def geo_extent(spark, sf_dir):
    out = ops.geo_extent(_station_locations(spark, sf_dir))
    return rounded(out, "lat_min", "lat_max", "lon_min", "lon_max", "northern_percent", "southern_percent")


@query(
    "continent_counts",
    b.with_cte(
        """SELECT count(*) FILTER (WHERE longitude BETWEEN -170 AND -50 AND latitude >= 15) AS north_america,
        count(*) FILTER (WHERE longitude BETWEEN -85 AND -30 AND latitude < 15) AS south_america,
        count(*) FILTER (WHERE longitude BETWEEN -15 AND 40 AND latitude >= 35) AS europe,
        count(*) FILTER (WHERE longitude BETWEEN -20 AND 55 AND latitude >= -35 AND latitude < 35) AS africa,
        count(*) FILTER (WHERE longitude BETWEEN 40 AND 180 AND latitude >= 10) AS asia,
        count(*) FILTER (WHERE longitude BETWEEN 110 AND 180 AND latitude < 10) AS oceania FROM spots""",
        extra={"spots": _AT.replace("c_acctbal / 60 - 5", "c_acctbal / 32 - 130")},
    ),
)
def continent_counts(spark, sf_dir):
    at = _station_locations(spark, sf_dir).withColumn("longitude", F.col("latitude") * 120 / 32 - 130)
    return ops.continent_counts(at)


@query(
    "seasonal_heatmap",
    _sql(
        "SELECT CAST(year(date) AS INTEGER) AS year, "
        + ", ".join(
            f"round(avg(ndvi) FILTER (WHERE dayofyear(date) // 10 * 10 = {d}), 6) AS doy_{d}" for d in range(0, 370, 10)
        )
        + " FROM ndvi GROUP BY 1"
    ),
)
def seasonal_heatmap(spark, sf_dir):
    out = ops.seasonal_heatmap(b.ndvi(spark, sf_dir))
    return rounded(out, *[c for c in out.columns if c != "year"])


@query(
    "availability_matrix",
    "SELECT l_suppkey AS site, "
    + ", ".join(f"count(*) FILTER (WHERE month(l_shipdate) = {m}) AS m{m}" for m in ops.MONTHS)
    + ", count(*) AS total FROM lineitem GROUP BY 1 ORDER BY total DESC, site LIMIT 20",
)
def availability_matrix(spark, sf_dir):
    rows = b.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("site"), F.col("l_shipdate").alias("date"))
    return ops.availability(rows)


@query(
    "month_list_explode",
    _sql("SELECT CAST(date_trunc('month', date) AS DATE) AS month_start, round(ndvi, 6) AS ndvi FROM ndvi"),
)
def month_list_explode(spark, sf_dir):
    return rounded(ops.month_values(b.ndvi(spark, sf_dir)), "ndvi")


@query(
    "monthly_profile_filled",
    b.with_cte(
        """SELECT site, CAST(month AS INTEGER) AS month, round(coalesce(m, avg(m) OVER (PARTITION BY site)), 6) AS ndvi_mean
        FROM (SELECT site, unnest(range(1, 13)) AS month FROM top) s
        LEFT JOIN (SELECT site, month(date) AS month, avg(ndvi) AS m FROM rows GROUP BY 1, 2) x USING (site, month)""",
        extra={
            "rows": """SELECT l_partkey AS site, l_shipdate AS date, l_quantity AS ndvi FROM lineitem""",
            "top": "SELECT site FROM rows GROUP BY site ORDER BY count(*) DESC, site LIMIT 6",
        },
    ),
)
def monthly_profile_filled(spark, sf_dir):
    rows = b.table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("site"), F.col("l_shipdate").alias("date"), F.col("l_quantity").alias("ndvi")
    )
    return rounded(ops.monthly_profile(rows, 6), "ndvi_mean")


@query(
    "coverage_timeline",
    """SELECT l_suppkey AS site, min(d) AS first_date, max(d) AS last_date, count(*) AS n,
       CAST(max(d) - min(d) AS INTEGER) AS span_days FROM (SELECT l_suppkey, CAST(l_shipdate AS DATE) AS d FROM lineitem) x
       GROUP BY 1 ORDER BY n DESC, site LIMIT 15""",
)
def coverage_timeline(spark, sf_dir):
    rows = b.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("site"), F.to_date("l_shipdate").alias("date"))
    return ops.coverage(rows)


def _order_dates(spark, sf_dir, site):
    return b.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias(site)).agg(
        F.min("o_orderdate").alias("first_date"), F.max("o_orderdate").alias("last_date")
    )


@query(
    "mission_overlap",
    """SELECT site, first_date, last_date, collection, nir_band, red_band FROM
       (SELECT o_custkey AS site, min(o_orderdate) AS first_date, max(o_orderdate) AS last_date FROM orders GROUP BY 1) d
       JOIN (VALUES ('LANDSAT/LT05/C02/T1_L2', 1984, 2013, 'SR_B4', 'SR_B3'), ('LANDSAT/LE07/C02/T1_L2', 1999, 2021, 'SR_B4', 'SR_B3'),
             ('LANDSAT/LC08/C02/T1_L2', 2013, 2023, 'SR_B5', 'SR_B4')) m(collection, since, until, nir_band, red_band)
       ON year(first_date) <= until AND year(last_date) >= since""",
)
def mission_overlap(spark, sf_dir):
    return ops.missions_in_range(_order_dates(spark, sf_dir, "site"))


_DATES_SQL = """SELECT n_name AS site, min(o_orderdate) + INTERVAL 400 DAY AS lo, max(o_orderdate) - INTERVAL 300 DAY AS hi
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1"""


@query(
    "scene_filter",
    _sql(
        """SELECT n.site, n.date, round(ndvi, 6) AS ndvi, collection, cloud_cover FROM ndvi n JOIN dates d ON n.site = d.site
        AND n.date >= CAST(lo AS DATE) AND n.date < CAST(hi AS DATE) WHERE cloud_cover < 20""",
        dates=_DATES_SQL,
    ),
)
def scene_filter(spark, sf_dir):
    customers = b.stations(spark, sf_dir).withColumnRenamed("station", "o_custkey")
    dates = (
        b.table(spark, sf_dir, "orders")
        .join(customers, "o_custkey")
        .groupBy("site")
        .agg(
            F.date_add(F.min("o_orderdate").cast("date"), 400).alias("first_date"),
            F.date_sub(F.max("o_orderdate").cast("date"), 300).alias("last_date"),
        )
    )
    return rounded(ops.filter_scenes(b.ndvi(spark, sf_dir), dates), "ndvi")


_PIXELS = """SELECT l_suppkey AS site, CAST(date_trunc('month', l_shipdate) AS DATE) AS scene,
    CASE l_returnflag WHEN 'A' THEN 'LANDSAT/LT05/C02/T1_L2' WHEN 'N' THEN 'LANDSAT/LE07/C02/T1_L2'
                      ELSE 'LANDSAT/LC08/C02/T1_L2' END AS collection,
    l_tax AS "SR_B3", l_discount AS "SR_B4", l_quantity AS "SR_B5" FROM lineitem"""


def _pixels(spark, sf_dir):
    flag = F.col("l_returnflag")
    collection = F.when(flag == "A", "LANDSAT/LT05/C02/T1_L2").when(flag == "N", "LANDSAT/LE07/C02/T1_L2")
    return b.table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("site"),
        F.trunc("l_shipdate", "month").alias("scene"),
        collection.otherwise("LANDSAT/LC08/C02/T1_L2").alias("collection"),
        F.col("l_tax").alias("SR_B3"),
        F.col("l_discount").alias("SR_B4"),
        F.col("l_quantity").alias("SR_B5"),
    )


@query(
    "zonal_mean_nd",
    b.with_cte(
        """SELECT site, scene, collection, round(avg((nir - red) / nullif(nir + red, 0)), 6) AS ndvi FROM
        (SELECT site, scene, collection, CASE WHEN contains(collection, 'LC08') THEN "SR_B5" ELSE "SR_B4" END AS nir,
         CASE WHEN contains(collection, 'LC08') THEN "SR_B4" ELSE "SR_B3" END AS red FROM pixels) p GROUP BY 1, 2, 3""",
        extra={"pixels": _PIXELS},
    ),
)
def zonal_mean_nd(spark, sf_dir):
    collection = F.col("collection")
    out = ops.zonal_mean(
        _pixels(spark, sf_dir),
        ["site", "scene", "collection"],
        ops.band_by_mission(collection, "nir"),
        ops.band_by_mission(collection, "red"),
    )
    return rounded(out, "ndvi")


@query(
    "zonal_mean_sentinel",
    """SELECT l_suppkey AS site, CAST(date_trunc('month', l_shipdate) AS DATE) AS scene,
       round(avg((l_quantity - l_linenumber) / nullif(l_quantity + l_linenumber, 0)), 6) AS ndvi
       FROM lineitem WHERE l_discount * 1000 < 20 GROUP BY 1, 2""",
)
def zonal_mean_sentinel(spark, sf_dir):
    pixels = b.table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("site"),
        F.trunc("l_shipdate", "month").alias("scene"),
        F.col("l_quantity").alias("B8"),
        F.col("l_linenumber").alias("B4"),
        (F.col("l_discount") * 1000).alias("cloudy_pixels"),
    )
    clear = pixels.where(F.col("cloudy_pixels") < ops.MAX_CLOUD)
    return rounded(ops.zonal_mean(clear, ["site", "scene"], F.col("B8"), F.col("B4")), "ndvi")


@query(
    "mission_union",
    _sql(
        f"""SELECT collection, {_STATS}, count(band) AS bands FROM (
        SELECT collection, ndvi, NULL AS band FROM ndvi WHERE collection LIKE '%LT05%' UNION ALL
        SELECT collection, ndvi, NULL FROM ndvi WHERE collection LIKE '%LE07%' UNION ALL
        SELECT collection, ndvi, 'SR_B5' FROM ndvi WHERE collection LIKE '%LC08%') u GROUP BY collection"""
    ),
)
def mission_union(spark, sf_dir):
    rows = b.ndvi(spark, sf_dir)
    parts = [rows.where(mission_code(F.col("collection")) == m).select("collection", "ndvi") for m in ("LT05", "LE07")]
    newest = rows.where(mission_code(F.col("collection")) == "LC08")
    parts.append(newest.select("collection", "ndvi", F.lit("SR_B5").alias("band")))
    merged = reshape.union_all(parts)
    return _stats(
        merged.groupBy("collection").agg(
            F.avg("ndvi").alias("ndvi_mean"),
            F.stddev_samp("ndvi").alias("ndvi_std"),
            F.count("ndvi").alias("ndvi_count"),
            F.count("band").alias("bands"),
        )
    )


@query(
    "primary_site",
    """SELECT l_orderkey, 'P' || l_partkey AS "primary", 3 AS n_members, 'S' || l_suppkey AS second FROM lineitem""",
)
def primary_site(spark, sf_dir):
    text = F.concat(F.lit(" P"), "l_partkey", F.lit(" ,S"), "l_suppkey", F.lit(", L"), "l_linenumber")
    rows = b.table(spark, sf_dir, "lineitem").select("l_orderkey", text.alias("sites"))
    out = reshape.split_list(rows, "sites")
    return out.select("l_orderkey", "primary", F.size("members").alias("n_members"), F.element_at("members", 2).alias("second"))


@query(
    "flatten_properties",
    "SELECT event_id, event_type AS site, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events",
)
def flatten_properties(spark, sf_dir):
    rows = b.table(spark, sf_dir, "events").select(
        "event_id", F.col("event_type").alias("site"), F.from_json("props", "k int").alias("properties")
    )
    return reshape.flatten(rows, "properties", ["event_id", "site"])
