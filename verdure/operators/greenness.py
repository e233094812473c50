"""Summaries of a vegetation index table: site, date, index, collection, cloud cover."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdure.functions import calendar, codes
from verdure.functions.cuts import cut
from verdure.functions.greenness import (
    MAX_CLOUD,
    MISSIONS,
    hemisphere,
    mission_code,
    normalized_difference,
    vegetation_class,
    vegetation_class_report,
)
from verdure.operators.joins import lookup_join
from verdure.operators.stats import equal_width_cut, exact_quantiles, top_k

MONTHS = tuple(range(1, 13))
MONTH_NAMES = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def prepare(df: DataFrame, date: str = "date") -> DataFrame:
    """Parses the date and adds year, month and day of year."""
    day = F.to_date(F.col(date))
    return df.withColumn(date, day).withColumns(
        {"year": F.year(date), "month": F.month(date), "day_of_year": F.dayofyear(date)}
    )


def _spread(value: str) -> list[Column]:
    return [
        F.avg(value).alias(f"{value}_mean"),
        F.stddev_samp(value).alias(f"{value}_std"),
        F.count(value).alias(f"{value}_count"),
    ]


def grouped_stats(df: DataFrame, by: Sequence[str | Column], value: str = "ndvi") -> DataFrame:
    """Mean, sample deviation and count of the index per group."""
    return df.groupBy(*by).agg(*_spread(value))


def overview(df: DataFrame) -> DataFrame:
    """Size of the table: rows, sites, date range, missions, years and months covered."""
    # one row per combination, so that the distinct counts do not multiply the records
    cells = df.groupBy("site", "collection", F.year("date").alias("year"), F.month("date").alias("month")).agg(
        F.count(F.lit(1)).alias("n"), F.min("date").alias("first"), F.max("date").alias("last")
    )
    n, sites = F.sum("n"), F.countDistinct("site")
    return cells.agg(
        n.alias("records"),
        sites.alias("sites"),
        F.min("first").alias("first_date"),
        F.max("last").alias("last_date"),
        F.countDistinct("collection").alias("missions"),
        F.countDistinct("year").alias("years"),
        F.countDistinct("month").alias("months"),
        (n / sites).alias("records_per_site"),
    )


def global_stats(df: DataFrame) -> DataFrame:
    """Mean, median, range and deviation of the index; mean, median and maximum of cloud cover."""
    out = df.agg(
        F.avg("ndvi").alias("ndvi_mean"),
        F.min("ndvi").alias("ndvi_min"),
        F.max("ndvi").alias("ndvi_max"),
        F.stddev_samp("ndvi").alias("ndvi_std"),
        F.avg("cloud_cover").alias("cloud_mean"),
        F.max("cloud_cover").alias("cloud_max"),
    )
    # both columns are ranked in one pass
    long = df.unpivot([], ["ndvi", "cloud_cover"], "column", "value")
    medians = exact_quantiles(long, "value", [0.5], by=["column"], names=["median"]).agg(
        F.struct(
            F.max(F.when(F.col("column") == "ndvi", F.col("median"))).alias("ndvi_median"),
            F.max(F.when(F.col("column") == "cloud_cover", F.col("median"))).alias("cloud_median"),
        ).alias("m")
    )
    return out.withColumn("_m", medians.scalar()).select(*out.columns, "_m.*")


def quality_counts(df: DataFrame) -> DataFrame:
    """Records with a negative index, much cloud, little cloud or no index, with their shares."""
    n = F.count(F.lit(1))
    conditions = {
        "negative": F.col("ndvi") < 0,
        "cloudy": F.col("cloud_cover") > 50,
        "clear": F.col("cloud_cover") < 10,
        "missing": F.col("ndvi").isNull(),
    }
    out = [n.alias("records")]
    for name, condition in conditions.items():
        out += [
            F.count_if(condition).alias(f"{name}_count"),
            F.try_divide(F.count_if(condition) * F.lit(100.0), n).alias(f"{name}_percent"),
        ]
    return df.agg(*out)


def site_summary(df: DataFrame, digits: int = 3) -> DataFrame:
    """Index and cloud statistics and the date range per site, rounded half to even."""
    rounded = lambda c: F.bround(c, digits)
    return df.groupBy("site").agg(
        F.count("ndvi").alias("ndvi_count"),
        rounded(F.avg("ndvi")).alias("ndvi_mean"),
        rounded(F.stddev_samp("ndvi")).alias("ndvi_std"),
        rounded(F.min("ndvi")).alias("ndvi_min"),
        rounded(F.max("ndvi")).alias("ndvi_max"),
        rounded(F.avg("cloud_cover")).alias("cloud_cover_mean"),
        F.min("date").alias("date_min"),
        F.max("date").alias("date_max"),
    )


def support_rollup(counts: DataFrame, n: str, more_than: Sequence[int] = (10, 50)) -> DataFrame:
    """Distribution of rows per site and the sites above given sizes."""
    return counts.agg(
        F.count(F.lit(1)).alias("sites"),
        F.avg(n).alias("mean_rows"),
        F.min(n).alias("min_rows"),
        F.max(n).alias("max_rows"),
        *[F.count_if(F.col(n) > m).alias(f"sites_over_{m}") for m in more_than],
    )


def mission_stats(df: DataFrame, contains: str | None = None) -> DataFrame:
    """Index statistics and record count per mission, optionally of collections containing a text."""
    if contains is not None:
        df = df.where(F.col("collection").contains(contains))
    return df.groupBy(mission_code(F.col("collection")).alias("mission")).agg(
        *_spread("ndvi"), F.count(F.lit(1)).alias("records")
    )


def busiest_year(df: DataFrame) -> DataFrame:
    """Years with data and the year with most records (the earliest on ties)."""
    per_year = df.groupBy(F.year("date").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    return per_year.agg(
        F.count(F.lit(1)).alias("years"),
        F.max_by("year", F.struct(F.col("n"), -F.col("year"))).alias("busiest_year"),
        F.max("n").alias("records"),
    )


def class_counts(df: DataFrame, report: bool = False) -> DataFrame:
    """Records per vegetation class and their share of all records; records without index have no class."""
    classify = vegetation_class_report if report else vegetation_class
    classes = df.groupBy(classify(F.col("ndvi")).alias("veg_class")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # over the five classes, records without one included
    return classes.withColumn("percent", F.col("n") * F.lit(100.0) / total).where(F.col("veg_class").isNotNull())


def top_sites(df: DataFrame, k: int, site: str = "site") -> DataFrame:
    return top_k(df.groupBy(site).agg(F.count(F.lit(1)).alias("n")), "n", k, site)


def rows_of_top_sites(df: DataFrame, k: int, site: str = "site") -> DataFrame:
    """Rows of the k sites with most rows; the k names are broadcast."""
    return df.join(F.broadcast(top_sites(df, k, site).select(site)), site, "left_semi")


def cloud_bins(df: DataFrame) -> DataFrame:
    """Index statistics per cloud cover class; 0 and values above 100 fall outside."""
    label = cut(F.col("cloud_cover"), codes.CLOUD_EDGES, codes.CLOUD_LABELS)
    return grouped_stats(df.withColumn("cloud_bin", label).where("cloud_bin IS NOT NULL"), ["cloud_bin"])


def cloud_trend(df: DataFrame) -> DataFrame:
    """Least-squares line of the index over cloud cover."""
    return df.agg(
        F.regr_slope("ndvi", "cloud_cover").alias("slope"),
        F.regr_intercept("ndvi", "cloud_cover").alias("intercept"),
    )


def boxplot(df: DataFrame, by: str, value: str = "ndvi", reach: float = 1.5) -> DataFrame:
    """Quartiles and whiskers per group; whiskers are the extreme values within the fences."""
    quartiles = exact_quantiles(df, value, [0.25, 0.5, 0.75], by=[by], names=["q1", "median", "q3"])
    joined = lookup_join(df.where(F.col(value).isNotNull()).select(by, value), quartiles, [by], "inner", derived=True)
    margin = (F.col("q3") - F.col("q1")) * reach
    low, high = F.col("q1") - margin, F.col("q3") + margin
    inside = F.col(value).between(low, high)
    return joined.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"),
        F.max("q1").alias("q1"),
        F.max("median").alias("median"),
        F.max("q3").alias("q3"),
        F.min(F.when(inside, F.col(value))).alias("whisker_low"),
        F.max(F.when(inside, F.col(value))).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"),
    )


def attach_locations(summary: DataFrame, locations: DataFrame, how: str = "left") -> DataFrame:
    """Site coordinates with the index summary of each site; ``left`` keeps sites without one."""
    return lookup_join(locations, summary, ["site"], how, derived=True)


def latitude_bins(located: DataFrame, value: str, latitude: str = "latitude", bins: int = 10) -> DataFrame:
    """Statistics of site means over equal-width latitude bins with their midpoints."""
    placed = equal_width_cut(located, latitude, bins, "lat_bin")
    return placed.where(F.col("lat_bin").isNotNull()).groupBy("lat_bin").agg(
        F.max("lat_bin_mid").alias("lat_mid"), *_spread(value)
    )


def hemisphere_monthly(df: DataFrame, locations: DataFrame, latitude: str = "latitude") -> DataFrame:
    """Mean index per hemisphere and calendar month; sites without a location are left out."""
    sides = locations.select("site", hemisphere(F.col(latitude)).alias("hemisphere")).where("hemisphere IS NOT NULL")
    joined = lookup_join(df, sides, ["site"], "inner")
    return joined.groupBy("hemisphere", F.month("date").alias("month")).agg(F.avg("ndvi").alias("ndvi_mean"))


def geo_extent(locations: DataFrame, latitude: str = "latitude", longitude: str = "longitude") -> DataFrame:
    """Coordinate ranges and sites per hemisphere."""
    lat = F.col(latitude)
    n = F.count(F.lit(1))
    return locations.agg(
        n.alias("sites"),
        F.min(latitude).alias("lat_min"),
        F.max(latitude).alias("lat_max"),
        F.min(longitude).alias("lon_min"),
        F.max(longitude).alias("lon_max"),
        F.count_if(lat > 0).alias("northern"),
        F.count_if(lat <= 0).alias("southern"),
        F.try_divide(F.count_if(lat > 0) * F.lit(100.0), n).alias("northern_percent"),
        F.try_divide(F.count_if(lat <= 0) * F.lit(100.0), n).alias("southern_percent"),
    )


# Rough continent boxes as (west, east, south, north), inclusive west, east and south
# borders, exclusive north border, None for no limit. They overlap.
CONTINENTS = {
    "north_america": (-170, -50, 15, None),
    "south_america": (-85, -30, None, 15),
    "europe": (-15, 40, 35, None),
    "africa": (-20, 55, -35, 35),
    "asia": (40, 180, 10, None),
    "oceania": (110, 180, None, 10),
}


def continent_counts(locations: DataFrame, latitude: str = "latitude", longitude: str = "longitude") -> DataFrame:
    """Sites per continent box; a site inside two boxes counts twice."""
    picks = []
    for name, (west, east, south, north) in CONTINENTS.items():
        inside = F.col(longitude).between(west, east)
        if south is not None:
            inside = inside & (F.col(latitude) >= south)
        if north is not None:
            inside = inside & (F.col(latitude) < north)
        picks.append(F.count_if(inside).alias(name))
    return locations.agg(*picks)


def seasonal_heatmap(df: DataFrame) -> DataFrame:
    """Mean index per year with one column per ten days of the year."""
    placed = df.select(
        F.year("date").alias("year"), calendar.ten_day_bin(F.dayofyear("date")).alias("doy_bin"), "ndvi"
    )
    means = placed.groupBy("year", "doy_bin").agg(F.avg("ndvi").alias("mean"))
    picks = [F.max(F.when(F.col("doy_bin") == b, F.col("mean"))).alias(f"doy_{b}") for b in range(0, 370, 10)]
    return means.groupBy("year").agg(*picks)


def availability(df: DataFrame, k: int = 20) -> DataFrame:
    """Records per month of the k sites with most records, 0 for empty months."""
    month = F.month("date")
    picks = [F.count_if(month == m).alias(f"m{m}") for m in MONTHS]
    return top_k(df.groupBy("site").agg(*picks, F.count(F.lit(1)).alias("total")), "total", k, "site")


def month_values(df: DataFrame) -> DataFrame:
    """The index values of each calendar month period, one row per value.

    Gathering the values of a month into a list and unpacking it again gives the same rows, so the
    list is never built.
    """
    return df.select(F.trunc("date", "month").alias("month_start"), "ndvi")


def monthly_profile(df: DataFrame, k: int) -> DataFrame:
    """Twelve monthly means of each of the k largest sites; gaps take the mean of the site's months."""
    month = F.month("date")
    means = F.array(*[F.avg(F.when(month == m, F.col("ndvi"))) for m in MONTHS])
    per_site = rows_of_top_sites(df, k).groupBy("site").agg(means.alias("means"))
    known = F.filter("means", lambda m: m.isNotNull())
    total = F.aggregate(known, F.lit(0.0), lambda a, m: a + m)
    filled = per_site.select("site", F.posexplode("means"), F.try_divide(total, F.size(known)).alias("site_mean"))
    return filled.select("site", (F.col("pos") + 1).alias("month"), F.coalesce("col", "site_mean").alias("ndvi_mean"))


def coverage(df: DataFrame, k: int = 15) -> DataFrame:
    """First and last date, day span and records of the k sites with most records."""
    spans = df.groupBy("site").agg(
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.count("date").alias("n"),
        F.datediff(F.max("date"), F.min("date")).alias("span_days"),
    )
    return top_k(spans, "n", k, "site")


def missions_in_range(site_dates: DataFrame, first: str = "first_date", last: str = "last_date") -> DataFrame:
    """Missions in service during the years of each site's date range, one row per site and mission.

    Date columns may be texts starting with the year. The three missions are tested per row and the
    hits unpacked, so nothing is joined.
    """
    start, end = (F.substring(F.col(c).cast("string"), 1, 4).cast("int") for c in (first, last))
    hits = [
        F.when((start <= until) & (end >= since), F.struct(F.lit(name).alias("collection"), F.lit(nir).alias("nir_band"), F.lit(red).alias("red_band")))
        for name, since, until, nir, red in MISSIONS
    ]
    rows = site_dates.withColumn("_m", F.explode(F.array_compact(F.array(*hits))))
    return rows.select(*site_dates.columns, "_m.*")


def filter_scenes(
    scenes: DataFrame,
    site_dates: DataFrame,
    max_cloud: float = MAX_CLOUD,
    first: str = "first_date",
    last: str = "last_date",
) -> DataFrame:
    """Scenes of known sites within the site's date range (end excluded) and below the cloud limit."""
    ranges = site_dates.select("site", F.col(first).alias("_from"), F.col(last).alias("_to"))
    clear = scenes.where(F.col("cloud_cover") < max_cloud)
    joined = lookup_join(clear, ranges, ["site"], "inner", derived=True)
    inside = (F.col("date") >= F.col("_from")) & (F.col("date") < F.col("_to"))
    return joined.where(inside).select(*scenes.columns)


def zonal_mean(pixels: DataFrame, by: Sequence[str], nir: Column, red: Column, out: str = "ndvi") -> DataFrame:
    """Mean normalized difference of the pixels of each zone; pixels without a value are skipped."""
    return pixels.groupBy(*by).agg(F.avg(normalized_difference(nir, red)).alias(out))


def band_by_mission(collection: Column, band: str) -> Column:
    """Value of the ``nir`` or ``red`` band that the row's mission uses."""
    position = {"nir": 3, "red": 4}[band]
    out = F.lit(None).cast("double")
    for mission in MISSIONS:
        out = F.when(collection == mission[0], F.col(mission[position])).otherwise(out)
    return out
