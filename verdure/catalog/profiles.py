"""Queries over file sources, sinks and profiles."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from verdure.catalog.registry import query, rounded
from verdure.operators import align, features, reshape
from verdure.operators import profile as ops
from verdure.plans import bindings as b
from verdure.plans import feature_table
from verdure.session import scratch_path
from verdure.sources import files, sinks, stations


def _flow_long(spark, sf_dir):
    return reshape.melt(b.flow_wide(spark, sf_dir), ["site", "ts"], None, "plant_id", "sap_flow")


def _archive(spark, sf_dir, kinds=("env", "sapf"), compress: bool = False):
    """A station archive written from the events table: weather and flow files per site."""
    root = scratch_path(spark, "archive")
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("TIMESTAMP")
    solar = F.date_format(F.col("ts") + F.expr("INTERVAL 20 MINUTES"), "yyyy-MM-dd HH:mm:ss").alias("TIMESTAMP_solar")
    if "env" in kinds:
        env = b.env(spark, sf_dir).select("site", stamp, solar, "ta", "sw_in", F.col("vpd").alias("netrad"), "precip")
        sinks.write_station_files(env, root, "env", compress=compress)
    if "sapf" in kinds:
        flow = b.flow_wide(spark, sf_dir).select("site", stamp, "tree_1", "tree_2")
        # files differ in the place of their time column, and some have row numbers in a column without a name
        late = F.col("site") < "h"
        sinks.write_station_files(flow.where(~late), root, "sapf", compress=compress)
        numbered = flow.where(late).select("site", F.lit(7).alias(" "), "tree_2", "TIMESTAMP", "tree_1")
        sinks.write_station_files(numbered, root, "sapf", compress=compress)
    return root


@query(
    "site_catalog",
    """SELECT DISTINCT event_type AS site, kind, 'data' AS part FROM events, (VALUES ('env'), ('sapf')) k(kind)""",
)
def site_catalog(spark, sf_dir):
    return stations.site_catalog(spark, _archive(spark, sf_dir)).select("site", "kind", "part")


@query(
    "csv_scan_roundtrip",
    b.with_cte(
        """SELECT site, ts, 'tree_1' AS plant_id, round(tree_1, 6) AS sap_flow FROM flow_wide
        UNION ALL SELECT site, ts, 'tree_2', round(tree_2, 6) FROM flow_wide""",
        "flow_wide",
    ),
)
def csv_scan_roundtrip(spark, sf_dir):
    root = _archive(spark, sf_dir, ["sapf"], compress=True)
    return rounded(stations.read_long(spark, root, "sapf", "data", "plant_id", "sap_flow"), "sap_flow")


@query(
    "ingest_env",
    b.with_cte(
        """SELECT site, ts, ts + INTERVAL 20 MINUTES AS solar_ts, round(ta, 6) AS ta, round(sw_in, 6) AS sw_in, precip,
        CAST(NULL AS DOUBLE) AS rh FROM env""",
        "env",
    ),
)
def ingest_env(spark, sf_dir):
    rows = stations.read_wide(spark, _archive(spark, sf_dir, ["env"]), "env", ["ta", "sw_in", "netrad", "precip", "rh"])
    return rounded(rows, "ta", "sw_in")


@query(
    "libsvm_roundtrip",
    """SELECT feature, round(sum(v), 4) AS total, count(*) AS n, round(sum(label), 4) AS label_total FROM (
       SELECT 0 AS feature, coalesce(CASE WHEN l_linenumber > 2 THEN l_quantity END, 0) AS v, l_extendedprice AS label FROM lineitem WHERE l_tax > 0
       UNION ALL SELECT 1, l_discount, l_extendedprice FROM lineitem WHERE l_tax > 0
       UNION ALL SELECT 2, l_tax, l_extendedprice FROM lineitem WHERE l_tax > 0
       UNION ALL SELECT 3, 0, l_extendedprice FROM lineitem WHERE l_tax > 0) x GROUP BY feature""",
)
def libsvm_roundtrip(spark, sf_dir):
    lines = b.table(spark, sf_dir, "lineitem")
    rows = lines.select(
        F.col("l_suppkey").alias("site"),
        F.when(F.col("l_tax") > 0, F.col("l_extendedprice")).alias("sap_flow"),
        F.when(F.col("l_linenumber") > 2, F.col("l_quantity")).alias("ta"),
        F.col("l_discount").alias("vpd"),
        F.col("l_tax").alias("rh"),
        F.col("l_returnflag").alias("ta_flags"),
    )
    features = ["ta", "vpd", "rh", "soil_depth"]  # the last one is absent and written as 0
    paths = []
    for part in (0, 1):
        paths.append(scratch_path(spark, "libsvm"))
        sinks.write_libsvm(rows.where(F.pmod("site", F.lit(2)) == part), paths[-1], "sap_flow", features)
    both = sinks.read_libsvm(spark, paths, len(features))
    cells = both.select("label", F.posexplode(vector_to_array("features")).alias("feature", "v"))
    out = cells.groupBy("feature").agg(
        F.sum("v").alias("total"), F.count(F.lit(1)).alias("n"), F.sum("label").alias("label_total")
    )
    return rounded(out, "total", "label_total", digits=4)


@query(
    "libsvm_line_check",
    """SELECT kind, kind IN (0, 4) AS is_valid, count(*) AS n FROM
       (SELECT CAST(l_linenumber % 5 AS INTEGER) AS kind FROM lineitem) k GROUP BY 1, 2""",
)
def libsvm_line_check(spark, sf_dir):
    good = F.concat_ws(" ", "l_quantity", F.concat(F.lit("1:"), "l_tax"), F.concat(F.lit("2:"), "l_discount"))
    kind = F.col("l_linenumber") % 5
    text = (
        F.when(kind == 1, F.concat(good, F.lit(" 3")))
        .when(kind == 2, F.concat(F.lit("x"), good))
        .when(kind == 3, F.concat(good, F.lit(" a:1")))
        .when(kind == 4, F.lit("  "))
        .otherwise(good)
    )
    path = scratch_path(spark, "lines")
    b.table(spark, sf_dir, "lineitem").select(kind.alias("kind"), text.alias("value")).write.partitionBy("kind").text(path)
    checked = sinks.libsvm_line_check(spark.read.text(path))
    return checked.groupBy("kind", "is_valid").agg(F.count(F.lit(1)).alias("n"))


@query(
    "null_profile",
    b.with_cte(
        """SELECT c AS "column", nulls, round(nulls * 100.0e0 / n, 6) AS percent FROM (
        SELECT count(*) AS n, count(*) - count(site) AS a, count(*) - count(date) AS b, count(*) - count(ndvi) AS c1,
               count(*) - count(collection) AS d, count(*) - count(cloud_cover) AS e FROM ndvi) x,
        LATERAL (VALUES ('site', a), ('date', b), ('ndvi', c1), ('collection', d), ('cloud_cover', e)) v(c, nulls)""",
        "ndvi",
    ),
)
def null_profile(spark, sf_dir):
    return rounded(ops.null_profile(b.ndvi(spark, sf_dir)), "percent")


@query(
    "inf_profile",
    """SELECT 'value' AS "column", count(*) FILTER (WHERE event_id % 9 IN (0, 1)) AS infinities FROM events
       UNION ALL SELECT 'other', 0""",
)
def inf_profile(spark, sf_dir):
    key = F.col("event_id") % 9
    rows = b.table(spark, sf_dir, "events").select(
        "event_id",
        F.when(key == 0, float("inf")).when(key == 1, float("-inf")).otherwise(F.col("value")).alias("value"),
        F.col("value").alias("other"),
    )
    return ops.infinity_profile(rows)


@query(
    "string_profile",
    """SELECT 'event_type' AS "column", count(DISTINCT event_type) AS distinct_values,
       (SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT event_type AS v FROM events) d) AS listed_values FROM events
       UNION ALL SELECT 'props', count(DISTINCT props), NULL FROM events""",
)
def string_profile(spark, sf_dir):
    return ops.string_profile(b.table(spark, sf_dir, "events"))


@query(
    "target_describe",
    b.with_cte(
        """SELECT count(ndvi) AS n, round(avg(ndvi), 6) AS mean, round(stddev_samp(ndvi), 6) AS std, round(min(ndvi), 6) AS min,
        round(max(ndvi), 6) AS max, count(*) - count(ndvi) AS missing FROM ndvi""",
        "ndvi",
    ),
)
def target_describe(spark, sf_dir):
    return rounded(ops.describe(b.ndvi(spark, sf_dir), "ndvi"), "mean", "std", "min", "max")


@query(
    "type_profile",
    """SELECT type, count(*) AS n_columns, string_agg(column_name, '|' ORDER BY column_name) AS columns FROM
       (SELECT column_name, CASE column_type WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'INTEGER' THEN 'int'
        ELSE lower(column_type) END AS type FROM (DESCRIBE events)) d GROUP BY type""",
)
def type_profile(spark, sf_dir):
    return ops.type_profile(b.table(spark, sf_dir, "events"))


@query(
    "dataset_profile",
    """SELECT site, count(*) AS n_rows, CASE WHEN site < 'h' THEN 4 WHEN site < 's' THEN 5 ELSE 3 END AS n_columns, site < 's' AS has_target,
       true AS has_timestamp, true AS has_site, CASE WHEN site < 'h' OR site >= 's' THEN '' ELSE 'netrad|pl_name' END AS reported_columns,
       CASE WHEN site < 'h' OR site >= 's' THEN '' ELSE 'pl_name' END AS text_columns
       FROM (SELECT event_type AS site FROM events) e GROUP BY site""",
)
def dataset_profile(spark, sf_dir):
    path = scratch_path(spark, "dataset")
    rows = b.series(spark, sf_dir).select("site", "plant_id", F.col("ts").alias("TIMESTAMP"), F.col("ta").alias("sap_flow"))
    # three schemas side by side: two of parquet files, one of CSV files
    sinks.write_parquet(rows.where("site < 'h'"), path)
    second = rows.where("site >= 'h' AND site < 's'").withColumn("pl_name", F.lit("x"))
    sinks.write_parquet(second.withColumnRenamed("plant_id", "netrad"), path, mode="append")
    sinks.write_csv(rows.where("site >= 's'").drop("sap_flow"), path, mode="append")
    out = ops.dataset_profile(spark, path)
    # large sites are written as several files
    site = F.regexp_extract("file", "site=([^/]+)", 1).alias("site")
    flags = ("has_target", "has_timestamp", "has_site")
    return out.groupBy(site).agg(
        F.sum("n_rows").alias("n_rows"),
        F.max("n_columns").cast("int").alias("n_columns"),
        *[F.every(f).alias(f) for f in flags],
        *[F.max(c).alias(c) for c in ("reported_columns", "text_columns")],
    )


def _site_md(spark, sf_dir):
    """Invented metadata of the sites; every value follows from the length of the site's name."""
    n = F.length("site")
    number = lambda c: c.cast("double")
    return b.env(spark, sf_dir).select("site").distinct().select(
        "site",
        number(n * 12 - 72).alias("si_lat"),
        number(n * 10).alias("si_long"),
        number(n * 100).alias("si_elev"),
        number(n - 5).alias("si_mat"),
        number(n * 90).alias("si_map"),
        F.when(n == 8, "Boreal Forests/Taiga").alias("si_biome"),
        F.when(n == 4, "SAV").when(n == 5, "DBF").when(n == 6, "EBF").alias("si_igbp"),
        F.when(n == 5, "AUS").otherwise("ESP").alias("si_country"),
        F.when(n != 6, F.upper("site")).alias("si_name"),
        number(n * 10).alias("st_age"),
        number(n + 1).alias("st_lai"),
        F.when(n == 5, "evergreen").alias("sp_leaf_habit"),
        number(n).alias("sp_ntrees"),
        F.when(n == 4, 0.0).otherwise(30.0).alias("env_timestep"),
        F.when(n == 5, "5UTC+01:00").otherwise("UTC").alias("env_time_zone"),
    )


def _plant_md(spark):
    rows = [("tree_1", 20.0, 60.0, 5.0, 3.5, 20.0, 2.5, "dominant", "Abies"), ("tree_2", 40.0, 120.0, 9.0, 0.0, 35.0, None, "suppressed", None)]
    names = "pl_code string, pl_dbh double, pl_age double, pl_height double, pl_leaf_area double, pl_sapw_area double, pl_sapw_depth double"
    return spark.createDataFrame(rows, f"{names}, pl_social string, pl_species string")


def _features(spark, sf_dir, described: bool = True):
    env = b.env(spark, sf_dir).withColumn("ppfd_in", F.col("sw_in") + 1).withColumn("solar_ts", F.col("ts") + F.expr("INTERVAL 20 MINUTES"))
    flow = _flow_long(spark, sf_dir)
    if not described:
        return feature_table.build(flow, env)
    flags = b.flags(spark, sf_dir)
    of = lambda kind: flags.where(F.col("kind") == kind)
    return feature_table.build(flow, env, _site_md(spark, sf_dir), _plant_md(spark), of("sapf"), of("env"))


# The feature lists say which columns there are; what a column holds is written out below.
_DRIVERS = ("ta", "sw_in", "vpd", "precip", "ppfd_in")
_WINDOWED = {
    **{
        f"{d}_lag_{k}h": f"lag({d}, {k}) OVER w" if d in _DRIVERS else "CAST(NULL AS DOUBLE)"
        for d in features.LAG_DRIVERS
        for k in features.LAGS
    },
    **{
        f"{d}_{name}_{k}h": f"{function}({d}) OVER (w ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)" if d in _DRIVERS else "CAST(NULL AS DOUBLE)"
        for d in features.ROLLING_DRIVERS
        for k in features.ROLLING_WIDTHS
        for name, function in (("mean", "avg"), ("std", "stddev_samp"))
    },
}
_FORMULAS = {
    "hour": "hour(ts)", "day_of_year": "dayofyear(ts)", "month": "month(ts)", "year": "year(ts)", "day_of_week": "isodow(ts) - 1",
    "is_daylight": "CAST(hour(ts) BETWEEN 6 AND 18 AS INTEGER)", "is_peak_sunlight": "CAST(hour(ts) BETWEEN 10 AND 16 AS INTEGER)",
    "is_weekend": "CAST(isodow(ts) >= 6 AS INTEGER)", "solar_hour": "hour(solar_ts)", "solar_day_of_year": "dayofyear(solar_ts)",
    "solar_hour_sin": "sin(hour(solar_ts) * 2 * pi() / 24)", "solar_hour_cos": "cos(hour(solar_ts) * 2 * pi() / 24)",
    "solar_day_sin": "sin(dayofyear(solar_ts) * 2 * pi() / 365)", "solar_day_cos": "cos(dayofyear(solar_ts) * 2 * pi() / 365)",
    "latitude": "n * 12.0e0 - 72", "longitude": "n * 10.0e0", "elevation": "n * 100.0e0", "mean_annual_temp": "n - 5.0e0",
    "mean_annual_precip": "n * 90.0e0", "stand_age": "n * 10.0e0", "leaf_area_index": "n + 1.0e0", "n_trees": "n + 0.0e0",
    "measurement_timestep": "CASE WHEN n = 4 THEN 0.0e0 ELSE 30.0e0 END", "measurement_frequency": "CASE WHEN n <> 4 THEN 2.0e0 END",
    "latitude_abs": "abs(n * 12.0e0 - 72)",
    "climate_zone_code": "CASE WHEN n * 12 - 72 <= -23.5 THEN 0.0e0 WHEN n * 12 - 72 <= 23.5 THEN 1.0e0 ELSE 2.0e0 END",
    "aridity_index": "n * 90.0e0 / (n + 5)", "biome_code": "CASE WHEN n = 8 THEN 6.0e0 END", "leaf_habit_code": "CASE WHEN n = 5 THEN 3.0e0 END",
    "igbp_code": "CASE n WHEN 4 THEN 9.0e0 WHEN 5 THEN 4.0e0 WHEN 6 THEN 2.0e0 END",
    "igbp_class_code": "CASE n WHEN 4 THEN 9.0e0 WHEN 5 THEN 4.0e0 WHEN 6 THEN 2.0e0 END",
    "country_code": "CASE WHEN n = 5 THEN 2.0e0 ELSE 11.0e0 END", "timezone_offset": "CASE WHEN n = 5 THEN 1.0e0 END",
    "timezone_code": "CASE WHEN n = 5 THEN 0.0e0 ELSE 1.0e0 END",
    "site_name_code": "CASE WHEN n = 6 THEN 0.0e0 + named ELSE place END",
    "pl_dbh": "k * 20.0e0", "pl_age": "k * 60.0e0", "pl_height": "k * 4.0e0 + 1", "pl_leaf_area": "CASE k WHEN 1 THEN 3.5e0 ELSE 0.0e0 END",
    "pl_sapw_area": "k * 15.0e0 + 5", "pl_sapw_depth": "CASE k WHEN 1 THEN 2.5e0 END",
    "pl_social_code": "CASE k WHEN 1 THEN 3.0e0 ELSE 0.0e0 END", "social_status_code": "CASE k WHEN 1 THEN 3.0e0 ELSE 0.0e0 END",
    "pl_species_code": "k - 1.0e0", "tree_size_class_code": "k + 0.0e0", "tree_age_class_code": "k + 1.0e0",
    "tree_volume_index": "(k * 20) ** 2 * (k * 4.0e0 + 1)", "tree_size_factor": "ln(k * 20.0e0 + 1)", "temp_deviation": "abs(ta - 25)",
    "sapwood_leaf_ratio": "(k * 15 + 5) / (CASE k WHEN 1 THEN 3.5e0 ELSE 0.0e0 END + 1e-6)",
    "transpiration_capacity": "(k * 15 + 5) * ppfd_in / (vpd + 1e-6)",
}
_ABSENT = [c for c in (*align.EXPECTED, *align.SPARSE) if c not in (*_DRIVERS, *_FORMULAS)]
_IDS = ("site", "ts", "plant_id", "solar_ts")


def _digits(name: str) -> int:
    """Means of values with few decimals end in a 5 after six digits, deviations and ratios differ after those."""
    return 2 if name in ("sapwood_leaf_ratio", "transpiration_capacity") else 9 if "_mean_" in name else 6


def _features_sql() -> str:
    columns = {"sap_flow": "sap_flow", **{d: d for d in _DRIVERS}, **_WINDOWED, **_FORMULAS, **dict.fromkeys(_ABSENT, "CAST(NULL AS DOUBLE)")}
    whole = {"hour", "day_of_year", "month", "year", "day_of_week", "is_daylight", "is_peak_sunlight", "is_weekend", "solar_hour", "solar_day_of_year"}
    shown = [f"CAST({v} AS INTEGER) AS {c}" if c in whole else f"round({v}, {_digits(c)}) AS {c}" for c, v in columns.items()]
    bad = "SELECT site, ts FROM flags WHERE kind = '{}' AND flag IN ('OUT_WARN', 'RANGE_WARN')"
    return b.with_cte(
        f"""SELECT {', '.join(_IDS)}, {', '.join(shown)} FROM joined JOIN sites USING (site)
        WINDOW w AS (PARTITION BY site, plant_id ORDER BY ts)""",
        "flow_wide",
        "env",
        "flags",
        extra={
            "flow": """SELECT site, ts, 'tree_1' AS plant_id, 1 AS k, tree_1 AS sap_flow FROM flow_wide
            UNION ALL SELECT site, ts, 'tree_2', 2, tree_2 FROM flow_wide""",
            "joined": f"""SELECT flow.*, e.* EXCLUDE (site, ts), e.sw_in + 1 AS ppfd_in, ts + INTERVAL 20 MINUTES AS solar_ts
            FROM flow JOIN env e USING (site, ts) WHERE sap_flow IS NOT NULL
            AND (site, ts) NOT IN ({bad.format('env')}) AND (site, ts) NOT IN ({bad.format('sapf')})""",
            "sites": """SELECT site, length(site) AS n, count(*) FILTER (WHERE length(site) <> 6) OVER () AS named,
            CAST(count(*) FILTER (WHERE length(site) <> 6) OVER (ORDER BY upper(site)) - 1 AS DOUBLE) AS place
            FROM (SELECT DISTINCT site FROM env) s""",
        },
    )


@query("feature_table", _features_sql())
def feature_table_query(spark, sf_dir):
    """All columns of the feature table, with flags, site and plant metadata."""
    out = _features(spark, sf_dir)
    doubles = [c for c, kind in out.dtypes if kind == "double"]
    return out.withColumns({c: F.round(c, _digits(c)) for c in doubles})


_KEPT = """SELECT site, count(*) AS n_rows FROM (SELECT site, tree_1 AS v FROM flow_wide UNION ALL SELECT site, tree_2 FROM flow_wide) f
    WHERE v IS NOT NULL GROUP BY site"""


def _accepted(spark, sf_dir):
    path = scratch_path(spark, "features")
    # one column that should not be there, infinite in one site
    odd = F.when(F.col("site") == "purchase", float("inf")).otherwise(F.col("ta"))
    sinks.write_parquet(_features(spark, sf_dir, described=False).withColumn("netrad", odd), path)
    return ops.output_acceptance(spark.read.parquet(path), by=["site"])


@query(
    "output_acceptance",
    b.with_cte(
        """SELECT site, n_rows, true AS accepted, 'netrad' AS reported_columns, CAST(site = 'purchase' AS INTEGER) AS infinite_columns
        FROM kept""",
        "flow_wide",
        extra={"kept": _KEPT},
    ),
)
def output_acceptance(spark, sf_dir):
    return _accepted(spark, sf_dir).select("site", "n_rows", "accepted", "reported_columns", "infinite_columns")


@query(
    "mixed_format_scan",
    b.with_cte(
        """SELECT site, plant_id, ts, ta, CASE WHEN event_id % 3 = 0 THEN event_id END AS event_id, CASE WHEN event_id % 3 = 1 THEN 'late' END AS note
        FROM series""",
        "series",
    ),
)
def mixed_format_scan(spark, sf_dir):
    """A table a third of which is parquet and the rest CSV with two different headers, read as one."""
    path = scratch_path(spark, "mixed")
    rows = b.series(spark, sf_dir)
    part = lambda k: rows.where(F.col("event_id") % 3 == k)
    sinks.write_parquet(part(0), path)
    sinks.write_csv(part(1).select("ta", "ts", "plant_id", "site", F.lit("late").alias("note")), path, mode="append")
    sinks.write_csv(part(2).select("site", "ts", "ta", "plant_id"), path, compress=True, mode="append")
    return files.read_table(spark, path).select("site", "plant_id", "ts", "ta", "event_id", "note")


@query(
    "pending_sites",
    """SELECT DISTINCT l_suppkey AS site FROM lineitem WHERE l_suppkey NOT IN
       (SELECT l_suppkey FROM lineitem GROUP BY 1 HAVING count(*) >= 600)""",
)
def pending_sites(spark, sf_dir):
    rows = b.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("site"), "l_quantity")
    path = scratch_path(spark, "done")
    whole = rows.groupBy("site").agg(F.count(F.lit(1)).alias("n")).where("n >= 600")
    whole.write.parquet(path)
    return ops.pending(rows, spark.read.parquet(path))


@query(
    "run_summary",
    """SELECT CASE WHEN n >= 600 THEN 'ok' ELSE 'failed' END AS status, count(*) AS sites, CAST(sum(n) AS BIGINT) AS rows,
       max(CASE WHEN n >= 600 THEN 11 ELSE 0 END) AS max_columns
       FROM (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) s GROUP BY 1""",
)
def run_summary(spark, sf_dir):
    lines = b.table(spark, sf_dir, "lineitem")
    verdicts = ops.output_acceptance(lines, min_columns=11, essential=("l_quantity", "l_suppkey"), by=["l_suppkey"])
    good = F.col("accepted") & (F.col("n_rows") >= 600)
    sites = verdicts.select(
        F.when(good, "ok").otherwise("failed").alias("status"),
        "n_rows",
        F.when(good, F.col("n_columns")).otherwise(0).alias("n_columns"),
    )
    return ops.run_summary(sites)
