"""Station archives, sinks, profiles and streams over files."""

from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime
from pathlib import Path

import pytest
from conftest import SF, values
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdure.operators import profile
from verdure.plans import bindings, feature_table
from verdure.session import clear_scratch, discard, materialize, scratch_path
from verdure.sources import files, sinks, stations
from verdure.streaming import jobs


def put(root, name, text):
    root.mkdir(exist_ok=True)
    (root / name).write_text(text)


@pytest.fixture
def archive(tmp_path):
    root = tmp_path / "archive"
    put(root, "AUS_ONE_env_data.csv", '"TIMESTAMP","TIMESTAMP_solar","ta","netrad"\n2020-01-01T00:00:00Z,2020-01-01 00:30:00,1.5,7\n2020-01-01T01:00:00Z,NA,NA,7\n2020-01-01T02:00:00Z,NA,2.5,7\n')
    put(root, "ESP_TWO_A_env_data.csv", "solar_TIMESTAMP,TIMESTAMP,vpd,ta\n2020-01-01 00:10:00,2020-01-01 00:00:00,0.5,9.0\n")
    put(root, "AUS_ONE_sapf_data.csv", "TIMESTAMP,solar_TIMESTAMP,t1,t2\n2020-01-01 00:00:00,NA,10,NA\n2020-01-01 01:00:00,NA,11,NA\n2020-01-01 02:00:00,NA,12,NA\n")
    put(root, "ESP_TWO_A_sapf_data.csv", "TIMESTAMP,solar_TIMESTAMP,only\n2020-01-01 00:00:00,NA,NaN\n2020-01-01 01:00:00,NA,5\n")
    put(root, "AUS_ONE_sapf_flags.csv", "TIMESTAMP,solar_TIMESTAMP,t1,t2\n2020-01-01 01:00:00,NA,NA,OUT_WARN\n2020-01-01 02:00:00,NA,,NA\n")
    put(root, "AUS_ONE_site_md.csv", 'si_code,si_name,si_lat,si_igbp\nAUS_ONE,"Hill, north",-30.5,ENF\n')
    put(root, "notes.csv", "x\n1\n")
    return str(root)


def test_catalog_reads_names_only(spark, archive):
    out = stations.site_catalog(spark, archive)
    assert values(out, "site", "kind", "part") == [
        ("AUS_ONE", "env", "data"), ("AUS_ONE", "sapf", "data"), ("AUS_ONE", "sapf", "flags"), ("AUS_ONE", "site", "md"),
        ("ESP_TWO_A", "env", "data"), ("ESP_TWO_A", "sapf", "data"),
    ]


def test_wide_tables_with_different_headers(spark, archive):
    out = stations.read_wide(spark, archive, "env", ["ta", "vpd", "netrad"])
    assert "netrad" not in out.columns
    got = values(out, "site", "ts", "solar_ts", "ta", "vpd")
    assert got[0] == ("AUS_ONE", datetime(2020, 1, 1), datetime(2020, 1, 1, 0, 30), 1.5, None)
    assert got[1][3] is None
    assert got[3] == ("ESP_TWO_A", datetime(2020, 1, 1), datetime(2020, 1, 1, 0, 10), 9.0, 0.5)


def test_long_tables_have_one_row_per_cell(spark, archive):
    out = stations.read_long(spark, archive, "sapf", "data", "plant_id", "sap_flow")
    assert out.count() == 8
    assert values(out.where("site = 'ESP_TWO_A'"), "ts", "sap_flow") == [(datetime(2020, 1, 1), None), (datetime(2020, 1, 1, 1), 5.0)]
    flags = stations.read_long(spark, archive, "sapf", "flags", "col_name", "flag")
    assert values(flags.where("flag IS NOT NULL"), "col_name", "flag") == [("t2", "OUT_WARN")]


def test_quoted_metadata(spark, archive):
    out = stations.read_metadata(spark, archive, "site", ["si_name", "si_lat", "si_elev"])
    assert values(out, "site", "si_name", "si_lat", "si_elev") == [("AUS_ONE", "Hill, north", "-30.5", None)]


def test_the_time_column_may_stand_anywhere(spark, tmp_path):
    put(tmp_path, "AA_env_data.csv", "TIMESTAMP,ta\n2020-01-01 00:00:00,1\n")
    put(tmp_path, "BB_env_data.csv", "ta,vpd,x,\"TIMESTAMP\"\n2,3,4,2020-01-01 00:00:00\n")
    put(tmp_path, "CC_env_data.csv", "\n  \nta, TIMESTAMP ,ta\n5,2020-01-01 00:00:00,6\n,,\n")
    out = stations.read_wide(spark, str(tmp_path), "env", ["ta", "vpd"])
    assert values(out.where("ts IS NOT NULL"), "site", "ta", "vpd") == [("AA", 1.0, None), ("BB", 2.0, 3.0), ("CC", 5.0, None)]


def test_a_line_that_looks_like_a_header_is_data(spark, tmp_path):
    put(tmp_path, "AA_env_data.csv", "TIMESTAMP,note\n2020-01-01 00:00:00,a\nTIMESTAMP,note\n")
    out = stations.read_long(spark, str(tmp_path), "env", "data", "c", "v")
    assert out.count() == 2


def test_unusable_files_are_listed(spark, archive):
    root = Path(archive)
    put(root, "X_env_data.csv", "time,ta\n1,2\n")
    put(root, "Y_sapf_data.csv", "\n")
    put(root, "Z_site_md.csv", "1,2\n")
    out = stations.unusable_files(spark, archive)
    assert values(out, "site", "kind", "part", "header") == [
        ("X", "env", "data", "time,ta"), ("Y", "sapf", "data", ""), ("Z", "site", "md", "1,2"),
    ]
    assert stations.read_wide(spark, archive, "env", ["ta"]).where("site = 'X'").isEmpty()


def test_of_a_plain_and_a_gzipped_copy_one_is_read(spark, tmp_path):
    import gzip

    text = "TIMESTAMP,ta\n2020-01-01 00:00:00,1\n"
    put(tmp_path, "A_env_data.csv", text)
    (tmp_path / "A_env_data.csv.gz").write_bytes(gzip.compress(text.encode()))
    (tmp_path / "B b_env_data.csv.gz").write_bytes(gzip.compress(text.encode()))
    (tmp_path / "C[1]{x}_env_data.csv").write_text(text)
    out = stations.read_wide(spark, str(tmp_path), "env", ["ta"])
    assert values(out, "site", "ta") == [("A", 1.0), ("B b", 1.0), ("C[1]{x}", 1.0)]


def test_only_files_of_the_sites_asked_for_are_read(spark, archive, frame):
    one = frame([("ESP_TWO_A",)], "site string")
    found = stations.station_files(spark, archive, "env", "data", one)
    assert [f.site for f in found] == ["ESP_TWO_A"]
    out = stations.read_wide(spark, archive, "env", ["ta"], sites=one)
    assert [f.rsplit("/", 1)[1] for f in out.inputFiles()] == ["ESP_TWO_A_env_data.csv"]
    assert stations.read_wide(spark, archive, "env", ["ta"], sites=one.where("false")).count() == 0


def test_metadata_rows_keep_the_order_of_the_file(spark, tmp_path):
    put(tmp_path, "A_site_md.csv", "si_name,si_lat\nz,9\na,1\n")
    put(tmp_path, "A_plant_md.csv", "pl_code,pl_dbh\nt,9\nt,1\n")
    site = feature_table.site_metadata(spark, str(tmp_path), {"site": ("si_name", "si_lat")})
    assert values(site, "site", "si_name", "si_lat") == [("A", "z", 9.0)]
    assert values(feature_table.plant_metadata(spark, str(tmp_path)), "pl_code", "pl_dbh") == [("t", 1.0)]


def test_a_table_of_parquet_and_csv_files_reads_as_one(spark, frame, tmp_path):
    df = frame([("a", 1.5, 1), ("b", 2.5, 2)], "site string, v double, n int")
    sinks.write_parquet(df, str(tmp_path / "t"))
    put(tmp_path / "t" / "site=c", "x.csv", "n,v,more\n3,3.5,yes\n4,NA,no\n5,bad,\n")
    put(tmp_path / "t" / "site=d", "y.csv", "v,n\n6.5,6\n")
    out = files.read_table(spark, str(tmp_path / "t"))
    assert dict(out.dtypes) == {"v": "double", "n": "int", "site": "string", "more": "string"}
    assert values(out, "site", "n", "v", "more") == [
        ("a", 1, 1.5, None), ("b", 2, 2.5, None), ("c", 3, 3.5, "yes"), ("c", 4, None, "no"), ("c", 5, None, None), ("d", 6, 6.5, None),
    ]
    put(tmp_path / "u", "x.csv", "v,n\n6.5,6\n")
    only = files.read_table(spark, str(tmp_path / "u"))
    assert dict(only.dtypes) == {"v": "double", "n": "int"} and only.count() == 1
    with pytest.raises(ValueError, match="no parquet or CSV"):
        (tmp_path / "none").mkdir()
        files.read_table(spark, str(tmp_path / "none"))


def test_columns_of_every_file(spark, frame, tmp_path):
    root = tmp_path / "t"
    frame([("a", 1.5)], "site string, v double").write.partitionBy("site").parquet(str(root))
    frame([("b", 1.5, "x")], "site string, v double, w string").write.mode("append").partitionBy("site").parquet(str(root))
    put(root / "site=c", "x.csv", "v,TIMESTAMP\n3,4\n")
    got = values(files.file_columns(spark, str(root)).withColumn("file", F.regexp_extract("file", "site=(.)", 1)), "file", "column", "type")
    assert got == [
        ("a", "site", "folder"), ("a", "v", "double"), ("b", "site", "folder"), ("b", "v", "double"), ("b", "w", "string"),
        ("c", "TIMESTAMP", "text"), ("c", "site", "folder"), ("c", "v", "text"),
    ]


def test_missing_kind_is_an_error(spark, archive):
    with pytest.raises(ValueError, match="no plant md"):
        stations.read_metadata(spark, archive, "plant", ["pl_code"])


def test_archive_to_feature_table(spark, archive):
    out = feature_table.build_from_archive(spark, archive)
    # 01:00 is flagged for the whole site and t2 never has a value
    got = values(out, "site", "ts", "plant_id", "sap_flow", "ta", "ta_lag_1h", "igbp_class_code", "climate_zone_code", "order_" if "order_" in out.columns else "hour")
    assert [g[:7] for g in got] == [
        ("AUS_ONE", datetime(2020, 1, 1), "t1", 10.0, 1.5, None, 1.0),
        ("AUS_ONE", datetime(2020, 1, 1, 2), "t1", 12.0, 2.5, 1.5, 1.0),
    ]
    assert len(out.columns) >= 50
    verdict = profile.output_acceptance(out, by=["site"]).first()
    assert verdict.accepted and verdict.reported_columns == ""


def test_feature_table_of_long_series_and_hot_hours(spark):
    wide = bindings.flow_wide(spark, SF)
    flow = wide.unpivot(["site", "ts"], ["tree_1", "tree_2"], "plant_id", "sap_flow")
    few = {"lags": (1, 24), "widths": (3, 72)}
    plain = feature_table.build(flow, bindings.env(spark, SF), **few)
    cut = feature_table.build(flow, bindings.env(spark, SF), **few, max_rows=1, block_rows=80)
    columns = ["sap_flow", "ta", "sw_in_lag_1h", "vpd_lag_24h", "ta_mean_72h", "sw_in_std_72h", "hour"]
    a, b = (values(t, *columns, order=["site", "plant_id", "ts"]) for t in (plain, cut))
    assert len(a) == len(b) > 500
    for x, y in zip(a, b, strict=True):
        assert x == pytest.approx(y)


def test_station_files_round_trip(spark, frame, tmp_path):
    df = frame([("a", "2020-01-01 00:00:00", 1.25, None), ("b", "2020-01-01 00:00:00", None, 2.5)], "site string, TIMESTAMP string, x double, y double")
    for compress in (False, True):
        root = str(tmp_path / f"out{compress}")
        sinks.write_station_files(df, root, "sapf", compress=compress)
        back = stations.read_long(spark, root, "sapf", "data", "plant_id", "v")
        assert values(back, "site", "plant_id", "v") == [("a", "x", 1.25), ("a", "y", None), ("b", "x", None), ("b", "y", 2.5)]


def test_parquet_and_csv_sinks(spark, frame, tmp_path):
    df = frame([("a", 1.5), ("b", 2.5)], "site string, v double")
    sinks.write_parquet(df, str(tmp_path / "p"), compress=False)
    assert values(spark.read.parquet(str(tmp_path / "p")), "site", "v") == [("a", 1.5), ("b", 2.5)]
    assert len(list((tmp_path / "p").glob("site=*"))) == 2
    sinks.write_csv(df, str(tmp_path / "c"), compress=True)
    assert list((tmp_path / "c").glob("site=*/*.csv.gz"))
    back = spark.read.schema("v double, site string").csv(str(tmp_path / "c"), header=True)
    assert values(back, "site", "v") == [("a", 1.5), ("b", 2.5)]


def test_libsvm_drops_missing_targets_and_zeroes_features(spark, frame, tmp_path):
    df = frame([("a", 1.0, None, "x"), ("a", None, 2.0, "x"), ("b", 3.0, 4.0, "x")], "site string, sap_flow double, ta double, q_flags string")
    sinks.write_libsvm(df, str(tmp_path / "s"), "sap_flow")
    back = sinks.read_libsvm(spark, str(tmp_path / "s"), 1)
    assert values(back.select("label", vector_to_array("features")[0].alias("f")), "label", "f") == [(1.0, 0.0), (3.0, 4.0)]
    assert sinks.libsvm_line_check(spark.read.text(str(tmp_path / "s"))).where("NOT is_valid").count() == 0


def test_libsvm_lines(frame):
    lines = ["1.5 1:2 3:4e-1", "x 1:2", "1 2", "1 a:2", "1 1:b", "", "  ", "7", "-1 2:-3", "1 1:2:3"]
    out = sinks.libsvm_line_check(frame([(i, t) for i, t in enumerate(lines)], "i int, value string"))
    assert [r[1] for r in values(out, "i", "is_valid")] == [True, False, False, False, False, True, True, True, True, False]


def test_greenness_csv(spark, tmp_path):
    put(tmp_path, "n.csv", "site,date,ndvi,collection,cloud_cover\na,2020-03-01,0.5,LC08,1\nb,2020-12-31,,LC08,2\n")
    out = stations.read_greenness(spark, str(tmp_path / "n.csv"))
    assert values(out, "site", "ndvi", "year", "month", "day_of_year") == [("a", 0.5, 2020, 3, 61), ("b", None, 2020, 12, 366)]


def test_run_summaries(spark, tmp_path):
    put(tmp_path, "one.json", '{"model_type": "m1", "metrics": {"test_r2": 0.5, "test_rmse": 2.0}, "other": 1}\n')
    put(tmp_path, "two.json", '{"model_type": "m2", "metrics": {"test_r2": 0.7, "test_rmse": 1.0}}\n')
    assert values(stations.read_summaries(spark, str(tmp_path)), "model_type", "test_r2") == [("m1", 0.5), ("m2", 0.7)]


def test_profiles(frame):
    df = frame([("a", 1.0, "x"), ("b", float("inf"), None), (None, None, "x")], "site string, v double, t string")
    assert values(profile.null_profile(df), "column", "nulls") == [("site", 1), ("t", 1), ("v", 1)]
    assert values(profile.infinity_profile(df), "column", "infinities") == [("v", 1)]
    assert values(profile.string_profile(df), "column", "distinct_values", "listed_values") == [("site", 2, "a|b"), ("t", 1, "x")]
    assert values(profile.string_profile(df, exact=False), "column", "distinct_values") == [("site", 2), ("t", 1)]
    assert values(profile.type_profile(df), "type", "n_columns", "columns") == [("double", 1, "v"), ("string", 2, "site|t")]
    row = profile.describe(df, "v").first()
    assert (row.n, row.missing) == (2, 1)


def test_long_columns_are_sketched(spark):
    df = spark.range(2000).select(F.col("id").cast("string").alias("many"), F.lit("x").alias("one"))
    got = {r.column: r for r in profile.string_profile(df, exact=False).collect()}
    assert abs(got["many"].distinct_values - 2000) < 200 and got["many"].listed_values is None
    assert got["one"].listed_values == "x"
    assert got["one"].is_exact and not got["many"].is_exact


def test_acceptance(frame):
    df = frame([("a", 1.0)], "site string, sap_flow double")
    assert not profile.output_acceptance(df).first().accepted
    assert profile.output_acceptance(df, min_columns=2).first().accepted
    assert not profile.output_acceptance(df.where("site = 'z'"), min_columns=2).first().accepted
    extra = df.withColumn("wind_stress", F.lit(1)).withColumn("netrad", F.lit(1))
    assert profile.output_acceptance(extra).first().reported_columns == "netrad|wind_stress"


def test_files_of_different_schemas_are_judged_by_their_own(spark, frame, tmp_path):
    root = tmp_path / "t"
    frame([("a", 1.0, "x"), ("a", 2.0, "x")], "site string, sap_flow double, pl_name string").coalesce(1).write.partitionBy("site").parquet(str(root))
    frame([("b", 1, 2)], "site string, TIMESTAMP_solar int, netrad int").write.mode("append").partitionBy("site").parquet(str(root))
    put(root / "site=c", "x.csv", "v,sap_flow\n3,4\n\n5,6\n")
    out = profile.dataset_profile(spark, str(root)).withColumn("file", F.regexp_extract("file", "site=(.)", 1))
    got = values(out, "file", "n_rows", "n_columns", "has_target", "has_timestamp", "has_site", "reported_columns", "text_columns")
    assert got == [
        ("a", 2, 3, True, False, True, "pl_name", "pl_name"),
        ("b", 1, 3, False, True, True, "netrad", ""),
        ("c", 2, 3, True, False, True, "", ""),
    ]
    (tmp_path / "empty").mkdir()
    assert profile.dataset_profile(spark, str(tmp_path / "empty")).count() == 0


def test_pending(frame):
    sites = frame([("a",), ("b",), ("b",)], "site string")
    assert values(profile.pending(sites, frame([("a",)], "site string")), "site") == [("b",)]


def slices(spark, path, parts=4):
    rows = bindings.table(spark, SF, "events")
    edges = rows.approxQuantile("event_id", [i / parts for i in range(1, parts)], 0.0)
    low = -1.0
    for e in [*edges, 1e18]:
        piece = rows.where((F.col("event_id") > low) & (F.col("event_id") <= e))
        piece.coalesce(1).write.mode("append").parquet(path)
        low = e
        yield


def test_streamed_features_equal_the_batch_answer(spark, tmp_path):
    arriving, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    schema = bindings.table(spark, SF, "events").schema
    env = bindings.env(spark, SF).withColumnRenamed("ts", "h")
    pick = lambda df: df.select(F.col("event_type").alias("site"), "event_id", bindings.hour_of("ts").alias("h"), F.col("value").alias("sap_flow"))
    for _ in slices(spark, arriving):  # every slice is a run of its own, continuing from the last
        flow = pick(jobs.read_stream(spark, arriving, schema, per_run=1))
        jobs.append_features(flow, env, out, progress, on=("site", "h")).awaitTermination()
    batch = pick(bindings.table(spark, SF, "events")).join(env, ["site", "h"])
    saved = jobs.read_features(spark, out)
    assert saved.count() == batch.count()
    assert values(saved, "event_id", "site", "sw_in") == values(batch, "event_id", "site", "sw_in")


def test_readings_wait_for_their_weather(spark, tmp_path):
    """Weather and readings arrive in any order; an interrupted step and a repeated one change nothing."""
    arriving, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    schema = bindings.table(spark, SF, "events").schema
    env = bindings.env(spark, SF).withColumnRenamed("ts", "h")
    pick = lambda df: df.select(F.col("event_type").alias("site"), "event_id", bindings.hour_of("ts").alias("h"), F.col("value").alias("sap_flow"))
    assert jobs.retry_waiting(env, out) == 0 and jobs.read_features(spark, out) is None
    part = lambda k: env.where(F.pmod(F.xxhash64("site", "h"), F.lit(4)) < k)
    for known, _ in enumerate(slices(spark, arriving)):
        flow = pick(jobs.read_stream(spark, arriving, schema))
        jobs.append_features(flow, lambda k=known: part(k), out, progress, on=("site", "h")).awaitTermination()
    joined_so_far = jobs.read_features(spark, out).count()
    # a step that wrote rows but was lost before it wrote what waits does not count
    env.limit(5).withColumn("event_id", F.lit(-1)).write.partitionBy("site").parquet(f"{out}/rows/step=3_1")
    assert jobs.read_features(spark, out).count() == joined_so_far
    assert jobs.retry_waiting(part(3), out, on=("site", "h")) > 0
    assert jobs.retry_waiting(part(4), out, on=("site", "h")) == 0
    batch = pick(bindings.table(spark, SF, "events")).join(env, ["site", "h"])
    saved = jobs.read_features(spark, out)
    assert values(saved, "event_id", "site", "sw_in") == values(batch, "event_id", "site", "sw_in")
    assert jobs.retry_waiting(env, out, on=("site", "h")) == 0 and jobs.read_features(spark, out).count() == batch.count()


def test_streamed_flag_counts_equal_the_batch_answer(spark, tmp_path):
    arriving, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    schema = bindings.table(spark, SF, "events").schema
    pick = lambda df: df.select(
        F.col("event_type").alias("site"), F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("value") > 100, "OUT_WARN").otherwise("OK").alias("flag")
    )
    for _ in slices(spark, arriving):
        flags = pick(jobs.read_stream(spark, arriving, schema, per_run=1))
        jobs.daily_flag_counts(flags, out, progress).awaitTermination()
    batch = pick(bindings.table(spark, SF, "events")).groupBy("site", F.date_trunc("day", "ts").alias("day")).agg(
        F.count("flag").alias("total"), F.count_if(F.col("flag") == "OUT_WARN").alias("warn")
    )
    got = jobs.latest_flag_counts(spark, out)
    assert values(got, "site", "day", "total", "warn") == values(batch, "site", "day", "total", "warn")


class Cluster:
    """A session on a cluster without the shared folder set."""

    class conf:
        get = staticmethod(lambda key, default: default)

    class sparkContext:
        master, applicationId = "yarn", "app"


def test_scratch_is_the_shared_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    path = scratch_path(spark, "x")
    assert path.startswith(f"{shared}/verdure-") and path != scratch_path(spark, "x")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_path(Cluster, "x")


def test_scratch_can_be_cleared(spark):
    spark.range(3).write.parquet(scratch_path(spark, "x"))
    folder = scratch_path(spark, "x").rsplit("/", 1)[0]
    assert Path(folder).exists()
    clear_scratch(spark)
    assert not Path(folder).exists()


def shuffle_files(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {p for folder in folders for p in Path(folder).rglob("shuffle_*")}


def test_what_is_written_leaves_no_shuffle_files(spark):
    key, before = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", shuffle_files(spark)
    setting = spark.conf.get(key, None)

    def one(k):
        return materialize(spark.range(1000).groupBy((F.col("id") % 7 + k).alias("k")).count(), "x")

    with ThreadPoolExecutor(4) as pool:
        tables = list(pool.map(one, range(8)))
    assert [sorted(r.k for r in t.collect()) for t in tables] == [list(range(k, k + 7)) for k in range(8)]
    # they are removed in the background
    for _ in range(50):
        if not shuffle_files(spark) - before:
            break
        time.sleep(0.1)
    assert not shuffle_files(spark) - before
    assert spark.conf.get(key, None) == setting


def test_written_tables_can_be_discarded(spark):
    kept, gone = (materialize(spark.range(n), "x") for n in (3, 4))
    discard(gone)
    assert kept.count() == 3 and not Path(gone._scratch.removeprefix("file:")).exists()


def test_counts_of_sites_that_arrive_out_of_time_order(spark, tmp_path):
    arriving, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    schema = T.StructType([T.StructField("site", T.StringType()), T.StructField("ts", T.TimestampType()), T.StructField("flag", T.StringType())])
    for site, month in (("A", 6), ("B", 1), ("A", 6)):
        row = [(site, datetime(2020, month, 3, 4), "OUT_WARN")]
        spark.createDataFrame(row, schema).coalesce(1).write.mode("append").parquet(arriving)
        jobs.daily_flag_counts(jobs.read_stream(spark, arriving, schema), out, progress).awaitTermination()
    got = jobs.latest_flag_counts(spark, out).select("site", F.month("day").alias("m"), "total", "warn")
    assert values(got, "site", "m", "total", "warn") == [("A", 6, 2, 2), ("B", 1, 1, 1)]


@pytest.mark.parametrize("header, line", [(",TIMESTAMP,ta", "1,2020-01-01,5"), ("TIMESTAMP,,ta", "2020-01-01,9,5"), ("TIMESTAMP,NA,ta,ta", "2020-01-01,9,5,7")])
def test_columns_without_a_name_shift_nothing(spark, tmp_path, header, line):
    (tmp_path / "AA_ONE_env_data.csv").write_text(f"{header}\n{line}\n")
    rows = stations.read_wide(spark, str(tmp_path), "env", ["ta"]).collect()
    assert [(r.site, r.ta) for r in rows] == [("AA_ONE", 5.0)]
