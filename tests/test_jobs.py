from __future__ import annotations

from pathlib import Path

from conftest import values
from pyspark.sql import functions as F
from test_sources import archive, put  # noqa: F401

from verdure.plans import jobs
from verdure.sources import sinks


def test_second_run_adds_only_new_sites(spark, archive, tmp_path, frame):  # noqa: F811
    out = str(tmp_path / "features")
    tiers = frame([("ESP_TWO_A", "extreme")], "site string, tier string")
    first = jobs.process_archive(spark, archive, out, tiers=tiers)
    assert values(first, "status", "sites", "rows") == [("ok", 1, 2)]
    again = jobs.process_archive(spark, archive, out, tiers=tiers)
    assert again.count() == 0
    more = jobs.process_archive(spark, archive, out, tiers=tiers, include=["extreme"])
    # its only reading with a value has no weather
    assert values(more, "status", "sites", "rows") == [("failed", 1, 0)]
    table = spark.read.parquet(out)
    assert values(table.groupBy("site").count(), "site", "count") == [("AUS_ONE", 2)]


def test_force_replaces_but_keeps_exclusions(spark, archive, tmp_path, frame):  # noqa: F811
    out = str(tmp_path / "features")
    jobs.process_archive(spark, archive, out)
    tiers = frame([("AUS_ONE", "no_data")], "site string, tier string")
    jobs.process_archive(spark, archive, out, force=True)
    assert spark.read.parquet(out).count() == 2
    summary = jobs.process_archive(spark, archive, str(tmp_path / "none"), tiers=tiers, force=True)
    assert values(summary, "status", "sites") == [("failed", 1)]


def test_all_metadata_tables_reach_the_table(spark, archive, tmp_path):  # noqa: F811
    root = Path(archive)
    put(root, "AUS_ONE_stand_md.csv", "st_name,st_age,st_lai\nx,40,NA\n")
    put(root, "AUS_ONE_species_md.csv", "sp_name,sp_ntrees\nPinus,7\n")
    put(root, "AUS_ONE_env_md.csv", "env_timestep,env_time_zone\n30,5UTC+01:00\n")
    put(root, "AUS_ONE_plant_md.csv", "pl_name,pl_code,pl_dbh,pl_height\na,t1,20,3\na,t1,10,3\nb,t9,5,1\n")
    out = str(tmp_path / "features")
    jobs.process_archive(spark, archive, out)
    table = spark.read.parquet(out)
    got = values(table, "plant_id", "latitude", "stand_age", "leaf_area_index", "n_trees", "measurement_timestep", "pl_dbh")
    assert got == [("t1", -30.5, 40.0, None, 7.0, 30.0, 10.0)] * 2


def test_texts_are_coded_alike_in_later_runs(spark, archive, tmp_path):  # noqa: F811
    root, out = Path(archive), str(tmp_path / "features")
    put(root, "AUS_ONE_species_md.csv", "sp_name,sp_ntrees\nPinus,7\n")
    put(root, "AUS_ONE_env_md.csv", "env_timestep,env_time_zone\n30,5UTC+01:00\n")
    jobs.process_archive(spark, archive, out)
    for name, species in (("ZZ_NEW", "Abies"), ("ZZ_OLD", "Pinus")):
        put(root, f"{name}_env_data.csv", "TIMESTAMP,ta\n2020-01-01 00:00:00,9.0\n")
        put(root, f"{name}_sapf_data.csv", "TIMESTAMP,t1\n2020-01-01 00:00:00,5\n")
        put(root, f"{name}_species_md.csv", f"sp_name,sp_ntrees\n{species},7\n")
    jobs.process_archive(spark, archive, out)
    got = {r.site: r.species_name_code for r in spark.read.option("mergeSchema", "true").parquet(out).collect()}
    # null was given the code after the values of the first run
    assert got == {"AUS_ONE": 0.0, "ZZ_NEW": 2.0, "ZZ_OLD": 0.0}
    assert all(kind != "string" or c in ("site", "plant_id") for c, kind in spark.read.parquet(out).dtypes)


def test_audit_of_an_archive(spark, archive):  # noqa: F811
    tables = jobs.audit_archive(spark, archive)
    assert values(tables["sites"], "site", "sapf_warn", "sapf_total") == [("AUS_ONE", 1, 1)]
    assert values(tables["columns"], "kind", "col_name", "warn") == [("sapf", "t1", 0), ("sapf", "t2", 1)]
    assert tables["total"].first().total_warn == 1
    assert tables["presence"].first().sites_with_flags == 1
    assert all(t.collect() is not None for t in tables.values())


def test_index_report(spark, frame):
    rows = [("a", "2020-01-01", 0.4, "LANDSAT/LC08/C02/T1_L2", 3.0), ("b", "2021-07-01", 0.6, "LANDSAT/LE07/C02/T1_L2", 60.0)]
    scenes = frame(rows, "site string, date string, ndvi double, collection string, cloud_cover double")
    tables = jobs.index_report(scenes.withColumn("date", F.to_date("date")))
    assert tables["statistics"].first().ndvi_median == 0.5
    assert {r.veg_class for r in tables["classes"].collect()} == {"moderate", "dense"}
    assert all(t.count() > 0 for t in tables.values())


def test_overwriting_keeps_the_folders_of_other_sites(spark, tmp_path):
    out = str(tmp_path / "out")
    sinks.write_parquet(spark.createDataFrame([("A", 1), ("B", 2)], "site string, v int"), out)
    sinks.write_parquet(spark.createDataFrame([("B", 3)], "site string, v int"), out, mode="overwrite")
    assert sorted((r.site, r.v) for r in spark.read.parquet(out).collect()) == [("A", 1), ("B", 3)]
