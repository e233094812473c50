from __future__ import annotations

from datetime import date

import pytest
from conftest import values
from pyspark.sql import functions as F

from verdure.functions.greenness import SENTINEL
from verdure.operators import greenness, stats

SCHEMA = "site string, date date, ndvi double, collection string, cloud_cover double"


def scenes(frame):
    lc, le = "LANDSAT/LC08/C02/T1_L2", "LANDSAT/LE07/C02/T1_L2"
    return frame(
        [
            ("a", date(2020, 1, 1), 0.1, lc, 0.0),
            ("a", date(2020, 1, 20), 0.3, lc, 5.0),
            ("a", date(2021, 7, 1), None, le, 60.0),
            ("b", date(2021, 7, 2), -0.2, le, 20.0),
            ("b", date(2021, 12, 31), 0.5, lc, 19.9),
        ],
        SCHEMA,
    )


def test_overview_and_quality(frame):
    row = greenness.overview(scenes(frame)).first()
    assert (row.records, row.sites, row.missions, row.years, row.months) == (5, 2, 2, 2, 3)
    row = greenness.quality_counts(scenes(frame)).first()
    assert (row.negative_count, row.cloudy_count, row.clear_count, row.missing_count) == (1, 1, 2, 1)
    assert row.missing_percent == 20.0


def test_global_stats(frame):
    row = greenness.global_stats(scenes(frame)).first()
    assert row.ndvi_median == pytest.approx(0.2) and row.cloud_median == 19.9
    assert row.ndvi_min == -0.2 and row.cloud_max == 60.0


def test_site_summary_rounds_half_to_even(frame):
    df = frame([("a", date(2020, 1, 1), 0.0625, "x", 2.0625)], SCHEMA)
    row = greenness.site_summary(df).first()
    assert (row.ndvi_mean, row.cloud_cover_mean) == (0.062, 2.062)


def test_busiest_year_prefers_the_first(frame):
    df = frame([(date(y, 1, 1),) for y in (2001, 2001, 2000, 2000, 1999)], "date date")
    assert tuple(greenness.busiest_year(df).first()) == (3, 2000, 2)


def test_class_share_counts_records_without_index(frame):
    out = greenness.class_counts(scenes(frame))
    assert values(out, "veg_class", "percent") == [("Dense", 20.0), ("Sparse", 20.0), ("Very Dense", 20.0), ("Water/Bare", 20.0)]


def test_cloud_bins_leave_out_zero(frame):
    out = greenness.cloud_bins(scenes(frame))
    assert values(out.select("cloud_bin", "ndvi_count"), "cloud_bin", "ndvi_count") == [("0-5%", 1), ("10-20%", 2), ("50-100%", 0)]


def test_scene_range_excludes_its_end(frame):
    dates = frame([("a", "2020-01-01", "2020-01-20"), ("b", "2021-07-02", "2022-01-01")], "site string, first_date string, last_date string")
    out = greenness.filter_scenes(scenes(frame), dates.withColumns({c: F.to_date(c) for c in ("first_date", "last_date")}))
    assert values(out, "site", "date") == [("a", date(2020, 1, 1)), ("b", date(2021, 12, 31))]


def test_missions_by_year(frame):
    df = frame([("old", "1990-01-01", "1998-12-31"), ("mid", "2013-05-01", "2013-06-01"), ("new", "2022-01-01", "2024-01-01")],
               "site string, first_date string, last_date string")
    out = greenness.missions_in_range(df).withColumn("m", F.substring("collection", 9, 4))
    assert values(out, "site", "m") == [("mid", "LC08"), ("mid", "LE07"), ("mid", "LT05"), ("new", "LC08"), ("old", "LT05")]
    bands = {r.m: (r.nir_band, r.red_band) for r in out.collect()}
    assert bands["LC08"] == ("SR_B5", "SR_B4") and bands["LT05"] == ("SR_B4", "SR_B3")


def test_zonal_mean_skips_empty_pixels(frame):
    df = frame([("a", 3.0, 1.0), ("a", 0.0, 0.0), ("a", 1.0, 1.0)], "scene string, B8 double, B4 double")
    _, nir, red = SENTINEL
    assert values(greenness.zonal_mean(df, ["scene"], F.col(nir), F.col(red)), "scene", "ndvi") == [("a", 0.25)]


def test_boxplot(frame):
    rows = [(1, float(v)) for v in (1, 2, 3, 4, 100)]
    row = greenness.boxplot(frame(rows, "month int, ndvi double"), "month").first()
    assert (row.q1, row.median, row.q3, row.whisker_low, row.whisker_high, row.outliers) == (2.0, 3.0, 4.0, 1.0, 4.0, 1)


def test_monthly_profile_fills_gaps_with_the_mean_of_months(frame):
    out = greenness.monthly_profile(scenes(frame), 1)
    got = dict(values(out.where("site = 'a'"), "month", "ndvi_mean"))
    assert len(got) == 12 and got[1] == pytest.approx(0.2) and got[2] == pytest.approx(0.2)


def test_latitude_bins_widen_the_lowest_edge(frame):
    df = frame([(v,) for v in (0.0, 10.0, 10.1, 100.0, None)], "latitude double")
    out = stats.equal_width_cut(df, "latitude", 10, "b")
    got = values(out, "latitude", "b", "b_mid")
    assert [g[:2] for g in got] == [(None, None), (0.0, 1), (10.0, 1), (10.1, 2), (100.0, 10)]
    assert got[1][2] == pytest.approx((10.0 - 0.1) / 2)


def test_histogram_closes_the_last_bin(frame):
    df = frame([(float(v),) for v in (0, 1, 1, 2, 4)], "v double")
    assert values(stats.histogram(df, "v", 4), "bin", "n") == [(1, 1), (2, 2), (3, 1), (4, 1)]
    same = frame([(5.0,), (5.0,)], "v double")
    assert values(stats.histogram(same, "v", 4), "bin", "n") == [(1, 2)]


def test_continents_overlap(frame):
    df = frame([(20.0, -60.0), (36.0, 40.0), (5.0, 120.0)], "latitude double, longitude double")
    row = greenness.continent_counts(df).first()
    assert (row.north_america, row.europe, row.asia, row.oceania, row.south_america, row.africa) == (1, 1, 1, 1, 0, 0)


def test_locations_without_index_stay(frame):
    summary = frame([("a", 0.5)], "site string, ndvi_mean double")
    places = frame([("a", 1.0), ("b", -1.0)], "site string, latitude double")
    assert values(greenness.attach_locations(summary, places), "site", "ndvi_mean") == [("a", 0.5), ("b", None)]
    assert greenness.attach_locations(summary, places, "inner").count() == 1


def test_heatmap_and_availability(frame):
    row = greenness.seasonal_heatmap(scenes(frame)).where("year = 2020").first()
    assert row.doy_0 == 0.1 and row.doy_20 == 0.3 and row.doy_10 is None
    out = greenness.availability(scenes(frame), 1)
    assert values(out, "site", "m1", "m7", "total") == [("a", 2, 1, 3)]


def test_coverage(frame):
    row = greenness.coverage(scenes(frame), 1).first()
    assert (row.site, row.n, row.span_days) == ("a", 3, 547)
