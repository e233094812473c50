"""Scalar expressions and metadata against answers worked out by hand."""

from __future__ import annotations

from datetime import datetime

import pytest
from conftest import values
from pyspark.sql import functions as F

from verdure.functions import calendar, codes, derived
from verdure.functions.clean import sanitize
from verdure.functions.cuts import cut, encode
from verdure.functions.greenness import (
    hemisphere,
    mission_code,
    normalized_difference,
    vegetation_class,
    vegetation_class_report,
)
from verdure.operators import align, metadata


def column(frame, kind, data, make):
    df = frame([(i, v) for i, v in enumerate(data)], f"i int, v {kind}")
    return [r[1] for r in values(df.select("i", make(F.col("v")).alias("o")), "i", "o")]


def test_cuts_are_closed_on_the_right(frame):
    zone = lambda c: derived.climate(c)["climate_zone_code"]
    assert column(frame, "double", [-90.0, -23.5, 23.5, 23.6, 90.1, None], zone) == [None, 0.0, 1.0, 2.0, None, None]
    size = lambda c: cut(c, codes.SIZE_EDGES, list(codes.SIZE_CLASS))
    got = column(frame, "double", [0.0, 10.0, 10.1, 1000.0, 1001.0], size)
    assert got == [None, "Sapling", "Small", "Very Large", None]
    age = lambda c: cut(c, codes.AGE_EDGES, list(codes.AGE_CLASS))
    assert column(frame, "double", [20.0, 20.5, 200.0, 201.0], age) == ["Young", "Mature", "Very Old", "Ancient"]
    cloud = lambda c: cut(c, codes.CLOUD_EDGES, codes.CLOUD_LABELS)
    assert column(frame, "double", [0.0, 5.0, 5.1, 20.0], cloud) == [None, "0-5%", "5-10%", "10-20%"]
    with pytest.raises(ValueError):
        cut(F.lit(1), (0, 1), ("a", "b"))


def test_season(frame):
    assert column(frame, "int", [12, 2, 3, 6, 9, 11], calendar.season) == [1, 1, 2, 3, 4, 4]


def test_calendar_of_a_sunday(frame):
    df = frame([(datetime(2024, 12, 29, 18, 30),)], "ts timestamp_ntz")
    row = metadata.add_columns(df, calendar.calendar(F.col("ts"))).first()
    assert (row.hour, row.day_of_year, row.month, row.year, row.day_of_week) == (18, 364, 12, 2024, 6)
    assert (row.is_daylight, row.is_peak_sunlight, row.is_weekend) == (1, 0, 1)


def test_solar_cycle(frame):
    df = frame([(datetime(2024, 1, 1, 6),)], "ts timestamp_ntz")
    row = metadata.add_columns(df, calendar.solar(F.col("ts"))).first()
    assert row.solar_hour_sin == pytest.approx(1.0) and row.solar_hour_cos == pytest.approx(0.0, abs=1e-12)
    assert row.solar_day_of_year == 1


def test_ten_day_bin(frame):
    assert column(frame, "int", [1, 9, 10, 366], calendar.ten_day_bin) == [0, 0, 10, 360]


def test_time_zone(frame):
    data = ["1UTC+01:00", "UTC", "5UTC-05:00", None]
    assert column(frame, "string", data, derived.utc_offset) == [1.0, None, -5.0, None]


def test_sanitize(frame):
    df = frame([("", 1.5), ("nan", float("inf")), ("None", float("-inf")), ("NULL", float("nan")), ("x", None)], "t string, v double")
    got = [tuple(r) for r in sanitize(df).collect()]
    assert got == [(None, 1.5), (None, None), (None, None), (None, None), ("x", None)]


def test_vegetation_class_edges(frame):
    data = [0.1, 0.3, 0.5, -0.2, None]
    assert column(frame, "double", data, vegetation_class) == ["Sparse", "Dense", "Very Dense", "Water/Bare", None]
    assert column(frame, "double", data, vegetation_class_report) == ["sparse", "moderate", "moderate", "bare", None]


def test_index_and_mission(frame):
    df = frame([(0.0, 0.0), (3.0, 1.0)], "nir double, red double")
    assert [r[0] for r in df.select(normalized_difference(F.col("nir"), F.col("red"))).collect()] == [None, 0.5]
    assert column(frame, "string", ["LANDSAT/LC08/C02/T1_L2", "COPERNICUS/S2"], mission_code) == ["LC08", None]
    assert column(frame, "double", [0.0, 0.1, None], hemisphere) == ["Southern", "Northern", None]


def test_codes_have_the_fixed_values(frame):
    assert len(codes.BIOME) == 15 and len(codes.IGBP) == 16 and len(codes.COUNTRY) == 24
    assert column(frame, "string", ["BSV", "ENF", "??", None], lambda c: encode(c, codes.IGBP)) == [16.0, 1.0, None, None]
    assert column(frame, "string", ["suppressed"], lambda c: encode(c, codes.SOCIAL)) == [0.0]


def test_derived_metadata(frame):
    df = frame(
        [(10.0, 1200.0, 20.0, 3.0, 2.0, 0.0, "warm deciduous", 30.0)],
        "mean_annual_temp double, mean_annual_precip double, pl_dbh double, pl_height double, pl_sapw_area double, "
        "pl_leaf_area double, leaf_habit string, measurement_timestep double",
    )
    row = metadata.derive_metadata(df).first()
    assert row.aridity_index == 60.0 and row.tree_volume_index == 1200.0 and row.leaf_habit_code == 2.0
    assert row.sapwood_leaf_ratio == pytest.approx(2e6) and row.measurement_frequency == 2.0
    assert row.tree_size_class == "Small"


def test_domain_features_need_their_inputs(frame):
    df = frame([(30.0, 9.0)], "ta double, pl_dbh double")
    made = derived.domain(df.columns)
    assert set(made) == {"temp_deviation", "tree_size_factor"}
    row = metadata.add_columns(df, made).first()
    assert row.temp_deviation == 5.0 and row.tree_size_factor == pytest.approx(2.302585093)


def test_last_duplicate_plant_wins(frame):
    facts = frame([("p1",), ("p2",), ("p3",)], "plant_id string")
    plants = frame([("p1", 1.0, 1), ("p1", 2.0, 2), ("p2", 5.0, 1)], "pl_code string, pl_dbh double, line int")
    out = metadata.attach_plant_metadata(facts, plants, order=["line"])
    assert values(out, "plant_id", "pl_dbh") == [("p1", 2.0), ("p2", 5.0), ("p3", None)]


def test_site_metadata_is_renamed_and_optional(frame):
    facts = frame([("a",), ("b",)], "site string")
    table = frame([("a", 1.0, "x")], "site string, si_lat double, si_remarks string")
    out = metadata.attach_site_metadata(facts, table)
    assert out.columns == ["site", "latitude"]
    assert values(out, "site", "latitude") == [("a", 1.0), ("b", None)]


def test_auto_encode_kinds(frame):
    rows = [(f"c{i % 3}", str(i % 30), str(i % 20), str(i) if i % 2 else f"x{i}", "7.5" if i else "bad") for i in range(200)]
    df = frame(rows, "few string, numbers string, classes string, many string, pl_age string")
    out = metadata.auto_encode(df)
    assert out.columns == ["numbers", "pl_age", "few_code", "classes_code", "many_code"]
    assert set(dict(out.dtypes).values()) == {"double"}
    assert {r[0] for r in out.select("few_code").distinct().collect()} == {0.0, 1.0, 2.0}
    assert out.select(F.count_distinct("classes_code")).first()[0] == 20
    assert out.select(F.count("pl_age")).first()[0] == 199
    treated = metadata.auto_encode(df, treat={"many": "drop", "few": "keep", "classes": "number", "pl_age": "code"})
    assert treated.columns == ["few", "numbers", "classes", "pl_age_code"]
    with pytest.raises(ValueError, match="unknown treatment"):
        metadata.auto_encode(df, treat={"many": "hash"})


@pytest.mark.parametrize("n", [100, 101, 1000])
@pytest.mark.parametrize("size", [{}, {"max_rows": 50, "block_rows": 30}])
def test_every_value_of_any_number_of_values_is_coded(frame, n, size):
    rows = [(i, f"v{i % n:04d}" if i % n else None) for i in range(2 * n)]
    out = values(metadata.auto_encode(frame(rows, "id int, t string"), **size), "id", "t_code")
    assert out == [(i, float(i % n - 1 if i % n else n - 1)) for i in range(2 * n)]


def test_known_codes_stay_and_new_values_follow(frame):
    first = metadata.value_codes(frame([("b",), ("a",), (None,)], "t string"), ["t"])
    assert values(first, "value", "code", order=["code"]) == [("a", 0.0), ("b", 1.0), (None, 2.0)]
    again = metadata.value_codes(frame([("aa",), ("b",), (None,), ("0",)], "t string"), ["t"], known=first)
    assert values(again, "value", "code", order=["code"]) == [("a", 0.0), ("b", 1.0), (None, 2.0), ("0", 3.0), ("aa", 4.0)]
    out = metadata.encode_values(frame([(1, "aa"), (2, None), (3, "zz")], "id int, t string"), again, ["t"])
    assert values(out, "id", "t_code") == [(1, 4.0), (2, 2.0), (3, None)]
    assert values(metadata.value_codes(frame([("b",)], "t string"), ["t"], null=True), "value", order=["code"]) == [("b",), (None,)]


def test_columns_without_values(frame):
    out = metadata.auto_encode(frame([(1, None), (2, None)], "id int, t string"))
    assert values(out, "id", "t_code") == [(1, 0.0), (2, 0.0)]
    assert metadata.auto_encode(frame([], "id int, t string")).columns == ["id", "t_code"]


def test_codes_agree_between_parts_of_a_table(frame):
    df = frame([("s1", "b"), ("s2", "a"), ("s2", "b"), ("s1", None)], "site string, kind string")
    out = values(metadata.auto_encode(df), "site", "kind_code")
    assert out == [("s1", 1.0), ("s1", 2.0), ("s2", 0.0), ("s2", 1.0)]


def test_feature_lists():
    columns = ["site", "TIMESTAMP", "ta", "stand_age", "x_flags", "y_md", "sap_flow", "depth"]
    assert align.feature_list(columns, "sap_flow") == ["ta", "stand_age", "depth"]
    # 'ta' is also part of 'stand_age': the name parts match loosely
    assert align.priority_features(columns, "sap_flow", above=2, cap=30) == ["ta", "stand_age"]
    assert align.priority_features(columns, "sap_flow", above=3) == ["ta", "stand_age", "depth"]


def test_align_schema(frame):
    df = frame([(1.0, 2.0, float("inf"))], "ta double, netrad double, soil_depth double")
    out = align.align_schema(df)
    assert "netrad" not in out.columns and set(align.EXPECTED) <= set(out.columns) and "leaf_habit_code" in out.columns
    assert out.first().soil_depth is None and out.first().ta == 1.0


def test_fill_features(frame):
    df = frame([(1.0, None), (None, 2.0)], "y double, ta double")
    out = align.fill_features(df, ["ta", "rh"], "y")
    assert [tuple(r) for r in out.select("y", "ta", "rh").collect()] == [(1.0, 0.0, 0.0)]
