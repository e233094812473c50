from __future__ import annotations

from conftest import values
from pyspark.sql import functions as F

from verdure.operators import quality, reshape


def flow(frame):
    wide = frame([("s", 1, 1.0, 2.0), ("s", 2, 3.0, 4.0), ("s", 3, 5.0, None)], "site string, ts int, tree_1 double, tree_2 double")
    return reshape.melt(wide, ["site", "ts"], None, "col_name", "v")


def flags(frame):
    wide = frame([("s", 1, "OUT_WARN", None), ("s", 2, None, "OK")], "site string, ts int, tree_1 string, tree_2 string")
    return wide, reshape.melt(wide, ["site", "ts"], None, "col_name", "flag")


def test_row_filter_drops_the_time_for_all_trees(frame):
    out = quality.drop_flagged_rows(flow(frame), flags(frame)[1])
    assert values(out, "ts", "col_name") == [(2, "tree_1"), (2, "tree_2"), (3, "tree_1"), (3, "tree_2")]
    strict = quality.drop_flagged_rows(flow(frame), flags(frame)[1], require_flags=True)
    assert values(strict, "ts", "col_name") == [(2, "tree_1"), (2, "tree_2")]


def test_cell_filter_drops_one_cell(frame):
    out = quality.drop_flagged_cells(flow(frame), flags(frame)[1])
    assert (1, "tree_1") not in values(out, "ts", "col_name") and out.count() == 5


def test_filter_is_the_same_for_hot_sites(frame):
    plain = quality.drop_flagged_rows(flow(frame), flags(frame)[1])
    hot = quality.drop_flagged_rows(flow(frame), flags(frame)[1], max_rows=1)
    assert values(plain, "ts", "col_name") == values(hot, "ts", "col_name")


def test_wide_mark(frame):
    wide, _ = flags(frame)
    assert [r[0] for r in wide.orderBy("ts").select(quality.any_bad(["tree_1", "tree_2"])).collect()] == [True, False]


def test_share_is_of_cells_with_a_flag(frame):
    rows = [("s", "env", f) for f in ("OUT_WARN", "OK", None, None)] + [("t", "sapf", None)]
    audit = quality.site_audit(frame(rows, "site string, kind string, flag string"))
    got = {r.site: r for r in audit.collect()}
    assert (got["s"].env_total, got["s"].env_warn, got["s"].env_flag_percent) == (2, 1, 50.0)
    assert (got["t"].total_data, got["t"].overall_flag_percent) == (0, 0.0)


def test_rollup_has_the_grand_total(frame):
    rows = [("s", "env", "OUT_WARN"), ("t", "sapf", "RANGE_WARN"), ("t", "sapf", "OK")]
    out = quality.site_rollup(frame(rows, "site string, kind string, flag string"))
    total = out.where("is_total = 1").first()
    assert total.site is None and total.total_warn == 2 and total.total_data == 3


def audit_of(frame, counts):
    return frame([(f"s{i}", c) for i, c in enumerate(counts)], "site string, total_warn long")


def test_sites_within_a_share_leave_out_the_crossing_site(frame):
    row = quality.pareto(audit_of(frame, [50, 30, 20])).first()
    assert (row.sites_within_50pct, row.sites_within_80pct, row.sites_within_90pct) == (1, 2, 2)


def test_tiers(frame):
    out = quality.tiers(audit_of(frame, [0, 1000, 1001, 10000, 50000, 50001]))
    assert values(out, "tier", "sites") == [("high", 1), ("low", 2), ("medium", 2), ("very_high", 1)]


def test_concentration(frame):
    row = quality.concentration(audit_of(frame, [1, 2, 3, 10])).first()
    assert (row.mean_flags, row.median_flags) == (4.0, 2.5)


def test_exclusion_by_tier(frame):
    df = frame([(s,) for s in "abcdef"], "site string")
    tiers = frame(
        [("a", "no_data"), ("b", "extreme"), ("c", "high"), ("d", "moderate"), ("e", "moderate"), ("e", "high")],
        "site string, tier string",
    )
    out = quality.exclude_sites(df, tiers)
    assert values(out, "site", "quality_warning") == [("d", True), ("f", False)]
    more = quality.exclude_sites(df, tiers, include=["high", "extreme"])
    assert values(more, "site", "quality_warning") == [("b", False), ("c", False), ("d", True), ("e", True), ("f", False)]


def test_melt_then_pivot_returns_the_input(frame):
    wide = frame([(1, 1.0, None), (2, None, 4.0)], "ts int, a double, b double")
    long = reshape.melt(wide, ["ts"], None, "name", "v")
    assert long.count() == 4
    back = reshape.pivot_mean(long, "ts", "name", ["a", "b"], "v", "")
    assert values(back, "ts", "a", "b") == [(1, 1.0, None), (2, None, 4.0)]


def test_series_without_numbers_is_invalid(frame):
    rows = [("p", "NA")] * 150 + [("p", "1.5"), ("q", "NA"), ("q", None)]
    df = frame(rows, "plant string, v string")
    assert values(reshape.valid_series(df, ["plant"], "v"), "plant", "n_values", "is_valid") == [("p", 1, True), ("q", 0, False)]
    assert reshape.keep_valid_series(df, ["plant"], "v").count() == 151


def test_split_list(frame):
    out = reshape.split_list(frame([(" A , B,C",)], "sites string"), "sites")
    assert tuple(out.select("members", "primary").first()) == (["A", "B", "C"], "A")


def test_pivot_count(frame):
    out = reshape.pivot_count(frame([("s", 1), ("s", 1), ("t", 3)], "site string, m int"), "site", "m", [1, 2, 3], "m")
    assert values(out, "site", "m1", "m2", "m3", "total") == [("s", 2, 0, 0, 2), ("t", 0, 0, 1, 1)]


def test_join_drivers_drops_missing_targets(frame):
    env = frame([("s", 1, 9.0), ("s", 3, 8.0)], "site string, ts int, ta double")
    out = reshape.join_drivers(flow(frame), env, ["site", "ts"], "v")
    assert values(out, "ts", "col_name", "ta") == [(1, "tree_1", 9.0), (1, "tree_2", 9.0), (3, "tree_1", 8.0)]
    assert out.where(F.col("v").isNull()).count() == 0


def test_running_share_in_pieces(frame, monkeypatch):
    audit = audit_of(frame, [50, 30, 20, 20, 5, 5, 5, 0])
    whole = quality.pareto(audit).first()
    monkeypatch.setattr(quality, "MAX_SERIES_ROWS", 2)
    assert quality.pareto(audit).first() == whole


def test_a_mean_at_the_limit_is_not_above_it(spark):
    rows = [("tie", v) for v in (0.01, 0.04, 0.1)] + [("high", v) for v in (0.01, 0.05, 0.1)] + [("odd", 1e-9), ("odd", 0.3)]
    rows += [("nan", float("nan")), ("none", None), ("gap", None), ("gap", 0.06), ("low", 0.02)]
    df = spark.createDataFrame(rows, "site string, v double").coalesce(1)
    assert (0.01 + 0.04 + 0.1) / 3 > 0.05  # as doubles add up in this order
    out = df.groupBy("site").agg(quality.mean_above("v", "0.05").alias("above"))
    assert values(out.where("above"), "site") == [("gap",), ("high",), ("nan",), ("odd",)]


def test_tier_union_query_at_the_limit(spark, tmp_path):
    from verdure.catalog import quality as catalog

    lines = spark.createDataFrame([(1, v, 1.0) for v in (0.01, 0.04, 0.1)] + [(2, 0.06, 1.0)], "l_suppkey long, l_discount double, l_quantity double")
    lines.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(3, -1.0), (4, 1.0)], "s_suppkey long, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    assert values(catalog.tier_union(spark, str(tmp_path)), "site") == [(2,), (3,)]
