"""Queries over flags, ingest and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdure.catalog.registry import query, rounded
from verdure.operators import quality as ops
from verdure.operators import reshape
from verdure.plans import bindings as b

_FLOW_SQL = """SELECT site, ts, 'tree_1' AS plant_id, tree_1 AS sap_flow FROM flow_wide
    UNION ALL SELECT site, ts, 'tree_2', tree_2 FROM flow_wide"""
_BAD = "flag IN ('OUT_WARN', 'RANGE_WARN')"
_AUDIT_SQL = f"""SELECT *, env_warn + sapf_warn AS total_warn, env_total + sapf_total AS total_data,
    coalesce(env_warn * 100.0e0 / nullif(env_total, 0), 0) AS env_flag_percent,
    coalesce(sapf_warn * 100.0e0 / nullif(sapf_total, 0), 0) AS sapf_flag_percent,
    coalesce((env_warn + sapf_warn) * 100.0e0 / nullif(env_total + sapf_total, 0), 0) AS overall_flag_percent
    FROM (SELECT site,
      count(*) FILTER (WHERE kind = 'env' AND {_BAD}) AS env_warn, count(flag) FILTER (WHERE kind = 'env') AS env_total,
      count(*) FILTER (WHERE kind = 'sapf' AND {_BAD}) AS sapf_warn, count(flag) FILTER (WHERE kind = 'sapf') AS sapf_total
      FROM flags GROUP BY site) a"""
_PERCENTS = ("env_flag_percent", "sapf_flag_percent", "overall_flag_percent")
# flags per part supplier: an audit with many sites
_MANY_SQL = """SELECT l_suppkey AS site, CASE WHEN l_linenumber % 3 = 0 THEN 'env' ELSE 'sapf' END AS kind,
    CASE WHEN l_discount >= 0.09 THEN 'OUT_WARN' WHEN l_tax >= 0.08 THEN 'RANGE_WARN'
         WHEN l_linenumber % 2 = 0 THEN 'OK' END AS flag FROM lineitem"""


def _flow(spark, sf_dir):
    return reshape.melt(b.flow_wide(spark, sf_dir), ["site", "ts"], None, "plant_id", "sap_flow")


def _many_flags(spark, sf_dir):
    line = F.col("l_linenumber")
    return b.table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("site"),
        F.when(line % 3 == 0, "env").otherwise("sapf").alias("kind"),
        F.when(F.col("l_discount") >= 0.09, "OUT_WARN")
        .when(F.col("l_tax") >= 0.08, "RANGE_WARN")
        .when(line % 2 == 0, "OK")
        .alias("flag"),
    )


def _audit_cte(body: str) -> str:
    return b.with_cte(body, extra={"flags": _MANY_SQL, "audit": _AUDIT_SQL})


@query(
    "melt_series",
    b.with_cte("SELECT site, ts, plant_id, round(sap_flow, 6) AS sap_flow FROM flow", "flow_wide", extra={"flow": _FLOW_SQL}),
)
def melt_series(spark, sf_dir):
    return rounded(_flow(spark, sf_dir), "sap_flow")


@query(
    "valid_series",
    """SELECT event_type AS site, user_id AS plant_id, count(*) AS n_rows,
       count(CASE WHEN value > 60 THEN value END) AS n_values,
       count(CASE WHEN value > 60 THEN value END) > 0 AS is_valid
       FROM events GROUP BY event_type, user_id""",
)
def valid_series(spark, sf_dir):
    # readings up to 60 stand for cells without a number
    cells = b.series(spark, sf_dir).withColumn("cell", F.when(F.col("ta") > 60, F.col("ta").cast("string")).otherwise("NA"))
    return reshape.valid_series(cells, ["site", "plant_id"], "cell")


@query(
    "flag_filter_row",
    b.with_cte(
        f"""SELECT site, ts, plant_id, round(sap_flow, 6) AS sap_flow FROM flow f WHERE NOT EXISTS
        (SELECT 1 FROM flags g WHERE g.site = f.site AND g.ts = f.ts AND {_BAD})""",
        "flow_wide",
        "flags",
        extra={"flow": _FLOW_SQL},
    ),
)
def flag_filter_row(spark, sf_dir):
    return rounded(ops.drop_flagged_rows(_flow(spark, sf_dir), b.flags(spark, sf_dir)), "sap_flow")


@query(
    "flag_filter_required",
    b.with_cte(
        f"""SELECT site, ts, plant_id, round(sap_flow, 6) AS sap_flow FROM flow f WHERE NOT EXISTS
        (SELECT 1 FROM checked g WHERE g.site = f.site AND g.ts = f.ts AND {_BAD})
        AND EXISTS (SELECT 1 FROM checked g WHERE g.site = f.site AND g.ts = f.ts)""",
        "flow_wide",
        "flags",
        extra={"flow": _FLOW_SQL, "checked": "SELECT * FROM flags WHERE kind = 'env'"},
    ),
)
def flag_filter_required(spark, sf_dir):
    """Readings without any flag row go too, as in an inner join of readings and flags."""
    checked = b.flags(spark, sf_dir).where("kind = 'env'")
    return rounded(ops.drop_flagged_rows(_flow(spark, sf_dir), checked, require_flags=True), "sap_flow")


@query(
    "flag_filter_cell",
    b.with_cte(
        f"""SELECT site, ts, col_name, round(sap_flow, 6) AS sap_flow FROM
        (SELECT site, ts, plant_id AS col_name, sap_flow FROM flow) f WHERE NOT EXISTS
        (SELECT 1 FROM flags g WHERE g.site = f.site AND g.ts = f.ts AND g.col_name = f.col_name AND {_BAD})""",
        "flow_wide",
        "flags",
        extra={"flow": _FLOW_SQL},
    ),
)
def flag_filter_cell(spark, sf_dir):
    cells = _flow(spark, sf_dir).withColumnRenamed("plant_id", "col_name")
    return rounded(ops.drop_flagged_cells(cells, b.flags(spark, sf_dir)), "sap_flow")


@query(
    "flow_env_join",
    b.with_cte(
        """SELECT site, ts, plant_id, round(sap_flow, 6) AS sap_flow, round(e.ta, 6) AS ta, e.sw_in, e.vpd, e.precip
        FROM flow JOIN env e USING (site, ts) WHERE sap_flow IS NOT NULL""",
        "flow_wide",
        "env",
        extra={"flow": _FLOW_SQL},
    ),
)
def flow_env_join(spark, sf_dir):
    joined = reshape.join_drivers(_flow(spark, sf_dir), b.env(spark, sf_dir), ["site", "ts"], "sap_flow")
    return rounded(joined, "sap_flow", "ta")


_AUDIT_OUT = (
    "site, env_warn, env_total, sapf_warn, sapf_total, total_warn, total_data, "
    + ", ".join(f"round({c}, 6) AS {c}" for c in _PERCENTS)
)


@query("flag_site_audit", b.with_cte(f"SELECT {_AUDIT_OUT} FROM audit", "flags", extra={"audit": _AUDIT_SQL}))
def flag_site_audit(spark, sf_dir):
    return rounded(ops.site_audit(b.flags(spark, sf_dir)), *_PERCENTS)


@query(
    "flag_rollup",
    b.with_cte(
        f"SELECT {_AUDIT_OUT}, is_total FROM audit",
        "flags",
        extra={
            "audit": _AUDIT_SQL.replace("(SELECT site,", "(SELECT site, CAST(grouping(site) AS INTEGER) AS is_total,").replace(
                "GROUP BY site", "GROUP BY ROLLUP (site)"
            )
        },
    ),
)
def flag_rollup(spark, sf_dir):
    return rounded(ops.site_rollup(b.flags(spark, sf_dir)), *_PERCENTS)


@query(
    "flag_column_rate",
    b.with_cte(
        f"""SELECT kind, col_name, count(*) FILTER (WHERE {_BAD}) AS warn, count(flag) AS total,
        round(coalesce(count(*) FILTER (WHERE {_BAD}) * 100.0e0 / nullif(count(flag), 0), 0), 6) AS flag_percent
        FROM flags GROUP BY kind, col_name""",
        "flags",
    ),
)
def flag_column_rate(spark, sf_dir):
    return rounded(ops.column_rate(b.flags(spark, sf_dir), ["kind", "col_name"]), "flag_percent")


@query(
    "flag_site_presence",
    _audit_cte(
        """SELECT count(*) AS sites, count(*) FILTER (WHERE total_warn > 0) AS sites_with_flags,
        count(*) FILTER (WHERE total_warn = 0) AS sites_without_flags,
        round(count(*) FILTER (WHERE total_warn > 0) * 100.0e0 / count(*), 6) AS with_percent,
        round(count(*) FILTER (WHERE total_warn = 0) * 100.0e0 / count(*), 6) AS without_percent FROM audit"""
    ),
)
def flag_site_presence(spark, sf_dir):
    return rounded(ops.site_presence(ops.site_audit(_many_flags(spark, sf_dir))), "with_percent", "without_percent")


@query(
    "flag_tiers",
    _audit_cte(
        """SELECT CASE WHEN total_warn <= 100 THEN 'low' WHEN total_warn <= 125 THEN 'medium'
        WHEN total_warn <= 140 THEN 'high' ELSE 'very_high' END AS tier, count(*) AS sites,
        CAST(sum(total_warn) AS BIGINT) AS flags FROM audit GROUP BY 1"""
    ),
)
def flag_tiers(spark, sf_dir):
    limits = (("low", 100), ("medium", 125), ("high", 140))
    return ops.tiers(ops.site_audit(_many_flags(spark, sf_dir)), limits)


@query(
    "flag_concentration",
    _audit_cte(
        """SELECT round(avg(total_warn), 6) AS mean_flags, round(stddev_samp(total_warn), 6) AS std_flags,
        round(stddev_samp(total_warn) / avg(total_warn), 6) AS variation,
        round(CAST(quantile_cont(total_warn, 0.5) AS DOUBLE), 6) AS median_flags FROM audit"""
    ),
)
def flag_concentration(spark, sf_dir):
    out = ops.concentration(ops.site_audit(_many_flags(spark, sf_dir)))
    return rounded(out, "mean_flags", "std_flags", "variation", "median_flags")


@query(
    "pareto_sites",
    _audit_cte(
        """SELECT count(*) AS sites, count(*) FILTER (WHERE running <= total * 0.5) AS sites_within_50pct,
        count(*) FILTER (WHERE running <= total * 0.8) AS sites_within_80pct,
        count(*) FILTER (WHERE running <= total * 0.9) AS sites_within_90pct
        FROM (SELECT sum(total_warn) OVER (ORDER BY total_warn DESC, site ROWS UNBOUNDED PRECEDING) AS running,
                     sum(total_warn) OVER () AS total FROM audit) p"""
    ),
)
def pareto_sites(spark, sf_dir):
    return ops.pareto(ops.site_audit(_many_flags(spark, sf_dir)))


@query(
    "top_flag_count",
    _audit_cte(
        """SELECT site, total_warn, round(overall_flag_percent, 6) AS overall_flag_percent FROM audit
        ORDER BY total_warn DESC, site LIMIT 10"""
    ),
)
def top_flag_count(spark, sf_dir):
    return rounded(ops.top_by_count(ops.site_audit(_many_flags(spark, sf_dir))), "overall_flag_percent")


@query(
    "top_flag_rate",
    _audit_cte(
        """SELECT site, total_warn, round(overall_flag_percent, 6) AS overall_flag_percent FROM audit
        WHERE total_data > 300 ORDER BY overall_flag_percent DESC, site LIMIT 10"""
    ),
)
def top_flag_rate(spark, sf_dir):
    out = ops.top_by_rate(ops.site_audit(_many_flags(spark, sf_dir)), more_than=300)
    return rounded(out, "overall_flag_percent")


_TIERS_SQL = """SELECT c_nationkey AS site, CASE WHEN avg(c_acctbal) > 4800 THEN 'no_data'
    WHEN avg(c_acctbal) > 4600 THEN 'extreme' WHEN avg(c_acctbal) > 4400 THEN 'high'
    WHEN avg(c_acctbal) > 4200 THEN 'moderate' ELSE 'good' END AS tier FROM customer GROUP BY c_nationkey"""


def _tier_table(spark, sf_dir):
    mean = F.avg("c_acctbal")
    tier = (
        F.when(mean > 4800, "no_data").when(mean > 4600, "extreme").when(mean > 4400, "high").when(mean > 4200, "moderate")
    )
    return (
        b.table(spark, sf_dir, "customer")
        .groupBy(F.col("c_nationkey").alias("site"))
        .agg(tier.otherwise("good").alias("tier"))
    )


@query(
    "site_tier_filter",
    b.with_cte(
        """SELECT o_orderkey, c_nationkey AS site, tier = 'moderate' AS quality_warning FROM orders
        JOIN customer ON o_custkey = c_custkey JOIN tiers ON c_nationkey = site
        WHERE tier NOT IN ('no_data', 'extreme')""",
        extra={"tiers": _TIERS_SQL},
    ),
)
def site_tier_filter(spark, sf_dir):
    customers = b.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("site"))
    rows = b.table(spark, sf_dir, "orders").join(customers, "o_custkey").select("o_orderkey", "site")
    return ops.exclude_sites(rows, _tier_table(spark, sf_dir), include=["high"])


@query(
    "tier_union",
    """SELECT l_suppkey AS site FROM lineitem GROUP BY l_suppkey HAVING avg(l_discount) > 0.05
       UNION SELECT l_suppkey FROM lineitem GROUP BY l_suppkey HAVING sum(l_quantity) > 15500
       UNION SELECT s_suppkey FROM supplier WHERE s_acctbal < 0""",
)
def tier_union(spark, sf_dir):
    lines = b.table(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "site")
    sums = lines.groupBy("site").agg(ops.mean_above("l_discount", "0.05").alias("high_rate"), F.sum("l_quantity").alias("amount"))
    poor = b.table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("site"))
    return ops.tier_union(sums.where("high_rate"), sums.where("amount > 15500"), poor)
