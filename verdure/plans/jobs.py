"""Whole jobs: feature table of an archive, flag audit, index report."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdure.operators import greenness, profile, quality
from verdure.plans import feature_table
from verdure.session import materialize
from verdure.sources import sinks, stations


def process_archive(
    spark: SparkSession,
    root: str,
    out: str,
    tiers: DataFrame | None = None,
    include: Sequence[str] = (),
    force: bool = False,
    **options,
) -> DataFrame:
    """Builds the feature table of all sites not yet in ``out`` and adds it there, one folder per site.

    ``tiers`` lists sites by quality tier; excluded tiers stay out even with ``force``, which only
    replaces the output of sites processed before. Only files of the sites to do are read. Codes of metadata texts are
    kept beside the output, in ``<out>-codes``, so that later runs use the same. Returns one row per outcome with sites
    and rows.
    """
    sites = stations.site_catalog(spark, root).select("site").distinct()
    if tiers is not None:
        sites = quality.exclude_sites(sites, tiers, include).select("site")
    done = None if force else sinks.read_if_there(spark, out, "site string")
    todo = sites if done is None else profile.pending(sites, done)
    todo = materialize(todo, "todo")
    options.setdefault("codes_path", f"{out.rstrip('/')}-codes")
    table = feature_table.build_from_archive(spark, root, sites=todo, **options)
    sinks.write_parquet(table, out, mode="overwrite" if force else "append")
    rows = spark.read.schema("site string").parquet(out).groupBy("site").agg(F.count(F.lit(1)).alias("n_rows"))
    verdicts = todo.join(rows, "site", "left").select(
        F.when(F.col("n_rows").isNotNull(), "ok").otherwise("failed").alias("status"),
        F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
        F.lit(len(table.columns)).alias("n_columns"),
    )
    return profile.run_summary(verdicts)


def audit_archive(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """All flag audit tables of an archive, empty without flag files. The audit per site is written once and shared."""
    listed = stations.site_catalog(spark, root).where("part = 'flags'").select("kind").distinct().collect()
    kinds = sorted(r["kind"] for r in listed)
    if not kinds:
        none = spark.createDataFrame([], "site string, col_name string, flag string, kind string")
    long = [
        stations.read_long(spark, root, k, "flags", "col_name", "flag").withColumn("kind", F.lit(k)) for k in kinds
    ]
    flags = reduce(DataFrame.unionByName, long) if long else none
    audit = materialize(quality.site_audit(flags), "audit")
    return {
        "sites": audit,
        "total": quality.site_rollup(flags).where("is_total = 1"),
        "columns": quality.column_rate(flags, ["kind", "col_name"]),
        "presence": quality.site_presence(audit),
        "tiers": quality.tiers(audit),
        "concentration": quality.concentration(audit),
        "pareto": quality.pareto(audit),
        "top_count": quality.top_by_count(audit),
        "top_rate": quality.top_by_rate(audit),
    }


def index_report(scenes: DataFrame) -> dict[str, DataFrame]:
    """The tables of the vegetation index report."""
    return {
        "overview": greenness.overview(scenes),
        "statistics": greenness.global_stats(scenes),
        "quality": greenness.quality_counts(scenes),
        "sites": greenness.site_summary(scenes),
        "top_sites": greenness.top_sites(scenes, 10),
        "months": greenness.grouped_stats(scenes, [F.month("date").alias("month")]),
        "years": greenness.grouped_stats(scenes, [F.year("date").alias("year")]),
        "missions": greenness.mission_stats(scenes),
        "classes": greenness.class_counts(scenes, report=True),
    }
