"""The feature table: readings joined with weather, turned into features and described by metadata."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdure.functions import calendar, derived
from verdure.functions.codes import BY_COLUMN
from verdure.operators import align, features, metadata, quality, reshape
from verdure.operators.ordered import BLOCK_ROWS, MAX_SERIES_ROWS
from verdure.session import materialize
from verdure.sources import sinks, stations


def add_time_features(df: DataFrame, ts: str = "ts", solar_ts: str | None = None) -> DataFrame:
    """Calendar parts and, where a solar time is given, solar time with its cyclic forms."""
    columns = calendar.calendar(F.col(ts))
    if solar_ts and solar_ts in df.columns:
        columns |= calendar.solar(F.col(solar_ts))
    return metadata.add_columns(df, columns)


def build(
    flow: DataFrame,
    env: DataFrame,
    site_table: DataFrame | None = None,
    plants: DataFrame | None = None,
    flow_flags: DataFrame | None = None,
    env_flags: DataFrame | None = None,
    target: str = "sap_flow",
    order: Sequence[str] = ("ts",),
    lags: Sequence[int] = features.LAGS,
    widths: Sequence[int] = features.ROLLING_WIDTHS,
    interactions: bool = False,
    codes: DataFrame | None = None,
    max_rows: int = MAX_SERIES_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Feature table from long flow readings ``(site, ts, plant_id, <target>)`` and weather ``(site, ts, …)``.

    One shuffle by (site, ts) brings readings and weather together, one by (site, plant_id) serves
    every lag and rolling column. Metadata comes last, after the wide window stage, and is broadcast
    when it is small. Long series are looked for in the readings as they were given. Texts of the metadata
    without a code table of their own become codes, those of ``codes`` where given.
    """
    size = {"max_rows": max_rows, "count_from": flow}
    if env_flags is not None:
        env = quality.drop_flagged_rows(env, env_flags)
    if flow_flags is not None:
        flow = quality.drop_flagged_rows(flow, flow_flags)
    df = reshape.join_drivers(flow, env, ["site", "ts"], target)
    df = features.series_features(df, ["site", "plant_id"], list(order), lags=lags, widths=widths, block_rows=block_rows, **size)
    df = add_time_features(df, "ts", "solar_ts")
    if site_table is not None:
        df = metadata.attach_site_metadata(df, site_table)
    if plants is not None:
        df = metadata.attach_plant_metadata(df, plants, site=["site"] if "site" in plants.columns else ())
    df = metadata.derive_metadata(df)
    df = df.withColumns(derived.domain(df.columns))
    if interactions:
        df = df.withColumns(derived.interactions(df.columns))
    df = metadata.encode_known(df)
    texts = metadata.text_columns(df, metadata.PRESERVED)
    if texts:
        codes = text_codes(site_table, plants) if codes is None else codes
        df = metadata.encode_values(df, codes, texts)
    return align.align_schema(df, blocked=[b for b in align.BLOCKED if not interactions])


# The columns read from each metadata table that describes a site.
_PREFIXES = {"site": ("si_", "is_"), "stand": ("st_",), "species": ("sp_",), "env": ("env_",)}
METADATA = {kind: tuple(c for c in metadata.SITE_COLUMNS if c.startswith(p)) for kind, p in _PREFIXES.items()}


def _numbers(df: DataFrame) -> DataFrame:
    """Metadata texts with the columns known to hold numbers as doubles."""
    known = {*metadata.NUMERIC, "n_trees"}
    return align.to_numbers(df, [c for c in df.columns if metadata.SITE_COLUMNS.get(c, c) in known])


def site_metadata(spark, root: str, kinds: Mapping[str, Sequence[str]], sites: DataFrame | None = None) -> DataFrame | None:
    """One row per site from the metadata tables of the given kinds; of several rows the first of the file."""
    tables = []
    for kind, columns in kinds.items():
        rows = stations.read_metadata(spark, root, kind, columns, sites, line=True)
        tables.append(metadata.first_per_key(_numbers(rows), ["site"], ["line"]).drop("line"))
    return reduce(lambda a, b: a.join(b, "site", "full"), tables) if tables else None


def plant_metadata(spark, root: str, sites: DataFrame | None = None) -> DataFrame:
    """One row per site and plant code; of a repeated code the last of the file."""
    rows = stations.read_metadata(spark, root, "plant", ["pl_code", *metadata.PLANT_COLUMNS], sites, line=True)
    return metadata.last_per_key(_numbers(rows), ["site", "pl_code"], ["line"]).drop("line")


def text_codes(site_table: DataFrame | None, plants: DataFrame | None, known: DataFrame | None = None) -> DataFrame | None:
    """Codes of the texts of the small metadata tables that have no code table of their own, null included.

    ``column`` is the name in the feature table. ``known`` holds the codes of earlier runs, which stay.
    """
    parts = []
    for table in (site_table, plants):
        if table is None:
            continue
        names = {f.name: metadata.SITE_COLUMNS.get(f.name, f.name) for f in table.schema if f.dataType.simpleString() == "string"}
        free = {c: n for c, n in names.items() if n not in BY_COLUMN and n not in (*metadata.PRESERVED, "pl_code")}
        if free:
            parts.append(table.select(*[F.col(c).alias(n) for c, n in free.items()]))
    if not parts:
        return known
    columns = [c for p in parts for c in p.columns]
    return metadata.value_codes(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts), columns, known, null=True)


def build_from_archive(
    spark,
    root: str,
    drivers: Sequence[str] = (*features.LAG_DRIVERS, "ext_rad"),
    site_columns: Mapping[str, Sequence[str]] = METADATA,
    use_flags: bool = True,
    sites: DataFrame | None = None,
    codes_path: str | None = None,
    **size,
) -> DataFrame:
    """Feature table of an archive of station files, or of the ``sites`` listed, whose files alone are read.

    Texts of the metadata are coded. With ``codes_path`` the codes given there by earlier runs are used, and those of
    new values are added to it, so that tables built one after the other agree.
    """
    env = stations.read_wide(spark, root, "env", drivers, sites=sites)
    flow = stations.read_long(spark, root, "sapf", "data", "plant_id", "sap_flow", sites)
    flow = reshape.keep_valid_series(flow, ["site", "plant_id"], "sap_flow")
    listed = stations.site_catalog(spark, root).select("kind", "part").distinct().collect()  # a dozen at most
    kinds = {(r["kind"], r["part"]) for r in listed}
    flags = {}
    for kind in ("env", "sapf"):
        if use_flags and (kind, "flags") in kinds:
            flags[kind] = stations.read_long(spark, root, kind, "flags", "col_name", "flag", sites)
    listed_md = {kind: columns for kind, columns in site_columns.items() if (kind, "md") in kinds}
    # small tables that come out of aggregates, used by several joins
    site_table = site_metadata(spark, root, listed_md, sites)
    if site_table is not None:
        site_table = materialize(site_table, "site-metadata")
    plants = None
    if ("plant", "md") in kinds:
        plants = materialize(plant_metadata(spark, root, sites), "plants")
    known = sinks.read_if_there(spark, codes_path) if codes_path else None
    codes = text_codes(site_table, plants, known)
    if codes_path and codes is not None:
        fresh = codes if known is None else codes.join(known, ["column", "code"], "left_anti")
        fresh.write.mode("append").parquet(codes_path)
    return build(flow, env, site_table, plants, flags.get("sapf"), flags.get("env"), codes=codes, **size)
