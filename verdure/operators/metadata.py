"""Attaching site and plant metadata, and encoding categorical columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdure.functions import derived
from verdure.functions.codes import BY_COLUMN
from verdure.functions.cuts import encode
from verdure.operators.joins import lookup_join
from verdure.operators.ordered import ranked
from verdure.session import materialize

# Metadata column -> feature column.
SITE_COLUMNS = {
    "si_lat": "latitude",
    "si_long": "longitude",
    "si_elev": "elevation",
    "si_mat": "mean_annual_temp",
    "si_map": "mean_annual_precip",
    "si_biome": "biome",
    "si_igbp": "igbp_class",
    "si_country": "country",
    "si_code": "site_code",
    "si_name": "site_name",
    "is_inside_country": "is_inside_country",
    "st_age": "stand_age",
    "st_basal_area": "basal_area",
    "st_density": "tree_density",
    "st_height": "stand_height",
    "st_lai": "leaf_area_index",
    "st_clay_perc": "clay_percentage",
    "st_sand_perc": "sand_percentage",
    "st_silt_perc": "silt_percentage",
    "st_soil_depth": "soil_depth",
    "st_USDA_soil_texture": "soil_texture",
    "st_terrain": "terrain",
    "st_growth_condition": "growth_condition",
    "sp_name": "species_name",
    "sp_leaf_habit": "leaf_habit",
    "sp_ntrees": "n_trees",
    "env_timestep": "measurement_timestep",
    "env_time_zone": "timezone",
}
PLANT_COLUMNS = (
    "pl_age", "pl_dbh", "pl_height", "pl_leaf_area", "pl_bark_thick", "pl_social", "pl_species",
    "pl_sapw_area", "pl_sapw_depth",
)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row of each key in the given order, found by a partial aggregate instead of a sort."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last row of each key in the given order."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


def attach_site_metadata(
    df: DataFrame, table: DataFrame, site: str = "site", names: Mapping[str, str] = SITE_COLUMNS
) -> DataFrame:
    """Left join of the known site columns under their feature names; unknown columns are left out."""
    picked = table.select(site, *[F.col(c).alias(n) for c, n in names.items() if c in table.columns])
    return lookup_join(df, picked, [site], "left")


def attach_plant_metadata(
    df: DataFrame,
    plants: DataFrame,
    plant_id: str = "plant_id",
    code: str = "pl_code",
    order: Sequence[str] = (),
    site: Sequence[str] = (),
    columns: Sequence[str] = PLANT_COLUMNS,
) -> DataFrame:
    """Left join of plant attributes by plant code (and site, if the codes are per site).

    One row of a repeated code is attached: the last in the given order, without an order the largest by value.
    """
    kept = [c for c in columns if c in plants.columns]
    order = order or kept
    if order:
        plants = last_per_key(plants.select(*dict.fromkeys([*site, code, *kept, *order])), [*site, code], order)
    picked = plants.select(*site, F.col(code).alias(plant_id), *kept)
    return lookup_join(df, picked, [*site, plant_id], "left")


def add_columns(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    return df.select("*", *[c.alias(n) for n, c in columns.items()])


def derive_metadata(df: DataFrame) -> DataFrame:
    """Adds every derived metadata feature whose inputs are there."""
    return df.withColumns(derived.metadata(df.columns))


def encode_known(df: DataFrame, tables: Mapping[str, Mapping[str, int]] = BY_COLUMN, drop: bool = True) -> DataFrame:
    """``<column>_code`` for every column with a code table; the text column is dropped."""
    known = [c for c in df.columns if c in tables]
    coded = df.withColumns({f"{c}_code": encode(F.col(c), tables[c]) for c in known})
    return coded.drop(*known) if drop else coded


# Text columns left alone, and text columns known to hold numbers.
PRESERVED = ("TIMESTAMP", "solar_TIMESTAMP", "plant_id", "sap_flow", "site")
NUMERIC = (
    "latitude", "longitude", "elevation", "mean_annual_temp", "mean_annual_precip", "stand_age", "basal_area",
    "tree_density", "stand_height", "leaf_area_index", "clay_percentage", "sand_percentage", "silt_percentage",
    "soil_depth", "pl_age", "pl_dbh", "pl_height", "pl_leaf_area", "pl_bark_thick", "pl_sapw_area",
    "pl_sapw_depth", "measurement_timestep", "swc_shallow_depth", "timezone_offset", "measurement_frequency",
)
# Number-like text columns with at most so many values are taken for classes, as the feature table always did.
FEW = 20
TREATMENTS = ("code", "number", "drop", "keep")


def text_columns(df: DataFrame, preserved: Sequence[str] = PRESERVED) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in preserved]


def _number_like(df: DataFrame, columns: Sequence[str]) -> set[str]:
    """The columns whose every text is a number, unless they have at most ``FEW`` different ones.

    One pass with counters and sketches; only the few values of number-like columns near the limit are counted exactly.
    """
    if not columns:
        return set()
    picks = []
    for i, c in enumerate(columns):
        picks.append(F.count_if(F.col(c).isNotNull() & F.col(c).try_cast("double").isNull()).alias(f"texts{i}"))
        picks.append(F.approx_count_distinct(c, 0.05).alias(f"values{i}"))
    row = df.agg(*picks).first()
    numbers = {c: row[f"values{i}"] for i, c in enumerate(columns) if row[f"texts{i}"] == 0 and row[f"values{i}"] > 0}
    near = [c for c, n in numbers.items() if n <= 2 * FEW]
    few = set()
    if near:
        exact = df.agg(*[F.count_distinct(c).alias(c) for c in near]).first()
        few = {c for c in near if exact[c] <= FEW}
    return set(numbers) - few


def value_codes(
    df: DataFrame, columns: Sequence[str], known: DataFrame | None = None, null: bool | None = None, **size
) -> DataFrame:
    """A code for every value of the text columns, however many: ``column, value, code``.

    Codes number the values of the whole table in sorted order from 0, null last, so that all parts of the table agree
    on them. ``known`` is an earlier table of codes: its codes stay, and values it lacks are numbered after them. A
    null has a code if the column has nulls, or as ``null`` says. A column with very many values is numbered in
    pieces. The result is written.
    """
    values = df.select(*columns).unpivot([], list(columns), "column", "value").distinct()
    if null is not None:
        values = values.where(F.col("value").isNotNull())
    if null:
        names = df.sparkSession.createDataFrame([(c, None) for c in columns], "column string, value string")
        values = values.unionByName(names)
    if known is not None:
        same = (values["column"] == known["column"]) & values["value"].eqNullSafe(known["value"])
        values = values.join(known, same, "left_anti")
    placed = ranked(values.withColumn("_null", F.col("value").isNull()), ["column"], ["_null", "value"], "_rn", **size)
    code = F.col("_rn") - 1
    if known is not None:
        # one row per column
        taken = known.groupBy("column").agg((F.max("code") + 1).alias("_taken"))
        placed = placed.join(F.broadcast(taken), "column", "left")
        code = code + F.coalesce("_taken", F.lit(0))
    made = placed.select("column", "value", code.cast("double").alias("code"))
    return materialize(made if known is None else known.select("column", "value", "code").unionByName(made), "codes")


def encode_values(df: DataFrame, codes: DataFrame, columns: Sequence[str], drop: bool = True) -> DataFrame:
    """``<column>_code`` from a table of codes; a value it lacks gives null. The text columns are dropped."""
    for c in columns:
        # in a struct null matches null
        own = codes.where(F.col("column") == c).select(F.struct(F.col("value").alias("v")).alias("_v"), F.col("code").alias(f"{c}_code"))
        coded = lookup_join(df.withColumn("_v", F.struct(F.col(c).alias("v"))), own, ["_v"], "left")
        df = coded.select(*df.columns, f"{c}_code")
    return df.drop(*columns) if drop else df


def auto_encode(
    df: DataFrame,
    preserved: Sequence[str] = PRESERVED,
    numeric: Sequence[str] = NUMERIC,
    treat: Mapping[str, str] | None = None,
    known: DataFrame | None = None,
    **size,
) -> DataFrame:
    """Turns the remaining text columns into numbers, however many values they have.

    ``treat`` names the treatment of a column: ``code`` numbers its values, ``number`` casts them and makes other
    text null, ``drop`` leaves the column out, ``keep`` leaves it alone. Without one, a column of ``numeric`` is
    cast; another column is cast if all its texts are numbers and there are more than ``FEW`` of them, and coded
    otherwise, so that no value is lost. Codes are those of ``value_codes``; ``known`` holds earlier ones.
    """
    treat = dict(treat or {})
    wrong = sorted(set(treat.values()) - set(TREATMENTS))
    if wrong:
        raise ValueError(f"unknown treatment {wrong}, expected one of {TREATMENTS}")
    text = text_columns(df, [p for p in preserved if p not in treat])
    treat = {c: "number" for c in text if c in numeric} | treat
    numbers = _number_like(df, [c for c in text if c not in treat])
    kinds = {c: treat.get(c) or ("number" if c in numbers else "code") for c in text}
    of = lambda kind: [c for c in text if kinds[c] == kind]
    out = df.withColumns({c: F.col(c).try_cast("double") for c in of("number")}).drop(*of("drop"))
    if not of("code"):
        return out
    return encode_values(out, value_codes(df, of("code"), known, **size), of("code"))
