"""Derived site, plant and driver features as column expressions."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column
from pyspark.sql import functions as F

from verdure.functions import codes
from verdure.functions.cuts import cut, encode

EPSILON = 1e-6


def climate(latitude: Column) -> dict[str, Column]:
    return {
        "climate_zone_code": cut(latitude, codes.LATITUDE_EDGES, [float(c) for c in codes.CLIMATE_ZONE.values()]),
        "latitude_abs": F.abs(latitude),
        "climate_zone": cut(latitude, codes.LATITUDE_EDGES, list(codes.CLIMATE_ZONE)),
    }


def plant_classes(dbh: Column, age: Column) -> dict[str, Column]:
    return {
        "tree_size_class": cut(dbh, codes.SIZE_EDGES, list(codes.SIZE_CLASS)),
        "tree_age_class": cut(age, codes.AGE_EDGES, list(codes.AGE_CLASS)),
    }


def utc_offset(zone: Column) -> Column:
    """Signed two-digit hour offset inside a time zone text, null if there is none."""
    return F.nullif(F.regexp_extract(zone, r"([+-]\d{2})", 1), F.lit("")).try_cast("double")


def aridity(precipitation: Column, temperature: Column) -> Column:
    return F.try_divide(precipitation, temperature + 10)


def volume_index(dbh: Column, height: Column) -> Column:
    return F.pow(dbh, 2) * height


def per_hour(timestep: Column) -> Column:
    """Readings per hour from the minutes between readings."""
    return F.try_divide(F.lit(60.0), timestep)


def sapwood_leaf_ratio(sapwood: Column, leaf: Column) -> Column:
    return sapwood / (leaf + F.lit(EPSILON))


def domain(have: Collection[str]) -> dict[str, Column]:
    """Physiological features for which the table has the inputs."""
    c = F.col
    out = {}
    if "ta" in have:
        out["temp_deviation"] = F.abs(c("ta") - 25)
    if "pl_dbh" in have:
        out["tree_size_factor"] = F.ln(c("pl_dbh") + 1)
    if {"pl_sapw_area", "pl_leaf_area"} <= set(have):
        out["sapwood_leaf_ratio"] = sapwood_leaf_ratio(c("pl_sapw_area"), c("pl_leaf_area"))
        if {"vpd", "ppfd_in"} <= set(have):
            out["transpiration_capacity"] = c("pl_sapw_area") * c("ppfd_in") / (c("vpd") + F.lit(EPSILON))
    return out


def interactions(have: Collection[str]) -> dict[str, Column]:
    """Driver products and ratios, off by default in the feature table."""
    products = {
        "vpd_ppfd_interaction": ("vpd", "ppfd_in"),
        "wind_vpd_interaction": ("ws", "vpd"),
        "stomatal_control_index": ("vpd", "ppfd_in", "ext_rad"),
    }
    ratios = {
        "temp_humidity_ratio": ("ta", "vpd"),
        "water_stress_index": ("swc_shallow", "vpd"),
        "ppfd_efficiency": ("ppfd_in", "sw_in"),
        "stomatal_conductance_proxy": ("ppfd_in", "vpd"),
        "light_efficiency": ("ppfd_in", "ext_rad"),
    }
    out = {}
    for name, factors in products.items():
        if set(factors) <= set(have):
            product = F.col(factors[0])
            for f in factors[1:]:
                product = product * F.col(f)
            out[name] = product
    for name, (over, under) in ratios.items():
        if {over, under} <= set(have):
            out[name] = F.col(over) / (F.col(under) + F.lit(EPSILON))
    return out


def metadata(have: Collection[str]) -> dict[str, Column]:
    """All features derived from site and plant metadata for which the table has the inputs."""
    c, have = F.col, set(have)
    out: dict[str, Column] = {}
    if "latitude" in have:
        out |= climate(c("latitude"))
    if {"mean_annual_temp", "mean_annual_precip"} <= have:
        out["aridity_index"] = aridity(c("mean_annual_precip"), c("mean_annual_temp"))
    for name, column, table in (
        ("leaf_habit_code", "leaf_habit", codes.LEAF_HABIT),
        ("biome_code", "biome", codes.BIOME),
        ("igbp_code", "igbp_class", codes.IGBP),
        ("social_status_code", "pl_social", codes.SOCIAL),
    ):
        if column in have:
            out[name] = encode(c(column), table)
    if "pl_dbh" in have:
        out["tree_size_class"] = cut(c("pl_dbh"), codes.SIZE_EDGES, list(codes.SIZE_CLASS))
    if "pl_age" in have:
        out["tree_age_class"] = cut(c("pl_age"), codes.AGE_EDGES, list(codes.AGE_CLASS))
    if {"pl_sapw_area", "pl_leaf_area"} <= have:
        out["sapwood_leaf_ratio"] = sapwood_leaf_ratio(c("pl_sapw_area"), c("pl_leaf_area"))
    if {"pl_dbh", "pl_height"} <= have:
        out["tree_volume_index"] = volume_index(c("pl_dbh"), c("pl_height"))
    if "timezone" in have:
        out["timezone_offset"] = utc_offset(c("timezone"))
    if "measurement_timestep" in have:
        out["measurement_frequency"] = per_hour(c("measurement_timestep"))
    return out
