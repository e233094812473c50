"""Vegetation index expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Collection id, first and last year of service, near infrared and red band.
MISSIONS = (
    ("LANDSAT/LT05/C02/T1_L2", 1984, 2013, "SR_B4", "SR_B3"),
    ("LANDSAT/LE07/C02/T1_L2", 1999, 2021, "SR_B4", "SR_B3"),
    ("LANDSAT/LC08/C02/T1_L2", 2013, 2023, "SR_B5", "SR_B4"),
)
SENTINEL = ("COPERNICUS/S2_SR_HARMONIZED", "B8", "B4")
MAX_CLOUD = 20


def normalized_difference(nir: Column, red: Column) -> Column:
    return F.try_divide(nir - red, nir + red)


def mission_code(collection: Column) -> Column:
    """Short mission name inside a collection id, null if there is none."""
    return F.nullif(F.regexp_extract(collection, r"(L[ECT]\d+)", 1), F.lit(""))


def vegetation_class(index: Column) -> Column:
    """Classes of the data summary; 0.5 belongs to the densest class."""
    return (
        F.when(index < 0.1, "Water/Bare")
        .when(index < 0.3, "Sparse")
        .when(index < 0.5, "Dense")
        .when(index >= 0.5, "Very Dense")
    )


def vegetation_class_report(index: Column) -> Column:
    """Classes of the report; 0.5 still belongs to the middle class."""
    return (
        F.when(index < 0.1, "bare")
        .when(index < 0.3, "sparse")
        .when(index <= 0.5, "moderate")
        .when(index > 0.5, "dense")
    )


def hemisphere(latitude: Column) -> Column:
    return F.when(latitude > 0, "Northern").when(latitude <= 0, "Southern")
