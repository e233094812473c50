"""Code tables for categorical columns.

Fixed values: the numbers must stay as they are, since stored feature tables use them.
"""

from __future__ import annotations

BIOME = {
    "Tropical and Subtropical Moist Broadleaf Forests": 1,
    "Tropical and Subtropical Dry Broadleaf Forests": 2,
    "Tropical and Subtropical Coniferous Forests": 3,
    "Temperate Broadleaf and Mixed Forests": 4,
    "Temperate Conifer Forests": 5,
    "Boreal Forests/Taiga": 6,
    "Tropical and Subtropical Grasslands, Savannas and Shrublands": 7,
    "Temperate Grasslands, Savannas and Shrublands": 8,
    "Flooded Grasslands and Savannas": 9,
    "Montane Grasslands and Shrublands": 10,
    "Tundra": 11,
    "Mediterranean Forests, Woodlands and Scrub": 12,
    "Deserts and Xeric Shrublands": 13,
    "Mangroves": 14,
    "Woodland/Shrubland": 15,
}

IGBP = {
    "ENF": 1, "EBF": 2, "DNF": 3, "DBF": 4, "MF": 5, "CSH": 6, "OSH": 7, "WSA": 8,
    "SAV": 9, "GRA": 10, "WET": 11, "CRO": 12, "URB": 13, "CVM": 14, "SNO": 15, "BSV": 16,
}

COUNTRY = {
    "ARG": 1, "AUS": 2, "AUT": 3, "BRA": 4, "CAN": 5, "CHE": 6, "CHN": 7, "COL": 8,
    "CZE": 9, "DEU": 10, "ESP": 11, "FIN": 12, "FRA": 13, "GBR": 14, "GUF": 15, "JPN": 16,
    "KOR": 17, "MDG": 18, "PRT": 19, "RUS": 20, "SEN": 21, "SWE": 22, "USA": 23, "ZAF": 24,
}

SOIL_TEXTURE = {
    "clay": 1, "clay loam": 2, "loam": 3, "loamy sand": 4, "sandy clay": 5, "sandy clay loam": 6,
    "sandy loam": 7, "sand": 8, "silt": 9, "silt loam": 10, "silty clay": 11, "silty clay loam": 12,
}

ASPECT = {"N": 1, "NE": 2, "E": 3, "SE": 4, "S": 5, "SW": 6, "W": 7, "NW": 8}

TERRAIN = {
    "Flat": 1, "Gentle slope (<2 %)": 2, "Moderate slope (2-10 %)": 3, "Steep slope (>10 %)": 4,
    "Valley": 5, "Ridge": 6,
}

GROWTH_CONDITION = {
    "Naturally regenerated, managed": 1,
    "Naturally regenerated, unmanaged": 2,
    "Planted, managed": 3,
    "Planted, unmanaged": 4,
}

LEAF_HABIT = {"cold deciduous": 1, "warm deciduous": 2, "evergreen": 3, "semi-deciduous": 4}

SOCIAL = {"dominant": 3, "codominant": 2, "intermediate": 1, "suppressed": 0}

CLIMATE_ZONE = {"Temperate_South": 0, "Tropical": 1, "Temperate_North": 2}

SIZE_CLASS = {"Sapling": 0, "Small": 1, "Medium": 2, "Large": 3, "Very Large": 4}

AGE_CLASS = {"Young": 0, "Mature": 1, "Old": 2, "Very Old": 3, "Ancient": 4}

# Column of the feature table -> code table.
BY_COLUMN = {
    "biome": BIOME,
    "igbp_class": IGBP,
    "country": COUNTRY,
    "soil_texture": SOIL_TEXTURE,
    "aspect": ASPECT,
    "terrain": TERRAIN,
    "growth_condition": GROWTH_CONDITION,
    "leaf_habit": LEAF_HABIT,
    "pl_social": SOCIAL,
    "climate_zone": CLIMATE_ZONE,
    "tree_size_class": SIZE_CLASS,
    "tree_age_class": AGE_CLASS,
}

# Class borders; every class is open on the left and closed on the right.
LATITUDE_EDGES = (-90.0, -23.5, 23.5, 90.0)
SIZE_EDGES = (0.0, 10.0, 30.0, 50.0, 100.0, 1000.0)
AGE_EDGES = (0.0, 20.0, 50.0, 100.0, 200.0, 1000.0)
CLOUD_EDGES = (0.0, 5.0, 10.0, 20.0, 50.0, 100.0)
CLOUD_LABELS = ("0-5%", "5-10%", "10-20%", "20-50%", "50-100%")

BAD_FLAGS = ("OUT_WARN", "RANGE_WARN")
SENTINELS = ("", "nan", "None", "NULL")
