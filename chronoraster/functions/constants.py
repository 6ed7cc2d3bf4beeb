"""Fixed values of the products: names, patterns, resolutions, labels, grid."""

from __future__ import annotations

from datetime import date

# Parts of a granule's file name, PRODUCT.AYYYYDDD[.hHHvVV].VVV.YYYYDDDHHMMSS.ext, each between two dots.
PRODUCT_PART = r"^((?:MOD|MYD|MXD|VNP)\d\d[A-Z]\d)\."
DATE_PART = r"\.A(\d{7})(?:\.|$)"
TILE_PART = r"\.(h\d\dv\d\d)(?:\.|$)"
VERSION_PART = r"\.(\d{3})(?:\.|$)"
PROC_PART = r"\.(\d{13})(?:\.|$)"

# Product families.
VI_PATTERN = r"^(?:VNP|M[OYX]D)13.+"
LST_PATTERN = r"^M[YO]D11.+"
SUPPORTED_PATTERN = r"^(?:VNP13|M[OYX]D13|M[YO]D11).+"
TILE_ARGUMENT = r"^h\d{2}v\d{2}$"

# Code -> subdataset name.
SUBDATASETS = {"VIM": "NDVI", "VEM": "EVI", "LTD": "LST_Day", "LTN": "LST_Night"}

# Product family -> (temporal resolution, shift, merged name or None, first date or None).
TEMPORAL = {
    "VNP13": (8, 8, "VNP", date(2012, 1, 17)),
    "MXD13": (8, 8, None, date(2002, 7, 4)),
    "MOD13": (16, 8, "MXD", None),
    "MYD13": (16, 8, "MXD", None),
    "MOD11": (8, 4, None, None),
    "MYD11": (8, 4, None, None),
}

# Fixed values: (code, satellite) -> name of the land surface temperature cube.
LST_NAMES = {("LTD", "MOD"): "TDT", ("LTD", "MYD"): "TDA", ("LTN", "MOD"): "TNT", ("LTN", "MYD"): "TNA"}

# Interpolation step -> letter in a smooth cube's name; other steps c, none n.
STEP_LETTERS = {5: "p", 10: "d"}

# Day of month -> label.
PENTAD_LABELS = {3: "p1", 8: "p2", 13: "p3", 18: "p4", 23: "p5", 28: "p6"}
DEKAD_LABELS = {5: "d1", 15: "d2", 25: "d3"}

# Physical range per code.
VALID_RANGE = {"VIM": (-2000.0, 10000.0), "VEM": (-2000.0, 10000.0), "LTD": (7500.0, 65535.0), "LTN": (7500.0, 65535.0)}
VNP_RANGE = (-10000.0, 10000.0)

# The sinusoidal grid.
SPHERE_RADIUS = 6371007.181
PIXEL_METRES = 926.6254330558334
TILE_PIXELS = 1200
ORIGIN_H, ORIGIN_V = 18, 9
METRES_PER_DEGREE = 112000.0
