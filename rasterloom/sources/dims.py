"""Small fixed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Lens profiles (make, model, mount, focal range, distortion k1 k2, vignetting v1 v2, lateral colour red and blue).
LENSES = (
    ("Sony", "FE 24-70mm F2.8 GM II", "Sony E", 24.0, 70.0, -0.024, 0.006, -0.38, 0.12, 0.00032, -0.00040),
    ("Sony", "FE 16-35mm F2.8 GM II", "Sony E", 16.0, 35.0, -0.042, 0.012, -0.52, 0.20, 0.00055, -0.00065),
    ("Sigma", "24-70mm F2.8 DG DN | Art", "Sony E", 24.0, 70.0, -0.028, 0.007, -0.42, 0.14, 0.00038, -0.00048),
    ("Canon", "RF24-70mm F2.8 L IS USM", "Canon RF", 24.0, 70.0, -0.022, 0.005, -0.34, 0.10, 0.00028, -0.00035),
    ("Hasselblad", "XCD 45mm F4 P", "Hasselblad X", 45.0, 45.0, -0.008, 0.001, -0.18, 0.04, 0.00010, -0.00012),
)

# Papers (id, maker, name, densest black, white in Lab).
PAPERS = (
    ("canon_pt101", "Canon", "Photo Paper Pro Platinum (PT-101)", 2.45, 97.2, 0.5, -1.8),
    ("epson_traditional", "Epson", "Traditional Photo Paper (Baryta)", 2.38, 96.8, 0.3, 1.2),
    ("hahnemuhle_photorag", "Hahnemühle", "Photo Rag 308 (Matte Cotton)", 1.72, 95.5, 0.4, 3.2),
    ("ilford_gold_fibre", "Ilford", "Galerie Gold Fibre Gloss", 2.35, 96.5, 0.2, 0.8),
)

# The 24 chart patches (name, Lab).
PATCHES = (
    ("Dark skin", 37.99, 13.56, 14.06), ("Light skin", 65.71, 18.13, 17.81), ("Blue sky", 49.93, -4.88, -21.93), ("Foliage", 43.14, -13.10, 21.91),
    ("Blue flower", 55.11, 8.84, -25.40), ("Bluish green", 70.72, -33.40, -0.20), ("Orange", 62.66, 36.07, 57.10), ("Purplish blue", 40.02, 10.41, -45.96),
    ("Moderate red", 51.12, 48.24, 16.25), ("Purple", 30.33, 22.98, -21.59), ("Yellow green", 72.53, -23.71, 60.47), ("Orange yellow", 71.94, 19.36, 67.86),
    ("Blue", 28.78, 14.18, -50.30), ("Green", 55.26, -38.34, 31.37), ("Red", 42.10, 53.38, 28.19), ("Yellow", 81.73, 4.04, 79.82),
    ("Magenta", 51.94, 49.99, -14.57), ("Cyan", 51.04, -28.63, -28.64), ("White 9.5", 96.54, -0.43, 1.19), ("Neutral 8", 81.26, -0.64, -0.34),
    ("Neutral 6.5", 66.77, -0.73, -0.50), ("Neutral 5", 50.87, -0.15, -0.27), ("Neutral 3.5", 35.66, -0.42, -1.23), ("Black 2", 20.46, -0.08, -0.97),
)

# Export recipes (id, name, format, colour space, quality, longest side or 0, edge sharpening and its amount, watermark); null where a recipe says nothing.
RECIPES = (
    ("recipe_print_16bit", "Print Master 16-bit TIFF (AdobeRGB)", "TIFF16", "AdobeRGB", None, 0, False, None, False),
    ("recipe_web_webp", "Web Master Ultra-Quality WebP (sRGB)", "WebP", "sRGB", 95, 0, False, None, False),
    ("recipe_sns_jpeg", "SNS 2048px Optimized JPEG (sRGB + High-Pass Sharpness)", "JPEG", "sRGB", 92, 2048, True, 45.0, True),
)

# Settings of tethered cameras by brand (brand, camera, lens, seconds as a fraction of one, aperture, ISO, battery per cent).
BRANDS = (
    ("Sony", "ILCE-7RM5", "FE 24-70mm F2.8 GM II", 250, 2.8, 100, 94),
    ("Canon", "EOS R5 Mark II", "RF 24-70mm F2.8 L IS USM", 320, 2.8, 100, 88),
    ("Nikon", "Z 8", "NIKKOR Z 24-70mm f/2.8 S", 200, 4.0, 64, 91),
    ("Fujifilm", "GFX100 II", "GF 55mm F1.7 R WR", 160, 1.7, 80, 85),
    ("Panasonic", "LUMIX S1R", "Lumix S PRO 24-70mm F2.8", 250, 2.8, 100, 79),
)

# Names of enumerations in the order of their codes.
ENUMS = {
    "mask_type": ("linear", "radial", "polygon", "brush", "luminance", "colour", "depth", "edge"),
    "boolean_op": ("replace", "union", "subtract", "intersect"),
    "colour_label": ("none", "red", "yellow", "green", "blue", "purple"),
    "proof_intent": ("perceptual", "relative", "saturation", "absolute"),
    "blend_mode": ("additive", "average", "screen", "lighten", "darken"),
    "tether_state": ("disconnected", "connecting", "connected", "transferring", "processing", "ready"),
}


def lenses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *row) for i, row in enumerate(LENSES)], "ord int, lens_make string, lens_model string, mount string, focal_min double, focal_max double, k1 double, k2 double, v1 double, v2 double, tca_red double, tca_blue double")


def papers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *row) for i, row in enumerate(PAPERS)], "ord int, paper string, maker string, name string, dmax double, white_l double, white_a double, white_b double")


def patches(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *row) for i, row in enumerate(PATCHES)], "patch int, name string, lab_l double, lab_a double, lab_b double")


def enums(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, i, v) for k, names in ENUMS.items() for i, v in enumerate(names)], "enum string, code int, name string")


def export_recipes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *row) for i, row in enumerate(RECIPES)], "ord int, recipe string, name string, format string, space string, quality int, longest int, sharpen boolean, sharpening double, watermark boolean")


def brands(spark: SparkSession) -> DataFrame:
    rows = [(i, brand, camera, lens, 1.0 / part, aperture, iso, battery) for i, (brand, camera, lens, part, aperture, iso, battery) in enumerate(BRANDS)]
    return spark.createDataFrame(rows, "ord int, brand string, camera string, lens string, exposure_time double, aperture double, iso int, battery int")
