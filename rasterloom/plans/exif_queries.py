"""Exif directories built from a table and read back in both byte orders, bare or inside a JPEG (S8, K2), and what is shown of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.operators import catalog
from rasterloom.plans.registry import register
from rasterloom.sources import exif
from rasterloom.sources.views import spread, table

#: Fields by part number, in SQL of both engines; every ninth part has no lens, every fourth no place.
_ROW = {
    "make": "CASE p_partkey % 3 WHEN 0 THEN 'Sony' WHEN 1 THEN 'NIKON' ELSE '' END", "model": "CASE p_partkey % 3 WHEN 0 THEN 'SONY ILCE-7' WHEN 1 THEN 'Z 8' ELSE 'X' END", "orientation": "CAST(p_partkey % 9 AS INT)",
    "software": "p_brand", "taken": "concat('2024:01:', 10 + p_partkey % 19)", "width": "CAST(p_partkey * 7 AS INT)", "height": "CAST(p_size AS INT)",
    "exposure_time": "1e0 / (p_size + 1)", "f_number": "p_size / 10e0", "iso_speed": "CAST(p_size * 50 AS INT)", "focal_length": "p_size + p_partkey % 10 / 10e0", "lens": "CASE WHEN p_partkey % 9 <> 0 THEN p_name END",
    "latitude": "CASE WHEN p_partkey % 4 <> 0 THEN p_partkey % 80 - 40e0 + 0.5e0 END", "longitude": "CASE WHEN p_partkey % 4 <> 0 THEN 90e0 - p_partkey % 180 + 0.25e0 END",
}
_DIGITS = ("exposure_time", "f_number", "focal_length", "latitude", "longitude")


def files(spark: SparkSession, d: str) -> DataFrame:
    rows = spread(table(spark, d, "part").select("p_partkey", "p_brand", "p_size", "p_name"), "p_partkey").selectExpr("p_partkey", *[f"{v} AS {k}" for k, v in _ROW.items()])
    return exif.write_exif(rows, F.col("p_partkey") % 2 == 0, F.col("p_partkey") % 5 < 2).select("p_partkey", "data")


@register("k02_exif", "SELECT p_partkey, " + ", ".join(f"round({v}, 6) AS {k}" if k in _DIGITS else f"{v} AS {k}" for k, v in _ROW.items()) + " FROM part")
def k02_exif(spark: SparkSession, d: str) -> DataFrame:
    """Directories written and read back: every field."""
    return exif.read_exif(files(spark, d)).select("p_partkey", *[F.round(k, 6).alias(k) if k in _DIGITS else k for k in _ROW])


@register("s08_exif_files", """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'SONY ILCE-7' WHEN 1 THEN 'NIKON Z 8' ELSE 'X' END AS camera, '1/' || (p_size + 1) || 's' AS shutter_text, 'ISO ' || p_size * 50 AS iso_text, p_size || 'mm' AS focal_text,
  CAST(CASE p_partkey % 9 WHEN 3 THEN 2 WHEN 4 THEN 2 WHEN 6 THEN 1 WHEN 7 THEN 1 WHEN 5 THEN 3 WHEN 8 THEN 3 ELSE 0 END AS INTEGER) AS quarter_turns, p_partkey % 9 IN (2, 4, 5, 7) AS mirrored FROM part""")
def s08_exif_files(spark: SparkSession, d: str) -> DataFrame:
    """What a catalog shows of files: the camera's name, exposure texts, and how previews are turned."""
    read = exif.read_exif(files(spark, d)).withColumn("exposure_time", F.expr("1e0 / round(1e0 / exposure_time)")).withColumn("focal_length", F.floor(F.col("focal_length") + 1e-9))
    shown = catalog.shown_exif(read).withColumn("u", exif.upright(F.col("orientation")))
    return shown.select("p_partkey", exif.camera_name(F.col("make"), F.col("model")).alias("camera"), "shutter_text", "iso_text", "focal_text", "u.quarter_turns", "u.mirrored")
