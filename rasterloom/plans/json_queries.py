"""Stored development settings and mask layers: reading with defaults and faults, writing, and reading back.

The texts are made from orders in both engines; the SQL reads them with the other engine's own JSON functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.operators import settings_json
from rasterloom.plans.registry import register
from rasterloom.sources.views import spread, table

#: Both engines join numbers and texts alike. Every twelfth text has one fault or other.
SETTINGS_TEXT = """CASE WHEN k % 12 = 0 THEN 'no settings' WHEN k % 12 = 8 THEN '{}' ELSE concat('{"exposureEV":', k % 7 - 3, '.25,"kelvin":', CASE WHEN k % 12 = 3 THEN 'null' ELSE concat('', 5000 + k % 900) END,
  ',"contrast":', CASE k % 12 WHEN 1 THEN '"abc"' WHEN 2 THEN '"12.5"' ELSE concat('', k % 50) END, ',"colorProfile":"p/', k % 3, '","isMonochrome":', CASE WHEN k % 2 = 0 THEN 'true' ELSE '"FALSE"' END,
  ',"hslBands":[{"h":', k % 5, '},', CASE WHEN k % 12 = 4 THEN '7' ELSE '{"s":2.5,"l":"x"}' END, '],"monochromeWeights":[0.5,', CASE WHEN k % 12 = 6 THEN '1' ELSE 'null,0.25,0.125,"0.75",0,1,2' END,
  '],"toneCurveLUT":[0,0.5,', k % 4, '],"primaryRed":{"h":', k % 6, '},"splitToning":{"bal":', k % 8, '},"lensCorrection":{"enable":true,"dist":', k % 100, '},"geometry":',
  CASE WHEN k % 12 = 5 THEN '5' ELSE concat('{"x":0.5,"ratio":"', CASE WHEN k % 12 = 7 THEN 'WIDE' ELSE 'GOLDEN' END, '","steps":', k % 4, ',"flipH":true}') END,
  ',"outputColorSpace":"', CASE WHEN k % 12 = 7 THEN 'Other' ELSE 'AdobeRGB' END, '","enableDithering":false}') END"""
LAYERS_TEXT = """CASE WHEN k % 12 = 0 THEN '' WHEN k % 12 = 8 THEN '[1' ELSE concat('[{"id":"m', k, '","type":"', CASE k % 4 WHEN 0 THEN 'BRUSH' WHEN 1 THEN 'DEPTH_MAP' WHEN 2 THEN 'CLOUD' ELSE 'POLYGON_BEZIER' END, '","opacity":0.', k % 10,
  ',"enabled":', CASE WHEN k % 5 = 0 THEN 'false' ELSE 'true' END, ',"polygonVertices":[{"x":0.25,"y":', k % 3, '},{"x":"1"},{}],"brushStrokes":[{"x":1,"r":', k % 40, '},{"p":0.5,"er":true}],"adjustments":{"exposureEV":', k % 4, '}},',
  CASE k % 12 WHEN 1 THEN '3' WHEN 2 THEN '{"polygonVertices":{}}' WHEN 3 THEN '{"brushStrokes":[1]}' WHEN 4 THEN '{"adjustments":null}' ELSE concat('{"name":"n', k % 6, '","booleanOp":"', CASE WHEN k % 2 = 0 THEN 'SUBTRACT' ELSE 'XOR' END, '","lumaMax":', k % 9, '}') END, ',{"id":null,"radialAngle":"2.5"}]') END"""


def texts(spark: SparkSession, d: str, text: str) -> DataFrame:
    return spread(table(spark, d, "orders").select(F.col("o_orderkey").alias("k")), "k").selectExpr("k", f"{text} AS t")


# j: the parsed text; stop: which of the fields that can be at fault ends the reading
_READ = f"""
WITH x AS (SELECT k, TRY_CAST(t AS JSON) AS j FROM (SELECT k, {SETTINGS_TEXT} AS t FROM (SELECT o_orderkey AS k FROM orders))),
s AS (SELECT *, CASE WHEN json_exists(j, '$.kelvin') AND TRY_CAST(j->>'$.kelvin' AS DOUBLE) IS NULL THEN 1 WHEN json_exists(j, '$.contrast') AND TRY_CAST(j->>'$.contrast' AS DOUBLE) IS NULL THEN 2
  WHEN list_bool_or(list_transform(json_extract(j, '$.hslBands[*]'), lambda e: json_type(e) <> 'OBJECT')) THEN 3 WHEN json_exists(j, '$.geometry') AND json_type(j, '$.geometry') <> 'OBJECT' THEN 4 ELSE 5 END AS stop FROM x)"""
_F = lambda v, default, rank: f"CAST(CASE WHEN stop > {rank} THEN coalesce(TRY_CAST(j->>'{v}' AS DOUBLE), {default}) ELSE {default} END AS DOUBLE)"
_WEIGHTS = "CASE WHEN stop > 3 AND json_array_length(j, '$.monochromeWeights') = 8 THEN list_transform(json_extract(j, '$.monochromeWeights[*]'), lambda e: coalesce(TRY_CAST(e->>'$' AS DOUBLE), 0e0)) ELSE [0.18, 0.24, 0.22, 0.16, 0.08, 0.06, 0.03, 0.03] END"
_COLUMNS = f"""k, {_F('$.exposureEV', '0', 0)} AS exposure, {_F('$.kelvin', '5500', 1)} AS kelvin, {_F('$.tint', '0', 1)} AS tint, {_F('$.contrast', '0', 2)} AS contrast,
  CASE WHEN stop > 2 THEN coalesce(j->>'$.colorProfile', 'cinetone') ELSE 'cinetone' END AS profile, CASE WHEN stop > 2 THEN lower(coalesce(j->>'$.isMonochrome', 'false')) = 'true' ELSE false END AS mono,
  CAST(CASE WHEN stop > 2 THEN coalesce(TRY_CAST(j->>'$.hslBands[0].h' AS DOUBLE), 0) ELSE 0 END AS DOUBLE) AS hue_1, {_F('$.hslBands[1].s', '0', 3)} AS saturation_2, {_F('$.hslBands[1].l', '0', 3)} AS light_2, 8 AS n_bands,
  round(list_sum({_WEIGHTS}), 4) AS weights, CAST(CASE WHEN stop > 3 THEN coalesce(json_array_length(j, '$.toneCurveLUT'), 0) ELSE 0 END AS INTEGER) AS n_curve, {_F('$.primaryRed.h', '0', 3)} AS red_hue, {_F('$.splitToning.bal', '0', 3)} AS balance,
  {_F('$.lensCorrection.dist', '100', 3)} AS lens_distortion, {_F('$.lensCorrection.vig', '100', 3)} AS lens_vignetting, {_F('$.geometry.x', '0', 4)} AS crop_x, {_F('$.geometry.w', '1', 4)} AS crop_w,
  CASE WHEN stop > 4 AND j->>'$.geometry.ratio' = 'GOLDEN' THEN 'GOLDEN' ELSE 'ORIGINAL' END AS ratio, CAST(CASE WHEN stop > 4 THEN coalesce(CAST(j->>'$.geometry.steps' AS INTEGER), 0) ELSE 0 END AS INTEGER) AS turns, CASE WHEN stop > 4 THEN coalesce(j->>'$.geometry.flipH' = 'true', false) ELSE false END AS flipped,
  CASE WHEN stop > 4 AND j->>'$.outputColorSpace' = 'AdobeRGB' THEN 'AdobeRGB' ELSE 'sRGB' END AS space, CASE WHEN stop > 4 THEN coalesce(j->>'$.enableDithering' <> 'false', true) ELSE true END AS dither"""
_SHOWN = ["k", "CAST(s.exposureEV AS DOUBLE) AS exposure", "CAST(s.kelvin AS DOUBLE) AS kelvin", "CAST(s.tint AS DOUBLE) AS tint", "CAST(s.contrast AS DOUBLE) AS contrast", "s.colorProfile AS profile", "s.isMonochrome AS mono", "CAST(s.hslBands[0].h AS DOUBLE) AS hue_1", "CAST(s.hslBands[1].s AS DOUBLE) AS saturation_2", "CAST(s.hslBands[1].l AS DOUBLE) AS light_2", "size(s.hslBands) AS n_bands", "round(aggregate(s.monochromeWeights, 0e0, (a, v) -> a + v), 4) AS weights", "size(s.toneCurveLUT) AS n_curve", "CAST(s.primaryRed.h AS DOUBLE) AS red_hue", "CAST(s.splitToning.bal AS DOUBLE) AS balance", "CAST(s.lensCorrection.dist AS DOUBLE) AS lens_distortion", "CAST(s.lensCorrection.vig AS DOUBLE) AS lens_vignetting", "CAST(s.geometry.x AS DOUBLE) AS crop_x", "CAST(s.geometry.w AS DOUBLE) AS crop_w", "s.geometry.ratio AS ratio", "s.geometry.steps AS turns", "s.geometry.flipH AS flipped", "s.outputColorSpace AS space", "s.enableDithering AS dither"]


@register("s14_settings", f"{_READ} SELECT {_COLUMNS} FROM s")
def s14_settings(spark: SparkSession, d: str) -> DataFrame:
    """Settings from their texts: defaults, coerced values, and where a fault ends the reading."""
    return settings_json.read_settings(texts(spark, d, SETTINGS_TEXT), "t", "s").selectExpr(*_SHOWN)


@register("k09_settings", f"""{_READ}, c AS (SELECT {_COLUMNS}, CASE WHEN stop > 3 AND json_exists(j, '$.toneCurveLUT') THEN concat('[0,0.5,', j->>'$.toneCurveLUT[2]', ']') ELSE '[]' END AS curve FROM s)
SELECT k, CASE WHEN exposure = 0 THEN '0' ELSE CAST(exposure AS VARCHAR) END AS exposure, CAST(CAST(kelvin AS BIGINT) AS VARCHAR) AS kelvin, concat('"', replace(profile, '/', '\\/'), '"') AS profile, concat('"h":', CAST(hue_1 AS BIGINT), ',"s":0,"l":0') AS first_band, curve,
  concat('{{"x":', CASE WHEN crop_x = 0 THEN '0' ELSE '0.5' END, ',"y":0,"w":1,"h":1,"ratio":"', ratio, '","rot":0,"steps":', turns, ',"flipH":', flipped, ',"flipV":false,"perspV":0,"perspH":0,"dist":0,"guide":"NONE"}}') AS geometry, true AS same FROM c""")
def k09_settings(spark: SparkSession, d: str) -> DataFrame:
    """Settings written as texts: some of their parts, and whether reading gives the same settings again."""
    first = settings_json.read_settings(texts(spark, d, SETTINGS_TEXT), "t", "s").select("k", "s", F.expr(settings_json.write_settings("s")).alias("j"))
    again = settings_json.read_settings(first, "j", "s2")
    part = lambda name, rest: F.regexp_extract("j", f'"{name}":({rest})', 1).alias(name)
    shown = again.select("k", part("exposureEV", "[^,]*").alias("exposure"), part("kelvin", "[^,]*"), part("colorProfile", '"[^,]*"').alias("profile"), part("hslBands", "\\[\\{[^}]*").substr(3, 99).alias("first_band"), part("toneCurveLUT", "\\[[^\\]]*\\]").alias("curve"), part("geometry", "\\{[^}]*\\}"), (F.col("s") == F.col("s2")).alias("same"))
    return shown


_LAYERS = f"""
WITH x AS (SELECT k, TRY_CAST(CASE WHEN t = '' THEN '[]' ELSE t END AS JSON) AS j FROM (SELECT k, {LAYERS_TEXT} AS t FROM (SELECT o_orderkey AS k FROM orders))),
e AS (SELECT k, unnest(json_extract(j, '$[*]')) AS m, generate_subscripts(json_extract(j, '$[*]'), 1) - 1 AS pos FROM x WHERE j IS NOT NULL),
f AS (SELECT *, json_type(m) = 'OBJECT' AND (NOT json_exists(m, '$.polygonVertices') OR json_type(m, '$.polygonVertices') = 'ARRAY') AND (NOT json_exists(m, '$.brushStrokes') OR coalesce(list_bool_and(list_transform(json_extract(m, '$.brushStrokes[*]'), lambda b: json_type(b) = 'OBJECT')), json_type(m, '$.brushStrokes') = 'ARRAY'))
  AND (NOT json_exists(m, '$.adjustments') OR json_type(m, '$.adjustments') = 'OBJECT') AS ok FROM e),
g AS (SELECT *, bool_and(ok) OVER (PARTITION BY k ORDER BY pos) AS read FROM f)
SELECT k, CAST(pos AS INTEGER) AS pos, CASE WHEN json_exists(m, '$.id') THEN coalesce(m->>'$.id', 'null') ELSE concat('mask-', pos) END AS id, coalesce(m->>'$.name', 'Mask Layer') AS name, coalesce(m->>'$.enabled' = 'true', true) AS enabled,
  CASE WHEN m->>'$.type' IN ('BRUSH', 'DEPTH_MAP', 'POLYGON_BEZIER') THEN m->>'$.type' ELSE 'RADIAL_GRADIENT' END AS type, CASE WHEN m->>'$.booleanOp' = 'SUBTRACT' THEN 'SUBTRACT' ELSE 'UNION' END AS op, round(coalesce(CAST(m->>'$.opacity' AS DOUBLE), 1), 4) AS opacity,
  CAST(coalesce(json_array_length(m, '$.polygonVertices'), 0) AS INTEGER) AS n_vertices, coalesce(CAST(m->>'$.polygonVertices[1].x' AS DOUBLE), 0) AS second_x, CAST(coalesce(json_array_length(m, '$.brushStrokes'), 0) AS INTEGER) AS n_strokes, CAST(coalesce(m->>'$.brushStrokes[0].r', '-1') AS DOUBLE) AS first_radius,
  CASE WHEN json_exists(m, '$.brushStrokes') THEN 25e0 ELSE -1e0 END AS second_radius, round(coalesce(CAST(m->>'$.lumaMax' AS DOUBLE), 1), 4) AS luma_max, coalesce(CAST(m->>'$.radialAngle' AS DOUBLE), 0) AS angle, coalesce(CAST(m->>'$.adjustments.exposureEV' AS DOUBLE), 0) AS exposure
FROM g WHERE read"""


def _layer_rows(df: DataFrame) -> DataFrame:
    # outer: else the optimiser infers a filter on the list's size and works the whole list out once more for it, step by step below
    m = df.selectExpr("k", "posexplode_outer(l) AS (pos, m)").where("pos IS NOT NULL")
    return m.selectExpr("k", "pos", "m.id", "m.name", "m.enabled", "m.type", "m.booleanOp AS op", "round(CAST(m.opacity AS DOUBLE), 4) AS opacity", "size(m.polygonVertices) AS n_vertices", "CAST(coalesce(try_element_at(m.polygonVertices, 2).x, 0) AS DOUBLE) AS second_x", "size(m.brushStrokes) AS n_strokes", "CAST(coalesce(try_element_at(m.brushStrokes, 1).r, -1) AS DOUBLE) AS first_radius", "CAST(coalesce(try_element_at(m.brushStrokes, 2).r, -1) AS DOUBLE) AS second_radius", "round(CAST(m.lumaMax AS DOUBLE), 4) AS luma_max", "CAST(m.radialAngle AS DOUBLE) AS angle", "CAST(m.adjustments.exposureEV AS DOUBLE) AS exposure")


@register("s14_layers", _LAYERS)
def s14_layers(spark: SparkSession, d: str) -> DataFrame:
    """Mask layers from their texts, up to the first that can't be read."""
    return _layer_rows(settings_json.read_layers(texts(spark, d, LAYERS_TEXT), "t", "l"))


@register("k09_layers", _LAYERS)
def k09_layers(spark: SparkSession, d: str) -> DataFrame:
    """Mask layers written as texts and read back."""
    first = settings_json.written_layers(settings_json.read_layers(texts(spark, d, LAYERS_TEXT), "t", "l"), "l", "j").select("k", "j")
    return _layer_rows(settings_json.read_layers(first, "j", "l"))
