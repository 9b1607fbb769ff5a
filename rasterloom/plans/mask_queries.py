"""Mask layers of several frames from tables: nations give the layers, parts the brush strokes.

The SQL works every layer out at every pixel by its own formulas, strokes by comparing each with each pixel, and folds them in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.operators import mask_rows, settings_json, stencil
from rasterloom.plans.registry import register
from rasterloom.sources.views import HEIGHT, PIXELS, WIDTH, height, pixels, table

#: Fields of a layer by the nation's number n, in SQL of both engines (``div`` is spelled out); all others have their defaults.
ORD = "CAST(floor(n / 2e0) AS INT)"
LAYER = {
    "enabled": "n % 11 <> 6", "inverted": "n % 5 = 0", "opacity": "0.4e0 + (n % 4) * 0.2e0", "type_at": f"{ORD} % 8", "op_at": f"({ORD} + n) % 4",
    "linearStartX": "(n % 3) * 0.1e0", "linearStartY": "0.2e0", "linearEndX": "0.9e0 - (n % 2) * 0.3e0", "linearEndY": "0.8e0", "linearFeather": "(n % 3) * 0.2e0",
    "radialCenterX": "0.5e0", "radialCenterY": "0.4e0", "radialRadiusX": "0.3e0 + n * 0.01e0", "radialRadiusY": "0.5e0", "radialAngle": "n * 0.1e0", "radialFeather": "0.5e0",
    "lumaMin": "0.2e0", "lumaMax": "0.6e0", "lumaFeather": "0.1e0", "colorTargetHue": "n * 14e0", "colorTargetSat": "0.4e0", "colorTargetLum": "0.5e0", "colorTolHue": "60e0", "colorTolSat": "0.3e0", "colorTolLum": "0.3e0",
    "depthMin": "0.3e0", "depthMax": "0.7e0", "edgeThreshold": "0.8e0", "brushRadius": "6e0", "brushFeather": "0.5e0",
}
STROKE = {"frame_id": "k % 2", "ord": "3 + 8 * (CAST(floor(k / 2e0) AS INT) % 2)", "seq": "k", "x": "CASE WHEN k % 10 = 0 THEN (k % 7) / 8e0 ELSE (k * 37 % 50) * 1e0 END", "y": "CASE WHEN k % 10 = 0 THEN (k % 3) / 4e0 ELSE (k * 53 % 113) * 1e0 END", "p": "(k % 5) / 4e0", "r": "(k % 9 - 1) * 1e0", "f": "0.5e0", "er": "k % 3 = 0"}
FRAME, DEPTH = "CASE WHEN x < 25 THEN 0 ELSE 1 END", "CASE WHEN x % 9 = 0 THEN NULL ELSE ((x * 7 + y * 3) % 10) / 10e0 END"


def layers(spark: SparkSession, d: str) -> DataFrame:
    made = {f.name: settings_json.default_of(f) for f in settings_json.LAYER} | {k: f"CAST({v} AS FLOAT)" if v.endswith("e0") or "e0 " in v else v for k, v in LAYER.items() if not k.endswith("_at")}
    made |= {"type": f"element_at(array({', '.join(map(repr, settings_json.MASK_TYPES))}), {LAYER['type_at']} + 1)", "booleanOp": f"element_at(array({', '.join(map(repr, settings_json.OPERATIONS))}), CAST({LAYER['op_at']} AS INT) + 1)"}
    made["type"] = made["type"].replace(f"{LAYER['type_at']} + 1", f"CAST({LAYER['type_at']} AS INT) + 1")
    made["polygonVertices"] = "array(named_struct('x', 0.1e0, 'y', 0.1e0), named_struct('x', 0.9e0, 'y', 0.2e0 + n * 0.01e0), named_struct('x', 0.5e0, 'y', 0.9e0))"
    return table(spark, d, "nation").selectExpr("n_nationkey AS n").selectExpr("CAST(n % 2 AS INT) AS frame_id", f"{ORD} AS ord", *[f"{v} AS {k}" for k, v in made.items()])


def strokes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").selectExpr("p_partkey AS k").selectExpr(*[f"CAST({v} AS INT) AS {k}" if k in ("frame_id", "ord") else f"{v} AS {k}" for k, v in STROKE.items()])


def framed(spark: SparkSession, d: str) -> DataFrame:
    return stencil.sobel(pixels(spark, d)).withColumn("frame_id", F.expr(FRAME)).withColumn("depth", F.expr(DEPTH))


_F32 = lambda k: f"CAST(CAST({LAYER[k]} AS FLOAT) AS DOUBLE) AS {k}"
_S = lambda lo, hi, x: f"(SELECT t * t * (3 - 2 * t) FROM (SELECT least(greatest((({x}) - ({lo})) / (({hi}) - ({lo}) + 1e-7), 0e0), 1e0) AS t))"
_NUMBERS = ", ".join(_F32(k) for k in LAYER if k not in ("enabled", "inverted", "type_at", "op_at"))
_VERTICES = "[[0.1e0, 0.1e0], [0.9e0, 0.2e0 + n * 0.01e0], [0.5e0, 0.9e0]]"


def _sql(sobel: str) -> str:
    edges = " UNION ALL ".join(f"SELECT {_VERTICES}[{i}][1] AS ax, {_VERTICES}[{i}][2] AS ay, {_VERTICES}[{j}][1] AS qx, {_VERTICES}[{j}][2] AS qy" for i, j in ((1, 3), (2, 1), (3, 2)))
    gap = "(SELECT min(pow(nx - ax - t * (qx - ax), 2) + pow(ny - ay - t * (qy - ay), 2)) FROM (SELECT *, least(greatest(((nx - ax) * (qx - ax) + (ny - ay) * (qy - ay)) / (pow(qx - ax, 2) + pow(qy - ay, 2)), 0e0), 1e0) AS t FROM edges e WHERE e.n = l.n))"
    inside = "(SELECT count(*) % 2 = 1 FROM edges e WHERE e.n = l.n AND (ay > ny) <> (qy > ny) AND nx < (qx - ax) * (ny - ay) / (qy - ay) + ax)"
    close = lambda a, tol, k: f"(1 - {_S(tol, f'{tol} + {0.2 * k}e0', a)})"
    raw = f"""CASE type_at
      WHEN 0 THEN CASE WHEN linearFeather > 0 THEN {_S('greatest(0, 0.5e0 - greatest(0.01e0, linearFeather / 2))', 'least(1, 0.5e0 + greatest(0.01e0, linearFeather / 2))', 'along')} ELSE along END
      WHEN 1 THEN CASE WHEN far >= 1 THEN 0 WHEN far <= 0.5e0 THEN 1 ELSE 1 - {_S('0.5e0', '1e0', 'far')} END
      WHEN 2 THEN CASE WHEN {inside} THEN 0.5e0 + 0.5e0 * least(sqrt({gap}) / 0.02e0, 1e0) ELSE 0.5e0 - 0.5e0 * least(sqrt({gap}) / 0.02e0, 1e0) END
      WHEN 3 THEN coalesce((SELECT b.w FROM brushed b WHERE b.x = p.x AND b.y = p.y AND b.ord = l.ord), 0)
      WHEN 4 THEN {_S('lumaMin - lumaFeather', 'lumaMin', 'lum')} * (1 - {_S('lumaMax', 'lumaMax + lumaFeather', 'lum')})
      WHEN 5 THEN {close('least(abs(hue - colorTargetHue), 360 - abs(hue - colorTargetHue))', 'colorTolHue', 45)} * {close('abs(sat - colorTargetSat)', 'colorTolSat', 0.3)} * {close('abs(light - colorTargetLum)', 'colorTolLum', 0.3)}
      WHEN 6 THEN {_S('depthMin - 0.15e0', 'depthMin', 'depth')} * (1 - {_S('depthMax', 'depthMax + 0.15e0', 'depth')})
      ELSE {_S('edgeThreshold - 0.05e0', 'edgeThreshold + 0.05e0', 'grad')} END"""
    return f"""
WITH f AS (SELECT x, y, r, g, b, grad, {FRAME} AS frame_id, {DEPTH} AS depth, x / 49e0 AS nx, y / ({HEIGHT} - 1e0) AS ny, 0.2126e0 * r + 0.7152e0 * g + 0.0722e0 * b AS lum, greatest(r, g, b) AS hi, least(r, g, b) AS lo FROM {sobel}),
px AS (SELECT *, (hi + lo) / 2 AS light, CASE WHEN hi - lo < 1e-6 THEN 0 WHEN (hi + lo) / 2 < 0.5e0 THEN least((hi - lo) / greatest(hi + lo, 1e-5), 1) WHEN 2 - hi - lo <= 1e-5 THEN 0 ELSE least((hi - lo) / (2 - hi - lo), 1) END AS sat,
  CASE WHEN hi - lo < 1e-6 THEN 0 WHEN hi = r THEN ((g - b) / (hi - lo) * 60 + 360) % 360 WHEN hi = g THEN (b - r) / (hi - lo) * 60 + 120 ELSE (r - g) / (hi - lo) * 60 + 240 END AS hue FROM f),
lay AS (SELECT n, CAST(n % 2 AS INTEGER) AS frame_id, {ORD} AS ord, {LAYER['inverted']} AS inverted, CAST({LAYER['type_at']} AS INTEGER) AS type_at, CAST({LAYER['op_at']} AS INTEGER) AS op_at, {_NUMBERS} FROM (SELECT n_nationkey AS n FROM nation) WHERE {LAYER['enabled']}),
edges AS (SELECT n, e.* FROM lay, LATERAL ({edges}) e),
st AS (SELECT frame_id, ord, seq, er, CASE WHEN x BETWEEN 0 AND 1 AND y BETWEEN 0 AND 1 THEN x * {WIDTH} ELSE x END AS sx, CASE WHEN x BETWEEN 0 AND 1 AND y BETWEEN 0 AND 1 THEN y * {HEIGHT} ELSE y END AS sy, CASE WHEN r > 0 THEN r ELSE 6 END * greatest(p, 0.01e0) AS radius, f * greatest(p, 0.01e0) AS flow
  FROM (SELECT {', '.join(f'{v} AS {k}' for k, v in STROKE.items())} FROM (SELECT p_partkey AS k FROM part))),
hit AS (SELECT px.x, px.y, st.ord, seq, (CASE WHEN er THEN -1 ELSE 1 END) * flow * (CASE WHEN d <= radius / 2 THEN 1 ELSE 1 - {_S('radius / 2', 'radius', 'd')} END) AS v FROM px JOIN st USING (frame_id), LATERAL (SELECT sqrt(pow(px.x - sx, 2) + pow(px.y - sy, 2)) AS d) WHERE d <= radius),
brushed AS (SELECT x, y, ord, list_reduce(list_prepend(0e0, list(v ORDER BY seq)), lambda a, b: least(1e0, greatest(0e0, a + b))) AS w FROM hit GROUP BY x, y, ord),
each_ AS (SELECT p.x, p.y, l.ord, l.op_at, CASE WHEN type_at = 6 AND depth IS NULL THEN 0 ELSE least(greatest((CASE WHEN inverted THEN 1 - ({raw}) ELSE {raw} END) * opacity, 0e0), 1e0) END AS w
  FROM px p JOIN lay l USING (frame_id), LATERAL (SELECT least(greatest(((nx - linearStartX) * (linearEndX - linearStartX) + (ny - linearStartY) * (linearEndY - linearStartY)) / (pow(linearEndX - linearStartX, 2) + pow(linearEndY - linearStartY, 2)), 0e0), 1e0) AS along,
    sqrt(pow(((nx - radialCenterX) * cos(radialAngle) + (ny - radialCenterY) * sin(radialAngle)) / radialRadiusX, 2) + pow(((ny - radialCenterY) * cos(radialAngle) - (nx - radialCenterX) * sin(radialAngle)) / radialRadiusY, 2)) AS far))"""


def _register(sobel: str) -> None:
    @register("f09_layer_rows", f"{_sql(sobel)} SELECT x, y, ord, round(w, 6) AS w FROM each_")
    def f09_layer_rows(spark: SparkSession, d: str) -> DataFrame:
        """Every layer's own weight at every pixel."""
        m = mask_rows.masked(framed(spark, d), layers(spark, d), strokes(spark, d), str(WIDTH), str(height(spark, d)), each="each_")
        return m.select("x", "y", F.explode("each_").alias("m")).selectExpr("x", "y", "m.ord", "round(m.w, 6) AS w")

    fold = "list_reduce(list_prepend({'op': 0, 'w': 0e0}, list({'op': CASE WHEN k = 1 THEN 0 ELSE op_at END, 'w': w} ORDER BY ord)), lambda a, b: {'op': 0, 'w': least(greatest(CASE b.op WHEN 0 THEN b.w WHEN 1 THEN a.w + b.w WHEN 2 THEN a.w - b.w ELSE a.w * b.w END, 0e0), 1e0)}).w"

    @register("f10_layer_rows", f"{_sql(sobel)} SELECT x, y, round({fold}, 6) AS w FROM (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY ord) AS k FROM each_) GROUP BY x, y")
    def f10_layer_rows(spark: SparkSession, d: str) -> DataFrame:
        """All layers of each frame folded in their order."""
        return mask_rows.masked(framed(spark, d), layers(spark, d), strokes(spark, d), str(WIDTH), str(height(spark, d))).selectExpr("x", "y", "round(w, 6) AS w")
