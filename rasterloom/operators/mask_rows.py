"""Mask layers that come from a table: every frame has its own, of eight types, evaluated by type at each pixel.

Layers are rows (frame_id, ord, and the fields of settings_json.LAYER, whose names are used here). A frame's layers are prepared once
(angles, squares, edges) and joined to its pixels as one small list, so pixels aren't multiplied by layers. Frames without layers have weight 0, and so have pixels where nothing stands.

Brush strokes are rows of their own (frame_id, ord, seq, x, y, p, r, f, er). A stroke becomes a row for each pixel that
its circle covers, and these are folded by pixel and layer in their order: the work grows with the covered area, also where all
strokes lie in one corner. Pixels without strokes join nothing.

Columns: pixels have frame_id, x, y, r, g, b; ``depth`` for depth masks and ``grad`` (stencil.sobel) for edge masks, else those
layers have weight 0. ``width`` and ``height`` of frames are given as SQL. Null depths have weight 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.functions.colour import angle_between, luma, to_hsl
from rasterloom.functions.dialect import apply, clamp, smoothstep
from rasterloom.operators.masks import normalised

#: Softness that stored layers don't have (fixed values).
POLYGON_FEATHER, COLOUR_FEATHER, DEPTH_FEATHER, EDGE_FEATHER = 0.02, 0.2, 0.15, 0.05
LEAST = "1e-4"


def strokes_of(layers: DataFrame) -> DataFrame:
    """The strokes of layers that hold them as lists: a row for each."""
    return layers.select("frame_id", "ord", F.posexplode("brushStrokes").alias("seq", "_s")).select("frame_id", "ord", "seq", "_s.*")


def prepared(layers: DataFrame) -> DataFrame:
    """One row for each frame: its enabled layers in order, with what doesn't depend on the pixel worked out."""
    vertices = "transform(polygonVertices, v -> named_struct('x', CAST(v.x AS DOUBLE), 'y', CAST(v.y AS DOUBLE)))"
    edge = "named_struct('ax', v.x, 'ay', v.y, 'sx', w.x - v.x, 'sy', w.y - v.y)"
    # each vertex with the one before it
    edges = f"zip_with({vertices}, concat(slice({vertices}, -1, least(1, size(polygonVertices))), slice({vertices}, 1, greatest(size(polygonVertices) - 1, 0))), (v, w) -> {edge})"
    d = lambda c: f"CAST({c} AS DOUBLE)"
    feather = clamp(d("radialFeather"), 0.01, 1)
    fields = {
        "ord": "ord", "type": "type", "op": "booleanOp", "inverted": "inverted", "opacity": d("opacity"),
        "x0": d("linearStartX"), "y0": d("linearStartY"), "vx": f"{d('linearEndX')} - {d('linearStartX')}", "vy": f"{d('linearEndY')} - {d('linearStartY')}", "lf": d("linearFeather"),
        "cx": d("radialCenterX"), "cy": d("radialCenterY"), "c": f"cos(-{d('radialAngle')})", "s": f"sin(-{d('radialAngle')})",
        "rx": f"greatest(1e-5, {d('radialRadiusX')})", "ry": f"greatest(1e-5, {d('radialRadiusY')})", "inner": f"greatest(0e0, 1e0 - {feather})",
        "edges": edges, "low": f"CASE type WHEN 'DEPTH_MAP' THEN {d('depthMin')} ELSE {d('lumaMin')} END", "high": f"CASE type WHEN 'DEPTH_MAP' THEN {d('depthMax')} ELSE {d('lumaMax')} END",
        "soft": f"greatest({LEAST}, CASE type WHEN 'DEPTH_MAP' THEN {DEPTH_FEATHER}e0 ELSE {d('lumaFeather')} END)",
        "hue": d("colorTargetHue"), "sat": d("colorTargetSat"), "light": d("colorTargetLum"), "th": d("colorTolHue"), "ts": d("colorTolSat"), "tl": d("colorTolLum"), "edge": d("edgeThreshold"),
    }
    one = ", ".join(f"'{k}', {v}" for k, v in fields.items())
    return layers.where("enabled").groupBy("frame_id").agg(F.array_sort(F.collect_list(F.expr(f"named_struct({one})"))).alias("_layers"))


def brushed(strokes: DataFrame, layers: DataFrame, sizes: DataFrame) -> DataFrame:
    """(frame_id, x, y, _brushed): at each pixel that a stroke covers, the weight of each brush layer by its ord.

    sizes: (frame_id, width, height). A stroke becomes a row for each pixel within its circle, line by line, so the work is the area
    that strokes cover, wherever they lie. A pixel's rows of one layer are folded in their order (equal places: smaller amounts first).
    """
    own = layers.where("enabled AND type = 'BRUSH'").selectExpr("frame_id", "ord", "CAST(brushRadius AS DOUBLE) AS _base", "least(greatest(CAST(brushFeather AS DOUBLE), 0.01e0), 1e0) AS _soft")
    s = strokes.join(own, ["frame_id", "ord"]).join(sizes, "frame_id")
    p, part = clamp("CAST(p AS DOUBLE)", 0.01, 1), "x BETWEEN 0 AND 1 AND y BETWEEN 0 AND 1"
    s = s.selectExpr("frame_id", "CAST(ord AS BIGINT) AS ord", "seq", f"CASE WHEN {part} THEN CAST(x AS DOUBLE) * width ELSE CAST(x AS DOUBLE) END AS px", f"CASE WHEN {part} THEN CAST(y AS DOUBLE) * height ELSE CAST(y AS DOUBLE) END AS py", f"CASE WHEN r > 0 THEN CAST(r AS DOUBLE) ELSE _base END * {p} AS radius", f"{clamp(f'CAST(f AS DOUBLE) * {p}', 0, 1)} AS flow", "er", "_soft", "width", "height")
    # places inside the frame between two ends, none if they have passed each other
    span = lambda low, high, size: f"filter(sequence(CAST(greatest(0e0, floor({low})) AS BIGINT), CAST(greatest(greatest(0e0, floor({low})), least({size} - 1, ceil({high}))) AS BIGINT)), v -> v < {size})"
    touched = s.where("ceil(px + radius) >= 0 AND ceil(py + radius) >= 0 AND floor(px - radius) <= width - 1 AND floor(py - radius) <= height - 1")
    lines = touched.withColumn("y", F.explode(F.expr(span("py - radius", "py + radius", "height")))).withColumn("_half", F.expr("sqrt(greatest(0e0, radius * radius - (y - py) * (y - py)))"))
    at = lines.withColumn("x", F.explode(F.expr(span("px - _half", "px + _half", "width")))).withColumn("_d", F.expr("sqrt((x - px) * (x - px) + (y - py) * (y - py))")).where("_d <= radius")
    inner = "greatest(0e0, radius * (1e0 - _soft))"
    stamp = f"CASE WHEN _d <= {inner} THEN flow ELSE (1e0 - {smoothstep(inner, 'radius', '_d')}) * flow END"
    hits = at.selectExpr("frame_id", "x", "y", "ord", "seq", f"CASE WHEN er THEN -1e0 ELSE 1e0 END * ({stamp}) AS v")
    lists = hits.groupBy("frame_id", "x", "y", "ord").agg(F.sort_array(F.collect_list(F.struct("seq", "v"))).alias("h"))
    folded = lists.selectExpr("frame_id", "x", "y", "ord", "aggregate(h, 0e0, (w, s) -> greatest(0e0, least(1e0, w + s.v))) AS w")
    return folded.groupBy("frame_id", "x", "y").agg(F.map_from_entries(F.collect_list(F.struct("ord", "w"))).alias("_brushed"))


def _band(x: str) -> str:
    return f"{smoothstep('a.low - a.soft', 'a.low', x)} * (1e0 - {smoothstep('a.high', 'a.high + a.soft', x)})"


def weights() -> dict[str, str]:
    """SQL of the weight of layer a (of ``prepared``) at a pixel, for each type; not yet turned round or weakened."""
    along = clamp("((nx - a.x0) * a.vx + (ny - a.y0) * a.vy) / (a.vx * a.vx + a.vy * a.vy)", 0, 1)
    half = "greatest(0.01e0, a.lf * 0.5e0)"
    linear = f"CASE WHEN a.vx * a.vx + a.vy * a.vy < 1e-7 THEN 0e0 WHEN a.lf > 0 THEN {smoothstep(f'greatest(0e0, 0.5e0 - {half})', f'least(1e0, 0.5e0 + {half})', along)} ELSE {along} END"
    u, v = "((nx - a.cx) * a.c - (ny - a.cy) * a.s)", "((nx - a.cx) * a.s + (ny - a.cy) * a.c)"
    far = f"sqrt({u} * {u} / (a.rx * a.rx) + {v} * {v} / (a.ry * a.ry))"
    radial = f"CASE WHEN {far} >= 1e0 THEN 0e0 WHEN {far} <= a.inner THEN 1e0 ELSE 1e0 - {smoothstep('a.inner', '1e0', far)} END"
    crossed = "aggregate(a.edges, 0, (n, e) -> n + CASE WHEN (e.ay > ny) <> (e.ay + e.sy > ny) AND nx < e.sx * (ny - e.ay) / e.sy + e.ax THEN 1 ELSE 0 END) % 2 = 1"
    t = f"CASE WHEN e.sx * e.sx + e.sy * e.sy > 1e-7 THEN {clamp('((nx - e.ax) * e.sx + (ny - e.ay) * e.sy) / (e.sx * e.sx + e.sy * e.sy)', 0, 1)} ELSE 0e0 END"
    near = f"aggregate(a.edges, double('infinity'), (m, e) -> least(m, pow(nx - e.ax - ({t}) * e.sx, 2e0) + pow(ny - e.ay - ({t}) * e.sy, 2e0)))"
    edge = clamp(f"sqrt({near}) / {POLYGON_FEATHER}e0", 0, 1)
    polygon = f"CASE WHEN size(a.edges) < 3 THEN 0e0 WHEN {crossed} THEN 0.5e0 + 0.5e0 * {edge} ELSE greatest(0e0, 0.5e0 - 0.5e0 * {edge}) END"
    off = lambda d, tol, k: f"(1e0 - {smoothstep(tol, f'{tol} + {COLOUR_FEATHER * k}e0', d)})"
    colour = f"{off(angle_between('h', 'a.hue'), 'a.th', 45)} * {off('abs(s - a.sat)', 'a.ts', 0.3)} * {off('abs(l - a.light)', 'a.tl', 0.3)}"
    return {
        "LINEAR_GRADIENT": linear, "RADIAL_GRADIENT": radial, "POLYGON_BEZIER": polygon, "BRUSH": "coalesce(element_at(_brushed, CAST(a.ord AS BIGINT)), 0e0)",
        "LUMINANCE_RANGE": _band("_y"), "COLOR_RANGE": colour, "DEPTH_MAP": _band("depth"), "SOBEL_EDGE": smoothstep(f"a.edge - {EDGE_FEATHER}e0", f"a.edge + {EDGE_FEATHER}e0", "grad"),
    }


def layer_weight() -> str:
    """SQL of layer a's weight at a pixel: by type, turned round where wanted, weakened by its opacity."""
    by_type = " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights().items())
    # where depth or gradient are missing the layer stands nowhere, turned round or not
    gone = "(a.type = 'DEPTH_MAP' AND depth IS NULL) OR (a.type = 'SOBEL_EDGE' AND grad IS NULL)"
    w = f"element_at(transform(array(CASE a.type {by_type} ELSE 1e0 END), w -> {clamp('CASE WHEN a.inverted THEN 1e0 - w ELSE w END', 0, 1)}), 1)"
    return f"CASE WHEN {gone} THEN 0e0 ELSE {clamp(f'{w} * a.opacity', 0, 1)} END"


def composite(out: str = "w") -> str:
    """SQL of all layers folded in order; the first one replaces whatever it says."""
    step = "element_at(transform(array(m.w), v -> least(greatest(CASE WHEN m.i = 0 OR m.op = 'REPLACE' THEN v WHEN m.op = 'UNION' THEN acc + v WHEN m.op = 'SUBTRACT' THEN acc - v ELSE acc * v END, 0e0), 1e0)), 1)"
    each = f"transform(_layers, (a, i) -> named_struct('i', i, 'op', a.op, 'w', {layer_weight()}))"
    return f"coalesce(aggregate({each}, 0e0, (acc, m) -> {step}), 0e0)"


def masked(pixels: DataFrame, layers: DataFrame, strokes: DataFrame, width: str, height: str, out: str = "w", each: str | None = None) -> DataFrame:
    """pixels with the composite weight of their frame's layers; each: also a list of every layer's own weight (ord, w)."""
    own = pixels.columns
    for c in ("depth", "grad"):
        if c not in own:
            pixels = pixels.withColumn(c, F.lit(None).cast("double"))
    sizes = layers.select("frame_id").distinct().withColumns({"width": F.expr(width), "height": F.expr(height)})
    at = apply(pixels, [normalised(width, height), *to_hsl(), {"_y": luma()}])
    # layers are few beside the pixels; the optimiser sends them out only below its own size limit
    at = at.join(prepared(layers), "frame_id", "left").join(brushed(strokes, layers, sizes), ["frame_id", "x", "y"], "left")
    shown = [F.expr(composite()).alias(out)]
    if each:
        shown.append(F.expr(f"transform(_layers, a -> named_struct('ord', a.ord, 'w', {layer_weight()}))").alias(each))
    return at.select(*[F.col(c) for c in own if c not in (out, each)], *shown)
