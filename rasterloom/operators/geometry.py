"""Geometry: coordinates are computed, pixels are gathered by equi-joins.

Flips and quarter turns only rename coordinates. Warps compute a source place for each target pixel, name its four corners, and
join them to the source by frame and place (one shuffle of either side), then weigh and sum.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.functions.dialect import apply, num


def flip(df: DataFrame, width: int, height: int, horizontal: bool = False, vertical: bool = False) -> DataFrame:
    """G1."""
    new = {}
    if horizontal:
        new["x"] = F.lit(width - 1) - F.col("x")
    if vertical:
        new["y"] = F.lit(height - 1) - F.col("y")
    return df.withColumns(new) if new else df


def quarter_turns(df: DataFrame, width: int, height: int, steps: int) -> DataFrame:
    """Clockwise; negative steps turn back."""
    x, y = F.col("x"), F.col("y")
    to = {0: (x, y), 1: (F.lit(height - 1) - y, x), 2: (F.lit(width - 1) - x, F.lit(height - 1) - y), 3: (y, F.lit(width - 1) - x)}[steps % 4]
    return df.withColumns({"x": to[0], "y": to[1]})


def crop_box(width: int, height: int, x: float, y: float, w: float, h: float) -> tuple[int, int, int, int]:
    """F16: the pixels (left, top, width, height) of a crop given in parts of the frame; the whole frame if it says so."""
    if not (w > 0 and h > 0 and (x > 1e-4 or y > 1e-4 or w < 0.9999 or h < 0.9999)):
        return 0, 0, width, height
    near = lambda v: math.floor(v + 0.5)
    left, top = min(max(near(x * width), 0), width - 1), min(max(near(y * height), 0), height - 1)
    return left, top, min(max(near(w * width), 1), width - left), min(max(near(h * height), 1), height - top)


def crop(df: DataFrame, width: int, height: int, x: float, y: float, w: float, h: float) -> DataFrame:
    """F16: a range filter that reaches the scan, and shifted coordinates."""
    left, top, cw, ch = crop_box(width, height, x, y, w, h)
    return df.where((F.col("x") >= left) & (F.col("x") < left + cw) & (F.col("y") >= top) & (F.col("y") < top + ch)).withColumns({"x": F.col("x") - left, "y": F.col("y") - top})


def targets(spark: SparkSession, width: int, height: int, frames: DataFrame | None = None) -> DataFrame:
    """Every target pixel (frame_id, x, y)."""
    full = spark.range(width * height).select(F.expr(f"CAST(id % {width} AS BIGINT)").alias("x"), F.expr(f"id div {width}").alias("y"))
    return full.withColumn("frame_id", F.lit(0)) if frames is None else full.crossJoin(F.broadcast(frames.select("frame_id").distinct()))


def bilinear(source: DataFrame, places: DataFrame, width: int, height: int, edge: str = "clamp", cols: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """Values of source at places (frame_id, x, y, sx, sy) as (frame_id, x, y, cols).

    edge: clamp repeats the frame's edge; inside gives 0 where the places' column ``inside`` is false; zero gives 0 where a place is outside or has no right or lower neighbour.
    """
    p = places.withColumns({"_x": F.floor("sx"), "_y": F.floor("sy")}).withColumns({"_fx": F.col("sx") - F.col("_x"), "_fy": F.col("sy") - F.col("_y")})
    if edge == "zero":
        p = p.withColumn("_in", (F.col("sx") >= 0) & (F.col("sx") < width - 1) & (F.col("sy") >= 0) & (F.col("sy") < height - 1))
    else:
        p = p.withColumn("_in", F.col("inside") if edge == "inside" else F.lit(True))
    inside = lambda c, n: F.least(F.greatest(c, F.lit(0)), F.lit(n - 1))
    corner = lambda dx, dy: F.struct(inside(F.col("_x") + dx, width).cast("long").alias("x"), inside(F.col("_y") + dy, height).cast("long").alias("y"), ((F.col("_fx") if dx else 1 - F.col("_fx")) * (F.col("_fy") if dy else 1 - F.col("_fy"))).alias("k"))
    each = p.select("frame_id", "x", "y", "_in", F.explode(F.array(*[corner(dx, dy) for dy in (0, 1) for dx in (0, 1)])).alias("c"))
    each = each.select("frame_id", F.col("x").alias("_tx"), F.col("y").alias("_ty"), "_in", F.col("c.x").alias("x"), F.col("c.y").alias("y"), "c.k")
    found = each.join(source.select("frame_id", "x", "y", *cols), ["frame_id", "x", "y"])
    return found.groupBy("frame_id", F.col("_tx").alias("x"), F.col("_ty").alias("y")).agg(*[F.sum(F.when(F.col("_in"), F.col(c) * F.col("k")).otherwise(0.0)).alias(c) for c in cols])


def rotation(width: int, height: int, degrees: float) -> tuple[str, str]:
    """Source place of a pixel turned around the frame's middle."""
    a = math.radians(-degrees)
    cx, cy = width * 0.5, height * 0.5
    return f"{num(cx)} + ((x - {num(cx)}) * {num(math.cos(a))} - (y - {num(cy)}) * {num(math.sin(a))})", f"{num(cy)} + ((x - {num(cx)}) * {num(math.sin(a))} + (y - {num(cy)}) * {num(math.cos(a))})"


def warp(source: DataFrame, width: int, height: int, sx: str, sy: str, edge: str = "clamp", cols: tuple[str, ...] = ("r", "g", "b"), size: tuple[int, int] | None = None) -> DataFrame:
    """Gathers each target pixel from the place that sx, sy say (SQL over x, y)."""
    w, h = size or (width, height)
    places = targets(source.sparkSession, w, h, source).withColumns({"sx": F.expr(sx), "sy": F.expr(sy)})
    return bilinear(source, places, width, height, edge, cols)


def fine_rotation(df: DataFrame, width: int, height: int, degrees: float, cols: tuple[str, ...] = ("r8", "g8", "b8"), top: int = 255) -> DataFrame:
    """On quantised values, rounded."""
    if abs(degrees) < 1e-3:
        return df
    out = warp(df, width, height, *rotation(width, height, degrees), cols=cols)
    return out.withColumns({c: F.least(F.greatest(F.round(F.round(c, 9)), F.lit(0.0)), F.lit(float(top))).cast("int") for c in cols})


def downscaled_size(width: int, height: int, longest: int) -> tuple[int, int, float]:
    scale = longest / max(width, height)
    near = lambda v: max(1, math.floor(v + 0.5))
    return near(width * scale), near(height * scale), scale


def downscale(df: DataFrame, width: int, height: int, longest: int, cols: tuple[str, ...] = ("r8", "g8", "b8"), top: int = 255) -> DataFrame:
    """Bilinear to a longest edge, rounded by cutting off after adding a half. Smaller frames stay."""
    if longest <= 0 or max(width, height) <= longest:
        return df
    w, h, s = downscaled_size(width, height, longest)
    out = warp(df, width, height, f"greatest((x + 0.5e0) / {num(s)} - 0.5e0, 0e0)", f"greatest((y + 0.5e0) / {num(s)} - 0.5e0, 0e0)", cols=cols, size=(w, h))
    return out.withColumns({c: F.least(F.greatest(F.round(F.col(c), 9) + 0.5, F.lit(0.0)), F.lit(float(top))).cast("int") for c in cols})


@dataclass(frozen=True)
class Framing:
    """One projective look at a frame: crop in parts of it, quarter turns clockwise, fine turn in degrees, tilts, distortion from -1 to 1."""

    crop: tuple[float, float, float, float] = (0.0, 0.0, 1.0, 1.0)
    degrees: float = 0.0
    steps: int = 0
    flip_h: bool = False
    flip_v: bool = False
    tilt_v: float = 0.0
    tilt_h: float = 0.0
    distortion: float = 0.0


def framed_places(p: Framing, width: int, height: int) -> list[dict[str, str]]:
    """Layers over target places x, y of a width x height target: where (u, v in parts of the source) a pixel comes from.

    ``inside`` is false behind the tilted plane and outside the source.
    """
    side_x, side_y = ("-" if p.flip_h else ""), ("-" if p.flip_v else "")
    turn = {0: ("_a", "_b"), 1: ("-_b", "_a"), 2: ("-_a", "-_b"), 3: ("_b", "-_a")}[p.steps % 4]
    cos, sin = num(math.cos(math.radians(p.degrees))), num(math.sin(math.radians(p.degrees)))
    bent = f"1e0 + {num(0.5 * p.distortion)} * (_px * _px + _py * _py)" if abs(p.distortion) > 1e-4 else "1e0"
    x, y, w, h = p.crop
    if min(w, h) <= 1e-6:
        w = h = 1.0
    return [
        {"_a": f"{side_x}((x + 0.5e0) / {num(width)} - 0.5e0)", "_b": f"{side_y}((y + 0.5e0) / {num(height)} - 0.5e0)"},
        {"_tx": turn[0], "_ty": turn[1]},
        {"_rx": f"_tx * {cos} + _ty * {sin}", "_ry": f"_ty * {cos} - _tx * {sin}"},
        {"_w": f"1e0 + _ry * {num(0.4 * p.tilt_v)} + _rx * {num(0.4 * p.tilt_h)}"},
        {"_px": "CASE WHEN _w > 0 THEN _rx / _w ELSE 9e0 END", "_py": "CASE WHEN _w > 0 THEN _ry / _w ELSE 9e0 END"},
        {"_k": bent},
        {"u": f"{num(x)} + (_px * _k + 0.5e0) * {num(w)}", "v": f"{num(y)} + (_py * _k + 0.5e0) * {num(h)}"},
        {"inside": "_w > 0 AND u BETWEEN 0e0 AND 1e0 AND v BETWEEN 0e0 AND 1e0"},
    ]


def framed(df: DataFrame, width: int, height: int, p: Framing, size: tuple[int, int] | None = None, cols: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """Flips, turns, tilts, distortion and crop in one gather to ``size``; what lies outside the frame is black."""
    w, h = size or (width, height)
    places = apply(targets(df.sparkSession, w, h, df), framed_places(p, w, h))
    edge = lambda c, n: F.least(F.greatest(F.col(c) * float(n) - 0.5, F.lit(0.0)), F.lit(float(n - 1)))
    places = places.select("frame_id", "x", "y", "inside", F.when(F.col("inside"), edge("u", width)).otherwise(0.0).alias("sx"), F.when(F.col("inside"), edge("v", height)).otherwise(0.0).alias("sy"))
    return bilinear(df, places, width, height, "inside", cols)


def lens_places(width: int, height: int, k1: float, k2: float, tca: float, strength: float, tca_strength: float) -> tuple[str, str]:
    """Source place of one channel under distortion and lateral colour."""
    cx, cy = width * 0.5, height * 0.5
    dx, dy = f"(x - {num(cx)})", f"(y - {num(cy)})"
    r2 = f"(({dx} * {dx} + {dy} * {dy}) / {num(cx * cx + cy * cy)})"
    f = f"(1e0 + {num(k1 * strength * 0.01)} * {r2} + {num(k2 * strength * 0.01)} * {r2} * {r2}) * (1e0 + {num(tca * tca_strength * 0.01)} * {r2})"
    inside = lambda s, n: f"least(greatest({s}, 0e0), {num(n - 1)})"
    return inside(f"{num(cx)} + {dx} * {f}", width), inside(f"{num(cy)} + {dy} * {f}", height)


def quads(source: DataFrame, width: int, height: int, cols: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """(frame_id, _x, _y, _r0 .. _b3): for each place its pixel and its right, lower and lower right neighbours, the frame's edge repeated."""
    # a pixel is corner (0, 0) of its own place and corner (1, 0) of the place on its left; in the last column both of its own
    side = lambda c, n: f"filter(array(struct({c} AS at, 0 AS d), struct({c} - 1 AS at, 1 AS d), struct({c} AS at, CASE WHEN {c} = {n - 1} THEN 1 END AS d)), v -> v.at >= 0 AND v.d IS NOT NULL)"
    each = source.select("frame_id", "x", "y", *cols).withColumn("_i", F.explode(F.expr(side("x", width)))).withColumn("_j", F.explode(F.expr(side("y", height))))
    corner = each.selectExpr("frame_id", "_i.at AS _x", "_j.at AS _y", "CAST(_j.d * 2 + _i.d AS TINYINT) AS _c", *cols)
    return corner.groupBy("frame_id", "_x", "_y").agg(*[F.max(F.when(F.col("_c") == i, F.col(c))).alias(f"_{c}{i}") for c in cols for i in range(4)])


def lens_correction(df: DataFrame, width: int, height: int, lens: dict[str, float], strength: float = 100.0, tca_strength: float = 100.0) -> DataFrame:
    """Each channel gathered by its own place. All channels' places meet the four pixels around them in one join."""
    at = []
    for c, tca in zip("rgb", (lens["tca_red"], 0.0, lens["tca_blue"])):
        sx, sy = lens_places(width, height, lens["k1"], lens["k2"], tca, strength, tca_strength)
        at.append(f"named_struct('c', '{c}', 'sx', {sx}, 'sy', {sy})")
    places = targets(df.sparkSession, width, height, df).select("frame_id", F.col("x").alias("_tx"), F.col("y").alias("_ty"), F.explode(F.expr(f"array({', '.join(at)})")).alias("p"))
    places = places.selectExpr("frame_id", "_tx", "_ty", "p.c AS _channel", "floor(p.sx) AS _x", "floor(p.sy) AS _y", "p.sx - floor(p.sx) AS _fx", "p.sy - floor(p.sy) AS _fy")
    found = places.join(quads(df, width, height), ["frame_id", "_x", "_y"])
    mixed = lambda c: " + ".join(f"coalesce(_{c}{2 * j + i} * ({'_fx' if i else '(1 - _fx)'} * {'_fy' if j else '(1 - _fy)'}), 0e0)" for j in (0, 1) for i in (0, 1))
    value = found.selectExpr("frame_id", "_tx AS x", "_ty AS y", "_channel", "CASE " + " ".join(f"WHEN _channel = '{c}' AND coalesce({', '.join(f'_{c}{i}' for i in range(4))}) IS NOT NULL THEN {mixed(c)}" for c in "rgb") + " END AS v")
    # pixels all of whose channels have found a place
    out = value.groupBy("frame_id", "x", "y").agg(*[F.max(F.when(F.col("_channel") == c, F.col("v"))).alias(c) for c in "rgb"], F.count(F.lit(1)).alias("_n"))
    return out.where("_n = 3").drop("_n")


Affine = tuple[float, float, float, float, float, float]


def affine(t: Affine, x: str = "x", y: str = "y") -> tuple[str, str]:
    """(m00, m01, tx, m10, m11, ty) applied to a place."""
    return f"{num(t[0])} * {x} + {num(t[1])} * {y} + {num(t[2])}", f"{num(t[3])} * {x} + {num(t[4])} * {y} + {num(t[5])}"


def inverse(t: Affine) -> Affine:
    """The identity if there is no inverse."""
    a, b, tx, c, d, ty = t
    det = a * d - b * c
    if abs(det) < 1e-9:
        return 1.0, 0.0, 0.0, 0.0, 1.0, 0.0
    a, b, c, d = d / det, -b / det, -c / det, a / det
    return a, b, -(a * tx + b * ty), c, d, -(c * tx + d * ty)


def warp_affine(df: DataFrame, width: int, height: int, t: Affine) -> DataFrame:
    """Outside is 0."""
    return warp(df, width, height, *affine(t), edge="zero")


def clone(df: DataFrame, width: int, height: int, target: tuple[float, float], source: tuple[float, float], radius: float, feather: float = 0.3, opacity: float = 1.0) -> DataFrame:
    """A soft disc takes pixels from elsewhere. Only the disc's rows are joined (a bounded patch), the rest stays."""
    from rasterloom.functions.dialect import smoothstep

    place = lambda v, n: v * n if v <= 1.0 else v
    (tx, ty), (sx, sy) = ((place(p[0], width), place(p[1], height)) for p in (target, source))
    inner = max(0.0, radius * (1 - feather))
    d = f"sqrt((x - {num(tx)}) * (x - {num(tx)}) + (y - {num(ty)}) * (y - {num(ty)}))"
    alpha = f"CASE WHEN {d} > {num(radius)} THEN 0e0 WHEN {d} <= {num(inner)} THEN {num(opacity)} ELSE (1e0 - {smoothstep(num(inner), num(radius), d)}) * {num(opacity)} END"
    near = lambda v, off, n: F.expr(f"CAST(least(greatest(round({v} + {num(off)}), 0e0), {num(n - 1)}) AS BIGINT)")
    marked = df.withColumn("_a", F.expr(alpha))
    patch = marked.where("_a > 0").withColumns({"_sx": near("x", sx - tx, width), "_sy": near("y", sy - ty, height)})
    src = df.select(F.col("frame_id").alias("_f"), F.col("x").alias("_sx"), F.col("y").alias("_sy"), *[F.col(c).alias(f"_{c}") for c in "rgb"])
    mixed = patch.join(src, (patch["frame_id"] == src["_f"]) & (patch["_sx"] == src["_sx"]) & (patch["_sy"] == src["_sy"])).withColumns({c: F.col(c) * (1 - F.col("_a")) + F.col(f"_{c}") * F.col("_a") for c in "rgb"})
    return marked.where("_a <= 0").select(*df.columns).unionByName(mixed.select(*df.columns))


def heal(df: DataFrame, width: int, height: int, target: tuple[float, float], source: tuple[float, float], radius: float, feather: float = 0.3, opacity: float = 1.0, iterations: int = 40) -> DataFrame:
    """A disc takes the texture of another place and its own surroundings' colours: relaxation of the difference inside
    a region of fixed size, in one task for each frame. The rest of the frame isn't moved.
    """
    import pandas as pd

    place = lambda v, n: v * n if v <= 1.0 else v
    (tx, ty), (sx, sy) = ((place(p[0], width), place(p[1], height)) for p in (target, source))
    ox, oy = math.floor(sx - tx + 0.5), math.floor(sy - ty + 0.5)
    pad = math.ceil(radius) + 4
    x0, x1 = max(0, math.floor(tx) - pad), min(width - 1, math.ceil(tx) + pad)
    y0, y1 = max(0, math.floor(ty) - pad), min(height - 1, math.ceil(ty) + pad)
    if x1 - x0 + 1 <= 2 or y1 - y0 + 1 <= 2:
        return df
    inside = F.col("x").between(x0, x1) & F.col("y").between(y0, y1)
    cut = lambda v, n: min(max(v, 0), n - 1)
    used = F.col("x").between(cut(x0 + ox, width), cut(x1 + ox, width)) & F.col("y").between(cut(y0 + oy, height), cut(y1 + oy, height))
    cols = ["frame_id", "y", "x", "r", "g", "b"]

    def relax(part: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        frame = {(int(y), int(x)): v for y, x, *v in part[["y", "x", "r", "g", "b"]].itertuples(index=False, name=None)}
        ys, xs = np.mgrid[y0 : y1 + 1, x0 : x1 + 1]
        own = np.array([[frame[y, x] for x in range(x0, x1 + 1)] for y in range(y0, y1 + 1)])
        src = np.array([[frame[cut(y + oy, height), cut(x + ox, width)] for x in range(x0, x1 + 1)] for y in range(y0, y1 + 1)])
        d = np.hypot(xs - tx, ys - ty)
        inner = max(0.0, radius * (1 - feather))
        t = np.clip((d - inner) / (radius - inner + 1e-7), 0, 1)
        m = np.where(d > radius, 0.0, np.where(d <= inner, 1.0, 1 - t * t * (3 - 2 * t))) * opacity
        fixed = m < 0.01
        fixed[[0, -1], :] = fixed[:, [0, -1]] = True
        f = np.where(fixed[..., None], own - src, 0.0)
        free = np.zeros_like(fixed)
        free[1:-1, 1:-1] = m[1:-1, 1:-1] > 0.01
        for _ in range(iterations):
            mean = np.zeros_like(f)
            mean[1:-1, 1:-1] = 0.25 * (f[1:-1, :-2] + f[1:-1, 2:] + f[:-2, 1:-1] + f[2:, 1:-1])
            f = np.where(free[..., None], mean, f)
        healed = np.maximum(0.0, src + f)
        out = own * (1 - m[..., None]) + healed * m[..., None]
        return pd.DataFrame({"frame_id": part["frame_id"].iloc[0], "y": ys.ravel(), "x": xs.ravel(), "r": out[..., 0].ravel(), "g": out[..., 1].ravel(), "b": out[..., 2].ravel()})

    schema = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in cols)
    new = df.where(inside | used).select(*cols).groupBy("frame_id").applyInPandas(relax, schema)
    return df.where(~inside).select(*cols).unionByName(new)
