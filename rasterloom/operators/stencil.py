"""Neighbourhood operators on pixels (frame_id, y, x, ...), with edges clamped to the frame.

Neighbours come from window frames in two passes (along rows, then along columns), partitioned by frame and row or by frame
and column; nothing is joined, so a pixel crosses the network twice for each stencil, whatever its size. A radius of 1 needs
``coalesce`` for the clamped edge; a box of radius r adds the repeated edge value for each missing neighbour.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec

from rasterloom.functions.colour import luma

ROW = ("frame_id", "y")
COLUMN = ("frame_id", "x")


def _rows(df: DataFrame) -> WindowSpec:
    return W.partitionBy(*ROW).orderBy("x")


def _columns(df: DataFrame) -> WindowSpec:
    return W.partitionBy(*COLUMN).orderBy("y")


def beside(c: str, w: WindowSpec, n: int) -> Column:
    """The neighbour n places on, or the pixel's own value beyond the frame (radius 1)."""
    return F.coalesce(F.lag(c, -n).over(w) if n < 0 else F.lead(c, n).over(w), F.col(c))


def grid(df: DataFrame, c: str, out: str = "n") -> DataFrame:
    """The 3 x 3 neighbours of c as columns n00 .. n22 (first digit: row above, own, below; second: left, own, right)."""
    w = _rows(df)
    df = df.withColumns({"_c0": beside(c, w, -1), "_c1": F.col(c), "_c2": beside(c, w, 1)})
    v = _columns(df)
    new = {}
    for k in range(3):
        new |= {f"{out}0{k}": beside(f"_c{k}", v, -1), f"{out}1{k}": F.col(f"_c{k}"), f"{out}2{k}": beside(f"_c{k}", v, 1)}
    return df.withColumns(new).drop("_c0", "_c1", "_c2")


def sobel(df: DataFrame, out: str = "grad") -> DataFrame:
    """Gradient length of luma."""
    g = grid(df.withColumn("_y", F.expr(luma())), "_y")
    gx = F.expr("(n02 + 2e0 * n12 + n22) - (n00 + 2e0 * n10 + n20)")
    gy = F.expr("(n20 + 2e0 * n21 + n22) - (n00 + 2e0 * n01 + n02)")
    return g.withColumn(out, F.sqrt(gx * gx + gy * gy)).drop("_y", *[f"n{i}{j}" for i in range(3) for j in range(3)])


# Highlight colours of focus peaking.
PEAKS = {"red": (1.0, 0.0, 0.2), "yellow": (1.0, 1.0, 0.0), "blue": (0.0, 0.85, 1.0), "white": (1.0, 1.0, 1.0)}


def focus_peaking(df: DataFrame, colour: str = "red", threshold: float = 0.15) -> DataFrame:
    """Edges take the colour, all else turns half grey."""
    df = sobel(df).withColumn("_y", F.expr(luma()))
    new = {c: F.when(F.col("grad") > threshold, F.col(c) * 0.15 + v * 0.85).otherwise(F.col(c) * 0.5 + F.col("_y") * 0.5) for c, v in zip("rgb", PEAKS[colour])}
    return df.withColumns(new).drop("_y", "grad")


def box_sum(df: DataFrame, c: str, r: int, out: str) -> DataFrame:
    """The sum over (2r + 1)^2 pixels, edge values repeated."""
    for axis, order in ((ROW, "x"), (COLUMN, "y")):
        w = W.partitionBy(*axis).orderBy(order)
        whole = W.partitionBy(*axis)
        inside = F.sum(c).over(w.rowsBetween(-r, r))
        before = F.greatest(F.lit(r) - (F.col(order) - F.min(order).over(whole)), F.lit(0))
        after = F.greatest(F.lit(r) - (F.max(order).over(whole) - F.col(order)), F.lit(0))
        first = F.first(c).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
        last = F.last(c).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
        df = df.withColumn(out, inside + before * first + after * last)
        c = out
    return df


def sharpness(df: DataFrame, radius: int = 1, out: str = "sharp") -> DataFrame:
    """Modified Laplacian of luma, summed over a window."""
    df = df.withColumn("_y", F.expr(luma()))
    w, v = _rows(df), _columns(df)
    df = df.withColumn("_ml", F.abs(2 * F.col("_y") - beside("_y", w, -1) - beside("_y", w, 1)))
    df = df.withColumn("_ml", F.col("_ml") + F.abs(2 * F.col("_y") - beside("_y", v, -1) - beside("_y", v, 1)))
    return box_sum(df, "_ml", max(1, radius), out).drop("_y", "_ml")


def box_mean(df: DataFrame, c: str, r: int) -> DataFrame:
    """W4."""
    n = (2 * r + 1) ** 2
    return box_sum(df, c, r, "_box").withColumn(c, F.col("_box") / n).drop("_box")


def _table_exp(x: Column) -> Column:
    """exp(-x) in steps of 1/32; 1 up to 0, 0 from 16 on."""
    return F.when(x <= 0, 1.0).when(x >= 16, 0.0).otherwise(F.exp(-F.floor(x * 32) / 32.0))


def luminance_nr(df: DataFrame, strength: float, detail: float = 0.0, contrast: float = 0.0) -> DataFrame:
    """A 3 x 3 bilateral filter of luma; colours follow by ratio."""
    if strength <= 0:
        return df
    s, dt, ct = strength * 0.01, detail * 0.01, contrast * 0.01
    sigma = 0.02 + s * 0.20 * (1 - dt * 0.6)
    inv = 1 / (2 * sigma * sigma)
    df = grid(df.withColumn("_y", F.expr(luma())), "_y")
    y, total, weight = F.col("_y"), F.lit(0.0), F.lit(0.0)
    for i in range(3):
        for j in range(3):
            n = F.col(f"n{i}{j}")
            w = _table_exp(F.lit(((i - 1) ** 2 + (j - 1) ** 2) * 0.5) + (n - y) * (n - y) * inv)
            total, weight = total + n * w, weight + w
    df = df.withColumn("_t", total).withColumn("_w", weight)
    blend = y * (1 - s) + F.when(F.col("_w") > 0, F.col("_t") / F.col("_w")).otherwise(y) * s
    df = df.withColumn("_b", blend)
    if ct > 0:
        keep = F.pow(1 - F.least(F.greatest(y, F.lit(0.0)), F.lit(1.0)), 2.0) * ct * 0.5
        df = df.withColumn("_b", F.col("_b") * (1 - keep) + y * keep)
    df = df.withColumn("_k", F.when(y > 1e-5, F.col("_b") / y).otherwise(1.0))
    return df.withColumns({c: F.greatest(F.lit(0.0), F.col(c) * F.col("_k")) for c in "rgb"}).drop("_y", "_t", "_w", "_b", "_k", *[f"n{i}{j}" for i in range(3) for j in range(3)])


def chroma_nr(df: DataFrame, strength: float, smoothness: float = 0.0) -> DataFrame:
    """A Gaussian of the two colour differences (two passes over strength 50), green rebuilt from luma."""
    if strength <= 0:
        return df
    s, radius = strength * 0.01, 1 + smoothness * 0.01 * 2
    inv = 1 / (2 * radius * radius)
    kernel = [[math.exp(-math.floor(((i - 1) ** 2 + (j - 1) ** 2) * inv * 32) / 32) for j in range(3)] for i in range(3)]
    norm = sum(map(sum, kernel))
    df = df.withColumn("_y", F.expr(luma())).withColumns({"_cr": F.col("r") - F.expr(luma()), "_cb": F.col("b") - F.expr(luma())})
    for _ in range(2 if s > 0.5 else 1):
        for c in ("_cr", "_cb"):
            df = grid(df, c)
            blur = sum((F.col(f"n{i}{j}") * kernel[i][j] for i in range(3) for j in range(3)), F.lit(0.0)) / norm
            df = df.withColumn(c, F.col(c) * (1 - s) + blur * s).drop(*[f"n{i}{j}" for i in range(3) for j in range(3)])
    left = "_y - 0.2126e0 * (_y + _cr) - 0.0722e0 * (_y + _cb)"
    excess = "(0.2126e0 * greatest(0e0, _cr) + 0.0722e0 * greatest(0e0, _cb))"
    df = df.withColumn("_n", F.expr(left))
    df = df.withColumn("_k", F.expr(f"CASE WHEN _n >= 0e0 OR {excess} <= 1e-5 THEN 1e0 ELSE least(greatest(_y * 0.7152e0 / {excess}, 0e0), 1e0) END"))
    df = df.withColumns({"_cr": F.col("_cr") * F.col("_k"), "_cb": F.col("_cb") * F.col("_k")})
    df = df.withColumn("_n", F.expr(f"CASE WHEN _n < 0e0 THEN greatest(0e0, {left}) ELSE _n END"))
    return df.withColumns({"r": F.expr("greatest(0e0, _y + _cr)"), "g": F.expr("greatest(0e0, _n / 0.7152e0)"), "b": F.expr("greatest(0e0, _y + _cb)")}).drop("_y", "_cr", "_cb", "_n", "_k")


def sharpen(df: DataFrame, amount: float, masking: float = 0.0, preview: bool = False) -> DataFrame:
    """Unsharp luma by a 4-neighbour Laplacian, held back where gradients are small; preview shows that weight."""
    if amount <= 0 and not preview:
        return df
    a, limit = amount * 0.01, masking * 0.01 * 0.12
    df = df.withColumn("_y", F.expr(luma()))
    w, v = _rows(df), _columns(df)
    df = df.withColumns({"_l": beside("_y", w, -1), "_r": beside("_y", w, 1)}).withColumns({"_t": beside("_y", v, -1), "_b": beside("_y", v, 1)})
    edge = F.lit(1.0)
    if limit > 1e-5:
        edge = F.least(F.greatest((F.abs(F.col("_r") - F.col("_l")) + F.abs(F.col("_b") - F.col("_t")) - limit) / max(limit * 0.5, 0.005), F.lit(0.0)), F.lit(1.0))
    df = df.withColumn("_e", edge)
    if preview:
        return df.withColumns({c: F.col("_e") for c in "rgb"}).drop("_y", "_l", "_r", "_t", "_b", "_e")
    boost = -((F.col("_l") + F.col("_r") + F.col("_t") + F.col("_b")) * 0.25 - F.col("_y")) * a * 1.5 * F.col("_e")
    df = df.withColumn("_k", F.when(F.col("_y") > 1e-5, F.greatest(F.lit(0.0), F.col("_y") + boost) / F.col("_y")).otherwise(1.0))
    return df.withColumns({c: F.greatest(F.lit(0.0), F.col(c) * F.col("_k")) for c in "rgb"}).drop("_y", "_l", "_r", "_t", "_b", "_e", "_k")


def denoise(df: DataFrame, luma_strength: float = 0, luma_detail: float = 0, luma_contrast: float = 0, chroma_strength: float = 0, chroma_smoothness: float = 0, sharpening: float = 0, masking: float = 0, preview: bool = False) -> DataFrame:
    """Luminance, then chroma, then sharpening; a stage that is off isn't in the plan."""
    return sharpen(chroma_nr(luminance_nr(df, luma_strength, luma_detail, luma_contrast), chroma_strength, chroma_smoothness), sharpening, masking, preview)


def local_maxima(df: DataFrame, threshold: Column | float, border: int = 2, value: str = "lum") -> DataFrame:
    """Pixels over the threshold and above all eight neighbours, at least ``border`` pixels from the frame's edge."""
    g = grid(df, value)
    c = F.col(value)
    top = F.lit(True)
    for i in range(3):
        for j in range(3):
            if (i, j) != (1, 1):
                top &= c > F.col(f"n{i}{j}")
    g = g.withColumns({"_w": F.max("x").over(W.partitionBy(*ROW)), "_h": F.max("y").over(W.partitionBy(*COLUMN))})
    inside = (F.col("x") >= border) & (F.col("y") >= border) & (F.col("x") <= F.col("_w") - border) & (F.col("y") <= F.col("_h") - border)
    return g.where((c > threshold) & top & inside).drop("_w", "_h", *[f"n{i}{j}" for i in range(3) for j in range(3)])


def pixel_shift(shots: DataFrame) -> DataFrame:
    """Four shots (column shot 0 to 3) moved by a pixel each, merged by the phase of the colour filter."""
    wide = shots.groupBy("frame_id", "y", "x").agg(*[F.max(F.when(F.col("shot") == k, F.col(c))).alias(f"{c}{k}") for k in range(4) for c in "rgb"])
    w, v = _rows(wide), _columns(wide)
    wide = wide.withColumns({f"{c}{k}": beside(f"{c}{k}", w, -1) for k in (1, 2) for c in "rgb"})
    wide = wide.withColumns({f"{c}{k}": beside(f"{c}{k}", v, -1) for k in (2, 3) for c in "rgb"})
    phase = (F.col("y") % 2) * 2 + F.col("x") % 2
    pick = lambda *names: F.when(phase == 0, names[0]).when(phase == 1, names[1]).when(phase == 2, names[2]).otherwise(names[3])
    col = F.col
    return wide.select("frame_id", "y", "x", pick(col("r0"), col("r1"), col("r3"), col("r2")).alias("r"), (pick(col("g1") + col("g3"), col("g0") + col("g2"), col("g0") + col("g2"), col("g1") + col("g3")) * 0.5).alias("g"), pick(col("b2"), col("b3"), col("b1"), col("b0")).alias("b"))


def prefetch_order(items: DataFrame, at: str = "pos", reach: int = 5) -> DataFrame:
    """For each item the others within reach, nearest first and forward before back: rank from 1. Each is one row shifted, not a join."""
    steps = [s * k for k in range(1, reach + 1) for s in (1, -1)]
    near = F.explode(F.array(*[F.struct((F.col(at) + s).alias("near"), F.lit(i + 1).alias("rank")) for i, s in enumerate(steps)]))
    last = items.agg(F.max(at)).first()[0]
    return items.select(F.col(at), near.alias("n")).select(at, "n.near", "n.rank").where((F.col("near") >= 0) & (F.col("near") <= F.lit(last)))
