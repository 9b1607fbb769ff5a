"""Measurement scopes: binned counts of pixels, and the pictures drawn from them.

Counts are one aggregation over (channel, column, row) with partial sums before the shuffle; pictures join the few bins to a
generated grid.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rasterloom.functions.dialect import SPARK, Dialect, num

# Packed colours of scope pictures.
BACKGROUND, DIVIDER, GRATICULE, SKIN_LINE = 0xFF0C0A0A, 0xFF2D2F33, 0x448E8E93, 0x55FF7900
VECTOR_BACKGROUND, VECTOR_GRID, VECTOR_TARGET, VECTOR_SKIN = 0xFF0A0A0C, 0xFF35393F, 0xFF8E8E93, 0xFFFF9500


def strides(width: int, height: int, wave_w: int) -> tuple[int, int]:
    """Every how many pixels a scope samples."""
    return max(1, width // (wave_w * 2)), max(1, height // 512)


def sampled(df: DataFrame, width: int, height: int, wave_w: int) -> DataFrame:
    sx, sy = strides(width, height, wave_w)
    return df.where((F.col("x") % sx == 0) & (F.col("y") % sy == 0)) if sx > 1 or sy > 1 else df


def channels(df: DataFrame, *keep: Column | str) -> DataFrame:
    """One row for each channel: channel (r, g, b) and v."""
    return df.select(*keep, F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(f"{c}8").alias("v")) for c in "rgb"])).alias("c")).select(*keep, "c.channel", "c.v")


def histogram(df: DataFrame, width: int, height: int, wave_w: int = 512) -> DataFrame:
    """A1: (channel, bin, n) of columns r8, g8, b8."""
    return channels(sampled(df, width, height, wave_w)).groupBy("channel", F.col("v").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def level_row(v: str, wave_h: int, d: Dialect = SPARK) -> str:
    """Row of a level: 255 on top."""
    return f"({wave_h - 1} - {d.idiv(f'{v} * {wave_h - 1}', '255')})"


def waveform(df: DataFrame, width: int, height: int, mode: str = "overlay", wave_w: int = 512, wave_h: int = 256) -> DataFrame:
    """A2 overlay, A3 parade (a third of the columns for each channel), A4 luma: (channel, col, row, n)."""
    df = sampled(df, width, height, wave_w)
    if mode == "luma":
        df = df.select("x", F.expr(f"CAST({num(0.2126)} * r8 + {num(0.7152)} * g8 + {num(0.0722)} * b8 AS INT)").alias("v"), F.lit("y").alias("channel"))
        col = F.expr(f"(x * {wave_w}) div {width}")
    else:
        df = channels(df, "x")
        third = wave_w // 3
        col = F.expr(f"(x * {wave_w}) div {width}") if mode == "overlay" else F.expr(f"(x * {third}) div {width} + CASE channel WHEN 'r' THEN 0 WHEN 'g' THEN {third} ELSE {2 * third} END")
    return df.groupBy("channel", col.cast("long").alias("col"), F.expr(level_row("v", wave_h)).cast("long").alias("row")).agg(F.count(F.lit(1)).alias("n"))


def float_levels(df: DataFrame) -> DataFrame:
    """A5: r8, g8, b8 of linear r, g, b, cut off (not rounded)."""
    return df.withColumns({f"{c}8": F.expr(f"CAST(least(greatest({c} * 255e0, 0e0), 255e0) AS INT)") for c in "rgb"})


def intensities(bins: DataFrame, power: float = 0.55, lift: float = 35.0) -> DataFrame:
    """Brightness of each bin from its count and the largest count."""
    top = F.max("n").over(W.partitionBy(F.lit(0)))
    top = bins.agg(F.max("n").alias("top")).first()[0] or 1
    gain = 255.0 / float(top) ** power
    return bins.withColumn("value", F.expr(f"CAST(least(greatest(CAST(pow(n, {num(power)}) * {num(gain)} + {num(lift)} AS INT), 0), 255) AS INT)"))


def grid(spark: SparkSession, width: int, height: int) -> DataFrame:
    return spark.range(width * height).select((F.col("id") % width).alias("col"), F.expr(f"id div {width}").alias("row"))


def graticule(width: int, height: int) -> dict[int, int]:
    """Rows of the exposure lines (100, 70, 50, 18 and 0) and their colours."""
    return {0: GRATICULE, int(height * 0.30): SKIN_LINE, int(height * 0.50): GRATICULE, int(height * 0.82): GRATICULE, height - 1: GRATICULE}


def with_graticule(picture: DataFrame, width: int, height: int) -> DataFrame:
    """Dotted lines over a picture (col, row, argb): they brighten what has any alpha."""
    rows = list(graticule(width, height))
    return picture.withColumn("argb", F.when(F.col("row").isin(rows) & (F.col("col") % 6 < 3), F.col("argb").bitwiseOR(F.lit(0x00333333))).otherwise(F.col("argb")))


def waveform_picture(bins: DataFrame, mode: str, wave_w: int, wave_h: int) -> DataFrame:
    """Every pixel of the scope as (col, row, argb)."""
    lit = intensities(bins).groupBy("col", "row").agg(*[F.coalesce(F.max(F.when(F.col("channel").isin(c, "y"), F.col("value"))), F.lit(0)).alias(c) for c in "rgb"])
    third = wave_w // 3
    full = grid(bins.sparkSession, wave_w, wave_h).join(lit, ["col", "row"], "left")
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    if mode == "parade":
        g = F.when(F.col("col") >= 2 * third, F.least(F.expr("b div 4"), F.lit(30))).otherwise(g)
    alpha = F.least(F.greatest(r, g, b) + 60, F.lit(255))
    argb = F.shiftleft(alpha.cast("long"), 24) + F.shiftleft(r.cast("long"), 16) + F.shiftleft(g.cast("long"), 8) + b.cast("long")
    picture = full.withColumn("argb", F.when(r.isNull(), F.lit(BACKGROUND)).otherwise(argb))
    if mode == "parade":
        picture = picture.withColumn("argb", F.when(F.col("col").isin(third, 2 * third), F.lit(DIVIDER)).otherwise(F.col("argb")))
    return with_graticule(picture, wave_w, wave_h).select("col", "row", "argb")


def histogram_picture(bins: DataFrame, wave_w: int, wave_h: int) -> DataFrame:
    """Bars of the three channels as (col, row, argb)."""
    top = bins.agg(F.max("n")).first()[0] or 1
    bars = bins.groupBy("bin").agg(*[F.coalesce(F.max(F.when(F.col("channel") == c, F.expr(f"CAST(n * {num((wave_h - 1) / top)} AS INT)"))), F.lit(0)).alias(c) for c in "rgb"])
    full = grid(bins.sparkSession, wave_w, wave_h).withColumn("bin", F.expr(f"CAST((col * 256) div {wave_w} AS INT)")).join(F.broadcast(bars), "bin", "left")
    up = F.lit(wave_h - 1) - F.col("row")
    on = {c: up <= F.coalesce(F.col(c), F.lit(0)) for c in "rgb"}
    part = lambda c, n: F.when(on[c], F.lit(220 << n)).otherwise(F.lit(0))
    argb = F.when(on["r"] | on["g"] | on["b"], F.lit(0xEE000000) + part("r", 16) + part("g", 8) + part("b", 0)).otherwise(F.lit(BACKGROUND))
    return with_graticule(full.withColumn("argb", argb), wave_w, wave_h).select("col", "row", "argb")


# Colour-difference weights.
CB, CR = (-0.168736, -0.331264, 0.5), (0.5, -0.418688, -0.081312)


def chroma_bins(df: DataFrame, width: int, height: int, dim: int = 256, gain: float = 2.0) -> DataFrame:
    """(vx, vy, n) of linear r, g, b; values off the scope are dropped."""
    df = df.where((F.col("x") % max(1, width // 512) == 0) & (F.col("y") % max(1, height // 512) == 0))
    mix = lambda w: "(" + " + ".join(f"{num(k)} * {c}" for k, c in zip(w, "rgb")) + ")"
    df = df.select(F.expr(f"CAST(({mix(CB)} * {num(gain)} + 0.5e0) * {num(dim)} AS BIGINT)").alias("vx"), F.expr(f"CAST((-{mix(CR)} * {num(gain)} + 0.5e0) * {num(dim)} AS BIGINT)").alias("vy"))
    return df.where((F.col("vx") >= 0) & (F.col("vx") < dim) & (F.col("vy") >= 0) & (F.col("vy") < dim)).groupBy("vx", "vy").agg(F.count(F.lit(1)).alias("n"))


def vector_graticule(dim: int, gain: float = 2.0) -> dict[tuple[int, int], int]:
    """The first colour that is drawn at each place: crosshair, rings, skin line, targets, in this order."""
    out: dict[tuple[int, int], int] = {}

    def dot(x: float, y: float, colour: int) -> None:
        if 0 <= int(x) < dim and 0 <= int(y) < dim and (out.get((int(x), int(y)), 0) & 0xFFFFFF) < 0x404040:
            out[int(x), int(y)] = colour

    c, radius = dim * 0.5, dim * 0.45
    for i in (i for i in range(dim) if i % 4):
        dot(i, int(c), VECTOR_GRID), dot(int(c), i, VECTOR_GRID)
    for deg in range(360):
        a = math.radians(deg)
        dot(c + radius * math.cos(a), c + radius * math.sin(a), VECTOR_GRID)
        if deg % 2 == 0:
            dot(c + 0.75 * radius * math.cos(a), c + 0.75 * radius * math.sin(a), VECTOR_GRID)
    a = math.radians(123 - 90)
    for r in range(10, math.ceil(radius)):
        if r % 4:
            dot(c - r * math.cos(a), c - r * math.sin(a), VECTOR_SKIN)
    for r, g, b in ((1, 0, 0), (1, 0, 1), (0, 0, 1), (0, 1, 1), (0, 1, 0), (1, 1, 0)):
        v = [0.75 * k for k in (r, g, b)]
        tx = int((sum(k * x for k, x in zip(CB, v)) * gain + 0.5) * dim)
        ty = int((-sum(k * x for k, x in zip(CR, v)) * gain + 0.5) * dim)
        for dx in range(-2, 3):
            for dy in range(-2, 3):
                if 2 in (abs(dx), abs(dy)):
                    dot(tx + dx, ty + dy, VECTOR_TARGET)
    return out


def vectorscope_picture(bins: DataFrame, dim: int = 256, gain: float = 2.0) -> DataFrame:
    """The trace in its phosphor colour with the graticule where it is dark: (col, row, argb)."""
    spark = bins.sparkSession
    lit = intensities(bins, 0.5, 40.0).select(F.col("vx").alias("col"), F.col("vy").alias("row"), "value")
    marks = spark.createDataFrame([(x, y, v) for (x, y), v in vector_graticule(dim, gain).items()], "col long, row long, mark long")
    full = grid(spark, dim, dim).join(lit, ["col", "row"], "left").join(F.broadcast(marks), ["col", "row"], "left")
    v = F.col("value")
    trace = F.lit(0xFF000000) + F.shiftleft((v * 0.2).cast("int").cast("long"), 16) + F.shiftleft(v.cast("long"), 8) + (v * 0.7).cast("int").cast("long")
    base = F.coalesce(trace, F.lit(VECTOR_BACKGROUND))
    dark = base.bitwiseAND(F.lit(0xFFFFFF)) < 0x404040
    return full.select("col", "row", F.when(F.col("mark").isNotNull() & dark, F.col("mark")).otherwise(base).alias("argb"))
