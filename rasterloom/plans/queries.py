"""Registered queries: each operator over a whole table, with SQL for another engine where it can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rasterloom.functions import colour as c
from rasterloom.functions.dialect import DUCK, SPARK, Dialect, Layer, apply, num, per_channel, smoothstep, sql
from rasterloom.operators import calibrate, catalog, develop, geometry, masks, scopes, stack, stencil, xmp
from rasterloom.plans.registry import QUERIES, SQL, Query, register
from rasterloom.sources import dims
from rasterloom.sources.images import synthetic_colours, synthetic_frames
from rasterloom.sources.views import CATALOG, HEIGHT, PIXEL_COLUMNS, PIXELS, SAMPLES, WIDTH, height, pixels, samples, spread, table
from rasterloom.sources.views import catalog as catalog_view
from rasterloom.streaming import tether

W_, RGB = str(WIDTH), ("r", "g", "b")


def rounded(cols: tuple[str, ...] = RGB, keys: tuple[str, ...] = ("x", "y"), digits: int = 6) -> list[str]:
    return [*keys, *(f"round(CAST({k} AS DOUBLE), {digits}) AS {k}" for k in cols)]


def pixelwise(name: str, layers: Callable[[Dialect, str], list[Layer]], cols: tuple[str, ...] = RGB, plain: tuple[str, ...] = ()) -> None:
    """An operator on pixels: layers(dialect, frame height). cols are rounded, plain ones taken as they are."""
    out = [*rounded(cols), *plain]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        # a long literal: squares of a tall frame's height don't fit in an int
        return apply(pixels(spark, sf_dir), layers(SPARK, f"{height(spark, sf_dir)}L")).selectExpr(*out)

    register(name, sql(PIXELS, PIXEL_COLUMNS, layers(DUCK, HEIGHT), ", ".join(out)))(run)


E8 = ("r8", "g8", "b8")
EIGHT = lambda d, h: [c.eight_bit("srgb", d)]
CURVE = tuple((i / 255) ** 1.2 for i in range(256))
FULL = develop.Params(kelvin=6200, tint=8, shadow_tint=(3, -2, 4), exposure_ev=0.5, dehaze=15, primary_hue=(5, 0, -5), primary_saturation=(10, 0, 5), highlights=-40, shadows=20, contrast=12, whites=5, blacks=4, band_hue=(5, 0, 0, -8, 0, 10, 0, 0), band_saturation=(10, 0, 5, 0, 0, -10, 0, 0), band_luminance=(0, 4, 0, 0, -6, 0, 0, 0), vibrance=25, saturation=6, tone_curve=CURVE)

# develop (2.3)
pixelwise("p01_white_balance", lambda d, h: develop.white_balance(6200, 8))
pixelwise("p02_shadow_tint", lambda d, h: develop.shadow_tint(10, -5, 8))
pixelwise("p03_exposure", lambda d, h: develop.exposure(0.75))
pixelwise("p04_dehaze", lambda d, h: develop.dehaze(40))
pixelwise("p04_haze", lambda d, h: develop.dehaze(-30))
pixelwise("p05_primaries", lambda d, h: develop.primaries((12, -8, 15), (20, 10, -15)))
pixelwise("p06_highlights", lambda d, h: [*develop.exposure(1), *develop.highlights(-80)])
pixelwise("p06_highlights_up", lambda d, h: develop.highlights(50))
pixelwise("p07_shadows", lambda d, h: develop.shadows(35))
pixelwise("p08_contrast", lambda d, h: develop.contrast(30))
pixelwise("p09_levels", lambda d, h: develop.levels(20, 15))
pixelwise("p10_hue_bands", lambda d, h: develop.hue_bands((10, 0, -15, 5, 0, 20, 0, -5), (20, 0, 0, -30, 10, 0, 0, 5), (0, 5, 0, 10, 0, -10, 0, 0)))
pixelwise("p11_monochrome", lambda d, h: develop.monochrome((0.2, 0.15, 0.15, 0.1, 0.1, 0.05, 0.1, 0.15)))
pixelwise("p12_vibrance", lambda d, h: develop.vibrance(80, 10))
pixelwise("p12_vibrance_down", lambda d, h: develop.vibrance(-40))
pixelwise("p13_tone_curve", lambda d, h: develop.tone_curve(CURVE, d))
pixelwise("p14_develop", lambda d, h: develop.develop(FULL, d))
pixelwise("p16_hsl", lambda d, h: c.to_hsl(), ("h", "s", "l"))
pixelwise("p17_hsl_back", lambda d, h: [*c.to_hsl(), *c.from_hsl()])
pixelwise("p18_angle", lambda d, h: [*c.to_hsl(), {"off": c.angle_between("h", "200e0")}], ("off",))
for space in ("linear", "adobe", "srgb"):
    pixelwise(f"p19_{space}", lambda d, h, s=space: [per_channel(lambda k: c.encode(k, s))])
for bits in (8, 16):
    pixelwise(f"p20_dither{bits}", lambda d, h, b=bits: [{f"q{k}": c.quantise(d, c.encode(k), i, b) for i, k in enumerate("rgb")}], (), ("qr", "qg", "qb"))
pixelwise("p21_formats", lambda d, h: [{"fmt": "CASE x % 4 WHEN 0 THEN 'jpeg' WHEN 1 THEN 'webp' WHEN 2 THEN 'tiff16' ELSE 'dng' END"}, {"bits": "CASE WHEN fmt IN ('tiff16', 'dng') THEN 16 ELSE 8 END", "space": "CASE WHEN fmt = 'dng' THEN 'linear' ELSE 'srgb' END"}], (), ("fmt", "bits", "space"))
pixelwise("p27_local_adjust", lambda d, h: [{"w": "(x % 10) / 9e0"}, *develop.local_adjust(develop.Local(0.6, 400, 5, 20, -30, 25, 10, 5, 15, 20))])
pixelwise("p28_lab", lambda d, h: c.to_lab(), ("lab_l", "lab_a", "lab_b"))
pixelwise("p28_lab_back", lambda d, h: [*c.to_lab(), *c.from_lab()])
pixelwise("p29_delta_e", lambda d, h: [*c.to_lab(), *c.delta_e00(("lab_l", "lab_a", "lab_b"), ("50e0", "(-10e0)", "20e0"))], ("delta_e",))
pixelwise("p30_soft_proof", lambda d, h: [*c.to_lab(), *masks.gamut("hahnemuhle_photorag"), *masks.soft_proof("hahnemuhle_photorag", "relative")])
pixelwise("p30_soft_proof_warning", lambda d, h: [*c.to_lab(), *masks.gamut("canon_pt101"), *masks.soft_proof("canon_pt101", "perceptual", warning=(1.0, 0.0, 1.0))])
pixelwise("p31_defringe", lambda d, h: develop.defringe(80, 40))
pixelwise("p32_vignetting", lambda d, h: develop.vignetting(-0.38, 0.12, 100, W_, h))
pixelwise("p33_false_colour", lambda d, h: [{"ire": c.ire()}, c.false_colour()], ("ire", *RGB))
pixelwise("p34_argb", lambda d, h: [*EIGHT(d, h), {"argb": c.pack_argb(d, "255", "r8", "g8", "b8")}, {k + "_": v for k, v in c.unpack_argb(d, "argb").items()}], (), ("argb", "a8_", "r8_", "g8_", "b8_"))
pixelwise("p39_horizon", lambda d, h: [{"turn": c_turn} for c_turn in (catalog.horizon("x + 1e0", "y - 7e0"),)], ("turn",))
pixelwise("p40_bezier", lambda d, h: catalog.bezier("(x / 49e0)", 0.2, 0.0, 0.0, 1.0), ("eased",))
pixelwise("p38_viewport", lambda d, h: catalog.viewport("1080e0", "720e0", "4000e0", "3000e0", "(1e0 + x / 10e0)", "(x * 4e0 - 100e0)", "(y % 100 - 50e0)"), ("left_part", "top_part", "right_part", "bottom_part"))

# masks and predicates (2.4)
NORM = lambda h: [masks.normalised(W_, h)]
POLY = [(0.2, 0.2), (0.8, 0.25), (0.55, 0.5), (0.8, 0.8), (0.2, 0.75)]
STROKES = [{"x": 0.3, "y": 0.4, "pressure": 0.2, "radius": 12.0}, {"x": 0.5, "y": 0.5, "pressure": 1.0, "radius": 15.0, "flow": 0.7}, {"x": 0.5, "y": 0.55, "pressure": 0.8, "radius": 6.0, "eraser": True}]
pixelwise("f01_linear", lambda d, h: [*NORM(h), *masks.linear((0.1, 0.2), (0.9, 0.7))], ("w",))
pixelwise("f02_radial", lambda d, h: [*NORM(h), *masks.radial((0.5, 0.5), 0.4, 0.25, 0.5, 0.6)], ("w",))
pixelwise("f03_polygon", lambda d, h: [*NORM(h), *masks.polygon(POLY)], ("w",))
pixelwise("f04_brush", lambda d, h: masks.brush(STROKES, 10.0, 0.5, W_, h, d), ("w",))
pixelwise("f05_luminance", lambda d, h: masks.luminance(0.3, 0.7), ("w",))
pixelwise("f06_colour_range", lambda d, h: masks.colour_range(120, 0.6, 0.5, (20, 0.2, 0.2)), ("w",))
pixelwise("f07_depth", lambda d, h: [{"depth": "CASE WHEN x = 7 THEN NULL ELSE x / 49e0 END"}, *masks.depth(0.3, 0.6)], ("w",))
pixelwise("f09_single_mask", lambda d, h: [*NORM(h), *masks.radial((0.4, 0.6), 0.5, 0.5, inverted=True), masks.opacity(0.8)], ("w",))
pixelwise("f10_composite", lambda d, h: [*NORM(h), *masks.composite([(masks.radial((0.5, 0.5), 0.4, 0.4), "replace", 1.0), (masks.luminance(0.4, 1.0), "intersect", 1.0), (masks.linear((0, 0), (1, 0)), "union", 0.5), (masks.polygon(POLY), "subtract", 0.7)])], ("w",))
pixelwise("f11_mask_layers", lambda d, h: [*NORM(h), *masks.radial((0.5, 0.5), 0.4, 0.4), *develop.local_adjust(develop.Local(exposure_ev=1.0)), *masks.luminance(0.5, 1.0), *develop.local_adjust(develop.Local(saturation=-30, contrast=20))])
pixelwise("f12_zebra", lambda d, h: masks.zebra(70, 3, d))
pixelwise("f13_gamut", lambda d, h: [*c.to_lab(), *masks.gamut("matte paper")], (), ("out_of_gamut",))

PX8 = sql(PIXELS, PIXEL_COLUMNS, EIGHT(DUCK, ""), "*")


# SQL of these is written on its own, from the numbers of the settings
_luma = "(0.2126e0 * r + 0.7152e0 * g + 0.0722e0 * b)"


@register("p22_preview_matrix", f"""
WITH k AS (SELECT pow(2e0, 0.4e0) * 1.15e0 * (1 + 20e0 / 250) AS gain, -0.5e0 * 1.15e0 * 255 + 127.5e0 + (35 * 0.35e0 + 10 * 0.25e0 + (-40) * 0.35e0 + 5 * 0.25e0) * 0.4e0 AS lift,
  1 + (-20 + 30 * 0.75e0) / 100 AS sat, 1 + 700e0 / 5500 * 0.45e0 AS warm, 1 - 700e0 / 5500 * 0.45e0 AS cold),
m AS (SELECT *, (1 - sat) * 0.2126e0 AS sr, (1 - sat) * 0.7152e0 AS sg, (1 - sat) * 0.0722e0 AS sb FROM k),
c AS (SELECT x, y, (sr + sat) * gain * warm * 1.08e0 * 1.04e0 * r8 + sg * gain * g8 + sb * gain * b8 + lift AS r8, sr * gain * r8 + (sg + sat) * gain * 0.96e0 * 1.02e0 * g8 + sb * gain * b8 + lift AS g8,
  sr * gain * r8 + sg * gain * g8 + (sb + sat) * gain * cold * 0.96e0 * b8 + lift AS b8 FROM ({PX8}), m)
SELECT x, y, round(least(greatest(r8, 0), 255), 6) AS r8, round(least(greatest(g8, 0), 255), 6) AS g8, round(least(greatest(b8, 0), 255), 6) AS b8 FROM c""")
def p22(spark: SparkSession, d: str) -> DataFrame:
    p = develop.Preview(exposure_ev=0.4, contrast=15, shadows=35, blacks=10, highlights=-40, whites=5, kelvin=6200, tint=8, clarity=20, saturation=-20, vibrance=30, profile="portrait")
    return apply(px8(spark, d), develop.preview_matrix(develop.exposure_matrix(p))).selectExpr(*rounded(E8))


@register("p22_preview_mono", f"""
WITH v AS (SELECT x, y, least(greatest((0.18e0 * r8 + 0.16e0 * g8 + 0.06e0 * b8) / 0.4e0 * pow(2e0, -0.5e0) * 0.9e0 + 12.75e0, 0), 255) AS v FROM ({PX8}))
SELECT x, y, round(v, 6) AS r8, round(v, 6) AS g8, round(v, 6) AS b8 FROM v""")
def p22_mono(spark: SparkSession, d: str) -> DataFrame:
    p = develop.Preview(exposure_ev=-0.5, contrast=-10, kelvin=4000, saturation=50, monochrome=True, mono_weights=(0.18, 0.24, 0.22, 0.16, 0.08, 0.06, 0.03, 0.03))
    return apply(px8(spark, d), develop.preview_matrix(develop.exposure_matrix(p))).selectExpr(*rounded(E8))


@register("p23_preview_gain", f"SELECT x, y, CAST(least(floor(r8 * pow(2e0, 0.3e0)), 255) AS INTEGER) AS r8, CAST(least(floor(g8 * pow(2e0, 0.3e0)), 255) AS INTEGER) AS g8, CAST(least(floor(b8 * pow(2e0, 0.3e0) * 1.1e0), 255) AS INTEGER) AS b8 FROM ({PX8})")
def p23(spark: SparkSession, d: str) -> DataFrame:
    return apply(px8(spark, d), develop.preview_gain(0.3, 4800)).select("x", "y", *E8)


@register("p24_colour_wheels", f"""
WITH w AS (SELECT *, pow(least(greatest(1 - {_luma} / 0.86e0, 0), 1), 2) AS lo, pow(least(greatest(({_luma} - 0.26e0) / 0.74e0, 0), 1), 2) AS hi FROM {PIXELS}),
m AS (SELECT *, greatest(0, 1 - lo - hi) AS mid FROM w)
SELECT x, y, round(greatest(0, r + lo * 0.1e0 * 0.5e0 + lo * -0.3e0 * 0.2e0 + mid * -0.05e0 * 0.5e0 + mid * 0.1e0 * 0.2e0 + hi * 0.2e0 * 0.5e0 + hi * 0.05e0 * 0.2e0 + 0.01e0 * 0.3e0 - 0.02e0 * 0.15e0), 6) AS r,
  round(greatest(0, g + lo * -0.2e0 * 0.5e0 + lo * -0.3e0 * 0.2e0 + mid * 0.1e0 * 0.2e0 + hi * 0.1e0 * 0.5e0 + hi * 0.05e0 * 0.2e0 - 0.02e0 * 0.15e0), 6) AS g,
  round(greatest(0, b + lo * 0.15e0 * 0.5e0 + lo * -0.3e0 * 0.2e0 + mid * 0.05e0 * 0.5e0 + mid * 0.1e0 * 0.2e0 + hi * -0.1e0 * 0.5e0 + hi * 0.05e0 * 0.2e0 - 0.01e0 * 0.3e0 - 0.02e0 * 0.15e0), 6) AS b FROM m""")
def p24(spark: SparkSession, d: str) -> DataFrame:
    layers = develop.colour_wheels((0.1, -0.2, 0.15, -0.3), (-0.05, 0.0, 0.05, 0.1), (0.2, 0.1, -0.1, 0.05), (0.01, 0.0, -0.01, -0.02), balance=0.3, blending=0.75)
    return apply(pixels(spark, d), layers).selectExpr(*rounded())


@register("p26_split_toning", f"""
WITH y AS (SELECT *, {_luma} AS v FROM {PIXELS}),
a AS (SELECT x, y, v, least(greatest((v - 0.6e0) / 0.4e0, 0), 1) * 0.35e0 AS hi, least(greatest((0.6e0 - v) / 0.6e0, 0), 1) * 0.25e0 AS lo, r, g, b FROM y),
s AS (SELECT x, y, v, hi, r * (1 - lo) AS r, g * (1 - lo) + 2 * v * lo * 0.5e0 AS g, b * (1 - lo) + 2 * v * lo AS b FROM a)
SELECT x, y, round(r * (1 - hi) + 2 * v * hi, 6) AS r, round(g * (1 - hi) + 2 * v * hi * 0.6e0, 6) AS g, round(b * (1 - hi), 6) AS b FROM s""")
def p26(spark: SparkSession, d: str) -> DataFrame:
    return apply(pixels(spark, d), develop.split_toning(7 / 12, 0.5, 0.1, 0.7, 0.4)).selectExpr(*rounded())


@register("f16_crop", f"SELECT x - 5 AS x, y - CAST(round(0.1e0 * {HEIGHT}) AS BIGINT) AS y, round(r, 6) AS r, round(g, 6) AS g, round(b, 6) AS b FROM {PIXELS} WHERE x BETWEEN 5 AND 44 AND y >= CAST(round(0.1e0 * {HEIGHT}) AS BIGINT) AND y < CAST(round(0.1e0 * {HEIGHT}) AS BIGINT) + CAST(round(0.8e0 * {HEIGHT}) AS BIGINT)")
def f16(spark: SparkSession, d: str) -> DataFrame:
    return geometry.crop(pixels(spark, d), WIDTH, height(spark, d), 0.1, 0.1, 0.8, 0.8).selectExpr(*rounded())


@register("f17_slider", "SELECT event_id, CASE WHEN (value <= -100e0 AND before > -100e0) OR (value >= 100e0 AND before < 100e0) THEN 'limit' WHEN (before < 0e0 AND value >= 0e0) OR (before > 0e0 AND value <= 0e0) THEN 'zero' WHEN abs(value - before) >= 5e-2 THEN 'step' ELSE 'none' END AS kind FROM (SELECT event_id, value - 50 AS value, lag(value - 50, 1, 0) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)")
def f17(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value") - 50
    df = table(spark, d, "events").withColumn("before", F.lag(v, 1, 0.0).over(W.partitionBy("user_id").orderBy("ts", "event_id"))).withColumn("value", v)
    return df.select("event_id", F.expr(catalog.slider_kind("value", "before")).alias("kind"))


# scopes (2.6)
def px8(spark: SparkSession, d: str) -> DataFrame:
    return apply(pixels(spark, d), EIGHT(SPARK, ""))


LONG = f"(SELECT x, y, unnest(['r', 'g', 'b']) AS channel, unnest([r8, g8, b8]) AS v FROM ({PX8}) WHERE y % greatest(1, {HEIGHT} // 512) = 0)"


@register("a01_histogram", f"SELECT channel, v AS bin, count(*) AS n FROM {LONG} GROUP BY ALL")
def a01(spark: SparkSession, d: str) -> DataFrame:
    return scopes.histogram(px8(spark, d), WIDTH, height(spark, d))


def wave_sql(mode: str) -> str:
    if mode == "luma":
        src = f"(SELECT x, 'y' AS channel, CAST(trunc(0.2126e0 * r8 + 0.7152e0 * g8 + 0.0722e0 * b8) AS BIGINT) AS v FROM ({PX8}) WHERE y % greatest(1, {HEIGHT} // 512) = 0)"
        col = f"(x * 512) // {WIDTH}"
    else:
        src, col = LONG, f"(x * 512) // {WIDTH}" if mode == "overlay" else f"(x * 170) // {WIDTH} + CASE channel WHEN 'r' THEN 0 WHEN 'g' THEN 170 ELSE 340 END"
    return f"SELECT channel, CAST({col} AS BIGINT) AS col, CAST(255 - (v * 255) // 255 AS BIGINT) AS row, count(*) AS n FROM {src} GROUP BY ALL"


for i, mode in enumerate(("overlay", "parade", "luma")):
    register(f"a0{i + 2}_waveform_{mode}", wave_sql(mode))(lambda spark, d, m=mode: scopes.waveform(px8(spark, d), WIDTH, height(spark, d), m))


@register("a05_float_levels", f"SELECT x, y, " + ", ".join(f"CAST(least(greatest(trunc({k} * 255e0), 0), 255) AS INTEGER) AS {k}8" for k in RGB) + f" FROM {PIXELS}")
def a05(spark: SparkSession, d: str) -> DataFrame:
    return scopes.float_levels(pixels(spark, d)).select("x", "y", "r8", "g8", "b8")


@register("a06_intensity", f"SELECT *, CAST(least(greatest(trunc(pow(n, 0.55e0) * (255e0 / pow((SELECT max(n) FROM ({wave_sql('overlay')})), 0.55e0)) + 35e0), 0), 255) AS INTEGER) AS value FROM ({wave_sql('overlay')})")
def a06(spark: SparkSession, d: str) -> DataFrame:
    return scopes.intensities(scopes.waveform(px8(spark, d), WIDTH, height(spark, d), "overlay"))


def picture_sql(body: str, w: int, h: int) -> str:
    rows = ", ".join(map(str, scopes.graticule(w, h)))
    return f"SELECT col, row, CASE WHEN row IN ({rows}) AND col % 6 < 3 THEN argb | {0x333333} ELSE argb END AS argb FROM ({body})"


def grid_sql(w: int, h: int) -> str:
    return f"(SELECT i % {w} AS col, i // {w} AS row FROM range({w * h}) t(i))"


LIT = f"(SELECT *, CAST(least(greatest(trunc(pow(n, 0.55e0) * (255e0 / pow((SELECT max(n) FROM bins), 0.55e0)) + 35e0), 0), 255) AS BIGINT) AS value FROM bins)"
for mode in ("overlay", "parade"):
    _lit = "SELECT col, row, " + ", ".join(f"coalesce(max(value) FILTER (channel = '{k}'), 0) AS {k}" for k in RGB) + f" FROM {LIT} GROUP BY ALL"
    _g = "CASE WHEN col >= 340 THEN least(b // 4, 30) ELSE g END" if mode == "parade" else "g"
    _div = f"WHEN col IN (170, 340) THEN {scopes.DIVIDER}" if mode == "parade" else ""
    _body = f"SELECT col, row, CAST(CASE {_div} WHEN r IS NULL THEN {scopes.BACKGROUND} ELSE (CAST(least(greatest(r, {_g}, b) + 60, 255) AS BIGINT) << 24) + (r << 16) + (CAST({_g} AS BIGINT) << 8) + b END AS BIGINT) AS argb FROM {grid_sql(512, 256)} LEFT JOIN ({_lit}) USING (col, row)"
    register(f"a06_picture_{mode}", f"WITH bins AS ({wave_sql(mode)}) {picture_sql(_body, 512, 256)}")(lambda spark, d, m=mode: scopes.waveform_picture(scopes.waveform(px8(spark, d), WIDTH, height(spark, d), m), m, 512, 256))

_bars = "SELECT bin, " + ", ".join(f"coalesce(max(CAST(trunc(n * (127e0 / (SELECT max(n) FROM bins))) AS BIGINT)) FILTER (channel = '{k}'), 0) AS {k}" for k in RGB) + " FROM bins GROUP BY bin"
_on = {k: f"(127 - row <= coalesce({k}, 0))" for k in RGB}
_body = f"SELECT col, row, CASE WHEN {' OR '.join(_on.values())} THEN {0xEE000000} + CASE WHEN {_on['r']} THEN {220 << 16} ELSE 0 END + CASE WHEN {_on['g']} THEN {220 << 8} ELSE 0 END + CASE WHEN {_on['b']} THEN 220 ELSE 0 END ELSE {scopes.BACKGROUND} END AS argb FROM {grid_sql(256, 128)} LEFT JOIN ({_bars}) s ON s.bin = col"


@register("a07_histogram_picture", f"WITH bins AS ({SQL['a01_histogram']}) {picture_sql(_body, 256, 128)}")
def a07(spark: SparkSession, d: str) -> DataFrame:
    return scopes.histogram_picture(a01(spark, d), 256, 128)


_mix = lambda w: "(" + " + ".join(f"{num(k)} * {x}" for k, x in zip(w, RGB)) + ")"
VECTOR = f"SELECT vx, vy, count(*) AS n FROM (SELECT CAST(trunc(({_mix(scopes.CB)} * 2e0 + 0.5e0) * 256e0) AS BIGINT) AS vx, CAST(trunc((-{_mix(scopes.CR)} * 2e0 + 0.5e0) * 256e0) AS BIGINT) AS vy FROM {PIXELS} WHERE y % greatest(1, {HEIGHT} // 512) = 0) WHERE vx BETWEEN 0 AND 255 AND vy BETWEEN 0 AND 255 GROUP BY ALL"


@register("a08_vectorscope", VECTOR)
def a08(spark: SparkSession, d: str) -> DataFrame:
    return scopes.chroma_bins(pixels(spark, d), WIDTH, height(spark, d))


@register("a09_vectorscope_picture")
def a09(spark: SparkSession, d: str) -> DataFrame:
    return scopes.vectorscope_picture(a08(spark, d))


# stacks
@register("a10_mean", f"SELECT x, y, round(avg(r), 6) AS r, round(avg(g), 6) AS g, round(avg(b), 6) AS b FROM {SAMPLES} GROUP BY x, y")
def a10(spark: SparkSession, d: str) -> DataFrame:
    return stack.mean(samples(spark, d), ("x", "y")).selectExpr(*rounded())


@register("a11_median", "SELECT x, y, " + ", ".join(f"list_sort(list({k}))[len(list({k})) // 2 + 1] AS {k}" for k in RGB) + f" FROM {SAMPLES} GROUP BY x, y")
def a11(spark: SparkSession, d: str) -> DataFrame:
    return stack.median(samples(spark, d), ("x", "y"))


for mode in ("additive", "average", "screen", "lighten", "darken"):
    _fold = lambda k, m=mode: f"round(list_reduce(list({k} ORDER BY seq), lambda a, v: {stack.blend('a', 'v', '0.8e0', m)}), 6) AS {k}"
    register(f"a12_{mode}", f"SELECT x, y, {', '.join(map(_fold, RGB))} FROM {SAMPLES} GROUP BY x, y")(lambda spark, d, m=mode: stack.multiple_exposure(samples(spark, d), m, 0.8, ("x", "y")).selectExpr(*rounded()))

_clip, _src = f"(SELECT x, y, " + ", ".join(f"list_sort(list({k})) AS v{k}, min_by({k}, seq) AS f{k}" for k in RGB) + f" FROM {SAMPLES} GROUP BY x, y)", ""
for _ in range(3):
    _clip = f"(SELECT x, y, fr, fg, fb, " + ", ".join(f"{stack.clip_once('v' + k, 1.5, DUCK)} AS v{k}" for k in RGB) + f" FROM {_clip})"


@register("a13_kappa_sigma", "SELECT x, y, " + ", ".join(f"round(CASE WHEN len(v{k}) > 0 THEN list_sum(v{k}) / len(v{k}) ELSE f{k} END, 6) AS {k}" for k in RGB) + f" FROM {_clip}")
def a13(spark: SparkSession, d: str) -> DataFrame:
    return stack.kappa_sigma(samples(spark, d), 1.5, 3, ("x", "y")).selectExpr(*rounded())


# neighbourhoods (2.7): windows in SQL as well
def rows_sql(source: str, cols: dict[str, str]) -> str:
    """source with the left (l_), own and right (r_) value of each expression."""
    return "(SELECT *, " + ", ".join(f"coalesce(lag({e}) OVER rw, {e}) AS {k}0, {e} AS {k}1, coalesce(lead({e}) OVER rw, {e}) AS {k}2" for k, e in cols.items()) + f" FROM {source} WINDOW rw AS (PARTITION BY frame_id, y ORDER BY x))"


def nine_sql(source: str, expr: str) -> str:
    """source with n00 .. n22 of an expression."""
    parts = ", ".join(f"coalesce(lag(q{k}) OVER cw, q{k}) AS n0{k}, q{k} AS n1{k}, coalesce(lead(q{k}) OVER cw, q{k}) AS n2{k}" for k in range(3))
    return f"(SELECT * EXCLUDE (q0, q1, q2), {parts} FROM {rows_sql(source, {'q': expr})} WINDOW cw AS (PARTITION BY frame_id, x ORDER BY y))"


SOBEL = f"(SELECT frame_id, x, y, r, g, b, {c.luma()} AS lum, sqrt(pow((n02 + 2e0 * n12 + n22) - (n00 + 2e0 * n10 + n20), 2) + pow((n20 + 2e0 * n21 + n22) - (n00 + 2e0 * n01 + n02), 2)) AS grad FROM {nine_sql(PIXELS, c.luma())})"


@register("w01_sobel", f"SELECT x, y, round(grad, 6) AS grad FROM {SOBEL}")
def w01(spark: SparkSession, d: str) -> DataFrame:
    return stencil.sobel(pixels(spark, d)).selectExpr(*rounded(("grad",)))


@register("f08_edge_mask", f"SELECT x, y, round(least(greatest({smoothstep(num(0.5 - 0.2), num(0.5 + 0.2), 'grad')}, 0e0), 1e0), 6) AS w FROM {SOBEL}")
def f08(spark: SparkSession, d: str) -> DataFrame:
    return apply(stencil.sobel(pixels(spark, d)), masks.edge_weight(0.5, 0.2)).selectExpr(*rounded(("w",)))


@register("w02_focus_peaking", "SELECT x, y, " + ", ".join(f"round(CASE WHEN grad > 1.5e0 THEN {k} * 0.15e0 + {num(v)} * 0.85e0 ELSE {k} * 0.5e0 + lum * 0.5e0 END, 6) AS {k}" for k, v in zip(RGB, stencil.PEAKS["yellow"])) + f" FROM {SOBEL}")
def w02(spark: SparkSession, d: str) -> DataFrame:
    return stencil.focus_peaking(pixels(spark, d), "yellow", 1.5).selectExpr(*rounded())


def neighbours_sql(source: str, expr: str, r: int) -> str:
    """Sum of an expression over (2r + 1)^2 clamped neighbours, by a join on computed places: (x, y, total)."""
    w = f"(SELECT max(x) FROM {source})"
    h = f"(SELECT max(y) FROM {source})"
    return f"(SELECT a.x, a.y, sum({expr}) AS total FROM {source} a, range(-{r}, {r + 1}) i(dx), range(-{r}, {r + 1}) j(dy), {source} s WHERE s.x = least(greatest(a.x + dx, 0), {w}) AND s.y = least(greatest(a.y + dy, 0), {h}) GROUP BY a.x, a.y)"


ML = f"(SELECT frame_id, x, y, abs(2e0 * q1 - q0 - q2) + abs(2e0 * q1 - coalesce(lag(q1) OVER cw, q1) - coalesce(lead(q1) OVER cw, q1)) AS ml FROM {rows_sql(PIXELS, {'q': c.luma()})} WINDOW cw AS (PARTITION BY frame_id, x ORDER BY y))"


@register("w03_sharpness", f"WITH m AS MATERIALIZED {ML} SELECT x, y, round(total, 6) AS sharp FROM {neighbours_sql('m', 's.ml', 2)}")
def w03(spark: SparkSession, d: str) -> DataFrame:
    return stencil.sharpness(pixels(spark, d), 2).selectExpr(*rounded(("sharp",)))


@register("w04_box_mean", f"WITH m AS MATERIALIZED (SELECT * FROM {PIXELS}) SELECT x, y, round(total / 25, 6) AS r FROM {neighbours_sql('m', 's.r', 2)}")
def w04(spark: SparkSession, d: str) -> DataFrame:
    return stencil.box_mean(pixels(spark, d), "r", 2).selectExpr(*rounded(("r",)))


_s, _dt = 0.6, 0.3
_inv = 1 / (2 * (0.02 + _s * 0.2 * (1 - _dt * 0.6)) ** 2)
_wt = lambda i, j: (lambda a: f"CASE WHEN {a} <= 0 THEN 1e0 WHEN {a} >= 16 THEN 0e0 ELSE exp(-floor({a} * 32) / 32e0) END")(f"({num(((i - 1) ** 2 + (j - 1) ** 2) * 0.5)} + (n{i}{j} - lum) * (n{i}{j} - lum) * {num(_inv)})")
_nr = f"(SELECT *, {c.luma()} AS lum FROM {nine_sql(PIXELS, c.luma())})"
_ws, _ns = " + ".join(_wt(i, j) for i in range(3) for j in range(3)), " + ".join(f"n{i}{j} * {_wt(i, j)}" for i in range(3) for j in range(3))


@register("w05_luminance_nr", "SELECT x, y, " + ", ".join(f"round(greatest(0e0, {k} * CASE WHEN lum > 1e-5 THEN bl / lum ELSE 1e0 END), 6) AS {k}" for k in RGB) + f" FROM (SELECT *, lum * {num(1 - _s)} + CASE WHEN ws > 0 THEN ns / ws ELSE lum END * {num(_s)} AS bl FROM (SELECT *, {_ws} AS ws, {_ns} AS ns FROM {_nr}))")
def w05(spark: SparkSession, d: str) -> DataFrame:
    return stencil.luminance_nr(pixels(spark, d), 60, 30).selectExpr(*rounded())


@register("w06_chroma_nr")
def w06(spark: SparkSession, d: str) -> DataFrame:
    return stencil.chroma_nr(pixels(spark, d), 80, 60).selectExpr(*rounded())


_four = f"(SELECT *, coalesce(lag(q1) OVER cw, q1) AS t, coalesce(lead(q1) OVER cw, q1) AS o FROM {rows_sql(PIXELS, {'q': c.luma()})} WINDOW cw AS (PARTITION BY frame_id, x ORDER BY y))"
_edge = f"least(greatest((abs(q2 - q0) + abs(o - t) - {num(0.5 * 0.12)}) / {num(max(0.5 * 0.12 * 0.5, 0.005))}, 0e0), 1e0)"


@register("w07_sharpen", "SELECT x, y, " + ", ".join(f"round(greatest(0e0, {k} * CASE WHEN q1 > 1e-5 THEN greatest(0e0, q1 - ((q0 + q2 + t + o) * 0.25e0 - q1) * 0.8e0 * 1.5e0 * e) / q1 ELSE 1e0 END), 6) AS {k}" for k in RGB) + f" FROM (SELECT *, {_edge} AS e FROM {_four})")
def w07(spark: SparkSession, d: str) -> DataFrame:
    return stencil.sharpen(pixels(spark, d), 80, 50).selectExpr(*rounded())


@register("w08_denoise")
def w08(spark: SparkSession, d: str) -> DataFrame:
    return stencil.denoise(pixels(spark, d), 40, 20, 10, 30, 20, 50, 20).selectExpr(*rounded())


@register("w09_local_maxima", f"SELECT x, y, round(lum, 6) AS lum FROM (SELECT *, {c.luma()} AS lum FROM {nine_sql(PIXELS, c.luma())}) WHERE lum > 0.6e0 AND " + " AND ".join(f"lum > n{i}{j}" for i in range(3) for j in range(3) if (i, j) != (1, 1)) + f" AND x BETWEEN 2 AND 47 AND y BETWEEN 2 AND {HEIGHT} - 3")
def w09(spark: SparkSession, d: str) -> DataFrame:
    return stencil.local_maxima(pixels(spark, d).withColumn("lum", F.expr(c.luma())), 0.6).selectExpr(*rounded(("lum",)))


SHOTS = f"(SELECT 0 AS frame_id, x, y, s.shot, r * (1e0 - s.shot * 0.1e0) AS r, g * (1e0 - s.shot * 0.1e0) AS g, b * (1e0 - s.shot * 0.1e0) AS b FROM {PIXELS}, (SELECT unnest([0, 1, 2, 3]) AS shot) s)"
_at = lambda n, dx, dy: f"LEFT JOIN s AS s{n} ON s{n}.shot = {n} AND s{n}.x = greatest(a.x + {dx}, 0) AND s{n}.y = greatest(a.y + {dy}, 0)"
_pick = lambda k, *o: "round(CASE (a.y % 2) * 2 + a.x % 2 " + " ".join(f"WHEN {i} THEN {e}" for i, e in enumerate(o)) + f" END, 6) AS {k}"


@register("w10_pixel_shift", f"WITH s AS MATERIALIZED {SHOTS} SELECT a.x, a.y, {_pick('r', 's0.r', 's1.r', 's3.r', 's2.r')}, {_pick('g', '(s1.g + s3.g) * 0.5e0', '(s0.g + s2.g) * 0.5e0', '(s0.g + s2.g) * 0.5e0', '(s1.g + s3.g) * 0.5e0')}, {_pick('b', 's2.b', 's3.b', 's1.b', 's0.b')} FROM {PIXELS} a {_at(0, 0, 0)} {_at(1, -1, 0)} {_at(2, -1, -1)} {_at(3, 0, -1)}")
def w10(spark: SparkSession, d: str) -> DataFrame:
    shots = pixels(spark, d).withColumn("shot", F.explode(F.array(*map(F.lit, range(4)))))
    return stencil.pixel_shift(shots.withColumns({k: F.expr(f"{k} * (1e0 - shot * 0.1e0)") for k in RGB})).selectExpr(*rounded())


@register("w11_heal")
def w11(spark: SparkSession, d: str) -> DataFrame:
    return geometry.heal(pixels(spark, d), WIDTH, height(spark, d), (30.0, 15.0), (12.0, 15.0), 6.0).selectExpr(*rounded())


@register("w12_prefetch", "SELECT a.doc_id AS pos, a.doc_id + o AS near, CAST(2 * abs(o) - CASE WHEN o > 0 THEN 1 ELSE 0 END AS INTEGER) AS rank FROM documents a, range(-5, 6) t(o) WHERE o <> 0 AND a.doc_id + o BETWEEN 0 AND (SELECT max(doc_id) FROM documents)")
def w12(spark: SparkSession, d: str) -> DataFrame:
    return stencil.prefetch_order(table(spark, d, "documents").select(F.col("doc_id").alias("pos")))


@register("a14_focus_stack")
def a14(spark: SparkSession, d: str) -> DataFrame:
    px = pixels(spark, d)
    frames = px.unionByName(px.withColumns({"frame_id": F.lit(1), "r": F.col("g"), "g": F.col("b"), "b": F.col("r")}))
    return stack.focus(frames, 3.0, 2).selectExpr(*rounded())


# geometry (2.8)
@register("g01_flip", f"SELECT 49 - x AS x, {HEIGHT} - 1 - y AS y, round(r, 6) AS r, round(g, 6) AS g, round(b, 6) AS b FROM {PIXELS}")
def g01(spark: SparkSession, d: str) -> DataFrame:
    return geometry.flip(pixels(spark, d), WIDTH, height(spark, d), True, True).selectExpr(*rounded())


@register("g02_quarter_turn", f"SELECT {HEIGHT} - 1 - y AS x, x AS y, round(r, 6) AS r, round(g, 6) AS g, round(b, 6) AS b FROM {PIXELS}")
def g02(spark: SparkSession, d: str) -> DataFrame:
    return geometry.quarter_turns(pixels(spark, d), WIDTH, height(spark, d), -3).selectExpr(*rounded())


def gather_sql(sx: str, sy: str, cols: tuple[str, ...], source: str, w: str, h: str, tw: str, th: str, zero: bool = False) -> str:
    """Bilinear gather with one join for each corner."""
    cut = lambda v, n: f"least(greatest({v}, 0), {n} - 1)"
    places = f"(SELECT x, y, sx, sy, CAST(floor(sx) AS BIGINT) AS ix, CAST(floor(sy) AS BIGINT) AS iy FROM (SELECT *, {sx} AS sx, {sy} AS sy FROM (SELECT i % {tw} AS x, i // {tw} AS y FROM range(CAST({tw} * {th} AS BIGINT)) t(i))))"
    joins = " ".join(f"LEFT JOIN src c{dx}{dy} ON c{dx}{dy}.x = {cut(f'ix + {dx}', w)} AND c{dx}{dy}.y = {cut(f'iy + {dy}', h)}" for dx in (0, 1) for dy in (0, 1))
    mix = lambda k: f"(1 - (sx - ix)) * (1 - (sy - iy)) * c00.{k} + (sx - ix) * (1 - (sy - iy)) * c10.{k} + (1 - (sx - ix)) * (sy - iy) * c01.{k} + (sx - ix) * (sy - iy) * c11.{k}"
    inside = lambda k: f"CASE WHEN sx >= 0 AND sx < {w} - 1 AND sy >= 0 AND sy < {h} - 1 THEN {mix(k)} ELSE 0e0 END" if zero else mix(k)
    return f"WITH src AS MATERIALIZED ({source}), gathered AS (SELECT p.x, p.y, {', '.join(f'{inside(k)} AS {k}' for k in cols)} FROM {places} p {joins})"


AFFINE = (0.98, 0.05, 1.5, -0.04, 1.01, -2.25)


@register("g08_warp_affine", gather_sql(*geometry.affine(AFFINE), RGB, f"SELECT * FROM {PIXELS}", "50", HEIGHT, "50", HEIGHT, zero=True) + " SELECT x, y, round(r, 6) AS r, round(g, 6) AS g, round(b, 6) AS b FROM gathered")
def g08(spark: SparkSession, d: str) -> DataFrame:
    return geometry.warp_affine(pixels(spark, d), WIDTH, height(spark, d), AFFINE).selectExpr(*rounded())


_a = -5.0
_rot = f"(25e0 + ((x - 25e0) * cos(radians(-5e0)) - (y - {HEIGHT} * 0.5e0) * sin(radians(-5e0))))", f"({HEIGHT} * 0.5e0 + ((x - 25e0) * sin(radians(-5e0)) + (y - {HEIGHT} * 0.5e0) * cos(radians(-5e0))))"


@register("g03_fine_rotation", gather_sql(*_rot, E8, PX8, "50", HEIGHT, "50", HEIGHT) + " SELECT x, y, " + ", ".join(f"CAST(least(greatest(round(round({k}, 9)), 0), 255) AS INTEGER) AS {k}" for k in E8) + " FROM gathered")
def g03(spark: SparkSession, d: str) -> DataFrame:
    return geometry.fine_rotation(px8(spark, d), WIDTH, height(spark, d), 5.0).select("x", "y", *E8)


_sc = f"(20e0 / greatest(50, {HEIGHT}))"


@register("g04_downscale", gather_sql(f"greatest((x + 0.5e0) / {_sc} - 0.5e0, 0e0)", f"greatest((y + 0.5e0) / {_sc} - 0.5e0, 0e0)", E8, PX8, "50", HEIGHT, f"CAST(greatest(1, floor(50 * {_sc} + 0.5e0)) AS BIGINT)", f"CAST(greatest(1, floor({HEIGHT} * {_sc} + 0.5e0)) AS BIGINT)") + " SELECT x, y, " + ", ".join(f"CAST(trunc(least(greatest(round({k}, 9) + 0.5e0, 0), 255)) AS INTEGER) AS {k}" for k in E8) + " FROM gathered")
def g04(spark: SparkSession, d: str) -> DataFrame:
    return geometry.downscale(px8(spark, d), WIDTH, height(spark, d), 20).select("x", "y", *E8)


@register("g05_geometry_order")
def g05(spark: SparkSession, d: str) -> DataFrame:
    h = height(spark, d)
    _, _, w1, h1 = geometry.crop_box(WIDTH, h, 0.1, 0.1, 0.8, 0.8)
    df = geometry.quarter_turns(geometry.flip(geometry.crop(px8(spark, d), WIDTH, h, 0.1, 0.1, 0.8, 0.8), w1, h1, True), w1, h1, 1)
    return geometry.downscale(geometry.fine_rotation(df, h1, w1, 3.0), h1, w1, 20).select("x", "y", *E8)


# crop 0.05, 0.1, 0.9, 0.8; a quarter turn, 5 degrees more, mirrored; tilts 0.6 and -0.4, distortion 0.2
_tilted = f"""
WITH src AS MATERIALIZED (SELECT * FROM {PIXELS}),
n AS (SELECT i % 30 AS x, i // 30 AS y, -((i % 30 + 0.5e0) / 30 - 0.5e0) AS a, (i // 30 + 0.5e0) / 40 - 0.5e0 AS b FROM range(1200) t(i)),
t AS (SELECT x, y, -b * cos(radians(5e0)) + a * sin(radians(5e0)) AS rx, b * sin(radians(5e0)) + a * cos(radians(5e0)) AS ry FROM n),
q AS (SELECT x, y, rx / (1 + ry * 0.24e0 - rx * 0.16e0) AS px, ry / (1 + ry * 0.24e0 - rx * 0.16e0) AS py FROM t),
u AS (SELECT x, y, 0.05e0 + (px * (1 + 0.1e0 * (px * px + py * py)) + 0.5e0) * 0.9e0 AS u, 0.1e0 + (py * (1 + 0.1e0 * (px * px + py * py)) + 0.5e0) * 0.8e0 AS v FROM q),
p AS (SELECT *, u BETWEEN 0 AND 1 AND v BETWEEN 0 AND 1 AS seen, least(greatest(u * 50 - 0.5e0, 0), 49) AS sx, least(greatest(v * {HEIGHT} - 0.5e0, 0), {HEIGHT} - 1) AS sy FROM u),
c AS (SELECT p.*, s.r, s.g, s.b, (1 - abs(sx - s.x)) * (1 - abs(sy - s.y)) AS k FROM p JOIN src s ON s.x BETWEEN floor(sx) AND floor(sx) + 1 AND s.y BETWEEN floor(sy) AND floor(sy) + 1)
"""


@register("g06_keystone", _tilted + "SELECT x, y, " + ", ".join(f"round(sum(CASE WHEN seen THEN {k} * c.k ELSE 0e0 END), 6) AS {k}" for k in RGB) + " FROM c GROUP BY x, y")
def g06(spark: SparkSession, d: str) -> DataFrame:
    p = geometry.Framing((0.05, 0.1, 0.9, 0.8), 5.0, 1, True, False, 0.6, -0.4, 0.2)
    return geometry.framed(pixels(spark, d), WIDTH, height(spark, d), p, (30, 40)).selectExpr(*rounded())


@register("g07_lens_correction")
def g07(spark: SparkSession, d: str) -> DataFrame:
    return geometry.lens_correction(pixels(spark, d), WIDTH, height(spark, d), {"k1": -0.024, "k2": 0.006, "tca_red": 0.00032, "tca_blue": -0.0004}).selectExpr(*rounded())


@register("g10_clone", f"""WITH p AS (SELECT x, y, r, g, b, sqrt(pow(x - 30, 2) + pow(y - 15, 2)) AS d FROM {PIXELS}),
  t AS (SELECT *, least(greatest((d - 4.9e0) / (2.1e0 + 1e-7), 0), 1) AS t FROM p), a AS (SELECT *, CASE WHEN d > 7 THEN 0 WHEN d <= 4.9e0 THEN 1 ELSE 1 - t * t * (3 - 2 * t) END AS a FROM t)
  SELECT a.x, a.y, """ + ", ".join(f"round(a.{k} * (1 - a) + s.{k} * a, 6) AS {k}" for k in RGB) + f" FROM a JOIN {PIXELS} s ON s.x = least(greatest(a.x - 18, 0), 49) AND s.y = least(greatest(a.y - 5, 0), {HEIGHT} - 1)")
def g10(spark: SparkSession, d: str) -> DataFrame:
    return geometry.clone(pixels(spark, d), WIDTH, height(spark, d), (30.0, 15.0), (12.0, 10.0), 7.0).selectExpr(*rounded())


_inv_t = geometry.inverse(AFFINE)


@register("g11_affine_inverse", f"SELECT x, y, round({geometry.affine(_inv_t)[0]}, 6) AS ix, round({geometry.affine(_inv_t)[1]}, 6) AS iy FROM {PIXELS}")
def g11(spark: SparkSession, d: str) -> DataFrame:
    ix, iy = geometry.affine(geometry.inverse(AFFINE))
    return pixels(spark, d).select("x", "y", F.round(F.expr(ix), 6).alias("ix"), F.round(F.expr(iy), 6).alias("iy"))


# calibration and stars
@register("a15_sample_patches")
def a15(spark: SparkSession, d: str) -> DataFrame:
    return calibrate.sample_patches(pixels(spark, d), WIDTH, height(spark, d)).selectExpr(*rounded(keys=("patch",)))


@register("a16_calibration")
def a16(spark: SparkSession, d: str) -> DataFrame:
    return calibrate.calibration(calibrate.sample_patches(pixels(spark, d), WIDTH, height(spark, d))).selectExpr(*rounded((*RGB, "delta_e"), keys=("patch",), digits=4))


@register("a17_sky", f"SELECT frame_id, round(avg({c.luma()}), 6) AS sky_mean, round(stddev_pop({c.luma()}), 6) AS sky_sigma FROM {PIXELS} WHERE (y * 50 + x) % 3 = 0 GROUP BY frame_id")
def a17(spark: SparkSession, d: str) -> DataFrame:
    px = pixels(spark, d).withColumn("i", F.col("y") * WIDTH + F.col("x"))
    return stack.sky(px, F.expr(c.luma()), 3).selectExpr(*rounded(("sky_mean", "sky_sigma"), keys=("frame_id",)))


@register("a18_stars")
def a18(spark: SparkSession, d: str) -> DataFrame:
    return calibrate.detect_stars(pixels(spark, d), 1.0).selectExpr(*rounded(("x", "y", "flux", "snr"), keys=("frame_id", "star")))


@register("a20_noise", f"SELECT y, round(stddev_pop(r), 6) AS sigma FROM {PIXELS} GROUP BY y")
def a20(spark: SparkSession, d: str) -> DataFrame:
    return stack.noise_level(pixels(spark, d), "r", "y").selectExpr("y", "round(sigma, 6) AS sigma")


@register("a21_cache", "SELECT user_id, CAST(sum(value) AS BIGINT) AS bytes, round(count(*) FILTER (event_type = 'click') / count(*)::DOUBLE, 6) AS hit_rate FROM (SELECT user_id, event_type, CAST(round(value * 100) AS BIGINT) AS value FROM events) GROUP BY user_id")
def a21(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("bytes"), F.round(F.count(F.when(F.col("event_type") == "click", 1)) / F.count(F.lit(1)), 6).alias("hit_rate"))


@register("j06_triangles")
def j06(spark: SparkSession, d: str) -> DataFrame:
    return calibrate.triangles(calibrate.detect_stars(pixels(spark, d), 1.0)).selectExpr(*rounded(("r1", "r2"), keys=("frame_id", "v0", "v1", "v2")))


@register("g09_transform")
def g09(spark: SparkSession, d: str) -> DataFrame:
    stars = calibrate.detect_stars(pixels(spark, d), 1.0)
    t = calibrate.estimate_transform(stars, stars.withColumns({"x": F.col("x") + 3.0, "y": F.col("y") + 2.0}))
    return spark.createDataFrame([tuple(round(v, 6) for v in t)], "m00 double, m01 double, tx double, m10 double, m11 double, ty double")


# catalog (2.1, 2.2, 2.5, 2.9)
@register("s09_is_raw", f"SELECT doc_id, lower(string_split(name, '.')[-1]) IN ({', '.join(repr(x) for x in catalog.RAW)}) AS raw FROM {CATALOG}")
def s09(spark: SparkSession, d: str) -> DataFrame:
    return catalog_view(spark, d).select("doc_id", catalog.is_raw("name").alias("raw"))


@register("s13_stored_entries", "WITH e AS (SELECT doc_id, 0 AS k, 'a://' || doc_id AS uri, '' AS file_name, coalesce(n_chars, 0) AS edited, doc_id % 6 AS rating, 'PICKED' AS pick_status FROM documents UNION ALL SELECT doc_id, 1, 'b://' || doc_id, 'n \"1\".dng', 1000, 0, 'NONE' FROM documents WHERE doc_id % 3 <> 0) SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY edited DESC, k) AS INTEGER) AS position, uri, file_name, CAST(edited AS BIGINT) AS last_edited_at, CAST(rating AS BIGINT) AS rating, pick_status FROM e WHERE doc_id % 4 <> 0")
def s13(spark: SparkSession, d: str) -> DataFrame:
    first = """concat('{"uri":"a://', doc_id, '","lastEditedAt":', coalesce(n_chars, 0), ',"rating":"', doc_id % 6, '","pickStatus":"PICKED"}')"""
    second = r"""concat('{"uri":"b://', doc_id, '","fileName":"n \\"1\\".dng","lastEditedAt":1000', CASE WHEN doc_id % 3 = 0 THEN ',"rating":null}' ELSE '}' END)"""
    # a broken text, an entry without uri before another, a rating that is no number, a plain catalog; null ratings
    tail = """CASE doc_id % 4 WHEN 0 THEN ',{"uri"' WHEN 1 THEN ',{"rating":1},{"uri":"c://"}]' WHEN 2 THEN ',{"uri":"d://","rating":"x"}]' ELSE ']' END"""
    stored = table(spark, d, "documents").where("doc_id IS NOT NULL").select("doc_id", F.expr(f"concat('[', {first}, ',', {second}, {tail})").alias("json"))
    return catalog.stored_entries(stored).select("doc_id", "position", "uri", "file_name", "last_edited_at", "rating", "pick_status")


@register("t03_newest", f"SELECT doc_id, uri, bytes FROM {CATALOG} ORDER BY bytes DESC, doc_id LIMIT 120")
def t03(spark: SparkSession, d: str) -> DataFrame:
    return catalog.newest(catalog_view(spark, d).select("doc_id", "uri", "bytes"), 120, "bytes", "doc_id")


@register("p41_cache_key", f"SELECT doc_id, md5(CASE WHEN doc_id % 2 = 0 THEN '/dcim/' || name ELSE uri END) AS key FROM {CATALOG}")
def p41(spark: SparkSession, d: str) -> DataFrame:
    path = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("/dcim/"), F.col("name"))).otherwise("")
    return catalog_view(spark, d).select("doc_id", catalog.cache_key(path, F.col("uri")).alias("key"))


@register("p42_sidecar_path", f"SELECT doc_id, regexp_replace('/dcim/' || name, '\\.[^./]*$', '') || '.xmp' AS path FROM {CATALOG}")
def p42(spark: SparkSession, d: str) -> DataFrame:
    return catalog_view(spark, d).select("doc_id", catalog.sidecar_path(F.concat(F.lit("/dcim/"), F.col("name"))).alias("path"))


@register("p43_file_type", "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'jpg' WHEN 1 THEN 'tif' WHEN 2 THEN 'webp' WHEN 3 THEN 'dng' ELSE 'jpg' END AS suffix, CASE doc_id % 5 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/tiff' WHEN 2 THEN 'image/webp' WHEN 3 THEN 'image/x-adobe-dng' ELSE 'image/jpeg' END AS media FROM documents")
def p43(spark: SparkSession, d: str) -> DataFrame:
    fmt = F.element_at(F.array(*map(F.lit, ("JPEG", "TIFF16", "WebP", "DNG", "bmp"))), (F.col("doc_id") % 5 + 1).cast("int"))
    ext, media = catalog.file_type(fmt)
    return table(spark, d, "documents").select("doc_id", ext.alias("suffix"), media.alias("media"))


@register("p37_exposure_line", "SELECT p_partkey, p_brand || '  |  ' || p_name || '  |  ' || CAST(p_size AS VARCHAR) || 'mm  f/' || printf('%.1f', p_size / 10e0) || '  1/' || CAST(CAST(floor(1e0 / (1e0 / (p_size + 1)) + 0.5e0) AS BIGINT) AS VARCHAR) || 's  ISO ' || CAST(p_size * 100 AS VARCHAR) || '  |  X' AS line FROM part")
def p37(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    return table(spark, d, "part").select("p_partkey", catalog.exposure_line(F.col("p_brand"), F.col("p_name"), size, size / 10, F.lit(1.0) / (size + 1), size * 100, "X").alias("line"))


@register("s08_shown_exif", "SELECT p_partkey, CASE WHEN t < 1 THEN '1/' || CAST(CAST(trunc(1e0 / t) AS BIGINT) AS VARCHAR) || 's' ELSE CAST(t AS VARCHAR) || 's' END AS shutter_text, 'f/' || CAST(p_size / 8e0 AS VARCHAR) AS aperture_text, 'ISO ' || CAST(p_size * 50 AS VARCHAR) AS iso_text, CAST(p_size AS VARCHAR) || 'mm' AS focal_text FROM (SELECT *, p_size / 16e0 AS t FROM part)")
def s08(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").selectExpr("p_partkey", "p_size / 16e0 AS exposure_time", "p_size / 8e0 AS f_number", "p_size * 50 AS iso_speed", "p_size AS focal_length")
    return catalog.shown_exif(p).select("p_partkey", "shutter_text", "aperture_text", "iso_text", "focal_text")


@register("k11_exposure_seconds", "SELECT p_partkey, round(CASE p_size % 3 WHEN 0 THEN 1e0 / p_size WHEN 1 THEN p_size / 10e0 END, 9) AS seconds FROM part")
def k11(spark: SparkSession, d: str) -> DataFrame:
    text = F.expr("CASE p_size % 3 WHEN 0 THEN concat('1/', p_size, 's') WHEN 1 THEN concat(CAST(p_size / 10e0 AS STRING), 's') ELSE 'bulb' END")
    return table(spark, d, "part").select("p_partkey", F.round(catalog.exposure_seconds(text), 9).alias("seconds"))


@register("s07_sample_size", "SELECT o_orderkey, CAST(CASE WHEN least(w, h) / 256e0 < 1 THEN 1 ELSE pow(2, floor(log2(least(w, h) / 256e0))) END AS INTEGER) AS sample FROM (SELECT o_orderkey, o_orderkey % 9000 + 1 AS w, o_orderkey % 6001 + 1 AS h FROM orders)")
def s07(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", catalog.sample_size(F.col("o_orderkey") % 9000 + 1, F.col("o_orderkey") % 6001 + 1, 256).alias("sample"))


@register("s11_markup", r"""SELECT page_id, CASE WHEN regexp_matches(html, '\blang="([^"]*)"') THEN regexp_extract(html, '\blang="([^"]*)"', 1) END AS lang, CASE WHEN regexp_matches(html, '\btitle="([^"]*)"') THEN regexp_extract(html, '\btitle="([^"]*)"', 1) WHEN regexp_matches(html, '<title>([^<]*)</title>') THEN regexp_extract(html, '<title>([^<]*)</title>', 1) END AS title FROM pages""")
def s11(spark: SparkSession, d: str) -> DataFrame:
    return xmp.tokens(table(spark, d, "pages").select("page_id", "html"), "html", entities=False).select("page_id", xmp.value("_tags", "lang").alias("lang"), xmp.value("_tags", "title").alias("title"))


# sidecars of every document: attributes or elements, either place of the pick, labels in any case, texts that are no numbers, entities
_SIDECAR = """concat('<x:xmpmeta><rdf:RDF><rdf:Description rdf:about="" tiff:Make="A &amp; B > ', doc_id % 3, '"', CASE WHEN doc_id % 2 = 0 THEN concat(' xmp:Rating="', doc_id % 6, '" xmp:Rating="9"') ELSE '' END, CASE doc_id % 3 WHEN 0 THEN ' crs:Pick="1"' WHEN 1 THEN ' photoshop:Urgency="-1"' ELSE ' crs:Pick="4"' END,
  ' crs:Temperature="', CASE WHEN doc_id % 5 = 0 THEN 'warm' ELSE concat('', 5000 + doc_id % 900) END, '">', CASE WHEN doc_id % 2 = 1 THEN concat('<xmp:Rating>', doc_id % 6, '</xmp:Rating>') ELSE '<xmp:Rating>8</xmp:Rating>' END, '<xmp:Label>', CASE doc_id % 4 WHEN 0 THEN 'GREEN' WHEN 1 THEN 'Blue' WHEN 2 THEN 'mauve' ELSE '' END, '</xmp:Label><dc:title><rdf:li>x</rdf:li></dc:title>',
  CASE WHEN doc_id % 7 = 0 THEN '' ELSE concat('<exif:LensModel>L&lt;', doc_id % 4, '&gt;</exif:LensModel>') END, '</rdf:Description></rdf:RDF></x:xmpmeta>')"""


@register("s11_sidecars", "SELECT doc_id, CAST(doc_id % 6 AS INTEGER) AS rating, CASE doc_id % 4 WHEN 0 THEN 'green' WHEN 1 THEN 'blue' ELSE 'none' END AS label, CASE doc_id % 3 WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END AS pick, 'A & B > ' || doc_id % 3 AS make, CASE WHEN doc_id % 7 <> 0 THEN 'L<' || doc_id % 4 || '>' END AS lens, CASE WHEN doc_id % 5 <> 0 THEN 5000e0 + doc_id % 900 END AS kelvin FROM documents")
def s11_sidecars(spark: SparkSession, d: str) -> DataFrame:
    """Sidecar texts read by one pass over their tokens."""
    return catalog.read_sidecar(table(spark, d, "documents").selectExpr("doc_id", f"{_SIDECAR} AS xml")).select("doc_id", "rating", "label", "pick", "make", "lens", "kelvin")


@register("k07_upsert_texts", """SELECT doc_id, concat('<rdf:Description crs:Tint="', CASE WHEN doc_id % 3 = 0 THEN '7' ELSE '1' END, '"', CASE doc_id % 3 WHEN 0 THEN concat('\n   xmp:Rating="', doc_id % 6, '"\n   xmp:Label="Red" ') WHEN 1 THEN concat(' xmp:Rating="', doc_id % 6, '"\n   crs:Tint2="x"') ELSE ' xmp:Rating="9"' END, CASE WHEN doc_id % 3 = 0 THEN '/>' ELSE concat('><xmp:Label>', CASE WHEN doc_id % 3 = 1 THEN 'Red' ELSE 'old' END, '</xmp:Label></rdf:Description>') END, '<rdf:Description/>') AS xml FROM documents""")
def k07_upsert_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts of sidecars after changes: values in place, or new attributes in the first description."""
    start = """CASE WHEN doc_id % 3 = 0 THEN '<rdf:Description crs:Tint="1" /><rdf:Description/>' ELSE '<rdf:Description crs:Tint="1" xmp:Rating="9"><xmp:Label>old</xmp:Label></rdf:Description><rdf:Description/>' END"""
    t = table(spark, d, "documents").selectExpr("doc_id", f"{start} AS xml", "CAST(doc_id % 6 AS STRING) AS stars")
    both, one = {"xmp:Rating": F.col("stars"), "xmp:Label": F.lit("Red")}, {"crs:Tint": F.lit("7")}
    changed = F.when(F.col("doc_id") % 3 == 0, catalog.upsert_tags(F.col("xml"), one | both)).when(F.col("doc_id") % 3 == 1, catalog.upsert_tags(F.col("xml"), both | {"crs:Tint2": F.lit("x")})).otherwise(F.col("xml"))
    return t.select("doc_id", changed.alias("xml"))


@register("s12_presets")
def s12(spark: SparkSession, d: str) -> DataFrame:
    p = spread(table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_size"), "p_partkey")
    xml = catalog.write_packet({"crs:PresetName": catalog.escape_xml(F.col("p_name")), "crs:Group": F.col("p_brand"), **catalog.setting_texts({"exposure_ev": F.col("p_size") / 25 - 1, "kelvin": F.col("p_size") * 100 + 2500, "tint": F.col("p_size") / 3})})
    return catalog.read_preset(p.select("p_partkey", xml.alias("xml"))).select("p_partkey", "name", "category", "exposure_ev", "kelvin", "tint", "monochrome")


SQL["s12_presets"] = "SELECT p_partkey, trim(p_name) AS name, upper(p_brand) AS category, CAST(printf('%.2f', p_size / 25e0 - 1) AS DOUBLE) AS exposure_ev, CAST(p_size * 100 + 2500 AS DOUBLE) AS kelvin, CAST(printf('%.1f', p_size / 3e0) AS DOUBLE) AS tint, FALSE AS monochrome FROM part"


@register("k07_sidecar_upsert")
def k07(spark: SparkSession, d: str) -> DataFrame:
    v = catalog_view(spark, d)
    first = catalog.write_packet({"xmp:Rating": F.col("rating").cast("string"), "crs:Tint": F.lit("1.0")})
    xml = catalog.upsert_tags(first, {"xmp:Rating": (F.col("rating") + 1).cast("string"), "xmp:Label": F.lit("Red")})
    return catalog.read_sidecar(v.select("doc_id", xml.alias("xml"))).select("doc_id", "rating", "label", "tint")


SQL["k07_sidecar_upsert"] = f"SELECT doc_id, rating + 1 AS rating, 'red' AS label, 1e0 AS tint FROM {CATALOG}"


@register("k09_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type AS kind FROM events")
def k09(spark: SparkSession, d: str) -> DataFrame:
    packed = table(spark, d, "events").select("event_id", F.to_json(F.struct(F.get_json_object("props", "$.k").cast("long").alias("k"), F.col("event_type").alias("kind"))).alias("j"))
    return packed.select("event_id", F.from_json("j", "k long, kind string, scale double").alias("s")).select("event_id", "s.k", "s.kind")


@register("s14_json_defaults", "SELECT event_id, coalesce(CAST(json_extract_string(props, '$.missing') AS DOUBLE), 5500e0) AS kelvin FROM events")
def s14(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.coalesce(F.from_json("props", "k long, missing double")["missing"], F.lit(5500.0)).alias("kelvin"))


@register("s15_intents", "SELECT conv_id, list(turn ORDER BY turn) || list_filter([-1, 0, 100], lambda v: NOT list_contains(list(turn), v)) AS uris FROM conversations GROUP BY conv_id")
def s15(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("s"))
    return s.select("conv_id", catalog.intent_uris(F.col("s"), F.array(*[F.lit(v).cast("long") for v in (-1, 0, 100, 100)])).alias("uris"))


# fixed tables (2.2), each joined to a given one
_ENUMS = ", ".join(f"('{k}', {i}, '{v}', {len(names)})" for k, names in dims.ENUMS.items() for i, v in enumerate(names))


@register("s16_dims", f"SELECT p_partkey, enum, code, name FROM part JOIN (VALUES {_ENUMS}) v(enum, code, name, n) ON code = p_partkey % n")
def s16(spark: SparkSession, d: str) -> DataFrame:
    """A value of every enumeration for each part, by its code."""
    e = dims.enums(spark).withColumn("n", F.count("*").over(W.partitionBy("enum")))
    return table(spark, d, "part").select("p_partkey").join(e, F.col("code") == F.col("p_partkey") % F.col("n")).select("p_partkey", "enum", "code", "name")


@register("s16_recipes", "SELECT doc_id, concat('IMG_', doc_id, '.', suffix) AS file, recipe, format, space, quality, longest FROM documents JOIN (VALUES (0, 'recipe_print_16bit', 'TIFF16', 'AdobeRGB', NULL, 0, 'tif'), (1, 'recipe_web_webp', 'WebP', 'sRGB', 95, 0, 'webp'), (2, 'recipe_sns_jpeg', 'JPEG', 'sRGB', 92, 2048, 'jpg')) v(ord, recipe, format, space, quality, longest, suffix) ON ord = doc_id % 3")
def s16_recipes(spark: SparkSession, d: str) -> DataFrame:
    """The file that an export recipe gives for each document."""
    r = dims.export_recipes(spark)
    joined = table(spark, d, "documents").select("doc_id").join(r, F.col("ord") == F.col("doc_id") % 3)
    return joined.select("doc_id", F.concat(F.lit("IMG_"), F.col("doc_id").cast("string"), F.lit("."), catalog.file_type(F.col("format"))[0]).alias("file"), "recipe", "format", "space", "quality", "longest")


@register("s16_brands", "SELECT s_suppkey, brand, camera, microseconds, iso, battery FROM supplier JOIN (VALUES (0, 'Sony', 'ILCE-7RM5', 4000, 100, 94), (1, 'Canon', 'EOS R5 Mark II', 3125, 100, 88), (2, 'Nikon', 'Z 8', 5000, 64, 91), (3, 'Fujifilm', 'GFX100 II', 6250, 80, 85), (4, 'Panasonic', 'LUMIX S1R', 4000, 100, 79)) v(ord, brand, camera, microseconds, iso, battery) ON ord = s_suppkey % 5")
def s16_brands(spark: SparkSession, d: str) -> DataFrame:
    """The settings that a supplier's camera starts with."""
    s = table(spark, d, "supplier").select("s_suppkey").join(dims.brands(spark), F.col("ord") == F.col("s_suppkey") % 5)
    return s.select("s_suppkey", "brand", "camera", F.round(F.col("exposure_time") * 1e6).cast("int").alias("microseconds"), "iso", "battery")


@register("j02_lens_profile", "WITH l AS (" + " UNION ALL ".join(f"SELECT {i} AS ord, '{r[0]}' AS mk, '{r[1]}' AS md, {r[3]}e0 AS lo, {r[4]}e0 AS hi" for i, r in enumerate(dims.LENSES)) + "), s AS (SELECT s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN 'Sony' WHEN 1 THEN 'Canon' WHEN 2 THEN 'Sig' ELSE '' END AS make, CASE s_suppkey % 5 WHEN 0 THEN 'XCD 45mm F4 P' WHEN 1 THEN '70mm F2.8' ELSE '' END AS lens, CAST(s_suppkey % 100 AS DOUBLE) AS focal FROM supplier), m AS (SELECT id, ord, md, CASE WHEN lens <> '' AND (contains(md, lens) OR contains(lens, md)) THEN 0 WHEN make <> '' AND contains(mk, make) AND (focal <= 0 OR focal BETWEEN lo AND hi) THEN 1 WHEN ord = 0 THEN 2 END AS tier FROM s, l) SELECT id, tier, md AS lens_model FROM m WHERE tier IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY tier, ord) = 1")
def j02(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").selectExpr("s_suppkey AS id", "CASE s_suppkey % 4 WHEN 0 THEN 'Sony' WHEN 1 THEN 'Canon' WHEN 2 THEN 'Sig' ELSE '' END AS make", "CASE s_suppkey % 5 WHEN 0 THEN 'XCD 45mm F4 P' WHEN 1 THEN '70mm F2.8' ELSE '' END AS lens", "CAST(s_suppkey % 100 AS DOUBLE) AS focal")
    return calibrate.find_lens(s, dims.lenses(spark))


@register("j07_enrich", f"SELECT s.uri, CASE WHEN c.rating > 0 THEN c.rating ELSE s.rating END AS rating, CASE WHEN c.pick_status <> 'NONE' THEN c.pick_status ELSE s.pick_status END AS pick_status, CASE WHEN c.capture_date <> '' AND s.capture_date = '' THEN c.capture_date ELSE s.capture_date END AS capture_date FROM (SELECT 'content://' || doc_id AS uri, 1 AS rating, 'OLD' AS pick_status, CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'd' END AS capture_date FROM documents) s LEFT JOIN {CATALOG} c USING (uri)")
def j07(spark: SparkSession, d: str) -> DataFrame:
    shots = table(spark, d, "documents").selectExpr("concat('content://', doc_id) AS uri", "1 AS rating", "'OLD' AS pick_status", "CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'd' END AS capture_date")
    return catalog.enrich(shots, catalog_view(spark, d).select("uri", "rating", "pick_status", "capture_date"))


@register("j08_append_new", "SELECT c_custkey AS id, 'old' AS origin FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT o_custkey, 'new' FROM (SELECT DISTINCT o_custkey FROM orders) WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0)")
def j08(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "customer").where("c_custkey % 3 = 0").selectExpr("c_custkey AS id", "'old' AS origin")
    return catalog.append_new(old, table(spark, d, "orders").selectExpr("o_custkey AS id", "'new' AS origin"), "id")


PRESET = {"exposure_ev": 0.8, "kelvin": 5650.0, "contrast": 12.0, "sharpening": 40.0}


@register("p35_preset_blend", "SELECT p_partkey, " + ", ".join(f"round({catalog.preset_blend(b, num(PRESET[k]), k, 150)}, 6) AS {k}" for k, b in (("exposure_ev", "(p_size / 10e0 - 2e0)"), ("kelvin", "(p_size * 250e0)"), ("contrast", "(p_size * 2e0)"), ("sharpening", "(p_size * 3e0)"))) + " FROM part")
def p35(spark: SparkSession, d: str) -> DataFrame:
    base = {"exposure_ev": "(p_size / 10e0 - 2e0)", "kelvin": "(p_size * 250e0)", "contrast": "(p_size * 2e0)", "sharpening": "(p_size * 3e0)"}
    return table(spark, d, "part").select("p_partkey", *[F.round(F.expr(catalog.preset_blend(b, num(PRESET[k]), k, 150)), 6).alias(k) for k, b in base.items()])


@register("j09_batch_sync", "SELECT p_partkey, 7200e0 AS kelvin, 22e0 AS tint, p_size / 10e0 AS exposure_ev, p_size AS rating, 60e0 AS luminance_nr FROM part")
def j09(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "part").selectExpr("p_partkey", "5000e0 AS kelvin", "0e0 AS tint", "p_size / 10e0 AS exposure_ev", "p_size AS rating", "10e0 AS luminance_nr")
    s = spark.createDataFrame([(7200.0, 22.0, 1.25, 5, 60.0)], "kelvin double, tint double, exposure_ev double, rating int, luminance_nr double")
    return catalog.batch_sync(t, s, 1 | 8)


@register("j10_recipes", f"SELECT doc_id, f AS format, CASE f WHEN 'TIFF16' THEN 'tif' WHEN 'WebP' THEN 'webp' ELSE 'jpg' END AS suffix FROM {CATALOG}, (SELECT unnest(['TIFF16', 'WebP', 'JPEG']) AS f)")
def j10(spark: SparkSession, d: str) -> DataFrame:
    t = spark.createDataFrame([("TIFF16",), ("WebP",), ("JPEG",)], "format string")
    return catalog.recipes(catalog_view(spark, d).select("doc_id"), t).select("doc_id", "format", "suffix")


@register("k10_save_entries", f"SELECT uri, name, capture_date, last_edited_at FROM (SELECT uri, CASE WHEN doc_id % 2 = 0 THEN name ELSE 'renamed' END AS name, capture_date, doc_id * 2 + 1 AS last_edited_at FROM {CATALOG} WHERE doc_id % 4 < 2 UNION ALL SELECT uri, name, capture_date, doc_id * 2 FROM {CATALOG} WHERE doc_id % 4 >= 2) ORDER BY last_edited_at DESC, uri LIMIT 50")
def k10(spark: SparkSession, d: str) -> DataFrame:
    v = catalog_view(spark, d)
    old = v.selectExpr("uri", "name", "capture_date", "doc_id * 2 AS last_edited_at")
    new = v.where("doc_id % 4 < 2").selectExpr("uri", "CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'renamed' END AS name", "'' AS capture_date", "doc_id * 2 + 1 AS last_edited_at")
    return catalog.save_entries(old, new)


@register("t04_trim", f"SELECT doc_id, bytes FROM (SELECT doc_id, bytes, coalesce(sum(bytes) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed, sum(bytes) OVER () AS total FROM {CATALOG}) WHERE total > 500000 AND total - freed > 400000")
def t04(spark: SparkSession, d: str) -> DataFrame:
    return catalog.trim_oldest(catalog_view(spark, d).select("doc_id", F.col("doc_id").alias("modified"), "name", "bytes"), 500000, groups=4).select("doc_id", "bytes")


@register("t07_collection_tab", f"SELECT doc_id, CASE WHEN rating > 0 THEN 'recent' ELSE 'device' END AS tab FROM {CATALOG}")
def t07(spark: SparkSession, d: str) -> DataFrame:
    return catalog_view(spark, d).select("doc_id", F.when(F.col("rating") > 0, "recent").otherwise("device").alias("tab"))


@register("f14_category", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'LANDSCAPE' WHEN 1 THEN 'FILM' WHEN 2 THEN 'PORTRAIT' ELSE 'OTHER' END AS category FROM documents")
def f14(spark: SparkSession, d: str) -> DataFrame:
    shown = F.element_at(F.array(*map(F.lit, ("風景", "フィルム", " portrait ", "other"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", catalog.category_name(shown).alias("category"))


@register("f15_selection", f"SELECT c.doc_id FROM {CATALOG} c WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND doc_id <> 3")
def f15(spark: SparkSession, d: str) -> DataFrame:
    return catalog_view(spark, d).join(table(spark, d, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi").where("doc_id <> 3").select("doc_id")


# streams (2.10)
@register("x01_packets", "SELECT event_id, CAST(12 + event_id % 5 AS BIGINT) AS length, 4 AS type, 16386 AS code, event_id AS tx, CAST(event_id % 5 AS BIGINT) AS payload_bytes FROM events")
def x01(spark: SparkSession, d: str) -> DataFrame:
    le = lambda v, n: F.concat(*[F.lpad(F.hex(F.shiftright(v, 8 * i).bitwiseAND(F.lit(255))), 2, "0") for i in range(n)])
    e = F.col("event_id")
    packet = F.unhex(F.concat(le(12 + e % 5, 4), le(F.lit(4).cast("long"), 2), le(F.lit(16386).cast("long"), 2), le(e, 4), F.repeat(F.lit("00"), (e % 5).cast("int"))))
    return tether.parse_packets(table(spark, d, "events").select("event_id", packet.alias("packet"))).selectExpr("event_id", "length", "CAST(type AS INT) AS type", "CAST(code AS INT) AS code", "tx", "payload_bytes")


EVENTS = "(SELECT user_id AS device, ts, CASE event_id % 6 WHEN 0 THEN 'connect' WHEN 1 THEN 'opened' WHEN 2 THEN 'transfer' WHEN 3 THEN 'received' WHEN 4 THEN 'developed' ELSE 'disconnect' END AS event FROM events)"


def session_events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").selectExpr("user_id AS device", "CAST(ts AS TIMESTAMP) AS ts", "event_id", "value", "CASE event_id % 6 WHEN 0 THEN 'connect' WHEN 1 THEN 'opened' WHEN 2 THEN 'transfer' WHEN 3 THEN 'received' WHEN 4 THEN 'developed' ELSE 'disconnect' END AS event")


@register("x02_sessions", f"""WITH RECURSIVE n AS (SELECT *, row_number() OVER (PARTITION BY device ORDER BY ts, event) AS k FROM {EVENTS}), s AS (
  SELECT device, CAST(0 AS BIGINT) AS k, CAST(NULL AS TIMESTAMP) AS ts, '' AS event, 'disconnected' AS state FROM (SELECT DISTINCT device FROM n)
  UNION ALL
  SELECT n.device, n.k, n.ts, n.event, CASE WHEN n.event = 'disconnect' THEN 'disconnected' WHEN n.event = 'connect' AND state = 'disconnected' THEN 'connecting' WHEN n.event = 'opened' AND state = 'connecting' THEN 'connected'
    WHEN n.event = 'transfer' AND state IN ('connected', 'ready') THEN 'transferring' WHEN n.event = 'received' AND state = 'transferring' THEN 'processing' WHEN n.event = 'developed' AND state = 'processing' THEN 'ready' ELSE state END
  FROM s JOIN n ON n.device = s.device AND n.k = s.k + 1)
SELECT CAST(device AS VARCHAR) AS device, ts, event, state FROM s WHERE k > 0""")
def x02(spark: SparkSession, d: str) -> DataFrame:
    return tether.sessions(session_events(spark, d).withColumn("device", F.col("device").cast("string")).select("device", "ts", "event"))


@register("x03_latest_settings", "SELECT user_id AS device, event_type AS name, max_by(value, ts) AS value FROM events GROUP BY ALL")
def x03(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").selectExpr("user_id AS device", "event_type AS name", "ts", "value")
    return tether.latest_settings(e).select("device", "name", "value")


@register("x04_transfers", f"SELECT device, tx, round(epoch(max(ts) FILTER (event = 'developed')) - epoch(min(ts) FILTER (event = 'transfer')), 3) AS seconds FROM (SELECT *, 1 AS tx FROM {EVENTS}) GROUP BY device, tx HAVING max(ts) FILTER (event = 'developed') IS NOT NULL AND min(ts) FILTER (event = 'transfer') IS NOT NULL")
def x04(spark: SparkSession, d: str) -> DataFrame:
    return tether.transfers(session_events(spark, d).withColumns({"tx": F.lit(1), "payload_bytes": F.lit(0)})).select("device", "tx", F.round("seconds", 3).alias("seconds"))


@register("x05_debounce", "SELECT file, max_by(value, ts) AS value, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY file ORDER BY ts) AS burst FROM (SELECT user_id AS file, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY file, burst")
def x05(spark: SparkSession, d: str) -> DataFrame:
    return tether.debounced(session_events(spark, d).selectExpr("device AS file", "ts", "value"), "6 hours").select("file", "value", "n")


@register("x06_throttle", """WITH RECURSIVE e AS (SELECT DISTINCT user_id AS device, epoch_us(ts) / 1000e0 AS ts_ms FROM events), p AS (
  SELECT device, min(ts_ms) AS ts_ms FROM e GROUP BY device
  UNION ALL
  SELECT * FROM (SELECT p.device, (SELECT min(ts_ms) FROM e WHERE e.device = p.device AND e.ts_ms >= p.ts_ms + 3.6e6) AS ts_ms FROM p) WHERE ts_ms IS NOT NULL)
SELECT * FROM p""")
def x06(spark: SparkSession, d: str) -> DataFrame:
    return tether.throttled(session_events(spark, d).selectExpr("device", "CAST(unix_micros(ts) AS DOUBLE) / 1000e0 AS ts_ms"), 3.6e6)


@register("x07_progress", "SELECT frame_id, tile, round(row_number() OVER (PARTITION BY frame_id ORDER BY tile) / (count(*) OVER (PARTITION BY frame_id))::DOUBLE, 6) AS done FROM (SELECT user_id AS frame_id, event_id AS tile FROM events)")
def x07(spark: SparkSession, d: str) -> DataFrame:
    return tether.progress(table(spark, d, "events").selectExpr("user_id AS frame_id", "event_id AS tile")).select("frame_id", "tile", F.round("done", 6).alias("done"))


@register("x08_windowed_counts", "SELECT strftime(time_bucket(INTERVAL 10 MINUTES, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def x08(spark: SparkSession, d: str) -> DataFrame:
    return tether.windowed_counts(table(spark, d, "events")).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The RGB histogram of a developed, encoded frame."""
    layers = [*develop.white_balance(6200), *develop.exposure(0.5), *develop.shadows(20), c.eight_bit("srgb")]
    return scopes.histogram(apply(pixels(spark, sf_dir), layers), WIDTH, height(spark, sf_dir))


register("flagship", f"SELECT channel, v AS bin, count(*) AS n FROM (SELECT unnest(['r', 'g', 'b']) AS channel, unnest([r8, g8, b8]) AS v FROM ({sql(PIXELS, PIXEL_COLUMNS, [*develop.white_balance(6200), *develop.exposure(0.5), *develop.shadows(20), c.eight_bit('srgb', DUCK)], '*')}) WHERE y % greatest(1, {HEIGHT} // 512) = 0) GROUP BY ALL")(flagship)


CUBE = [((x / 4) ** 0.9, (y / 4) ** 1.1, 0.1 + 0.8 * z / 4) for z in range(5) for y in range(5) for x in range(5)]
pixelwise("p25_lut3d", lambda d, h: develop.lut3d(CUBE, 5, 0.7, d))


@register("s05_tile", f"SELECT x, y, x - 6 AS tx, y - 4 AS ty, round(r, 6) AS r FROM {PIXELS} WHERE x BETWEEN 6 AND 33 AND y BETWEEN 4 AND 23")
def s05(spark: SparkSession, d: str) -> DataFrame:
    from rasterloom.sources.images import tile

    return tile(pixels(spark, d), 10, 8, 20, 12, 4, WIDTH, height(spark, d)).selectExpr("x", "y", "tx", "ty", "round(r, 6) AS r")


@register("s05_halo_tiles", f"SELECT tile_x, tile_y, count(*) AS n FROM (SELECT unnest(range(greatest((x - 4) // 16, 0), (x + 4) // 16 + 1)) AS tile_x, y FROM {PIXELS}) t, LATERAL (SELECT unnest(range(greatest((y - 4) // 16, 0), (y + 4) // 16 + 1)) AS tile_y) u GROUP BY ALL")
def s05_halo(spark: SparkSession, d: str) -> DataFrame:
    from rasterloom.sources.images import halo_tiles

    return halo_tiles(pixels(spark, d), 16, 4).groupBy("tile_x", "tile_y").agg(F.count(F.lit(1)).alias("n"))


@register("s03_tiff_round_trip")
def s03(spark: SparkSession, d: str) -> DataFrame:
    """Frames of 16-bit values encoded, decoded again and compared."""
    import pandas as pd

    from rasterloom.sources.images import TIFF_LINES, decode_tiff, encode_frames

    q = apply(pixels(spark, d), [{f"{k}8": c.quantise(SPARK, c.encode(k), i, 16) for i, k in enumerate("rgb")}])

    def check(parts):
        for part in parts:
            yield pd.DataFrame({"frame_id": part["frame_id"], "width": part["width"], "height": part["height"], "level_sum": [int((decode_tiff(x) * 65535).round().sum()) for x in part["data"]]})

    bands = encode_frames(q, "tiff16", lines=TIFF_LINES).mapInPandas(check, "frame_id int, width int, height int, level_sum long")
    return bands.groupBy("frame_id").agg(F.max("width").alias("width"), F.sum("height").cast("int").alias("height"), F.sum("level_sum").alias("level_sum"))


SQL["s03_tiff_round_trip"] = f"SELECT frame_id, CAST(max(x) + 1 AS INTEGER) AS width, CAST(max(y) + 1 AS INTEGER) AS height, CAST(sum(qr + qg + qb) AS BIGINT) AS level_sum FROM ({sql(PIXELS, PIXEL_COLUMNS, [{f'q{k}': c.quantise(DUCK, c.encode(k), i, 16) for i, k in enumerate('rgb')}], '*')}) GROUP BY frame_id"


@register("k01_jpeg")
def k01(spark: SparkSession, d: str) -> DataFrame:
    """Frames as JPEG files; a frame that is taller than a JPEG can be is several, one below the other, counted together."""
    from rasterloom.sources.images import JPEG_LINES, encode_frames

    bands = encode_frames(px8(spark, d), "jpeg", 90, lines=JPEG_LINES).select("frame_id", "width", "height", F.octet_length("data").alias("n_bytes"), F.hex(F.substring("data", 1, 2)).alias("mark"))
    return bands.groupBy("frame_id").agg(F.max("width").alias("width"), F.sum("height").cast("int").alias("height"), F.sum("n_bytes").cast("int").alias("n_bytes"), F.min("mark").alias("mark"))


_glyphs = "VALUES (0, [127, 9, 25, 41, 70]), (1, [126, 17, 17, 17, 126]), (2, [70, 73, 73, 73, 49]), (3, [1, 1, 127, 1, 1])"
_ink = f"(SELECT 20 + 7 * i + c AS x, {HEIGHT} + (tall - 7) // 2 + b AS y FROM (SELECT i, unnest(bits) AS bits, unnest(range(5)) AS c FROM ({_glyphs}) v(i, bits)), range(7) r(b), tall WHERE (bits >> b) & 1 = 1 AND 20 + 7 * i + c < 50)"


@register("k06_watermark", f"""
WITH tall AS MATERIALIZED (SELECT greatest(60, CAST(floor({HEIGHT} * 0.08e0) AS BIGINT)) AS tall),
margin AS (SELECT i % 50 AS x, {HEIGHT} + i // 50 AS y FROM tall, LATERAL (SELECT unnest(range(50 * tall)) AS i))
SELECT x, y, CAST(r8 AS INTEGER) AS r8, CAST(g8 AS INTEGER) AS g8, CAST(b8 AS INTEGER) AS b8 FROM ({PX8})
UNION ALL SELECT m.x, m.y, CASE WHEN k.x IS NULL THEN 15 ELSE 229 END, CASE WHEN k.x IS NULL THEN 15 ELSE 229 END, CASE WHEN k.x IS NULL THEN 18 ELSE 234 END FROM margin m LEFT JOIN {_ink} k ON k.x = m.x AND k.y = m.y""")
def k06(spark: SparkSession, d: str) -> DataFrame:
    from rasterloom.sources.images import watermark

    return watermark(px8(spark, d), WIDTH, height(spark, d), "RAST").select("x", "y", *E8)


@register("s04_synthetic", "SELECT frame_id, x, y, " + ", ".join(f"round({e}, 6) AS {k}" for k, e in synthetic_colours(96, 64, DUCK).items()) + " FROM (SELECT r_regionkey AS frame_id, r_regionkey / 100e0 AS grain FROM region), range(96) a(x), range(64) b(y)")
def s04(spark: SparkSession, d: str) -> DataFrame:
    """A generated frame for each region, with its own grain."""
    frames = table(spark, d, "region").selectExpr("r_regionkey AS frame_id", "r_regionkey / 100e0 AS grain")
    return synthetic_frames(frames, 96, 64).selectExpr(*rounded(keys=("frame_id", "x", "y")))


# further queries register themselves
from rasterloom.plans import align_queries, exif_queries, history_queries, json_queries, mask_queries  # noqa: E402, F401

mask_queries._register(SOBEL)
