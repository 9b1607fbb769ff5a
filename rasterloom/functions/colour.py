"""Colour formulas: luma, HSL, transfer functions, dither, CIE Lab, CIEDE2000, exposure zones."""

from __future__ import annotations

import math

from rasterloom.functions.dialect import Dialect, Layer, clamp, num

# Rec.709 luma weights.
LUMA = (0.2126, 0.7152, 0.0722)


def luma(r: str = "r", g: str = "g", b: str = "b") -> str:
    return f"({num(LUMA[0])} * {r} + {num(LUMA[1])} * {g} + {num(LUMA[2])} * {b})"


def to_hsl(r: str = "r", g: str = "g", b: str = "b") -> list[Layer]:
    """Columns h (degrees), s, l of linear colours; values above 1 are allowed, below 0 count as 0."""
    return [
        {"_r": f"greatest(0e0, {r})", "_g": f"greatest(0e0, {g})", "_b": f"greatest(0e0, {b})"},
        {"_hi": "greatest(_r, _g, _b)", "_lo": "least(_r, _g, _b)"},
        {"_d": "_hi - _lo", "l": "(_hi + _lo) * 0.5e0"},
        {
            "s": "CASE WHEN _d < 1e-6 OR _hi < 1e-6 THEN 0e0 WHEN l < 0.5e0 THEN "
            + clamp("_d / greatest(_hi + _lo, 1e-5)", 0, 1)
            + " WHEN 2e0 - _hi - _lo <= 1e-5 THEN "
            + clamp("_d / greatest(_hi, 1e-5)", 0, 1)
            + " ELSE "
            + clamp("_d / (2e0 - _hi - _lo)", 0, 1)
            + " END",
            "h": "60e0 * CASE WHEN _d < 1e-6 OR _hi < 1e-6 THEN 0e0 WHEN _r = _hi THEN (_g - _b) / _d + CASE WHEN _g < _b THEN 6e0 ELSE 0e0 END "
            "WHEN _g = _hi THEN (_b - _r) / _d + 2e0 ELSE (_r - _g) / _d + 4e0 END",
        },
    ]


def from_hsl(h: str = "h", s: str = "s", l: str = "l") -> list[Layer]:
    """Columns r, g, b of a hue in degrees, saturation and lightness."""

    def channel(shift: float) -> str:
        t = f"({h} / 360e0 + {num(shift)})"
        t = f"(CASE WHEN {t} < 0e0 THEN {t} + 1e0 WHEN {t} > 1e0 THEN {t} - 1e0 ELSE {t} END)"
        return f"CASE WHEN {s} < 1e-6 THEN {l} WHEN {t} < {num(1 / 6)} THEN _p + (_q - _p) * 6e0 * {t} WHEN {t} < 0.5e0 THEN _q WHEN {t} < {num(2 / 3)} THEN _p + (_q - _p) * ({num(2 / 3)} - {t}) * 6e0 ELSE _p END"

    return [{"_q": f"CASE WHEN {l} < 0.5e0 THEN {l} * (1e0 + {s}) ELSE {l} + {s} - {l} * {s} END"}, {"_p": f"2e0 * {l} - _q"}, {"r": channel(1 / 3), "g": channel(0), "b": channel(-1 / 3)}]


def angle_between(a: str, b: str) -> str:
    """Circular distance of two hues, 0 to 180."""
    return f"least(abs({a} - {b}), 360e0 - abs({a} - {b}))"


def wrap_hue(h: str) -> str:
    return f"((({h}) % 360e0 + 360e0) % 360e0)"


def encode(c: str, space: str = "srgb") -> str:
    """The transfer function of an output space: linear, adobe, or srgb (Display P3 has the same)."""
    if space == "linear":
        return f"CASE WHEN {c} <= 0e0 THEN 0e0 ELSE {c} END"
    if space == "adobe":
        return f"CASE WHEN {c} <= 0e0 THEN 0e0 ELSE pow({c}, {num(1 / 2.19921875)}) END"
    return f"CASE WHEN {c} <= 0e0 THEN 0e0 WHEN {c} <= 0.0031308e0 THEN {c} * 12.92e0 ELSE 1.055e0 * pow({c}, {num(1 / 2.4)}) - 0.055e0 END"


WORD = 4294967295  # 32-bit wrap-around


def noise(d: Dialect, x: str, y: str, seed: int) -> str:
    """A fixed pseudo-random value in [0, 1) of a pixel: a 32-bit hash in wrap-around arithmetic."""
    # The hash's multipliers.
    h = f"((CAST({x} AS BIGINT) * 374761393 + CAST({y} AS BIGINT) * 668265263 + {seed * 3628273133 & WORD}) & {WORD})"
    h = f"((({d.xor(h, d.shr(h, 13))}) * 1274126177) & {WORD})"
    return f"(CAST({d.xor(h, d.shr(h, 16))} AS DOUBLE) / 4294967296e0)"


def quantise(d: Dialect, c: str, channel: int, bits: int = 8, dither: bool = True, x: str = "x", y: str = "y") -> str:
    """An encoded value as an integer, with triangular dither of one step that depends on the global pixel only."""
    top = (1 << bits) - 1
    grain = f" + ({noise(d, x, y, 2 * channel + 101)} - {noise(d, x, y, 2 * channel + 202)})" if dither else ""
    return f"CAST({clamp(f'round(({c}) * {num(top)}{grain})', 0, top)} AS INT)"


# sRGB to XYZ and back, D65 white.
TO_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
FROM_XYZ = ((3.2404542, -1.5371385, -0.4985314), (-0.9692660, 1.8760108, 0.0415560), (0.0556434, -0.2040259, 1.0572252))
WHITE = (0.95047, 1.0, 1.08883)


def to_lab(r: str = "r", g: str = "g", b: str = "b", out: tuple[str, str, str] = ("lab_l", "lab_a", "lab_b")) -> list[Layer]:
    """CIE Lab of linear values, clamped to 0..1 first."""
    d = 6 / 29
    xyz = {f"_{n}": "(" + " + ".join(f"{num(w)} * {c}" for w, c in zip(row, ("_r", "_g", "_b"))) + f") / {num(white)}" for n, row, white in zip("xyz", TO_XYZ, WHITE)}
    f = {f"_f{n}": f"CASE WHEN _{n} > {num(d**3)} THEN cbrt(_{n}) ELSE _{n} / {num(3 * d * d)} + {num(4 / 29)} END" for n in "xyz"}
    return [{"_r": clamp(r, 0, 1), "_g": clamp(g, 0, 1), "_b": clamp(b, 0, 1)}, {f"{k}w": v for k, v in xyz.items()}, {k: v.replace("_x", "_xw").replace("_y", "_yw").replace("_z", "_zw") for k, v in f.items()}, {out[0]: "116e0 * _fy - 16e0", out[1]: "500e0 * (_fx - _fy)", out[2]: "200e0 * (_fy - _fz)"}]


def from_lab(lab: tuple[str, str, str] = ("lab_l", "lab_a", "lab_b")) -> list[Layer]:
    d = 6 / 29
    back = lambda t, w: f"{num(w)} * CASE WHEN {t} > {num(d)} THEN {t} * {t} * {t} ELSE {num(3 * d * d)} * ({t} - {num(4 / 29)}) END"
    return [
        {"_fy": f"({lab[0]} + 16e0) / 116e0"},
        {"_fx": f"{lab[1]} / 500e0 + _fy", "_fz": f"_fy - {lab[2]} / 200e0"},
        {"_xw": back("_fx", WHITE[0]), "_yw": back("_fy", WHITE[1]), "_zw": back("_fz", WHITE[2])},
        {c: clamp(" + ".join(f"{num(w)} * {v}" for w, v in zip(row, ("_xw", "_yw", "_zw"))), 0, 1) for c, row in zip("rgb", FROM_XYZ)},
    ]


def delta_e00(one: tuple[str, str, str], two: tuple[str, str, str], out: str = "delta_e") -> list[Layer]:
    """CIEDE2000 colour difference, staged so that nothing is computed twice."""
    pi, (l1, a1, b1), (l2, a2, b2) = math.pi, one, two
    turn = f"{num(2 * pi)}"
    big = "6103515625e0"  # 25**7
    rad = lambda x: num(math.radians(x))
    return [
        {"_c": f"(sqrt({a1} * {a1} + {b1} * {b1}) + sqrt({a2} * {a2} + {b2} * {b2})) * 0.5e0"},
        {"_gg": f"0.5e0 * (1e0 - sqrt(pow(_c, 7e0) / (pow(_c, 7e0) + {big})))"},
        {"_a1": f"(1e0 + _gg) * {a1}", "_a2": f"(1e0 + _gg) * {a2}"},
        {"_c1": f"sqrt(_a1 * _a1 + {b1} * {b1})", "_c2": f"sqrt(_a2 * _a2 + {b2} * {b2})", "_h1": f"atan2({b1}, _a1)", "_h2": f"atan2({b2}, _a2)"},
        {"_h1": f"CASE WHEN _h1 < 0e0 THEN _h1 + {turn} ELSE _h1 END", "_h2": f"CASE WHEN _h2 < 0e0 THEN _h2 + {turn} ELSE _h2 END"},
        {
            "_dh": f"CASE WHEN _c1 * _c2 <= 1e-6 THEN 0e0 WHEN abs(_h2 - _h1) <= {num(pi)} THEN _h2 - _h1 WHEN _h2 - _h1 > {num(pi)} THEN _h2 - _h1 - {turn} ELSE _h2 - _h1 + {turn} END",
            "_hm": f"CASE WHEN _c1 * _c2 <= 1e-6 THEN 0e0 WHEN abs(_h1 - _h2) <= {num(pi)} THEN (_h1 + _h2) * 0.5e0 WHEN _h1 + _h2 < {turn} THEN (_h1 + _h2 + {turn}) * 0.5e0 ELSE (_h1 + _h2 - {turn}) * 0.5e0 END",
            "_cm": "(_c1 + _c2) * 0.5e0",
            "_lm": f"pow(({l1} + {l2}) * 0.5e0 - 50e0, 2e0)",
        },
        {
            "_tt": f"1e0 - 0.17e0 * cos(_hm - {rad(30)}) + 0.24e0 * cos(2e0 * _hm) + 0.32e0 * cos(3e0 * _hm + {rad(6)}) - 0.2e0 * cos(4e0 * _hm - {rad(63)})",
            "_rt": f"-sin(2e0 * {rad(30)} * exp(-pow((_hm * {num(180 / pi)} - 275e0) / 25e0, 2e0))) * 2e0 * sqrt(pow(_cm, 7e0) / (pow(_cm, 7e0) + {big}))",
        },
        {"_tl": f"({l2} - {l1}) / (1e0 + 0.015e0 * _lm / sqrt(20e0 + _lm))", "_tc": "(_c2 - _c1) / (1e0 + 0.045e0 * _cm)", "_th": "2e0 * sqrt(_c1 * _c2) * sin(_dh * 0.5e0) / (1e0 + 0.015e0 * _cm * _tt)"},
        {out: "sqrt(greatest(0e0, _tl * _tl + _tc * _tc + _th * _th + _rt * _tc * _th))"},
    ]


def ire(r: str = "r", g: str = "g", b: str = "b") -> str:
    """Exposure level: encoded luma as a percentage, from 0 to 100; 0 for what is no number."""
    return f"(CASE WHEN isnan({luma(r, g, b)}) THEN 0e0 ELSE {clamp(luma(r, g, b), 0, 1)} * 100e0 END)"


# Exposure zones as (upper bound, bound included, red, green, blue); the last has no bound.
ZONES = (
    (2.5, False, 0.35, 0.0, 0.55),
    (20.0, False, 0.0, 0.20, 0.80),
    (38.0, False, 0.0, 0.55, 0.65),
    (44.0, True, 0.0, 0.85, 0.15),
    (52.0, False, 0.45, 0.45, 0.45),
    (58.0, True, 1.0, 0.42, 0.71),
    (70.0, False, 0.65, 0.65, 0.45),
    (85.0, False, 0.95, 0.95, 0.15),
    (98.0, False, 1.0, 0.50, 0.0),
    (None, False, 1.0, 0.0, 0.0),
)


def false_colour(level: str = "ire") -> Layer:
    """r, g, b of the zone of an exposure level."""
    pick = lambda i: "CASE " + " ".join(f"WHEN {level} {'<=' if z[1] else '<'} {num(z[0])} THEN {num(z[i])}" for z in ZONES[:-1]) + f" ELSE {num(ZONES[-1][i])} END"
    return {"r": pick(2), "g": pick(3), "b": pick(4)}


def pack_argb(d: Dialect, a: str, r: str, g: str, b: str) -> str:
    """One number of four bytes."""
    byte = lambda x: f"CAST({x} AS BIGINT)"
    return f"({d.shl(byte(a), 24)} + {d.shl(byte(r), 16)} + {d.shl(byte(g), 8)} + {byte(b)})"


def unpack_argb(d: Dialect, v: str) -> Layer:
    return {"a8": f"({d.shr(v, 24)} & 255)", "r8": f"({d.shr(v, 16)} & 255)", "g8": f"({d.shr(v, 8)} & 255)", "b8": f"({v} & 255)"}


def eight_bit(space: str = "srgb", d: Dialect | None = None, dither: bool = False) -> Layer:
    """Encoded r, g, b as integers 0 to 255."""
    from rasterloom.functions.dialect import SPARK

    return {f"{c}8": quantise(d or SPARK, encode(c, space), k, 8, dither) for k, c in enumerate("rgb")}

