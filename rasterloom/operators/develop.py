"""Global development of linear pixels: each stage is a list of layers over columns r, g, b.

Stages that a neutral parameter leaves without effect are left out of the plan. ``develop`` puts them in their fixed order.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from rasterloom.functions.colour import angle_between, from_hsl, luma, to_hsl, wrap_hue
from rasterloom.functions.dialect import SPARK, Dialect, Layer, clamp, num, per_channel

# Centres of the eight hue bands (red, orange, yellow, green, aqua, blue, purple, magenta).
BANDS = (0.0, 30.0, 60.0, 120.0, 180.0, 240.0, 285.0, 330.0)
HALF_BAND = 45.0
LEAST = 1e-4


@dataclass(frozen=True)
class Params:
    """Development settings; neutral by default."""

    kelvin: float = 5500.0
    tint: float = 0.0
    shadow_tint: tuple[float, float, float] = (0.0, 0.0, 0.0)
    exposure_ev: float = 0.0
    dehaze: float = 0.0
    primary_hue: tuple[float, float, float] = (0.0, 0.0, 0.0)
    primary_saturation: tuple[float, float, float] = (0.0, 0.0, 0.0)
    highlights: float = 0.0
    shadows: float = 0.0
    contrast: float = 0.0
    whites: float = 0.0
    blacks: float = 0.0
    band_hue: tuple[float, ...] = (0.0,) * 8
    band_saturation: tuple[float, ...] = (0.0,) * 8
    band_luminance: tuple[float, ...] = (0.0,) * 8
    monochrome: bool = False
    mono_weights: tuple[float, ...] = (0.125,) * 8
    vibrance: float = 0.0
    saturation: float = 0.0
    tone_curve: tuple[float, ...] = field(default=())


def white_balance(kelvin: float, tint: float = 0.0) -> list[Layer]:
    """Gains of red and blue; green stays."""
    ratio = min(max(kelvin, 2000.0), 50000.0) / 5500.0
    green = max(0.01, 1.0 - tint * 0.005)
    return [{"r": f"r * {num(ratio**0.65 / green)}", "b": f"b * {num((1 / ratio) ** 0.85 / green)}"}]


def shadow_tint(r: float, g: float, b: float) -> list[Layer]:
    """A tint that fades with the square of brightness."""
    return [{"_w": f"pow(1e0 - {clamp(luma(), 0, 1)}, 2e0)"}, {c: f"{c} + _w * {num(v * 0.002)}" for c, v in zip("rgb", (r, g, b))}]


def exposure(ev: float) -> list[Layer]:
    """P3."""
    return [per_channel(lambda c: f"{c} * {num(2.0**ev)}")]


def dehaze(amount: float) -> list[Layer]:
    """Above 0 the veil is divided out, below 0 it is mixed in."""
    air = 0.95
    if amount > 0:
        f = amount * 0.01
        t = clamp("1e0 - 0.75e0 * least(r, g, b)", 0.15, 1)
        return [{"_t": f"1e0 + {num(f * 0.6)} * ({t} - 1e0)"}, per_channel(lambda c: f"greatest(0e0, {c} * {num(1 - f)} + (({c} - {num(air)}) / _t + {num(air)}) * {num(f)})")]
    h = -amount * 0.01 * 0.5
    return [per_channel(lambda c: f"{c} * {num(1 - h)} + {num(air * h)}")]


def primaries(hue: tuple[float, float, float], saturation: tuple[float, float, float]) -> list[Layer]:
    """P5: hue and saturation shifts with triangular weights of 120 degrees around red, green and blue."""
    near = lambda c: f"greatest(0e0, 1e0 - abs(h - {num(c)}) / 120e0)"
    weights = {"_w0": f"{near(0)} + {near(360)}", "_w1": near(120), "_w2": near(240)}
    shift = lambda v, k: "(" + " + ".join(f"_w{i} * {num(x)}" for i, x in enumerate(v)) + f") * {num(k)}"
    return [*to_hsl(), weights, {"h": wrap_hue(f"h + {shift(hue, 0.3)}"), "s": clamp(f"s * (1e0 + {shift(saturation, 0.01)})", 0, 1)}, *from_hsl()]


def highlights(amount: float) -> list[Layer]:
    """Values over 0.75 are compressed (below 0) or stretched (above 0)."""
    over = lambda c: f"({c} - 0.75e0)"
    if amount < 0:
        return [per_channel(lambda c: f"CASE WHEN {c} > 0.75e0 THEN 0.75e0 + {over(c)} / (1e0 + {over(c)} * {num(-amount * 0.015)}) ELSE {c} END")]
    return [per_channel(lambda c: f"CASE WHEN {c} > 0.75e0 THEN 0.75e0 + {over(c)} * {num(1 + amount * 0.005)} ELSE {c} END")]


def shadows(amount: float) -> list[Layer]:
    """P7."""
    return [{"_w": f"pow(1e0 - {clamp(luma(), 0, 1)}, 3e0) * {num(amount * 0.004)}"}, per_channel(lambda c: f"greatest(0e0, {c} + _w)")]


def contrast(amount: float) -> list[Layer]:
    """An S-curve around middle grey."""
    e, p = num(1 + amount * 0.006), 0.18
    low = lambda c: f"{num(p)} * pow({c} / {num(p)}, {e})"
    high = lambda c: f"greatest({num(p)}, 1e0 - {num(1 - p)} * pow(greatest(0e0, 1e0 - {c}) / {num(1 - p)}, {e}))"
    return [per_channel(lambda c: f"CASE WHEN {c} <= 0e0 THEN 0e0 WHEN {c} < {num(p)} THEN {low(c)} ELSE {high(c)} END")]


def levels(whites: float, blacks: float) -> list[Layer]:
    """P9."""
    return [per_channel(lambda c: f"greatest(0e0, {c} - {num(blacks * 0.0005)}) * {num(1 + whites * 0.005)}")]


def _band_weights() -> list[Layer]:
    """_w0.._w7 of hue h, zero from 45 degrees on, and their sum."""
    each = {f"_w{i}": f"CASE WHEN {angle_between('h', num(c))} < {num(HALF_BAND)} THEN cos({angle_between('h', num(c))} * {num(3.14159265 / 90)}) ELSE 0e0 END" for i, c in enumerate(BANDS)}
    return [each, {"_ws": " + ".join(each)}]


def _weighted(values: tuple[float, ...]) -> str:
    return "(" + (" + ".join(f"_w{i} * {num(v)}" for i, v in enumerate(values) if v) or "0e0") + ")"


def hue_bands(hue: tuple[float, ...], saturation: tuple[float, ...], luminance: tuple[float, ...]) -> list[Layer]:
    """P10: the weighted mean of the bands' shifts; pixels without colour stay. Leaves h, s, l."""
    on = "s > 1e-4 AND _ws > 1e-5"
    moved = {
        "_on": f"CASE WHEN {on} THEN 1 ELSE 0 END",
        "h": f"CASE WHEN {on} THEN {wrap_hue(f'h + {_weighted(hue)} / _ws')} ELSE h END",
        "s": f"CASE WHEN {on} THEN {clamp(f's * (1e0 + {_weighted(saturation)} / _ws * 0.01e0)', 0, 1)} ELSE s END",
        "l": f"CASE WHEN {on} THEN {clamp(f'l * (1e0 + {_weighted(luminance)} / _ws * 0.01e0)', 0, 1)} ELSE l END",
    }
    *steps, last = from_hsl()
    return [*to_hsl(), *_band_weights(), moved, *steps, {c: f"CASE WHEN _on = 1 THEN {v} ELSE {c} END" for c, v in last.items()}]


def monochrome(weights: tuple[float, ...]) -> list[Layer]:
    """Grey with a gain for each hue band."""
    gain = f"CASE WHEN _ws > 1e-5 THEN {_weighted(weights)} / _ws * 8e0 ELSE 1e0 END"
    return [*to_hsl(), *_band_weights(), {"_y": f"greatest(0e0, {luma()} * ({gain}))"}, per_channel(lambda c: "_y")]


def vibrance(amount: float, saturation: float = 0.0, hsl: bool = False) -> list[Layer]:
    """Dull colours gain most, skin tones (10 to 50 degrees) least. hsl: column h is there already."""
    first = [] if hsl else to_hsl()
    skin = "CASE WHEN h >= 10e0 AND h <= 50e0 THEN greatest(0e0, 1e0 - abs(h - 25e0) / 20e0) ELSE 0e0 END"
    sat = "CASE WHEN greatest(r, g, b) > 1e-5 THEN (greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b) ELSE 0e0 END"
    part = "(1e0 - _sat)" if amount > 0 else "_sat"
    return [*first, {"_y": luma(), "_skin": skin, "_sat": sat}, {"_k": f"(1e0 + {num(amount * 0.01)} * {part} * (1e0 - _skin * 0.85e0)) * {num(1 + saturation * 0.01)}"}, per_channel(lambda c: f"_y + ({c} - _y) * _k")]


def tone_curve(curve: tuple[float, ...], d: Dialect = SPARK) -> list[Layer]:
    """A table of 256 values with linear interpolation; of another length it does nothing."""
    if len(curve) != 256:
        return []
    at = lambda i: d.at("_lut", i)
    norm = lambda c: f"({clamp(c, 0, 1)} * 255e0)"
    low = lambda c: d.int_(norm(c))
    mix = lambda c: f"{at(f'{low(c)} + 1')} * (1e0 - ({norm(c)} - {low(c)})) + {at(f'least({low(c)} + 1, 255) + 1')} * ({norm(c)} - {low(c)})"
    return [{"_lut": d.array(num(v) for v in curve)}, per_channel(mix)]


def develop(p: Params, d: Dialect = SPARK) -> list[Layer]:
    """All stages that have an effect, in their order (retouching and masks follow as operators of their own)."""
    out = [*white_balance(p.kelvin, p.tint)]
    if any(p.shadow_tint):
        out += shadow_tint(*p.shadow_tint)
    if p.exposure_ev:
        out += exposure(p.exposure_ev)
    if abs(p.dehaze) > LEAST:
        out += dehaze(p.dehaze)
    if any(abs(v) > LEAST for v in (*p.primary_hue, *p.primary_saturation)):
        out += primaries(p.primary_hue, p.primary_saturation)
    if p.highlights:
        out += highlights(p.highlights)
    if abs(p.shadows) > LEAST:
        out += shadows(p.shadows)
    if abs(p.contrast) > LEAST:
        out += contrast(p.contrast)
    out += levels(p.whites, p.blacks)
    if p.monochrome:
        out += monochrome(p.mono_weights)
    else:
        bands = any((*p.band_hue, *p.band_saturation, *p.band_luminance))
        if bands:
            out += hue_bands(p.band_hue, p.band_saturation, p.band_luminance)
        if abs(p.vibrance) > LEAST or abs(p.saturation) > LEAST:
            out += vibrance(p.vibrance, p.saturation, hsl=bands)
    return out + tone_curve(p.tone_curve, d)


def preview_matrix(m: tuple[float, ...]) -> list[Layer]:
    """A 4 x 5 colour matrix on 8-bit values r8, g8, b8 (alpha 255), clamped."""
    row = lambda i: clamp(" + ".join(f"{num(m[5 * i + j])} * {c}" for j, c in enumerate(("r8", "g8", "b8", "255e0"))) + f" + {num(m[5 * i + 4])}", 0, 255)
    return [{"r8": row(0), "g8": row(1), "b8": row(2)}]


def concat_matrices(outer: tuple[float, ...], inner: tuple[float, ...]) -> tuple[float, ...]:
    """The matrix that applies inner, then outer."""
    full = lambda m: [list(m[5 * i : 5 * i + 5]) for i in range(4)] + [[0, 0, 0, 0, 1]]
    a, b = full(outer), full(inner)
    return tuple(sum(a[i][k] * b[k][j] for k in range(5)) for i in range(4) for j in range(5))


# Channel gains of the preview's colour profiles.
PROFILE_GAINS = {"cinetone": (1.04, 0.98, 0.94), "landscape": (0.96, 1.06, 1.12), "portrait": (1.08, 1.02, 0.96)}
REC709 = (0.2126, 0.7152, 0.0722)


@dataclass(frozen=True)
class Preview:
    """Settings that the preview's matrix stands for; amounts in percent, neutral by default."""

    exposure_ev: float = 0.0
    contrast: float = 0.0
    shadows: float = 0.0
    blacks: float = 0.0
    highlights: float = 0.0
    whites: float = 0.0
    kelvin: float = 5500.0
    tint: float = 0.0
    clarity: float = 0.0
    saturation: float = 0.0
    vibrance: float = 0.0
    profile: str = ""
    monochrome: bool = False
    mono_weights: tuple[float, ...] = ()


def exposure_matrix(p: Preview) -> tuple[float, ...]:
    """Gain, saturation, white balance and profile as one 4 x 5 matrix; the offset is the same for all channels."""
    bound = lambda x, lo, hi: min(max(x, lo), hi)
    steep = 1 + bound(p.contrast / 100, -0.95, 3)
    lift = 127.5 * (1 - steep) + 0.4 * (0.35 * (p.shadows + p.highlights) + 0.25 * (p.blacks + p.whites))
    gain = max(0.01, bound(2.0**p.exposure_ev, 0.05, 20) * steep * (1 + p.clarity / 250))
    if p.monochrome or p.profile == "monochrome":
        # red, green and blue stand at the bands 0, 3 and 5 of the mixer
        parts = [p.mono_weights[k] if k < len(p.mono_weights) else REC709[i] for i, k in enumerate((0, 3, 5))]
        row = (*(gain * x / max(0.001, sum(parts)) for x in parts), 0.0, lift)
        return (*row, *row, *row, 0.0, 0.0, 0.0, 1.0, 0.0)
    keep = max(0.0, 1 + (p.saturation + 0.75 * p.vibrance) / 100)
    warm, magenta = 0.45 * (p.kelvin / 5500 - 1), p.tint / 200
    balance = (bound(1 + warm, 0.2, 2.5) * bound(1 + magenta, 0.2, 2), bound(1 - magenta, 0.2, 2), bound(1 - warm, 0.2, 2.5))
    own = [b * g for b, g in zip(balance, PROFILE_GAINS.get(p.profile, (1.0, 1.0, 1.0)))]
    spill = [(1 - keep) * w for w in REC709]  # what each channel gives to the others
    rows = [(*(gain * ((spill[j] + keep) * own[j] if i == j else spill[j]) for j in range(3)), 0.0, lift) for i in range(3)]
    return (*rows[0], *rows[1], *rows[2], 0.0, 0.0, 0.0, 1.0, 0.0)


def preview_gain(ev: float, kelvin: float) -> list[Layer]:
    """8-bit values under exposure and a gain of red (warm) or blue (cold), cut off to whole numbers."""
    gain = {"r8": 1 + max(0.0, kelvin - 5500) / 10000, "g8": 1.0, "b8": 1 + max(0.0, 5500 - kelvin) / 7000}
    return [{c: f"CAST({clamp(f'floor({c} * {num(2.0**ev)} * {num(k)})', 0, 255)} AS INT)" for c, k in gain.items()}]


Wheel = tuple[float, float, float, float]


def colour_wheels(shadows: Wheel, midtones: Wheel, highlights: Wheel, overall: Wheel, balance: float = 0.0, blending: float = 0.5) -> list[Layer]:
    """Wheels (r, g, b, luminance) added by weights of the pixel's luma, around a middle that balance (-1 to 1) moves."""
    middle, wide = min(max(0.5 + 0.2 * balance, 0.15), 0.85), max(0.1, 0.4 * blending)
    low = clamp(f"1e0 - {luma()} / {num(middle + wide)}", 0, 1)
    high = clamp(f"({luma()} - {num(middle - wide)}) / {num(1 - (middle - wide))}", 0, 1)
    add = lambda i: " + ".join(f"{w} * {num(0.5 * wheel[i] + 0.2 * wheel[3])}" for w, wheel in (("_ws", shadows), ("_wm", midtones), ("_wh", highlights)))
    return [
        {"_ls": low, "_lh": high},
        {"_ws": "_ls * _ls", "_wh": "_lh * _lh"},
        {"_wm": "greatest(0e0, 1e0 - _ws - _wh)"},
        {c: f"greatest(0e0, {c} + {add(i)} + {num(0.3 * overall[i] + 0.15 * overall[3])})" for i, c in enumerate("rgb")},
    ]


def split_toning(shadow_hue: float, shadow_sat: float, high_hue: float, high_sat: float, balance: float = 0.0) -> list[Layer]:
    """Dark and bright pixels move towards pure hues of twice their luma. Hues and saturations from 0 to 1, balance from -1 to 1."""
    import colorsys

    if shadow_sat < LEAST and high_sat < LEAST:
        return []
    dark, bright = (colorsys.hls_to_rgb(h, 0.5, 1.0) for h in (shadow_hue, high_hue))
    pivot = min(max(0.5 + 0.25 * balance, 0.1), 0.9)
    first = f"{clamp(f'({num(pivot)} - _y) / {num(pivot)}', 0, 1)} * {num(0.5 * shadow_sat)}"
    then = f"{clamp(f'(_y - {num(pivot)}) / {num(1 - pivot)}', 0, 1)} * {num(0.5 * high_sat)}"
    mix = lambda w, hue: {c: f"{c} + {w} * ({num(2 * hue[i])} * _y - {c})" for i, c in enumerate("rgb")}
    return [{"_y": luma()}, {"_kd": first, "_kb": then}, mix("_kd", dark), mix("_kb", bright)]


@dataclass(frozen=True)
class Local:
    """Settings of a masked adjustment."""

    exposure_ev: float = 0.0
    kelvin: float = 0.0
    tint: float = 0.0
    contrast: float = 0.0
    highlights: float = 0.0
    shadows: float = 0.0
    whites: float = 0.0
    blacks: float = 0.0
    saturation: float = 0.0
    clarity: float = 0.0


def local_adjust(p: Local, w: str = "w") -> list[Layer]:
    """Adjustments in proportion to a weight; pixels with a weight up to 1e-5 stay."""
    out: list[Layer] = [{"_on": f"{w} > 1e-5"}]
    step = lambda make: out.append(per_channel(lambda c: f"CASE WHEN _on THEN {make(c)} ELSE {c} END"))
    step(lambda c: f"{c} * (1e0 + {num(2.0**p.exposure_ev - 1)} * {w})")
    if abs(p.kelvin) > 1 or abs(p.tint) > 0.01:
        k = {"r": f"(1e0 - {num(p.kelvin / 5000)} * {w})", "b": f"(1e0 + {num(p.kelvin / 5000)} * {w})", "g": f"(1e0 - {num(p.tint * 0.005)} * {w})"}
        step(lambda c: f"{c} * {k[c]}")
    if abs(p.contrast) > LEAST:
        step(lambda c: f"pow(greatest(0e0, {c} / 0.18e0), greatest(0.01e0, 1e0 + {num(p.contrast * 0.005)} * {w})) * 0.18e0")
    if abs(p.highlights) > LEAST:
        out.append({"_m": "greatest(r, g, b)"})
        out.append({"_k": f"CASE WHEN _on AND _m > 0.75e0 THEN (0.75e0 + (_m - 0.75e0) / greatest(0.01e0, 1e0 + (_m - 0.75e0) * abs({num(p.highlights * 0.008)} * {w}))) / _m ELSE 1e0 END"})
        out.append(per_channel(lambda c: f"{c} * _k"))
    if abs(p.shadows) > LEAST:
        out.append({"_y": f"pow(1e0 - {clamp(luma(), 0, 1)}, 3e0) * {num(p.shadows * 0.0035)} * {w}"})
        step(lambda c: f"greatest(0e0, {c} + _y)")
    if abs(p.whites) > LEAST or abs(p.blacks) > LEAST:
        step(lambda c: f"greatest(0e0, {c} - {num(p.blacks * 0.0005)} * {w}) * (1e0 + {num(p.whites * 0.005)} * {w})")
    if abs(p.saturation) > LEAST:
        out.append({"_y": luma()})
        step(lambda c: f"_y + ({c} - _y) * (1e0 + {num(p.saturation * 0.01)} * {w})")
    if abs(p.clarity) > LEAST:
        out.append({"_y": luma()})
        step(lambda c: f"{c} * (1e0 + {num(p.clarity * 0.003)} * {w} * (1e0 - abs(_y - 0.5e0) * 2e0))")
    return out


def defringe(purple: float, green: float) -> list[Layer]:
    """Purple and green fringes fade towards luma."""
    p, g = (min(max(v * 0.01, 0.0), 1.0) for v in (purple, green))
    ramp = lambda x: clamp(f"({x} - 0.005e0) / 0.01e0", 0, 1)
    out: list[Layer] = [{"_y": luma(), "_x": "least(greatest(0e0, r - g), greatest(0e0, b - g))"}]
    if p > 0:
        out += [{"_k": f"CASE WHEN _x > 0.005e0 THEN {ramp('_x')} * {num(p)} ELSE 0e0 END"}, {"r": "r * (1e0 - _k) + _y * _k", "b": "b * (1e0 - _k) + _y * _k"}]
    if g > 0:
        out += [{"_x": "g - greatest(r, b)"}, {"_k": f"CASE WHEN _x > 0.005e0 THEN {ramp('_x')} * {num(g)} ELSE 0e0 END"}, {"g": "g * (1e0 - _k) + _y * _k"}]
    return out


def vignetting(v1: float, v2: float, strength: float, width: str, height: str) -> list[Layer]:
    """Brightens towards the corners by the inverse of a polynomial falloff."""
    a, b = num(v1 * strength * 0.01), num(v2 * strength * 0.01)
    r2 = f"((x - {width} * 0.5e0) * (x - {width} * 0.5e0) + (y - {height} * 0.5e0) * (y - {height} * 0.5e0)) / ({width} * {width} * 0.25e0 + {height} * {height} * 0.25e0)"
    return [{"_r2": r2}, {"_k": f"1e0 / {clamp(f'1e0 + {a} * _r2 + {b} * _r2 * _r2', 0.15, 1)}"}, per_channel(lambda c: f"{c} * _k")]


def lut3d(table: list[tuple[float, float, float]], n: int, opacity: float = 1.0, d: Dialect = SPARK) -> list[Layer]:
    """P25: a colour cube of n^3 entries (red fastest), interpolated in three directions and mixed in by opacity.

    The cube is an array literal of fixed size (n^3 entries a channel), so it is part of the plan and no rows move.
    """
    if n < 2:
        return []
    out: list[Layer] = [{f"_cube{c}": d.array(num(v[i]) for v in table) for i, c in enumerate("rgb")}]
    out.append({f"_p{c}": f"{clamp(c, 0, 1)} * {num(n - 1)}" for c in "rgb"})
    out.append({f"_i{c}": f"least({d.floor(f'_p{c}')}, {n - 1})" for c in "rgb"})
    out.append({f"_j{c}": f"least(_i{c} + 1, {n - 1})" for c in "rgb"} | {f"_f{c}": f"_p{c} - _i{c}" for c in "rgb"})
    mix = lambda a, b, f: f"(({a}) * (1e0 - {f}) + ({b}) * {f})"

    def sample(c: str) -> str:
        at = lambda x, y, z: d.at(f"_cube{c}", f"_{z}b * {n * n} + _{y}g * {n} + _{x}r + 1")
        face = lambda z: mix(mix(at("i", "i", z), at("j", "i", z), "_fr"), mix(at("i", "j", z), at("j", "j", z), "_fr"), "_fg")
        return mix(face("i"), face("j"), "_fb")

    return [*out, per_channel(lambda c: f"{c} * {num(1 - opacity)} + {sample(c)} * {num(opacity)}")]
