"""Weighted masks: predicates on place, colour and depth whose truth is a number from 0 to 1.

Columns x, y are pixel numbers; nx, ny the same from 0 to 1 (``normalised``).
"""

from __future__ import annotations

import math

from rasterloom.functions.colour import angle_between, luma, to_hsl
from rasterloom.functions.dialect import SPARK, Dialect, Layer, clamp, num, smoothstep


def normalised(width: str, height: str) -> Layer:
    return {"nx": f"CAST(x AS DOUBLE) / greatest(1, {width} - 1)", "ny": f"CAST(y AS DOUBLE) / greatest(1, {height} - 1)"}


def _turn(w: str, inverted: bool) -> str:
    return clamp(f"1e0 - ({w})" if inverted else w, 0, 1)


def linear(start: tuple[float, float], end: tuple[float, float], feather: float = 0.5, smooth: bool = True, inverted: bool = False, out: str = "w") -> list[Layer]:
    """along the line from start to end; a line without length gives 0 (1 inverted)."""
    vx, vy = end[0] - start[0], end[1] - start[1]
    size = vx * vx + vy * vy
    if size < 1e-7:
        return [{out: num(1.0 if inverted else 0.0)}]
    steps: list[Layer] = [{"_t": clamp(f"((nx - {num(start[0])}) * {num(vx)} + (ny - {num(start[1])}) * {num(vy)}) / {num(size)}", 0, 1)}]
    if smooth:
        steps.append({"_t": smoothstep("0e0", "1e0", "_t")})
    if feather > 0:
        half = max(0.01, feather * 0.5)
        steps.append({"_t": smoothstep(num(max(0.0, 0.5 - half)), num(min(1.0, 0.5 + half)), "_t")})
    return [*steps, {out: _turn("_t", inverted)}]


def radial(centre: tuple[float, float], rx: float, ry: float, angle: float = 0.0, feather: float = 0.5, inverted: bool = False, out: str = "w") -> list[Layer]:
    """1 inside a turned ellipse, fading to its rim."""
    c, s = math.cos(-angle), math.sin(-angle)
    rx, ry, inner = max(1e-5, rx), max(1e-5, ry), max(0.0, 1.0 - min(max(feather, 0.01), 1.0))
    dx, dy = f"(nx - {num(centre[0])})", f"(ny - {num(centre[1])})"
    return [
        {"_u": f"{dx} * {num(c)} - {dy} * {num(s)}", "_v": f"{dx} * {num(s)} + {dy} * {num(c)}"},
        {"_d": f"sqrt(_u * _u / {num(rx * rx)} + _v * _v / {num(ry * ry)})"},
        {out: _turn(f"CASE WHEN _d >= 1e0 THEN 0e0 WHEN _d <= {num(inner)} THEN 1e0 ELSE 1e0 - {smoothstep(num(inner), '1e0', '_d')} END", inverted)},
    ]


def polygon(vertices: list[tuple[float, float]], feather: float = 0.05, inverted: bool = False, out: str = "w") -> list[Layer]:
    """inside by the parity of crossed edges, softened by the distance to the nearest edge. Any number of edges."""
    if len(vertices) < 3:
        return [{out: num(1.0 if inverted else 0.0)}]
    cross, dist = [], []
    for (ax, ay), (bx, by) in zip(vertices, vertices[-1:] + vertices[:-1]):
        if ay != by:
            cross.append(f"CASE WHEN ({num(ay)} > ny) <> ({num(by)} > ny) AND nx < {num(bx - ax)} * (ny - {num(ay)}) / {num(by - ay)} + {num(ax)} THEN 1 ELSE 0 END")
        sx, sy = bx - ax, by - ay
        size = sx * sx + sy * sy
        t = clamp(f"((nx - {num(ax)}) * {num(sx)} + (ny - {num(ay)}) * {num(sy)}) / {num(size)}", 0, 1) if size > 1e-7 else "0e0"
        dist.append(f"pow(nx - ({num(ax)} + {t} * {num(sx)}), 2e0) + pow(ny - ({num(ay)} + {t} * {num(sy)}), 2e0)")
    edge = clamp(f"sqrt(_d2) / {num(max(1e-4, feather))}", 0, 1)
    return [{"_in": f"({' + '.join(cross) or '0'}) % 2", "_d2": f"least({', '.join(dist)})"}, {out: _turn(f"CASE WHEN _in = 1 THEN 0.5e0 + 0.5e0 * {edge} ELSE greatest(0e0, 0.5e0 - 0.5e0 * {edge}) END", inverted)}]


def _band(x: str, low: str, high: str, below: float, above: float) -> str:
    below, above = max(1e-4, below), max(1e-4, above)
    return clamp(f"{smoothstep(f'{low} - {num(below)}', low, x)} * (1e0 - {smoothstep(high, f'{high} + {num(above)}', x)})", 0, 1)


def luminance(low: float, high: float, feather_low: float = 0.1, feather_high: float = 0.1, inverted: bool = False, out: str = "w") -> list[Layer]:
    """F5."""
    return [{"_y": luma()}, {out: _turn(_band("_y", num(low), num(high), feather_low, feather_high), inverted)}]


def colour_range(hue: float, sat: float, light: float, tol: tuple[float, float, float], feather: float = 0.2, inverted: bool = False, out: str = "w") -> list[Layer]:
    """the product of closeness in hue, saturation and lightness. Leaves h, s, l."""
    f = max(1e-4, feather)
    off = lambda dist, t, k: f"(1e0 - {smoothstep(num(t), num(t + f * k), dist)})"
    w = f"{off(angle_between('h', num(hue)), tol[0], 45)} * {off(f'abs(s - {num(sat)})', tol[1], 0.3)} * {off(f'abs(l - {num(light)})', tol[2], 0.3)}"
    return [*to_hsl(), {out: _turn(clamp(w, 0, 1), inverted)}]


def depth(low: float, high: float, feather: float = 0.1, inverted: bool = False, out: str = "w") -> list[Layer]:
    """column depth; null depth has weight 0."""
    return [{out: f"CASE WHEN depth IS NULL THEN 0e0 ELSE {_turn(_band('depth', num(low), num(high), feather, feather), inverted)} END"}]


def edge_weight(threshold: float, feather: float, inverted: bool = False, out: str = "w") -> list[Layer]:
    """F8: from column grad (see stencil.sobel)."""
    f = max(1e-4, feather)
    return [{out: _turn(smoothstep(num(threshold - f), num(threshold + f), "grad"), inverted)}]


def opacity(value: float, w: str = "w") -> Layer:
    return {w: clamp(f"{w} * {num(value)}", 0, 1)}


def combine(base: str, incoming: str, op: str) -> str:
    """replace, union (sum up to 1), subtract (down to 0) or intersect (product)."""
    return clamp({"replace": incoming, "union": f"{base} + {incoming}", "subtract": f"{base} - {incoming}", "intersect": f"{base} * {incoming}"}[op], 0, 1)


def composite(layers: list[tuple[list[Layer], str, float]], out: str = "w") -> list[Layer]:
    """enabled layers (mask, operation, opacity) folded in order; the first replaces whatever it says. Masks give column w."""
    steps: list[Layer] = []
    for i, (mask, op, alpha) in enumerate(layers):
        steps += [*mask, opacity(alpha), {"_acc": "w" if i == 0 else combine("_acc", "w", op)}]
    return [*steps, {out: "_acc"}]


def brush(strokes: list[dict], base_radius: float, feather: float, width: str, height: str, d: Dialect = SPARK, out: str = "w") -> list[Layer]:
    """stamps in order; each adds to the weight up to 1 or, erasing, takes away down to 0.

    Pressure (0.01 to 1) scales radius and flow; places up to 1 are parts of the frame. Strokes are a bounded list of parameters, so the
    fold is an expression of each pixel and moves no rows.
    """
    f = min(max(feather, 0.01), 1.0)
    steps: list[Layer] = [{"_acc": "0e0"}]
    for s in strokes:
        p = min(max(s.get("pressure", 1.0), 0.01), 1.0)
        radius = (s["radius"] if s.get("radius", 0) > 0 else base_radius) * p
        flow = min(max(s.get("flow", 1.0) * p, 0.0), 1.0)
        part = 0 <= s["x"] <= 1 and 0 <= s["y"] <= 1
        cx, cy = (f"({num(s['x'])} * {width})", f"({num(s['y'])} * {height})") if part else (num(s["x"]), num(s["y"]))
        inner = max(0.0, radius * (1 - f))
        stamp = f"CASE WHEN _d > {num(radius)} THEN 0e0 WHEN _d <= {num(inner)} THEN {num(flow)} ELSE (1e0 - {smoothstep(num(inner), num(radius), '_d')}) * {num(flow)} END"
        fold = f"greatest(0e0, _acc - {stamp})" if s.get("eraser") else f"least(1e0, _acc + {stamp})"
        steps += [{"_d": f"sqrt((x - {cx}) * (x - {cx}) + (y - {cy}) * (y - {cy}))"}, {"_acc": fold}]
    return [*steps, {out: "_acc"}]


def zebra(threshold: float, phase: float = 0.0, d: Dialect = SPARK) -> list[Layer]:
    """diagonal stripes of 8 pixels over all levels from the threshold on."""
    from rasterloom.functions.colour import ire

    stripe = f"((({d.int_(f'x + y + {num(phase)}')} % 16) + 16) % 16)"
    ink = f"CASE WHEN {stripe} < 8 THEN 0e0 ELSE 1e0 END"
    return [{"_ire": ire()}, {c: f"CASE WHEN _ire >= {num(threshold)} THEN {ink} ELSE {c} END" for c in "rgb"}]


def gamut(paper: str) -> list[Layer]:
    """column out_of_gamut of Lab columns lab_l, lab_a, lab_b for a paper profile's name."""
    matte = "photorag" in paper or "matte" in paper
    least, chroma = (14.5, 58.0) if matte else (6.0, 78.0)
    hue = f"CASE WHEN _h < 0e0 THEN _h + {num(2 * math.pi)} ELSE _h END * {num(180 / math.pi)}"
    return [
        {"_c": "sqrt(lab_a * lab_a + lab_b * lab_b)", "_h": "atan2(lab_b, lab_a)"},
        {"_h": hue},
        {"_max": f"CASE WHEN _h >= 170e0 AND _h <= 260e0 THEN {num(chroma * 0.72)} ELSE {num(chroma)} END * greatest(0.2e0, 1e0 - pow(abs(lab_l - 50e0) / 50e0, 2e0))"},
        {"out_of_gamut": f"lab_l < {num(least)} OR _c > _max"},
    ]


def soft_proof(paper: str, intent: str = "relative", black_ink: bool = True, paper_white: bool = True, warning: tuple[float, float, float] | None = None) -> list[Layer]:
    """Needs out_of_gamut. intent: perceptual, relative, or any other for none."""
    rag = "photorag" in paper
    white, lift, warm = (0.955, 0.055, 0.025) if rag else (0.97, 0.015, 0.012)
    steps: list[Layer] = [{"_y": luma()}]
    if intent == "perceptual":
        steps.append({c: f"_y + ({c} - _y) * CASE WHEN _y > 0.8e0 THEN 0.92e0 ELSE 0.96e0 END" for c in "rgb"})
    elif intent == "relative":
        steps.append({c: f"CASE WHEN out_of_gamut THEN _y + ({c} - _y) * 0.82e0 ELSE {c} END" for c in "rgb"})
    if black_ink:
        steps.append({c: f"{num(lift)} + {c} * {num(1 - lift)}" for c in "rgb"})
    if paper_white:
        steps.append({c: f"{c} * {num(k)}" for c, k in zip("rgb", (white, white - warm * 0.2, max(0.0, white - warm * 0.5)))})
    last = {c: clamp(c, 0, 1) for c in "rgb"}
    if warning:
        last = {c: f"CASE WHEN out_of_gamut THEN {num(v)} ELSE {e} END" for (c, e), v in zip(last.items(), warning)}
    return [*steps, last]
