"""Expected behaviour on small built rasters, stacks and texts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.functions import colour as c
from rasterloom.functions.dialect import SPARK, apply
from rasterloom.operators import calibrate, catalog, develop, geometry, history, masks, scopes, stack, stencil
from rasterloom.sources import dims, images
from rasterloom.streaming import tether


def frame(spark, array, frame_id=0, **more):
    """Pixel rows of a (height, width, 3) array."""
    h, w, _ = array.shape
    rows = [(frame_id, x, y, *map(float, array[y, x])) for y in range(h) for x in range(w)]
    return spark.createDataFrame(rows, "frame_id int, x long, y long, r double, g double, b double").withColumns({k: F.lit(v) for k, v in more.items()})


def grid(df, cols=("r", "g", "b")):
    p = df.select("x", "y", *cols).toPandas()
    out = np.zeros((p["y"].max() + 1, p["x"].max() + 1, len(cols)))
    out[p["y"], p["x"]] = p[list(cols)]
    return out


def grey(spark, v, h=3, w=3):
    return frame(spark, np.full((h, w, 3), v))


def test_white_balance_and_exposure(spark):
    warm = grid(apply(grey(spark, 0.5), develop.develop(develop.Params(kelvin=8000))))[1, 1]
    cold = grid(apply(grey(spark, 0.5), develop.develop(develop.Params(kelvin=3500))))[1, 1]
    assert warm[0] > 0.5 > warm[2] and cold[0] < 0.5 < cold[2]
    up = grid(apply(grey(spark, 0.2), develop.exposure(1)))[0, 0, 0]
    assert abs(up / 0.2 - 2) < 0.1
    assert grid(apply(grey(spark, 2.0), develop.highlights(-80)))[0, 0, 0] < 2.0


def test_vibrance_spares_skin(spark):
    px = np.array([[[0.78, 0.55, 0.45], [0.40, 0.45, 0.48]]])
    out = grid(apply(frame(spark, px), develop.vibrance(80)))
    sat = lambda p: (p.max() - p.min()) / p.max()
    skin, dull = (sat(out[0, i]) / sat(px[0, i]) - 1 for i in (0, 1))
    assert skin < 0.25 and dull > 0.35 and dull > 2 * skin


def test_monochrome_is_grey(spark):
    out = grid(apply(frame(spark, np.random.default_rng(1).random((2, 2, 3))), develop.monochrome((0.125,) * 8)))
    assert np.ptp(out, axis=2).max() < 1e-5


def test_hsl_and_lab_round_trips(spark):
    px = np.random.default_rng(2).random((6, 6, 3))
    assert np.abs(grid(apply(frame(spark, px), [*c.to_hsl(), *c.from_hsl()])) - px).max() < 1e-6
    assert np.abs(grid(apply(frame(spark, px), [*c.to_lab(), *c.from_lab()])) - px).max() < 1e-4


def test_delta_e_known_pair(spark):
    """A published CIEDE2000 test pair."""
    df = spark.createDataFrame([(50.0, 2.6772, -79.7751, 50.0, 0.0, -82.7485)], "l1 double, a1 double, b1 double, l2 double, a2 double, b2 double")
    assert apply(df, c.delta_e00(("l1", "a1", "b1"), ("l2", "a2", "b2"))).first()["delta_e"] == pytest.approx(2.0425, abs=1e-3)


def test_dither_is_a_matter_of_place(spark):
    q = lambda df: grid(apply(df, [{"q": c.quantise(SPARK, "r", 0)}]), ("q",))
    a = q(grey(spark, 0.5013, 8, 8))
    assert np.array_equal(a, q(grey(spark, 0.5013, 8, 8))) and len(np.unique(a)) > 1 and abs(a.mean() - 0.5013 * 255) < 0.5


def test_sharpening_leaves_flat_parts(spark):
    px = np.full((6, 32, 3), 0.2)
    px[:, 16:] = 0.8
    out = grid(stencil.sharpen(frame(spark, px), 80, 50))
    assert np.abs(out[:, :10] - px[:, :10]).max() < 1e-4 and out[3, 16, 0] > 0.8
    assert grid(stencil.sharpen(frame(spark, px), 80, 50, preview=True))[3, 4, 0] == 0


def test_chroma_noise_falls(spark):
    rng = np.random.default_rng(42)
    px = np.clip(0.45 + rng.normal(0, 0.08, (40, 40, 1)) + rng.normal(0, 0.12, (40, 40, 3)), 0, None)
    spread = lambda a: np.std(a[..., 0] - a @ np.array(c.LUMA))
    assert spread(grid(stencil.chroma_nr(frame(spark, px), 80, 60))) < 0.35 * spread(px)


def test_box_sum_repeats_edges(spark):
    px = np.random.default_rng(3).random((5, 7, 3))
    want = sum(np.pad(px[..., 0], 2, "edge")[i : i + 5, j : j + 7] for i in range(5) for j in range(5))
    assert np.abs(grid(stencil.box_sum(frame(spark, px), "r", 2, "t"), ("t",))[..., 0] - want).max() < 1e-9


def test_exposure_bars(spark):
    px = np.zeros((16, 64, 3))
    for i, v in enumerate((0.01, 0.40, 0.55, 1.0)):
        px[:, i * 16 : i * 16 + 16] = v
    out = grid(apply(frame(spark, px), [{"ire": c.ire()}, c.false_colour()]))
    assert out[0, 0, 2] > 0.5 and out[0, 20, 1] > 0.8 and out[0, 40, 0] == 1 and tuple(out[0, 60]) == (1, 0, 0)
    z = grid(apply(frame(spark, px), masks.zebra(95)))
    assert np.array_equal(z[:, :48], px[:, :48]) and set(np.unique(z[:, 48:])) == {0, 1}


def test_peaking_marks_the_step(spark):
    px = np.full((8, 64, 3), 0.1)
    px[:, 32:] = 0.9
    out = grid(stencil.focus_peaking(frame(spark, px), "red", 0.15))
    assert out[4, 32, 0] > 0.7 and out[4, 32, 1] < 0.3 and out[4, 5, 0] < 0.6


def test_radial_and_luminance_masks(spark):
    px = np.full((64, 64, 3), 0.2)
    yy, xx = np.mgrid[:64, :64]
    for (cx, cy), v in {(16, 16): 0.95, (16, 48): 0.08, (48, 16): 0.95}.items():
        px[(xx - cx) ** 2 + (yy - cy) ** 2 <= 64] = v
    both = masks.composite([(masks.radial((0.25, 0.25), 0.2, 0.2), "replace", 1.0), (masks.luminance(0.7, 1.0), "intersect", 1.0)])
    df = apply(frame(spark, px), [masks.normalised("64", "64"), *both])
    w = grid(df, ("w",))[..., 0]
    assert w[16, 16] > 0.85 and max(w[48, 16], w[16, 48], w[40, 40]) < 0.01
    lit = grid(apply(df, develop.local_adjust(develop.Local(exposure_ev=1))))
    assert lit[16, 16, 0] > 1.8 * px[16, 16, 0] and abs(lit[60, 60, 0] - 0.2) < 1e-4


def test_polygon_with_a_dent(spark):
    shape = [(0.1, 0.1), (0.9, 0.1), (0.9, 0.9), (0.5, 0.4), (0.1, 0.9)]
    w = grid(apply(grey(spark, 0.5, 41, 41), [masks.normalised("41", "41"), *masks.polygon(shape, 0.02)]), ("w",))[..., 0]
    assert w[10, 20] > 0.9 and w[32, 20] < 0.1 and w[30, 6] > 0.9


def test_brush_pressure_and_eraser(spark):
    strokes = [{"x": 16.0, "y": 20.0, "pressure": 0.2, "radius": 12.0}, {"x": 46.0, "y": 20.0, "pressure": 1.0, "radius": 12.0}]
    at = lambda s: grid(apply(grey(spark, 0.5, 40, 64), masks.brush(s, 12.0, 0.5, "64", "40")), ("w",))[..., 0]
    w = at(strokes)
    assert w[20, 46] > 4 * w[20, 16] and (w[20] > 0.01)[32:].sum() > 3 * (w[20] > 0.01)[:32].sum()
    assert at([*strokes, {"x": 46.0, "y": 20.0, "radius": 14.0, "eraser": True}])[20, 46] < 0.05


def test_heal_and_clone(spark):
    px = np.repeat(np.linspace(0.5, 0.6, 64)[None, :, None], 64, 0).repeat(3, 2)
    yy, xx = np.mgrid[:64, :64]
    px[(xx - 32) ** 2 + (yy - 32) ** 2 <= 16] = 0.05
    assert grid(geometry.clone(frame(spark, px), 64, 64, (32.0, 32.0), (16.0, 32.0), 8.0))[32, 32, 0] > 0.35
    healed = grid(geometry.heal(frame(spark, px), 64, 64, (32.0, 32.0), (16.0, 32.0), 8.0))
    assert healed[32, 32, 0] > 0.45 and healed.shape == px.shape and abs(healed[32, 41, 0] - px[32, 41, 0]) < 0.05


def test_stacks(spark):
    rows = [(0, 0, 0, s, v, v, v) for s, v in enumerate((0.4, 0.4, 0.4, 0.9, 0.41))]
    df = spark.createDataFrame(rows, "stack_id int, y int, x int, seq int, r double, g double, b double")
    assert stack.median(df).first()["r"] == 0.4
    assert stack.kappa_sigma(df, 2.0, 3).first()["r"] < 0.41
    assert stack.mean(df).first()["r"] == pytest.approx(0.502)
    even = df.where("seq < 4")
    assert stack.median(even.withColumn("r", F.col("seq").cast("double"))).first()["r"] == 2.0  # the upper of two
    for mode, want in {"additive": 2.51, "lighten": 0.9, "darken": 0.4}.items():
        assert stack.multiple_exposure(df, mode).first()["r"] == pytest.approx(want)


def test_focus_stack_keeps_the_sharp_frame(spark):
    base = np.full((20, 20, 3), 0.5)
    board = np.where(np.indices((20, 20)).sum(0)[..., None] % 2, 0.9, 0.1)
    a, b = base.copy(), base.copy()
    a[:10], b[10:] = board[:10], board[10:]
    out = grid(stack.focus(frame(spark, a, 0).unionByName(frame(spark, b, 1)), 3.0, 2))
    assert np.abs(np.diff(out[2:8, :, 0], axis=1)).max() > 0.4 and np.abs(np.diff(out[13:18, :, 0], axis=1)).max() > 0.4


def test_pixel_shift_of_a_constant(spark):
    df = frame(spark, np.tile(np.array([0.8, 0.5, 0.2]), (6, 6, 1))).withColumn("shot", F.explode(F.array(*map(F.lit, range(4)))))
    assert np.abs(grid(stencil.pixel_shift(df)) - [0.8, 0.5, 0.2]).max() < 1e-4


def test_geometry_round_trips(spark):
    px = np.random.default_rng(4).random((5, 7, 3))
    df = frame(spark, px)
    assert np.array_equal(grid(geometry.flip(df, 7, 5, True, True)), px[::-1, ::-1])
    assert np.array_equal(grid(geometry.quarter_turns(df, 7, 5, 1)), np.rot90(px, -1))
    back = geometry.quarter_turns(geometry.quarter_turns(df, 7, 5, 1), 5, 7, -1)
    assert np.array_equal(grid(back), px)
    moved = grid(geometry.warp_affine(df, 7, 5, (1, 0, 1, 0, 1, 0)))
    assert np.abs(moved[:4, :5] - px[:4, 1:6]).max() < 1e-9 and not moved[:, 6].any()
    t = (0.98, 0.05, 1.5, -0.04, 1.01, -2.25)
    i = geometry.inverse(t)
    x, y = t[0] * 3 + t[1] * 4 + t[2], t[3] * 3 + t[4] * 4 + t[5]
    assert (i[0] * x + i[1] * y + i[2], i[3] * x + i[4] * y + i[5]) == pytest.approx((3, 4))


def test_downscale_values(spark):
    px = np.arange(16).reshape(4, 4)
    df = frame(spark, np.repeat(px[..., None], 3, 2).astype(float)).selectExpr("frame_id", "x", "y", "CAST(r AS INT) r8", "CAST(g AS INT) g8", "CAST(b AS INT) b8")
    out = grid(geometry.downscale(df, 4, 4, 2), ("r8",))[..., 0]
    assert out.tolist() == [[3, 5], [11, 13]]


def test_stars_and_transform(spark):
    def sky(dx=0, dy=0):
        px = np.full((64, 64, 3), 0.02)
        for x, y, v in ((10, 12, 0.9), (30, 8, 0.8), (50, 20, 0.95), (18, 40, 0.7), (44, 50, 0.85)):
            px[y + dy, x + dx] = v
            for i, j in ((0, 1), (1, 0), (0, -1), (-1, 0)):
                px[y + dy + j, x + dx + i] = v / 3
        return px

    ref = calibrate.detect_stars(frame(spark, sky()), 3.0)
    tgt = calibrate.detect_stars(frame(spark, sky(3, 2)), 3.0)
    assert ref.count() == 5
    t = calibrate.estimate_transform(ref, tgt)
    assert t == pytest.approx((1, 0, 3, 0, 1, 2), abs=0.05)


def test_chart_calibration(spark):
    lab = apply(dims.patches(spark), c.from_lab()).orderBy("patch").select("r", "g", "b").collect()
    px = np.zeros((80, 120, 3))
    sensor = np.array([[0.9, 0.08, 0.02], [0.05, 0.88, 0.07], [0.02, 0.1, 0.85]])
    for i, v in enumerate(lab):
        x0, y0 = 6 + i % 6 * 18, 4 + i // 6 * 18
        px[y0 : y0 + 18, x0 : x0 + 18] = sensor @ np.array(v)
    found = calibrate.calibration(calibrate.sample_patches(frame(spark, px), 120, 80))
    assert found.count() == 24 and found.agg(F.avg("delta_e")).first()[0] < 4.0


def test_lens_ranking(spark):
    shots = spark.createDataFrame([(1, "Sony", "FE 24-70mm F2.8 GM II", 50.0), (2, "Canon", "", 35.0), (3, "", "", 0.0), (4, "Sony", None, 300.0), (5, None, None, None)], "id int, make string, lens string, focal double")
    got = {r.id: (r.tier, r.lens_model) for r in calibrate.find_lens(shots, dims.lenses(spark)).collect()}
    assert got[1] == (0, "FE 24-70mm F2.8 GM II") and got[2][1].startswith("RF24") and got[3][0] == got[4][0] == got[5][0] == 2


def test_scopes_place_colours(spark):
    px = np.zeros((40, 60, 3))
    px[:, :20], px[:, 20:40], px[:, 40:] = (0.9, 0.04, 0.04), (0.9, 0.9, 0.04), (0.9, 0.9, 0.9)
    df = scopes.float_levels(frame(spark, px))
    pic = scopes.waveform_picture(scopes.waveform(df, 60, 40, "overlay", 60, 64), "overlay", 60, 64)
    v = pic.where("col = 5 AND row = 7").first()["argb"]
    assert v >> 16 & 255 > 100 and v & 255 < 52 + 50
    assert scopes.histogram(df, 60, 40, 60).agg(F.sum("n")).first()[0] == 3 * 60 * 40
    vec = scopes.vectorscope_picture(scopes.chroma_bins(frame(spark, px), 60, 40))
    assert vec.count() == 256 * 256


def test_presets_and_sidecars(spark):
    xml = '<rdf:Description crs:PresetName="Look" crs:Exposure2012="+0.80" crs:Temperature="5650"><crs:Contrast2012>12</crs:Contrast2012></rdf:Description>'
    p = catalog.read_preset(spark.createDataFrame([(xml,), (None,)], "xml string")).collect()
    assert (p[0]["exposure_ev"], p[0]["kelvin"], p[0]["contrast"], p[0]["name"]) == (0.8, 5650.0, 12.0, "Look")
    assert p[1]["exposure_ev"] is None
    df = spark.createDataFrame([(xml,)], "xml string").withColumn("xml", catalog.upsert_tags(F.col("xml"), {"xmp:Rating": F.lit("4"), "crs:Contrast2012": F.lit("20"), "crs:Exposure2012": F.lit("+0.75")}))
    s = catalog.read_sidecar(df).first()
    assert (s["rating"], s["contrast"], s["exposure_ev"]) == (4, 20.0, 0.75)
    blend = [spark.sql(f"SELECT {catalog.preset_blend('0e0', '0.8e0', 'exposure_ev', a)}").first()[0] for a in (0, 50, 100, 150, 200)]
    assert blend == pytest.approx([0, 0.4, 0.8, 1.2, 1.6])


def test_batch_sync(spark):
    cols = "kelvin double, tint double, exposure_ev double, rating int, luminance_nr double, dither boolean"
    t = spark.createDataFrame([(5000.0, 0.0, -0.5, 3, 0.0, False)], cols)
    s = spark.createDataFrame([(7200.0, 22.0, 1.25, 5, 40.0, True)], cols)
    assert tuple(catalog.batch_sync(t, s, 1 | 8).first()) == (7200.0, 22.0, -0.5, 3, 40.0, False)
    assert catalog.batch_sync(t, s, catalog.ALL).first()["dither"] is True


def test_save_entries_keeps_what_is_empty(spark):
    old = spark.createDataFrame([("a", "n1", "x", 1), ("b", "n2", "y", 2)], "uri string, name string, lens string, last_edited_at long")
    new = spark.createDataFrame([("a", "", None, 5), ("c", "n3", "", 4)], old.schema)
    got = catalog.save_entries(old, new, cap=2).collect()
    assert [(r.uri, r.name, r.lens) for r in got] == [("a", "n1", "x"), ("c", "n3", "")]


def test_exposure_texts(spark):
    df = spark.createDataFrame([("1/250s",), ("1/0",), ("0.5",), ("bulb",), (None,)], "t string")
    assert [r[0] for r in df.select(catalog.exposure_seconds(F.col("t"))).collect()] == [0.004, None, 0.5, None, None]


def replayed(commands, most):
    """One tree, command by command, with plain Python objects."""
    nodes, branches, now, active, numbers = {}, {}, None, 0, 1
    kids = lambda i: [n for n in nodes if nodes[n]["parent"] == i]
    for op, x in commands:
        if op == "add":
            fork = now is not None and bool(kids(now))
            branch = (numbers if fork else active) if now is not None else 0
            if fork:
                branches[branch], numbers = [now, x], numbers + 1
            branches.setdefault(branch, [x, x])[1] = x
            nodes[x] = {"parent": now, "branch": branch, "step": nodes[now]["step"] + 1 if now is not None else 0}
            now, active = x, branch
        elif op == "undo":
            while x and nodes[now]["parent"] is not None:
                now, x = nodes[now]["parent"], x - 1
        elif op == "redo":
            while x and kids(now):
                now = min(kids(now), key=lambda n: (nodes[n]["branch"] != active, n))
                active, x = nodes[now]["branch"], x - 1
        elif op == "switch" and x in branches:
            active, now = x, branches[x][1] if branches[x][1] in nodes else now
        elif op == "jump" and x in nodes:
            now, active = x, nodes[x]["branch"]
        if op == "add" and len(nodes) > most:
            for old in sorted(n for n in nodes if n != now)[: len(nodes) - most]:
                del nodes[old]
            for n in nodes.values():
                n["parent"] = n["parent"] if n["parent"] in nodes else None
            branches = {b: v for b, v in branches.items() if v[0] in nodes or v[1] in nodes}
    line, i = [], now
    while i is not None:
        line, i = [i, *line], nodes[i]["parent"]
    while kids(line[-1]):
        line.append(min(kids(line[-1]), key=lambda n: (nodes[n]["branch"] != active, n)))
    return {(i, n["parent"], n["branch"], n["step"]) for i, n in nodes.items()}, {(b, *v) for b, v in branches.items()}, (now, active, numbers), line


@pytest.mark.parametrize("seed, most", [(1, 100), (2, 5)])
def test_histories_of_many_trees(spark, seed, most):
    """Rounds of commands for all trees at once against one tree after the other."""
    r = random.Random(seed)
    trees, ids = range(1, 7), {}
    logs = {t: [] for t in trees}
    schema = "tree long, id long, ts long, label string"
    h = history.opened(spark.createDataFrame([], schema))
    for k in range(2):
        batch = [(t, ids.setdefault(t, 0) + i) for t in trees for i in range(r.randint(1, 5)) if k == 0 or r.random() < 0.8]
        for t in trees:
            own = sorted(i for u, i in batch if u == t)
            logs[t] += [("add", i) for i in own]
            ids[t] = (own[-1] if own else ids[t]) + 1
        h = history.append(h, spark.createDataFrame([(t, i, i, "x") for t, i in batch], schema), most=most)
        for name, op, what in (("undo", history.back, "n"), ("redo", history.ahead, "n"), ("switch", history.switch, "branch_id"), ("jump", history.jump_to, "id")):
            some = [(t, r.randint(0, 4)) for t in trees if r.random() < 0.5 and logs[t]]
            for t, x in some:
                logs[t].append((name, x))
            h = op(h, spark.createDataFrame(some, f"tree long, {what} {'int' if what == 'branch_id' else 'long'}"))
    nodes, branches, cursors, lines = h.nodes.collect(), h.branches.collect(), {c.tree: c for c in h.cursors.collect()}, history.timeline(h).collect()
    for t in trees:
        n, b, c, line = replayed(logs[t], most)
        assert {(x.id, x.parent_id, x.branch_id, x.step_index) for x in nodes if x.tree == t} == n
        assert {(x.branch_id, x.root_id, x.leaf_id) for x in branches if x.tree == t} == b
        assert (cursors[t].current_id, cursors[t].active_branch, cursors[t].next_branch) == c
        assert [x.id for x in sorted((x for x in lines if x.tree == t), key=lambda x: x.at)] == line


def test_long_history(spark):
    rows = [(1, 0, None, 0), *((1, i, i - 1, i) for i in range(1, 51)), (1, 51, 25, 51), (None, 1, None, 1), (2, None, None, 1)]
    n = spark.createDataFrame(rows, "tree long, id long, parent_id long, ts long")
    h = history.append(history.opened(n), n)
    assert h.nodes.count() == 52 and h.nodes.where("id = 51 AND branch_id = 1 AND step_index = 26").count() == 1
    assert len(history.jumps(history.parents(n))) == 6  # 32 states and no more than that in one jump
    move = spark.createDataFrame([(1, 1000)], "tree long, n long")
    top = history.back(h, move)
    assert top.cursors.first()["current_id"] == 0 and history.ahead(top, move).cursors.first()["current_id"] == 50  # the first state's child has branch 0, which becomes active
    assert history.children(n).where("id = 25").count() == 2
    kept = history.evict(n.where("tree = 1 AND id IS NOT NULL"), spark.createDataFrame([(1, 3)], "tree long, current_id long"), 10)
    assert kept.count() == 10 and kept.where("id = 3").count() == 1 and kept.where("id = 44").first()["parent_id"] == 43
    assert history.append(history.opened(n), n.limit(0)).nodes.count() == 0


def test_packets_and_sessions(spark):
    good = (12 + 3).to_bytes(4, "little") + (4).to_bytes(2, "little") + (0x4002).to_bytes(2, "little") + (7).to_bytes(4, "little") + b"abc"
    df = spark.createDataFrame([(good,), (good[:14],), (b"x",), (None,)], "packet binary")
    assert [(r.length, r.type, r.code, r.tx, r.payload_bytes) for r in tether.parse_packets(df).collect()] == [(15, 4, 0x4002, 7, 3)]
    ev = spark.createDataFrame([("d", i, e) for i, e in enumerate(("opened", "connect", "opened", "transfer", "received", "developed", "transfer", "disconnect"))], "device string, i long, event string").selectExpr("device", "timestamp_seconds(i) AS ts", "event")
    assert [r.state for r in tether.sessions(ev).orderBy("ts").collect()] == ["disconnected", "connecting", "connected", "transferring", "processing", "ready", "transferring", "disconnected"]


def test_session_stream_equals_batch(spark, tmp_path):
    names = ("connect", "opened", "transfer", "received", "developed", "disconnect")
    ev = spark.range(60).selectExpr("concat('d', id % 3) AS device", "timestamp_seconds(id) AS ts", f"element_at(array({', '.join(map(repr, names))}), CAST(id div 3 % 6 AS INT) + 1) AS event")
    ev.write.parquet(str(tmp_path / "in"))
    stream = tether.session_stream(spark.readStream.schema(ev.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("device", "ts", "event", "state").collect()))
    assert got == sorted(map(tuple, tether.sessions(ev).collect()))


def test_windowed_stream_and_hook(spark, sf_dir, tmp_path):
    seen = []
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    src = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    q = tether.on_batch(tether.windowed_counts(src), lambda df, i: seen.append(df.count()), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert sum(seen) > 0


def test_throttle_and_debounce(spark):
    t = spark.createDataFrame([("a", float(i)) for i in (0, 10, 22, 30, 44, 45, 100)], "device string, ts_ms double")
    assert [r.ts_ms for r in tether.throttled(t).orderBy("ts_ms").collect()] == [0, 22, 44, 100]
    w = spark.createDataFrame([("f", 0, "1"), ("f", 200, "2"), ("f", 900, "3")], "file string, ms long, value string").selectExpr("file", "timestamp_millis(ms) AS ts", "value")
    assert [(r.value, r.n) for r in tether.debounced(w).orderBy("start").collect()] == [("2", 2), ("3", 1)]


def test_images(spark, tmp_path):
    img = np.random.default_rng(5).integers(0, 65536, (9, 13, 3))
    data = images.encode_tiff(img, 16, dng=True, model="X")
    assert np.array_equal((images.decode_tiff(data) * 65535).round(), img)
    for bad in (b"", data[:40], b"II*\0" + b"\xff" * 20, data[:-1]):
        assert images.decode_tiff(bad) is None
    (tmp_path / "a.dng").write_bytes(data)
    (tmp_path / "b.dng").write_bytes(b"junk")
    assert images.read_frames(spark, str(tmp_path)).count() == 9 * 13
    small, large = (images.encode_jpeg(np.full((n, n, 3), 90), 90) for n in (8, 24))
    w, h, found = images.embedded_preview(b"raw" * 30 + small + b"pad" + large + b"tail")
    assert (w, h, found) == (24, 24, large)
    assert images.embedded_preview(b"nothing" * 20) is None
    e = images.exif_payload({"make": "Sony", "model": "A", "exposure_time": 1 / 500, "f_number": 4.0, "iso_speed": 3200, "focal_length": 70.0, "gps_latitude": 35.6, "gps_longitude": -139.7})
    assert b"Sony\0" in e and images.exif_rational(1 / 500) == (1, 500) and (1).to_bytes(4, "little") + (500).to_bytes(4, "little") in e


def test_trim_and_append(spark):
    f = spark.createDataFrame([(f"f{i}", i, 100) for i in range(10)], "name string, modified long, bytes long")
    gone = sorted(r.name for r in catalog.trim_oldest(f, 900, groups=3).collect())
    assert gone == ["f0", "f1", "f2"]  # until 720 or less is left
    assert catalog.trim_oldest(f, 1000).count() == 0
    assert catalog.append_new(f, f.withColumn("name", F.lit("new")), "name").count() == 11


def test_preview_matrix_by_hand():
    assert develop.exposure_matrix(develop.Preview()) == pytest.approx((1, 0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 0, 1, 0))
    m = develop.exposure_matrix(develop.Preview(exposure_ev=1, kelvin=6600, tint=20, saturation=-100, profile="portrait"))
    assert m[:5] == pytest.approx((2 * 0.2126 * 1.09 * 1.1 * 1.08, 2 * 0.7152, 2 * 0.0722, 0, 0))
    assert m[5:8] == pytest.approx((2 * 0.2126, 2 * 0.7152 * 0.9 * 1.02, 2 * 0.0722)) and m[12] == pytest.approx(2 * 0.0722 * 0.91 * 0.96)
    grey = develop.exposure_matrix(develop.Preview(contrast=20, shadows=10, whites=-4, profile="monochrome"))
    assert grey[:5] == grey[5:10] == grey[10:15] == pytest.approx((1.2 * 0.2126, 1.2 * 0.7152, 1.2 * 0.0722, 0, -25.5 + 0.4 * (3.5 - 1)))


def test_preview_gain_by_hand(spark):
    df = spark.createDataFrame([(0, 0, 101, 200, 90)], "x int, y int, r8 int, g8 int, b8 int")
    assert tuple(apply(df, develop.preview_gain(0.0, 6500)).first())[2:] == (111, 200, 90)
    assert tuple(apply(df, develop.preview_gain(1.0, 4800)).first())[2:] == (202, 255, 198)


def test_wheels_and_split_toning_by_hand(spark):
    none = (0.0, 0.0, 0.0, 0.0)
    w = (2 / 7) ** 2
    out = grid(apply(grey(spark, 0.5), develop.colour_wheels((0.0, 0.4, 0.0, 0.0), none, (0.2, 0.0, 0.0, 0.1), (0.0, 0.0, -0.1, 0.2))))[1, 1]
    assert out == pytest.approx([0.5 + w * 0.12 + 0.03, 0.5 + w * (0.2 + 0.02) + 0.03, 0.5 + w * 0.02 - 0.03 + 0.03])
    dark = grid(apply(grey(spark, 0.25), develop.split_toning(2 / 3, 0.8, 0.0, 0.5)))[1, 1]  # blue: half way, by 0.4
    assert dark == pytest.approx([0.25 * 0.8, 0.25 * 0.8, 0.25 * 0.8 + 0.5 * 0.2])
    assert develop.split_toning(0.1, 0.0, 0.2, 0.0) == []


def test_framing_by_hand(spark):
    px = np.arange(24, dtype=float).reshape(4, 6, 1).repeat(3, 2)
    src = frame(spark, px)
    look = lambda p, size=(6, 4): grid(geometry.framed(src, 6, 4, p, size))[..., 0]
    assert np.allclose(look(geometry.Framing()), px[..., 0])
    assert np.allclose(look(geometry.Framing(flip_h=True)), px[:, ::-1, 0]) and np.allclose(look(geometry.Framing(steps=2)), px[::-1, ::-1, 0])
    assert np.allclose(look(geometry.Framing(crop=(0.5, 0.0, 0.5, 1.0)), (3, 4)), px[:, 3:, 0])
    tilted = look(geometry.Framing(tilt_v=1.0))  # rows above the middle spread beyond the frame, rows below shrink
    assert tilted[0, 0] == 0 and tilted[3, 0] > 0
    assert (look(geometry.Framing(tilt_v=1.0, tilt_h=1.0, crop=(0.0, 0.0, 0.0, 1.0))) >= 0).all()


def test_watermark_prints_a_camera_line(spark):
    from rasterloom.sources.images import GLYPHS, glyph_cells, watermark

    line = "SONY ILCE-7RM5 | FE 24-70mm F2.8 GM II | 50mm f/2.8 1/250s ISO 100 | (C) 2026 DUFFY"
    cells = glyph_cells(line, 1, GLYPHS)
    assert {x for x, y in cells if x < 7} == {0, 1, 2, 3, 4} and sorted(y for x, y in cells if x == 0) == [1, 2, 6]  # an S
    df = spark.createDataFrame([(0, x, y, 60, 60, 60) for x in range(120) for y in range(40)], "frame_id int, x long, y long, r8 int, g8 int, b8 int")
    out = watermark(df, 120, 40, "(C) 2026")
    ink = out.where("y >= 40 AND r8 = 229 AND g8 = 229 AND b8 = 234").count()
    assert out.count() == 120 * 100 and ink == len(glyph_cells("(C) 2026", 1, GLYPHS)) and out.where("y >= 40 AND r8 = 15 AND b8 = 18").count() == 120 * 60 - ink
    over = watermark(df, 120, 40, "ISO", below=False)
    assert over.count() == 4800 and sorted({r.r8 for r in over.select("r8").collect()}) == [60, (60 * 30 + 255 * 225) // 255]
    assert [chr(i) for i in range(32, 127)] == list(GLYPHS) and len(glyph_cells("35mm Photo", 1, GLYPHS)) > 80
    # a character that isn't printable is a blank for each of its bytes
    assert glyph_cells("éI", 1, GLYPHS) == glyph_cells("  I", 1, GLYPHS)


def test_shown_exif_by_hand(spark):
    df = spark.createDataFrame([(1 / 250, 2.8, 100, 50.9), (0.3, 4.0, 0, 0.0), (2.0, 0.0, 64, 24.0), (0.0, 1.4, 1, 8.0)], "exposure_time double, f_number double, iso_speed int, focal_length double")
    got = [tuple(r)[4:] for r in catalog.shown_exif(df).collect()]
    assert got == [("1/250s", "f/2.8", "ISO 100", "50mm"), ("1/3s", "f/4.0", "", ""), ("2.0s", "", "ISO 64", "24mm"), ("", "f/1.4", "ISO 1", "8mm")]


def test_levels_of_no_number(spark):
    df = spark.createDataFrame([(float("nan"), 0.5, 0.5), (1.0, 1.0, 1.0), (-1.0, 0.0, 0.0)], "r double, g double, b double")
    assert [round(r[0], 6) for r in df.select(F.expr(c.ire())).collect()] == [0.0, 100.0, 0.0]


def test_stored_entries_end_at_null_numbers(spark):
    texts = ['[{"uri":"a","rating":3,"fileName":null},{"uri":"b","rating":null},{"uri":"c"}]', '[{"uri":null,"lastEditedAt":"7"},5,{"uri":"x"}]', '[{"lastEditedAt":1}]', "{", None, "[]"]
    got = catalog.stored_entries(spark.createDataFrame(list(enumerate(texts)), "k int, json string")).select("k", "position", "uri", "file_name", "rating", "last_edited_at").collect()
    assert [tuple(r) for r in got] == [(0, 1, "a", "null", 3, 0), (1, 1, "null", "", 0, 7)]


def test_settings_and_layers_as_json(spark):
    """Against Python's own JSON reader: what is written has all fields in order, and reads back the same."""
    import json

    from rasterloom.operators import settings_json as sj

    def default(f):
        if isinstance(f, sj.Group):
            one = {x.name: x.default for x in f.fields}
            return [one] * (f.size or 0) if f.many else one
        return list(f.default) if isinstance(f.default, tuple) else f.default

    texts = ["", "nothing", "{}", '{"kelvin": 1e300, "tint": 1}', '{"colorProfile": "a\\"b/c\\\\é\\n", "toneCurveLUT": [0, "x", 1.5]}', '{"tint": true, "contrast": 5}', '{"tint": 2, "primaryRed": 1, "geometry": {"steps": 2}}', None]
    df = sj.read_settings(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, t string"), "t", "s")
    rows = {r.k: (r.s, r.j) for r in df.select("k", "s", F.expr(sj.write_settings("s")).alias("j")).collect()}
    plain = {f.name: default(f) for f in sj.SETTINGS}
    single = lambda v: json.loads(json.dumps(v), parse_float=lambda x: float(np.float32(x)), parse_int=float)
    for k in (0, 1, 2, 5, 7):
        read = json.loads(rows[k][1], parse_int=float)
        assert list(read) == [f.name for f in sj.SETTINGS] and read == single(plain)
    assert rows[3][1] is None and rows[3][0].tint == 1 and rows[3][0].kelvin == float("inf")
    assert rows[4][0].colorProfile == 'a"b/c\\é\n' and json.loads(rows[4][1])["colorProfile"] == 'a"b/c\\é\n' and "b\\/c" in rows[4][1] and rows[4][0].toneCurveLUT == [0, 0, 1.5]
    assert rows[6][0].tint == 2 and rows[6][0].geometry.steps == 0
    again = sj.read_settings(df.where("k <> 3").select("k", "s", F.expr(sj.write_settings("s")).alias("j")), "j", "s2")
    assert [r.same for r in again.select((F.col("s") == F.col("s2")).alias("same")).collect()] == [True] * 7

    layers = ["", "[]", "[5]", '[{"id":"a","brushStrokes":[{"x":1}]},{"polygonVertices":3}]', '[{"name":"x/\\"y"},{}]', None]
    df = sj.read_layers(spark.createDataFrame(list(enumerate(layers)), "k int, t string"), "t", "l")
    got = {r.k: (r.l, r.j) for r in df.select("k", "l", F.expr(sj.write_layers("l")).alias("j")).collect()}
    assert all(got[k] == ([], "") for k in (0, 1, 2, 5)) and [m.id for m in got[3][0]] == ["a"] and got[3][0][0].brushStrokes[0].r == 25
    assert [(m["id"], m["name"]) for m in json.loads(got[4][1])] == [("mask-0", 'x/"y'), ("mask-1", "Mask Layer")]
    assert list(json.loads(got[4][1])[1]) == [f.name for f in sj.LAYER]


def test_masks_of_frames_without_layers(spark):
    from rasterloom.operators import mask_rows, settings_json as sj

    made = [f"{sj.default_of(f)} AS {f.name}" for f in sj.LAYER if f.name not in ("type", "booleanOp", "inverted", "opacity")]
    rows = [(0, 0, "DEPTH_MAP", "UNION", True, 1.0), (0, 1, "LINEAR_GRADIENT", "SUBTRACT", False, 1.0), (2, 0, "LINEAR_GRADIENT", "INTERSECT", False, 0.5), (3, 0, "BRUSH", "UNION", True, 1.0)]
    layers = spark.createDataFrame(rows, "frame_id int, ord int, type string, booleanOp string, inverted boolean, opacity double").selectExpr("*", *made)
    strokes = spark.createDataFrame([(3, 0, 0, 70.0, 1.0, 1.0, 3.0, 1.0, False)], "frame_id int, ord int, seq int, x double, y double, p double, r double, f double, er boolean")
    px = spark.createDataFrame([(f, x, y, 0.5, 0.5, 0.5) for f in range(4) for x in (0, 70, 99) for y in (0, 1)], "frame_id int, x long, y long, r double, g double, b double")
    got = {(r.frame_id, r.x, r.y): r.w for r in mask_rows.masked(px, layers, strokes, "100", "2").collect()}
    # without depth that layer stands nowhere; a subtraction from nothing is nothing; frame 1 has no layers
    assert all(got[f, x, y] == 0 for f in (0, 1) for x in (0, 70, 99) for y in (0, 1))
    assert got[2, 0, 0] == 0 and got[2, 99, 1] == 0.5 and got[3, 70, 1] == 0 and got[3, 0, 0] == 1


def test_exif_within_bounds():
    """Cut, turned and broken files never read outside, and whole ones read back in both byte orders."""
    from rasterloom.sources import exif

    row = {"make": "A", "model": "A long model name", "orientation": 6, "taken": "2024:01:02 03:04:05", "exposure_time": 1 / 250, "f_number": 2.8, "iso_speed": 100, "focal_length": 50.9, "lens": "é", "latitude": -35.5, "longitude": 139.25}
    for big in (False, True):
        data = exif.build(row, big)
        for whole in (data, exif.in_jpeg(data), b"\xff\xd8\xff\xe0\x00\x04ab" + exif.in_jpeg(data)[2:]):
            got = exif.parse(whole)
            assert all(got[k] == pytest.approx(v, abs=1e-5) if isinstance(v, float) else got[k] == v for k, v in row.items()) and got["software"] is None
        for n in range(len(data)):
            exif.parse(data[:n])
        r = random.Random(1)
        for _ in range(300):
            broken = bytearray(data)
            for _ in range(5):
                broken[r.randrange(8, len(data))] = r.randrange(256)
            exif.parse(bytes(broken))
    assert exif.parse(None) is None and exif.parse(b"") is None and exif.parse(b"II*\0") is None and exif.parse(b"\xff\xd8\xff\xd9") is None
