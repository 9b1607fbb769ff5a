"""Colour calibration from a chart, lens profiles, and star alignment."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rasterloom.functions.colour import delta_e00, from_lab, to_lab
from rasterloom.functions.dialect import apply
from rasterloom.sources.dims import patches
from rasterloom.sources.staging import cut as staged

Corners = tuple[tuple[float, float], tuple[float, float], tuple[float, float], tuple[float, float]]
WHOLE: Corners = ((0.05, 0.05), (0.95, 0.05), (0.05, 0.95), (0.95, 0.95))


def patch_windows(spark: SparkSession, width: int, height: int, corners: Corners = WHOLE) -> DataFrame:
    """The 24 sampling windows (patch, x0, x1, y0, y1) of a chart with corners top left, top right, bottom left, bottom right."""
    tl, tr, bl, br = corners
    rows = []
    for i in range(24):
        u, v = (i % 6 + 0.5) / 6, (i // 6 + 0.5) / 4
        mix = lambda k: (tl[k] * (1 - u) + tr[k] * u) * (1 - v) + (bl[k] * (1 - u) + br[k] * u) * v
        cx, cy = int(mix(0) * width), int(mix(1) * height)
        rw = max(1, int((tr[0] - tl[0]) * width / 6 * 0.125))
        rh = max(1, int((bl[1] - tl[1]) * height / 4 * 0.125))
        cut = lambda z, n: min(max(z, 0), n - 1)
        rows.append((i, cut(cx - rw, width), cut(cx + rw, width), cut(cy - rh, height), cut(cy + rh, height)))
    return spark.createDataFrame(rows, "patch int, x0 int, x1 int, y0 int, y1 int")


def sample_patches(df: DataFrame, width: int, height: int, corners: Corners = WHOLE) -> DataFrame:
    """Mean colour in each window. 24 windows are broadcast; a pixel in none drops out."""
    win = F.broadcast(patch_windows(df.sparkSession, width, height, corners))
    hit = df.join(win, (df["x"] >= win["x0"]) & (df["x"] <= win["x1"]) & (df["y"] >= win["y0"]) & (df["y"] <= win["y1"]))
    return hit.groupBy("patch").agg(*[F.avg(c).alias(c) for c in "rgb"])


def target_patches(spark: SparkSession) -> DataFrame:
    """(patch, lab_l, lab_a, lab_b, tr, tg, tb): the chart's Lab values and their linear colours."""
    t = apply(patches(spark), from_lab())
    return t.select("patch", "lab_l", "lab_a", "lab_b", F.col("r").alias("tr"), F.col("g").alias("tg"), F.col("b").alias("tb"))


def colour_matrix(measured: DataFrame) -> DataFrame:
    """One row with the matrix m00 .. m22 of the weighted ridge fit from measured to target colours, kelvin and tint."""
    both = measured.join(F.broadcast(target_patches(measured.sparkSession)), "patch")
    w = F.when(F.col("patch") >= 18, 3.0).otherwise(1.0)
    sums = [F.sum(w * F.col(a) * F.col(b)).alias(f"x{i}{j}") for i, a in enumerate("rgb") for j, b in enumerate("rgb")]
    sums += [F.sum(w * F.col(a) * F.col(b)).alias(f"y{i}{j}") for i, a in enumerate("rgb") for j, b in enumerate(("tr", "tg", "tb"))]
    grey = [F.avg(F.when(F.col("patch").between(19, 22), F.col(c))).alias(f"w{c}") for c in "rgb"]
    one = both.agg(*sums, *grey)
    one = one.withColumns({f"x{i}{i}": F.col(f"x{i}{i}") + 0.05 for i in range(3)})
    x = lambda i, j: f"x{i}{j}"
    cof = lambda i, j: f"({x((i + 1) % 3, (j + 1) % 3)} * {x((i + 2) % 3, (j + 2) % 3)} - {x((i + 1) % 3, (j + 2) % 3)} * {x((i + 2) % 3, (j + 1) % 3)})"
    one = one.withColumn("det", F.expr(" + ".join(f"x0{j} * {cof(0, j)}" for j in range(3)))).where("abs(det) >= 1e-8")
    one = one.withColumns({f"i{i}{j}": F.expr(f"{cof(j, i)} / det") for i in range(3) for j in range(3)})
    one = one.withColumns({f"m{c}{r}": F.expr(" + ".join(f"i{r}{k} * y{k}{c}" for k in range(3))) for r in range(3) for c in range(3)})
    kelvin = F.expr("least(greatest(5500e0 / greatest(wr / greatest(wb, 1e-4), 0.1e0), 2000e0), 12000e0)")
    return one.select(*[f"m{i}{j}" for i in range(3) for j in range(3)], kelvin.alias("kelvin"), F.expr("(wg - (wr + wb) * 0.5e0) * 100e0").alias("tint"))


def calibration(measured: DataFrame) -> DataFrame:
    """Each patch's calibrated colour and its difference from the target (delta_e)."""
    m = F.broadcast(colour_matrix(measured))
    cal = measured.crossJoin(m).select("patch", *[F.expr(f"least(greatest(m{i}0 * r + m{i}1 * g + m{i}2 * b, 0e0), 1e0)").alias(c) for i, c in enumerate("rgb")])
    cal = apply(cal, to_lab(out=("cl", "ca", "cb"))).join(F.broadcast(target_patches(measured.sparkSession)), "patch")
    return apply(cal, delta_e00(("cl", "ca", "cb"), ("lab_l", "lab_a", "lab_b"))).select("patch", "r", "g", "b", "delta_e")


def find_lens(shots: DataFrame, lenses: DataFrame) -> DataFrame:
    """Each shot (id, make, lens, focal) with the name of its profile: the first that contains the lens name or is contained in it, else the
    first whose maker contains the camera's and whose range holds the focal length (or it is unknown), else the first.

    The profiles are a small fixed table and are broadcast; the best is kept by an aggregate with partial results, not by a sort.
    """
    p = F.broadcast(lenses.select(F.col("ord"), F.col("lens_make"), F.col("lens_model"), F.col("focal_min"), F.col("focal_max")))
    name = (F.coalesce(F.col("lens"), F.lit("")) != "") & (F.col("lens_model").contains(F.col("lens")) | F.col("lens").contains(F.col("lens_model")))
    make = (F.coalesce(F.col("make"), F.lit("")) != "") & F.col("lens_make").contains(F.col("make"))
    fits = make & ((F.coalesce(F.col("focal"), F.lit(0.0)) <= 0) | F.col("focal").between(F.col("focal_min"), F.col("focal_max")))
    tier = F.when(name, 0).when(fits, 1).otherwise(F.when(F.col("ord") == 0, 2))
    return shots.crossJoin(p).withColumn("tier", tier).where("tier IS NOT NULL").groupBy("id").agg(F.min(F.struct("tier", "ord", "lens_model")).alias("best")).select("id", "best.tier", "best.lens_model")


def detect_stars(df: DataFrame, min_snr: float = 5.0, most: int = 100, step: int | None = None) -> DataFrame:
    """(frame_id, star, x, y, flux, snr), brightest first: local maxima over the sky, with centroids in 5 x 5 pixels."""
    from rasterloom.functions.colour import luma
    from rasterloom.operators.stack import sky
    from rasterloom.operators.stencil import local_maxima

    dims = df.groupBy("frame_id").agg((F.max("x") + 1).alias("_w"), F.count(F.lit(1)).alias("_n"))
    px = df.withColumn("lum", F.expr(luma())).join(F.broadcast(dims), "frame_id").withColumn("i", F.col("y") * F.col("_w") + F.col("x"))
    if step is None:
        step = max(1, int(math.sqrt(dims.agg(F.max("_n")).first()[0] / 10000.0)))
    stats = F.broadcast(sky(px, F.col("lum"), step))
    px = px.join(stats, "frame_id")
    noise = F.greatest("sky_sigma", F.lit(0.005))
    peaks = local_maxima(px, F.col("sky_mean") + min_snr * noise).select("frame_id", F.col("x").alias("px"), F.col("y").alias("py"), F.col("lum").alias("peak"), "sky_mean", "sky_sigma")
    around = peaks.withColumn("o", F.explode(F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in range(-2, 3) for j in range(-2, 3)])))
    around = around.withColumns({"x": F.col("px") + F.col("o.dx"), "y": F.col("py") + F.col("o.dy")}).join(px.select("frame_id", "x", "y", "lum"), ["frame_id", "x", "y"])
    w = F.greatest(F.lit(0.0), F.col("lum") - F.col("sky_mean"))
    star = around.groupBy("frame_id", "px", "py").agg(F.sum(w).alias("flux"), (F.sum(w * F.col("x")) / F.sum(w)).alias("x"), (F.sum(w * F.col("y")) / F.sum(w)).alias("y"), F.first((F.col("peak") - F.col("sky_mean")) / noise).alias("snr")).where("flux > 1e-4")
    rank = F.row_number().over(W.partitionBy("frame_id").orderBy(F.desc("flux"), "py", "px"))
    return star.withColumn("star", rank).where(F.col("star") <= most).select("frame_id", "star", "x", "y", "flux", "snr")


def triangles(stars: DataFrame, most: int = 30, least: float = 4.0) -> DataFrame:
    """Triangles of the brightest stars of each frame: (frame_id, v0, v1, v2, r1, r2), corners by the length of the side opposite them.

    A frame gives at most 30 * 29 * 28 / 6 triangles.
    """
    s = stars.where(F.col("star") <= most)
    one = lambda n: s.select("frame_id", F.struct("star", "x", "y").alias(n))
    dist = lambda a, b: F.sqrt(F.pow(F.col(f"{a}.x") - F.col(f"{b}.x"), 2.0) + F.pow(F.col(f"{a}.y") - F.col(f"{b}.y"), 2.0))
    t = one("a").join(one("b"), "frame_id").where("a.star < b.star").withColumn("ab", dist("a", "b")).where(F.col("ab") >= least)
    t = t.join(one("c"), "frame_id").where("b.star < c.star").withColumns({"bc": dist("b", "c"), "ca": dist("c", "a")}).where((F.col("bc") >= least) & (F.col("ca") >= least))
    sides = F.array_sort(F.array(*[F.struct((-F.col(side)).alias("len"), F.col(f"{v}.star").alias("v")) for side, v in (("bc", "a"), ("ca", "b"), ("ab", "c"))]))
    t = t.withColumn("s", sides)
    return t.select("frame_id", *[F.col("s")[i]["v"].alias(f"v{i}") for i in range(3)], (F.col("s")[1]["len"] / F.col("s")[0]["len"]).alias("r1"), (F.col("s")[2]["len"] / F.col("s")[0]["len"]).alias("r2"))


def match_triangles(ref: DataFrame, tgt: DataFrame, tol: float = 0.025, by: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of stars of like triangles (ref, tgt) within equal columns by: a band join as an equi-join on cells of width tol and their neighbours, then checked."""
    cell = lambda c: F.floor(F.col(c) / tol)
    r = ref.select(*by, cell("r1").alias("c1"), cell("r2").alias("c2"), F.struct("v0", "v1", "v2", "r1", "r2").alias("a"))
    near = lambda c: F.explode(F.array(*[cell(c) + k for k in (-1, 0, 1)]))
    t = tgt.select(*by, F.struct("v0", "v1", "v2", "r1", "r2").alias("b"), near("r1").alias("c1"), "r2").select(*by, "b", "c1", near("r2").alias("c2"))
    hit = r.join(t, [*by, "c1", "c2"]).where((F.abs(F.col("a.r1") - F.col("b.r1")) < tol) & (F.abs(F.col("a.r2") - F.col("b.r2")) < tol))
    return hit.select(*by, F.explode(F.array(*[F.struct(F.col(f"a.v{i}").alias("ref"), F.col(f"b.v{i}").alias("tgt")) for i in range(3)])).alias("p")).select(*by, "p.ref", "p.tgt")


PAIR = ("ref_frame", "tgt_frame")
TRANSFORM = ("m00", "m01", "tx", "m10", "m11", "ty")
#: Fixed multipliers by which proposals are drawn: the same ones in every run and at every place.
DRAW, PRIME = (48271, 69621), 2147483647


def align(stars: DataFrame, pairs: DataFrame, reach: float = 2.5, proposals: int = 100, most: int = 30) -> DataFrame:
    """For every pair (ref_frame, tgt_frame) the transform of its stars (m00, m01, tx, m10, m11, ty) and its inliers.

    Random sample consensus by sets: matches of stars that like triangles agree on are rows with their votes; each proposal draws two of
    them by its number, weighted by votes, and gives a similarity transform; a join counts the votes that it brings within reach, and
    the best proposal of each pair stays, the first among equals. A frame's ``most`` brightest stars are used, so a pair has most * most
    matches at most. With fewer than three inliers the brightest stars' offset is taken. Pairs with fewer than three stars on a side have no row.
    """
    enough = stars.groupBy("frame_id").agg(F.count("*").alias("n"), F.min_by(F.struct("x", "y"), "star").alias("lead")).where("n >= 3")
    side = lambda c, p: enough.select(F.col("frame_id").alias(c), F.col("lead").alias(p))
    pairs = pairs.select(*PAIR).distinct().join(side("ref_frame", "_r"), "ref_frame").join(side("tgt_frame", "_t"), "tgt_frame")
    tri = triangles(stars, most)
    of = lambda c: pairs.select(*PAIR).join(tri.withColumnRenamed("frame_id", c), c)
    votes = match_triangles(of("ref_frame"), of("tgt_frame"), by=PAIR).groupBy(*PAIR, "ref", "tgt").agg(F.count("*").alias("votes"))
    at = lambda c, n: stars.select(F.col("frame_id").alias(c), F.col("star").alias(n), F.col("x").alias(f"{n}x"), F.col("y").alias(f"{n}y"))
    matches = votes.join(at("ref_frame", "ref"), ["ref_frame", "ref"]).join(at("tgt_frame", "tgt"), ["tgt_frame", "tgt"])
    order = W.partitionBy(*PAIR).orderBy("ref", "tgt")
    matches = staged(matches.withColumn("upto", F.sum("votes").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))))

    totals = matches.groupBy(*PAIR).agg(F.sum("votes").alias("total")).where("total >= 3")
    numbered = totals.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(proposals)))).withColumn("draw", F.col("draw").cast("long"))
    drawn = numbered.select(*PAIR, "draw", *[(F.col("draw") * DRAW[i] % PRIME * DRAW[1 - i] % PRIME % F.col("total")).alias(f"at{i}") for i in (0, 1)])
    for i, p in enumerate("pq"):
        m = matches.select(*PAIR, (F.col("upto") - F.col("votes")).alias("_from"), F.col("upto").alias("_to"), F.struct("refx", "refy", "tgtx", "tgty").alias(p))
        drawn = drawn.join(m, [*PAIR]).where((F.col(f"at{i}") >= F.col("_from")) & (F.col(f"at{i}") < F.col("_to"))).drop("_from", "_to")
    d = drawn.selectExpr(*PAIR, "draw", "p", "q.refx - p.refx AS dx", "q.refy - p.refy AS dy", "q.tgtx - p.tgtx AS ex", "q.tgty - p.tgty AS ey").where("dx * dx + dy * dy >= 1e-4")
    d = d.selectExpr(*PAIR, "draw", "p", "try_divide(ex * dx + ey * dy, dx * dx + dy * dy) AS c", "try_divide(ey * dx - ex * dy, dx * dx + dy * dy) AS s")
    proposed = d.selectExpr(*PAIR, "draw", "c AS m00", "-s AS m01", "p.tgtx - (c * p.refx - s * p.refy) AS tx", "s AS m10", "c AS m11", "p.tgty - (s * p.refx + c * p.refy) AS ty")
    off = F.expr("sqrt(pow(m00 * refx + m01 * refy + tx - tgtx, 2e0) + pow(m10 * refx + m11 * refy + ty - tgty, 2e0))")
    scored = proposed.join(matches, [*PAIR]).where(off < reach).groupBy(*PAIR, "draw", *TRANSFORM).agg(F.sum("votes").alias("inliers"))
    best = scored.where("inliers >= 3").groupBy(*PAIR).agg(F.max_by(F.struct(*TRANSFORM, "inliers"), F.struct("inliers", -F.col("draw"))).alias("b"))
    out = pairs.join(best, [*PAIR], "left")
    plain = dict(zip(TRANSFORM, ("1e0", "0e0", "_t.x - _r.x", "0e0", "1e0", "_t.y - _r.y")))
    return out.selectExpr(*PAIR, *[f"coalesce(b.{k}, {v}) AS {k}" for k, v in plain.items()], "coalesce(b.inliers, 0) AS inliers")


def estimate_transform(ref: DataFrame, tgt: DataFrame, reach: float = 2.5, proposals: int = 100) -> tuple[float, ...] | None:
    """The transform from ref to tgt stars of one frame each, or None with fewer than three stars."""
    stars = ref.withColumn("frame_id", F.lit(0)).unionByName(tgt.withColumn("frame_id", F.lit(1)), allowMissingColumns=True)
    found = align(stars, ref.sparkSession.createDataFrame([(0, 1)], "ref_frame int, tgt_frame int"), reach, proposals).first()
    return None if found is None else tuple(found[k] for k in TRANSFORM)
