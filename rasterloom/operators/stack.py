"""Stacks: several frames folded into one, pixel by pixel.

Frames are rows (stack_id, y, x, seq, r, g, b); alignment by place is the grouping itself. Mean, sums and extremes
aggregate before the shuffle; order-dependent and robust folds gather one pixel's samples (as many as there are frames).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rasterloom.functions.dialect import SPARK, Dialect, num
from rasterloom.operators.stencil import box_mean, sharpness

PIXEL = ("stack_id", "y", "x")


def mean(frames: DataFrame, keys: tuple[str, ...] = PIXEL) -> DataFrame:
    """A10."""
    return frames.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in "rgb"])


def upper_median(values: str, d: Dialect = SPARK) -> str:
    """The element n div 2 of a sorted list (from 0)."""
    return d.at(values, f"{d.idiv(d.size(values), '2')} + 1")


def median(frames: DataFrame, keys: tuple[str, ...] = PIXEL, cols: str = "rgb") -> DataFrame:
    """The upper median of each channel."""
    lists = frames.groupBy(*keys).agg(*[F.array_sort(F.collect_list(c)).alias(c) for c in cols])
    return lists.select(*keys, *[F.expr(upper_median(c)).alias(c) for c in cols])


def blend(base: str, item: str, opacity: str, mode: str) -> str:
    """One step of a multiple exposure."""
    unit = lambda x: f"least(greatest({x}, 0e0), 1e0)"
    return {
        "additive": f"({base} + {item} * {opacity})",
        "average": f"({base} * (1e0 - {opacity} * 0.5e0) + {item} * {opacity} * 0.5e0)",
        "screen": f"(1e0 - (1e0 - {unit(base)}) * (1e0 - {unit(f'{item} * {opacity}')}))",
        "lighten": f"greatest({base}, {item} * {opacity})",
        "darken": f"least({base}, {item} * {opacity} + (1e0 - {opacity}))",
    }[mode]


def multiple_exposure(frames: DataFrame, mode: str, opacity: float = 1.0, keys: tuple[str, ...] = PIXEL, cols: str = "rgb") -> DataFrame:
    """Frame by frame in the order of seq, from the first. Column opacity, if there, counts for its frame."""
    alpha = F.col("opacity") if "opacity" in frames.columns else F.lit(float(opacity))
    rows = frames.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("seq", *[F.col(c).cast("double").alias(c) for c in cols], alpha.alias("o")))).alias("f"))
    fold = lambda c: f"aggregate(slice(f, 2, size(f)), f[0].{c}, (a, v) -> {blend('a', f'v.{c}', 'v.o', mode)})"
    return rows.select(*keys, *[F.expr(fold(c)).alias(c) for c in cols])


def clip_once(values: str, kappa: float, d: Dialect = SPARK) -> str:
    """The sorted values within kappa deviations of their upper median; two or fewer stay. The deviation is 1.4826 * MAD, 0.005 at least."""
    med = upper_median(values, d)
    mad = upper_median(d.sort(d.map(values, "m", f"abs(m - {med})")), d)
    keep = d.keep(values, "k", f"abs(k - {med}) <= {num(kappa)} * greatest(1.4826e0 * {mad}, 0.005e0)")
    return f"CASE WHEN {d.size(values)} <= 2 THEN {values} ELSE {keep} END"


def kappa_sigma(frames: DataFrame, kappa: float = 2.0, iterations: int = 3, keys: tuple[str, ...] = PIXEL, cols: str = "rgb") -> DataFrame:
    """The mean of what repeated clipping keeps; the first frame's value if it keeps nothing."""
    rows = frames.groupBy(*keys).agg(*[F.sort_array(F.collect_list(F.col(c).cast("double"))).alias(f"_{c}") for c in cols], *[F.min_by(F.col(c).cast("double"), "seq").alias(f"_{c}1") for c in cols])
    # the same as clip_once, with median and threshold worked out once a list, not once a value
    for _ in range(min(max(iterations, 1), 5)):
        rows = rows.withColumns({f"_{c}m": F.expr(f"CASE WHEN size(_{c}) > 2 THEN {upper_median(f'_{c}')} END") for c in cols})
        rows = rows.withColumns({f"_{c}d": F.expr(f"sort_array(transform(_{c}, v -> abs(v - _{c}m)))") for c in cols})
        rows = rows.withColumns({f"_{c}t": F.expr(f"CASE WHEN size(_{c}) > 2 THEN {num(kappa)} * greatest(1.4826e0 * {upper_median(f'_{c}d')}, 0.005e0) END") for c in cols})
        rows = rows.withColumns({f"_{c}": F.expr(f"CASE WHEN size(_{c}) <= 2 THEN _{c} ELSE filter(_{c}, k -> abs(k - _{c}m) <= _{c}t) END") for c in cols})
    take = lambda c: F.expr(f"CASE WHEN size(_{c}) > 0 THEN aggregate(_{c}, 0e0, (a, v) -> a + v) / size(_{c}) ELSE _{c}1 END")
    return rows.select(*keys, *[take(c).alias(c) for c in cols])


def focus(frames: DataFrame, exponent: float = 3.0, feather: int = 2) -> DataFrame:
    """A mean weighted by local sharpness, of frames (frame_id, y, x, r, g, b) of one stack; weights are smoothed if feather > 1."""
    p = min(max(exponent, 1.0), 8.0)
    over = W.partitionBy("y", "x")
    df = sharpness(frames, feather, "_s").withColumn("_w", F.pow(F.greatest(F.col("_s"), F.lit(1e-6)), F.lit(p)))
    df = df.withColumn("_w", F.col("_w") / F.sum("_w").over(over))
    if feather > 1:
        df = box_mean(df, "_w", feather)
    return df.groupBy("y", "x").agg(*[(F.sum(F.col(c) * F.col("_w")) / F.sum("_w")).alias(c) for c in "rgb"])


def noise_level(df: DataFrame, c: str, *keys: str) -> DataFrame:
    """Standard deviation over n."""
    return df.groupBy(*keys).agg(F.stddev_pop(c).alias("sigma"))


def sky(df: DataFrame, lum: Column, step: int = 1, keys: tuple[str, ...] = ("frame_id",)) -> DataFrame:
    """Mean and deviation (0.005 at least where it sets a threshold) of every step-th pixel in row order; column i is that order."""
    df = df.where(F.col("i") % step == 0)
    return df.groupBy(*keys).agg(F.avg(lum).alias("sky_mean"), F.sqrt(F.greatest(F.lit(0.0), F.avg(lum * lum) - F.avg(lum) * F.avg(lum))).alias("sky_sigma"))
