"""Regions of interest: crops, figures of merit, projections, their pump-probe forms, and normalization."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beamframe.functions import divide, divide_ieee
from beamframe.operators.image import REDUCERS
from beamframe.operators.stats import averaged

Rect = tuple[int, int, int, int]


def clip(roi: Rect, ny: int, nx: int) -> Rect | None:
    """(x, y, w, h) within the image; None for an invalid or outside region."""
    x, y, w, h = roi
    if w <= 0 or h <= 0:
        return None
    x0, y0 = max(x, 0), max(y, 0)
    w, h = min(x + w, nx) - x0, min(y + h, ny) - y0
    return (x0, y0, w, h) if w > 0 and h > 0 else None


def _inside(roi: Rect) -> Column:
    x, y, w, h = roi
    return F.col("y").between(y, y + h - 1) & F.col("x").between(x, x + w - 1)


def roi_pixels(px: DataFrame, rois: dict[int, Rect], ny: int, nx: int) -> DataFrame:
    """Pixels with their roi (a row for each region a pixel is in)."""
    own = {k: c for k, r in rois.items() if (c := clip(r, ny, nx))}
    which = F.array_compact(F.array(*[F.when(_inside(r), F.lit(k)) for k, r in own.items()]))
    return px.withColumn("roi", F.explode(which))


def roi_values(px: DataFrame, rois: dict[int, Rect], ny: int, nx: int, how: str, keys: tuple[str, ...]) -> DataFrame:
    """keys and r1..rk: each region's reduction in one pass; NULL without the region."""
    out = {}
    for k, r in rois.items():
        c = clip(r, ny, nx)
        out[f"r{k}"] = F.lit(None).cast("double") if c is None else REDUCERS[how](F.when(_inside(c), F.col("v")))
    return px.groupBy(*keys).agg(*[v.cast("double").alias(k) for k, v in out.items()])


def combine(a: Column, b: Column, combo: str) -> Column:
    if combo == "first":
        return a
    if combo == "second":
        return b
    return {"sub": lambda: a - b, "add": lambda: a + b, "div": lambda: divide_ieee(a, b)}[combo]()


def roi_fom(px: DataFrame, rois: dict[int, Rect], ny: int, nx: int, how: str = "sum", combo: str = "first", keys: tuple[str, ...] = ("train_id",)) -> DataFrame:
    """fom of regions 1 and 2: the pulse form with keys (train_id, pulse), the train form on mean images."""
    got = roi_values(px, {k: rois[k] for k in (1, 2) if k in rois}, ny, nx, how, keys)
    for c in ("r1", "r2"):
        if c not in got.columns:
            got = got.withColumn(c, F.lit(None).cast("double"))
    return got.select(*keys, combine(F.col("r1"), F.col("r2"), combo).alias("fom"), *([F.col("r2").alias("fom_slave")] if combo == "first" and 2 in rois else []))


def roi_norm(px: DataFrame, rois: dict[int, Rect], ny: int, nx: int, how: str = "sum", combo: str = "first", keys: tuple[str, ...] = ("train_id",)) -> DataFrame:
    """norm of regions 3 and 4."""
    return roi_fom(px, {k - 2: r for k, r in rois.items() if k in (3, 4)}, ny, nx, how, combo, keys).select(*keys, F.col("fom").alias("norm"))


def roi_combine(px: DataFrame, a: Rect, b: Rect, combo: str, keys: tuple[str, ...] = ("train_id",)) -> DataFrame:
    """Pixel-wise a + b or a - b of regions of one shape, at places in the region."""
    if a[2:] != b[2:]:
        raise ValueError("regions must have the same shape")
    part = lambda r, sign: px.where(_inside(r)).select(*keys, (F.col("y") - r[1]).alias("y"), (F.col("x") - r[0]).alias("x"), (sign * F.col("v")).alias("v"))
    both = part(a, F.lit(1.0)).unionAll(part(b, F.lit(1.0 if combo == "add" else -1.0)))
    return both.groupBy(*keys, "y", "x").agg(F.when(F.count("v") == 2, F.sum("v")).alias("v"))


def roi_projection(px: DataFrame, roi: Rect, ny: int, nx: int, axis: str = "x", how: str = "sum", keys: tuple[str, ...] = ("train_id",)) -> DataFrame:
    """keys, i (place in the region along axis), y."""
    c = clip(roi, ny, nx)
    base = c[0] if axis == "x" else c[1]
    return px.where(_inside(c)).groupBy(*keys, (F.col(axis) - base).alias("i")).agg((F.coalesce(F.sum("v"), F.lit(0.0)) if how == "sum" else F.avg("v")).alias("y"))


def roi_fom_train(px: DataFrame, rois: dict[int, Rect], ny: int, nx: int, how: str = "sum", combo: str = "first", w: int = 1, normalizer: str | None = None, norm_combo: str = "first") -> DataFrame:
    """train_id, fom [, fom_slave], status of train images (train_id, y, x, v): moving average of the images over w trains, regions 1 and 2, and, with normalizer (a reduction), division by regions 3 and 4."""
    px = averaged(px.select("train_id", "y", "x", "v"), ["y", "x"], "v", w)
    out = roi_fom(px, rois, ny, nx, how, combo)
    if normalizer is None:
        return out.withColumn("status", F.lit("ok"))
    return normalize(out, roi_norm(px, rois, ny, nx, normalizer, norm_combo))


def roi_projection_train(px: DataFrame, rois: dict[int, Rect], ny: int, nx: int, axis: str = "x", how: str = "sum", w: int = 1, lo: float = -math.inf, hi: float = math.inf, normalizer: str | None = None) -> DataFrame:
    """train_id, i, y: region 1 of the averaged images, projected, and divided by the area under it within lo..hi or, with normalizer, by regions 3 and 4."""
    px = averaged(px.select("train_id", "y", "x", "v"), ["y", "x"], "v", w)
    curve = roi_projection(px, rois[1], ny, nx, axis, how)
    if normalizer is None:
        return normalize_auc(curve.withColumnRenamed("i", "x"), lo, hi).withColumnRenamed("x", "i").select("train_id", "i", "y")
    return normalize(curve, roi_norm(px, rois, ny, nx, normalizer), "y").select("train_id", "i", "y")


def projection_fom(curve: DataFrame, keys: tuple[str, ...] = ("train_id",)) -> DataFrame:
    return curve.groupBy(*keys).agg(F.sum("y").alias("fom"))


def pp_roi_fom(on: DataFrame, off: DataFrame, rois: dict[int, Rect], ny: int, nx: int, how: str = "sum", combo: str = "first", normalizer: str | None = None) -> DataFrame:
    """fom(on) - fom(off) of on and off images with one train_id; no absolute value is taken. normalizer: each is divided by its own image's regions 3 and 4 first."""
    if normalizer:
        on_off = [roi_fom(v, rois, ny, nx, how, combo).select("train_id", "fom") for v in (on, off)]
        both = normalize_pp(*on_off, *[roi_norm(v, rois, ny, nx, normalizer) for v in (on, off)])
        return both.select("train_id", (F.col("fom_on") - F.col("fom_off")).alias("fom"))
    a, b = (roi_fom(v, rois, ny, nx, how, combo).select("train_id", F.col("fom").alias(n)) for v, n in ((on, "a"), (off, "b")))
    return a.join(b, "train_id").select("train_id", (F.col("a") - F.col("b")).alias("fom"))


def pp_roi_projection(on: DataFrame, off: DataFrame, roi: Rect, ny: int, nx: int, axis: str = "x", lo: float = -math.inf, hi: float = math.inf, absolute: bool = True) -> tuple[DataFrame, DataFrame]:
    """(on - off along the axis, its sum or absolute sum within lo..hi)."""
    a, b = (roi_projection(v, roi, ny, nx, axis) for v in (on, off))
    curve = a.join(b.withColumnRenamed("y", "b"), ["train_id", "i"]).select("train_id", "i", (F.col("y") - F.col("b")).alias("y"))
    own = curve.where((F.col("i") >= lo) & (F.col("i") <= hi))
    return curve, own.groupBy("train_id").agg(F.sum(F.abs("y") if absolute else F.col("y")).alias("fom"))


def normalize(df: DataFrame, denominator: DataFrame, col: str = "fom") -> DataFrame:
    """col / denominator (train_id, norm); a missing or zero one gives NULL and a status."""
    joined = df.join(denominator.select("train_id", "norm"), "train_id", "left")
    status = F.when(F.col("norm").isNull(), "normalizer is not available").when(F.col("norm") == 0, "normalizer is zero").otherwise("ok")
    return joined.withColumn("status", status).withColumn(col, divide(F.col(col), F.col("norm"))).drop("norm")


def pulse_mean(pulses: DataFrame, col: str) -> DataFrame:
    """train_id, norm: the mean over all pulses, as an intensity normalizer."""
    return pulses.groupBy("train_id").agg(F.avg(col).alias("norm"))


def normalize_pp(on: DataFrame, off: DataFrame, norm_on: DataFrame, norm_off: DataFrame) -> DataFrame:
    """train_id, fom_on, fom_off, each by its own normalizer."""
    a, b = normalize(on, norm_on), normalize(off, norm_off)
    return a.select("train_id", F.col("fom").alias("fom_on")).join(b.select("train_id", F.col("fom").alias("fom_off")), "train_id")


def normalize_auc(curve: DataFrame, lo: float = -math.inf, hi: float = math.inf, keys: tuple[str, ...] = ("train_id",)) -> DataFrame:
    """Curves (keys, x, y) over the trapezoid area within lo..hi. An all-zero curve stays; an area of 0 gives NULL."""
    order = Window.partitionBy(*keys).orderBy("x")
    inside = curve.where((F.col("x") >= lo) & (F.col("x") <= hi))
    strips = inside.select(*keys, ((F.lead("x").over(order) - F.col("x")) * (F.lead("y").over(order) + F.col("y")) / 2).alias("a"))
    area = strips.groupBy(*keys).agg(F.coalesce(F.sum("a"), F.lit(0.0)).alias("__area"))
    flat = curve.groupBy(*keys).agg((~F.coalesce(F.bool_or(F.col("y") != 0), F.lit(False))).alias("__zero"))
    return curve.join(area.join(flat, list(keys), "right"), list(keys)).withColumn("y", F.when(F.col("__zero"), F.col("y")).otherwise(divide(F.col("y"), F.col("__area")))).drop("__area", "__zero")
