"""Detector images in array layout: one row an image (train_id [, pulse], data), row-major, NULL a masked pixel.

What concerns one image stays inside its row: columns to columns by transform, zip_with and aggregate, without an exchange.
Constants and masks are arrays too; a mask or a train-wide constant is one row that every task gets, constants by memory
cell are joined by pulse. Only means over the pulses of a train leave the row, and they are partial sums by pixel.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beamframe.functions import nan_to_null
from beamframe.operators.roi import Rect, clip, combine
from beamframe.operators.scan import moving_average_vectors

def frames(df: DataFrame, data: str, keys: tuple[str, ...] = ("train_id",)) -> DataFrame:
    """keys, data as doubles; NaN becomes NULL."""
    return df.select(*keys, F.transform(data, lambda v: nan_to_null(v.cast("double"))).alias("data"))


def to_pixels(df: DataFrame, nx: int, keys: tuple[str, ...] = ("train_id",)) -> DataFrame:
    """Array layout to pixel layout (keys, y, x, v)."""
    return df.select(*keys, F.posexplode("data").alias("__i", "v")).select(*keys, F.floor(F.col("__i") / nx).cast("int").alias("y"), (F.col("__i") % nx).cast("int").alias("x"), "v")


# masks and values: columns to columns


def threshold(data: Column, lo: float = -math.inf, hi: float = math.inf, keep_nan: bool = True) -> Column:
    """Values outside [lo, hi] are masked, or 0 with keep_nan=False, as masked pixels are then."""
    kept = lambda v: F.when((v >= lo) & (v <= hi), v)
    return F.transform(data, kept if keep_nan else lambda v: F.coalesce(kept(v), F.lit(0.0)))


def mask(data: Column, hit: Column, keep_nan: bool = True) -> Column:
    """hit: array of booleans, true where a pixel is masked."""
    kept = lambda v, h: F.when(~h, v)
    return F.zip_with(data, hit, kept if keep_nan else lambda v, h: F.coalesce(kept(v, h), F.lit(0.0)))


def mask_both(data: Column, hit: Column, lo: float, hi: float) -> tuple[Column, Column]:
    """(data under both masks, is_masked as their union: in the mask, out of range or NULL)."""
    bad = F.zip_with(data, hit, lambda v, h: h | v.isNull() | ~((v >= lo) & (v <= hi)))
    return mask(data, bad), bad


def nan_mask(data: Column) -> Column:
    return F.transform(data, lambda v: v.isNull() | F.isnan(v))


def asic_edges(data: Column, nx: int, asic_h: int, asic_w: int, rows_only: bool = False) -> Column:
    def kept(v: Column, i: Column) -> Column:
        ring = F.floor(i / nx).cast("int") % asic_h
        ring = ring.isin(0, asic_h - 1)
        return F.when(~(ring if rows_only else ring | (i % nx % asic_w).isin(0, asic_w - 1)), v)

    return F.transform(data, kept)


def photons(data: Column, adu: float) -> Column:
    return F.transform(data, lambda v: F.when(v.isNotNull(), F.greatest(F.lit(0.0), F.floor((0.5 * adu + v) / adu).cast("double"))))


def correct(data: Column, gain: Column | None = None, offset: Column | None = None, zero_as: float | None = None) -> Column:
    """g * (v - o), v - o or v * g; zero_as replaces a raw 0 before the subtraction, if only an offset is given."""
    if offset is not None:
        raw = F.transform(data, lambda v: F.when(v == 0, float(zero_as)).otherwise(v)) if gain is None and zero_as is not None else data
        data = F.zip_with(raw, offset, lambda v, o: v - o)
    return data if gain is None else F.zip_with(data, gain, lambda v, g: v * g)


def pair_mean(a: Column, b: Column) -> Column:
    """Pixel by pixel the mean of what is there."""
    return F.zip_with(a, b, lambda x, y: F.when(x.isNull(), y).when(y.isNull(), x).otherwise((x + y) / 2))


def down_sample(data: Column, ny: int, nx: int) -> Column:
    return F.filter(data, lambda v, i: (F.floor(i / nx) % 2 == 0) & (i % nx % 2 == 0))


# reductions inside the image


def reduce(data: Column, how: str) -> Column:
    """sum (0 for all masked), mean, min, max, count, var and std (of the population); NULL is no value."""
    held = F.filter(data, lambda v: v.isNotNull())
    if how in ("min", "max"):
        return (F.array_min if how == "min" else F.array_max)(held)
    if how == "count":
        return F.size(held)
    total = F.aggregate(held, F.lit(0.0), lambda s, v: s + v)
    if how == "sum":
        return total
    mean = F.when(F.size(held) > 0, total / F.size(held))
    if how == "mean":
        return mean
    if how not in ("var", "std"):
        raise ValueError(f"unknown reduction {how!r}")
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("m"), F.lit(0.0).alias("s"))

    def step(s: Column, v: Column) -> Column:  # running mean and sum of squares
        n = s["n"] + 1
        m = s["m"] + (v - s["m"]) / n
        return F.struct(n.alias("n"), m.alias("m"), (s["s"] + (v - s["m"]) * (v - m)).alias("s"))

    var = F.aggregate(held, start, step, lambda s: F.when(s["n"] > 0, s["s"] / s["n"]))
    return var if how == "var" else F.sqrt(var)


def region(data: Column, roi: Rect, ny: int, nx: int) -> Column | None:
    """The pixels of a region, clipped to the image, row by row; None where nothing of it lies inside."""
    own = clip(roi, ny, nx)
    if own is None:
        return None
    x, y, w, h = own
    return F.flatten(F.transform(F.sequence(F.lit(y), F.lit(y + h - 1)), lambda k: F.slice(data, k * nx + x + 1, w)))


def roi_fom(df: DataFrame, rois: dict[int, Rect], ny: int, nx: int, how: str = "sum", combo: str = "first", keys: tuple[str, ...] = ("train_id",)) -> DataFrame:
    """keys, fom of regions 1 and 2; with combo "first" fom_slave is region 2."""
    value = {k: F.lit(None).cast("double") if k not in rois or (r := region(F.col("data"), rois[k], ny, nx)) is None else reduce(r, how) for k in (1, 2)}
    return df.select(*keys, combine(value[1], value[2], combo).alias("fom"), *([value[2].alias("fom_slave")] if combo == "first" and 2 in rois else []))


def projection(data: Column, roi: Rect, ny: int, nx: int, axis: str = "x", how: str = "sum") -> Column:
    """Array of the reductions along the other axis, by place in the region."""
    x, y, w, h = clip(roi, ny, nx)
    row = lambda k: F.slice(data, k * nx + x + 1, w)
    column = lambda k: F.transform(F.sequence(F.lit(y), F.lit(y + h - 1)), lambda j: F.get(data, j * nx + k))
    if axis == "y":
        return F.transform(F.sequence(F.lit(y), F.lit(y + h - 1)), lambda k: reduce(row(k), how))
    return F.transform(F.sequence(F.lit(x), F.lit(x + w - 1)), lambda k: reduce(column(k), how))


# joins with constants and masks; means over pulses


def mask_frame(hits: DataFrame, ny: int, nx: int) -> DataFrame:
    """One row with hit, an array of booleans, from masked (y, x)."""
    own = hits.select((F.col("y") * nx + F.col("x")).cast("long").alias("id")).distinct().withColumn("h", F.lit(True))
    grid = hits.sparkSession.range(ny * nx).join(own, "id", "left").select("id", F.coalesce("h", F.lit(False)).alias("h"))
    return grid.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "h"))), lambda c: c["h"]).alias("hit"))


def with_frame(df: DataFrame, one: DataFrame) -> DataFrame:
    """df beside one row that holds for all images; it is no larger than an image."""
    return df.crossJoin(F.broadcast(one))


def with_cells(df: DataFrame, const: DataFrame, name: str, start: int = 0, step: int = 1) -> DataFrame:
    """The constant (cell, data) of a pulse beside it: pulse p is cell start + p * step."""
    own = const.where((F.col("cell") >= start) & ((F.col("cell") - start) % step == 0)).select(((F.col("cell") - start) / step).cast("int").alias("__pulse"), F.col("data").alias(name))
    return df.join(own, F.col("pulse") == F.col("__pulse")).drop("__pulse")


def nanmean_image(df: DataFrame, nx: int) -> DataFrame:
    """train_id, y, x, v: mean over the pulses of each train (those kept, if the column is there)."""
    own = df.where("kept") if "kept" in df.columns else df
    return to_pixels(own, nx).groupBy("train_id", "y", "x").agg(F.avg("v").alias("v"))


#: Pixels of a tile, the part of an image that one task averages over trains.
TILE = 1024


def moving_average(df: DataFrame, w: int, keys: tuple[str, ...] = (), tile: int = TILE) -> DataFrame:
    """df (train_id, keys, data) with data replaced by its moving average over trains, pixel by pixel, for each of keys.

    Images are cut into tiles, and the tiles averaged apart; what a pixel's NULL does is what it does in moving_average.
    """
    if w <= 1:
        return df
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size("data") - 1) / tile).cast("int")), lambda i: F.slice("data", i * tile + 1, tile))
    tiles = df.select("train_id", *keys, F.posexplode(parts).alias("__tile", "__part"))
    done = moving_average_vectors(tiles, [*keys, "__tile"], ["train_id"], "__part", w)
    whole = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("__tile", "avg"))), lambda t: t["avg"]))
    return done.groupBy("train_id", *keys).agg(whole.alias("data"))
