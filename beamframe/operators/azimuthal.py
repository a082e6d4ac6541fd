"""Azimuthal integration: q-maps, curves over q, their figures of merit, peaks and ring centres."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from beamframe.functions import HC_E
from beamframe.operators.roi import normalize_auc
from beamframe.operators.stats import averaged


def q_map(spark: SparkSession, ny: int, nx: int, cy: float, cx: float, dist: float, pixel: float, energy: float) -> DataFrame:
    """y, x, q: 4 pi / wavelength / sqrt(4 d^2 / r^2 + 1), r the distance of the pixel from the centre; 0 in the centre."""
    k = 4 * math.pi / (HC_E / energy)
    grid = spark.range(ny).select(F.col("id").cast("int").alias("y"), F.explode(F.sequence(F.lit(0), F.lit(nx - 1))).alias("x"))
    r2 = (F.pow(F.col("y") - F.lit(cy), 2) + F.pow(F.col("x") - F.lit(cx), 2)) * pixel * pixel
    return grid.withColumn("q", F.when(r2 > 0, k / F.sqrt(4 * dist * dist / F.when(r2 > 0, r2) + 1)).otherwise(0.0))


def integrate(px: DataFrame, qmap: DataFrame, n: int, lo: float, hi: float, min_count: int = 1, keys: tuple[str, ...] = ("train_id",), weight: str | None = None) -> DataFrame:
    """keys, bin, q (centre), i: mean pixel of each q bin. q = lo is left out, q = hi is in the last bin; bins under min_count are 0. weight: a column of qmap that divides the pixels."""
    width = (hi - lo) / n
    bin_ = F.when((F.col("q") > lo) & (F.col("q") <= hi), F.least(F.floor((F.col("q") - lo) / width), F.lit(n - 1)).cast("int"))
    binned = qmap.withColumn("bin", bin_).where("bin IS NOT NULL")
    v = F.col("v") / F.col(weight) if weight else F.col("v")
    got = px.where("v IS NOT NULL").join(binned, ["y", "x"]).groupBy(*keys, "bin").agg(F.avg(v).alias("m"), F.count("*").alias("c"))
    grid = px.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("bin"))
    return grid.join(got, [*keys, "bin"], "left").select(*keys, "bin", (F.lit(lo) + (F.col("bin") + 0.5) * width).alias("q"), F.when(F.col("c") >= min_count, F.col("m")).otherwise(0.0).alias("i"))


def azimuthal_train(px: DataFrame, qmap: DataFrame, n: int, lo: float, hi: float, auc: tuple[float, float] | None = None, w: int = 1) -> DataFrame:
    """Train curves (train_id, bin, q, i) of images averaged over w trains, over their area if auc is given; ai_sum has their figure of merit."""
    return _over_area(integrate(averaged(px.select("train_id", "y", "x", "v"), ["y", "x"], "v", w), qmap, n, lo, hi), auc)


def _over_area(curve: DataFrame, auc: tuple[float, float] | None) -> DataFrame:
    if auc is None:
        return curve
    return normalize_auc(curve.withColumnsRenamed({"q": "x", "i": "y"}), *auc).withColumnsRenamed({"x": "q", "y": "i"}).select("train_id", "bin", "q", "i")


def azimuthal_pulse_fom(px: DataFrame, qmap: DataFrame, n: int, lo: float, hi: float) -> DataFrame:
    """train_id, pulse, fom: sum of |curve - first pulse's curve|."""
    curve = integrate(px, qmap, n, lo, hi, keys=("train_id", "pulse"))
    first = F.first_value("i").over(Window.partitionBy("train_id", "bin").orderBy("pulse"))
    return curve.withColumn("d", F.abs(F.col("i") - first)).groupBy("train_id", "pulse").agg(F.sum("d").alias("fom"))


def azimuthal_pp(pairs: DataFrame, qmap: DataFrame, n: int, lo: float, hi: float, auc: tuple[float, float] | None = None, w: int = 1) -> DataFrame:
    """train_id, bin, q, on, off, i = on - off of paired images (train_id, y, x, on, off), each averaged over w trains and, if auc is given, divided by the area under its curve."""
    a, b = (azimuthal_train(pairs.select("train_id", "y", "x", F.col(c).alias("v")), qmap, n, lo, hi, auc, w).withColumnRenamed("i", c) for c in ("on", "off"))
    return a.join(b.drop("q"), ["train_id", "bin"]).withColumn("i", F.col("on") - F.col("off"))


def ai_sum(curve: DataFrame, lo: float = -math.inf, hi: float = math.inf, absolute: bool = True) -> DataFrame:
    own = curve.where((F.col("q") >= lo) & (F.col("q") <= hi))
    return own.groupBy("train_id").agg(F.sum(F.abs("i") if absolute else F.col("i")).alias("fom"))


def center_of_mass(curve: DataFrame) -> DataFrame:
    """train_id, q, i at index round(sum(k * i) / sum(i)), half to even; out of range: NULLs."""
    at = curve.groupBy("train_id").agg(F.when(F.sum("i") != 0, F.bround(F.sum(F.col("bin") * F.col("i")) / F.sum("i"))).cast("int").alias("bin"))
    return at.join(curve.select("train_id", "bin", "q", "i"), ["train_id", "bin"], "left").select("train_id", "q", "i")


def _bases(values: Column) -> Column:
    """For each sample the least value from it back to the nearest higher sample: one walk with a stack of falling values.

    An entry of the stack is a sample and the least value since the one below it; a sample takes off what is not higher.
    """
    entry = lambda v, m: F.struct(v.alias("v"), m.alias("m"))

    def step(s: Column, v: Column) -> Column:
        least = F.least(v, F.array_min(F.transform(F.filter(s["stack"], lambda e: e["v"] <= v), lambda e: e["m"])))
        return F.struct(F.concat(F.filter(s["stack"], lambda e: e["v"] > v), F.array(entry(v, least))).alias("stack"), F.concat(s["out"], F.array(least)).alias("out"))

    start = F.struct(F.array().cast("array<struct<v:double,m:double>>").alias("stack"), F.array().cast("array<double>").alias("out"))
    return F.aggregate(values, start, step, lambda s: s["out"])


def find_peaks(curve: DataFrame, prominence: float, most: int = 10) -> DataFrame:
    """train_id, bin, q, i, prominence of local maxima; more than `most` in a curve: none.

    A peak's base on either side is the least value up to the nearest higher sample. Of a plateau the middle counts as the
    peak. A curve is one array: both bases come from a walk along it, and the windows keep its partitioning.
    """
    arrays = curve.groupBy("train_id").agg(F.array_sort(F.collect_list(F.struct("bin", "q", F.col("i").cast("double").alias("i")))).alias("c"))
    values = F.transform("c", lambda s: s["i"])
    each = arrays.select("train_id", F.explode(F.arrays_zip("c", _bases(values).alias("lb"), F.reverse(_bases(F.reverse(values))).alias("rb"))).alias("s")).select("train_id", "s.c.*", "s.lb", "s.rb")
    order = Window.partitionBy("train_id").orderBy("bin")
    runs = each.withColumn("__new", (F.coalesce(F.lag("i").over(order) != F.col("i"), F.lit(True))).cast("int")).withColumn("__run", F.sum("__new").over(order))
    run = Window.partitionBy("train_id", "__run")
    ends = runs.withColumns({"__a": F.min("bin").over(run), "__b": F.max("bin").over(run)})
    last = Window.partitionBy("train_id").orderBy("__run").rangeBetween(-1, -1)
    after = Window.partitionBy("train_id").orderBy("__run").rangeBetween(1, 1)
    tops = ends.withColumns({"__l": F.max("i").over(last), "__r": F.max("i").over(after)}).where("i > __l AND i > __r AND bin = floor((__a + __b) / 2)")
    peaks = tops.withColumn("prominence", F.col("i") - F.greatest("lb", "rb")).where(F.col("prominence") >= prominence)
    return peaks.withColumn("__n", F.count("*").over(Window.partitionBy("train_id"))).where(F.col("__n") <= most).select("train_id", "bin", "q", "i", "prominence")


def largest_peak(peaks: DataFrame) -> DataFrame:
    return peaks.groupBy("train_id").agg(F.max("i").alias("peak"), F.max_by("q", F.struct("i", -F.col("bin"))).alias("peak_q"))


def find_center(px: DataFrame, cy: float, cx: float, ny: int, nx: int, reach: int = 10, min_count: int = 1) -> DataFrame:
    """train_id, cy, cx, peak: the centre within reach pixels whose radial mean has the highest peak, of equal ones (to 9 digits) the first by row and column.

    An image is one group and stays whole: its candidates are compared inside the task, so no pixel is sent more than once.
    """

    def search(image: pd.DataFrame) -> pd.DataFrame:
        y, x, v = image["y"].to_numpy(float), image["x"].to_numpy(float), image["v"].to_numpy(float)
        best = None
        for dy in range(-reach, reach + 1):
            for dx in range(-reach, reach + 1):
                r = np.floor(np.sqrt((y - cy - dy) ** 2 + (x - cx - dx) ** 2) + 0.5).astype(int)
                n = np.bincount(r)
                held = n >= max(min_count, 1)
                if held.any():
                    peak = (np.bincount(r, weights=v)[held] / n[held]).max()
                    if best is None or round(peak, 9) > round(best[2], 9):
                        best = (dy + cy, dx + cx, peak)
        return pd.DataFrame([(image["train_id"].iloc[0], *best)] if best else [], columns=["train_id", "cy", "cx", "peak"])

    own = px.where(F.col("v").isNotNull()).select("train_id", "y", "x", F.col("v").cast("double").alias("v"))
    return own.groupBy("train_id").applyInPandas(search, f"train_id {dict(px.dtypes)['train_id']}, cy double, cx double, peak double")
