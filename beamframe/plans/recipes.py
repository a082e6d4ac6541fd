"""Composite analyses: each is a composition of operators. Plus the operator protocol and FOM dispatch."""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beamframe.functions import absorption, calibrate_axis, curve, divide
from beamframe.operators import azimuthal, image, pumpprobe, roi, stats
from beamframe.operators.correlate import correlate, newest_value, pair_vectors
from beamframe.scratch import written

INF = math.inf


class Operator(Protocol):
    """Anything that turns a DataFrame into a DataFrame; chains run by df.transform."""

    def __call__(self, df: DataFrame) -> DataFrame: ...


def chain(df: DataFrame, *operators: Operator) -> DataFrame:
    for op in operators:
        df = df.transform(op)
    return df


class Recipe(Protocol):
    """A plug-in analysis: the sources it needs and what it does with their correlated table."""

    def sources(self) -> list[str]: ...

    def __call__(self, df: DataFrame) -> DataFrame: ...


def run_recipe(raw: DataFrame, recipe: Recipe, ties: str = "last") -> DataFrame:
    """A plug-in analysis over recorded messages: its sources are matched by train, complete trains go through it. A new call starts afresh."""
    return correlate(raw, recipe.sources(), ties).transform(recipe)


def apply_custom(df: DataFrame, fn: Callable, schema: str, keys: list[str] | None = None) -> DataFrame:
    """A user's vectorized step on pandas frames: per key, or per batch without keys."""
    if keys:
        return df.groupBy(*keys).applyInPandas(fn, schema)
    return df.mapInPandas(lambda frames: (fn(f) for f in frames), schema)


def fom(df: DataFrame, analysis: str, **options) -> DataFrame:
    """train_id, fom by analysis type: roi_fom, roi_proj (pixels), azimuthal (curve), pump_probe (on/off curve)."""
    if analysis == "roi_fom":
        return roi.roi_fom(df, **options).select("train_id", "fom")
    if analysis == "roi_proj":
        return roi.projection_fom(roi.roi_projection(df, **options))
    if analysis == "azimuthal":
        return azimuthal.ai_sum(df, **options)
    if analysis == "pump_probe":
        return azimuthal.ai_sum(df, absolute=options.pop("absolute", True), **options)
    raise ValueError(f"unknown analysis type {analysis!r}")


def _newest(pulses: DataFrame, window: int | None) -> DataFrame:
    return pulses if window is None else stats.last_n(pulses, [], ["train_id", "pulse"], window)


def xas_tim(pulses: DataFrame, i0_min: float, n: int, window: int | None = 180_000, channels: tuple[str, ...] = ("A", "B", "C", "D"), lo: float = -INF, hi: float = INF) -> DataFrame:
    """bin, center, count, i0 and spectrum of each channel, of pulses (train_id, pulse, energy, i0, i1_<channel>) with i0 > i0_min, the newest `window` (None: all).

    Spectra are -ln(-i1 / i0) of bin means, for the fourth channel -i1 / i0.
    """
    own = _newest(pulses.where(F.col("i0") > i0_min), window)
    binned, edges = stats._binned(own, "energy", n, lo, hi, "bin")
    got = binned.where("bin IS NOT NULL").groupBy("bin").agg(F.count("*").alias("count"), F.avg("i0").alias("i0"), *[F.avg(f"i1_{c}").alias(f"m_{c}") for c in channels])
    spectra = [(absorption(-F.col(f"m_{c}"), F.col("i0")) if c != "D" else divide(-F.col(f"m_{c}"), F.col("i0"))).alias(f"s_{c}") for c in channels]
    return stats._grid(edges, n, "bin").join(got, "bin", "left").select("bin", "center", F.coalesce("count", F.lit(0)).alias("count"), "i0", *spectra)


def xas_xmcd(pulses: DataFrame, i0_min: float, current_min: float, n: int, window: int | None = 180_000, channels: tuple[str, ...] = ("A",), shared_range: bool = False) -> DataFrame:
    """bin, center, and spectra <channel>_p, <channel>_n, difference, by the sign of current, of the newest `window` pulses (None: all); p and n have their own ranges unless shared_range."""
    own = _newest(pulses.where((F.col("i0") > i0_min) & (F.abs("current") > current_min)), window)
    lo, hi = (-INF, INF)
    if shared_range:
        r = stats.bin_range(own, "energy", lo, hi).collect()[0]
        lo, hi = r["lo"], r["hi"]
    p, m = (xas_tim(own.where(f"current {s} 0"), i0_min, n, window, channels, lo, hi) for s in (">", "<"))
    base = stats._grid(stats.bin_range(own, "energy", lo, hi), n, "bin")
    both = base.join(p.select("bin", *[F.col(f"s_{c}").alias(f"{c}_p") for c in channels]), "bin").join(m.select("bin", *[F.col(f"s_{c}").alias(f"{c}_n") for c in channels]), "bin")
    return both.withColumns({f"{c}_diff": F.col(f"{c}_p") - F.col(f"{c}_n") for c in channels})


def tr_xas_points(px: DataFrame, slow: DataFrame, rois: dict[int, roi.Rect], ny: int, nx: int) -> DataFrame:
    """train_id, delay, energy, a13, a23, a21 of trains whose three region sums are positive and whose slow data came."""
    sums = roi.roi_values(px, rois, ny, nx, "sum", ("train_id",)).where("r1 > 0 AND r2 > 0 AND r3 > 0")
    a = lambda i, j: absorption(F.col(f"r{i}"), F.col(f"r{j}")).alias(f"a{i}{j}")
    return sums.select("train_id", a(1, 3), a(2, 3), a(2, 1)).join(slow.select("train_id", "delay", "energy"), "train_id")


def tr_xas(points: DataFrame, n1: int, n2: int, range1=(-INF, INF), range2=(-INF, INF)) -> tuple[DataFrame, DataFrame]:
    """(bin, center, count, a13, a23, a21 by delay; bin1 (delay), bin2 (energy), count, stat of a21)."""
    binned, edges = stats._binned(points, "delay", n1, *range1, "bin")
    got = binned.where("bin IS NOT NULL").groupBy("bin").agg(F.count("*").alias("count"), *[F.avg(c).alias(c) for c in ("a13", "a23", "a21")])
    one = stats._grid(edges, n1, "bin").join(got, "bin", "left").select("bin", "center", F.coalesce("count", F.lit(0)).alias("count"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("a13", "a23", "a21")])
    return one, stats.bin_2d(points, "delay", "energy", "a21", n1, n2, range1, range2).select("bin1", "bin2", "count", "stat")


def line_detector(lines: DataFrame, dark: DataFrame | None, w: int, scale: float = 1.0, offset: float = 0.0) -> DataFrame:
    """train_id, axis, mean and averaged: a line detector's pulse mean less the dark line, and its moving average."""
    mean = lines.groupBy("train_id", "pixel").agg(F.avg("adc").alias("m"))
    if dark is not None:
        mean = mean.join(dark.groupBy("pixel").agg(F.avg("adc").alias("d")), "pixel", "left").withColumn("m", F.col("m") - F.coalesce("d", F.lit(0.0)))
    out = stats.moving_average(mean.select("train_id", "pixel", "m"), ["pixel"], ["train_id"], "m", w)
    return out.select("train_id", "pixel", calibrate_axis(F.col("pixel"), scale, offset).alias("axis"), F.col("m").alias("mean"), F.col("avg").alias("averaged"))


def camera(px: DataFrame, dark: DataFrame | None, rect: roi.Rect, ny: int, nx: int, w: int, n: int) -> tuple[DataFrame, DataFrame]:
    """(averaged images less dark, (train_id, mean, median, std) of the region)."""
    out = stats.moving_average(px.select("train_id", "y", "x", "v"), ["y", "x"], ["train_id"], "v", w).select("train_id", "y", "x", F.col("avg").alias("v"))
    if dark is not None:
        out = out.join(image.dark_from_run(dark).withColumnRenamed("v", "d"), ["y", "x"]).withColumn("v", F.col("v") - F.col("d")).drop("d")
    return out, stats.compute_statistics(roi.roi_pixels(out, {1: rect}, ny, nx), "v", ("train_id",))


def roi_histogram(images: DataFrame, rect: roi.Rect, ny: int, nx: int, n: int, lo: float, hi: float) -> DataFrame:
    """train_id, bin, count of a region's pixels of each train's image."""
    return stats.hist_by(roi.roi_pixels(images, {1: rect}, ny, nx), "v", ["train_id"], n, lo, hi)


def line_histogram(lines: DataFrame, first: int, last: int, n: int, lo: float, hi: float) -> DataFrame:
    """train_id, bin, count of a line detector's averaged values (line_detector) in pixels first..last."""
    return stats.hist_by(lines.where(F.col("pixel").between(first, last)), "averaged", ["train_id"], n, lo, hi)


def xes_timing(px: DataFrame, slow: DataFrame, n: int = 6000) -> DataFrame:
    """train_id, total, delay: the image sum against the delay's trace, the newest n."""
    return stats.last_n(px.groupBy("train_id").agg(F.sum("v").alias("total")).join(slow.select("train_id", "delay"), "train_id"), [], ["train_id"], n)


def vector_view(a: DataFrame, b: DataFrame, n: int = 6000) -> DataFrame:
    return stats.last_n(pair_vectors(a, b), [], ["train_id", "pulse"], n)


def multi_camera(raw: DataFrame, sources: list[str], ties: str = "last") -> DataFrame:
    """train_id and up to four image sources side by side, missing ones NULL; of a source's messages the newest counts (correlate.newest_value)."""
    if len(sources) > 4:
        raise ValueError("at most four sources")
    return raw.where(F.col("source").isin(sources)).groupBy("train_id").agg(*[newest_value(raw, s, ties) for s in sources])


def fit_linear(df: DataFrame, keys: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """keys, a, b, n of y = a x + b by least squares for each key; one point or no spread: NULLs."""
    s = df.groupBy(*keys).agg(F.count("*").alias("n"), F.regr_slope(F.col(y), F.col(x)).alias("a"), F.regr_intercept(F.col(y), F.col(x)).alias("b"))
    return s.select(*keys, F.when(F.col("n") > 1, F.col("a")).alias("a"), F.when(F.col("n") > 1, F.col("b")).alias("b"), "n")


def _solve(df: DataFrame, n: int) -> DataFrame:
    """df with d0..: Gaussian elimination of the symmetric positive system a{i}{j} (i <= j), b{i}. Each step is a projection of its own, so terms are computed once."""
    df = df.withColumns({f"m{i}{j}": F.col(f"a{min(i, j)}{max(i, j)}") for i in range(n) for j in range(n)} | {f"r{i}": F.col(f"b{i}") for i in range(n)})
    for i in range(n):
        below = range(i + 1, n)
        df = df.withColumns({f"f{j}": divide(F.col(f"m{j}{i}"), F.col(f"m{i}{i}")) for j in below})
        df = df.withColumns({f"m{j}{k}": F.col(f"m{j}{k}") - F.col(f"f{j}") * F.col(f"m{i}{k}") for j in below for k in range(i, n)} | {f"r{j}": F.col(f"r{j}") - F.col(f"f{j}") * F.col(f"r{i}") for j in below})
    for i in reversed(range(n)):
        known = sum((F.col(f"m{i}{k}") * F.col(f"d{k}") for k in range(i + 1, n)), F.lit(0.0))
        df = df.withColumn(f"d{i}", divide(F.col(f"r{i}") - known, F.col(f"m{i}{i}")))
    return df


def curve_fit(df: DataFrame, keys: list[str], kind: str, p0: tuple[float, ...] | None = None, iterations: int = 12) -> DataFrame:
    """keys, p0.. of a curve fitted to (x, y) of each key at once: one aggregate for each Gauss-Newton step; linear and cubic need one.

    One point or none gives no row; damping keeps the normal equations solvable.
    """
    size = {"linear": 2, "cubic": 4}.get(kind, 4)
    names = [f"p{i}" for i in range(size)]
    start = p0 or (1.0,) * size
    enough = df.groupBy(*keys).agg(F.count("*").alias("__n")).where("__n > 1").drop("__n")
    params = enough.withColumns({n: F.lit(float(v)) for n, v in zip(names, start, strict=True)})
    for _ in range(1 if kind in ("linear", "cubic") else iterations):
        met = df.join(params, keys)
        p = [F.col(n) for n in names]
        x, y = F.col("x"), F.col("y")
        eps = 1e-6
        value = curve(kind, x, p)
        grads = [(curve(kind, x, [q + eps if i == k else q for k, q in enumerate(p)]) - value) / eps for i in range(size)] if kind not in ("linear", "cubic") else [F.pow(x, size - 1 - i) for i in range(size)]
        met = met.withColumns({**{f"__g{i}": g for i, g in enumerate(grads)}, "__r": y - value})
        sums = met.groupBy(*keys, *names).agg(*[F.sum(F.col(f"__g{i}") * F.col(f"__g{j}")).alias(f"a{i}{j}") for i in range(size) for j in range(i, size)], *[F.sum(F.col(f"__g{i}") * F.col("__r")).alias(f"b{i}") for i in range(size)])
        damp = 0.0 if kind in ("linear", "cubic") else 1e-3
        if damp:
            sums = sums.withColumns({f"a{i}{i}": F.col(f"a{i}{i}") * (1 + damp) for i in range(size)})
        sums = _solve(sums, size)
        params = sums.select(*keys, *[(F.col(n) + F.col(f"d{i}")).alias(n) for i, n in enumerate(names)])
        if kind not in ("linear", "cubic"):
            params = written(params, "fit")  # cuts the lineage of the steps
    return params


def fitted_points(df: DataFrame, params: DataFrame, keys: list[str], kind: str, n: int = 100) -> DataFrame:
    """keys, x, y: n points of the fitted curve over the data's range."""
    size = {"linear": 2, "cubic": 4}.get(kind, 4)
    span = df.groupBy(*keys).agg(F.min("x").alias("lo"), F.max("x").alias("hi")).join(params, keys)
    at = span.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i")).withColumn("x", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / (n - 1))
    return at.select(*keys, "x", curve(kind, F.col("x"), [F.col(f"p{i}") for i in range(size)]).alias("y"))


def pump_probe_fom(px: DataFrame, mode: str, on, off, rois, ny: int, nx: int) -> DataFrame:
    """train_id, fom: the whole pump-probe chain to a region's on - off sum."""
    pairs = pumpprobe.pump_probe(px, mode, on, off)
    a, b = (pairs.select("train_id", "y", "x", F.col(c).alias("v")) for c in ("on", "off"))
    return roi.pp_roi_fom(a, b, rois, ny, nx)
