"""Detector images in pixel layout (train_id [, pulse], y, x, v): masks, corrections, assembly, reductions, transforms.

NULL is a masked pixel. Values are reduced by hash aggregates with partial sums; constants and maps (pixels of one
image) are joined, by broadcast where Spark finds them small.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beamframe.functions import nan_to_null
from beamframe.operators.stats import averaged

IMAGE, PULSE_IMAGE = ("train_id",), ("train_id", "pulse")


def to_pixels(df: DataFrame, data: str, nx: int, keys: tuple[str, ...] = IMAGE) -> DataFrame:
    """Array layout (row-major) to pixel layout; NaN becomes NULL."""
    return df.select(*keys, F.posexplode(data).alias("i", "v")).select(*keys, F.floor(F.col("i") / nx).cast("int").alias("y"), (F.col("i") % nx).cast("int").alias("x"), nan_to_null(F.col("v").cast("double")).alias("v"))


# masks


def mask_threshold(px: DataFrame, lo: float = -math.inf, hi: float = math.inf, keep_nan: bool = True) -> DataFrame:
    """Values outside [lo, hi] are masked, or 0 with keep_nan=False, as masked pixels are then."""
    v = F.when((F.col("v") >= lo) & (F.col("v") <= hi), F.col("v"))
    return px.withColumn("v", v if keep_nan else F.coalesce(v, F.lit(0.0)))


def _masked(px: DataFrame, mask: DataFrame) -> tuple[DataFrame, Column]:
    own = mask.select(F.col("y").alias("__y"), F.col("x").alias("__x")).distinct()
    return px.join(own, (F.col("y") == F.col("__y")) & (F.col("x") == F.col("__x")), "left"), F.col("__y").isNotNull()


def mask_image(px: DataFrame, mask: DataFrame, keep_nan: bool = True) -> DataFrame:
    """mask: the masked (y, x), shared by all pulses."""
    df, hit = _masked(px, mask)
    v = F.when(~hit, F.col("v"))
    return df.withColumn("v", v if keep_nan else F.coalesce(v, F.lit(0.0))).drop("__y", "__x")


def mask_pixels(px: DataFrame, mask: DataFrame, lo: float, hi: float) -> DataFrame:
    """Both masks in one pass, with is_masked as the union: in the mask, out of range or NaN."""
    df, hit = _masked(px, mask)
    bad = hit | F.col("v").isNull() | ~F.col("v").between(lo, hi)
    return df.withColumn("is_masked", bad).withColumn("v", F.when(~bad, F.col("v"))).drop("__y", "__x")


def nan_mask(px: DataFrame) -> DataFrame:
    return px.withColumn("is_masked", F.col("v").isNull() | F.isnan("v"))


def build_mask(ops: DataFrame, ny: int, nx: int) -> DataFrame:
    """Masked (y, x) after ops (seq, op, x, y, w, h): "set" and "remove" clear all before, "mask" and "unmask" draw rectangles; of those that touch a pixel the last counts."""
    start = ops.agg(F.coalesce(F.max(F.when(F.col("op").isin("set", "remove"), F.col("seq"))), F.lit(-1)).alias("__from"))
    rects = ops.crossJoin(F.broadcast(start)).where((F.col("seq") >= F.col("__from")) & (F.col("op") != "remove"))
    span = lambda a, n, most: F.sequence(F.greatest(F.col(a), F.lit(0)), F.least(F.col(a) + F.col(n), F.lit(most)) - 1)
    inside = rects.where((F.col("w") > 0) & (F.col("h") > 0) & (F.col("x") < nx) & (F.col("y") < ny) & (F.col("x") + F.col("w") > 0) & (F.col("y") + F.col("h") > 0))
    each = inside.select("seq", "op", F.explode(span("y", "h", ny)).alias("__py"), "x", "w").select("seq", "op", "__py", F.explode(span("x", "w", nx)).alias("__px"))
    return each.groupBy(F.col("__py").alias("y"), F.col("__px").alias("x")).agg(F.max_by("op", "seq").alias("op")).where("op != 'unmask'").select("y", "x")


def mask_asic_edges(px: DataFrame, asic_h: int, asic_w: int, rows_only: bool = False) -> DataFrame:
    ring = (F.col("y") % asic_h).isin(0, asic_h - 1)
    if not rows_only:
        ring = ring | (F.col("x") % asic_w).isin(0, asic_w - 1)
    return px.withColumn("v", F.when(~ring, F.col("v")))


# values


def bin_photons(px: DataFrame, adu: float) -> DataFrame:
    return px.withColumn("v", F.greatest(F.lit(0.0), F.floor((0.5 * adu + F.col("v")) / adu).cast("double")) + 0 * F.col("v"))


def down_sample(px: DataFrame) -> DataFrame:
    return px.where((F.col("y") % 2 == 0) & (F.col("x") % 2 == 0)).withColumn("y", (F.col("y") / 2).cast("int")).withColumn("x", (F.col("x") / 2).cast("int"))


def up_sample(px: DataFrame, ny: int, nx: int) -> DataFrame:
    """Each pixel twice along both axes, cropped to (ny, nx); the input must have the halves rounded up."""
    two = F.array(F.lit(0), F.lit(1))
    df = px.withColumn("__dy", F.explode(two)).withColumn("__dx", F.explode(two))
    return df.withColumn("y", F.col("y") * 2 + F.col("__dy")).withColumn("x", F.col("x") * 2 + F.col("__dx")).where((F.col("y") < ny) & (F.col("x") < nx)).drop("__dy", "__dx")


def with_constants(px: DataFrame, const: DataFrame, name: str, start: int = 0, step: int = 1) -> DataFrame:
    """A constant's value beside each pixel: by (cell, y, x), pulse p being cell start + p * step, or by (y, x)."""
    own = const.withColumnRenamed("v", name)
    if "cell" not in const.columns:
        return px.join(own, ["y", "x"])
    own = own.where((F.col("cell") >= start) & ((F.col("cell") - start) % step == 0)).withColumn("pulse", ((F.col("cell") - start) / step).cast("int")).drop("cell")
    return px.join(own, ["pulse", "y", "x"])


def correct(px: DataFrame, gain: DataFrame | None = None, offset: DataFrame | None = None, zero_as: float | None = None, **cells) -> DataFrame:
    """g * (v - o), v - o or v * g. zero_as replaces a raw 0 before the subtraction, if only an offset is given."""
    v = F.col("v")
    df = px
    if offset is not None:
        df = with_constants(df, offset, "__o", **cells)
        if gain is None and zero_as is not None:
            v = F.when(v == 0, float(zero_as)).otherwise(v)
        v = v - F.col("__o")
    if gain is not None:
        df = with_constants(df, gain, "__g", **cells)
        v = v * F.col("__g")
    return df.withColumn("v", v).drop("__o", "__g")


def intra_dark(px: DataFrame) -> DataFrame:
    """Even pulses less the odd pulse after each; trains with an odd number of pulses get status "error"."""
    order = Window.partitionBy("train_id", "y", "x").orderBy("pulse")
    after, n = F.lead("v").over(order), F.count(F.lit(1)).over(Window.partitionBy("train_id", "y", "x"))
    return px.withColumns({"__after": after, "__n": n}).withColumn("v", F.when((F.col("pulse") % 2 == 0) & (F.col("__n") % 2 == 0), F.col("v") - F.col("__after")).otherwise(F.col("v"))).withColumn("status", F.when(F.col("__n") % 2 == 0, "ok").otherwise("error")).drop("__after", "__n")


def calibrate(px: DataFrame, gain: DataFrame | None, offset: DataFrame | None, dark: DataFrame | None = None, dark_as_offset: bool = False, adu: float | None = None, slicer: tuple | None = None, mask: DataFrame | None = None, lo: float = -math.inf, hi: float = math.inf, w: int = 1, **options) -> DataFrame:
    """Correction, photon binning, moving average over trains (window w), pulse slice, masks, in that order.

    Constants and averages are those of the unsliced train, and what a mask or the range hides in one train is no gap in
    the averages. A dark image recorded from a run (dark_mean, dark_from_run) is `dark`.
    """
    from beamframe.operators.filters import slice_pulses

    df = correct(px, gain, dark if dark_as_offset else offset, **options)
    df = bin_photons(df, adu) if adu else df
    df = averaged(df, [c for c in ("pulse", "y", "x") if c in df.columns], "v", w)
    df = slice_pulses(df, *slicer) if slicer else df
    df = mask_image(df, mask) if mask is not None else df
    return df if math.isinf(lo) and math.isinf(hi) else mask_threshold(df, lo, hi)


# reductions


def nanmean_image(px: DataFrame) -> DataFrame:
    """Mean over the (kept) pulses of each train; all masked: NULL."""
    own = px.where("kept") if "kept" in px.columns else px
    return own.groupBy("train_id", "y", "x").agg(F.avg("v").alias("v"))


def nanmean_pair(a: DataFrame, b: DataFrame) -> DataFrame:
    cols = ["train_id", "y", "x", "v"]
    return a.select(*cols).unionAll(b.select(*cols)).groupBy("train_id", "y", "x").agg(F.avg("v").alias("v"))


def nan_reduce(px: DataFrame, how: str, keys: tuple[str, ...]) -> DataFrame:
    """nansum (0 for all masked) or nanmean over what keys leave."""
    return px.groupBy(*keys).agg((F.coalesce(F.sum("v"), F.lit(0.0)) if how == "sum" else F.avg("v")).alias("v"))


#: Reducers of a region; n_std and n_var are divided by the mean and its square.
REDUCERS = {
    "sum": lambda v: F.coalesce(F.sum(v), F.lit(0.0)),
    "mean": F.avg,
    "median": F.median,
    "max": F.max,
    "min": F.min,
    "std": F.stddev_pop,
    "var": F.var_pop,
    "n_std": lambda v: F.when(F.avg(v) != 0, F.stddev_pop(v) / F.avg(v)),
    "n_var": lambda v: F.when(F.avg(v) != 0, F.var_pop(v) / (F.avg(v) * F.avg(v))),
}


def nan_std(px: DataFrame, keys: tuple[str, ...], normalized: bool = False) -> DataFrame:
    return px.groupBy(*keys).agg(REDUCERS["n_std" if normalized else "std"](F.col("v")).alias("std"), REDUCERS["n_var" if normalized else "var"](F.col("v")).alias("var"))


def const_mean(const: DataFrame, start: int = 0, stop: int | None = None, step: int = 1) -> DataFrame:
    own = const.where((F.col("cell") >= start) & ((F.col("cell") - start) % step == 0) & (F.lit(True) if stop is None else F.col("cell") < stop))
    return own.groupBy("y", "x").agg(F.avg("v").alias("v"))


def dark_mean(px: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(mean by pulse, mean of those, one row with the number of trains)."""
    by_pulse = px.groupBy("pulse", "y", "x").agg(F.avg("v").alias("v"))
    return by_pulse, by_pulse.groupBy("y", "x").agg(F.avg("v").alias("v")), px.agg(F.countDistinct("train_id").alias("n_trains"))


def dark_from_run(px: DataFrame, keys: tuple[str, ...] = ("y", "x")) -> DataFrame:
    return px.groupBy(*keys).agg(F.avg("v").alias("v"))


# assembly


def pixel_map(tiles: list[dict], skip_edges: bool = False) -> list[tuple[int, int, int, int, int]]:
    """(module, my, mx, y, x) from tiles: module, my0, mx0 (the tile's place in its module), h, w, and corners (y0, x0), (y1, x1) in pixels.

    An axis runs up where the far corner lies beyond the first, else down from one before; the least corner is the origin.
    """
    near = lambda v: math.floor(v + 0.5) if v >= 0 else -math.floor(-v + 0.5)  # noqa: E731  half away from zero
    oy = -near(min(min(t["y0"], t["y1"]) for t in tiles))
    ox = -near(min(min(t["x0"], t["x1"]) for t in tiles))
    out = []
    for t in tiles:
        dy, dx = (1 if t["y1"] > t["y0"] else -1), (1 if t["x1"] > t["x0"] else -1)
        y0, x0 = near(t["y0"]) + oy - (dy < 0), near(t["x0"]) + ox - (dx < 0)
        edge = 1 if skip_edges else 0
        out += [(t["module"], t["my0"] + i, t["mx0"] + j, y0 + dy * i, x0 + dx * j) for i in range(edge, t["h"] - edge) for j in range(edge, t["w"] - edge)]
    return out


def assemble(px: DataFrame, geometry: DataFrame, keys: tuple[str, ...] = IMAGE) -> DataFrame:
    """Module pixels (module, my, mx, v) to image pixels (y, x, v); where tiles overlap the highest (module, my, mx) wins."""
    return px.join(geometry, ["module", "my", "mx"]).groupBy(*keys, "y", "x").agg(F.max_by("v", F.struct("module", "my", "mx")).alias("v"))


def dismantle(px: DataFrame, geometry: DataFrame, keys: tuple[str, ...] = IMAGE) -> DataFrame:
    return px.join(geometry, ["y", "x"]).select(*keys, "module", "my", "mx", "v")


def stack_modules(px: DataFrame, modules: list[int], h: int, w: int) -> DataFrame:
    """Every expected module of every train: rows module * h + my; a missing module is NULL."""
    trains = px.select("train_id").distinct()
    grid = trains.select("train_id", F.explode(F.array(*[F.lit(m) for m in modules])).alias("module")).select("train_id", "module", F.explode(F.sequence(F.lit(0), F.lit(h - 1))).alias("my")).select("train_id", "module", "my", F.explode(F.sequence(F.lit(0), F.lit(w - 1))).alias("mx"))
    place = F.array_position(F.array(*[F.lit(m) for m in modules]), F.col("module")) - 1
    return grid.join(px.select("train_id", "module", "my", "mx", "v"), ["train_id", "module", "my", "mx"], "left").select("train_id", (place * h + F.col("my")).cast("int").alias("y"), F.col("mx").alias("x"), "v")


# transforms


def convolve(px: DataFrame, kernel: list[tuple[int, int, float]], ny: int, nx: int, keys: tuple[str, ...] = IMAGE) -> DataFrame:
    """Sum of weight * value over neighbours; each pixel is sent to those it reaches. Beyond the border values are 0."""
    reach = F.explode(F.array(*[F.struct(F.lit(-dy).alias("dy"), F.lit(-dx).alias("dx"), F.lit(float(w)).alias("w")) for dy, dx, w in kernel])).alias("k")
    df = px.select(*keys, "y", "x", "v", reach).select(*keys, (F.col("y") + F.col("k.dy")).alias("y"), (F.col("x") + F.col("k.dx")).alias("x"), (F.col("v") * F.col("k.w")).alias("v"))
    return df.where(F.col("y").between(0, ny - 1) & F.col("x").between(0, nx - 1)).groupBy(*keys, "y", "x").agg(F.sum("v").alias("v"))


def cross_kernel(size: int, sigma: float) -> list[tuple[int, int, float]]:
    """Half a row and half a column of Gaussian weights, as a cross."""
    r = size // 2
    w = [math.exp(-(i * i) / (2 * sigma * sigma)) for i in range(-r, r + 1)]
    w = [x / sum(w) for x in w]
    out: dict[tuple[int, int], float] = {}
    for i, x in zip(range(-r, r + 1), w, strict=True):
        for at in ((0, i), (i, 0)):
            out[at] = out.get(at, 0.0) + 0.5 * x
    return [(dy, dx, v) for (dy, dx), v in sorted(out.items())]


def gaussian_blur(px: DataFrame, size: int, sigma: float, ny: int, nx: int, keys: tuple[str, ...] = IMAGE) -> DataFrame:
    return convolve(px, cross_kernel(size, sigma), ny, nx, keys)


def edge_detect(px: DataFrame, size: int, sigma: float, low: float, high: float, ny: int, nx: int, passes: int = 3, keys: tuple[str, ...] = IMAGE) -> DataFrame:
    """NaN to 0, blur, gradient, suppression along it, and growth of edges (>= high) into weak ones (>= low), `passes` times. v is 1 on an edge."""
    df = gaussian_blur(px.withColumn("v", F.coalesce("v", F.lit(0.0))), size, sigma, ny, nx, keys)
    sobel = [(-1, -1, -1), (-1, 1, 1), (0, -1, -2), (0, 1, 2), (1, -1, -1), (1, 1, 1)]
    gx = convolve(df, sobel, ny, nx, keys).withColumnRenamed("v", "gx")
    gy = convolve(df, [(dx, dy, w) for dy, dx, w in sobel], ny, nx, keys).withColumnRenamed("v", "gy")
    grad = gx.join(gy, [*keys, "y", "x"]).withColumn("g", F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")))
    angle = F.pmod(F.degrees(F.atan2("gy", "gx")), F.lit(180.0))
    sector = F.when((angle < 22.5) | (angle >= 157.5), F.struct(F.lit(0).alias("dy"), F.lit(1).alias("dx"))).when(angle < 67.5, F.struct(F.lit(1).alias("dy"), F.lit(1).alias("dx"))).when(angle < 112.5, F.struct(F.lit(1).alias("dy"), F.lit(0).alias("dx"))).otherwise(F.struct(F.lit(1).alias("dy"), F.lit(-1).alias("dx")))
    grad = grad.withColumn("s", sector)
    sides = grad.select(*keys, "y", "x", F.explode(F.array(F.lit(-1), F.lit(1))).alias("k"), "s").select(*keys, "y", "x", (F.col("y") + F.col("k") * F.col("s.dy")).alias("ny"), (F.col("x") + F.col("k") * F.col("s.dx")).alias("nx"))
    other = grad.select(*keys, F.col("y").alias("ny"), F.col("x").alias("nx"), F.col("g").alias("og"))
    most = sides.join(other, [*keys, "ny", "nx"]).groupBy(*keys, "y", "x").agg(F.max("og").alias("og"))
    thin = grad.join(most, [*keys, "y", "x"], "left").select(*keys, "y", "x", F.when(F.col("g") >= F.coalesce("og", F.lit(0.0)), F.col("g")).otherwise(0.0).alias("g"))
    state = thin.select(*keys, "y", "x", F.when(F.col("g") >= high, 2).when(F.col("g") >= low, 1).otherwise(0).alias("s"))
    for _ in range(passes):
        around = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx])
        near = state.where("s = 2").select(*keys, "y", "x", F.explode(around).alias("k")).select(*keys, (F.col("y") + F.col("k.dy")).alias("y"), (F.col("x") + F.col("k.dx")).alias("x")).distinct().withColumn("hit", F.lit(True))
        state = state.join(near, [*keys, "y", "x"], "left").select(*keys, "y", "x", F.when((F.col("s") == 1) & F.col("hit").isNotNull(), 2).otherwise(F.col("s")).alias("s"))
    return state.select(*keys, "y", "x", (F.col("s") == 2).cast("int").alias("v"))


def fourier(values: Column, n: int) -> Column:
    """The discrete Fourier transform of an array of n structs (re, im), inside the row.

    n = q 2^m with q odd: sums over q interleaved samples come first, then m stages of butterflies, so the work is
    n (q + m). An odd n is one direct sum.
    """
    m = (n & -n).bit_length() - 1
    q, blocks = n >> m, 1 << m
    turn = lambda part, whole: -2 * math.pi * part / whole
    times = lambda a, t: F.struct((a["re"] * F.cos(t) - a["im"] * F.sin(t)).alias("re"), (a["re"] * F.sin(t) + a["im"] * F.cos(t)).alias("im"))
    plus = lambda a, b: F.struct((a["re"] + b["re"]).alias("re"), (a["im"] + b["im"]).alias("im"))
    nothing = F.struct(F.lit(0.0).alias("re"), F.lit(0.0).alias("im"))
    # block b holds the samples r, r + 2^m, ... where r is b with its m bits reversed
    order = F.array(*[F.lit(int(f"{b:0{m}b}"[::-1], 2) if m else 0) for b in range(blocks)])
    places = F.sequence(F.lit(0), F.lit(n - 1))

    def direct(p: Column) -> Column:
        r, k = F.get(order, F.floor(p / q).cast("int")), p % q
        if q == 1:
            return F.get(values, r)
        return F.aggregate(F.sequence(F.lit(0), F.lit(q - 1)), nothing, lambda s, t: plus(s, times(F.get(values, r + blocks * t), turn((k * t) % q, q))))

    def stage(a: Column, half: Column) -> Column:
        def one(p: Column) -> Column:
            at = p % (2 * half)
            j = at % half
            low, high = F.get(a, p - at + j), F.get(a, p - at + j + half)
            return plus(low, times(high, turn(at, 2 * half)))  # beyond half the turn gains a half circle, which is the minus sign

        return F.transform(places, one)

    start = F.transform(places, direct)
    return F.aggregate(F.array(*[F.lit(q << i) for i in range(m)]), start, stage) if m else start


def _filled(cells: Column, n: int) -> Column:
    """An array of n structs from (at, re, im) in any order, 0 where none stands."""
    dense = F.transform(F.array_sort(cells), lambda c: F.struct(c["re"].alias("re"), c["im"].alias("im")))
    by = F.map_from_entries(F.transform(cells, lambda c: F.struct(c["at"], F.struct(c["re"].alias("re"), c["im"].alias("im")))))
    nothing = F.struct(F.lit(0.0).alias("re"), F.lit(0.0).alias("im"))
    return F.when(F.size(cells) == n, dense).otherwise(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.try_element_at(by, i), nothing)))


def power_spectrum(px: DataFrame, ny: int, nx: int, keys: tuple[str, ...] = IMAGE) -> DataFrame:
    """log10(1 + |F|) of the 2D Fourier transform, shifted to the centre: each row is one array and is transformed in place, then each column."""

    def along(df: DataFrame, by: str, at: str, n: int) -> DataFrame:
        cell = F.struct(F.col(at).cast("int").alias("at"), "re", "im")
        rows = df.groupBy(*keys, by).agg(F.collect_list(cell).alias("cells")).select(*keys, by, _filled(F.col("cells"), n).alias("row"))
        return rows.select(*keys, by, F.posexplode(fourier(F.col("row"), n)).alias(at, "z")).select(*keys, by, at, "z.re", "z.im")

    own = px.select(*keys, "y", "x", F.coalesce(F.col("v").cast("double"), F.lit(0.0)).alias("re"), F.lit(0.0).alias("im"))
    both = along(along(own, "y", "x", nx), "x", "y", ny)
    return both.select(*keys, ((F.col("y") + ny // 2) % ny).cast("int").alias("y"), ((F.col("x") + nx // 2) % nx).cast("int").alias("x"), F.log10(1 + F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im"))).alias("v"))
