"""Work inside array rows: Fourier transform, peak bases, ring centres, against NumPy and plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from beamframe.operators import azimuthal, image


@pytest.mark.parametrize(("ny", "nx"), [(2, 1), (3, 5), (6, 7), (8, 8), (12, 20)])
def test_power_spectrum_of_any_size(spark, ny, nx):
    v = np.random.default_rng(nx).normal(size=(2, ny, nx))
    gap = (1, ny - 1, 0)  # a pixel without a row counts as 0, as a masked one does
    rows = [(t, y, x, float(v[t, y, x])) for t in range(2) for y in range(ny) for x in range(nx) if (t, y, x) != gap]
    v[gap] = 0
    got = image.power_spectrum(spark.createDataFrame(rows, "train_id long, y int, x int, v double").repartition(3), ny, nx)
    want = np.log10(1 + np.abs(np.fft.fftshift(np.fft.fft2(v), axes=(1, 2))))
    by = {(r["train_id"], r["y"], r["x"]): r["v"] for r in got.collect()}
    assert len(by) == 2 * ny * nx
    assert all(by[t, y, x] == pytest.approx(want[t, y, x], abs=1e-9) for t, y, x in by)


def plain_peaks(v, least):
    out = []
    a = 0
    while a < len(v):
        b = a
        while b + 1 < len(v) and v[b + 1] == v[a]:
            b += 1
        if 0 < a and b + 1 < len(v) and v[a - 1] < v[a] > v[b + 1]:
            mid = (a + b) // 2
            left, right = mid, mid
            while left >= 0 and v[left] <= v[mid]:
                left -= 1
            while right < len(v) and v[right] <= v[mid]:
                right += 1
            prominence = v[mid] - max(min(v[left + 1 : mid + 1]), min(v[mid:right]))
            if prominence >= least:
                out.append((mid, prominence))
        a = b + 1
    return out


def test_peaks_are_those_of_plain_walks(spark):
    r = random.Random(4)
    curves = [[float(r.randrange(6)) for _ in range(r.randrange(1, 60))] for _ in range(40)] + [[float(i) for i in range(80)], [float(-i) for i in range(80)], [1.0] * 9]
    rows = [(t, k, k / 2, v) for t, c in enumerate(curves) for k, v in enumerate(c)]
    r.shuffle(rows)
    got = azimuthal.find_peaks(spark.createDataFrame(rows, "train_id long, bin int, q double, i double"), 2.0, 1000)
    assert sorted((x["train_id"], x["bin"], x["prominence"]) for x in got.collect()) == [(t, k, p) for t, c in enumerate(curves) for k, p in plain_peaks(c, 2.0)]
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange") <= 2 and "Join" not in plan


def test_centre_of_a_ring(spark):
    ny = nx = 24
    at = {1: (11, 13), 2: (14, 10)}
    rows = [(t, y, x, 1.0 if round(np.hypot(y - cy, x - cx)) == 6 else None if (y + x) % 11 == 0 else 0.0) for t, (cy, cx) in at.items() for y in range(ny) for x in range(nx)]
    df = spark.createDataFrame(rows, "train_id long, y int, x int, v double")
    got = {r["train_id"]: (r["cy"], r["cx"], r["peak"]) for r in azimuthal.find_center(df, 12.0, 12.0, ny, nx, 4, 20).collect()}
    assert got == {t: (float(cy), float(cx), 1.0) for t, (cy, cx) in at.items()}
    assert "Generate" not in azimuthal.find_center(df, 12.0, 12.0, ny, nx, 4)._jdf.queryExecution().executedPlan().toString()
    assert azimuthal.find_center(df.where(F.lit(False)), 12.0, 12.0, ny, nx).collect() == []


def test_array_layout_needs_no_exchange(spark):
    from beamframe.operators import frames

    nan = float("nan")
    df = frames.frames(spark.createDataFrame([(1, [1.0, nan, 3.0, -4.0, 5.0, 6.0]), (2, [nan] * 6)], "train_id long, d array<double>"), "d")
    d = F.col("data")
    out = df.select("train_id", frames.threshold(d, 0.0, 5.0).alias("a"), frames.threshold(d, 0.0, 5.0, False).alias("b"), frames.mask(d, F.array(*[F.lit(i % 2 == 0) for i in range(6)])).alias("c"), frames.nan_mask(d).alias("n"), *[frames.reduce(d, h).alias(h) for h in ("sum", "mean", "min", "max", "count", "var")], frames.projection(d, (1, 0, 5, 2), 2, 3, "x").alias("p"), frames.region(d, (2, 1, 9, 9), 2, 3).alias("r"))
    a, b = (tuple(r)[1:] for r in out.orderBy("train_id").collect())
    assert a == ([1.0, None, 3.0, None, 5.0, None], [1.0, 0.0, 3.0, 0.0, 5.0, 0.0], [None, None, None, -4.0, None, 6.0], [False, True, False, False, False, False], 11.0, 2.2, -4.0, 6.0, 5, pytest.approx(12.56), [5.0, 9.0], [6.0])
    assert b == ([None] * 6, [0.0] * 6, [None] * 6, [True] * 6, 0.0, None, None, None, 0, None, [0.0, 0.0], [None])
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert frames.region(d, (9, 9, 1, 1), 2, 3) is None
