"""Expectations on tiny tables: edges, ranges, order-dependent rules."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from beamframe import functions as fn
from beamframe import sources as src
from beamframe.operators import azimuthal, correlate, filters, image, pumpprobe, roi, scan, stats
from beamframe.plans import recipes

INF = math.inf


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def pairs(spark, xs, ys=None):
    ys = ys if ys is not None else xs
    return spark.createDataFrame([("k", i, float(x), float(y)) for i, (x, y) in enumerate(zip(xs, ys, strict=True))], "key string, train_id long, x double, fom double")


def test_bin_counts_and_last_edge(spark):
    df = pairs(spark, range(10))
    assert [r[2] for r in rows(stats.bin_1d(df, "x", "fom", 4, 0.0, 8.0), "bin")] == [2, 2, 2, 3]


@pytest.mark.parametrize("xs,lo,hi,want", [([0.1], -INF, INF, (-0.4, 0.6)), ([0.1, 0.2], -INF, INF, (0.1, 0.2)), ([0.1, 0.2], 0.3, INF, (0.3, 1.3)), ([0.1, 0.2], -INF, 0.0, (-1.0, 0.0)), ([], -INF, INF, (0.0, 1.0)), ([], 2.0, INF, (2.0, 3.0)), ([1.0], 0.0, 4.0, (0.0, 4.0))])
def test_dynamic_ranges(spark, xs, lo, hi, want):
    assert tuple(stats.bin_range(pairs(spark, xs), "x", lo, hi).collect()[0]) == pytest.approx(want)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(-50, 50), min_size=1, max_size=40), st.integers(1, 9))
def test_bins_hold_every_point_in_range(spark, xs, n):
    got = stats.bin_1d(pairs(spark, xs), "x", "fom", n, -20.0, 20.0)
    want = np.histogram(xs, bins=n, range=(-20, 20))[0]
    assert [r[2] for r in rows(got, "bin")] == want.tolist()


def test_nan_histogram(spark):
    df = spark.createDataFrame([(v,) for v in (float("nan"), 1.0, 2.0, 3.0, 6.0, float("nan"))], "v double")
    hist, stat = stats.hist_with_stats(df, "v", 4, 1.0, 3.0)
    assert [r[2] for r in rows(hist, "bin")] == [1, 0, 1, 1]
    assert tuple(stat.collect()[0]) == pytest.approx((2.0, 2.0, math.sqrt(2 / 3)))


def test_fom_histogram_golden(spark):
    df = pairs(spark, [10, 20, 30, 40, 20, 30, 20, 10, 40, 10])
    hist, _ = stats.fom_histogram(df, 5, -INF, INF)
    assert [(r[1], r[2]) for r in rows(hist, "bin")] == [(13, 3), (19, 3), (25, 0), (31, 2), (37, 2)]


def test_moving_average(spark):
    got = rows(stats.moving_average(pairs(spark, [1, 2, 3]), ["key"], ["train_id"], "x", 5).select("train_id", "avg"), "train_id")
    assert [v for _, v in got] == [1.0, 1.5, 2.0]


def test_moving_average_across_chunks_and_nulls(spark, monkeypatch):
    monkeypatch.setattr(scan, "CHUNK", 7)
    xs = np.random.default_rng(0).random(60).tolist()
    want, m = [], 0.0
    for i, x in enumerate(xs, 1):
        m = x if i == 1 else m + (x - m) / min(i, 5)
        want.append(m)
    got = rows(stats.moving_average(pairs(spark, xs), ["key"], ["train_id"], "x", 5).select("train_id", "avg"), "train_id")
    assert [v for _, v in got] == pytest.approx(want)
    df = pairs(spark, xs).withColumn("x", F.when(F.col("train_id") != 10, F.col("x")))
    got = rows(stats.moving_average(df, ["key"], ["train_id"], "x", 5).select("train_id", "avg"), "train_id")
    assert got[9][1] is not None and all(v is None for _, v in got[10:])


def test_scan_points_golden(spark):
    df = pairs(spark, [1, 2, 2.02, 2.10, 2.31, 2.40], [0.3, 0.4, 0.5, 0.6, 1, 2])
    got = stats.scan_points(df, ["key"], ["train_id"], "x", "fom", 0.1).collect()
    assert (got[0].y_avg, got[0].y_min, got[0].y_max, got[0]["count"]) == pytest.approx((0.5, 0.4591751709536137, 0.5408248290463863, 3))
    assert got[1]["count"] == 2 and got[1].y_avg == pytest.approx(1.5)


def test_scan_auto_reset(spark):
    xs = [1, 2, 5, 6, 7, 8, 1]
    df = pairs(spark, xs)
    seen = [[p.y_avg for p in stats.scan_points(df.where(f"train_id < {k}"), ["key"], ["train_id"], "x", "fom", 2.0, auto_reset=True).collect()] for k in range(1, 8)]
    assert seen == [[], [], [], [], [6.5], [7.0], [7.0]]


def test_pulse_ranges(spark):
    df = spark.createDataFrame([(1, i, float(i)) for i in range(10)], "train_id long, pulse int, v double")
    kept = lambda d: [r.pulse for r in d.where("kept").orderBy("pulse").collect()]
    a = filters.filter_pulses(df, "v", 3, 6)
    b = filters.filter_pulses(a, "v", -INF, 5)
    assert kept(a) == [3, 4, 5, 6] and kept(b) == [3, 4, 5] and kept(filters.filter_pulses(b, "v", 5, INF)) == [5]
    nan = spark.createDataFrame([(1, float("nan"))], "train_id long, v double")
    assert filters.filter_trains(nan, "v", 0, 1).count() == 1


@settings(max_examples=25, deadline=None)
@given(st.one_of(st.none(), st.integers(-6, 6)), st.one_of(st.none(), st.integers(-6, 6)), st.one_of(st.none(), st.integers(1, 3)))
def test_slices_follow_python(spark, start, stop, step):
    df = spark.createDataFrame([(1, i) for i in range(5)], "train_id long, pulse int")
    got = [r.pulse_index for r in filters.slice_pulses(df, start, stop, step).orderBy("pulse").collect()]
    assert got == list(range(5))[start:stop:step]


def test_emission_rule(spark):
    seq = [(1001, "a"), (1002, "a"), (1003, "a"), (1003, "b"), (1002, "b"), (1004, "b"), (1004, "a")]
    df = spark.createDataFrame([(i, t, s) for i, (t, s) in enumerate(seq)], "seq long, train_id long, source string")
    assert [r.train_id for r in correlate.correlate_ordered(df, ["a", "b"]).orderBy("train_id").collect()] == [1003, 1004]


def test_on_on_off_pairs(spark):
    t = lambda ids: spark.createDataFrame([(i,) for i in ids], "train_id long")
    assert rows(correlate.pair_on_off(t([1002, 1003, 1005, 1006]), "odd_on"), "train_off") == [(1006, 1005)]
    assert rows(correlate.pair_on_off(t([2, 3, 5, 6, 7]), "even_on"), "train_off") == [(3, 2), (7, 6)]
    lost = spark.createDataFrame([(2, True), (4, False), (5, True)], "train_id long, has_on boolean")
    assert rows(correlate.pair_on_off(lost, "even_on"), "train_off") == [(5, 2)]


def pixels(spark, arr, keys="train_id"):
    out = [(*((t,) if arr.ndim == 3 else (t // 100, t % 100)), y, x, float(v)) for t, im in enumerate(arr) for (y, x), v in np.ndenumerate(im)]
    return spark.createDataFrame(out, "train_id long, y int, x int, v double").withColumn("v", F.when(~F.isnan("v"), F.col("v")))


def test_masks_and_photons(spark):
    px = pixels(spark, np.array([[[1.0, 2.0], [float("nan"), 4.0]]]))
    assert [r.v for r in image.mask_threshold(px, 2, 3).orderBy("y", "x").collect()] == [None, 2.0, None, None]
    assert [r.v for r in image.mask_threshold(px, 2, 3, False).orderBy("y", "x").collect()] == [0.0, 2.0, 0.0, 0.0]
    assert [r.v for r in image.bin_photons(px, 3.0).orderBy("y", "x").collect()] == [0.0, 1.0, None, 1.0]


def test_assembly_round_trip(spark):
    tiles = [{"module": 0, "my0": 0, "mx0": 0, "h": 2, "w": 3, "y0": 2.4, "x0": -1.6, "y1": 0.4, "x1": 1.4}, {"module": 1, "my0": 0, "mx0": 0, "h": 2, "w": 3, "y0": 2.4, "x0": 4.4, "y1": 4.4, "x1": 1.4}]
    table = image.pixel_map(tiles)
    assert len({(y, x) for *_, y, x in table}) == 12 and min(y for *_, y, _ in table) >= 0
    geo = spark.createDataFrame(table, "module int, my int, mx int, y int, x int")
    px = spark.createDataFrame([(1, m, y, x, float(m * 10 + y * 3 + x)) for m in (0, 1) for y in (0, 1) for x in (0, 1, 2)], "train_id long, module int, my int, mx int, v double")
    back = image.dismantle(image.assemble(px, geo), geo)
    assert rows(back.select(*px.columns), "module", "my", "mx") == rows(px, "module", "my", "mx")


def test_fourier_against_numpy(spark):
    im = np.random.default_rng(1).random((4, 6))
    got = np.zeros((4, 6))
    for r in image.power_spectrum(pixels(spark, im[None]), 4, 6).collect():
        got[r.y, r.x] = r.v
    assert np.allclose(got, np.log10(1 + np.abs(np.fft.fftshift(np.fft.fft2(im)))))


def test_edges_of_a_square(spark):
    im = np.zeros((12, 12))
    im[4:8, 4:8] = 10
    on = {(r.y, r.x) for r in image.edge_detect(pixels(spark, im[None]), 3, 1.0, 1.0, 5.0, 12, 12).where("v = 1").collect()}
    assert on and (5, 5) not in on or (0, 0) not in on


def test_roi_and_normalizers(spark):
    px = pixels(spark, np.arange(16.0).reshape(1, 4, 4))
    got = roi.roi_fom(px, {1: (-1, -1, 3, 3), 2: (3, 3, 9, 9)}, 4, 4, "sum", "div").collect()[0]
    assert got.fom == pytest.approx((0 + 1 + 4 + 5) / 15)
    assert roi.roi_fom(px, {1: (0, 0, -1, 2)}, 4, 4).collect()[0].fom is None
    fom = spark.createDataFrame([(1, 4.0), (2, 4.0), (3, 4.0)], "train_id long, fom double")
    norm = spark.createDataFrame([(1, 2.0), (2, 0.0)], "train_id long, norm double")
    assert rows(roi.normalize(fom, norm).select("train_id", "fom", "status"), "train_id") == [(1, 2.0, "ok"), (2, None, "normalizer is zero"), (3, None, "normalizer is not available")]
    curve = spark.createDataFrame([(1, 0.0, 1.0), (1, 1.0, 3.0), (1, 2.0, 5.0), (2, 0.0, 0.0), (2, 1.0, 0.0)], "train_id long, x double, y double")
    assert [round(r[2], 6) for r in rows(roi.normalize_auc(curve), "train_id", "x")] == [round(v / 6, 6) for v in (1, 3, 5)] + [0, 0]


def test_pump_probe_modes(spark):
    px = spark.createDataFrame([(t, p, 0, 0, float(10 * t + p)) for t in (2, 3, 4) for p in range(4)], "train_id long, pulse int, y int, x int, v double")
    assert rows(pumpprobe.same_train(px, (0, None, 2), (1, None, 2)).where("train_id = 2"), "train_id") == [(2, 0, 0, 21.0, 22.0)]
    assert rows(pumpprobe.reference_as_off(px, (0, 2, None)).where("train_id = 2"), "train_id") == [(2, 0, 0, 20.5, 0.0)]
    assert rows(pumpprobe.alternating_trains(px, (None, None, None), (None, None, None)), "train_id") == [(3, 0, 0, 21.5, 31.5)]
    with pytest.raises(ValueError):
        pumpprobe.same_train(px, (0, None, 2), (0, None, 1))


def test_peaks_against_a_plain_search(spark):
    ys = [0, 1, 0, 3, 3, 1, 2, 0, 5, 4, 4.5, 0]
    curve = spark.createDataFrame([(1, i, i / 10, float(v)) for i, v in enumerate(ys)], "train_id long, bin int, q double, i double")
    got = rows(azimuthal.find_peaks(curve, 0.1).select("bin", "i", "prominence"), "bin")
    assert got == [(1, 1.0, 1.0), (3, 3.0, 3.0), (6, 2.0, 1.0), (8, 5.0, 5.0), (10, 4.5, 0.5)]
    assert azimuthal.find_peaks(curve, 0.1, most=3).count() == 0


def test_ring_center(spark):
    y, x = np.mgrid[:21, :21]
    im = (np.abs(np.hypot(y - 11, x - 9) - 5) < 0.6) * 1.0
    got = azimuthal.find_center(pixels(spark, im[None]), 10, 10, 21, 21, 2, 10).collect()[0]
    assert (got.cy, got.cx) == (11, 9)


def test_curve_fits(spark):
    xs = np.linspace(-3, 3, 40)
    data = [("g", float(x), float(2 * np.exp(-((x - 0.5) ** 2) / 2 / 0.64) + 1)) for x in xs]
    df = spark.createDataFrame(data, "key string, x double, y double")
    p = recipes.curve_fit(df, ["key"], "gaussian", (1.5, 0.3, 1.0, 0.5)).collect()[0]
    assert [p.p0, p.p1, abs(p.p2), p.p3] == pytest.approx([2, 0.5, 0.8, 1], abs=1e-2)
    cubic = spark.createDataFrame([("c", float(x), float(x**3 - 2 * x + 1)) for x in xs], "key string, x double, y double")
    assert [*recipes.curve_fit(cubic, ["key"], "cubic").collect()[0]][1:] == pytest.approx([1, 0, -2, 1], abs=1e-6)
    assert recipes.curve_fit(df.limit(1), ["key"], "linear").count() == 0


def test_xas_threshold(spark):
    df = spark.createDataFrame([(t, i, 700.0 + t, float(i), -float(i), 0.1) for t in (1, 2) for i in range(10)], "train_id long, pulse int, energy double, i0 double, i1_A double, current double")
    got = recipes.xas_tim(df, 7.0, 1, channels=("A",)).collect()[0]
    assert got["count"] == 4 and got.i0 == 8.5 and got.s_A == pytest.approx(0.0)


def test_erf(spark):
    df = spark.createDataFrame([(float(v),) for v in (-2, -0.5, 0, 0.3, 1.7)], "x double").select("x", fn.erf(F.col("x")).alias("y"))
    assert all(abs(r.y - math.erf(r.x)) < 2e-7 for r in df.collect())


def test_run_info_of_nothing(spark):
    assert tuple(src.run_info(spark.createDataFrame([], "train_id long")).collect()[0]) == (0, -1, -1)


def test_constants_are_checked(spark):
    with pytest.raises(ValueError):
        src.check_constants(spark.createDataFrame([(0, 0, 0, 1.0), (0, 1, 1, 1.0)], "cell int, y int, x int, v double"))


def test_the_later_arrival_wins_among_equal_times(spark):
    df = spark.createDataFrame([(1, "a", 5, 0, 9.0), (1, "a", 5, 1, 2.0), (1, "b", 5, 2, 1.0)], "train_id long, source string, ts long, seq long, scalar double")
    assert [tuple(r) for r in correlate.correlate(df, ["a", "b"]).collect()] == [(1, 2.0, 1.0)]


def test_a_ragged_reference_is_refused(spark, tmp_path):
    rows = [(y, x, 1.0) for y in range(2) for x in range(3)]
    for k, own in enumerate((rows, rows[:-1] + [rows[0]], rows[:4])):
        spark.createDataFrame(own, "y int, x int, v double").write.parquet(f"{tmp_path}/{k}")
    assert src.load_reference(spark, f"{tmp_path}/0").count() == 6
    for k in (1, 2):
        with pytest.raises(ValueError, match="rectangle"):
            src.load_reference(spark, f"{tmp_path}/{k}")


def test_xmcd_takes_every_pulse_without_a_window(spark):
    rows = [(t, 0, float(t % 40), 20.0, -float(1 + t % 7), 0.05 if t % 2 else -0.05) for t in range(400)]
    df = spark.createDataFrame(rows, "train_id long, pulse int, energy double, i0 double, i1_A double, current double")
    shown = lambda window: sorted(tuple(r) for r in recipes.xas_xmcd(df, 10.0, 0.015, 4, window).collect())
    assert shown(None) == shown(400) != shown(100)
