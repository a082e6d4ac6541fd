"""Bins of a stream with a range that moves, against one batch over all values."""

import math
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from beamframe.operators import stats
from beamframe.streaming import rebin


@pytest.mark.parametrize(("lo", "hi", "mode"), [(-math.inf, math.inf, "average"), (-1.0, math.inf, "accumulate"), (-2.0, 3.0, "average")])
def test_bins_are_those_of_the_whole_history(spark, lo, hi, mode):
    r = random.Random(3)
    at = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    parts = [[1.0] * 5, [], [r.uniform(0, 2) for _ in range(300)] + [None, math.nan], [r.gauss(0, 50) for _ in range(200)], [float(r.randrange(-4, 4)) for _ in range(200)]]
    handle, seen = rebin.dynamic_bins(at, "x", "y", 7, lo, hi, mode, cells=16), []
    for k, part in enumerate(parts):
        seen += [(x, float(i % 5)) for i, x in enumerate(part)]
        batch = spark.createDataFrame([(x, float(i % 5)) for i, x in enumerate(part)], "x double, y double")
        handle(batch, k)
        if k == 2:
            handle(batch, k)  # a batch that is run again changes nothing
        all_ = spark.createDataFrame(seen, "x double, y double").where(~F.isnan("x"))
        want = [tuple(v) for v in stats.bin_1d(all_, "x", "y", 7, lo, hi, mode).orderBy("bin").collect()]
        got = [tuple(v) for v in rebin.newest_bins(spark, at).orderBy("bin").collect()]
        assert got == [pytest.approx(v) for v in want], k
    assert spark.read.parquet(f"{at}/cells/batch=4").count() <= 17


def test_cells_widen_by_doubling():
    e = rebin.cell_exponent(0.0, 1.0, None, 16)
    assert 2.0**e * 16 >= 1.0 and rebin.cell_exponent(0.0, 100.0, e, 16) > e and rebin.cell_exponent(0.0, 1.0, 9, 16) == 9
    assert 2.0 ** rebin.cell_exponent(5.0, 5.0, None) > 0
