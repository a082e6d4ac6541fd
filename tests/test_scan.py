"""Moving averages against a loop, with small chunks and levels so that maps are composed over many levels."""

import math
import random

import pytest

from beamframe.operators import scan


def loop(values, w):
    out, m = [], 0.0
    for n, x in enumerate(values, 1):
        x = None if x is None or math.isnan(x) else x
        m = None if m is None or x is None else m + (x - m) / min(n, w)
        out.append(m)
    return out


@pytest.mark.parametrize(("w", "chunk", "level"), [(1, 3, 2), (2, 1, 40), (3, 7, 6), (50, 6, 20), (4000, 100, 5), (3, None, 1000)])
def test_averages_are_those_of_a_loop(spark, w, chunk, level):
    r = random.Random(w)
    own = {"hot": [r.gauss(5, 2) for _ in range(1200)], None: [r.random() for _ in range(40)], "one": [2.5], "gap": [r.random() for _ in range(30)] + [None] + [1.0] * 60, "nan": [math.nan, 1.0], "large": [1e100 * r.random() for _ in range(90)]}
    rows = [(k, i, v, f"{k}{i}", i) for k, vs in own.items() for i, v in enumerate(vs)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "a string, i long, v double, tag string, rows long").repartition(7)
    got = scan.moving_average(df, ["a"], ["i"], "v", w, chunk, level)
    assert got.columns == ["a", "i", "v", "tag", "rows", "avg"]
    by = {(x["a"], x["i"]): x["avg"] for x in got.collect()}
    assert len(by) == len(rows)
    for k, vs in own.items():
        want = loop(vs, w)
        for i, m in enumerate(want):
            assert by[k, i] == (None if m is None else pytest.approx(m, rel=1e-9)), (k, i)


def test_one_key_is_worked_on_by_several_tasks(spark):
    df = spark.range(40_000).selectExpr("id AS train_id", "CAST(id % 17 AS DOUBLE) AS v")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = scan.moving_average(df, [], ["train_id"], "v", 3)
        assert got.selectExpr("spark_partition_id() AS p").distinct().count() == 4
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = loop([float(i % 17) for i in range(40_000)], 3)
    assert {r["train_id"]: r["avg"] for r in got.collect()} == {i: pytest.approx(m) for i, m in enumerate(want)}


def test_level_starts(spark):
    maps = [(k, 1.0, float(k)) for k in range(0, 100, 3)]
    df = spark.createDataFrame(maps, "__k long, __a double, __b double")
    got = {r["__k"]: r["__start"] for r in scan.level_starts(df, [], 99, 4).collect()}
    assert got == {k: float(sum(range(0, k, 3))) for k in range(0, 100, 3)}


def test_empty_table(spark):
    df = spark.createDataFrame([], "a string, i long, v double")
    assert scan.moving_average(df, ["a"], ["i"], "v", 3).collect() == []


def test_calibration_averages_before_slice_and_masks(spark):
    from beamframe.operators import image

    px = spark.createDataFrame([(t, p, 0, 0, v + p) for t, v in enumerate([1.0, 5.0, 1.0, 1.0]) for p in (0, 1)], "train_id long, pulse int, y int, x int, v double")
    got = image.calibrate(px, None, None, slicer=(1, None, None), lo=0.0, hi=4.0, w=2).orderBy("train_id").collect()
    assert [(r["pulse"], r["v"]) for r in got] == [(0, 2.0), (0, 4.0), (0, 3.0), (0, 2.5)]
    got = image.calibrate(px.where("pulse = 0"), None, None, lo=0.0, hi=2.5, w=2).orderBy("train_id").collect()
    assert [r["v"] for r in got] == [1.0, None, 2.0, 1.5]


def test_a_digitizer_channel_masks_the_pulse_of_the_whole_train(spark):
    from beamframe.operators import filters

    df = spark.createDataFrame([(1, 0, 1.0, 9.0), (1, 1, 6.0, 9.0), (1, 2, math.nan, None)], "train_id long, pulse int, a double, b double")
    got = filters.digitizer_pulse(df, {"a": "A", "b": "B"}, ranges={"A": (5.0, math.inf)})
    assert {(r["channel"], r["pulse"]): r["kept"] for r in got.collect()} == {(c, p): p > 0 for c in "AB" for p in range(3)}
    images = spark.createDataFrame([(1, p, 0, 0, float(p)) for p in range(4)] + [(2, 0, 0, 0, 1.0)], "train_id long, pulse int, y int, x int, v double")
    kept = {(r["train_id"], r["pulse"]): r["kept"] for r in filters.mask_by_digitizer(images, got).collect()}
    assert kept == {(1, 0): False, (1, 1): True, (1, 2): True, (1, 3): True, (2, 0): True}
    with pytest.raises(ValueError, match="unknown"):
        filters.digitizer_pulse(df, {"a": "A"}, ranges={"Z": (0.0, 1.0)})


@pytest.mark.parametrize(("w", "chunk", "level"), [(2, 3, 2), (6, 2, 3), (40, 7, 32)])
def test_averages_of_arrays_are_those_of_their_elements(spark, w, chunk, level):
    r = random.Random(w)
    own = {"hot": [[r.random(), None if i == 90 else r.random(), 1.0] for i in range(150)], None: [[1.0, math.nan, 3.0], [2.0, 2.0, 2.0]], "one": [[4.0, 5.0, 6.0]]}
    rows = [(k, i, v, f"{k}{i}") for k, vs in own.items() for i, v in enumerate(vs)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "a string, i long, v array<double>, tag string").repartition(5)
    got = scan.moving_average_vectors(df, ["a"], ["i"], "v", w, chunk, level)
    assert got.columns == ["a", "i", "v", "tag", "avg"]
    by = {(x["a"], x["i"]): (x["tag"], x["avg"]) for x in got.collect()}
    assert len(by) == len(rows)
    for k, vs in own.items():
        for e in range(3):
            for i, m in enumerate(loop([v[e] for v in vs], w)):
                assert by[k, i][0] == f"{k}{i}" and by[k, i][1][e] == (None if m is None else pytest.approx(m)), (k, i, e)


def test_averages_have_the_bits_of_a_loop(spark):
    r = random.Random(20)
    own = {k: [round(r.uniform(15, 25), 2) for _ in range(r.randint(1, 30))] for k in range(400)}
    df = spark.createDataFrame([(k, i, v) for k, vs in own.items() for i, v in enumerate(vs)], "k long, i long, v double").coalesce(1)
    spark.conf.set("spark.sql.shuffle.partitions", "1")  # one range: no key is cut
    try:
        got = {(x["k"], x["i"]): x["avg"] for x in scan.moving_average(df, ["k"], ["i"], "v", 5).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == {(k, i): m for k, vs in own.items() for i, m in enumerate(loop(vs, 5))}
