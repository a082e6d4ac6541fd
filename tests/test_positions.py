"""Positions of a scan walked in ranges against one walk over all values."""

import random

import pyarrow as pa
import pytest

from beamframe.operators import positions


def whole(values, resolution, least, most, auto):
    closed, state = positions.walk([a for a, _ in values], [b for _, b in values], None, resolution, auto)
    if state and state[1]:
        closed.append(state[:4])
    kept = [p for p in closed if p[1] >= least][-most:]
    return [(i, p[0], p[2], p[2] - 0.5 * (p[3] / p[1]) ** 0.5, p[2] + 0.5 * (p[3] / p[1]) ** 0.5, p[1]) for i, p in enumerate(kept)]


@pytest.mark.parametrize(("auto", "most"), [(False, 3000), (True, 40)])
def test_ranges_give_what_one_walk_gives(spark, auto, most):
    r = random.Random(7)
    stairs = [(k // 9 + r.uniform(-0.2, 0.2), r.random()) for k in range(900)]
    wander, at = [], 0.0
    for _ in range(700):
        at += r.uniform(-0.4, 0.4)
        wander.append((at, r.random()))
    own = {"stairs": stairs, "wander": wander, "still": [(5.0, r.random()) for _ in range(800)], None: [(1.0, 2.0)] * 3, "one": [(1.0, 1.0)]}
    rows = [(k, i, a, b) for k, vs in own.items() for i, (a, b) in enumerate(vs)] + [("one", 9, None, 1.0)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, i long, a double, b double").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = positions.scan_points(df, ["k"], ["i"], "a", "b", 0.5, 2, most, auto).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for k, vs in own.items():
        mine = sorted(tuple(x)[1:] for x in got if x["k"] == k)
        assert mine == [pytest.approx(p) for p in whole(vs, 0.5, 2, most, auto)], k


def test_one_key_is_walked_in_many_ranges(spark):
    df = spark.range(4000).selectExpr("id AS i", "CAST(id div 10 AS DOUBLE) AS a", "CAST(id % 7 AS DOUBLE) AS b")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = positions.scan_points(df, [], ["i"], "a", "b", 0.5)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [(r["point"], r["x"], r["count"]) for r in got.orderBy("point").collect()] == [(k, float(k), 10) for k in range(400)]


def test_no_values(spark):
    df = spark.createDataFrame([], "k string, i long, a double, b double")
    assert positions.scan_points(df, ["k"], ["i"], "a", "b", 0.5).collect() == []


def test_many_keys_are_walked_by_one_task_over_batches_cut_anywhere():
    r = random.Random(9)
    own = {k: [(r.uniform(0, 2), r.random()) for _ in range(r.randint(1, 9))] for k in [None, float("nan"), *map(float, range(40))]}
    rows = [(k, 0, a, b) for k, vs in own.items() for a, b in vs]
    for size in (1, 7, len(rows)):
        batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + size], strict=True), (pa.float64(), pa.int64(), pa.float64(), pa.float64()), strict=True)], ["k", "__p", "__x", "__y"]) for i in range(0, len(rows), size)]
        got = [x for b in positions.first_walks(iter(batches), ["k", "__p"], 0.5, False) for x in b.to_pylist()]
        assert [str(x["k"]) for x in got] == [str(k) for k in own]
        for x, vs in zip(got, own.values(), strict=True):
            closed, state = positions.walk([a for a, _ in vs], [b for _, b in vs], None, 0.5, False)
            assert [tuple(p.values()) for p in x["__points"]] == closed and tuple(x["__state"].values()) == state
    assert list(positions.first_walks(iter([]), ["k", "__p"], 0.5, False)) == []
