"""Exact selection and the newest rows against sorted lists, with cells so small that several rounds run."""

import math
import random

import numpy as np
import pytest

from beamframe.operators import order, stats


def column(kind, n, seed=1):
    r = random.Random(seed)
    draw = {
        "spread": lambda: r.gauss(0, 1),
        "ties": lambda: float(r.randrange(7)),
        "one value": lambda: 3.0,
        "mostly one": lambda: 5.0 if r.random() < 0.9 else r.gauss(5, 1e-6),
        "far": lambda: math.copysign(10.0 ** r.uniform(-300, 300), r.random() - 0.5),
        "gaps": lambda: r.choice([None, math.nan, r.random(), -0.0, 0.0]),
    }[kind]
    return [draw() for _ in range(n)]


@pytest.mark.parametrize("kind", ["spread", "ties", "one value", "mostly one", "far", "gaps"])
def test_quantiles_are_those_of_a_sorted_list(spark, kind):
    few = 50_000 if kind == "gaps" else 12
    own = column(kind, 6000)
    df = spark.createDataFrame([(v,) for v in own], "v double").repartition(2)
    known = np.array([v for v in own if v is not None and not math.isnan(v)])
    qs = [0.05, 0.5, 1.0]
    got = order.quantiles(df, "v", qs, few=few).collect()
    assert len(got) == 1
    assert list(got[0]) == pytest.approx(np.quantile(known, qs).tolist(), rel=1e-12)
    got = order.quantiles(df, "v", qs, disc=True, few=few).first()
    assert list(got) == np.quantile(known, qs, method="inverted_cdf").tolist()


def test_quantiles_by_key_with_one_key_that_holds_most_rows(spark):
    own = [("hot" if i % 3 else None if i % 2 else "few", v) for i, v in enumerate(column("spread", 3000))] + [("none", None)]
    df = spark.createDataFrame(own, "a string, v double").repartition(4)
    got = {r["a"]: r["q0"] for r in order.quantiles(df, "v", [0.5], ("a",), few=50).collect()}
    assert got == {k: pytest.approx(np.median([v for a, v in own if a == k])) for k in ("hot", None, "few")}


def test_statistics_of_nothing(spark):
    empty = spark.createDataFrame([], "a string, v double")
    assert tuple(stats.compute_statistics(empty, "v").first()) == (None, None, None)
    assert stats.compute_statistics(empty, "v", ("a",)).collect() == []
    one = spark.createDataFrame([("x", None), ("y", 2.0), (None, 4.0)], "a string, v double")
    assert {tuple(r) for r in stats.compute_statistics(one, "v", ("a",)).collect()} == {("x", None, None, None), ("y", 2.0, 2.0, 0.0), (None, 4.0, 4.0, 0.0)}


@pytest.mark.parametrize("n", [1, 1000, 2990, 5000])
def test_newest_rows(spark, n):
    r = random.Random(n)
    rows = [(r.choice([None, *range(40)]), i, r.random()) for i in range(3000)]
    df = spark.createDataFrame(rows, "train_id long, pulse long, v double").repartition(4)
    got = order.newest(df, ["train_id", "pulse"], n, direct=10, few=30).collect()
    want = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1]), reverse=True)[:n]
    assert sorted(map(tuple, got), key=lambda x: x[1]) == sorted(want, key=lambda x: x[1])


def test_newest_of_rows_that_tie(spark):
    df = spark.createDataFrame([(1,)] * 50 + [(2,)] * 50, "train_id long")
    got = [r[0] for r in order.newest(df, ["train_id"], 70, direct=10, few=30).collect()]
    assert sorted(got) == [1] * 20 + [2] * 50


def test_no_task_sees_all_values(spark):
    df = spark.range(20_000).selectExpr("CAST(id AS DOUBLE) AS v")
    values = df.selectExpr("0 AS k", "v")
    got = order.select_ranks(values, lambda n: [n - 5000], False, few=100)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert got.first()["v0"] == 15_000 and "Window" not in plan and "percentile(" not in plan
