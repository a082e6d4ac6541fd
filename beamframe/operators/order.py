"""Exact order statistics without a sort of the whole column, and the newest rows without one.

A rank is looked for in ever smaller cells. A sketch of each group gives cut points near the rank; values below the cell
are counted, values inside it go on, and the rest is out. A round leaves about 3 values in a thousand; as soon as a cell
holds FEW values, they are sorted. A cell's ends are settled by their counts, so a value that many rows hold goes no
further. No task sees more than FEW values of a group, and each round is a written table.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beamframe.functions import nan_to_null
from beamframe.scratch import written

GRID, ACCURACY = 1000, 10_000
#: Values of a cell that are sorted at once.
FEW = 50_000


def _sorted_few(rows: DataFrame, want: DataFrame, by: list[str], t: int, bounded: Callable) -> DataFrame:
    """(by, v0, v1, ...) of groups with few values."""
    held = rows.join(bounded(want), by).groupBy(*by).agg(F.array_sort(F.collect_list("v")).alias("all"), *[F.first(f"r{i}").alias(f"r{i}") for i in range(t)])
    return held.select(*by, *[F.get("all", F.col(f"r{i}").cast("int")).alias(f"v{i}") for i in range(t)])


def _narrowed(rows: DataFrame, want: DataFrame, by: list[str], t: int, bounded: Callable) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One round over groups with many values: found (by, t, v), what is left of rows (by, t, v), and want (by, t, n, r0) for it."""
    sketch = rows.groupBy(*by).agg(F.min("v").alias("least"), F.max("v").alias("most"), F.percentile_approx("v", [i / GRID for i in range(1, GRID)], ACCURACY).alias("cuts"))
    place = lambda i: F.floor(F.col(f"r{i}") / F.col("n") * GRID).cast("int")
    low = lambda i: F.when(place(i) >= 2, F.get("cuts", place(i) - 2)).otherwise(F.col("least"))
    high = lambda i: F.coalesce(F.get("cuts", place(i) + 1), F.col("most"))
    cells = written(want.join(bounded(sketch), by).select(*by, "n", *[x for i in range(t) for x in (F.col(f"r{i}"), low(i).alias(f"lo{i}"), high(i).alias(f"hi{i}"))]), "cells")
    met = rows.join(bounded(cells), by)
    inside = lambda i: (F.col("v") > F.col(f"lo{i}")) & (F.col("v") < F.col(f"hi{i}"))
    tests = lambda i: {"b": F.col("v") < F.col(f"lo{i}"), "l": F.col("v") == F.col(f"lo{i}"), "m": inside(i), "h": F.col("v") == F.col(f"hi{i}")}
    counts = met.groupBy(*by).agg(*[F.count_if(x).alias(f"{c}{i}") for i in range(t) for c, x in tests(i).items()])
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col(f"lo{i}").alias("lo"), F.col(f"hi{i}").alias("hi"), (F.col(f"r{i}") - F.col(f"b{i}")).alias("r"), F.col(f"l{i}").alias("l"), F.col(f"m{i}").alias("m"), F.col(f"h{i}").alias("h")) for i in range(t)]))
    own = "t" if "t" in by else "c.t"
    after = cells.join(bounded(counts), by).select(*by, each.alias("c")).select("k", F.col(own).alias("t"), "c.lo", "c.hi", "c.r", "c.l", "c.m", "c.h")
    lost = F.when((F.col("r") < 0) | (F.col("r") >= F.col("l") + F.col("m") + F.col("h")), F.raise_error(F.lit("a sketch missed its rank")).cast("long"))
    # the ends of a cell are settled here, so values that many rows hold never go on
    at = F.when(F.col("r") < F.col("l"), F.col("lo")).when(F.col("r") >= F.col("l") + F.col("m"), F.col("hi"))
    after = written(after.withColumn("r", F.coalesce(lost, F.col("r"))).withColumn("v", at), "ranks")
    if t > 1:
        left = met.select("k", "v", F.explode(F.filter(F.array(*[F.when(inside(i), F.lit(i)) for i in range(t)]), lambda x: x.isNotNull())).alias("t"))
    else:
        left = met.where(inside(0)).select("k", "v", (F.col("t") if "t" in by else F.lit(0)).alias("t"))
    open_ = after.where("v IS NULL").select("k", "t", F.col("m").alias("n"), (F.col("r") - F.col("l")).alias("r0"))
    return after.where("v IS NOT NULL").select("k", "t", "v"), written(left.join(bounded(open_.select("k", "t")), ["k", "t"], "left_semi"), "values"), open_


def select_ranks(values: DataFrame, ranks: Callable[[Column], list[Column]], keyed: bool = True, few: int = FEW) -> DataFrame:
    """values (k, v) to (k, n, v0, v1, ...): the n values of each k, and those at ranks(n), counted from 0. NULL is no value.

    keyed=False: there is one k, so what is known of it is sent to all tasks; else it is joined.
    """
    bounded = (lambda df: df) if keyed else F.broadcast
    rows = written(values.where("v IS NOT NULL").select("k", "v"), "values")
    t = len(ranks(F.lit(0)))
    want = written(rows.groupBy("k").agg(F.count("*").alias("n")).select("k", "n", *[r.cast("long").alias(f"r{i}") for i, r in enumerate(ranks(F.col("n")))]), "ranks")
    done = _sorted_few(rows, want.where(F.col("n") <= few), ["k"], t, bounded)
    many = want.where(F.col("n") > few)
    if not many.isEmpty():
        found, rows, left = _narrowed(rows, many, ["k"], t, bounded)
        all_ = [found]
        while not left.isEmpty():
            all_.append(_sorted_few(rows, left.where(F.col("n") <= few), ["k", "t"], 1, bounded).select("k", "t", F.col("v0").alias("v")))
            left = left.where(F.col("n") > few)
            if left.isEmpty():
                break
            found, rows, left = _narrowed(rows, left, ["k", "t"], 1, bounded)
            all_.append(found)
        each = reduce(DataFrame.unionByName, all_).groupBy("k").agg(*[F.max(F.when(F.col("t") == i, F.col("v"))).alias(f"v{i}") for i in range(t)])
        done = done.unionByName(each)
    return want.select("k", "n").join(bounded(done), "k")


def _key(keys: tuple[str, ...]) -> Column:
    return F.struct(*keys) if keys else F.lit(0)


def quantiles(df: DataFrame, col: str, qs: list[float], keys: tuple[str, ...] = (), disc: bool = False, few: int = FEW) -> DataFrame:
    """keys, q0, q1, ... : exact quantiles, between the neighbours by weight, or with disc the first value that so many rows reach.

    NULL and NaN are no values; without keys there is one row, with NULLs if there is no value, and a key without values
    has no row.
    """
    v = nan_to_null(F.col(col)) if dict(df.dtypes)[col] in ("double", "float") else F.col(col)
    values = df.select(_key(keys).alias("k"), v.alias("v"))
    if disc:
        ranks = lambda n: [F.greatest(F.ceil(F.round(n * q, 6)) - 1, F.lit(0)) for q in qs]
        out = lambda i: F.col(f"v{i}")
    else:
        at = lambda n, q: F.round((n - 1) * F.lit(float(q)), 9)
        ranks = lambda n: [x for q in qs for x in (F.floor(at(n, q)), F.ceil(at(n, q)))]
        part = lambda q: at(F.col("n"), q) - F.floor(at(F.col("n"), q))
        out = lambda i: F.col(f"v{2 * i}") + (F.col(f"v{2 * i + 1}") - F.col(f"v{2 * i}")) * part(qs[i])
    got = select_ranks(values, ranks, bool(keys), few)
    if not keys:
        got = df.sparkSession.range(1).select(F.lit(0).alias("k")).join(F.broadcast(got), "k", "left")
    return got.select(*[F.col(f"k.{c}").alias(c) for c in keys], *[out(i).alias(f"q{i}") for i in range(len(qs))])


def newest(df: DataFrame, order: list[str], n: int, direct: int = 100_000, few: int = FEW) -> DataFrame:
    """The n rows that come last by order; NULLs come first. Of rows with equal order any.

    Up to `direct` rows are a top-k. Beyond, the value that holds the rank is found column by column: what lies above it
    is a filter, and only rows that tie with it are cut further. Nothing is sorted but a cell of values.
    """
    if n <= direct:
        return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)
    values = written(df.select(*order), "order")
    if values.count() <= n:
        return df
    kept, tied, left = F.lit(False), F.lit(True), n
    for c in order:
        own = values.where(tied)
        known = own.where(F.col(c).isNotNull()).count()
        if known <= left:
            kept, tied, left = kept | (tied & F.col(c).isNotNull()), tied & F.col(c).isNull(), left - known
        else:
            cut = select_ranks(own.select(F.lit(0).alias("k"), F.col(c).alias("v")), lambda m, left=left: [m - left], False, few).first()["v0"]
            above = own.where(F.col(c) > F.lit(cut)).count()
            kept, tied, left = kept | (tied & (F.col(c) > F.lit(cut))), tied & (F.col(c) == F.lit(cut)), left - above
        if not left:
            return df.where(F.coalesce(kept, F.lit(False)))
        if values.where(tied).count() == left:
            return df.where(F.coalesce(kept | tied, F.lit(False)))
    return df.where(F.coalesce(kept, F.lit(False))).unionAll(df.where(tied).limit(left))
