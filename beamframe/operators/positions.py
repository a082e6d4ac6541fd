"""Positions of a stop-and-scan run: a rule on the order of values, walked in ranges at the same time.

What a value does depends on the position that is open when it comes. Each range of a key is first walked as if nothing
were open before it; then it gets the state that the range before it ended with, and is walked again if that differs from
what it was given. As soon as both walks open a position at the same value they agree from there on, so a range's end
seldom changes and two rounds are the rule. When no range is given another state than before, all walks are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from beamframe.operators.scan import PLACE, range_numbers
from beamframe.scratch import written

#: What a walk gives besides its keys and range: the state it was given, the state at its end, the positions it closed.
STATE = "struct<x:double,n:bigint,y:double,s:double,skipped:boolean>"
POINTS = "array<struct<x:double,n:bigint,y:double,s:double>>"


def walk(xs: list[float], ys: list[float], state: tuple | None, resolution: float, auto_reset: bool) -> tuple[list[tuple], tuple | None]:
    """(positions that were closed, open state after the values); a position: x mean, count, y mean, sum of squares; the state has a flag more: the last value only reset."""
    x, n, y, s, skipped = state or (0.0, 0, 0.0, 0.0, False)
    closed = []
    for a, b in zip(xs, ys, strict=True):
        fresh = n == 0 or abs(a - x) > resolution
        if auto_reset:
            if fresh and not skipped:
                skipped = True
                continue
            skipped = False
        if fresh:
            if n:
                closed.append((x, n, y, s))
            x, n, y, s = a, 1, b, 0.0
        else:
            n += 1
            x += (a - x) / n
            before, y = y, y + (b - y) / n
            s += (b - before) * (b - y)
    return closed, ((x, n, y, s, skipped) if n or skipped else None)


def _positions(closed: list[list[tuple]]) -> pa.Array:
    """Lists of positions as an array of lists of structs."""
    parts = zip(("x", "n", "y", "s"), (pa.float64(), pa.int64(), pa.float64(), pa.float64()), strict=True)
    fields = [(name, pa.array([p[i] for own in closed for p in own], kind)) for i, (name, kind) in enumerate(parts)]
    ends = np.cumsum([0, *map(len, closed)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([v for _, v in fields], [k for k, _ in fields]))


def first_walks(batches: Iterator[pa.RecordBatch], at: list[str], resolution: float, auto_reset: bool) -> Iterator[pa.RecordBatch]:
    """Rows in the order of `at` and place to one row for each of `at`, walked as if nothing were open before it.

    A task walks what it holds batch by batch, so many short keys cost no call each, and a long one is never held whole.
    """
    state_kind = pa.struct([("x", pa.float64()), ("n", pa.int64()), ("y", pa.float64()), ("s", pa.float64()), ("skipped", pa.bool_())])
    same = lambda a, b: all(x == y or (x != x and y != y) for x, y in zip(a, b, strict=True))
    key, state, closed, kinds = None, None, [], []

    def shown(walks: list[tuple]) -> pa.RecordBatch:
        names = ("x", "n", "y", "s", "skipped")
        columns = [pa.array([w[0][i] for w in walks], kind) for i, kind in enumerate(kinds)]
        states = pa.array([None if w[1] is None else dict(zip(names, w[1], strict=True)) for w in walks], state_kind)
        return pa.RecordBatch.from_arrays([*columns, pa.nulls(len(walks), state_kind), states, _positions([w[2] for w in walks])], [*at, "__given", "__state", "__points"])

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        columns = [batch.column(c) for c in at]
        kinds = [c.type for c in columns]
        starts = np.zeros(n, bool)
        starts[0] = True
        for c in columns:
            codes = c.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
            starts[1:] |= codes[1:] != codes[:-1]
        places = np.flatnonzero(starts).tolist()
        xs, ys = batch.column("__x").to_pylist(), batch.column("__y").to_pylist()
        keys = list(zip(*[c.take(pa.array(places)).to_pylist() for c in columns], strict=True))
        done = []
        for own, a, b in zip(keys, places, [*places[1:], n], strict=True):
            if key is None or not same(key, own):
                if key is not None:
                    done.append((key, state, closed))
                key, state, closed = own, None, []
            more, state = walk(xs[a:b], ys[a:b], state, resolution, auto_reset)
            closed += more
        if done:
            yield shown(done)
    if key is not None:
        yield shown([(key, state, closed)])


def scan_points(df: DataFrame, keys: list[str], order: list[str], x: str, y: str, resolution: float, min_count: int = 2, max_len: int = 3000, auto_reset: bool = False) -> DataFrame:
    """keys, point, x, y_avg, y_min, y_max (half a standard deviation to either side), count of each position of a scan.

    A value further than resolution from the position's mean opens a new position; one with fewer than min_count values
    is discarded. auto_reset: the first value of a new position only resets and is not taken. NULLs are left out.
    """
    if resolution <= 0:
        raise ValueError("resolution must be positive")
    own = df.select(*keys, *order, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y")).where("__x IS NOT NULL AND __y IS NOT NULL")
    rows = range_numbers(own, keys, order).select(*keys, F.shiftright("__id", PLACE).alias("__p"), "__id", "__x", "__y")
    at = [*keys, "__p"]
    kinds = dict(rows.dtypes)
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in at], f"`__given` {STATE}", f"`__state` {STATE}", f"`__points` {POINTS}"])

    def step(key: tuple, frame: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("__id")
        before = given["__given"].iloc[0]
        before = tuple(before[c] for c in ("x", "n", "y", "s", "skipped")) if before is not None else None
        closed, state = walk(frame["__x"].tolist(), frame["__y"].tolist(), before, resolution, auto_reset)
        shown = lambda v, names: None if v is None else dict(zip(names, v, strict=True))
        row = [*key, shown(before, ("x", "n", "y", "s", "skipped")), shown(state, ("x", "n", "y", "s", "skipped")), [shown(p, ("x", "n", "y", "s")) for p in closed]]
        return pd.DataFrame([row], columns=[*at, "__given", "__state", "__points"])

    def walked(rows: DataFrame, given: DataFrame) -> DataFrame:
        return written(rows.groupBy(*at).cogroup(given.groupBy(*at)).applyInPandas(step, schema), "walks")

    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"u.{k}")) for k in at]
    ordered = rows.repartition("__p").sortWithinPartitions("__id").select(*at, "__x", "__y")
    walks = written(ordered.mapInArrow(lambda batches: first_walks(batches, at, resolution, auto_reset), schema), "walks")
    before = Window.partitionBy(*keys).orderBy("__p")
    while True:
        asked = walks.withColumn("__asked", F.lag("__state").over(before)).where(~F.col("__asked").eqNullSafe(F.col("__given"))).select(*at, F.col("__asked").alias("__given"))
        asked = written(asked, "asked")
        if asked.isEmpty():
            break
        again = walked(rows.alias("l").join(asked.alias("u"), same, "left_semi"), asked)
        walks = written(walks.alias("l").join(again.alias("u"), same, "left_anti").unionByName(again), "walks")

    newest = Window.partitionBy(*keys).orderBy(F.col("__p").desc())
    ends = walks.withColumn("__last", F.row_number().over(newest) == 1)
    open_ = F.when(F.col("__last") & (F.col("__state.n") > 0), F.array(F.struct("__state.x", "__state.n", "__state.y", "__state.s"))).otherwise(F.array().cast(POINTS))
    each = ends.select(*at, F.posexplode(F.concat("__points", open_)).alias("__i", "p")).where(F.col("p.n") >= min_count)
    back = Window.partitionBy(*keys).orderBy(F.col("__p").desc(), F.col("__i").desc())
    kept = each.withColumn("__r", F.row_number().over(back)).where(F.col("__r") <= max_len)
    half = 0.5 * F.sqrt(F.col("p.s") / F.col("p.n"))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("__r").desc())) - 1
    return kept.select(*keys, number.cast("long").alias("point"), F.col("p.x").alias("x"), F.col("p.y").alias("y_avg"), (F.col("p.y") - half).alias("y_min"), (F.col("p.y") + half).alias("y_max"), F.col("p.n").alias("count"))
