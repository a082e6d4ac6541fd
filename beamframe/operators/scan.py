"""Moving averages as a scan of affine maps in levels, so that one key of any length is worked on by many tasks.

A step m -> a m + b is an affine map, and maps compose. Rows are dealt to ranges by (keys, order) and numbered by their
place in the range, so no task sorts a whole key. Rows that follow each other are cut into chunks. Chunks are composed to
one map each, a thousand of these to one map of the next level, and so on; the start values then come down the same levels,
and the rows of a key in a range are walked step by step from there. A key in one range so has the very bits of a plain
loop, which counts where an average meets a filter's limit; where a key goes on in another range, its start there may
differ from the loop's in the last bits, which a few times w steps undo.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from beamframe.functions import nan_to_null
from beamframe.scratch import written

#: Maps of one level that are folded in a row.
LEVEL = 1000
#: Most rows of a chunk.
CHUNK = 10_000
#: Bits for the place in a range, as monotonically_increasing_id() has them.
PLACE = 33


def _same(a: str, b: str, keys: list[str]) -> list[Column]:
    return [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]


def range_numbers(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """df as a written table with column __id that rises with (keys, order); rows of a range of it stand in one task's reach."""
    ordered = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    return written(ordered.withColumn("__id", F.monotonically_increasing_id()), "ranges")


def level_starts(heads: DataFrame, keys: list[str], most: int, level: int = LEVEL) -> DataFrame:
    """heads (keys, __k, __a, __b), maps in the order of __k, 0 <= __k <= most, to (keys, __k, __start): the value before each, from 0 on.

    __b is a number, or an array that is mapped element by element. __start is NULL behind a map whose __b is NULL.
    """
    many = dict(heads.dtypes)["__b"].startswith("array")
    follow = (lambda m, h: F.zip_with(m, h["b"], lambda x, y: x * h["a"] + y)) if many else (lambda m, h: m * h["a"] + h["b"])
    may_be_null = lambda v: F.when(F.size("__h") > 0, v)  # noqa: E731  what is folded keeps the type of its first value, non-null included
    each = (lambda v: F.transform(v, may_be_null)) if many else may_be_null
    zero = F.transform(F.get("__h", F.lit(0))["b"], lambda v: may_be_null(F.lit(0.0))) if many else may_be_null(F.lit(0.0))
    ordered = F.array_sort(F.collect_list(F.struct(F.col("__k").alias("k"), F.col("__a").alias("a"), F.col("__b").alias("b")))).alias("__h")
    grouped = heads.withColumn("__g", F.floor(F.col("__k") / level)).groupBy(*keys, "__g").agg(ordered)
    if most < level:
        own = grouped.withColumn("__from", zero)
    else:
        both = F.aggregate("__h", F.struct(may_be_null(F.lit(1.0)).alias("a"), zero.alias("b")), lambda s, h: F.struct((s["a"] * h["a"]).alias("a"), follow(s["b"], h).alias("b")))
        grouped = written(grouped.withColumn("__both", both), "maps")
        up = level_starts(grouped.select(*keys, F.col("__g").alias("__k"), F.col("__both.a").alias("__a"), F.col("__both.b").alias("__b")), keys, most // level, level)
        own = grouped.alias("l").join(up.alias("u"), [*_same("l", "u", keys), F.col("l.__g") == F.col("u.__k")]).select("l.*", F.col("u.__start").alias("__from"))
    none = F.array().cast("array<array<double>>" if many else "array<double>")
    init = F.struct(each(F.col("__from")).alias("m"), none.alias("starts"))
    starts = F.aggregate("__h", init, lambda s, h: F.struct(follow(s["m"], h).alias("m"), F.concat(s["starts"], F.array(s["m"])).alias("starts")), lambda s: s["starts"])
    return own.select(*keys, F.explode(F.arrays_zip("__h", starts.alias("s"))).alias("__z")).select(*keys, F.col("__z.__h.k").alias("__k"), F.col("__z.s").alias("__start"))


def _beside(rows: DataFrame, chunks: DataFrame, at: list[str]) -> DataFrame:
    return rows.alias("l").join(chunks.alias("u"), _same("l", "u", at)).select("l.*", *[f"u.{c}" for c in chunks.columns if c not in at])


def _chunked(rows: DataFrame, keys: list[str], size: int, level: int) -> tuple[DataFrame, DataFrame, Callable]:
    """rows (of range_numbers) with their chunk (keys, __p, __q); the chunks with __first, __rows, __k and __before, the number of the key's rows before; and a function that adds the start values of a scan over chunks."""
    rows = rows.select("*", F.shiftright("__id", PLACE).alias("__p"), F.floor(F.col("__id").bitwiseAND((1 << PLACE) - 1) / size).alias("__q"))
    counts = written(rows.groupBy(*keys, "__p", "__q").agg(F.count("*").alias("__rows"), F.min("__id").alias("__first")), "chunks")
    last_p, last_q = (v or 0 for v in counts.agg(F.max("__p"), F.max("__q")).first())
    most = (last_p + 1) * (last_q + 1) - 1

    def with_start(chunks: DataFrame, a: Column, b: Column, name: str, level: int) -> DataFrame:
        before = level_starts(chunks.select(*keys, "__k", a.alias("__a"), b.alias("__b")), keys, most, level)
        joined = chunks.alias("l").join(before.alias("u"), [*_same("l", "u", keys), F.col("l.__k") == F.col("u.__k")])
        return written(joined.select("l.*", F.col("u.__start").alias(name)), "chunks")

    # the number of rows before a chunk is a scan too: m -> m + rows
    sizes = counts.withColumn("__k", F.col("__p") * (last_q + 1) + F.col("__q"))
    return rows, with_start(sizes, F.lit(1.0), F.col("__rows").cast("double"), "__before", level), with_start


def moving_average(df: DataFrame, keys: list[str], order: list[str], col: str, w: int, chunk: int | None = None, level: int = LEVEL) -> DataFrame:
    """df with column avg: m += (x - m) / c, c = 1..w and then w. A NULL or NaN makes all later averages NULL.

    The rows are written in ranges, then read to count the chunks, to compose them, and to walk them from their starts.
    """
    if w < 1:
        raise ValueError("the window must be positive")
    x = nan_to_null(F.col(col).cast("double"))
    rows = range_numbers(df, keys, order).withColumn("__x", x)
    if w == 1:  # the value itself, up to the first NULL
        bad = rows.where("__x IS NULL").groupBy(*keys).agg(F.min("__id").alias("__bad")).withColumnsRenamed({k: f"__{k}" for k in keys})
        out = rows.join(bad, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], "left") if keys else rows.crossJoin(F.broadcast(bad))
        return out.select(*df.columns, F.when(F.col("__bad").isNull() | (F.col("__id") < F.col("__bad")), F.col("__x")).alias("avg"))

    keep = (w - 1) / w
    size = chunk or min(CHUNK, max(1, int(400 / -math.log(keep))))  # weights inside a chunk stay above e^-400
    rows, chunks, with_start = _chunked(rows, keys, size, level)
    at = [*keys, "__p", "__q"]

    n, s = F.col("__before") + (F.col("__id") - F.col("__first")) + 1, F.col("__before") + 1
    step = lambda n: F.least(n, F.lit(float(w)))
    # the product of the factors of rows s + 1 to n: s / n up to w, then keep^(n - w)
    power = lambda k: F.pow(F.lit(keep), k)
    ratio = lambda n: F.when(n <= w, s / n).when(s > w, power(n - s)).otherwise(s / w * power(n - w))
    first = (step(s) - 1) / step(s)  # the factor of the chunk's first row; 0 for the key's first
    share, last = F.col("__x") / step(n), s + F.col("__rows") - 1
    joined = lambda r, c: _beside(r, c, at)
    heads = joined(rows.select(*at, "__id", "__x"), chunks).groupBy(*at).agg(F.sum(share * ratio(last) / ratio(n)).alias("__b"), F.max(first * ratio(last)).alias("__a"), F.count_if(F.col("__x").isNull()).alias("__bad"))
    heads = joined(chunks, heads)
    chunks = with_start(heads, F.col("__a"), F.when(F.col("__bad") == 0, F.col("__b")), "__start", level)

    # a key's chunks inside a range are walked on; only where a range begins with it the start value is taken
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = joined(rows, chunks).repartitionById(parts, F.col("__p").cast("int")).sortWithinPartitions("__id")
    own = own.select(*df.columns, F.col("__x"), step(n).alias("__c"), ((F.col("__id") == F.col("__first")) & ((F.col("__q") == 0) | (F.col("__before") == 0))).alias("__head"), F.col("__start"))
    width = len(df.columns)
    return own.mapInArrow(lambda batches: walked(batches, width), StructType([*df.schema.fields, StructField("avg", DoubleType())]))


def walked(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """The first n columns and avg, of rows in order with __x, __c, __head (a key begins in its range) and __start, the value before it."""
    m = None
    for batch in batches:
        out = []
        for x, c, head, start in zip(*[batch.column(n + i).to_pylist() for i in range(4)], strict=True):
            if head:
                m = start
            m = None if m is None or x is None else m + (x - m) / c
            out.append(m)
        yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(out, pa.float64())], [*batch.schema.names[:n], "avg"])


def moving_average_vectors(df: DataFrame, keys: list[str], order: list[str], col: str, w: int, chunk: int = 32, level: int = 32) -> DataFrame:
    """df with column avg, the moving average of arrays of one length, element by element, as moving_average has it of numbers.

    A chunk is some rows and is walked in place; its map is a factor and an array. Long arrays are best cut into tiles
    first (frames.moving_average), so that a chunk stays small.
    """
    x = F.transform(col, lambda v: nan_to_null(v.cast("double")))
    rows, chunks, with_start = _chunked(range_numbers(df, keys, order).withColumn("__x", x), keys, chunk, LEVEL)
    at = [*keys, "__p", "__q"]
    whole = written(rows.groupBy(*at).agg(F.array_sort(F.collect_list(F.struct("__id", "__x", F.struct(*[c for c in df.columns if c not in keys]).alias("rest")))).alias("__h")), "walks")
    whole = _beside(whole, chunks, at)
    number = lambda r: F.col("__before") + (r["__id"] - F.col("__first")) + 1
    c = lambda r: F.least(number(r), F.lit(float(w)))
    step = lambda m, r: F.when(number(r) == 1, r["__x"]).otherwise(F.zip_with(m, r["__x"], lambda a, b: a + (b - a) / c(r)))
    zeros = F.transform(F.get("__h", F.lit(0))["__x"], lambda v: F.when(F.size("__h") > 0, 0.0))  # may hold NULL, as what is folded does
    maps = whole.select(*chunks.columns, F.aggregate("__h", F.lit(1.0), lambda s, r: s * (c(r) - 1) / c(r)).alias("__a"), F.aggregate("__h", zeros, step).alias("__b"))
    starts = with_start(written(maps, "maps"), F.col("__a"), F.col("__b"), "__start", level)
    init = F.struct(F.transform("__start", lambda v: F.when(F.size("__h") > 0, v)).alias("m"), F.array().cast("array<array<double>>").alias("out"))
    run = F.aggregate("__h", init, lambda s, r: F.struct(step(s["m"], r).alias("m"), F.concat(s["out"], F.array(step(s["m"], r))).alias("out")), lambda s: s["out"])
    done = _beside(whole.select(*at, "__h", "__before", "__first"), starts.select(*at, "__start"), at)
    each = done.select(*keys, F.explode(F.arrays_zip("__h", run.alias("avg"))).alias("__z"))
    return each.select(*[F.col(c) if c in keys else F.col(f"__z.__h.rest.{c}").alias(c) for c in df.columns], F.col("__z.avg").alias("avg"))
