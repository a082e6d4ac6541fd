"""Binning of a stream whose range is that of all its values so far, without reading the history again.

What a micro-batch adds are partial sums over cells of a power-of-two width, with the least and the largest value of each
cell. When the range outgrows CELLS cells the width doubles, and two cells become one. Bins have ends where they please:
a cell whose least and largest values fall into one bin counts as a whole, and only of the others, at most one for each
inner edge, the values themselves are read, from files sorted by value.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beamframe.functions import bin_index

#: Cells of the grid; a power of two.
CELLS = 4096


def cell_exponent(lo: float, hi: float, least: int | None, cells: int = CELLS) -> int:
    """The exponent of the narrowest width, not under `least`, at which lo..hi fits the cells and cell numbers stay exact."""
    span = max(hi - lo, max(abs(lo), abs(hi)) * 2.0**-40, 2.0**-900)
    e = math.frexp(span / cells)[1]
    return e if least is None else max(e, least)


def own_range(least: float | None, most: float | None, lo: float, hi: float) -> tuple[float, float]:
    """(lo, hi) with infinite ends from the data; the rules of stats.bin_range."""
    if math.isinf(lo) and math.isinf(hi):
        if least is None:
            return 0.0, 1.0
        return (least - 0.5, most + 0.5) if least == most else (least, most)
    if math.isinf(lo):
        return (hi - 1.0 if least is None or least >= hi else least), hi
    if math.isinf(hi):
        return lo, (lo + 1.0 if most is None or most <= lo else most)
    return lo, hi


def dynamic_bins(folder: str, x: str, fom: str, n: int, lo: float = -math.inf, hi: float = math.inf, mode: str = "average", cells: int = CELLS):
    """For foreachBatch: keeps folder/cells, folder/values and folder/bins, each by batch, so that a batch that is run again overwrites its own work.

    folder/bins/batch=k holds bin, center, count, stat over all batches up to k (see newest_bins). Rows without x or fom,
    or with NaN, don't count; a batch without rows carries the state on.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        own = batch.select(F.col(x).cast("double").alias("x"), F.col(fom).cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
        own.repartitionByRange("x").sortWithinPartitions("x").write.mode("overwrite").parquet(f"{folder}/values/batch={batch_id}")
        own = spark.read.schema("x double, y double").parquet(f"{folder}/values/batch={batch_id}")
        kept = spark.read.parquet(f"{folder}/cells/batch={batch_id - 1}") if batch_id else None

        ends = own.select(F.min("x").alias("lo"), F.max("x").alias("hi"), F.lit(None).cast("int").alias("e"))
        ends = ends.unionByName(kept.select(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("e").alias("e"))) if batch_id else ends
        least, most, e = ends.agg(F.min("lo"), F.max("hi"), F.max("e")).first()
        exponent = cell_exponent(least, most, e, cells) if least is not None else 0
        width = F.lit(2.0**exponent)
        added = own.groupBy(F.floor(F.col("x") / width).alias("cell")).agg(F.count("*").alias("count"), F.sum("y").alias("total"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        if kept is not None:
            merged = kept.select(F.floor(F.col("cell") / F.pow(F.lit(2.0), F.lit(exponent) - F.col("e"))).alias("cell"), "count", "total", "lo", "hi").unionByName(added)
            added = merged.groupBy("cell").agg(F.sum("count").alias("count"), F.sum("total").alias("total"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        added.withColumn("e", F.lit(exponent)).write.mode("overwrite").parquet(f"{folder}/cells/batch={batch_id}")
        state = spark.read.parquet(f"{folder}/cells/batch={batch_id}")
        bins(spark, state, own_range(least, most, lo, hi)).write.mode("overwrite").parquet(f"{folder}/bins/batch={batch_id}")

    def bins(spark: SparkSession, state: DataFrame, ends: tuple[float, float]) -> DataFrame:
        lo_, hi_ = ends
        at = lambda c: bin_index(F.col(c), F.lit(lo_), F.lit(hi_), n)
        # a value under lo has no bin and neither has one over hi: told apart, as they may share a cell with binned values
        side = lambda c: F.coalesce(at(c), F.when(F.col(c) < lo_, -1).otherwise(n))
        marked = state.withColumns({"a": side("lo"), "b": side("hi")})
        whole = marked.where("a = b").select(F.col("a").alias("bin"), "count", "total")
        edges = [(r["lo"], r["hi"]) for r in marked.where("a < b").select("lo", "hi").collect()]  # n + 1 cells at most
        parts = whole
        if edges:
            near = " OR ".join(f"(x >= {a!r}D AND x <= {b!r}D)" for a, b in edges)
            values = spark.read.schema("x double, y double").parquet(f"{folder}/values").where(near)
            parts = whole.unionByName(values.select(side("x").alias("bin"), F.lit(1).cast("long").alias("count"), F.col("y").alias("total")))
        got = parts.where(f"bin >= 0 AND bin < {n}").groupBy("bin").agg(F.sum("count").alias("count"), F.sum("total").alias("total"))
        stat = F.col("total") / F.col("count") if mode == "average" else F.col("total")
        grid = spark.range(n).select(F.col("id").cast("int").alias("bin"), (lo_ + (F.col("id") + 0.5) * ((hi_ - lo_) / n)).alias("center"))
        return grid.join(F.broadcast(got), "bin", "left").select("bin", "center", F.coalesce("count", F.lit(0)).alias("count"), F.coalesce(stat, F.lit(0.0)).alias("stat"))

    return handle


def newest_bins(spark: SparkSession, folder: str) -> DataFrame:
    """bin, center, count, stat of the newest batch."""
    all_ = spark.read.parquet(f"{folder}/bins")
    last = all_.agg(F.max("batch").alias("batch")).first()["batch"]
    return all_.where(F.col("batch") == last).select("bin", "center", "count", "stat")
