"""Statistics over trains: binning, histograms, correlation, moving averages, stop-and-scan points."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from beamframe.functions import bin_edge, bin_index, nan_to_null
from beamframe.operators.order import newest, quantiles
from beamframe.operators.positions import scan_points
from beamframe.operators.scan import moving_average
from beamframe.scratch import written


def compute_statistics(df: DataFrame, col: str, keys: tuple[str, ...] = (), exact: bool = True) -> DataFrame:
    """mean, median, population std; NULL for no value. The exact median is selected in rounds, as no task may hold all values of a key."""
    v = nan_to_null(F.col(col).cast("double"))
    if not exact:
        return df.groupBy(*keys).agg(F.avg(v).alias("mean"), F.percentile_approx(v, 0.5).alias("median"), F.stddev_pop(v).alias("std"))
    own = written(df.select(*keys, v.alias("__v")), "values")
    moments = own.groupBy(*keys).agg(F.avg("__v").alias("mean"), F.stddev_pop("__v").alias("std"))
    median = quantiles(own, "__v", [0.5], keys)
    if not keys:
        return moments.crossJoin(F.broadcast(median)).select("mean", F.col("q0").alias("median"), "std")
    both = moments.alias("l").join(median.alias("u"), [F.col(f"l.{k}").eqNullSafe(F.col(f"u.{k}")) for k in keys], "left")
    return both.select(*[f"l.{k}" for k in keys], "mean", F.col("u.q0").alias("median"), "std")


def bin_range(df: DataFrame, col: str, lo: float, hi: float) -> DataFrame:
    """One row (lo, hi): an infinite end comes from the data; no data, equal ends and wrong sides get unit widths."""
    least, most = F.min(col), F.max(col)
    if math.isinf(lo) and math.isinf(hi):
        a = F.when(least.isNull(), 0.0).when(least == most, least - 0.5).otherwise(least)
        b = F.when(least.isNull(), 1.0).when(least == most, most + 0.5).otherwise(most)
    elif math.isinf(lo):
        a, b = F.when(least.isNull() | (least >= hi), hi - 1.0).otherwise(least), F.lit(float(hi))
    elif math.isinf(hi):
        a, b = F.lit(float(lo)), F.when(most.isNull() | (most <= lo), lo + 1.0).otherwise(most)
    else:
        a, b = F.lit(float(lo)), F.lit(float(hi))
    return df.agg(a.cast("double").alias("lo"), b.cast("double").alias("hi"))


def _binned(df: DataFrame, col: str, n: int, lo: float, hi: float, out: str) -> tuple[DataFrame, DataFrame]:
    """df with column out (bin or NULL), and the one-row range."""
    if not (math.isinf(lo) or math.isinf(hi)):
        return df.withColumn(out, bin_index(F.col(col), F.lit(float(lo)), F.lit(float(hi)), n)), df.sparkSession.range(1).select(F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi"))
    edges = bin_range(df, col, lo, hi)
    return df.crossJoin(F.broadcast(edges.select(F.col("lo").alias("__lo"), F.col("hi").alias("__hi")))).withColumn(out, bin_index(F.col(col), F.col("__lo"), F.col("__hi"), n)).drop("__lo", "__hi"), edges


def _grid(edges: DataFrame, n: int, name: str) -> DataFrame:
    """name (bin), center, one row for each bin."""
    rows = edges.select("lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name))
    return rows.select(name, ((bin_edge(F.col("lo"), F.col("hi"), n, F.col(name)) + bin_edge(F.col("lo"), F.col("hi"), n, F.col(name) + 1)) / 2).alias("center"))


def bin_1d(df: DataFrame, x: str, fom: str, n: int, lo: float = -math.inf, hi: float = math.inf, mode: str = "average") -> DataFrame:
    """bin, center, count, stat (0 for an empty bin)."""
    own, edges = _binned(df.where(F.col(fom).isNotNull() & F.col(x).isNotNull()), x, n, lo, hi, "bin")
    stat = F.avg(fom) if mode == "average" else F.sum(fom)
    got = own.where("bin IS NOT NULL").groupBy("bin").agg(F.count("*").alias("count"), stat.alias("stat"))
    return _grid(edges, n, "bin").join(got, "bin", "left").select("bin", "center", F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("stat", F.lit(0.0)).alias("stat"))


def bin_1d_vector(df: DataFrame, x: str, vec: str, n: int, lo: float, hi: float, mode: str = "average") -> DataFrame:
    """bin, i (place in the vector), heat. Vectors of the newest length only count, as a change of length clears the history."""
    size = df.agg(F.max_by(F.size(vec), "train_id").alias("__size"))
    own = df.crossJoin(F.broadcast(size)).where(F.size(vec) == F.col("__size")).select(x, F.posexplode(vec).alias("i", "v"))
    own, _ = _binned(own, x, n, lo, hi, "bin")
    return own.where("bin IS NOT NULL").groupBy("bin", "i").agg((F.avg("v") if mode == "average" else F.sum("v")).alias("heat"))


def bin_2d(df: DataFrame, x1: str, x2: str, fom: str, n1: int, n2: int, range1: tuple[float, float], range2: tuple[float, float], mode: str = "average") -> DataFrame:
    """bin2, bin1, count, stat over the whole grid."""
    own, e1 = _binned(df, x1, n1, *range1, "bin1")
    own, e2 = _binned(own, x2, n2, *range2, "bin2")
    got = own.where("bin1 IS NOT NULL AND bin2 IS NOT NULL").groupBy("bin2", "bin1").agg(F.count("*").alias("count"), (F.avg(fom) if mode == "average" else F.sum(fom)).alias("stat"))
    grid = _grid(e2, n2, "bin2").select("bin2").crossJoin(F.broadcast(_grid(e1, n1, "bin1").select("bin1")))
    return grid.join(got, ["bin2", "bin1"], "left").select("bin2", "bin1", F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("stat", F.lit(0.0)).alias("stat"))


def spectrum_1d(df: DataFrame, x: str, y: str, n: int, lo: float = -math.inf, hi: float = math.inf, nan_to_num: bool = False) -> DataFrame:
    """bin, center, mean, count; the mean of an empty bin is NULL (0 with nan_to_num)."""
    out = bin_1d(df, x, y, n, lo, hi)
    return out.select("bin", "center", (F.col("stat") if nan_to_num else F.when(F.col("count") > 0, F.col("stat"))).alias("mean"), "count")


def histogram(df: DataFrame, col: str, n: int = 10, lo: float = -math.inf, hi: float = math.inf) -> DataFrame:
    """bin, center, count over values in range; NaN is no value."""
    inside, edges = _inside(df, col, n, lo, hi)
    return _grid(edges, n, "bin").join(inside.groupBy("bin").agg(F.count("*").alias("count")), "bin", "left").select("bin", "center", F.coalesce("count", F.lit(0)).alias("count"))


def _inside(df: DataFrame, col: str, n: int, lo: float, hi: float) -> tuple[DataFrame, DataFrame]:
    own = df.select(nan_to_null(F.col(col).cast("double")).alias("v")).where("v IS NOT NULL")
    own, edges = _binned(own, "v", n, lo, hi, "bin")
    return own.where("bin IS NOT NULL"), edges


def hist_with_stats(df: DataFrame, col: str, n: int = 10, lo: float = -math.inf, hi: float = math.inf) -> tuple[DataFrame, DataFrame]:
    """(bin, center, count), (mean, median, std) over values in range; NaN is no value."""
    return histogram(df, col, n, lo, hi), compute_statistics(_inside(df, col, n, lo, hi)[0], "v")


def hist_by(df: DataFrame, col: str, keys: list[str], n: int, lo: float, hi: float) -> DataFrame:
    """keys, bin, count of a fixed range for each of keys (a train, a train and pulse of interest): only bins with values."""
    own = df.withColumn("bin", bin_index(nan_to_null(F.col(col).cast("double")), F.lit(float(lo)), F.lit(float(hi)), n)).where("bin IS NOT NULL")
    return own.groupBy(*keys, "bin").agg(F.count("*").alias("count"))


def fom_histogram(df: DataFrame, n: int, lo: float, hi: float, last: int = 2_304_000, pulse_resolved: bool = False, pump_probe: bool = False) -> tuple[DataFrame, DataFrame]:
    """Histogram of the last FOMs, of trains or pulses."""
    if pulse_resolved and pump_probe:
        raise ValueError("pulse-resolved histograms have no pump-probe form")
    order = ["train_id", "pulse"] if pulse_resolved else ["train_id"]
    return hist_with_stats(last_n(df, [], order, last), "fom", n, lo, hi)


def poi_histogram(df: DataFrame, poi: int, n: int, lo: float = -math.inf, hi: float = math.inf) -> tuple[DataFrame, DataFrame]:
    return hist_with_stats(df.where(F.col("pulse") == poi), "fom", n, lo, hi)


def quick_min_max(df: DataFrame, col: str, q: float = 1.0) -> DataFrame:
    """min and max, or the q and 1 - q quantiles as values of the data."""
    if q >= 1.0:
        v = nan_to_null(F.col(col))
        return df.agg(F.min(v).alias("lo"), F.max(v).alias("hi"))
    q = max(q, 1 - q)
    return quantiles(df, col, [round(1 - q, 12), q], disc=True).select(F.col("q0").alias("lo"), F.col("q1").alias("hi"))


def last_n(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The newest n rows (of each key). Without keys a top-k, or for many rows a cut at the rank, replaces the window, which one task would sort."""
    if not keys:
        return newest(df, order, n)
    desc = [F.col(c).desc() for c in order]
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*desc))).where(F.col("__r") <= n).drop("__r")


def correlation(fom: DataFrame, slow: DataFrame, n: int = 3000) -> DataFrame:
    """The newest n pairs (train_id, x, y [, y_slave])."""
    own = fom.join(slow, "train_id").where("x IS NOT NULL AND y IS NOT NULL")
    return last_n(own, [], ["train_id"], n)


def processing_rate(df: DataFrame, keys: list[str]) -> DataFrame:
    """1 / (time since the row before), per key."""
    order = Window.partitionBy(*keys).orderBy("ts", "train_id")
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    dt = at - F.lag(at).over(order)
    return df.withColumn("rate", F.when(dt > 0, 1 / dt))


def averaged(df: DataFrame, keys: list[str], col: str, w: int) -> DataFrame:
    """df with col replaced by its moving average over trains, window w, for each of keys; 1 leaves it as it is."""
    if w <= 1:
        return df
    return moving_average(df, keys, ["train_id"], col, w).select(*[F.col("avg").alias(c) if c == col else F.col(c) for c in df.columns])


def scan_step(state: list | None, x: float, y: float, resolution: float) -> tuple[list, bool]:
    """(state with this value, whether it opened a position); state: [x mean, count, y mean, sum of squares]."""
    if state is None or abs(x - state[0]) > resolution:
        return [x, 1, y, 0.0], True
    n = state[1] + 1
    mean = state[2] + (y - state[2]) / n
    return [state[0] + (x - state[0]) / n, n, mean, state[3] + (y - state[2]) * (y - mean)], False


def trace(df: DataFrame, col: str, n: int) -> DataFrame:
    """A slow value against trains, the newest n."""
    return last_n(df.select("train_id", col), [], ["train_id"], n)
