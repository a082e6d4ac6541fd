"""Projections, filters and predicates on trains and pulses. Ranges are inclusive; an infinite end is open."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beamframe.operators.stats import averaged


def select_property(raw: DataFrame, source: str, prop: str) -> DataFrame:
    """train_id, value of one property; `<property>.value` where the plain one is missing."""
    own = raw.where((F.col("source") == source) & F.col("property").isin(prop, f"{prop}.value"))
    return own.groupBy("train_id").agg(F.coalesce(F.max(F.when(F.col("property") == prop, F.col("scalar"))), F.max(F.when(F.col("property") == f"{prop}.value", F.col("scalar")))).alias("value"))


def select_modules(raw: DataFrame, pattern: str, modules: list[int]) -> DataFrame:
    """Rows of sources prefix<module>suffix for pattern "prefix*suffix", with column module; trains with one module or more are found."""
    prefix, _, suffix = pattern.partition("*")
    number = F.regexp_extract("source", f"^\\Q{prefix}\\E([0-9]+)\\Q{suffix}\\E$", 1)
    return raw.withColumn("module", F.when(number != "", number.cast("int"))).where(F.col("module").isin(modules))


def slice_bounds(n: Column, start: int | None, stop: int | None, step: int | None) -> tuple[Column, Column, int]:
    """Python's rules for start and stop of a slice of n elements."""
    step = 1 if step is None else step
    if step <= 0:
        raise ValueError("step must be positive")
    fix = lambda v: F.least(F.lit(v), n) if v >= 0 else F.greatest(n + v, F.lit(0))
    return (F.lit(0) if start is None else fix(start)), (n if stop is None else fix(stop)), step


def in_slice(i: Column, n: Column, start=None, stop=None, step=None) -> Column:
    lo, hi, by = slice_bounds(n, start, stop, step)
    return (i >= lo) & (i < hi) & ((i - lo) % by == 0)


def slice_pulses(df: DataFrame, start=None, stop=None, step=None, keys: tuple[str, ...] = ("train_id",)) -> DataFrame:
    """Pulses of the slice, numbered anew; pulse_index is the number they had. Negative ends need the train's pulse count."""
    if all(v is None or v >= 0 for v in (start, stop)):
        kept = df.where(in_slice(F.col("pulse"), F.lit(1 << 30), start, stop, step))
        lo, by = start or 0, step or 1
        return kept.withColumn("pulse_index", F.col("pulse")).withColumn("pulse", ((F.col("pulse") - lo) / by).cast("int"))
    n = F.max("pulse").over(Window.partitionBy(*keys)) + 1
    df = df.withColumn("__n", n)
    lo, _, by = slice_bounds(F.col("__n"), start, stop, step)
    return df.where(in_slice(F.col("pulse"), F.col("__n"), start, stop, step)).withColumn("pulse_index", F.col("pulse")).withColumn("pulse", ((F.col("pulse") - lo) / by).cast("int")).drop("__n")


def slice_array(arr: Column, start=None, stop=None, step=None) -> Column:
    return F.filter(arr, lambda v, i: in_slice(i, F.size(arr), start, stop, step))


def in_range(v: Column, lo: float, hi: float) -> Column:
    """NaN passes: neither comparison holds for it."""
    test = F.lit(True)
    if not math.isinf(lo):
        test = test & (v >= lo)
    if not math.isinf(hi):
        test = test & (v <= hi)
    return F.isnan(v) | test


def filter_trains(df: DataFrame, col: str, lo: float = -math.inf, hi: float = math.inf) -> DataFrame:
    return df.where(in_range(F.col(col), lo, hi))


def filter_pulses(df: DataFrame, col: str, lo: float = -math.inf, hi: float = math.inf) -> DataFrame:
    """Masks pulses (kept = kept AND in range); none is deleted."""
    kept = F.col("kept") if "kept" in df.columns else F.lit(True)
    return df.withColumn("kept", kept & in_range(F.col(col), lo, hi))


def fom_pulse_filter(fom: DataFrame, lo: float, hi: float) -> DataFrame:
    return filter_pulses(fom, "fom", lo, hi)


def fom_train_filter(fom: DataFrame, lo: float, hi: float) -> DataFrame:
    return filter_trains(fom, "fom", lo, hi)


CONTROL = ("Magnet", "Monochromator", "Motor", "User defined")


def control_filter(raw: DataFrame, catalog: DataFrame) -> DataFrame:
    """Trains where every filtered control item (catalog: category, name, property, lo, hi) is within its range; a train without the value is dropped."""
    items = catalog.where(F.col("category").isin(*CONTROL)).select(F.col("name").alias("source"), "property", "lo", "hi")
    n = items.agg(F.count_distinct("source", "property").alias("n"))
    hit = raw.join(items, ["source", "property"])
    good = hit.where(F.isnan("scalar") | F.col("scalar").between(F.col("lo"), F.col("hi"))).groupBy("train_id").agg(F.count_distinct("source", "property").alias("k"))
    # every train is good where nothing is asked
    good = raw.select("train_id").distinct().join(good, "train_id", "left").crossJoin(F.broadcast(n)).where(F.coalesce("k", F.lit(0)) == F.col("n"))
    return raw.join(good.select("train_id"), "train_id", "left_semi")


def drop_all_guard(df: DataFrame, keys: tuple[str, ...] = ("train_id",)) -> tuple[DataFrame, DataFrame]:
    """(rows of trains with a kept pulse, dropped(train_id, operator, reason))."""
    n = df.groupBy(*keys).agg(F.count_if("kept").alias("k"))
    gone = n.where("k = 0").select(*keys, F.lit("pulse filter").alias("operator"), F.lit("all pulses were dropped").alias("reason"))
    return df.join(n.where("k > 0").select(*keys), list(keys), "left_semi"), gone


DIGITIZER_CHANNELS = ("A", "B", "C", "D", "ADC")


def digitizer_pulse(df: DataFrame, channels: dict[str, str], start=None, stop=None, step=None, w: int = 1, ranges: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """(train_id, pulse, <properties>) to (train_id, channel, pulse, integral, kept) of the pulse slice; channels maps property to channel name.

    w: window of the moving average over trains for each channel and pulse. ranges: by channel, for the averaged integral.
    A pulse outside the range of any channel is masked (kept is false) in all channels of its train, and none is deleted;
    NaN and NULL are in range.
    """
    if unknown := (set(channels.values()) | set(ranges or {})) - set(DIGITIZER_CHANNELS):
        raise ValueError(f"unknown digitizer channels {sorted(unknown)}")
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(p).cast("double").alias("integral")) for p, c in channels.items()])).alias("c")
    own = averaged(slice_pulses(df.select("train_id", "pulse", pairs).select("train_id", "pulse", "c.*"), start, stop, step), ["channel", "pulse"], "integral", w)
    good = F.lit(True)
    for c, (lo, hi) in (ranges or {}).items():
        good = good & ((F.col("channel") != c) | F.coalesce(in_range(F.col("integral"), lo, hi), F.lit(True)))
    return own.withColumn("kept", F.bool_and(good).over(Window.partitionBy("train_id", "pulse")))


def mask_by_digitizer(df: DataFrame, digitizer: DataFrame) -> DataFrame:
    """df (train_id, pulse, ...) with kept = kept AND the digitizer's; pulses and trains that it lacks stay as they are."""
    own = digitizer.groupBy("train_id", "pulse").agg(F.bool_and("kept").alias("__kept"))
    kept = F.col("kept") if "kept" in df.columns else F.lit(True)
    return df.join(own, ["train_id", "pulse"], "left").withColumn("kept", kept & F.coalesce("__kept", F.lit(True))).drop("__kept")


def slice_curve(df: DataFrame, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """Points (x, y) with lo <= x <= hi; None is open."""
    return df.where((F.lit(True) if lo is None else F.col("x") >= lo) & (F.lit(True) if hi is None else F.col("x") <= hi))


def select_poi(df: DataFrame, i: int, j: int) -> tuple[DataFrame, DataFrame]:
    """(pulses i and j, errors(train_id, reason)) of each train."""
    missing = df.groupBy("train_id").agg((F.max("pulse") + 1).alias("n")).where(F.col("n") <= max(i, j)).select("train_id", F.format_string("POI index %d out of boundary [0 - %d]", F.lit(max(i, j)), F.col("n") - 1).alias("reason"))
    return df.where(F.col("pulse").isin(i, j)), missing


def squeeze(df: DataFrame, axis: str) -> DataFrame:
    """Drop an axis that has one place only, 0; a row at another place is an error. The schema doesn't hang on the data."""
    place = F.when(F.col(axis) == 0, F.col(axis)).otherwise(F.raise_error(F.lit(f"axis {axis} has more than one place")))
    return df.withColumn(axis, place).where(F.col(axis).isNotNull()).drop(axis)


def apd_stride(df: DataFrame, col: str, stride: int, n: int) -> DataFrame:
    """Every stride-th sample of an array, the first n of them; shorter arrays give status "error" and no values."""
    own = F.slice(F.filter(col, lambda v, i: i % stride == 0), 1, n)
    return df.withColumn("samples", F.when(F.size(own) >= n, own)).withColumn("status", F.when(F.size(own) >= n, "ok").otherwise("error"))


def check_modules(px: DataFrame, n_modules: int, ny: int, nx: int) -> tuple[DataFrame, DataFrame]:
    """(good trains' pixels, dropped): module shape and count (one module is allowed), and memory cells."""
    seen = px.groupBy("train_id").agg(F.count_distinct("module").alias("k"), (F.max("my") + 1).alias("ny"), (F.max("mx") + 1).alias("nx"), F.count("pulse").alias("cells"))
    reason = F.when((F.col("ny") != ny) | (F.col("nx") != nx), "module shape").when(~F.col("k").isin(1, n_modules), "module count").when(F.col("cells") == 0, "no memory cell")
    bad = seen.withColumn("reason", reason).where("reason IS NOT NULL").select("train_id", "reason")
    return px.join(bad, "train_id", "left_anti"), bad
