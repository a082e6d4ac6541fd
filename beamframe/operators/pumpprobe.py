"""Pump-probe: on and off pulse groups, their pairing, and train means."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from beamframe.operators.correlate import pair_on_off
from beamframe.operators.filters import in_slice
from beamframe.operators.stats import averaged

Slice = tuple[int | None, int | None, int | None]


def on_off_pulses(df: DataFrame, on: Slice, off: Slice) -> DataFrame:
    """Columns is_on and is_off: slices of the sliced pulse list, less dropped pulses."""
    plain = all(v is None or v >= 0 for s in (on, off) for v in s[:2])
    n = F.lit(1 << 30) if plain else F.max("pulse").over(Window.partitionBy("train_id")) + 1
    kept = F.col("kept") if "kept" in df.columns else F.lit(True)
    df = df.withColumn("__n", n)
    return df.withColumn("is_on", kept & in_slice(F.col("pulse"), F.col("__n"), *on)).withColumn("is_off", kept & in_slice(F.col("pulse"), F.col("__n"), *off)).drop("__n")


def on_off_means(px: DataFrame, on: Slice, off: Slice) -> DataFrame:
    """train_id, y, x, on, off: mean images of the groups in one aggregate."""
    df = on_off_pulses(px, on, off)
    return df.groupBy("train_id", "y", "x").agg(F.avg(F.when(F.col("is_on"), F.col("v"))).alias("on"), F.avg(F.when(F.col("is_off"), F.col("v"))).alias("off"), F.count_if("is_on").alias("n_on"), F.count_if("is_off").alias("n_off"), F.count_if(F.col("is_on") & F.col("is_off")).alias("n_both"))


def overlap_errors(pulses: DataFrame, on: Slice, off: Slice) -> DataFrame:
    """train_id, reason of trains with a pulse in both groups."""
    both = on_off_pulses(pulses, on, off).where("is_on AND is_off")
    return both.select("train_id").distinct().withColumn("reason", F.lit("on and off pulses overlap"))


def same_train(px: DataFrame, on: Slice, off: Slice) -> DataFrame:
    """Mode same train: both groups of one train; trains without one of them are dropped. Overlapping groups are an error of the train, which has no rows (overlap_errors names it); groups that begin with the same pulse overlap in every train and are refused at once."""
    if (on[0] or 0) == (off[0] or 0):
        raise ValueError("on and off pulses overlap")
    return on_off_means(px, on, off).where("n_on > 0 AND n_off > 0 AND n_both = 0").select("train_id", "y", "x", "on", "off")


def reference_as_off(px: DataFrame, on: Slice, reference: DataFrame | None = None) -> DataFrame:
    """Mode reference as off: off is the reference image, or zeros."""
    df = on_off_means(px, on, (0, 0, 1)).where("n_on > 0").select("train_id", "y", "x", "on")
    if reference is None:
        return df.withColumn("off", F.lit(0.0))
    return df.join(reference.select("y", "x", F.col("v").alias("off")), ["y", "x"], "left").withColumn("off", F.coalesce("off", F.lit(0.0))).select("train_id", "y", "x", "on", "off")


def alternating_trains(px: DataFrame, on: Slice, off: Slice, mode: str = "even_on") -> DataFrame:
    """Modes even-on and odd-on by train ID parity: the result has the off train's ID."""
    means = on_off_means(px, on, off)
    trains = means.groupBy("train_id").agg((F.max("n_on") > 0).alias("has_on"), (F.max("n_off") > 0).alias("has_off"))
    pairs = pair_on_off(trains, mode)
    a = means.select(F.col("train_id").alias("train_on"), "y", "x", "on").join(pairs, "train_on")
    b = means.select(F.col("train_id").alias("train_off"), "y", "x", "off")
    return a.join(b, ["train_off", "y", "x"]).select(F.col("train_off").alias("train_id"), "y", "x", "on", "off")


def pump_probe(px: DataFrame, mode: str, on: Slice = (None, None, None), off: Slice = (None, None, None), reference: DataFrame | None = None) -> DataFrame:
    if mode == "reference_as_off":
        return reference_as_off(px, on, reference)
    return same_train(px, on, off) if mode == "same_train" else alternating_trains(px, on, off, mode)


def intensities(pulses: DataFrame, cols: list[str], on: Slice, off: Slice) -> DataFrame:
    """Means of pulse intensities over the on and the off group: <col>_on, <col>_off."""
    df = on_off_pulses(pulses, on, off)
    return df.groupBy("train_id").agg(*[F.avg(F.when(F.col(f"is_{g}"), F.col(c))).alias(f"{c}_{g}") for c in cols for g in ("on", "off")])


def train_mean(px: DataFrame, on: Slice, off: Slice) -> DataFrame:
    """Mean of kept pulses; where on and off together are all pulses, the mean of their two means."""
    kept = F.col("kept") if "kept" in px.columns else F.lit(True)
    df = on_off_pulses(px, on, off)
    got = df.groupBy("train_id", "y", "x").agg(F.avg(F.when(F.col("is_on"), F.col("v"))).alias("a"), F.avg(F.when(F.col("is_off"), F.col("v"))).alias("b"), F.avg(F.when(kept, F.col("v"))).alias("m"), F.bool_and(F.col("is_on") | F.col("is_off")).alias("whole"), F.count_if("is_on").alias("n"), F.count_if("is_off").alias("k"))
    two = F.when(F.col("a").isNull(), F.col("b")).when(F.col("b").isNull(), F.col("a")).otherwise((F.col("a") + F.col("b")) / 2)
    return got.select("train_id", "y", "x", F.when(F.col("whole") & (F.col("n") > 0) & (F.col("k") > 0), two).otherwise(F.col("m")).alias("v"))


def pp_history(fom: DataFrame, n: int = 3000) -> DataFrame:
    return fom.select("train_id", "fom").orderBy(F.desc("train_id")).limit(n)


def line_pump_probe(lines: DataFrame, on: Slice, off: Slice, dark: Slice, w: int = 1) -> DataFrame:
    """Line detector (train_id, pulse, pixel, adc): train_id, k, pixel, vfom = on - off of the k-th on and off pulse, less the mean dark pulse (which cancels in the difference but not in what is shown: corrected). Trains with unequal counts have no rows. w: window of the moving average over trains."""
    n = F.max("pulse").over(Window.partitionBy("train_id")) + 1
    df = lines.withColumn("__n", n)
    df = df.withColumns({f"is_{k}": in_slice(F.col("pulse"), F.col("__n"), *s) for k, s in (("on", on), ("off", off), ("dark", dark))})
    base = df.where("is_dark").groupBy("train_id", "pixel").agg(F.avg("adc").alias("base"))
    rank = Window.partitionBy("train_id", "pixel").orderBy("pulse")
    part = lambda g: df.where(f"is_{g}").join(base, ["train_id", "pixel"]).select("train_id", "pixel", (F.row_number().over(rank) - 1).alias("k"), (F.col("adc") - F.col("base")).alias(g))
    counts = df.groupBy("train_id", "pixel").agg(F.count_if("is_on").alias("a"), F.count_if("is_off").alias("b")).where("a = b").select("train_id", "pixel")
    out = part("on").join(part("off"), ["train_id", "pixel", "k"]).join(counts, ["train_id", "pixel"], "left_semi").select("train_id", "k", "pixel", (F.col("on") - F.col("off")).alias("vfom"))
    return averaged(out, ["k", "pixel"], "vfom", w)
