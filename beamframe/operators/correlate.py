"""Matching by train ID, pairing of on and off, unions and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beamframe.functions import drop_reason, is_even
from beamframe.scratch import written


def newest_value(raw: DataFrame, source: str, ties: str = "last") -> Column:
    """Aggregate over messages: the value of a source's newest one, by ts. Of equal times the last or the first arrival counts, by seq where the column is there, else the greatest value. A message without value or time is passed over."""
    if ties not in ("last", "first"):
        raise ValueError(f"ties must be last or first, not {ties!r}")
    mine = (F.col("source") == source) & F.col("scalar").isNotNull() & F.col("ts").isNotNull()
    arrival = [F.col("seq") if ties == "last" else (-F.col("seq")).alias("seq")] if "seq" in raw.columns else []
    return F.max_by(F.when(mine, F.col("scalar")), F.when(mine, F.struct("ts", *arrival, "scalar"))).alias(source)


def correlate(raw: DataFrame, sources: list[str], ties: str = "last") -> DataFrame:
    """train_id and a column for each source, for trains where all arrived: one shuffle instead of a join each. A later message of a source wins (see newest_value)."""
    own = raw.where(F.col("source").isin(sources))
    wide = own.groupBy("train_id").agg(*[newest_value(raw, s, ties) for s in sources], *[F.count_if(F.col("source") == s).alias(f"__{i}") for i, s in enumerate(sources)])
    for i in range(len(sources)):
        wide = wide.where(F.col(f"__{i}") > 0)
    return wide.select("train_id", *[F.col(f"`{s}`") for s in sources])


def dropped_trains(raw: DataFrame, sources: list[str]) -> DataFrame:
    """train_id, n_missing, reason of incomplete trains; the first missing source in the order given is named."""
    found = raw.where(F.col("source").isin(sources)).groupBy("train_id").agg(F.collect_set("source").alias("have"))
    missing = F.array_except(F.array(*[F.lit(s) for s in sources]), "have")
    return found.withColumn("missing", missing).where(F.size("missing") > 0).select("train_id", F.size("missing").cast("long").alias("n_missing"), drop_reason(F.size("missing"), F.lit(len(sources)), F.element_at("missing", 1)).alias("reason"))


RANGES = 256


def by_ranges(df: DataFrame, col: str, ranges: int = RANGES) -> DataFrame:
    """df, written once, with __range, the number of one of at most `ranges` ranges of col with about equally many rows: windows over all rows become windows in a range and one over the ranges."""
    df = written(df, "ranges")
    cuts = sorted(set(df.approxQuantile(col, [i / ranges for i in range(1, ranges)], 0.25 / ranges)))
    return df.withColumn("__range", F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<double>"), lambda c: c < F.col(col))) if cuts else F.lit(0))


def correlate_ordered(arrivals: DataFrame, sources: list[str]) -> DataFrame:
    """Exact emission rule on (seq, train_id, source): a complete train survives unless a train that first arrived later completes before it.

    Works on one row a train after the first aggregate. Trains are cut into ranges of first_seq: what completes later is
    the least of the rows after a train in its range and of the least values of all later ranges.
    """
    own = arrivals.where(F.col("source").isin(sources))
    first = own.groupBy("train_id", "source").agg(F.min("seq").alias("seq"))
    trains = first.groupBy("train_id").agg(F.min("seq").alias("first_seq"), F.when(F.count("*") == len(sources), F.max("seq")).alias("complete_seq"))
    trains = by_ranges(trains, "first_seq")
    least = trains.groupBy("__range").agg(F.min("complete_seq").alias("least"))  # at most RANGES rows
    after = F.min("least").over(Window.orderBy("__range").rowsBetween(1, Window.unboundedFollowing))
    inside = F.min("complete_seq").over(Window.partitionBy("__range").orderBy("first_seq").rowsBetween(1, Window.unboundedFollowing))
    trains = trains.withColumn("inside", inside).join(F.broadcast(least.select("__range", after.alias("after"))), "__range")
    return trains.withColumn("later", F.least("inside", "after")).where("complete_seq IS NOT NULL AND (later IS NULL OR later > complete_seq)").select("train_id", "complete_seq")


def join_slow(fom: DataFrame, slow: DataFrame) -> DataFrame:
    return fom.join(slow, "train_id")


def pair_on_off(trains: DataFrame, mode: str = "even_on") -> DataFrame:
    """(train_off, train_on): each off train takes the latest unused on train before it. trains: train_id [, has_on, has_off, in arrival order of IDs].

    On trains without a kept on pulse never replace the stored one, so they are removed first; an on train is used by the
    next off train only, which the row before it decides.
    """
    on = is_even(F.col("train_id")) if mode == "even_on" else ~is_even(F.col("train_id"))
    df = trains.withColumn("__on", on)
    if "has_on" in trains.columns:
        df = df.where(~F.col("__on") | F.col("has_on"))
    df = by_ranges(df, "train_id").withColumn("__if_on", F.when(F.col("__on"), F.col("train_id")))
    last = df.groupBy("__range").agg(F.max_by("__if_on", "train_id").alias("last"))  # at most RANGES rows
    last = last.select("__range", F.lag("last").over(Window.orderBy("__range")).alias("__last"))
    order = Window.partitionBy("__range").orderBy("train_id")
    first = F.row_number().over(order) == 1
    df = df.withColumns({"__first": first, "__lag": F.lag("__if_on").over(order)}).join(F.broadcast(last), "__range")
    df = df.withColumn("__prev", F.when(F.col("__first"), F.col("__last")).otherwise(F.col("__lag")))
    df = df.where(~F.col("__on") & F.col("__prev").isNotNull())
    if "has_off" in trains.columns:
        df = df.where("has_off")
    return df.select(F.col("train_id").alias("train_off"), F.col("__prev").alias("train_on"))


def pair_vectors(a: DataFrame, b: DataFrame) -> DataFrame:
    """train_id, pulse, a, b of two pulse vectors of equal length in each train."""
    n = a.groupBy("train_id").agg(F.count("*").alias("n")).join(b.groupBy("train_id").agg(F.count("*").alias("m")), "train_id").where("n = m").select("train_id")
    return a.select("train_id", "pulse", F.col("v").alias("a")).join(b.select("train_id", "pulse", F.col("v").alias("b")), ["train_id", "pulse"]).join(n, "train_id", "left_semi")


def latest_trains(df: DataFrame, k: int = 3000) -> DataFrame:
    return df.orderBy(F.desc("ts"), F.desc("train_id")).limit(k)


def latest(df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The result with the greatest train_id wins (for each of keys)."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), "train_id").alias("r")).select(*keys, "r.*")


def sorted_ids(df: DataFrame, col: str = "train_id") -> DataFrame:
    return df.select(col).distinct().orderBy(col)


def kept_pulses(all_pulses: DataFrame, dropped: DataFrame) -> DataFrame:
    return all_pulses.join(dropped.select("train_id", "pulse"), ["train_id", "pulse"], "left_anti")


def check_overlap(on: DataFrame, off: DataFrame) -> DataFrame:
    """Pulses that are both on and off: an error of their trains."""
    return on.select("train_id", "pulse").intersect(off.select("train_id", "pulse"))


def sources_by_category(catalog: DataFrame) -> DataFrame:
    """category, sources in order of their first entry, each once."""
    first = catalog.groupBy("category", "name").agg(F.min("seq").alias("seq"))
    return first.groupBy("category").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "name"))), lambda s: s["name"]).alias("sources"))


def merge_messages(*parts: DataFrame) -> DataFrame:
    """Union of messages (train_id, source, property, arrival, scalar); of one property the later value wins."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("train_id", "source", "property").agg(F.max_by("scalar", "arrival").alias("scalar"))
