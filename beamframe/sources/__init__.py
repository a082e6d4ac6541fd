"""Scans, sinks and what is known about sources.

raw: train_id, source, property, ts, scalar [, vector]; pixels: train_id [, pulse], y, x, v.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DETECTOR = r"^(.+)/DET/(.+):(.+)$"


def scan_run(spark: SparkSession, path: str, sources: list[str] | None = None, require_all: bool = False) -> DataFrame:
    """A recorded run; with require_all only trains that have every one of sources."""
    df = spark.read.parquet(path)
    return restrict_sources(df, sources, require_all) if sources else df


def restrict_sources(df: DataFrame, sources: list[str], require_all: bool = False) -> DataFrame:
    df = df.where(F.col("source").isin(sources))
    if not require_all:
        return df
    whole = df.groupBy("train_id").agg(F.bit_or(_bit(sources)).alias("m")).where(F.col("m") == (1 << len(sources)) - 1).select("train_id")
    return df.join(whole, "train_id", "left_semi")


def _bit(sources: list[str]) -> Column:
    out = F.lit(0).cast("long")
    for i, s in enumerate(sources):
        out = F.when(F.col("source") == s, F.lit(1 << i).cast("long")).otherwise(out)
    return out


def train_range(df: DataFrame, start: int, end: int, step: int = 1) -> DataFrame:
    t = F.col("train_id")
    return df.where((t >= start) & (t < end) & ((t - start) % step == 0))


def run_info(df: DataFrame) -> DataFrame:
    """n_trains, first, last; (0, -1, -1) for no train."""
    return df.agg(F.countDistinct("train_id").alias("n_trains"), F.coalesce(F.min("train_id"), F.lit(-1).cast("long")).alias("first_train"), F.coalesce(F.max("train_id"), F.lit(-1).cast("long")).alias("last_train"))


def gather_sources(df: DataFrame, prioritized: tuple[str, ...] = (), instrument: str = ":") -> DataFrame:
    """source, kind (detector, instrument, control) and properties: prioritized ones first, then "*", then by name."""
    kind = F.when(F.col("source").rlike(DETECTOR), "detector").when(F.contains("source", F.lit(instrument)), "instrument").otherwise("control")
    rank = F.coalesce(*[F.when(F.col("property") == p, F.lit(i)) for i, p in enumerate(prioritized)], F.when(F.col("property") == "*", F.lit(len(prioritized))), F.lit(len(prioritized) + 1))
    listed = F.transform(F.array_sort(F.collect_set(F.struct(rank.alias("r"), F.col("property").alias("p")))), lambda x: x["p"])
    return df.groupBy("source", kind.alias("kind")).agg(listed.alias("properties"))


def stream_sources(spark: SparkSession, paths: list[str], schema) -> DataFrame:
    """Several file endpoints as one stream."""
    out = None
    for p in paths:
        part = spark.readStream.schema(schema).parquet(p)
        out = part if out is None else out.unionByName(part)
    return out


def load_constants(spark: SparkSession, path: str) -> DataFrame:
    """cell, y, x, v of a gain or offset table; each cell must be one full rectangle of equal shape."""
    return check_constants(spark.read.parquet(path))


def check_constants(df: DataFrame) -> DataFrame:
    shape = df.groupBy("cell").agg(F.count("*").alias("n"), (F.max("y") + 1).alias("ny"), (F.max("x") + 1).alias("nx"))
    bad = shape.agg(F.countDistinct("ny", "nx").alias("k"), F.count_if(F.col("n") != F.col("ny") * F.col("nx")).alias("holes")).where("k > 1 OR holes > 0")
    if bad.count():
        raise ValueError("constants must be cells of one full rectangular shape")
    return df


def load_reference(spark: SparkSession, path: str) -> DataFrame:
    """y, x, v of a reference image; it must be one full rectangle, each pixel once."""
    df = spark.read.parquet(path)
    if set(df.columns) != {"y", "x", "v"}:
        raise ValueError("a reference image has columns y, x, v")
    shape = df.agg(F.count("*").alias("n"), F.count_distinct("y", "x").alias("places"), ((F.max("y") + 1) * (F.max("x") + 1)).alias("all"), F.least(F.min("y"), F.min("x")).alias("least")).first()
    if shape["n"] and not (shape["n"] == shape["places"] == shape["all"] and shape["least"] == 0):
        raise ValueError("a reference image must be one full rectangle")
    return df


def write_results(df: DataFrame, path: str, checkpoint: str | None = None):
    """Results as Parquet by batch or, for a stream, micro-batch by micro-batch; the running query is returned then."""
    if df.isStreaming:
        return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()
    return df.write.mode("append").parquet(path)


def detector_output(px: DataFrame, detector: str) -> DataFrame:
    """Corrected mean images as messages of source EF_<detector>."""
    return px.groupBy("train_id", "ts").agg(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "v"))), lambda p: p["v"]).alias("data")).select("train_id", F.lit(f"EF_{detector}").alias("source"), "ts", "data")


def available_sources(df: DataFrame, now: Column, ttl: str = "2 seconds") -> DataFrame:
    """Sources heard of within ttl before now, with their last time and train."""
    return df.groupBy("source").agg(F.max("ts").alias("last_ts"), F.max_by("train_id", "ts").alias("last_train")).where(F.col("last_ts") >= now - F.expr(f"INTERVAL {ttl}"))


def process_counts(df: DataFrame) -> DataFrame:
    """Of rows (train_id, dropped, n_pulses): latest train, processed and dropped trains, processed pulses."""
    return df.agg(F.max("train_id").alias("latest_train"), F.count_if(~F.col("dropped")).alias("n_processed"), F.count_if("dropped").alias("n_dropped"), F.coalesce(F.sum(F.when(~F.col("dropped"), F.col("n_pulses"))), F.lit(0)).cast("long").alias("n_pulses"))
