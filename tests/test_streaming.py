"""Streams give what batches give; state survives a restart."""

import tempfile

from beamframe import streaming
from beamframe.operators import stats

SCHEMA = "seq long, train_id long, source string, x double, y double"


def drain(df, at, mode="append"):
    out = []
    df.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(lambda b, i: out.extend(tuple(r) for r in b.collect())).start().awaitTermination()
    return out


def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def test_moving_average_over_a_restart(spark):
    at = folder()
    xs = [1.0, 2.0, 3.0, 10.0]
    write = lambda part: spark.createDataFrame([(i, i, "k", x, x) for i, x in part], SCHEMA).write.mode("append").parquet(f"{at}/in")
    stream = lambda: streaming.moving_average_stream(spark.readStream.schema(SCHEMA).parquet(f"{at}/in"), "source", "seq", "x", 5)
    write(list(enumerate(xs))[:2])
    got = drain(stream(), at)
    write(list(enumerate(xs))[2:])
    got += drain(stream(), at)
    assert [v for _, _, v in sorted(got)] == [1.0, 1.5, 2.0, 4.0]


def test_exact_matching_and_reasons(spark):
    at = folder()
    seq = [(1001, "a"), (1002, "a"), (1003, "a"), (1003, "b"), (1004, "b"), (1004, "a")]
    spark.createDataFrame([(i, t, s, 0.0, 0.0) for i, (t, s) in enumerate(seq)], SCHEMA).coalesce(1).write.parquet(f"{at}/in")
    got = drain(streaming.correlate_stream_exact(spark.readStream.schema(SCHEMA).parquet(f"{at}/in"), ["a", "b"]), at)
    assert [t for t, ok, _ in got if ok] == [1003, 1004]
    assert sorted((t, why) for t, ok, why in got if not ok) == [(1001, "Not found: 1 out of 2: b"), (1002, "Not found: 1 out of 2: b")]


def test_scan_stream_is_the_batch(spark):
    at = folder()
    xs, ys = [1, 2, 2.02, 2.10, 2.31, 2.40], [0.3, 0.4, 0.5, 0.6, 1, 2]
    df = spark.createDataFrame([(i, i, "k", float(x), float(y)) for i, (x, y) in enumerate(zip(xs, ys, strict=True))], SCHEMA)
    df.coalesce(1).write.parquet(f"{at}/in")
    got = drain(streaming.scan_points_stream(spark.readStream.schema(SCHEMA).parquet(f"{at}/in"), "source", "seq", "x", "y", 0.1), at, "update")
    want = [tuple(r) for r in stats.scan_points(df, ["source"], ["seq"], "x", "y", 0.1).collect()]
    assert [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in sorted(got)] == [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in want]
