"""Stateful streams over restarts: rings, resets, trains with late rows, sources that fall silent."""

import tempfile
from datetime import UTC, datetime

from beamframe.streaming import states

SCHEMA = "train_id long, source string, ts timestamp, seq long, scalar double"


class Feed:
    """A file stream that is run until it is read, again and again, over one checkpoint."""

    def __init__(self, spark, schema, build, mode="append"):
        self.spark, self.schema, self.build, self.mode, self.at = spark, schema, build, mode, tempfile.mkdtemp(prefix="spark-", dir="/tmp")

    def __call__(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(f"{self.at}/in")
        out = []
        df = self.build(self.spark.readStream.schema(self.schema).parquet(f"{self.at}/in"))
        df.writeStream.outputMode(self.mode).option("checkpointLocation", f"{self.at}/state").trigger(availableNow=True).foreachBatch(lambda b, i: out.extend(tuple(r) for r in b.collect())).start().awaitTermination()
        return out


def at(minute):
    return datetime.fromtimestamp(1_700_000_000 + 60 * minute, UTC)


def test_the_ring_keeps_the_newest_rows_over_restarts(spark):
    feed = Feed(spark, "k string, at long, v double", lambda e: states.last_n_stream(e, "k", "at", "v", 3))
    changes = feed([("a", i, float(i)) for i in range(5)] + [("b", 1, None)])
    assert sorted(changes, key=str) == [("a", 2, 2.0, 1), ("a", 3, 3.0, 1), ("a", 4, 4.0, 1), ("b", 1, None, 1)]
    more = feed([("a", 9, 9.0), ("a", 1, 1.0)])
    assert sorted(more) == [("a", 2, 2.0, -1), ("a", 9, 9.0, 1)]
    left = states.history_of(spark.createDataFrame(changes + more, "k string, at long, v double, change long")).collect()
    assert sorted(map(tuple, left), key=str) == [("a", 3, 3.0), ("a", 4, 4.0), ("a", 9, 9.0), ("b", 1, None)]


def test_averages_begin_anew_at_commands_and_changes(spark):
    schema = "k string, at long, signature string, vec array<double>, command boolean"
    feed = Feed(spark, schema, lambda e: states.average_with_resets(e.where("NOT command"), e.where("command").select("k", "at"), "k", "at", 10))
    row = lambda i, s, *v: ("a", i, s, list(v), False)
    got = feed([row(1, "x", 1.0), row(2, "x", 3.0), ("a", 3, "", [], True), row(3, "x", 8.0)])
    assert [(i, n, m) for _, i, n, m in sorted(got)] == [(1, 1, [1.0]), (2, 2, [2.0]), (3, 1, [8.0])]
    got = feed([row(4, "x", 2.0), row(5, "y", 2.0), row(6, "y", 4.0), row(7, "y", 1.0, 5.0), row(8, "y", 3.0, 7.0)])
    assert [(i, n, m) for _, i, n, m in sorted(got)] == [(4, 2, [5.0]), (5, 1, [2.0]), (6, 2, [3.0]), (7, 1, [1.0, 5.0]), (8, 2, [2.0, 6.0])]


def test_trains_end_complete_or_with_a_reason(spark):
    feed = Feed(spark, SCHEMA, lambda e: states.match_trains(e, ["a", "b"], 10 * 60_000, "1 minute"))
    got = feed([(1, "a", at(0), 1, 1.0), (1, "b", at(1), 2, 2.0), (2, "a", at(1), 3, 3.0), (3, "b", at(2), 4, 4.0)])
    assert got == [(1, True, "", 1.0, 2.0)]
    got = feed([(3, "a", at(3), 5, 5.0), (3, "b", at(3), 6, 6.0), (4, "a", at(30), 7, 7.0)])
    assert sorted(got) == [(2, False, "Not found: 1 out of 2: b", 3.0, None), (3, True, "", 5.0, 6.0)]
    got = feed([(2, "b", at(2), 8, 8.0), (4, "b", at(31), 9, 9.0), (5, "a", at(60), 10, 1.0)])  # train 2 is late
    assert got == [(4, True, "", 7.0, 9.0)]


def test_silent_sources_leave_and_come_back(spark):
    feed = Feed(spark, SCHEMA, lambda e: states.source_changes(e, 10 * 60_000, "1 minute"))
    feed([(1, "a", at(0), 1, 1.0), (1, "b", at(0), 2, 1.0)])
    got = feed([(2, "a", at(8), 3, 1.0), (3, "a", at(16), 4, 1.0)])
    assert {(s, ok) for s, ok, _, _ in got} == {("a", True), ("b", False)}
    got = feed([(4, "b", at(17), 5, 1.0), (5, "a", at(40), 6, 1.0)])
    assert sorted((s, ok, t) for s, ok, _, t in got) == [("a", False, 3), ("a", True, 5), ("b", False, 4), ("b", True, 4)]
