"""Connected components of an edge table, by hash-to-minimum with pointer jumping; each round is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beamframe.llm.shared import materialize


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (a, b) with a != b; component is the least node reachable.

    Rounds alternate: every neighbour larger than a node is tied to the least one of the neighbourhood, then every
    smaller one. The edges become stars around the least nodes; their number never grows beyond twice the input, and a
    node with very many neighbours is only ever grouped by aggregates with partial sums and joins that can be split.
    """
    now = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    for _ in range(most_rounds):
        both = now.union(now.select("b", "a"))
        least = both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")).select("n", F.least("n", "m").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("n")).select(F.col("m").alias("a"), "b").distinct()
        large = materialize(large, "large")
        small = large.groupBy(F.col("b").alias("n")).agg(F.min("a").alias("m"))
        tied = large.join(small, F.col("b") == F.col("n")).select("m", "a", "n")
        after = tied.select(F.col("m").alias("a"), F.col("a").alias("b")).union(tied.select(F.col("m").alias("a"), F.col("n").alias("b"))).where("a < b").distinct()
        after = materialize(after, "small")
        # done when every node hangs on one node that hangs on none
        open_ = after.groupBy("b").agg(F.count("*").alias("k")).where("k > 1").limit(1).count() or after.select("b").join(after.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count()
        now = after
        if not open_:
            break
    else:
        raise RuntimeError("components did not settle")
    tied = now.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return tied.union(tied.select(F.col("component").alias("node"), "component").distinct())
