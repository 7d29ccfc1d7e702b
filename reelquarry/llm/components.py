"""Connected components of a graph held as a DataFrame of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    linked = edges.join(least, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.union(least.select("a", F.col("m").alias("b")))


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for each node of `edges`(a, b: long): root is the smallest node that can be reached.

    Alternates large-star and small-star steps, which needs a number of rounds that grows with the logarithm of a
    component's size. Each round is two partial aggregations and two joins on plain longs, and is written to the shared
    folder, so that the plan stays short and lost executors cost one round. Self-links, repeated edges and an empty table
    are fine; null ends are ignored. Raises RuntimeError if `most_rounds` do not suffice.
    """
    now = written(
        edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    before = None
    for _ in range(most_rounds):
        state = now.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if before is not None and tuple(state) == tuple(before):
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        if not state[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
        step = written(_small_star(_large_star(now)).filter("a != b").distinct(), "edges")
        discard(now)
        now = step
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
