"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame) -> DataFrame:
    """id, component (smallest id reachable) of every id in edges (a, b).

    Alternates large-star and small-star steps until the edge set is stable.
    Each round is a few joins on ids, whose hot keys adaptive execution can
    split (between two shuffles, so their sides are written), and is written to the shared folder, so that a lost executor
    repeats one round at most.
    """
    pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct()
    pairs = cut(pairs)
    before = None
    while (now := pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()) != before and now[0]:
        before = now
        both = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # What is joined with the edges it came from is written first: only then can adaptive execution split a hub.
        least = cut(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")))
        large = cut(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        low = cut(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        pairs = cut(small.filter("a != b").distinct())
    return pairs.select(F.col("a").alias("id"), F.col("b").alias("component")).unionAll(pairs.select("b", "b").distinct())
