"""Connected components of an edge table, and joins on keys that may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quakeloom.session import cut


def join_once(rows: DataFrame, keyed: DataFrame, key: str) -> DataFrame:
    """Inner join of `rows` with `keyed`, an aggregate of one row per key.

    The aggregate is cut first, so that it isn't made twice and both sides are plain shuffles, whose hot
    partitions adaptive execution splits.
    """
    return rows.join(cut(keyed), key)


def _toward_least(pairs: DataFrame) -> DataFrame:
    """Each (u, v) with the least neighbour of u. The minimum is pre-aggregated per task."""
    return join_once(pairs, pairs.groupBy("u").agg(F.min("v").alias("m")), "u")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node that has an edge to another; component is the least node.

    Alternating large-star and small-star rounds. Edges may repeat and point either way; nulls and loops
    are ignored. Neighbour lists are never gathered: a round is two minimum aggregations joined back,
    whatever the degree of a node.
    """
    high, low = F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    now = cut(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").select(high, low).distinct())
    before = None
    while (state := now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()) != before:
        before = state
        if not state[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _toward_least(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v").distinct()
        small = _toward_least(cut(large))
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        now = cut(small.where("u <> v").distinct())
    node = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return node.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
