"""Connected components by alternating star contraction (Kiveris et al., SOCC 2014).

Each round rewires every edge towards the smallest node seen nearby, so a component ends as a star
around its smallest node after a number of rounds logarithmic in practice. The edge list never grows,
each round ends in a checkpoint, and a hub is only ever an aggregation key (combined before the
shuffle) or the many side of a join against one row, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from mediamatch.session import checkpointed


def _clean(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("low") < F.col("high")).distinct()


def _tie_larger(edges: DataFrame) -> DataFrame:
    """Tie each larger neighbour of a node to the smallest node around it."""
    both = edges.select(F.col("low").alias("node"), F.col("high").alias("other")).unionByName(
        edges.select(F.col("high").alias("node"), F.col("low").alias("other"))
    )
    smallest = both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("m"))
    tied = both.where(F.col("other") > F.col("node")).join(smallest, "node")
    return _clean(tied.select(F.col("m").alias("low"), F.col("other").alias("high")))


def _tie_smaller(edges: DataFrame) -> DataFrame:
    """Tie a node and its smaller neighbours to the smallest of them."""
    smallest = edges.groupBy("high").agg(F.min("low").alias("m"))
    moved = edges.join(smallest, "high").select(F.col("m").alias("low"), F.col("low").alias("high"))
    kept = smallest.select(F.col("m").alias("low"), "high")
    return _clean(moved.unionByName(kept))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("low", "high"))).first())


def connected_components(edges: DataFrame, left: str = "left_bits", right: str = "right_bits") -> DataFrame:
    """(node, component) for every node that has an edge; the component is its smallest node."""
    current = checkpointed(
        _clean(edges.select(F.least(left, right).alias("low"), F.greatest(left, right).alias("high")))
    )
    mark = _mark(current)
    while mark[0]:
        current = checkpointed(_tie_smaller(_tie_larger(current)))
        previous, mark = mark, _mark(current)
        if mark == previous:
            break
    return current.select(F.col("high").alias("node"), F.col("low").alias("component")).unionByName(
        current.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct()
    )
