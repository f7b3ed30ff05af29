"""Connected components of a link table by alternating star contraction.

Large-star joins every larger neighbour of a node to the node's least
neighbour, small-star joins every smaller neighbour (and the node) to the
least; alternating both ends, in a number of rounds that is logarithmic in
practice, with a star around each component's least node.  Each round reads
and writes a table in the checkpoint folder; nothing is held by the driver but
two counters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprobe.llm.common import written


def _least(pairs: DataFrame) -> DataFrame:
    """(u, m): the least of u and its neighbours; combined before the shuffle."""
    return pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    return both.join(_least(both), "u").where("v > u") \
        .select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = _least(down)
    moved = down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    own = least.select(F.col("u").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(own).where("a <> b").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)),
                           F.bit_xor(F.xxhash64("a", "b")),
                           F.sum(F.xxhash64("a", "b").bitwiseAND((1 << 32) - 1))).first())


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, root)`` for every node that has a link to another node; root is
    the least node of its component."""
    edges = written(links.select(F.col(a).alias("a"), F.col(b).alias("b"))
                    .where("a <> b").distinct())
    state = _state(edges)
    while state[0]:
        edges = written(_small_star(_large_star(edges)))
        before, state = state, _state(edges)
        if state == before:
            break
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(roots)
