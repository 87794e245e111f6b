"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placelab.operators import skew
from placelab.session import discard, materialize

EDGES_PER_FILE = 500_000


def _shape(edges: DataFrame) -> tuple[int, int, int, int]:
    """(most edges of a larger end, most edges of a smaller end, nodes that are both, all edges)."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up"))
    )
    degrees = ends.groupBy("node").agg(F.sum("down").alias("down"), F.sum("up").alias("up"))
    row = degrees.agg(F.max("down"), F.max("up"), F.count_if((F.col("down") > 0) & (F.col("up") > 0)), F.sum("up")).first()
    return row[0] or 0, row[1] or 0, row[2], row[3] or 0


def _join(rows: DataFrame, other: DataFrame, key: str, degree: int, how: str) -> DataFrame:
    """Join by node; nodes with very many edges are salted."""
    if degree <= skew.HOT_ROWS:
        return rows.join(other, key, how)
    sizes = rows.groupBy(key).agg(F.count("*").alias("_n"))
    return skew.salted_join(rows, other, [key], skew.hot_keys(sizes, [key], "_n"), how)


def _star_round(edges: DataFrame, down: int, up: int) -> DataFrame:
    """One large-star and one small-star step over edges that run from larger to smaller nodes.

    Large star: the smaller end moves on to its own smallest neighbour. Small
    star: a node and all its smaller neighbours hang on the smallest of them.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    large = (
        _join(edges, least.select(F.col("u").alias("v"), "m"), "v", up, "left")
        .select("u", F.coalesce("m", "v").alias("v")).distinct()
    )
    smallest = large.groupBy("u").agg(F.min("v").alias("m"))
    starred = _join(large, smallest, "u", down, "inner")
    moved = starred.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(smallest.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for all end points of ``edges(u, v)``; a component is named by its smallest node.

    The number of rounds grows with the logarithm of the graph. Each round is
    written out, and the loop ends when every node hangs directly on a root; it always does.
    """
    current = materialize(
        edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    while True:
        down, up, between, count = _shape(current)
        if down <= 1 and not between:
            break
        # few edges need few files; the step itself still runs on all shuffle partitions
        files, before = -(-count // EDGES_PER_FILE) + 1, current
        current = materialize(_star_round(current, down, up).coalesce(files))
        discard(before)
    roots = current.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
