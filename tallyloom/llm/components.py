"""Connected components over an edge table, by alternating stars; nothing is gathered in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import forget, join_one, written_at


def kept(edges: DataFrame, what: str) -> tuple[DataFrame, str, tuple]:
    """The edges as a written table, its path, and its size and sum of hashes, taken as it is written."""
    seen = Observation()
    total = F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
    table, path = written_at(edges.observe(seen, F.count("*").alias("n"), total.alias("s")), what)
    got = seen.get
    return table, path, (got["n"], got["s"])


def large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the least node around it."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return join_one(both, least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v) to rows (u, v): each node but the roots, with the least node of its component.

    Every round is written to the shared folder and the one before it deleted; the number of rounds grows with the
    logarithm of the nodes.
    """
    edges = edges.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, path, before = kept(edges, "edges")
    while before[0]:
        edges, new, after = kept(small_star(large_star(edges)), "stars")
        forget(path)
        if after == before:
            break
        path, before = new, after
    return edges
