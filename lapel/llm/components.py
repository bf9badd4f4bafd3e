"""Connected components of an edge list by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapel.llm.common import materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (u, v), two longs each; root is the least node it reaches.

    Each round writes its edges to the shared folder; the driver sees a count and a checksum of them only. Minima
    combine map-side, and the joins hold the unique side against the edges, so a star's hub can be split.
    """
    now = edges.select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).filter("a <> b").distinct()
    now, seen = materialise(now, "edges"), None
    while (mark := _mark(now)) != seen:
        seen = mark
        now = materialise(_small_star(_large_star(now)), "edges")
    roots = now.select("b").distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(roots.select(F.col("b").alias("node"), F.col("b").alias("root")))


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the least node around."""
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are tied to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    near = edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return near.unionAll(least.select("a", F.col("m").alias("b"))).distinct()
