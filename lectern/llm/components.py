"""Connected components of a graph that stays distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the edges (a, b), the label being the least node of its component.

    Alternating large-star and small-star steps: every step replaces edges by edges to a least neighbour and never
    adds any, so a chain shrinks to a star in a number of rounds that is logarithmic in its length. Minima are
    combined before they are shuffled, and a node with very many neighbours meets its minimum in a join that can be
    split. Each round is a written table.
    """
    stars = written(_tidy(edges.select("a", "b")), "edges")
    before = None
    while True:
        now = stars.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if now == before or not now["n"]:
            break
        before = now
        both = stars.union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = _least(both)
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        large = written(_tidy(large), "edges")
        least = _least(large)
        small = large.join(least, "a").select(
            F.when(F.col("b") == F.col("least"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("least").alias("b")
        )
        stars = written(_tidy(small), "edges")
    own = stars.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return stars.select(F.col("a").alias("node"), F.col("b").alias("label")).union(own)


def _tidy(edges: DataFrame) -> DataFrame:
    """Distinct edges from the larger to the smaller node."""
    return (
        edges.filter("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )


def _least(edges: DataFrame) -> DataFrame:
    return written(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least")), "least")
