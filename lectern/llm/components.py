"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import removed, stored


def _lowest(arcs: DataFrame) -> DataFrame:
    """arcs (u, v) with the smallest of u's neighbours and u itself as m. The minimum is made by partial
    aggregates and joined back, so the arcs of a hub are dealt over tasks as the join splits them."""
    least = arcs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return arcs.join(least, "u")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component_id): every id on an edge, and the smallest id that its edges reach.

    Each round writes its edges to the shared folder. A round maps each id's larger neighbours to its
    smallest (large star) and then each id and its smaller ones likewise (small star); rounds grow with
    the logarithm of the longest path. Loops and repeated edges are harmless; an empty table gives none.
    """
    pairs = edges.select(F.least(a, b).alias("v"), F.greatest(a, b).alias("u")).where("u <> v").distinct()
    now, mark = stored(pairs, "edges"), None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (state.n, state.h) == mark or not state.n:
            break
        mark = (state.n, state.h)
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _lowest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        joined = _lowest(large)
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v"))).distinct()
        last, now = now, stored(small, "edges")
        removed(last)
    roots = now.select(F.col("v").alias("id")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component_id")).union(roots.select("id", F.col("id").alias("component_id")))
