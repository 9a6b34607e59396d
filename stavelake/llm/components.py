"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, stored


#: Keys with more than a HOT_SHARE-th of all rows, and FEW at least, are hot. There are fewer than HOT_SHARE of them at any
#: size, so they are broadcast.
HOT_SHARE, FEW = 1000, 64


def with_key_values(rows: DataFrame, small: DataFrame, key: str, total: int) -> DataFrame:
    """Inner join of `rows` with `small`, which has one row for each key and the key's number of rows as `n`.

    Rows of hot keys stay where they are and take their values from the broadcast hot part of `small`; the others meet
    theirs by shuffle. So no task gets the rows of a hot key, whatever its share. `total` is the number of `rows`.
    """
    most = max(FEW, total // HOT_SHARE)
    hot = small.where(F.col("n") > most)
    marked = rows.join(F.broadcast(hot), key, "left")
    cold = marked.where("n is null").select(*rows.columns).join(small.where(F.col("n") <= most).hint("merge"), key)
    return marked.where("n is not null").unionByName(cold).drop("n")


def _starred(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """One step. large: each node links its greater neighbours to its least one; small: its lesser ones and itself."""
    least = F.min("b").alias("m"), F.count("*").alias("n")
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        found = both.groupBy("a").agg(*least).select("a", F.least("a", "m").alias("m"), "n")
        out = with_key_values(both, found, "a", 2 * total).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        found = down.groupBy("a").agg(*least)
        out = with_key_values(down, found, "a", total).select(F.col("b").alias("a"), F.col("m").alias("b")).union(found.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges(a, b)`; the root is the least node of the component.

    Nothing goes through the driver but an edge count and a checksum for each round. Each round is a written table,
    so a lost executor costs one step; nodes with many edges stay spread over tasks. Rounds grow with the logarithm of the longest path. Self-loops, repeated and
    reversed edges are allowed; null ends are dropped; no edges give no rows.
    """
    edges = stored(edges.where("a <> b").distinct(), "edges")
    seen, total = None, edges.count()
    while total:
        half = stored(_starred(edges, True, total), "edges")
        new = stored(_starred(half, False, half.count()), "edges")
        drop_stored(edges)
        drop_stored(half)
        edges = new
        got = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if got == seen:
            break
        seen, total = got, got[0]
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())
