"""Connected components of an edge table by alternating large-star and small-star rounds (Kiveris et
al., 2014): every round is joins and aggregates over the edges, none of which reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, materialize


def components(edges: DataFrame) -> DataFrame:
    """Node and least node of its component (columns node, root) for all nodes of the undirected edges
    (columns a, b). Loops are dropped, repeated edges don't matter; no edges, no rows."""
    up = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    state = None
    while True:  # the rounds are logarithmic in the longest chain
        # large star: the greater neighbours of a node go to its least neighbour
        both = up.unionAll(up.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # the least neighbours are written, so that both sides of the join are plain: a node of very many
        # neighbours can then be dealt to several tasks
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: a node and its lesser neighbours go to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        before, up = up, materialize(
            small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionAll(low.select("u", F.col("m").alias("v"))).distinct(), "edges"
        )
        discard(before)
        discard(least)
        now = up.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or now[0] == 0:
            break
        state = now
    out = up.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(up.select("v", "v").distinct().toDF("node", "root"))
    out._written_at = up._written_at  # what it reads: can be discarded
    return out
