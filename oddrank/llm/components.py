"""Connected components of a graph that is too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddrank.llm import common


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): the smallest node reachable, for every node of an edge.

    By contraction: each round a node goes to the least node around it, and on to
    where that one goes; the edges are renamed, and those inside one name or said
    twice fall away. So the graph shrinks from round to round, and a group of
    many edges is read in full only once. The state of a round is a table in the
    shared folder, removed once the next round's stands; only a counter reaches
    the driver.
    """
    ends = [F.col(a).alias("a"), F.col(b).alias("b")]
    left = common.written(edges.select(*ends).where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct(), "edges")
    known: DataFrame | None = None
    while known is None or left.limit(1).count():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to"))
        further = near.select(F.col("a").alias("to"), F.col("to").alias("then"))
        moved = common.written(
            near.join(further, "to", "left").select("a", F.coalesce("then", "to").alias("to")), "moves"
        )
        before = known
        if known is None:
            known = common.written(moved.select(F.col("a").alias("node"), F.col("to").alias("label")), "labels")
        else:
            step = moved.select(F.col("a").alias("label"), "to")
            known = common.written(
                known.join(step, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels"
            )
        half = left.join(moved, "a").select(F.col("to").alias("x"), "b")
        renamed = half.join(moved.select(F.col("a").alias("b"), "to"), "b").select(F.col("x").alias("a"), F.col("to").alias("b"))
        again = common.written(renamed.where("a <> b").distinct(), "edges")
        common.remove(left, moved, *([before] if before is not None else []))
        left = again
    common.remove(left)
    return known
