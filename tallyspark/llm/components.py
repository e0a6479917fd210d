"""Connected components of an edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import materialised, tasks_for

ROUNDS = 50


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(u, v)`` that is not the root (smallest node) of its component.

    Alternates the two star operations: each node hangs its larger neighbours, then its smaller ones, on the smallest
    node it knows. The number of rounds grows with the logarithm of the component size; each round is a minimum that
    combines map-side and an equi-join, and is written to the checkpoint folder. Tasks follow the number of edges. Self-loops
    and repeated edges do no harm; no edges give no rows.
    """
    stars = materialised(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    tasks = tasks_for(4 * stars.count())
    stars = stars.coalesce(tasks)
    seen = None
    for _ in range(ROUNDS):
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # every node above its own minimum keeps an edge to it, so none is lost
        large = large.union(least.where("m < u").select("u", F.col("m").alias("v"))).where("u <> v").coalesce(tasks).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(least.select("u", F.col("m").alias("v"))).where("u <> v").coalesce(tasks).distinct()
        stars = materialised(small.coalesce(tasks))
        state = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state
    raise RuntimeError(f"no stable components after {ROUNDS} rounds")
