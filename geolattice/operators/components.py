"""Connected components of an edge table by label propagation with pointer jumping."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def connected_components(edges: DataFrame, save: Callable[[DataFrame, str], DataFrame], *, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that has an edge; the component is its least node.

    Each round replaces edges by edges to the least neighbour (large and small star steps); paths halve, so rounds grow with the
    logarithm of a component's diameter. ``save`` writes a table where all executors can read it and cuts the lineage. A node
    with a third of all edges costs one partial aggregate a task and round.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = save(e, "edges-0")
    for k in range(1, max_rounds + 1):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: neighbours above a node go to its least neighbour
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: a node and its lower neighbours go to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").filter("u <> v").distinct()
        new = save(small, f"edges-{k}")
        same = new.count() == e.count() and new.join(e, ["u", "v"], "left_anti").isEmpty()
        e = new
        if same:
            break
    else:
        raise RuntimeError(f"no fixpoint after {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
