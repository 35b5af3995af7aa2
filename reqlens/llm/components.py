"""Connected components by contraction, as a chain of staged DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reqlens.llm.common import stage


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` -> ``(node, comp)`` for every node of an edge, where
    ``comp`` is one node of its component, the same for all of them.

    Each round points every node at the least of itself and its neighbours and
    contracts the edges along these pointers.  With ids in random order (they
    are digests here) the nodes left shrink by a constant factor a round, so a
    chain of n nodes takes O(log n) rounds.  A round is one aggregation with
    map-side combine and joins against one row per node; nothing is collected,
    no group is gathered.  Rounds are written to the shared folder, so a lost
    executor repeats at most one of them.  An empty input gives no rows."""
    edges = edges.filter("a is not null and b is not null and a <> b")
    e = stage(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    comp = None
    for _ in range(max_rounds):
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = stage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                   .select("node", F.least("node", "m").alias("to")), "parent")
        if comp is None:
            comp = to.select("node", F.col("to").alias("comp"))
        else:
            up = to.select(F.col("node").alias("_n"), "to")
            comp = stage(comp.join(up, comp.comp == up._n, "left")
                         .select("node", F.coalesce("to", "comp").alias("comp")), "comp")
        a = to.select(F.col("node").alias("a"), F.col("to").alias("ta"))
        b = to.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        e = stage(e.join(a, "a").join(b, "b").filter("ta <> tb")
                  .select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "edges")
        if e.isEmpty():
            return comp
    raise RuntimeError("components did not converge")
