"""Connected components of an edge table.

The graph is contracted by joins until no edge is left, at every size in the
same way: each node takes its smallest neighbour as parent, parents are followed
to their ends, and edges are rewritten to the parents; the nodes that still have an
edge at least halve per round. Tables between steps are written to shared
storage, joins merge whatever the sizes, and only counts reach the driver.
A node of very many edges is one key of a join with one row on the other side,
which adaptive execution splits.

Defined cases: loops and repeated edges change nothing; an edge with a null end is
left out; no edges give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node of each edge's component, for nodes that have an edge."""
    edges = materialize(edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b").distinct(), "edges")
    labels = None
    while labels is None or edges.limit(1).count():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # A node's parent is its smallest neighbour, or itself if it is smaller than all.
        parent = materialize(both.groupBy("a").agg(F.min("b").alias("p")).select(F.col("a").alias("v"), F.least("a", "p").alias("p")), "parents")
        while True:
            # Only parents that have another parent themselves lead on.
            up = parent.where("p <> v").select(F.col("v").alias("p"), F.col("p").alias("q"))
            jumped = parent.join(up.hint("merge"), "p", "left").select("v", F.coalesce("q", "p").alias("p"), F.col("q").isNotNull().alias("moved"))
            jumped = materialize(jumped, "parents")
            parent = jumped.select("v", "p")
            if not jumped.where("moved").limit(1).count():
                break
        at = parent.select(F.col("v").alias("a"), F.col("p").alias("pa"))
        to = parent.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        moved = edges.join(at.hint("merge"), "a").join(to.hint("merge"), "b").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
        edges = materialize(moved.where("a <> b").distinct(), "edges")
        step = parent.select(F.col("v").alias("node"), F.col("p").alias("component"))
        labels = step if labels is None else _follow(labels, step)
    return labels


def _follow(labels: DataFrame, step: DataFrame) -> DataFrame:
    """``labels`` with the components of ``step`` in place of their own, where it has any."""
    step = step.select(F.col("node").alias("component"), F.col("component").alias("_to"))
    return materialize(labels.join(step.hint("merge"), "component", "left").select("node", F.coalesce("_to", "component").alias("component")), "labels")
