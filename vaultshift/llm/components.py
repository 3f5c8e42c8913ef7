"""Connected components by contraction, on links that stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultshift.session import written


def components(links: DataFrame) -> DataFrame:
    """(node, component) of all nodes in ``links`` (a, b); a component is named by its least node.

    A round hooks every node to its least neighbour, follows that once more, and
    renames the ends of the links; links within a component vanish.  Every round
    at least halves the nodes that still have links.  A node with very many links
    is one group of a map-side minimum and a key of joins that Spark can split.

    Defined cases: a link with a null end, or from a node to itself, says nothing and is left out, and so is a node
    that has no other; repeated links and both directions of one count once; no links give no rows; other columns are ignored.
    """
    left = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "links")
    ends = left.select(F.col("a").alias("node")).unionByName(left.select(F.col("b").alias("node"))).distinct()
    found = ends.select("node", F.col("node").alias("component"))
    while not left.isEmpty():
        both = left.select("a", "b").unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                         .select("node", F.least("node", "m").alias("up")), "parents")
        above = parent.select(F.col("node").alias("up"), F.col("up").alias("top"))
        root = written(parent.join(above, "up", "left").select("node", F.coalesce("top", "up").alias("root")), "roots")
        found = written(found.join(root.select(F.col("node").alias("component"), "root"), "component", "left")
                        .select("node", F.coalesce("root", "component").alias("component")), "components")
        left = written(left.join(root.select(F.col("node").alias("a"), F.col("root").alias("x")), "a")
                       .join(root.select(F.col("node").alias("b"), F.col("root").alias("y")), "b")
                       .where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
    return found
