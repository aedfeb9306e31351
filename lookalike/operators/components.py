"""Connected components of links (single linkage)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import written


def _roots(parents: DataFrame) -> DataFrame:
    """node and root, from node and parent (itself or a lesser node): pointers are doubled until they stay."""
    roots = written(parents.select("node", F.col("parent").alias("root")), "roots", narrow=True)
    while True:
        up = roots.select(F.col("node").alias("at"), F.col("root").alias("up"))
        new = written(roots.join(up, roots["root"] == up["at"]).select("node", F.col("up").alias("root"), (F.col("up") != F.col("root")).alias("moved")), "roots", narrow=True)
        roots = new.select("node", "root")
        if not new.filter("moved").limit(1).count():
            return roots


def connected_components(links: DataFrame, a: str = "id1", b: str = "id2") -> DataFrame:
    """node and component (the least node that can be reached) of every node of the links; order and repeats don't matter,
    nodes may be of any ordered type.

    Each node points to its least neighbour if that is less than itself, and follows the pointers to a root; then the links
    are taken between the roots, and what lies within one is gone. A round at least halves the nodes, and links shrink with
    them. Everything between rounds is written down, the driver sees counts. The joins are between plain scans, so that
    adaptive execution can split a hot node."""
    edges = written(links.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).filter("u < v").distinct(), "edges", few=True)
    levels: list[DataFrame] = []
    while True:
        both = edges.select(F.col("v").alias("node"), F.col("u").alias("other")).unionByName(edges.select(F.col("u").alias("node"), F.col("v").alias("other")))
        parents = both.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("parent"))
        roots = _roots(parents)
        levels.append(roots)
        first = edges.join(roots, edges["u"] == roots["node"]).select(F.col("root").alias("x"), "v")
        second = written(first.distinct(), "edges", narrow=True).join(roots, F.col("v") == F.col("node")).select("x", F.col("root").alias("y"))
        edges = written(second.filter("x <> y").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct(), "edges", narrow=True)
        if not edges.limit(1).count():
            break
    whole = levels.pop().withColumnRenamed("root", "component")
    while levels:
        lower, upper = levels.pop(), whole.select(F.col("node").alias("at"), F.col("component").alias("far"))
        whole = written(lower.join(upper, lower["root"] == upper["at"], "left").select("node", F.coalesce("far", "root").alias("component")), "components", narrow=True)
    return whole
