"""Connected components of a large graph by contraction, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltide.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b); a component is named by one of its nodes.

    Each round points every node at the least of itself and its neighbours, follows the pointers twice, and
    replaces edges by those between the nodes pointed at, until none is left: a number of rounds that grows with the
    logarithm of the size of the largest component. Neighbours are reduced by an aggregate, never gathered.
    """
    rest = cut_lineage(edges.where("a <> b").selectExpr("least(a, b) AS a", "greatest(a, b) AS b").distinct())
    labels: DataFrame | None = None
    while rest.limit(1).count():
        both = rest.unionByName(rest.selectExpr("b AS a", "a AS b"))
        point = cut_lineage(both.groupBy("a").agg(F.min("b").alias("m")).selectExpr("a AS node", "least(a, m) AS p"))
        jump = point.selectExpr("node AS p", "p AS pp")
        point = cut_lineage(point.join(jump, "p").selectExpr("node", "pp AS p"))
        if labels is None:
            labels = point.selectExpr("node", "p AS component")
        else:
            labels = cut_lineage(labels.join(point.selectExpr("node AS component", "p"), "component", "left").selectExpr(
                "node", "coalesce(p, component) AS component"))
        rest = cut_lineage(
            rest.join(point.selectExpr("node AS a", "p AS pa"), "a").join(point.selectExpr("node AS b", "p AS pb"), "b")
            .where("pa <> pb").selectExpr("least(pa, pb) AS a", "greatest(pa, pb) AS b").distinct())
    return labels if labels is not None else rest.selectExpr("a AS node", "b AS component")
