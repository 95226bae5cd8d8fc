"""Connected components of an undirected graph of integer vertices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """(vertex, component): the least vertex that each vertex of edges (a, b) is joined to.

    Each round takes the least label among the neighbours and then the label of
    that label, so paths shrink by half or more; rounds end when no label moves.
    Rows are cut from their lineage each round, and a vertex with very many
    edges is only ever on the side of a join that Spark can split.
    """
    both = cut_lineage(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    labels = cut_lineage(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "vertex"))
    while True:
        near = both.join(labels, both["b"] == labels["vertex"]).select(both["a"].alias("vertex"), "label")
        least = cut_lineage(near.union(labels.select("vertex", "label")).groupBy("vertex").agg(F.min("label").alias("label")))
        roots = least.select(F.col("vertex").alias("root"), F.col("label").alias("further"))
        new = cut_lineage(least.join(roots, least["label"] == roots["root"]).select("vertex", F.least("label", "further").alias("label")))
        moved = new.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        before = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        labels = new
        if moved == before:  # labels only ever fall
            return labels.select("vertex", F.col("label").alias("component"))
