"""Connected components of an undirected graph, by smallest neighbours, shortcuts and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, materialize


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """edges: a, b (long); rows: a bound of their number, if known. Gives node, label (the smallest node of its component) for every node that has an edge.

    Each round a node takes its smallest neighbour if that is smaller, follows it a step on, and edges are carried over to the labels;
    those within one label go, so the graph shrinks fast and each edge is joined once or twice in all. Rounds are written to
    the shared folder; only the number of edges left comes to the driver. Minima are aggregated before they are shuffled, and joins meet written
    tables, so adaptive execution can split a node with very many edges.
    """
    ordered = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    left = materialize(edges.where("a <> b").select(*ordered("a", "b")).distinct(), "cc-edges", rows)
    labels = None
    while n := left.count():
        both = left.select(F.col("a").alias("node"), F.col("b").alias("near")).unionByName(left.select(F.col("b").alias("node"), F.col("a").alias("near")))
        near = materialize(both.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("label")), "cc-near", 2 * n)
        step = materialize(near.join(moves(near), "label").select("node", F.col("far").alias("label")), "cc-steps", 2 * n)
        side = lambda c: step.select(F.col("node").alias(c), F.col("label").alias(f"l{c}"))
        carried = left.join(side("a"), "a").join(side("b"), "b").where("la <> lb")
        fewer = materialize(carried.select(*ordered("la", "lb")).distinct(), "cc-edges", n)
        if labels is None:
            first, labels = 2 * n, step
            discard(near, left)
        else:
            fresh = materialize(labels.join(moves(step), "label", "left").select("node", F.coalesce("far", "label").alias("label")), "cc-labels", first)
            discard(near, left, labels, step)
            labels = fresh
        left = fewer
    return left.select(F.col("a").alias("node"), F.col("b").alias("label")) if labels is None else labels


def moves(labels: DataFrame) -> DataFrame:
    """labels (node, label) as label, far: where a label leads."""
    return labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
