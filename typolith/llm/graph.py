"""Connected components of an edge table by minimum labels and contraction; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise


def _renamed(labels: DataFrame, side: str) -> DataFrame:
    return labels.select(F.col("node").alias(f"_n{side}"), F.col("label").alias(f"_l{side}"))


def _contracted(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """The edges between labels of their ends, each once; those within one label are gone."""
    ends = edges.join(_renamed(labels, "a"), F.col("a") == F.col("_na"), "left").join(_renamed(labels, "b"), F.col("b") == F.col("_nb"), "left")
    a, b = F.coalesce("_la", "a"), F.coalesce("_lb", "b")
    return materialise(ends.filter(a != b).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(), "edges")


def _mapped(labels: DataFrame, roots: DataFrame) -> DataFrame:
    """Labels with those that roots name replaced by their own label."""
    return labels.join(_renamed(roots, ""), F.col("label") == F.col("_n"), "left").select("node", F.coalesce("_l", "label").alias("label"))


def _hooked(edges: DataFrame) -> DataFrame:
    """(node, label) of every end of an edge: each takes its least neighbour, if that is less, then the label of its label until none moves."""
    both = edges.select("a", "b").union(edges.select("b", "a"))
    roots = materialise(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).select(F.col("a").alias("node"), "label"), "labels")
    while True:
        jumped = roots.join(_renamed(roots, ""), F.col("label") == F.col("_n")).select("node", F.col("_l").alias("label"), (F.col("_l") < F.col("label")).alias("moved"))
        jumped = materialise(jumped, "labels")
        roots = jumped.select("node", "label")
        if not jumped.filter("moved").limit(1).count():
            return roots


def components(edges: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(node, label): the smallest node reachable from each node of edges (a, b), and of the earlier edges whose labels are given.

    A round joins at least every two neighbouring labels to one, and only edges between different labels go on, so rounds are at most
    log2 of the nodes and a star or a clique is done in one. Each step is written to the shared scratch folder.
    """
    rest = materialise(edges.select("a", "b").distinct(), "edges") if labels is None else _contracted(edges, labels)
    found = None
    while rest.limit(1).count():
        roots = _hooked(rest)
        found = roots if found is None else materialise(_mapped(found, roots), "labels")
        rest = _contracted(rest, roots)
    if found is None:
        return rest.select(F.col("a").alias("node"), F.col("b").alias("label")) if labels is None else labels
    if labels is None:
        return found
    return materialise(_mapped(labels, found).unionByName(found.join(labels.select("node"), "node", "left_anti")), "labels")
